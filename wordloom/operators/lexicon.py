"""Building the lexicon's tables from dictionary dumps, frequency lists and word nets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.relational import first_by, global_rank, top_k

#: Parts of speech and tags that are left out, those of phrases, particles, accents' tags.
SKIP_POS = "name character symbol romanization punct".split()
SKIP_VI_POS = "name character romanization symbol punct affix suffix prefix".split()
PHRASE_POS = "verb phrase prep_phrase adv adj intj proverb conj prep".split()
SKIP_TAGS = "obsolete archaic dialectal form-of alt-of misspelling".split()
SKIP_FORM_TAGS = "table-tags inflection-template obsolete archaic dialectal nonstandard alternative romanization".split()
BAD_SURFACE = "nonstandard humorous obsolete archaic dialect".split()
PARTICLES = (
    "up down off out in on away back over through about around along by for with into across after apart ahead forward to at behind together round "
    "under upon from against onto aside"
).split()
UK_TAGS, US_TAGS = "UK Received-Pronunciation British".split(), "US General-American".split()
CEFR = "A1 A2 B1 B2 C1 C2".split()
HEADWORD = r"^[A-Za-z][A-Za-z'\-.]*( [A-Za-z][A-Za-z'\-.]*)*$"
CORE_WORD = r"^[a-z]+$"


def words(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def frequency_ranks(rows: DataFrame, pattern: str | None = None, renumber: bool = True) -> DataFrame:
    """AGG-08, WIN-01, VAR-01..03: word and rank from word, bnc and frq; 0 and empty mean no figure."""
    least = F.least(*[F.nullif(F.col(c).try_cast("bigint"), F.lit(0)) for c in ("bnc", "frq")])
    best = rows.select("word", least.alias("least")).where("word IS NOT NULL AND least IS NOT NULL")
    best = (best.where(F.col("word").rlike(pattern)) if pattern else best).groupBy("word").agg(F.min("least").alias("least"))
    return global_rank(best, [F.asc("least"), F.asc("word")], "freq_rank").drop("least") if renumber else best.withColumnRenamed("least", "freq_rank")


def rerank_without(ranks: DataFrame, inflected: DataFrame) -> DataFrame:
    """VAR-04: ranks anew once pure inflected forms (column word) are gone."""
    return global_rank(ranks.join(inflected, "word", "left_anti").withColumnRenamed("freq_rank", "_old"), [F.asc("_old"), F.asc("word")], "freq_rank").drop("_old")


def cefr_levels(rows: DataFrame) -> DataFrame:
    """AGG-17, VAR-15: the lowest level of each word and part of speech; a headword may list several, parted by a slash."""
    level = F.array_position(words(CEFR), F.upper(F.trim("CEFR")))
    each = rows.select(F.explode(F.split("headword", "/")).alias("word"), T.pos_name("pos").alias("pos"), level.alias("level")).withColumn("word", F.trim("word"))
    return each.where("word <> '' AND level > 0").groupBy("word", "pos").agg(F.element_at(words(CEFR), F.min("level").cast("int")).alias("cefr"))


def cefr_histogram(rows: DataFrame) -> DataFrame:
    """VAR-14."""
    return rows.groupBy("CEFR").agg(F.count("*").alias("n"))


def usable_senses(senses: Column) -> Column:
    """FLT-07: with a gloss and without a tag that is left out."""
    return F.filter(senses, lambda s: (F.size(s["glosses"]) > 0) & ~F.coalesce(F.arrays_overlap(s["tags"], words(SKIP_TAGS)), F.lit(False)))


def is_lemma(senses: Column) -> Column:
    """VAR-11: some sense has a gloss and isn't a form of another word."""
    return F.exists(senses, lambda s: (F.size(s["glosses"]) > 0) & ~F.coalesce(F.array_contains(s["tags"], "form-of"), F.lit(False)))


def kept_forms(forms: Column, word: Column) -> Column:
    """FLT-12, SET-05: forms that are shown, without tables' own rows, empty marks and the word itself."""
    return F.filter(F.coalesce(forms, F.array().cast("array<struct<form:string,tags:array<string>,source:string>>")), lambda f: ~F.coalesce(F.arrays_overlap(f["tags"], words(SKIP_FORM_TAGS)), F.lit(False)) & ~F.coalesce(f["form"], F.lit("")).isin("", "-", "—") & (f["form"] != word))


def shown_forms(forms: Column, k: int = 6) -> Column:
    """WIN-14, VAR-07: the first k distinct forms; those of no conjugation table if there are any."""
    loose = F.filter(forms, lambda f: F.coalesce(f["source"], F.lit("")) == "")
    return F.slice(F.array_distinct(F.transform(F.when(F.size(loose) > 0, loose).otherwise(forms), lambda f: f["form"])), 1, k)


def transcriptions(sounds: Column) -> Column:
    """FLT-13, VAR-06: phonemic transcriptions for uk, us and any accent, the first of each."""
    slashed = F.filter(F.coalesce(sounds, F.array().cast("array<struct<ipa:string,tags:array<string>,audio:string>>")), lambda x: F.coalesce(x["ipa"].startswith("/"), F.lit(False)))
    first = lambda keep: F.get(F.filter(slashed, keep), F.lit(0))["ipa"]
    has = lambda tags: lambda x: F.coalesce(F.arrays_overlap(x["tags"], words(tags)), F.lit(False))
    return F.struct(first(has(UK_TAGS)).alias("uk"), first(has(US_TAGS)).alias("us"), first(lambda x: F.coalesce(F.size(x["tags"]), F.lit(0)) <= 0).alias("any"))


def shown_examples(examples: Column, k: int = 2, longest: int = 200) -> Column:
    """FLT-14."""
    return F.slice(F.transform(F.filter(F.coalesce(examples, F.array().cast("array<struct<text:string,type:string>>")), lambda x: F.coalesce(x["text"] != "", F.lit(False)) & ~F.coalesce(x["type"] == "quotation", F.lit(False)) & (F.length(x["text"]) <= longest)), lambda x: x["text"]), 1, k)


def vi_translations(row_translations: Column, senses: Column) -> Column:
    """NST-02: Vietnamese translations of the entry and of its senses: (header, word)."""
    vi = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<struct<code:string,word:string,sense:string>>")), lambda t: (t["code"] == "vi") & (F.coalesce(t["word"], F.lit("")) != ""))
    own = F.transform(vi(row_translations), lambda t: F.struct(F.coalesce(t["sense"], F.lit("")).alias("header"), t["word"].alias("word")))
    inner = F.flatten(F.transform(F.filter(senses, lambda s: F.size(s["glosses"]) > 0), lambda s: F.transform(vi(s["translations"]), lambda t: F.struct(F.coalesce(F.nullif(t["sense"], F.lit("")), F.element_at(s["glosses"], -1)).alias("header"), t["word"].alias("word")))))
    return F.concat(own, inner)


def english_entries(dump: DataFrame, core: DataFrame, ranks: DataFrame, vi_words: DataFrame) -> DataFrame:
    """SRC-03, FLT-08..14, AGG-30, NST-01, NST-03, LNG-08: one row for each (word, pos), documents merged in order.

    dump: parsed documents with a column ``place`` that orders them; core, ranks, vi_words: column word.  Arrays are
    appended in order, scalars take the first value that isn't empty.
    """
    flag = lambda df, name: df.select("word").distinct().withColumn(name, F.lit(True))
    rows = dump.where((F.col("lang_code") == "en") & ~F.col("pos").isin(SKIP_POS) & F.col("word").rlike(HEADWORD)).withColumn("raw_pos", F.col("pos")).withColumn("pos", T.pos_name("pos"))
    rows = rows.withColumn("senses", F.coalesce("senses", F.array().cast(dump.schema["senses"].dataType))).withColumn("good", usable_senses(F.col("senses"))).where(F.size("good") > 0)
    parts = F.split("word", " ")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    n_tr = size(F.col("translations")) + F.aggregate(F.transform("senses", lambda s: size(s["translations"])), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("n_translations", n_tr).withColumn("parts", parts).withColumn("popularity", (n_tr + 3 * F.size("good")).cast("bigint"))
    tokens = rows.where(F.size("parts") > 1).select("place", F.posexplode("parts").alias("at", "token")).withColumn("token", F.lower("token"))
    known = tokens.join(core.select(F.col("word").alias("token")).distinct(), "token", "left_semi").groupBy("place").agg(F.min("at").alias("first_core"), F.array_sort(F.collect_set("token")).alias("core_tokens"))
    rows = rows.join(known, "place", "left").join(flag(core, "_core"), "word", "left").join(flag(ranks, "_rank"), "word", "left").join(flag(vi_words, "_vi"), "word", "left")
    phrase = (F.size("parts") > 1) & F.col("pos").isin(PHRASE_POS) & F.col("core_tokens").isNotNull()
    verb = (F.col("pos") == "verb") & (F.size("parts") <= 3) & (F.col("first_core") == 0) & (F.size(F.array_except(F.slice("parts", 2, 9), words(PARTICLES))) == 0)
    kind = F.when(phrase & verb, "phrasal_verb").when(phrase, "idiom")
    rows = rows.withColumn("kind", kind).where(F.coalesce("_core", "_rank", "_vi", F.lit(False)) | phrase | (F.col("n_translations") >= 5))
    shaped = rows.select(
        "word", "pos", "place", "kind", "core_tokens", "popularity",
        F.coalesce("kind", F.when(F.size("parts") > 1, "phrase").otherwise("word")).alias("entry_type"),
        F.transform("good", lambda s: F.struct(F.element_at(s["glosses"], -1).alias("gloss"), F.coalesce(s["tags"], F.array().cast("array<string>")).alias("tags"), shown_examples(s["examples"]).alias("examples"))).alias("senses"),
        kept_forms(F.col("forms"), F.col("word")).alias("forms"), transcriptions(F.col("sounds")).alias("ipa"), F.nullif(T.clean_etymology("etymology_text"), F.lit("")).alias("etymology"),
        F.filter(F.transform(F.coalesce("derived", F.array().cast("array<struct<word:string>>")), lambda d: d["word"]), lambda w: (F.coalesce(w, F.lit("")) != "") & ~w.contains(" ")).alias("derived"),
        vi_translations(F.col("translations"), F.col("senses")).alias("vi"),
    )
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(c).alias("v")))), lambda x: x["v"]))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("place")))
    return shaped.groupBy("word", "pos").agg(
        F.min("place").alias("place"), F.min_by("entry_type", "place").alias("entry_type"), F.min_by("kind", "place").alias("kind"), F.min_by("core_tokens", "place").alias("core_tokens"), F.min_by("popularity", "place").alias("popularity"),
        ordered("senses").alias("senses"), F.array_distinct(ordered("forms")).alias("forms"), first(F.col("ipa.uk")).alias("ipa_uk"), first(F.col("ipa.us")).alias("ipa_us"), first(F.col("ipa.any")).alias("ipa_any"),
        first(F.col("etymology")).alias("etymology"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("derived")))).alias("derived"), ordered("vi").alias("vi"),
    )


def form_links(dump: DataFrame) -> DataFrame:
    """NST-01: (form, target, relation, tags) of inflected and variant forms."""
    senses = dump.where((F.col("lang_code") == "en") & ~F.col("pos").isin(SKIP_POS) & F.col("word").rlike(HEADWORD)).select("word", F.explode("senses").alias("s"))
    one = lambda field, relation: senses.select("word", F.explode(f"s.{field}").alias("t"), F.lit(relation).alias("relation"), F.coalesce("s.tags", F.array().cast("array<string>")).alias("tags"))
    both = one("form_of", "inflection").unionByName(one("alt_of", "variant"))
    good = (F.coalesce("t.word", F.lit("")) != "") & (F.col("t.word") != F.col("word")) & ~F.arrays_overlap("tags", words(["obsolete", "archaic", "misspelling"]))
    return both.where(good).select(F.col("word").alias("form"), F.col("t.word").alias("target"), "relation", F.array_sort(F.array_except("tags", words(["form-of", "alt-of"]))).alias("tags")).distinct()


def lookup_index(links: DataFrame, headwords: DataFrame) -> DataFrame:
    """JOIN-10: forms whose target is a headword and which aren't headwords themselves."""
    hw = headwords.select("word")
    kept = links.join(hw.withColumnRenamed("word", "target"), "target", "left_semi").join(hw.withColumnRenamed("word", "form"), "form", "left_anti")
    return kept.select(T.fold("form").alias("form_norm"), F.col("target").alias("headword"), "relation", "tags")


def surface_forms(index: DataFrame, lemmas: DataFrame) -> DataFrame:
    """SRC-20: the inflected forms of each lemma, itself included."""
    good = index.where("relation = 'inflection'").where(~F.arrays_overlap("tags", words(BAD_SURFACE)) & F.col("form_norm").rlike(r"^\p{L}+$"))
    found = good.join(lemmas.select(F.col("lemma").alias("headword")).distinct(), "headword").select(F.col("headword").alias("lemma"), F.lower("form_norm").alias("form"))
    return found.union(lemmas.select("lemma", F.col("lemma").alias("form"))).distinct()


def phrase_links(entries: DataFrame) -> DataFrame:
    """JOIN-21, SET-07, WIN-13: core words of phrases, each phrase once, with its gloss and popularity."""
    rows = entries.where("kind IS NOT NULL").select("word", "kind", "popularity", "place", F.get("senses", F.lit(0))["gloss"].alias("gloss"), F.explode("core_tokens").alias("headword"))
    once = first_by(rows, ["headword", "word"], [F.asc("place")])
    return once.select("headword", F.col("word").alias("phrase"), "kind", "gloss", "popularity")


def family(entries: DataFrame, headwords: DataFrame) -> DataFrame:
    """FLT-28, JOIN-05, AGG: derived words that are headwords themselves."""
    members = entries.select(F.col("word").alias("headword"), F.explode("derived").alias("member")).where("headword <> member").distinct()
    return members.join(headwords.select(F.col("word").alias("member")), "member", "left_semi").select("headword", "member")


def matched_translations(senses: DataFrame, translations: DataFrame, least: float = 0.25) -> DataFrame:
    """JOIN-09: each translation header's best sense by shared words, null where none reaches ``least``.

    senses: entry_id, ord, gloss; translations: entry_id, header, word, place.
    """
    heads = translations.groupBy("entry_id", "header").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words"))
    pairs = heads.join(senses, "entry_id").withColumn("score", T.jaccard(T.gloss_tokens("header"), T.gloss_tokens("gloss")))
    best = top_k(pairs.where(F.col("score") >= least), ["entry_id", "header"], [F.desc("score"), F.asc("ord")], 1).select("entry_id", "header", "ord")
    return heads.join(best, ["entry_id", "header"], "left")


def thesaurus(links: DataFrame, synsets: DataFrame) -> DataFrame:
    """JOIN-17: word, pos, ord, definition, members, hypernyms from (word, pos, ord, synset) and (id, members, definition, hypernym)."""
    upper = synsets.select(F.col("id").alias("up_id"), F.get("members", F.lit(0)).alias("up_word"))
    own = links.join(synsets.withColumnRenamed("id", "synset"), "synset")
    ups = own.select("word", "pos", "ord", F.posexplode("hypernym").alias("at", "up_id")).join(upper, "up_id").groupBy("word", "pos", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "up_word"))), lambda x: x["up_word"]).alias("hypernyms"))
    return own.join(ups, ["word", "pos", "ord"], "left").select("word", "pos", "ord", F.get("definition", F.lit(0)).alias("definition"), F.filter("members", lambda m: m != F.col("word")).alias("members"), F.coalesce("hypernyms", F.array().cast("array<string>")).alias("hypernyms"))


def enriched(entries: DataFrame, ranks: DataFrame, cefr: DataFrame, ai: DataFrame, core: DataFrame) -> DataFrame:
    """JOIN-11, WIN-17: entries with rank, band, level, model and tier."""
    rows = entries.join(ranks, "word", "left").join(cefr, ["word", "pos"], "left").join(ai.select("word", "pos", F.col("model").alias("ai_model")), ["word", "pos"], "left").join(core.select("word", F.lit("A").alias("_tier")).distinct(), "word", "left")
    band = F.when(F.col("freq_rank") <= 3000, "Top 3000").when(F.col("freq_rank") <= 5000, "Top 5000")
    return rows.withColumn("freq_band", band).withColumn("tier", F.coalesce("_tier", F.lit("B"))).drop("_tier")


def latest_results(results: DataFrame) -> DataFrame:
    """SRC-21, BAT-09: one result for each (word, pos): the later pass, then the later file."""
    return first_by(results, ["word", "pos"], [F.desc("pass"), F.desc("file")])


def preferred_results(results: DataFrame) -> DataFrame:
    """SRC-22: the first model of a priority list."""
    return first_by(results, ["word", "pos"], [F.asc("priority"), F.asc("file")])


def source_senses(dump: DataFrame, wanted: DataFrame, longest: int = 160) -> DataFrame:
    """BAT-13: for each word of a set its entries in order: word, place, pos and senses of gloss, sorted tags and first example."""
    rows = dump.where((F.col("lang_code") == "en") & ~F.col("pos").isin(SKIP_POS)).join(wanted.select("word").distinct(), "word", "left_semi")
    sense = lambda s: F.struct(F.element_at(s["glosses"], -1).alias("gloss"), F.array_sort(F.coalesce(s["tags"], F.array().cast("array<string>"))).alias("tags"), F.get(shown_examples(s["examples"], 1, longest), F.lit(0)).alias("ex"))
    return rows.select("word", "place", T.pos_name("pos").alias("pos"), F.transform(usable_senses(F.col("senses")), sense).alias("senses")).where(F.size("senses") > 0)


def collected(dump: DataFrame, other: DataFrame, wanted: DataFrame) -> DataFrame:
    """BAT-14: the entries of ``source_senses`` and, from another dump, all glosses of each word: word, entries, glosses."""
    from wordloom.operators.nested import packed

    own = packed(source_senses(dump, wanted), ["word"], ["place"], ["pos", "senses"], "entries")
    glosses = other.where("lang_code = 'en'").select("word", "place", F.posexplode(F.flatten(F.transform("senses", lambda s: s["glosses"]))).alias("at", "gloss"))
    return wanted.select("word").distinct().join(own, "word", "left").join(packed(glosses, ["word"], ["place", "at"], ["gloss"], "glosses"), "word", "left")


def scanned(dump: DataFrame, wanted: DataFrame) -> DataFrame:
    """VAR-05: for each word of a set how many usable entries it has, and the phrases that hold it: word, entries, phrases."""
    from wordloom.operators.nested import packed

    want = wanted.select("word").distinct()
    rows = dump.where((F.col("lang_code") == "en") & ~F.col("pos").isin(SKIP_POS)).withColumn("good", usable_senses(F.col("senses"))).where(F.size("good") > 0)
    parts = F.split("word", " ")
    popularity = F.greatest(F.coalesce(F.size("translations"), F.lit(0)), F.lit(0)) + 3 * F.size("good")
    of = rows.where(F.size(parts) > 1).select(F.col("word").alias("phrase"), "pos", "place", parts.alias("parts"), F.element_at(F.col("good")[0]["glosses"], -1).alias("gloss"), popularity.alias("popularity"))
    of = of.select("*", F.explode(F.array_distinct("parts")).alias("word")).where("word <> phrase").join(want, "word", "left_semi")
    verb = (F.col("pos") == "verb") & (F.size("parts") <= 3) & (F.size(F.array_except(F.slice("parts", 2, 9), words(PARTICLES))) == 0) & (F.col("parts")[0] == F.col("word"))
    phrases = packed(of.withColumn("kind", F.when(verb, "phrasal_verb").otherwise("idiom")), ["word"], ["place"], ["phrase", "pos", "kind", "gloss", "popularity"], "phrases")
    entries = rows.groupBy("word").agg(F.count("*").alias("entries"))
    return want.join(entries, "word", "left").join(phrases, "word", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


def distinct_words(*sources: DataFrame) -> DataFrame:
    """AGG-15: source (its place) and how many distinct words it has, and ``all`` for their union."""
    every = None
    for i, df in enumerate(sources):
        one = df.select(F.lit(str(i)).alias("source"), "word")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("source").agg(F.count_distinct("word").alias("n")).unionByName(every.agg(F.lit("all").alias("source"), F.count_distinct("word").alias("n")))


def numbered_senses(senses: DataFrame) -> DataFrame:
    """WIN-16: numbers that go on across the entries of a word."""
    from pyspark.sql import Window as W

    return senses.withColumn("number", F.row_number().over(W.partitionBy("word").orderBy("entry", "sense")))


def validated(results: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NST-05, BAT-09: entries with their good senses, and rejects with a reason.

    results: word, pos, senses(array of struct src, definition, guideword, grammar, labels, vi, cefr, examples); sources:
    word, pos, n (senses of the entry).  Numbers run over all entries of a word.
    """
    total = sources.groupBy("word").agg(F.sum("n").alias("total"))
    rows = results.withColumn("pos", T.pos_name("pos")).join(total, "word", "left").join(sources.select("word", "pos", F.lit(True).alias("known")).distinct(), ["word", "pos"], "left")
    ok = lambda s: (F.trim(F.coalesce(s["definition"], F.lit(""))) != "") & (F.coalesce(F.size(s["src"]), F.lit(0)) > 0) & F.coalesce(F.forall(s["src"], lambda i: i.between(F.lit(1), F.col("total"))), F.lit(False))
    broken = F.col("word").isNull() | (F.coalesce("pos", F.lit("")) == "") | F.col("senses").isNull()
    rows = rows.withColumn("reason", F.when(broken, "word, pos or senses missing").when(F.col("known").isNull(), "not in the input"))
    rows = rows.withColumn("good", F.when(F.col("reason").isNull(), F.filter("senses", ok)))
    bad = rows.where("reason IS NULL").where(F.size("good") < F.size("senses")).withColumn("reason", F.lit("senses without definition or source"))
    return rows.where("reason IS NULL").select("word", "pos", F.col("good").alias("senses")), rows.where("reason IS NOT NULL").unionByName(bad).select("word", "pos", "reason")


def source_statistics(dump: DataFrame) -> DataFrame:
    """AGG-13, AGG-16, VAR-12: for each word its entries, senses and what it has."""
    any_ = lambda c: F.bool_or(F.coalesce(F.size(c), F.lit(0)) > 0)
    return dump.groupBy("word").agg(F.count("*").alias("entries"), F.sum(F.size(usable_senses(F.col("senses")))).alias("senses"), F.count_distinct("pos").alias("pos"), any_("sounds").alias("has_sound"), any_("forms").alias("has_forms"), any_("translations").alias("has_translations"), F.bool_or(is_lemma(F.col("senses"))).alias("is_lemma"))


def coverage_at(per_word: DataFrame, ranks: DataFrame, flags: list[str], cuts: list[int]) -> DataFrame:
    """AGG-14: for each cut-off the share of words at or above it that have each flag."""
    rows = ranks.join(per_word, "word", "left").select("freq_rank", *[F.coalesce(f, F.lit(False)).cast("double").alias(f) for f in flags])
    marks = rows.select(F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut"), "*").where("freq_rank <= cut")
    return marks.groupBy("cut").agg(F.count("*").alias("words"), *[F.avg(f).alias(f) for f in flags])
