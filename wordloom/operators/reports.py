"""Reports, dimensions and text forms of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.nested import copied_senses, packed
from wordloom.operators.relational import first_by, top_k

#: Roles and patterns by part of speech, in the order in which they are shown.
ROLES = {
    "noun": "subject object after_prep complement noun_mod plural".split(),
    "verb": "base present s_form past pp ing passive to_inf ing_subject ing_after_prep".split(),
    "adj": "attributive predicative postnominal comparative superlative".split(),
    "adv": "initial mid_before mid_after final before_adj comparative superlative".split(),
}
PATTERNS = {"noun": "verb_w adj_w noun_noun w_verb quant_of_w".split(), "verb": "w_noun adv_w".split(), "adj": "adv_w verb_w w_noun".split(), "adv": "verb_w w_adj".split()}
POS_ORDER = ["verb", "noun", "adj", "adv"]


def dimension(spark: SparkSession, codes: dict[str, list[str]]) -> DataFrame:
    """VAR-36, VAR-37: pos, code and ord; a small table for a broadcast join."""
    return spark.createDataFrame([(p, c, i) for p, cs in codes.items() for i, c in enumerate(cs)], "pos string, code string, ord int")


def grouped_in_order(rows: DataFrame, dim: DataFrame, code: str, fields: list[str], order: list[str]) -> DataFrame:
    """NST-09, NST-10: rows grouped by (headword, pos, code), groups in the dimension's order."""
    at = F.broadcast(dim.withColumnsRenamed({"code": code, "ord": "group_ord"}))
    groups = packed(rows, ["headword", "pos", code], order, fields, "rows").join(at, ["pos", code])
    return packed(groups, ["headword"], ["pos", "group_ord"], ["pos", code, "rows"], "groups")


def preposition_groups(prep: DataFrame) -> DataFrame:
    """VAR-38: prepositions by part of speech in fixed order."""
    place = F.array_position(F.array(*[F.lit(p) for p in POS_ORDER]), F.col("pos"))
    rows = packed(prep.withColumn("_n", -F.col("n")), ["headword", "pos"], ["_n", "prep"], ["prep", "obj", "n"], "preps").withColumn("place", place).where("place > 0")
    return packed(rows, ["headword"], ["place"], ["pos", "preps"], "groups")


def unique_examples(examples: DataFrame) -> DataFrame:
    """FLT-32: of an entry's examples with one text the best, by score and then key."""
    return first_by(examples, ["headword", "pos", "text"], [F.desc_nulls_last("score"), F.asc("key")])


def preposition_examples(examples: DataFrame, k: int = 2) -> DataFrame:
    """VAR-39: the first k examples of each preposition; a key is preposition|complement."""
    rows = examples.where("kind = 'prep'").withColumn("prep", F.split("key", r"\|").getItem(0))
    return top_k(rows, ["headword", "pos", "prep"], [F.desc("score"), F.asc("text")], k, "place")


def default_role(roles: DataFrame, examples: DataFrame) -> DataFrame:
    """SRT-15: of the roles with sentences the one that the corpus has most often."""
    shown = examples.where("kind = 'role'").select("headword", "pos", F.col("key").alias("role")).distinct()
    return roles.join(shown, ["headword", "pos", "role"], "left_semi").groupBy("headword", "pos").agg(F.max_by("role", F.struct("n", "role")).alias("role"))


def kept_collocation_examples(examples: DataFrame, kept: DataFrame) -> DataFrame:
    """JOIN-18: examples (key pattern|display) of collocations that are kept."""
    key = kept.select("headword", "pos", F.concat_ws("|", "pattern", "display").alias("key"))
    return examples.where("kind <> 'coll'").unionByName(examples.where("kind = 'coll'").join(key, ["headword", "pos", "key"], "left_semi"))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """AGG-19."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def totals_by(df: DataFrame, by: str) -> DataFrame:
    """AGG-20: groups by their total, the largest first."""
    return df.groupBy(by).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc(by))


def background(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-27, LNG-10: lemma counts, and for each part of speech how many of its words have a preposition; on whole or sampled tokens."""
    from wordloom.operators.linguistic import _has, _is_prep, flat, packed

    lemmas = flat(tokens).where("is_alpha").groupBy(F.lower("lemma").alias("lemma"), "pos").agg(F.count("*").alias("n"))
    heads = packed(tokens).select("ts", F.transform(F.filter("ts", _is_prep), lambda p: p["head"]).alias("heads"))
    each = heads.select(F.inline_outer(F.transform(F.filter("ts", lambda t: t["is_alpha"]), lambda t: F.struct(t["pos"].alias("pos"), F.coalesce(_has("heads", t["i"]), F.lit(False)).alias("has"))))).where("has IS NOT NULL")
    rates = each.groupBy("pos").agg(F.count("*").alias("n"), F.count_if("has").alias("with_prep"))
    return lemmas, rates


def batch_progress(batches: DataFrame, results: DataFrame) -> DataFrame:
    """AGG-31: planned, done, failed and the rate an hour; results: id, ok, finished (epoch seconds)."""
    best = results.groupBy("id").agg(F.bool_or("ok").alias("ok"), F.min("finished").alias("finished"))
    rows = batches.select("id").join(best, "id", "left")
    span = F.greatest(F.lit(1), F.max("finished") - F.min("finished"))
    return rows.agg(F.count("*").alias("planned"), F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), (3600 * F.count_if("ok") / span).alias("per_hour"))


def hits_of_forms(sentences: DataFrame, forms: DataFrame, shown: int = 4, first: int | None = 12) -> DataFrame:
    """FLT-27, JOIN-22: lemma, sid, sentence, place: of each lemma's sentences the shortest ones, by an equi-join of tokens and forms (lemma, form).

    All of a lemma's sentences take part with ``first`` None, otherwise its first ones by sid.

    sentences: sid, sentence, sids without repeats.  No pattern of all forms is run over the text, and no text travels with a hit: a task keeps the few sids of each
    form that can be shown, a sentence that several forms of one hit being one, and the few that are shown then take their texts.
    """
    tokens = sentences.select("sid", F.length("sentence").alias("len"), F.explode(F.array_distinct(T.tokens("sentence"))).alias("form"))
    # A lemma's shortest sentences are among the shortest of each of its forms, and its first among their first, so common words send few rows from a task.
    tokens = top_k(tokens, ["form"], [F.asc("len"), F.asc("sid")], shown) if first is None else top_k(tokens, ["form"], [F.asc("sid")], first)
    hits = tokens.join(forms, "form").select("lemma", "sid", "len")
    if first is not None:
        hits = hits.withColumn("_n", F.dense_rank().over(W.partitionBy("lemma").orderBy("sid"))).where(F.col("_n") <= first).select("lemma", "sid", "len")
    return top_k(hits.distinct(), ["lemma"], [F.asc("len"), F.asc("sid")], shown, "place").join(sentences.select("sid", "sentence"), "sid").select("lemma", "sid", "sentence", "place")


def pair_texts(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """JOIN-12: each headword's sentence pairs by id."""
    return packed(words.join(pairs.select(F.col("id").alias("tid"), "en", "vi"), "tid"), ["headword"], ["tid"], ["en", "vi"], "pairs")


def vi_views(links: DataFrame, runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """NST-12, LKP-07: Vietnamese entries: links by rank, sense groups, sentence pairs; from the bilingual operators' results."""
    a = packed(links, ["vi"], ["rank"], ["headword", "pos", "guideword", "definition", "source"], "en").withColumnRenamed("vi", "word")
    b = packed(runs, ["word"], ["run"], ["pos", "glosses"], "wikt")
    return a.join(b, "word", "full_outer").join(pairs.withColumnRenamed("phrase", "word"), "word", "left")


def prompt_text(senses: DataFrame) -> DataFrame:
    """NST-14: word, its numbered senses by part of speech as one text; senses: word, pos, number, gloss."""
    line = F.concat(F.col("number").cast("string"), F.lit(". ["), "pos", F.lit("] "), "gloss")
    rows = senses.select("word", "number", line.alias("line"))
    return rows.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("payload"))


def antonyms(antonym: DataFrame, entry: DataFrame) -> DataFrame:
    """SET-08."""
    return antonym.join(entry.select(F.col("id").alias("entry_id"), "headword"), "entry_id").select("headword", "word").distinct()


def entry_text(views: DataFrame) -> DataFrame:
    """SNK-26, SNK-27, VAR-41, VAR-42: each entry as plain text and as HTML, from ``nested.entry_views``."""
    shown = lambda b: copied_senses(F.filter(b["senses"], lambda s: s["layer"] == "learner"), b["senses"])
    numbered = lambda b, pre, post, esc: F.transform(shown(b), lambda s, i: F.concat(F.lit(pre), F.when(F.size(shown(b)) > 1, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(""), esc(F.coalesce(s["definition"], F.lit(""))), F.lit(post)))
    plain = F.array_join(F.transform("blocks", lambda b: F.concat_ws("\n", b["pos"], F.array_join(numbered(b, "", "", lambda c: c), "\n"))), "\n")
    html = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("<p><i>"), T.escape_html(b["pos"]), F.lit("</i></p>"), F.coalesce(F.array_join(numbered(b, "<p>", "</p>", T.escape_html), ""), F.lit("")))), "")
    return views.select("word", F.concat_ws("\n", "word", plain).alias("text"), F.concat(F.lit("<b>"), T.escape_html("word"), F.lit("</b>"), html).alias("html"))


def bundle(views: DataFrame) -> DataFrame:
    """SNK-23: all entries of a small word set as one JSON document."""
    return views.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", F.to_json(F.struct("freq_rank", "ipa", "blocks"))))))).alias("document"))


#: Rows of a page of a report.
MOST_ROWS = 10_000


def markdown_table(df: DataFrame, title: str) -> str:
    """SNK-25: a report's section, all rows of ``df``: an aggregate as small as the page that shows it; more than MOST_ROWS raise."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no page")
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)]) + "\n"


def word_list(table: DataFrame) -> DataFrame:
    """VAR-29: lower-case, bare and sized words for a search without an index; the mean size is one aggregate more."""
    return table.select("word", F.lower("word").alias("low"), T.strip_marks(F.lower("word")).alias("bare"), F.greatest(F.lit(0), F.length("word") - 2).alias("size"))


def rank_key(rank: Column) -> Column:
    """VAR-32, T7: a missing rank comes last."""
    return F.coalesce(rank.cast("double"), F.lit(float("inf")))


def civil_date(days: Column) -> Column:
    """MTH-07."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def backup_due(n_items: Column, last: Column, now: Column) -> Column:
    """MTH-11: ten items or more and no backup for over 30 days; times in epoch seconds."""
    return (n_items >= 10) & (now - F.coalesce(last, F.lit(0)) > 30 * 86_400)


def by_engine(results: DataFrame) -> DataFrame:
    """VAR-47: each word's results side by side, one column of structs by engine."""
    return packed(results, ["word"], ["model", "pos"], ["model", "pos", "senses"], "results")
