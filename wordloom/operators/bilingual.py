"""The Vietnamese-English layer and sentence pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.lexicon import SKIP_VI_POS
from wordloom.operators.patterns import phrase_hits
from wordloom.operators.relational import first_by, runs, top_k

#: How much a link's source weighs.
WEIGHT = {"ai": 3, "wiktionary": 2, "viwikt": 1}
HAN = r"[\x{3400}-\x{9FFF}\x{20000}-\x{2FFFF}]"


def vietnamese_blocks(dump: DataFrame) -> DataFrame:
    """SRC-04, VAR-08: word, pos and glosses in order, from documents with a column place."""
    rows = dump.where("lang_code = 'en'").select("word", T.pos_name("pos").alias("pos"), "place", F.flatten(F.transform("senses", lambda s: F.coalesce(s["glosses"], F.array().cast("array<string>")))).alias("glosses"))
    rows = rows.withColumn("glosses", F.filter(F.transform("glosses", lambda g: F.trim(g)), lambda g: g != "")).where(F.size("glosses") > 0)
    return rows.groupBy("word", "pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "glosses"))), lambda x: x["glosses"])).alias("glosses"))


def vietnamese_senses(dump: DataFrame, most: int = 8) -> DataFrame:
    """SRC-05, VAR-09: words without Han signs, with up to 8 glosses an entry; columns place, ord, word, pos, gloss."""
    rows = dump.where((F.col("word") != "") & ~F.col("word").rlike(HAN) & ~F.col("pos").isin(SKIP_VI_POS))
    tags = F.array(*[F.lit(x) for x in ("form-of", "alt-of", "obsolete")])
    good = F.filter("senses", lambda s: (F.size(s["glosses"]) > 0) & ~F.coalesce(F.arrays_overlap(s["tags"], tags), F.lit(False)))
    glosses = F.slice(F.transform(good, lambda s: F.element_at(s["glosses"], -1)), 1, most)
    return rows.select("place", F.lower("word").alias("word"), T.pos_name("pos").alias("pos"), F.posexplode(glosses).alias("ord", "gloss"))


def links_of(senses: DataFrame, source: str) -> DataFrame:
    """STR-17, VAR-10: one link for each short term of a gloss; senses: headword, pos, guideword, definition, vi."""
    return senses.select(F.explode(T.vi_terms("vi")).alias("vi"), "headword", "pos", "guideword", "definition").withColumn("source", F.lit(source)).withColumn("weight", F.lit(WEIGHT[source]))


def vi_headwords(links: DataFrame, senses: DataFrame) -> DataFrame:
    """AGG-09, SET-03: words of both tables, with their number of links and whether they have senses."""
    a = links.groupBy(F.col("vi").alias("word")).agg(F.count("*").alias("n_links"))
    b = senses.select("word").distinct().withColumn("has_wikt", F.lit(True))
    return a.join(b, "word", "full_outer").select("word", T.fold("word").alias("norm"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("has_wikt", F.lit(False)).alias("has_wikt"))


def sentence_pairs(vie: DataFrame, links: DataFrame, eng: DataFrame, longest: int = 120) -> DataFrame:
    """SRC-10, JOIN-06, VAR-13: each English sentence with its first Vietnamese one; links have a column place."""
    known = links.join(vie.select(F.col("id").alias("vie_id"), F.col("text").alias("vi")), "vie_id")
    first = known.groupBy("eng_id").agg(F.min_by("vi", "place").alias("vi"))
    return first.join(eng.select(F.col("id").alias("eng_id"), F.col("text").alias("en")).where(F.length("text") <= longest), "eng_id").select("eng_id", "en", "vi")


def pairs_by_word(pairs: DataFrame, headwords: DataFrame, lemma_of: DataFrame, k: int = 6) -> DataFrame:
    """JOIN-07, WIN-05: the k shortest pairs of each headword; a word that isn't one counts for its lemma.

    pairs: tid, en; lemma_of: form, lemma.
    """
    tokens = pairs.select("tid", F.length("en").alias("len"), F.explode(F.array_distinct(T.tokens("en"))).alias("token"))
    hw = headwords.select(F.col("word").alias("token"), F.col("word").alias("own"))
    lemma = first_by(lemma_of, ["form"], [F.asc("lemma")]).select(F.col("form").alias("token"), "lemma")
    found = tokens.join(hw, "token", "left").join(lemma, "token", "left").select("tid", "len", F.coalesce("own", "lemma").alias("headword")).where("headword IS NOT NULL").distinct()
    return top_k(found, ["headword"], [F.asc("len"), F.asc("tid")], k).select("headword", "tid")


def pairs_by_phrase(pairs: DataFrame, phrases: DataFrame, longest: int = 4, first: int = 80, k: int = 5) -> DataFrame:
    """JOIN-23, FLT-22, T6: pairs whose Vietnamese side has a phrase, of ``longest`` words at most, as whole words, for all phrases at once.

    One automaton of all phrases goes along each sentence; only hits and lengths travel, no text.
    """
    words = F.filter(F.split(F.lower("vi"), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    wanted = phrases.select(F.col("word").alias("phrase")).where(F.size(F.split("phrase", " ")) <= longest)
    hits = phrase_hits(pairs.select(words.alias("words"), "tid", F.length("en").alias("len")), wanted, ["tid", "len"])
    order = [F.asc("len"), F.asc("tid")]
    return top_k(hits, ["phrase"], order, min(first, k)).select("phrase", "tid")


def grouped_links(links: DataFrame, k: int = 40) -> DataFrame:
    """AGG-10, SRT-09, T5: a word's links, one for each (headword, pos, guideword), the strongest first."""
    best = links.groupBy("vi", "headword", "pos", F.coalesce("guideword", F.lit("")).alias("gw")).agg(
        F.max_by(F.struct("guideword", "definition", "source"), F.struct("weight", F.coalesce(-F.col("freq_rank"), F.lit(-(1 << 62))), "definition")).alias("row"), F.max("weight").alias("weight"), F.min("freq_rank").alias("freq_rank")
    )
    order = [F.desc("weight"), F.asc_nulls_last("freq_rank"), F.asc("headword"), F.asc("pos"), F.asc("gw")]
    return top_k(best, ["vi"], order, k, "rank").select("vi", "headword", "pos", "row.guideword", "row.definition", "row.source", "weight", "freq_rank", "rank")


def sense_runs(senses: DataFrame) -> DataFrame:
    """AGG-26, NST-08: consecutive glosses of one part of speech as one group; senses: word, place, ord, pos, gloss."""
    grouped = runs(senses, ["word"], [F.asc("place"), F.asc("ord")], "pos").groupBy("word", "run", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ord", "gloss"))), lambda x: x["gloss"]).alias("glosses"))
    return grouped
