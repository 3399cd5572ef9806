"""Nested views, built bottom-up for all words at once, and their flat forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.relational import top_k


def packed(df: DataFrame, by: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows of a group as an ordered array of structs (AGG-25, NST-08..10): sorted by ``order``, with ``fields`` alone."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_row"))))
    return df.groupBy(*by).agg(F.transform(rows, lambda x: x["_row"]).alias(name))


def entry_views(entry: DataFrame, sense: DataFrame, example: DataFrame, form: DataFrame, pronunciation: DataFrame) -> DataFrame:
    """AGG-25, NST-11, LKP-06, SRT-06, JOIN-13, AGG-23, AGG-24: word, freq_rank, ipa, blocks.

    Blocks: entries with AI senses first, then in order; senses learner layer first; examples inside senses.
    """
    exs = packed(example.repartition("sense_id"), ["sense_id"], ["ord"], ["text_en", "text_vi"], "examples")
    senses = sense.join(exs, sense["id"] == exs["sense_id"], "left").withColumn("_layer", F.when(F.col("layer") == "learner", 0).otherwise(1))
    senses = senses.withColumn("examples", F.coalesce("examples", F.array().cast("array<struct<text_en:string,text_vi:string>>")))
    # Dealt out by sense, an entry's senses seldom meet before the shuffle: rows are sent as they are, not as lists of one.
    senses = senses.select("entry_id", "_layer", "ord", "layer", "guideword", "grammar", "labels", "definition", "vi", "examples").repartition("entry_id")
    ss = packed(senses, ["entry_id"], ["_layer", "ord"], ["layer", "guideword", "grammar", "labels", "definition", "vi", "examples"], "senses")
    fs = packed(form, ["entry_id"], ["ord"], ["form", "tags"], "forms")
    blocks = entry.join(ss.withColumnRenamed("entry_id", "id"), "id", "left").join(fs.withColumnRenamed("entry_id", "id"), "id", "left")
    blocks = blocks.withColumn("_plain", F.col("ai_model").isNull())
    views = packed(blocks, ["headword"], ["_plain", "ord"], ["pos", "entry_type", "cefr", "etymology", "forms", "senses"], "blocks")
    place = F.struct(F.col("ai_model").isNull(), "ord")
    sounds = pronunciation.join(entry.select(F.col("id").alias("entry_id"), "headword", place.alias("_place")), "entry_id")
    first = lambda accent: F.min_by("ipa", F.when(F.col("accent") == accent, F.col("_place"))).alias(accent)
    ipa = sounds.groupBy("headword").agg(first("uk"), first("us"))
    rank = entry.groupBy("headword").agg(F.min_by("freq_rank", F.when(F.col("freq_rank").isNotNull(), place)).alias("freq_rank"))
    return views.join(rank, "headword").join(ipa, "headword", "left").select(F.col("headword").alias("word"), "freq_rank", F.struct("uk", "us").alias("ipa"), "blocks")


def usage_views(prep: DataFrame, coll: DataFrame, examples: DataFrame, seq: DataFrame) -> DataFrame:
    """NST-13, LKP-08, SRT-14: preps by count, collocations by pattern and rank, examples by score, 12 sequences."""
    n, score = -F.col("n"), -F.col("score")
    a = packed(prep.withColumn("_n", n), ["headword"], ["_n", "pos", "prep"], ["pos", "prep", "obj", "n", "ratio", "common"], "preps")
    b = packed(coll, ["headword"], ["pos", "pattern", "rank"], ["pos", "pattern", "display", "n"], "colls")
    c = packed(examples.withColumn("_s", score), ["headword"], ["_s", "text"], ["pos", "kind", "key", "text", "source", "hl_start", "hl_end", "n_words"], "examples")
    top = top_k(seq, ["headword"], [F.desc("n"), F.asc("pos"), F.asc("seq")], 12)
    d = packed(top.withColumn("_n", n), ["headword"], ["_n", "pos", "seq"], ["pos", "seq", "n"], "seqs")
    return a.join(b, "headword", "full_outer").join(c, "headword", "full_outer").join(d, "headword", "full_outer").withColumnRenamed("headword", "word")


def known_words(refs: DataFrame, headwords: DataFrame) -> DataFrame:
    """JOIN-14, T18: the words that a view mentions and that are headwords, sorted."""
    return refs.join(headwords.select(F.col("word").alias("ref")), "ref", "left_semi").groupBy("word").agg(F.array_sort(F.collect_set("ref")).alias("known"))


def numbered_text(xs: Column, text, sep: str = "; ") -> Column:
    """VAR-42, NST-16: "1. a; 2. b", without numbers if there is one."""
    return F.when(F.size(xs) == 1, text(F.get(xs, F.lit(0)))).otherwise(F.array_join(F.transform(xs, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), text(x))), sep))


def csv_line(*columns: Column | str) -> Column:
    """NST-16, SNK-18..20: quoted fields joined by commas."""
    return F.concat_ws(",", *[T.csv_field(c) for c in columns])


def json_list(c: Column | str) -> Column:
    """NST-04: an array kept as JSON text; what can't be read is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def copied_senses(learner: Column, full: Column, k: int = 12) -> Column:
    """VAR-41."""
    return F.when(F.size(learner) > 0, learner).otherwise(F.slice(full, 1, k))


def sections(**sizes: Column) -> Column:
    """VAR-40: the parts of an entry that aren't empty, in order."""
    return F.transform(F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("n")) for k, v in sizes.items()]), lambda x: x["n"] > 0), lambda x: x["name"])
