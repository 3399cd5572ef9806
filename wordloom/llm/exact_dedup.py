"""Exact duplicates, in DataFrame operations only.

Rows are grouped by the 128-bit hash of their white-space-normalised text and by the text itself, so that two
texts with one hash never share a group: comparing the grouping keys compares their bytes.  Copies inside a
partition fold before the shuffle, so a text that a third of all rows repeat travels once for each input partition.
The rows then take their group's result by (hash, second hash, length); where one of those triples stands for
several texts (a collision of both hashes), the texts themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import SPACE, cut, pick, plain


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, a text of white space only as one space (not as empty).  The smallest key of a group
    stays; a null key comes after all others and stays only where no row of the group has a key.  Of rows with one
    key and equal texts all are marked kept, as they are one document.  An empty table gives no rows.
    """
    rows = pick(df, key, text).toDF("doc_id", "raw")
    norm = F.regexp_replace(F.coalesce("raw", F.lit("")), SPACE, " ")
    rows = rows.select("doc_id", norm.alias("norm"))
    hashes = [F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("s"), F.octet_length("norm").alias("n")]
    groups = rows.groupBy(F.unhex(F.md5("norm")).alias("h"), "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(groups.select("h", F.unhex(F.sha2("norm", 256)).alias("s"), F.octet_length("norm").alias("n"), "keep_id", "group_size"))
    twice = groups.groupBy("h", "s", "n").agg(F.count("*").alias("texts")).where("texts > 1").select("h", "s", "n")
    marked = rows.select("doc_id", *hashes)
    if twice.isEmpty():
        out = marked.join(groups, ["h", "s", "n"])
    else:
        out = _by_bytes(rows.select("doc_id", "norm", *hashes))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))


def _by_bytes(rows: DataFrame) -> DataFrame:
    """The join by whole texts, for tables in which both hashes collide."""
    groups = rows.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, ["h", "norm"])


def drop_exact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows are told apart by their key: those of one key, or without a key, stay together if one of them stays.
    """
    kept = exact_groups(df, key, text).where("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    rows = plain(df)
    return rows.join(kept, rows[f"c{df.columns.index(key)}"].eqNullSafe(kept["kept_key"]), "left_semi").toDF(*df.columns)
