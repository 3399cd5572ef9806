"""Counts of a chunk are one file."""

from pathlib import Path

from pyspark.sql import functions as F

from wordloom.operators import corpus


def test_a_file_a_chunk(spark, tmp_path):
    s = spark.range(400).select((F.col("id") % 5).cast("int").alias("chunk"), F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" the")).alias("sentence"))
    # Spark itself would merge small tasks of these few words.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.word: r.n for r in corpus.partial_counts(s, str(tmp_path / "t")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == 401 and got["the"] == 400
    assert [len(list(d.glob("*.parquet"))) for d in Path(tmp_path / "t").glob("chunk=*")] == [1] * 5
