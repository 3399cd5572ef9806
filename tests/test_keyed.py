"""Keyed stream state: restarts go on where they were, and idle keys begin anew."""

from datetime import datetime, timedelta

from wordloom.streaming import keyed

SCHEMA = "user_id bigint, key string, label string, ts timestamp, id bigint"
START = datetime(2024, 1, 1)


def add(spark, path, rows):
    spark.createDataFrame([(u, k, k.upper(), START + timedelta(minutes=m), i) for u, k, m, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **how):
    at = str(tmp_path)
    keyed.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint", **how)
    return {(r.user_id, r.key): (r.label, int((r.ts - START).total_seconds() // 60), r.id, r.visits) for r in keyed.history(spark, f"{at}/out").collect()}


def test_restart_goes_on(spark, tmp_path):
    add(spark, f"{tmp_path}/in", [(1, "a", 5, 1), (1, "a", 3, 2), (1, "b", 9, 3), (2, "a", 1, 4)])
    assert run(spark, tmp_path) == {(1, "a"): ("A", 5, 1, 2), (1, "b"): ("B", 9, 3, 1), (2, "a"): ("A", 1, 4, 1)}
    assert run(spark, tmp_path)[1, "a"] == ("A", 5, 1, 2)
    # An earlier visit counts, but the last one stays; of one moment the larger id.
    add(spark, f"{tmp_path}/in", [(1, "a", 4, 5), (2, "a", 1, 6), (3, "c", 2, 7)])
    assert run(spark, tmp_path) == {(1, "a"): ("A", 5, 1, 3), (1, "b"): ("B", 9, 3, 1), (2, "a"): ("A", 1, 6, 2), (3, "c"): ("C", 2, 7, 1)}


def test_idle_keys_begin_anew(spark, tmp_path):
    add(spark, f"{tmp_path}/in", [(1, "a", 0, 1), (1, "a", 1, 2), (2, "b", 1, 3)])
    run(spark, tmp_path, keep=600, late="1 minute")
    add(spark, f"{tmp_path}/in", [(2, "b", 300, 4)])
    run(spark, tmp_path, keep=600, late="1 minute")
    add(spark, f"{tmp_path}/in", [(1, "a", 301, 5)])
    got = run(spark, tmp_path, keep=600, late="1 minute")
    assert got[1, "a"] == ("A", 301, 5, 1) and got[2, "b"][2] == 4


def test_keys_without_timers_need_no_python(spark, tmp_path):
    """Without timers Spark's own aggregate is the state, which takes rows without a moment or a number too."""
    spark.createDataFrame([(1, "a", "A", START, None), (1, "a", "B", None, 7), (1, None, "C", START, 2)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    at = str(tmp_path)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
    assert "TransformWithState" not in keyed.last_visits(stream)._jdf.queryExecution().logical().toString()
    keyed.follow(stream, f"{at}/out", f"{at}/checkpoint")
    assert {(r.user_id, r.key): (r.label, r.ts, r.id, r.visits) for r in keyed.history(spark, f"{at}/out").collect()} == {(1, "a"): ("A", START, None, 2), (1, None): ("C", START, 2, 1)}
