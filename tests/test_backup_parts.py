"""A backup of many lists is several documents, and no row holds them all."""

import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators import state


def test_parts(spark):
    lists = spark.range(60).select("id", F.concat(F.lit("List "), "id").alias("name"), F.lit(0).cast("bigint").alias("created"))
    # The first list has 300 items, the last none.
    item = F.when(F.col("id") < 300, F.lit(0)).otherwise(F.col("id") % 59)
    items = spark.range(1500).select("id", item.cast("bigint").alias("list_id"), F.concat(F.lit("w"), "id").alias("word"), F.lit("v").alias("pos"), F.lit("1").alias("sense"), F.lit("x").alias("label"), (F.col("id") % 7).alias("added_at"))
    history = spark.createDataFrame([(1, "a", "a", "en", 10)], "id bigint, key string, label string, kind string, ts bigint")
    settings = spark.createDataFrame([("x", "y")], "key string, value string")
    docs = state.backup(lists, items, history, settings, "x", "1", most=100)
    texts = [json.loads(r.document) for r in docs.collect()]
    assert len(texts) == 16 == texts[0]["parts"] and max(sum(len(x.get("items", [])) for x in t["lists"]) for t in texts) < 400
    none = lists.limit(0), items.limit(0), history.limit(0), settings.limit(0)
    body = state.read_backup(docs)
    state.assert_backup(body)
    ls, its, visits, values = state.restore(*none, body, 1)
    assert ls.count() == 60 and visits.count() == 1 and [tuple(r) for r in values.collect()] == [("x", "y")]
    names = lambda ls, its: sorted(map(tuple, its.join(ls.select(F.col("id").alias("list_id"), "name"), "list_id").select("name", "word", "added_at").collect()))
    assert names(ls, its) == names(lists, items) and len(names(ls, its)) == 1500
    with pytest.raises(ValueError, match="of 16 documents"):
        state.assert_backup(body.where("part <> 3"))
