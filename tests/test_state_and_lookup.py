"""Lookups on a small lexicon, user state, quality rules and streams."""

import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators import corpus, lookup, quality, relational, state
from wordloom.streaming import history


@pytest.fixture(scope="module")
def lex(spark):
    words = [("bank", 10), ("bake", 20), ("band", None), ("ban", 5), ("Bank", 90), ("receive", 7), ("went", None), ("go", 1), ("take off", 30), ("nha", None)]
    table = lookup.headwords(spark.createDataFrame(words, "word string, freq_rank bigint"))
    index = spark.createDataFrame([("went", "go"), ("banks", "bank"), ("going", "go")], "form_norm string, headword string")
    vi = spark.createDataFrame([("nhà", "nha", 5, True), ("nhá", "nha", 1, False), ("bàn", "ban", 3, False), ("đi", "di", 1, True)], "word string, norm string, n_links bigint, has_wikt boolean")
    return table, index, vi


def ask(spark, *rows):
    return spark.createDataFrame(rows, "raw string, mode string")


def test_suggest(spark, lex):
    table, index, vi = lex
    got = lookup.suggest(ask(spark, ("ba", "envi"), ("bàn", "envi"), ("going", "envi"), ("ban", "vien"), ("", "envi"), ("x" * 300, "envi")), table, vi, index)
    rows = {}
    for r in got.orderBy("place").collect():
        rows.setdefault((r.raw, r.mode), []).append(r.key)
    assert rows["ba", "envi"] == ["ban", "bank", "bake", "Bank", "band", "vi:bàn"]
    assert rows["bàn", "envi"][0] == "vi:bàn" and rows["ban", "vien"] == ["vi:bàn", "ban", "bank", "Bank", "band"]
    assert rows["going", "envi"] == ["go"] and ("", "envi") not in rows


def test_lookup(spark, lex):
    table, index, vi = lex
    got = {r.raw: (r.kind, r.words, r.also) for r in lookup.lookup(ask(spark, ("bank", "envi"), ("BANK", "envi"), ("went", "envi"), ("nha", "vien"), ("bàn", "envi"), ("ban", "envi"), ("vi:đi", "envi"), ("zzz", "envi"), (" ?!", "envi"), ("12", "envi"), ("going", "envi")), table, index, vi).collect()}
    assert got["bank"] == ("en", ["bank"], None) and got["BANK"][:2] == ("en", ["bank"]) and got["went"][:2] == ("en", ["went"])
    assert got["nha"] == ("choice", ["nhà", "nhá"], None) and got["bàn"] == ("vi", ["bàn"], None) and got["ban"] == ("en", ["ban"], "bàn")
    assert got["vi:đi"][:2] == ("vi", ["đi"]) and got["zzz"][0] == "none" and got["12"] == ("empty", None, None) and got["going"][:2] == ("en", ["go"])


def test_fuzzy(spark, lex):
    table, _, _ = lex
    got = lookup.fuzzy(spark.createDataFrame([("bnak",), ("recieve",), ("ba",)], "q string"), table, lookup.gram_index(table))
    rows = {(r.q, r.place): (r.word, r.distance) for r in got.collect()}
    assert rows["bnak", 1] == ("bank", 1) and rows["recieve", 1] == ("receive", 1) and not any(q == "ba" for q, _ in rows)
    assert [r.exists for r in lookup.exists(spark.createDataFrame([("bank",), ("x",)], "q string"), table).orderBy("q").collect()] == [True, False]


def test_batch_is_the_sum_of_single_queries(spark, lex):
    table, index, vi = lex
    qs = [("ban", "envi"), ("bank", "envi"), ("went", "vien")]
    whole = sorted(map(tuple, lookup.suggest(ask(spark, *qs), table, vi, index).collect()))
    assert whole == sorted(t for q in qs for t in map(tuple, lookup.suggest(ask(spark, q), table, vi, index).collect()))


def test_history_and_lists(spark):
    h = "id bigint, key string, label string, kind string, ts bigint"
    old = spark.createDataFrame([(1, "a", "a", "en", 10), (2, "b", "b", "en", 20)], h)
    new = state.add_history(old, spark.createDataFrame([(3, "a", "A", "en", 30)], h), keep=2)
    assert [(r.key, r.label, r.ts) for r in new.collect()] == [("a", "A", 30), ("b", "b", 20)]
    lists = spark.createDataFrame([(1, "Work", 0)], "id bigint, name string, created bigint")
    more = state.create_lists(lists, spark.createDataFrame([(" wORK ",), ("New  one",), ("",), ("new one",)], "name string"), 5)
    assert [(r.id, r.name) for r in more.orderBy("id").collect()] == [(1, "Work"), (2, "New one")]
    assert {r.name for r in state.rename_list(more, 2, "work").collect()} == {"Work", "New one"} and {r.name for r in state.rename_list(more, 2, "WORK 2").collect()} == {"Work", "WORK 2"}
    i = "id bigint, list_id bigint, word string, pos string, sense string, label string, added_at bigint"
    items = spark.createDataFrame([(1, 1, "run", "verb", "1", "run", 3)], i)
    items2 = state.add_items(items, spark.createDataFrame([(2, 1, "run", "verb", "1", "again", 4), (3, 1, "go", "verb", "", "go", 5)], i))
    assert [r.word for r in state.list_items(items2, 1).collect()] == ["go", "run"]
    assert {(r.name, r.n) for r in state.list_counts(more, items2).collect()} == {("Work", 2), ("New one", 0)}
    assert state.toggled(items2, items.select("*")).count() == 1 and state.remove_items(items2, [3]).count() == 1
    left, gone = state.delete_list(lists, items2, 1, 9)
    assert [tuple(r) for r in left.collect()] == [(1, state.DEFAULT_LIST, 9)] and gone.count() == 0 and state.cleared(items).count() == 0
    s = spark.createDataFrame([("a", "1"), ("active_list", "7")], "key string, value string")
    s2 = state.put_settings(s, spark.createDataFrame([("a", "2")], s.schema))
    assert state.settings_map(s2).first().settings == {"a": "2", "active_list": "7"} and state.active_list(more, s2).first().id == 1


def test_backup(spark):
    h = spark.createDataFrame([(1, "a", "a", "en", 10)], "id bigint, key string, label string, kind string, ts bigint")
    lists = spark.createDataFrame([(1, "Work", 0)], "id bigint, name string, created bigint")
    items = spark.createDataFrame([(1, 1, "run", "verb", "1", "run", 3)], "id bigint, list_id bigint, word string, pos string, sense string, label string, added_at bigint")
    s = spark.createDataFrame([("active_list", "1"), ("x", "y")], "key string, value string")
    doc = state.backup(lists, items, h, s, "2026-01-01", "1.0")
    assert json.loads(doc.first().document)["lists"][0]["items"][0]["word"] == "run"
    other = spark.createDataFrame([(4, "WORK", 0)], lists.schema)
    got = state.restore(other, items.limit(0), h.withColumn("ts", F.lit(5).cast("bigint")), s.limit(0), state.read_backup(doc), 1)
    assert [r.name for r in got[0].collect()] == ["WORK"] and [(r.list_id, r.word) for r in got[1].collect()] == [(4, "run")]
    assert [r.ts for r in got[2].collect()] == [10] and [tuple(r) for r in got[3].collect()] == [("x", "y")]
    for bad in ("{}", "nonsense", '{"format": "other", "version": 1, "lists": []}'):
        with pytest.raises(Exception):
            state.read_backup(spark.createDataFrame([(bad,)], "document string")).collect()


def test_quality_rules(spark):
    m = spark.createDataFrame([("entry", 99.0), ("definition", 97.9)], "metric string, pct double")
    assert {r.metric: r.ok for r in quality.gate(m, {"entry": 98.0, "definition": 98.0, "ipa": 1.0}).collect()} == {"entry": True, "definition": False, "ipa": False}
    with pytest.raises(ValueError, match="definition 97.9"):
        quality.assert_gate(m, {"definition": 98.0})
    sense = spark.createDataFrame([(1, 1, "learner", True), (2, 2, "full", True)], "id bigint, entry_id bigint, layer string, is_ai boolean")
    entry = spark.createDataFrame([(1, "m"), (2, None)], "id bigint, ai_model string")
    example = spark.createDataFrame([(1, True), (2, True)], "sense_id bigint, is_ai boolean")
    source = spark.createDataFrame([("a", "CC0"), ("b", None)], "id string, license string")
    assert {r.rule: r.n for r in quality.invariants(sense, entry, example, source).collect()} == {"ai sense without model": 1, "ai example outside the learner layer": 1, "source without licence": 1}


def test_sequences_and_chunks(spark):
    seq = spark.createDataFrame([("a", "VERB", "on sth in sth", 30), ("a", "VERB", "to sb for sth", 30), ("a", "VERB", "to for sth", 30), ("a", "VERB", "to sb about sth", 3)], "lemma string, pos string, seq string, n bigint")
    assert [r.seq for r in corpus.shown_sequences(seq).collect()] == ["to sb for sth"]
    patterns = spark.createDataFrame([("a", "VERB", "to", True)], "lemma string, pos string, prep string, pass boolean")
    assert {r.seq for r in corpus.passing_sequences(seq, patterns).collect()} == {"to sb for sth", "to for sth"}
    coll = spark.createDataFrame([("n", "NOUN", "verb_w", v, v, n, ld) for v, n, ld in (("have", 50, 4.0), ("minimize", 5, 9.0), ("do", 3, 5.0))], "lemma string, pos string, pattern string, display string, colloc string, n bigint, logdice double")
    assert [r.display for r in corpus.ranked_collocations(coll).orderBy("rank").collect()] == ["have", "minimize", "do"]
    ranked = relational.global_rank(spark.range(1000).repartition(7), [F.desc("id")], "r")
    assert {r.id: r.r for r in ranked.collect()} == {i: 1000 - i for i in range(1000)}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "id bigint, key string, label string, kind string, ts bigint"
    for k, rows in enumerate(([(1, "a", "a", "en", 1), (2, "b", "b", "en", 2)], [(3, "a", "A", "en", 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = history.upsert_history(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "h"), str(tmp_path / "c"))
        q.awaitTermination()
        last = k
    rows = spark.read.parquet(str(tmp_path / f"h/v{last}")).orderBy("key").collect()
    assert [(r.key, r.label, r.ts) for r in rows] == [("a", "A", 3), ("b", "b", 2)]
