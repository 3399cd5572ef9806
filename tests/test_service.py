"""The facade, user tables on disk, and text forms of entries."""

import pytest
from pyspark.sql import functions as F

from wordloom.operators import lookup, reports, service, tables


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    entry = make([(1, "run", "verb", 0, "word", 5, "A1", None, None)], "id bigint, headword string, pos string, ord int, entry_type string, freq_rank bigint, cefr string, etymology string, ai_model string")
    sense = make([(1, 1, "full", 0, "move <fast>", None, None, None, None), (2, 1, "full", 1, "lead", None, None, None, None)], "id bigint, entry_id bigint, layer string, ord int, definition string, guideword string, grammar string, labels string, vi string")
    return {
        "headword": lookup.headwords(make([("run", 5), ("ran", 9)], "word string, freq_rank bigint")), "lookup_index": make([("running", "run")], "form_norm string, headword string"),
        "vi_headword": make([("chạy", "chay", 1, True)], "word string, norm string, n_links bigint, has_wikt boolean"), "entry": entry, "sense": sense,
        "example": make([], "sense_id bigint, ord int, text_en string, text_vi string"), "form": make([], "entry_id bigint, ord int, form string, tags array<string>"), "pronunciation": make([], "entry_id bigint, accent string, ipa string"),
        "source": make([("a", "A", "CC0")], "id string, name string, license string"),
    }


def test_commands(spark, t, tmp_path):
    root = str(tmp_path / "user")
    s = service.Service(t, service.open_user_state(spark, root))
    qs = spark.createDataFrame([("running", "envi"), ("chay", "vien")], "raw string, mode string")
    assert {(r.raw, r.kind, tuple(r.words)) for r in s.call("lookup", queries=qs).collect()} == {("running", "en", ("run",)), ("chay", "vi", ("chạy",))}
    assert s.call("suggest", queries=qs).count() == 2 and s.call("sources").count() == 1
    assert [r.word for r in s.call("get_entry", words=spark.createDataFrame([("run",), ("none",)], "word string")).collect()] == ["run"]
    with pytest.raises(KeyError):
        s.call("nothing")
    s.call("history_add", new=spark.createDataFrame([(1, "run", "run", "en", 5)], tables.USER["history"]))
    s.call("list_create", names=spark.createDataFrame([("Mine",)], "name string"), now=1)
    s.call("item_add", new=spark.createDataFrame([(1, 1, "run", "", "", "run", 2), (2, 1, "gone", "", "", "gone", 3)], tables.USER["wordlist_item"]))
    s.call("setting_set", new=spark.createDataFrame([("k", "v")], tables.USER["settings"]))
    assert [(r.word, r.exists) for r in s.call("items", list_id=1).collect()] == [("gone", False), ("run", True)]
    assert s.call("lists").first().n == 2 and "run" in s.call("backup", exported_at="x", app_version="1").first().document
    service.save_user_state(s.user, root)
    again = service.open_user_state(spark, root)
    assert {k: df.count() for k, df in again.items()} == {"history": 1, "wordlist": 1, "wordlist_item": 2, "settings": 1}
    (tmp_path / "user/history").rename(tmp_path / "user/kept")
    (tmp_path / "user/history").mkdir()
    (tmp_path / "user/history/part-0.parquet").write_bytes(b"damaged")
    assert service.open_user_state(spark, root)["history"].count() == 0 and list((tmp_path / "user").glob("_damaged_history*"))
    assert service.is_stale("2", "1") and not service.is_stale("2", "2")


def test_texts(spark, t):
    from wordloom.operators.nested import entry_views

    view = entry_views(t["entry"], t["sense"], t["example"], t["form"], t["pronunciation"])
    r = reports.entry_text(view).first()
    assert r.text == "run\nverb\n1. move <fast>\n2. lead" and "move &lt;fast&gt;" in r.html
    assert '"run"' in reports.bundle(view).first().document
    assert "| run |" in reports.markdown_table(view.select("word"), "Words")
    sizes = reports.word_list(t["headword"]).agg(F.avg("size")).first()[0]
    assert sizes == 1.0
    d = reports.dimension(spark, reports.ROLES)
    rows = spark.createDataFrame([("run", "noun", "plural", 1), ("run", "noun", "subject", 2)], "headword string, pos string, role string, n int")
    assert [g.role for g in reports.grouped_in_order(rows, d, "role", ["n"], ["n"]).first().groups] == ["subject", "plural"]
    prep = spark.createDataFrame([("run", "noun", "for", "", 9), ("run", "verb", "on", "sth", 1), ("run", "verb", "to", "sb", 5)], "headword string, pos string, prep string, obj string, n bigint")
    assert [[p.prep for p in g.preps] for g in reports.preposition_groups(prep).first().groups] == [["to", "on"], ["for"]]
    results = spark.createDataFrame([("a", False, 10), ("a", True, 20), ("b", False, 30)], "id string, ok boolean, finished bigint")
    p = reports.batch_progress(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), results).first()
    assert (p.planned, p.done, p.failed) == (3, 1, 1)
    senses = spark.createDataFrame([("run", "verb", 2, "b"), ("run", "noun", 1, "a")], "word string, pos string, number int, gloss string")
    assert reports.prompt_text(senses).first().payload == "1. [noun] a\n2. [verb] b"
    vi = reports.vi_views(spark.createDataFrame([("chạy", 1, "run", "verb", None, "d", "ai")], "vi string, rank int, headword string, pos string, guideword string, definition string, source string"), spark.createDataFrame([("đi", 1, "verb", ["go"])], "word string, run int, pos string, glosses array<string>"), spark.createDataFrame([("đi", "1")], "phrase string, tid string"))
    assert {r.word for r in vi.collect()} == {"chạy", "đi"}


def test_where_tables_are(monkeypatch):
    """VAR-50: the environment, then what is given, in order."""
    monkeypatch.delenv("WORDLOOM_TABLES", raising=False)
    assert service.locate(None, "", "b", "c") == "b"
    with pytest.raises(FileNotFoundError):
        service.locate(None)
    monkeypatch.setenv("WORDLOOM_TABLES", "a")
    assert service.locate("b") == "a"


def test_command_line(spark, t, tmp_path, monkeypatch, capsys):
    """LKP-13: counts and searches over written tables."""
    every = tables.CORE | tables.BILINGUAL
    given = {name: t.get(name, spark.createDataFrame([], schema)) for name, schema in every.items()} | {"meta": spark.createDataFrame([("schema_version", tables.SCHEMA_VERSION)], "key string, value string")}
    tables.write_tables(given, str(tmp_path / "t"), every)
    monkeypatch.setenv("WORDLOOM_TABLES", str(tmp_path / "t"))
    service.main(["lookup", "running"])
    assert "run" in capsys.readouterr().out
    service.main(["counts"])
    assert "headword" in capsys.readouterr().out
    service.main(["fuzzy", "rnu"])
    assert "run" in capsys.readouterr().out


def test_web_commands(spark, t):
    """LKP-15: lists are renamed, deleted, exported, saved, cleared and restored; a text that is no backup changes nothing."""
    make = spark.createDataFrame
    user = {name: make([], schema) for name, schema in tables.USER.items()}
    s = service.Service(t, user)
    s.call("list_create", names=make([("One",), ("Two",)], "name string"), now=1)
    s.call("item_add", new=make([(1, 1, "run", "v", "", 'a "b"', 2), (2, 1, "ran", "", "", "x, y", 3), (3, 2, "run", "", "", "z", 4)], tables.USER["wordlist_item"]))
    s.call("list_rename", list_id=2, name=" Second ")
    assert s.call("csv", list_id=1).first().text == '﻿word,pos,sense,label\r\nran,,,"x, y"\r\nrun,v,,"a ""b"""\r\n'
    assert {r.key for r in s.call("saved_keys", list_id=1).collect()} == {"run|v|", "ran||"}
    s.call("setting_set", new=make([("active_list", "2")], tables.USER["settings"]))
    assert s.call("active_list").first().name == "Second"
    saved = s.call("backup", exported_at="x", app_version="1").collect()[0].document
    s.call("item_remove", ids=[1])
    s.call("list_delete", list_id=2, now=9)
    assert [(r.name, r.n) for r in s.call("lists").collect()] == [("One", 1)]
    with pytest.raises(Exception):
        s.call("restore", document=make([("no backup",)], "document string"), now=10)
    assert [(r.name, r.n) for r in s.call("lists").collect()] == [("One", 1)]
    s.call("clear")
    assert s.call("lists").count() == 0
    assert {(r.name, r.n) for r in s.call("restore", document=make([(saved,)], "document string"), now=10).collect()} == {("One", 2), ("Second", 1)}
