"""Lexicon building on hand-written dumps."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from wordloom.operators import batches, bilingual, export, lexicon, nested, tables
from wordloom.sources import readers

DUMP = [
    {"word": "run", "lang_code": "en", "pos": "verb", "etymology_text": "Etymology tree\n├ x\nFrom Old English.", "senses": [
        {"glosses": ["move fast"], "tags": ["intransitive"], "examples": [{"text": "He runs.", "type": "example"}, {"text": "q", "type": "quotation"}, {"text": "x" * 201}, {"text": "They run."}], "translations": [{"code": "vi", "word": "chạy", "sense": "move fast"}]},
        {"glosses": ["old"], "tags": ["obsolete"]}],
        "forms": [{"form": "ran", "tags": ["past"]}, {"form": "runs", "tags": ["table-tags"]}, {"form": "-"}, {"form": "run"}], "sounds": [{"ipa": "[x]"}, {"ipa": "/rʌn/", "tags": ["UK"]}, {"ipa": "/rən/"}],
        "derived": [{"word": "runner"}, {"word": "run off"}], "translations": [{"code": "vi", "word": "chạy nhanh", "sense": "to go"}, {"code": "de", "word": "laufen"}]},
    {"word": "run", "lang_code": "en", "pos": "verb", "senses": [{"glosses": ["be in charge"], "tags": ["transitive"]}], "sounds": [{"ipa": "/ran/", "tags": ["UK"]}], "forms": [{"form": "running", "tags": ["participle"]}], "derived": [{"word": "rerun"}]},
    {"word": "ran", "lang_code": "en", "pos": "verb", "senses": [{"glosses": ["past of run"], "tags": ["form-of", "past"], "form_of": [{"word": "run"}]}]},
    {"word": "run up", "lang_code": "en", "pos": "verb", "senses": [{"glosses": ["climb"]}], "translations": [{"code": "fr", "word": "x"}] * 2},
    {"word": "run of the mill", "lang_code": "en", "pos": "phrase", "senses": [{"glosses": ["ordinary"]}]},
    {"word": "Zzyx", "lang_code": "en", "pos": "name", "senses": [{"glosses": ["a name"]}]},
    {"word": "rare", "lang_code": "en", "pos": "adj", "senses": [{"glosses": ["not common"]}]},
    {"word": "laufen", "lang_code": "de", "pos": "verb", "senses": [{"glosses": ["run"]}]},
    {"word": "runner", "lang_code": "en", "pos": "noun", "senses": [{"glosses": ["one who runs"]}]},
]


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "en.jsonl.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.writelines(json.dumps(d, ensure_ascii=False) + "\n" for d in DUMP)
        f.write('broken "lang_code": "en"\n')
    return readers.dictionary(spark, str(path))


def words(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "word string")


def test_entries(spark, dump):
    rows = {(r.word, r.pos): r for r in lexicon.english_entries(dump, words(spark, "run"), words(spark, "runner"), words(spark, "none")).collect()}
    assert set(rows) == {("run", "verb"), ("run up", "verb"), ("run of the mill", "phrase"), ("runner", "noun")}
    run = rows["run", "verb"]
    assert [s.gloss for s in run.senses] == ["move fast", "be in charge"] and run.senses[0].examples == ["He runs.", "They run."]
    assert [f.form for f in run.forms] == ["ran", "running"] and (run.ipa_uk, run.ipa_any) == ("/rʌn/", "/rən/") and run.etymology == "From Old English."
    assert run.derived == ["rerun", "runner"] and [tuple(x) for x in run.vi] == [("to go", "chạy nhanh"), ("move fast", "chạy")]
    assert rows["run up", "verb"].entry_type == "phrasal_verb" and rows["run up", "verb"].popularity == 5 and rows["run of the mill", "phrase"].entry_type == "idiom"


def test_links(spark, dump):
    entries = lexicon.english_entries(dump, words(spark, "run"), words(spark, "runner"), words(spark, "none"))
    links = lexicon.form_links(dump)
    assert [tuple(r) for r in links.collect()] == [("ran", "run", "inflection", ["past"])]
    index = lexicon.lookup_index(links, words(spark, "run", "runner"))
    assert [(r.form_norm, r.headword) for r in index.collect()] == [("ran", "run")]
    assert {r.form for r in lexicon.surface_forms(index, spark.createDataFrame([("run",)], "lemma string")).collect()} == {"ran", "run"}
    assert {(r.headword, r.phrase, r.kind) for r in lexicon.phrase_links(entries).collect()} == {("run", "run up", "phrasal_verb"), ("run", "run of the mill", "idiom")}
    assert [tuple(r) for r in lexicon.family(entries, words(spark, "runner")).collect()] == [("run", "runner")]


def test_ranks_and_levels(spark, tmp_path):
    (tmp_path / "f.csv").write_text('word,phonetic,bnc,frq,other\nthe,ðә,1,2,x\nrun,,50,0,"a\nb"\nrun,,0,40,x\nzero,,0,0,x\n')
    freq = readers.frequency_csv(spark, str(tmp_path / "f.csv"))
    assert freq.columns == ["word", "phonetic", "bnc", "frq"]
    assert {r.word: r.freq_rank for r in lexicon.frequency_ranks(freq).collect()} == {"the": 1, "run": 2}
    assert {r.word: r.freq_rank for r in lexicon.rerank_without(lexicon.frequency_ranks(freq), words(spark, "the")).collect()} == {"run": 1}
    (tmp_path / "c.csv").write_text("﻿headword,pos,CEFR\nrun/go,verb,B1\nrun,verb,A1\n")
    levels = lexicon.cefr_levels(readers.profile_csv(spark, str(tmp_path / "c.csv")))
    assert {tuple(r) for r in levels.collect()} == {("run", "verb", "A1"), ("go", "verb", "B1")}


def test_word_net(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("entries-r.json", json.dumps({"run": {"v": {"sense": [{"synset": "s1"}, {"synset": "s2"}]}}}))
        z.writestr("verb.json", json.dumps({"s1": {"members": ["run", "go"], "definition": ["move"], "hypernym": ["s3"]}, "s2": {"members": ["run"], "definition": ["lead"]}, "s3": {"members": ["travel", "x"], "definition": ["t"]}}))
    rows = lexicon.thesaurus(*readers.word_net(spark, str(tmp_path / "w.zip"))).orderBy("ord").collect()
    assert [(r.definition, r.members, r.hypernyms) for r in rows] == [("move", ["go"], ["travel"]), ("lead", [], [])]


def test_results(spark):
    source = spark.createDataFrame([("run", "verb", 2), ("run", "noun", 1)], "word string, pos string, n int")
    sense = lambda src, d: {"src": src, "definition": d, "guideword": None, "grammar": None, "labels": None, "vi": None, "cefr": None, "examples": None, "vi_ok": None}
    rows = [("run", "Verb", [sense([1, 3], "move"), sense([4], "no such"), sense([], "x"), sense([1], " ")]), ("fly", "verb", [sense([1], "x")]), (None, "verb", [])]
    good, bad = lexicon.validated(spark.createDataFrame(rows, readers.RESULT), source)
    assert [(r.word, r.pos, [s.definition for s in r.senses]) for r in good.collect()] == [("run", "verb", ["move"])]
    assert sorted(r.reason for r in bad.collect()) == ["not in the input", "senses without definition or source", "word, pos or senses missing"]
    late = spark.createDataFrame([("a", "n", 1, "x", "old"), ("a", "n", 2, "w", "new")], "word string, pos string, pass int, file string, v string")
    assert [r.v for r in lexicon.latest_results(late).collect()] == ["new"]


def test_vietnamese(spark, tmp_path):
    path = tmp_path / "vi.jsonl"
    vi = [{"word": "Nhà", "pos": "noun", "senses": [{"glosses": ["house"]}, {"glosses": ["x"], "tags": ["obsolete"]}]}, {"word": "㐀", "pos": "noun", "senses": [{"glosses": ["h"]}]}, {"word": "nhà", "pos": "verb", "senses": [{"glosses": ["v"]}]}]
    path.write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in vi))
    senses = bilingual.vietnamese_senses(readers.dictionary(spark, str(path), None))
    assert [(r.word, r.pos, r.glosses) for r in bilingual.sense_runs(senses).orderBy("run").collect()] == [("nhà", "noun", ["house"]), ("nhà", "verb", ["v"])]
    links = bilingual.links_of(spark.createDataFrame([("house", "noun", None, "d", "nhà; căn nhà (to)")], "headword string, pos string, guideword string, definition string, vi string"), "ai")
    assert {r.vi for r in links.collect()} == {"nhà", "căn nhà"}
    assert {tuple(r) for r in bilingual.vi_headwords(links, senses).collect()} == {("nhà", "nha", 1, True), ("căn nhà", "can nha", 1, False)}


def test_sentences(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\teng\tHello there.\n2\tfra\tSalut\nbroken\n")
    assert [tuple(r) for r in readers.sentence_tsv(spark, str(tmp_path / "s.tsv")).collect()] == [("1", "eng", "Hello there.")]
    (tmp_path / "a.json").write_text('{"text": "This is a sentence of words. Short. Another one is here for you.", "namespace": 0}\n{"index": 1}\n{"text": "Talk page text is not wanted here.", "namespace": 1}\nnot json\n')
    both = readers.corpora(spark, {"tatoeba": str(tmp_path / "s.tsv"), "wiki": str(tmp_path / "a.json")})
    assert [r.sentence for r in both.orderBy("priority", "place").collect()] == ["Hello there.", "This is a sentence of words.", "Another one is here for you."]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.corpora(spark, {"wiki": str(tmp_path / "missing.json")})


def test_catalogue(spark):
    toml = '[[source]]\nid = "a"\nlicense = "CC0"\nname = "A|B"\nattribution = "x"\n'
    assert readers.catalogue(spark, toml).count() == 1
    assert "A\\|B" in export.licences_markdown(readers.catalogue(spark, toml)).first().text
    with pytest.raises(ValueError, match="licence"):
        readers.catalogue(spark, toml + '[[source]]\nid = "b"\n')


def test_tables(spark, tmp_path):
    root = str(tmp_path / "lex")
    meta = spark.createDataFrame([("schema_version", "2")], "key string, value string")
    hw = spark.createDataFrame([("run", "7"), ("go", "x")], "word string, freq_rank string")
    schemas = {k: tables.CORE[k] for k in ("meta", "headword")}
    for _ in range(2):
        tables.write_tables({"meta": meta, "headword": hw}, root, schemas)
    got = tables.open_tables(spark, root, schemas)
    assert {(r.word, r.freq_rank, r.tier) for r in got["headword"].collect()} == {("run", 7, None), ("go", None, None)}
    tables.write_tables({"meta": meta.withColumn("value", F.lit("1"))}, root, schemas)
    with pytest.raises(ValueError, match="version"):
        tables.open_tables(spark, root, schemas)


def test_views_and_shards(spark, tmp_path):
    entry = spark.createDataFrame([(1, "run", "noun", 0, "word", None, None, None, None), (2, "run", "verb", 1, "word", 5, "A1", None, "m")], "id bigint, headword string, pos string, ord int, entry_type string, freq_rank bigint, cefr string, etymology string, ai_model string")
    sense = spark.createDataFrame([(1, 2, "full", 0, "old"), (2, 2, "learner", 1, "b"), (3, 2, "learner", 0, "a")], "id bigint, entry_id bigint, layer string, ord int, definition string")
    sense = sense.select("*", *[F.lit(None).cast("string").alias(c) for c in ("guideword", "grammar", "labels", "vi")])
    example = spark.createDataFrame([(3, 1, "two", None), (3, 0, "one", "một")], "sense_id bigint, ord int, text_en string, text_vi string")
    form = spark.createDataFrame([(2, 0, "ran", ["past"])], "entry_id bigint, ord int, form string, tags array<string>")
    pron = spark.createDataFrame([(1, "uk", "/1/"), (2, "uk", "/2/")], "entry_id bigint, accent string, ipa string")
    view = nested.entry_views(entry, sense, example, form, pron)
    r = view.first()
    assert [b.pos for b in r.blocks] == ["verb", "noun"] and [s.definition for s in r.blocks[0].senses] == ["a", "b", "old"]
    assert [e.text_en for e in r.blocks[0].senses[0].examples] == ["one", "two"] and r.ipa.uk == "/2/" and r.freq_rank == 5
    docs = export.shards(view, "word", 8)
    assert json.loads(docs.first().document)["run"]["freq_rank"] == 5
    export.write_shards(docs, str(tmp_path / "sh"))
    assert export.read_shard(spark, str(tmp_path / "sh"), "run", 8).count() == 1
    files = spark.createDataFrame([("b.json", b"1"), ("a.json", b"2")], "path string, content binary")
    assert export.version_id(files).first() == export.version_id(files.orderBy("path")).first()
    assert export.oversized(files.union(spark.createDataFrame([("x.exe", b"")], files.schema))).count() == 1
    assert export.zipped({"b": b"1", "a": b"2"}) == export.zipped({"a": b"2", "b": b"1"})
    text = export.csv_text(spark.createDataFrame([(1, "a,b"), (0, "x")], "k int, line string"), ["k"], "h").first().text
    assert text == "﻿h\r\nx\r\na,b\r\n"


def test_batches(spark):
    words_ = spark.createDataFrame([(i, f"w{i}", c) for i, c in enumerate([3, 3, 20, 3, 0, 25, 3])], "place int, word string, cost int")
    plan = batches.plan(words_, "v", {"low": "s", "medium": "l"}, {"low": 2, "medium": 6}, {"low": 10, "medium": 40}).orderBy("rank_first").collect()
    assert [r.words for r in plan] == [["w0", "w1"], ["w2"], ["w3", "w6"], ["w5"]] and len({r.id for r in plan}) == 4 and all(len(r.id) == 14 for r in plan)
