"""The pipeline, stage by stage, against brute force on small tables."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from wordloom.llm import fuzzy_lines, secret_grammar, simhash
from wordloom.llm.set_links import jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, "123 456 !!", "en", "s", 10)], docs.schema))
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        got = stage(spark, docs, sf_dir)
        assert k == 4 or got.columns == docs.columns
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_language_stage(steps):
    want = {r.doc_id for r in steps[0] if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in steps[1]} == want and all(r.lang for r in steps[1])


def test_line_stage(steps):
    before, after = ({r.doc_id: r for r in s} for s in steps[1:3])
    assert before.keys() == after.keys()
    norm = lambda x: " ".join(x.lower().split())
    # one line stays of each distinct one at least, and none of the lines that stay is like another
    kept = [(d, norm(x)) for d, r in after.items() for x in r.text.split("\n") if norm(x)]
    sets = [fuzzy_lines.shingles(x) for _, x in kept]
    alike = sum(jaccard(a, b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i] if 0.8 * len(a) <= len(b) <= len(a) / 0.8)
    assert alike <= 0.01 * len(kept)
    assert len({x for _, x in kept}) == len(kept)
    for d, r in after.items():
        assert r.n_chars == len(r.text) and set(r.text.split("\n")) - {""} <= set(before[d].text.split("\n"))
    gone = [fuzzy_lines.shingles(norm(x)) for d, r in before.items() for x in set(r.text.split("\n")) - set(after[d].text.split("\n")) if norm(x)]
    assert gone and all(any(jaccard(g, s) >= 0.5 for s in sets) for g in gone[:100])


def test_near_stage(steps):
    fps = {r.doc_id: simhash.simhash(r.text) for r in steps[2]}
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in fps:
        for b in fps:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert {r.doc_id for r in steps[3]} == {root(d) for d in fps}


def test_secret_stage(steps):
    before = {r.doc_id: r for r in steps[3]}
    assert {r.doc_id for r in steps[4]} == before.keys()
    for r in steps[4]:
        spans = secret_grammar.base_spans(before[r.doc_id].text)
        assert not secret_grammar.base_spans(r.text)
        assert ("[secret]" in r.text) >= bool(spans) and r.n_chars == len(r.text)


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    texts = {r.doc_id: r.text for r in steps[4]}
    by, bins = defaultdict(list), defaultdict(list)
    for r in steps[5]:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == texts.keys()
    for d, t in texts.items():
        ids = reference.encode(t, add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by[d], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(by[d]) == 1) == (at <= 1024)
    for got in bins.values():
        got.sort()
        assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and sum(n for _, n in got) <= 1024
    assert len(bins) <= 1.02 * sum(n for g in bins.values() for _, n in g) / 1024 + 1


def test_run_takes_the_same_steps(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 100 and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def odd(spark):
    """Nulls everywhere, an empty and a long text, repeated rows, a text twice under two keys, and columns that differ in case."""
    rows = [
        (1, "the house and the dog live here\nin the old town", "en", "s", 48), (1, "the house and the dog live here\nin the old town", "en", "s", 48), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "12 34 !!", "en", None, 8),
        (5, "word " * 60_000 + "end", None, "s", 300_003), (6, "the house and the dog live here\nin the old town", "en", "t", 48), (None, "a text without a key is here and stays", "en", "s", 39), (7, "my password = hunter2hunter2 is here, and the town is old", "en", "s", 57),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = [*df.columns, "TEXT", "Doc_Id"]
    return df.select("*", df.source.alias("a"), df.n_chars.alias("b")).toDF(*names)


def test_every_stage_takes_odd_rows_and_an_empty_table(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString(), name
        rows = [tuple(r) for r in got.collect()]
        none = stage(spark, docs.limit(0), "")
        assert none.columns == docs.columns and none.count() == 0, name
        keys = sorted(r[0] for r in rows if r[0] is not None)
        if name == "language_id":
            assert keys == [1, 1, 5, 6, 7] and all(r[2] == "en" for r in rows) and len(rows) == 6
        elif name == "line_dedup":
            assert len(rows) == 9 and [r[1] for r in rows if r[0] == 6] == [""] and [r[1:5] for r in rows if r[0] == 1] == [("the house and the dog live here\nin the old town", "en", "s", 48)] * 2
        elif name == "simhash_near_dedup":
            # null, empty and wordless texts are copies of each other
            assert keys == [1, 1, 2, 4, 5, 7] and len(rows) == 7
        else:
            assert len(rows) == 9 and [(r[1], r[4]) for r in rows if r[0] == 7] == [("my [secret] is here, and the town is old", 40)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.doc_id == 1 for r in packed) == 2 and {r.length for r in packed if r.doc_id in (2, 3)} == {1} and sum(r.doc_id == 5 for r in packed) > 50
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_stages_are_written_once(spark, sf_dir, monkeypatch):
    """Each stage but the first reads a table, and nothing of the stages before it is left in its plan."""
    seen = []

    def watched(stage):
        def f(spark, docs, sf_dir):
            plan = docs._jdf.queryExecution().optimizedPlan().toString()
            seen.append((plan.startswith("Relation") and "\n" not in plan.strip(), docs.count(), docs.inputFiles()))
            return stage(spark, docs, sf_dir)

        return f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(f)) for n, f in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, sf_dir)
    assert len(seen) == 5 and all(x[0] and x[1] for x in seen) and out.count() >= seen[-1][1]
    assert "LogicalRDD" in out._jdf.queryExecution().optimizedPlan().toString() or "ExistingRDD" in out._jdf.queryExecution().optimizedPlan().toString()
