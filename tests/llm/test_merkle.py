"""The manifest against a plain tree, and trees of several blocks."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from wordloom.llm import merkle
from wordloom.llm.merkle import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """The root, and for each leaf its runs and places, level by level."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for p, i in zip(paths, at):
            p.append((runs[i // 16], i % 16))
        level, at = [h(*r) for r in runs], [i // 16 for i in at]
    return level[0] if level else None, paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: b"" if s is None else b"=" + s.encode())
    done = {s: tree([of(r) for r in sorted(by[s], key=lambda r: (r[0] is None, r[0] or 0, of(r)))]) for s in order}
    root, above = tree([done[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for r, path in zip(sorted(by[s], key=lambda r: (r[0] is None, r[0] or 0, of(r))), done[s][1]):
            low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            x = of((*r[:4], low)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else of(r)
            proof = ""
            for run, i in (*path, *up):
                proof += "".join(run[:i] + run[i + 1:])
                x = h(*run[:i], x, *run[i + 1:])
            out.append((r[0], of(r), done[s][0], root, h(proof), x, x == root))
    return out


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"s{i * i % 7}", "en", i, f"Text {i} É " * (i % 5)) for i in range(300)]
    out += [(i, "große", None, None, "ABC") for i in range(300, 340)] + [(400 + i, f"one {i}", "en", 1, "Q") for i in range(20)]
    return out + [(500, None, "en", 3, None), (501, None, None, 3, ""), (None, "s1", "de", 2, "Xy"), (None, None, None, None, None), (7, "s0", "en", 7, "B"), (7, "s0", "en", 7, "B"), (600, "", "en", 9, "Z" * 100_000)]


def test_against_a_plain_tree(spark, rows):
    assert got(manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rows_of", [[], [(1, "a", "en", 1, "T")], [(5, None, None, None, None)], [(1, "a", "en", 1, "T")] * 17])
def test_few_rows(spark, rows_of):
    assert got(manifest(spark.createDataFrame(rows_of, SCHEMA))) == sorted(brute(rows_of), key=str)


def test_trees_of_several_blocks(spark, rows, monkeypatch):
    """Small blocks, so that blocks' roots and sources make several steps."""
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    assert got(manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))) == sorted(brute(rows), key=str)


def test_other_columns_and_rows_tampered_with(spark):
    rows = [(i, "a", "en", 1, f"T{i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("1 AS pos", "doc_id", "doc_id AS Doc_ID", "source", "lang", "n_chars", "text", "'x' AS tree", "2 AS n", "text AS TEXT")
    from pyspark.sql import functions as F

    found = {r.doc_id: r.verified for r in manifest(df, F.col("doc_id") == 3).collect()}
    assert found == {i: i != 3 for i in range(40)}


def test_paths_fold_to_the_root():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    paths = [[] for _ in leaves]
    root = merkle.traverse(leaves, merkle.height_of(len(leaves)), 0, paths)
    assert all(merkle.fold(x, merkle.unpack_path(merkle.pack_path(p))) == root for x, p in zip(leaves, paths))
    assert merkle.fold(leaves[0], paths[1]) != root
