"""Nearest neighbours: scores and ties exactly, recall against brute force."""

import random

import numpy as np
import pytest

from wordloom.llm import small_world as sw

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=20, k=20):
    """(query, vec_id, score) for each query's k nearest; scores added up from the first component on."""
    ok = {(i, tuple(np.float32(c) for c in v)) for i, v, _ in rows if i is not None and v and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(v)}
    out = {}
    for i, v in ok:
        if i % every == 0:
            best = out.setdefault(i, {})
            for j, w in ok:
                if j != i and len(v) == len(w):
                    s = 0.0
                    for a, b in zip(v, w):
                        s += float(a) * float(b)
                    best[j] = max(best.get(j, -9e99), s)
    return {i: sorted((-s, j) for j, s in best.items())[:k] for i, best in out.items()}


def got(df, **how):
    out = {}
    for r in sw.nearest(df, **how).collect():
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for i, x in out.items():
        assert sorted(n for n, _, _ in x) == list(range(1, len(x) + 1))
    return {i: [(s, j) for _, s, j in sorted(x)] for i, x in out.items()}


def made(rng, n, width=16):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 1) for c in rng.choice(centres)], 1) for i in range(n)]


def test_few_rows_are_searched_whole(spark):
    """Odd rows, copies and ties; graphs so small that a search meets every node."""
    rng = random.Random(1)
    rows = made(rng, 90) + [(200, None, 1), (220, [0.0] * 16, 1), (240, [None] + [1.0] * 15, 1), (260, [float("nan")] * 16, 1), (280, [float("inf")] + [1.0] * 15, 1), (300, [], 1), (None, [1.0] * 16, 1)]
    rows += [(1000 + i, rows[20][1], 2) for i in range(60)] + [(20, rows[20][1], 3), (40, [0.5] * 16, 1), (320, [1.0, 2.0], 1), (321, [2.0, 1.0], 1), (-40, [-x for x in rows[3][1]], None), (340, [1e30] + [0.0] * 15, 1), (341, [-0.0] * 15 + [1.0], 1), (342, [0.0] * 15 + [1.0], 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    for shards in (1, 3):
        assert got(df, shards=shards) == want
    assert len(want[320]) == 1 and len(want[20]) == 20


@pytest.mark.parametrize("n", [0, 1, 2, 21])
def test_fewer_rows_than_neighbours(spark, n):
    rows = made(random.Random(n), n)
    want = {i: x for i, x in brute(rows).items() if x}
    assert got(spark.createDataFrame(rows, SCHEMA)) == want and (n < 2 or len(want[0]) == n - 1)


def test_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    x, ids = np.array([r[1] for r in rows]), [r[0] for r in rows]
    found = got(df)
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    hits = 0
    for i in asked:
        s = x @ x[i]
        s[i] = -9
        mine = found[ids[i]]
        hits += len({ids[j] for j in np.argsort(-s)[:20]} & {j for _, j in mine})
        assert len(mine) == 20 and mine == sorted(mine)
    assert len(found) == len(asked) and hits / 20 / len(asked) >= 0.97


def test_one_large_graph():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (6000, 1)).astype(np.float32)
    level = np.sort(sw.levels(np.arange(6000)))[::-1]
    assert 0.02 < (level > 0).mean() < 0.05
    g = sw.build(x, level)
    assert sw._reached(g.layers[0]).all() and all((a < len(a_)).all() for a, a_ in zip(g.layers, g.layers))
    q = x[::50]
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    found = sw.search(g, q)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best, found)]) >= 0.95


def test_other_types_and_columns(spark):
    rows = made(random.Random(8), 60, 3)
    df = spark.createDataFrame([(9, *r, "a") for r in rows], "VEC_ID int, vec_id int, embedding array<double>, label int, shard string")
    single = {}
    for i, v, _ in rows:
        if i % 20 == 0:
            each = sorted((-(((v[0] * w[0]) + v[1] * w[1]) + v[2] * w[2]), j) for j, w, _ in rows if j != i)
            single[i] = each[:20]
    assert got(df, shards=2) == single
