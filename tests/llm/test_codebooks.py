"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from wordloom.llm import codebooks

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = sorted((r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vs = [[math.floor(256 * float(np.float32(c))) for c in r[1]] for r in kept]
    if not vs:
        return []
    w = len(vs[0]) // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for v in vs[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest():
        return [[min((far(cut(v, p), e), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in vs]

    for _ in range(rounds):
        got = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, g in zip(vs, got) if g[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got = nearest()
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in got]
    return [(r[0], "".join(f"{i:02x}" for _, i in g), n, sum(m for m, s in zip(errors, kept) if s[2] == r[2]), sha) for r, g, n in zip(kept, got, errors)]


def made(rng, n, spread=1.0, width=64):
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]


def got(df, **how):
    return sorted(map(tuple, codebooks.vector_codes(df, **how).collect()), key=str)


@pytest.mark.parametrize("spread", [0.01, 0.2])
def test_against_plain_rounds(spark, spread):
    """Small spreads make ties and empty entries."""
    rng = random.Random(5)
    rows = made(rng, 300, spread)
    rows += [(400, None, 1), (401, [None] + [0.0] * 63, 1), (402, [float("nan")] * 64, 1), (403, [float("inf")] + [0.1] * 63, None), (404, [], 1)]
    rows += [(500 + i, rows[3][1], 2) for i in range(150)] + [(7, rows[9][1], 1), (7, rows[7][1], 0), (None, rows[5][1], None), (-3, [0.0] * 64, 1), rows[20], rows[20]]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows_make_few_entries(spark, n):
    rows = made(random.Random(2), n)
    assert got(spark.createDataFrame(rows, SCHEMA)) == sorted(brute(rows), key=str)


def test_more_rounds_and_other_shapes(spark):
    rows = made(random.Random(3), 200, width=12)
    df = spark.createDataFrame([(9, *r, "x") for r in rows], "VEC_ID int, vec_id bigint, embedding array<double>, label int, best string")
    single = [(a, [float(np.float32(c)) for c in v], b) for a, v, b in rows]
    assert got(df.withColumn("embedding", df["embedding"].cast("array<float>")), parts=4, entries=9, rounds=5) == sorted(brute(single, 4, 9, 5), key=str)


def test_bounds_leave_few_distances(spark):
    seen = []
    codebooks.fit_codes(spark.createDataFrame(made(random.Random(4), 800), SCHEMA), rounds=4, watch=lambda left, all_: seen.append(left / all_))
    assert len(seen) == 3 and max(seen) < 0.5


def test_lengths_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        codebooks.fit_codes(spark.createDataFrame([(1, [0.1] * 20, 1)], SCHEMA))
    with pytest.raises(ValueError):
        codebooks.fit_codes(spark.createDataFrame([(1, [0.1] * 64, 1), (2, [0.1] * 32, 1)], SCHEMA))
