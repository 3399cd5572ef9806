"""Searches do the whole job: against brute force."""

import random

from wordloom.operators import batches, lookup
from wordloom.plans.registry import QUERIES


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distances_of_all_words(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc'") for _ in range(rng.randint(1, 9))) for _ in range(250)} | {"phone", "fone", "ask", "task", "x" * 60, "x" * 58 + "yz"})
    got = lookup.within_two_edits(spark.createDataFrame([(w,) for w in words], "word string"))
    want = {(a, b, n) for i, a in enumerate(words) for b in words[i + 1:] if (n := levenshtein(a, b)) <= 2}
    assert sorted(map(tuple, got.collect())) == sorted(want) and {("fone", "phone", 2), ("ask", "task", 1)} <= want


def test_fuzzy_lev_takes_the_whole_vocabulary(spark, sf_dir):
    words = {r.word for r in QUERIES["freq_rank"](spark, sf_dir).collect()}
    asked = sorted(words)[::500]
    got = {tuple(r) for r in QUERIES["fuzzy_lev"](spark, sf_dir).collect()}
    want = {(min(a, b), max(a, b), n) for a in asked for b in words if a != b and abs(len(a) - len(b)) <= 2 and (n := levenshtein(a, b)) <= 2}
    assert want == {x for x in got if x[0] in asked or x[1] in asked}


def osa(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def test_fuzzy_search_against_all_words(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(400)})
    asked = sorted({w[0] + w[2] + w[1] + w[3:] for w in words if len(w) >= 5} | {"abcxe", "cabde"})[::4]
    v = lookup.headwords(spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, freq_rank bigint"))
    got = {}
    for r in lookup.fuzzy(spark.createDataFrame([(q,) for q in asked], "q string"), v, lookup.gram_index(v)).collect():
        got.setdefault(r.q, []).append((r.place, r.distance, r.word))
    grams = lambda w: {w[i:i + 3] for i in range(len(w) - 2)}
    rank = {w: i for i, w in enumerate(words)}
    for q in asked:
        near = [(n, rank[w], w) for w in words if (n := osa(q, w)) <= 2 and abs(len(w) - len(q)) <= 2 and (n <= 1 and w != q or grams(q) & grams(w))]
        assert [(n, w) for _, n, w in sorted(got.get(q, []))] == [(n, w) for n, _, w in sorted(near)[:10]]


def test_near_words_of_all_kinds(spark):
    """Every string over a small alphabet, and long and empty ones: whatever is within two edits is found, with its distance."""
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(250)} | {"Ab", "x" * 40, "x" * 38 + "yx", "éa", "café"})
    asked = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(60)} | {"x" * 38 + "xy", "caéf", "a"})
    table = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = sorted(map(tuple, lookup.near_words(table(asked, "q"), table(words, "word")).collect()))
    assert got == sorted((q, w, osa(q, w.lower())) for q in asked for w in words if osa(q, w.lower()) <= 2)


def test_pruned_search_is_the_whole_one(spark):
    """Blocks of a few words, so that bounds decide: scores and ranks as if all postings were read."""
    import math
    from collections import Counter

    rng = random.Random(21)
    parts = ["an", "ber", "che", "ing", "tion", "ou", "ra", "s", "the", "un"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(900)})
    asked = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(60)} | {"zzz", "ingzqx", "thethethe"})
    grams = lambda w: [w[i:i + 3] for i in range(len(w) - 2)]
    own = {w: Counter(grams(w)) for w in words if len(w) >= 3}
    df, mean = Counter(g for c in own.values() for g in c), sum(len(w) - 2 for w in own) / len(own)
    idf = {g: max(1e-6, math.log((len(own) - n + 0.5) / (n + 0.5))) for g, n in df.items()}
    score = lambda q, w: sum(idf[g] * own[w][g] * 2.2 / (own[w][g] + 1.2 * (0.25 + 0.75 * (len(w) - 2) / mean)) for g in set(grams(q)) if g in own[w])
    old, lookup.BLOCK = lookup.BLOCK, 8
    try:
        v = lookup.headwords(spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, freq_rank bigint"))
        index = lookup.cut(lookup.gram_index(v))
        qs = spark.createDataFrame([(q,) for q in asked], "q string")
        for k in (3, 40):
            got = {}
            for r in lookup.bm25(qs, index, k).collect():
                got.setdefault(r.q, []).append((-round(r.score, 9), r.word))
            for q in asked:
                want = sorted((-round(score(q, w), 9), w) for w in own if score(q, w) > 0)
                assert [s for s, _ in sorted(got.get(q, []))] == [s for s, _ in want[:k]] and set(got.get(q, [])) <= set(want)
        reads = lookup.bm25_reads(qs, index, 3).groupBy().sum("postings", "read").first()
        assert reads[1] < 0.6 * reads[0]
        pairs = [(q, w) for q in asked for w in list(own)[::7] if score(q, w) > 0]
        best = lookup._among_best(spark.createDataFrame(pairs, "q string, word string"), lookup._asked(qs, index), index, 25)
        want = {(q, w) for q, w in pairs if sum((score(q, x), w) > (score(q, w), x) for x in own) < 25}
        assert {tuple(r) for r in best.collect()} == want
    finally:
        lookup.BLOCK = old


def test_fuzzy_queries_are_of_every_fiftieth_rank(spark, sf_dir):
    words = {r.word: r.freq_rank for r in QUERIES["freq_rank"](spark, sf_dir).collect()}
    asked = {w[0] + w[2] + w[1] + w[3:] for w, r in words.items() if len(w) >= 4 and r % 50 == 0}
    got = {r.q for r in QUERIES["fuzzy_osa"](spark, sf_dir).collect()}
    assert len(asked) > 50 and got <= asked and len(got) >= 0.95 * len(asked)


def test_batches_of_chunks_are_those_of_one_walk(spark):
    rng = random.Random(4)
    rows = [(i + 1, f"w{i}", rng.choice([1, 2, 5, 9, 30, 80]), "ab"[rng.random() < 0.3]) for i in range(700)]
    words, cost = {"a": 5, "b": 7}, {"a": 20, "b": 70}
    want = {}
    for kind in "ab":
        batch, n, total = 0, 0, 0
        for place, _, c, k in rows:
            if k == kind:
                if n and (n + 1 > words[kind] or total + c > cost[kind]):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + c
                want[place] = batch
    df = spark.createDataFrame(rows, "place int, word string, cost int, kind string")
    for chunk in (3, 11, 100, 1000):
        assert {r.place: r.batch for r in batches.next_fit(df, "kind", words, cost, chunk).collect()} == want
