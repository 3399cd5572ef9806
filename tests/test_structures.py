"""Automata, closures, tries and scans against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import closure, completion, patterns, reports
from wordloom.operators.relational import rank_within


def test_automaton_finds_what_a_search_finds():
    rng = random.Random(5)
    phrases = [[rng.choice("abc") for _ in range(rng.randint(1, 4))] for _ in range(60)] + [[]]
    a = patterns.automaton(phrases)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        want = {n for n, p in enumerate(phrases) if p and any(words[i:i + len(p)] == p for i in range(len(words)))}
        assert a.found(words) == want


@pytest.mark.parametrize("most", [10_000, 60, 5])
def test_phrases_whatever_the_number_of_parts(spark, most):
    """In one automaton, in several by first word, and by an equi-join."""
    rng = random.Random(6)
    phrases = sorted({" ".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(40)}) + ["", None, "a  b"]
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for i in range(60)] + [(99, None)]
    s = spark.createDataFrame(rows, "tid bigint, words array<string>").withColumn("len", F.size("words"))
    got = sorted(map(tuple, patterns.phrase_hits(s, spark.createDataFrame([(p,) for p in phrases], "phrase string"), ["tid", "len"], most).collect()))
    want = sorted((p, i, len(w)) for i, w in rows if w for p in phrases if p and f" {p} " in f" {' '.join(w)} ")
    assert got == want and patterns.phrase_hits(s, spark.createDataFrame([], "phrase string"), ["tid"], most).count() == 0


def test_closures_of_deep_trees_and_cycles(spark):
    """A chain of 200 levels, trees, two-cycles, a node that is its own parent, and parents that aren't there."""
    rng = random.Random(7)
    edges = [("a", i, i - 1) for i in range(1, 201)] + [("b", i, rng.randint(0, i - 1)) for i in range(1, 60)] + [("c", 1, 2), ("c", 2, 1), ("c", 3, 1), ("c", 4, 4), ("c", 5, 4), ("c", 6, 77), ("c", None, 1), ("c", 7, None)]
    roots = [("a", 0), ("a", 150), ("b", 0), ("b", 5), ("c", 1), ("c", 4), ("c", 77), ("c", 8), ("a", 0)]
    kids = {}
    for g, n, p in edges:
        if n is not None and p is not None and n != p:
            kids.setdefault((g, p), []).append(n)
    want = set()
    for g, r in roots:
        todo, seen = [r], {r}
        while todo:
            for k in kids.get((g, todo.pop()), []):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        want |= {(g, r, n) for n in seen}
    e = spark.createDataFrame(edges, "g string, node int, parent int")
    got = [tuple(r) for r in closure.below(e, spark.createDataFrame(roots, "g string, root int"), ["g"]).select("g", "root", "node").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in closure.endless(e, ["g"]).collect()} == {("c", 1), ("c", 2), ("c", 3)}


@pytest.mark.parametrize("exact_first", [False, True])
def test_trie_of_all_prefixes(spark, exact_first):
    rng = random.Random(8)
    norms = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(300)] + ["aaaaaaaaaaaaab", "aaaaaaaaaaaaba", "é", "ab" * 20, None]
    rows = [(n and n + rng.choice(["", "x"]), n, rng.choice([None, 1, 2, 3, 50])) for n in norms] + [("dup", "dup", 1)] * 12
    t = spark.createDataFrame(rows, "word string, norm string, weight int").repartition(5)
    asked = sorted({n[:i] for _, n, _ in rows if n for i in range(1, len(n) + 1)} | {"zzz", ""})
    got = {}
    for r in completion.complete(spark.createDataFrame([(q,) for q in asked], "q string"), t, 4, exact_first, longest=5).collect():
        got.setdefault(r.q, []).append((r.place, r.word))
    for q in asked:
        best = sorted((exact_first and n != q, w is None, w or 0, len(x), n, x) for x, n, w in rows if q and n and n.startswith(q))[:4]
        assert [w for _, w in sorted(got.get(q, []))] == [b[-1] for b in best], q
        assert [p for p, _ in sorted(got.get(q, []))] == list(range(1, len(best) + 1))


def test_ranks_within_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aaaab"), rng.random()) for _ in range(500)]
    got = {}
    for r in rank_within(spark.createDataFrame(rows, "g string, x double").repartition(7), ["g"], [F.asc("x")], "n").collect():
        got.setdefault(r.g, []).append((r.n, r.x))
    assert {g: [x for _, x in sorted(v)] for g, v in got.items()} == {g: sorted(x for h, x in rows if h == g) for g in got}
    assert all(sorted(n for n, _ in v) == list(range(len(v))) for v in got.values())


def test_hits_keep_sentences_that_several_forms_hit(spark):
    s = spark.createDataFrame([(i, "cat cats " + "x" * (20 - i)) for i in range(15)], "sid bigint, sentence string")
    forms = spark.createDataFrame([("cat", "cat"), ("cat", "cats"), ("dog", "dog")], "lemma string, form string")
    got = sorted((r.place, r.sid, r.sentence) for r in reports.hits_of_forms(s, forms).collect())
    assert got == [(k + 1, 11 - k, "cat cats " + "x" * (9 + k)) for k in range(4)]


def test_percentiles_by_brackets(spark):
    """Nearest ranks of groups with ties, nulls, one row and none but nulls, and a null group."""
    import math

    from wordloom.operators import quality

    rng = random.Random(10)
    rows = [("a", rng.randint(0, 9)) for _ in range(400)] + [("b", int(10 ** rng.uniform(0, 7))) for _ in range(900)] + [("c", 5), ("d", None), ("a", None), (None, 3), (None, 4)]
    got = {r.g: r for r in quality.sizes(spark.createDataFrame(rows, "g string, v bigint").repartition(6), ["g"], "v", (0.5, 0.95), accuracy=20).collect()}
    assert got.keys() == {g for g, _ in rows}
    for g, r in got.items():
        v = sorted(x for h, x in rows if h == g and x is not None)
        at = lambda p: v[max(0, math.ceil(p * len(v)) - 1)] if v else None  # noqa: B023, E731
        assert (r.n, r.p50, r.p95, r.most) == (sum(h == g for h, _ in rows), at(0.5), at(0.95), max(v, default=None))


def test_heavy_words_within_their_bound(spark):
    from wordloom.operators import corpus

    rng = random.Random(11)
    words = ["the"] * 300 + ["of"] * 150 + [f"w{rng.randint(0, 2000)}".replace("0", "o").replace("1", "l").translate(str.maketrans("23456789", "abcdefgh")) for _ in range(4000)]
    rng.shuffle(words)
    s = spark.createDataFrame([(" ".join(words[i:i + 9]),) for i in range(0, len(words), 9)], "sentence string").repartition(3)
    got = {r.word: r for r in corpus.heavy_words(s, 0.02, held=30).collect()}
    assert {"the", "of"} <= got.keys() and all(r.estimate <= words.count(w) <= r.estimate + r.bound for w, r in got.items()) and got["the"].bound > 0


def test_versions_differ_where_files_do(spark):
    from wordloom.operators import versions

    files = [(f"d/{i}.json", f"content {i}".encode()) for i in range(300)] + [("empty", None)]
    make = lambda rows: versions.in_ranges(spark.createDataFrame(rows, "path string, content binary")).cache()
    old, same = make(files), make(files[::-1])
    new = make([(p, b"other" if p == "d/7.json" else c) for p, c in files if p != "d/9.json"] + [("z", b"z")])
    t = [versions.tree(x).cache() for x in (old, same, new)]
    ids = [versions.root(x).first().version for x in t]
    assert ids[0] == ids[1] != ids[2] and versions.changed_ranges(t[0], t[1]) == []
    ranges = versions.changed_ranges(t[0], t[2])
    assert len(ranges) <= 3 and {tuple(r) for r in versions.changes(old, new, ranges).collect()} == {("d/7.json", "changed"), ("d/9.json", "removed"), ("z", "added")}
    none = versions.tree(make([]))
    assert versions.root(none).count() == 1 and {tuple(r) for r in versions.changes(make([]), new, versions.changed_ranges(none, t[2])).collect()} == {(r.path, "added") for r in new.collect()}
