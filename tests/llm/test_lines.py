"""Fuzzy lines against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import fuzzy_lines as m
from wordloom.llm import set_links


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def brute_sets(line, k=m.SHINGLE):
    return {line[i:i + k] for i in range(max(1, len(line) - k + 1))}


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(60)]
    lines = list(base)
    for _ in range(200):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        lines.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    for _ in range(40):
        x = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(20, 60))).strip()
        lines += [x, x[:len(x) // 2] + "q" + x[len(x) // 2 + 1:]]
    lines += ["the."] * 5 + ["Short one", "", "   ", "short  ONE"]
    rng.shuffle(lines)
    return [(i, "\n".join(lines[4 * i:4 * i + 4])) for i in range(-(-len(lines) // 4))] + [(900, None), (901, ""), (902, "x" * 50_000), (None, "the.")]


def test_sets_of_many_lines_are_those_of_each(monkeypatch):
    lines = ["a", "abcdefgh", "abcdefghi" * 30, "x" * 500, "é" * 7, "ab"]
    for short, k in ((0, m.SHINGLE), (1, m.SHORT_SHINGLE)):
        sizes, values = m.shingle_sets(lines, short)
        assert [x.tolist() for x in np.split(values, np.cumsum(sizes)[:-1])] == [m.shingles(x, k).tolist() for x in lines]
        i, j = map(np.array, zip(*[(a, b) for a in range(len(lines)) for b in range(len(lines))]))
        want = [set_links.jaccard(m.shingles(lines[a], k), m.shingles(lines[b], k)) for a, b in zip(i, j)]
        got = set_links.pair_jaccards(sizes, values, i, j, 0.5)
        assert [g for g in got if g >= 0.5] == [w for w in want if w >= 0.5]
        monkeypatch.setattr(set_links, "MANY", 10)
        assert [g for g in set_links.pair_jaccards(sizes, values, i, j, 0.5) if g >= 0.5] == [w for w in want if w >= 0.5]
        monkeypatch.undo()


def test_sets_and_jaccard():
    for a, b in (("abcdefghij", "abcdefghix"), ("short", "short"), ("a", "b"), ("é" * 30, "é" * 29)):
        x, y = brute_sets(a), brute_sets(b)
        assert set_links.jaccard(m.shingles(a), m.shingles(b)) == len(x & y) / len(x | y)


def test_bands_find_similar_lines():
    rng = random.Random(1)
    text = lambda n: "".join(chr(rng.randint(97, 20_000)) for _ in range(n))
    hits = 0
    for _ in range(300):
        core = text(100)
        a, b = (core[:50] + text(5) + core[50:] for _ in range(2))
        assert 0.75 < set_links.jaccard(m.shingles(a), m.shingles(b)) < 0.85
        x, y = m.band_keys([a, b])
        hits += bool((x == y).any())
    assert hits >= 0.96 * 300


def test_bands_of_short_lines_tell_unlike_ones_apart():
    rng = random.Random(2)
    text = lambda n: "".join(chr(rng.randint(97, 20_000)) for _ in range(n))
    for n, k in ((20, m.SHORT_SHINGLE), (45, m.SHORT_SHINGLE), (60, m.SHINGLE), (120, m.SHINGLE)):
        like = unlike = 0
        for _ in range(200):
            core = text(n)
            x, y, z = m.band_keys([core, core[: n - 1] + text(1), core[: n // 2] + text(n - n // 2)], k=k)
            like, unlike = like + bool((x == y).any()), unlike + bool((x == z).any())
        assert like >= 0.96 * 200 and unlike <= 0.15 * 200


def test_bands_of_a_batch_are_those_of_each_line(monkeypatch):
    lines = ["a", "abcdefgh", "abcdefghi" * 30, "x" * 500, "é" * 7]
    together = m.band_keys(lines)
    monkeypatch.setattr(m, "WINDOW", 16)
    assert (np.vstack([m.band_keys([x]) for x in lines]) == together).all() and (m.band_keys(lines) == together).all()


def test_components_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    places = [((d is None, d or 0, i), norm(x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if norm(x)]
    up = {p: p for p, _ in places}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for k, low, high in ((m.SHINGLE, m.LONG, 1e9), (m.SHORT_SHINGLE, 0, m.SHORT)):
        sets = [(p, brute_sets(x, k)) for p, x in places if low <= len(x) < high]
        for i, (p, x) in enumerate(sets):
            for q, y in sets[:i]:
                both = len(x & y)
                if both >= 0.8 * (len(x) + len(y) - both):
                    a, b = sorted((root(p), root(q)))
                    up[b] = a
    got = {(r.doc_id is None, r.doc_id or 0, r.line_no): r for r in m.line_components(df).collect()}
    assert got.keys() == up.keys()
    wrong = [p for p in up if (got[p].keep_doc_id is None, got[p].keep_doc_id or 0, got[p].keep_line_no) != root(p)]
    assert len(wrong) <= 0.01 * len(up)
    sizes = defaultdict(int)
    for p in up:
        sizes[root(p)] += 1
    assert all(got[p].n_copies == sizes[root(p)] for p in up if p not in wrong) or wrong
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.keep_doc_id, r.keep_line_no)) for r in got.values())


def test_chains_that_skip_the_first_line(spark, monkeypatch):
    monkeypatch.setattr(set_links, "BLOCK", 2)
    members = spark.createDataFrame([(1, i, 1, 0) for i in (2, 3, 4)], "key bigint, id bigint, rep bigint, kind int")
    base = "".join(chr(97 + i % 26) for i in range(7)) + "".join(chr(200 + i) for i in range(200))
    texts = spark.createDataFrame([(1, "something else entirely"), (2, base), (3, base + "abcdefghijkl"), (4, base + "abcdefghijklmnopqrst")], "id bigint, data string")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    links = set_links._rest(set_links._open_members(members, roots), lambda df: df.join(texts, "id"), m.shingle_sets, 0.8)
    got = set_links.connected_components(links).collect()
    assert {(r.node, r.root) for r in got} == {(3, 2), (4, 2)}


def test_portions_of_a_rep_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(set_links, "FEW", 2)
    rng = random.Random(3)
    text = lambda n: "".join(chr(rng.randint(97, 20_000)) for _ in range(n))
    base, other = text(100), text(60)
    near = [base[:90] + text(3) for _ in range(30)]
    lines = [base, *near, *[other + text(2) for _ in range(6)], text(80), "x"]
    rows = [(7, "\n".join(lines)), (7, "\n".join(reversed(lines))), (8, base)]
    got = m.line_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sizes = sorted({(r.keep_line_no, r.n_copies) for r in got})
    assert sorted(n for _, n in sizes) == [2, 2, 12, 63] and len(got) == 2 * len(lines) + 1


def test_members_of_keys(spark, monkeypatch):
    """Runs of any size: each key's ids are all there, joined to its smallest, if need be through another of them."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.choice(np.array([7, 1 << 40, (1 << 63) + 5, (1 << 64) - 2, *range(1000, 1400)], np.uint64), 6, replace=False).tobytes()) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, keys binary").repartition(3)
    want = defaultdict(set)
    for i, data in rows:
        for k in np.frombuffer(data, np.int64).tolist():
            want[k].add(i)
    for size in (1 << 20, 200):
        monkeypatch.setattr(set_links, "RUN", size)
        got = defaultdict(list)
        for r in set_links._members(df, m._bands, 6).collect():
            got[r.key].append((r.rep, r.id))
        assert got.keys() == {k for k, ids in want.items() if len(ids) > 1}
        for k, links in got.items():
            reached = {min(want[k])}
            for _ in range(3):
                reached |= {b for a, b in links if a in reached}
            assert reached == want[k] and all(a < b for a, b in links)


def test_keys_that_are_no_numbers(spark):
    rows = [("b", "the very same line of text\nanother one"), ("a", "another one\nthe very same line of texts"), (None, "another one")]
    for cast in ("string", "date"):
        df = spark.createDataFrame(rows, "doc_id string, text string")
        df = df if cast == "string" else df.withColumn("doc_id", F.when(df.doc_id == "a", "2020-01-01").when(df.doc_id == "b", "2021-01-01").cast("date"))
        got = {(str(r.doc_id), r.line_no): (str(r.keep_doc_id), r.keep_line_no) for r in m.line_components(df).collect()}
        a, b = ("a", "b") if cast == "string" else ("2020-01-01", "2021-01-01")
        assert got == {(a, 0): (a, 0), (a, 1): (a, 1), (b, 0): (a, 1), (b, 1): (a, 0), ("None", 0): (a, 0)}


def test_drop_lines(spark):
    rows = [(1, "keep me here please\n\nsecond line", "a", 33), (2, "KEEP me   here please\nother words now", "b", 37), (3, "second line", "c", 11), (4, None, "d", None), (5, "second line\n", None, 12), (None, "second line", "e", 11)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, gone string, n_chars bigint")
    got = {r.doc_id: (r["text"], r.n_chars) for r in m.drop_lines(df).collect()}
    assert got == {1: (rows[0][1], 33), 2: ("other words now", 15), 3: ("", 0), 4: (None, None), 5: ("", 0), None: ("second line", 11)}
    assert m.drop_lines(df.limit(0)).count() == 0 and m.line_components(df.limit(0)).count() == 0


def test_lines_of_30_to_80_characters_match_copies_with_one_letter_changed(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in range(30, 81)]
    base = [f"q{x[1:-1].replace('  ', ' x').replace('  ', ' x')}q" for x in base]
    copies = [x[:(i := rng.randint(8, len(x) - 9))] + "0" + x[i + 1:] for x in base]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(base)] + [(100 + i, x) for i, x in enumerate(copies)], "doc_id bigint, text string")
    got = {r.doc_id: r.keep_doc_id for r in m.line_components(df).collect()}
    assert all(got[i] == i for i in range(len(base)))
    assert sum(got[100 + i] == i for i in range(len(base))) >= 0.96 * len(base)


def test_lines_that_repeat_themselves(spark):
    """No limits on length here: lines whose sets of either kind of shingles are alike, one of them of fewer than 40 characters, meet."""
    rng = random.Random(17)
    units = ["ha ", "-", "=-", "+--", "| x ", "na na hey ", "abcabd", "..", "_ "]
    lines = [u * n for u in units for n in (2, 5, 9, 13, 20, 39, 52)] + ["ha " * 12 + "ho", "-" * 39 + "x", "- " * 200, "ab" * 3000]
    lines += ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(20, 70))) for _ in range(60)]
    lines = sorted({x for x in map(norm, lines) if x})
    got = {r.line_no: r.keep_line_no for r in m.line_components(spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string")).collect()}
    same = lambda a, b, k: len(brute_sets(a, k) & brute_sets(b, k)) >= 0.8 * len(brute_sets(a, k) | brute_sets(b, k))
    alike = [(i, j) for j in range(len(lines)) for i in range(j) if min(len(lines[i]), len(lines[j])) < m.LONG and (same(lines[i], lines[j], 3) or same(lines[i], lines[j], 5))]
    across = [(i, j) for i, j in alike if max(len(lines[i]), len(lines[j])) >= m.SHORT]
    assert len(across) > 20 and sum(got[i] != got[j] for i, j in alike) <= 0.01 * len(alike)
    assert got[lines.index(norm("ha " * 13))] == got[lines.index(norm("ha " * 20))] and got[lines.index("-" * 39)] == got[lines.index("-" * 52)]


def test_repetitive_lines():
    lines = ["x" * 200, "abc" * 60, "".join(chr(97 + i * i % 26) + chr(100 + i % 50) for i in range(100)), "é" * 51, "".join(map(chr, range(200, 260))), "ab" * 50 + "".join(map(chr, range(300, 400)))]
    want = [len({x[i:i + 3] for i in range(len(x) - 2)}) <= m.FEW for x in lines]
    assert m.repetitive(lines).tolist() == want and True in want and False in want
