"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import xxhash

from wordloom.llm.exact_dedup import _by_bytes, drop_exact, exact_groups
from wordloom.llm.simhash import connected_components, drop_near, gray_rank, hamming_links, simhash, simhash_components


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " ", "One two", "one TWO", "one two three four", "É one two three four five", "a  b\tc\nd e f", "a b c d e f", "x " * 5000, "a b c d e f"]


def test_simhash_is_the_brute_force_one():
    for t in TEXTS:
        assert simhash(t) == brute_simhash(t)


def test_simhash_components(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        fps.append(fps[rng.randrange(len(fps))] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = hamming_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4)
    got = {r.node: r.root for r in connected_components(links).collect()}
    up = {x: x for x in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(signed[i]), root(signed[j])))
                up[b] = a
    assert {x: got.get(x, x) for x in signed} == {x: root(x) for x in signed}


def test_hot_blocks_are_dealt_out(spark, monkeypatch):
    import wordloom.llm.simhash as m

    monkeypatch.setattr(m, "CHUNK", 20)
    base = random.Random(2).getrandbits(63)
    fps = [base ^ (1 << i) for i in range(40)] + [base ^ (1 << i) ^ (1 << i + 1) for i in range(39)]
    got = m.connected_components(m.hamming_links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), 2)).collect()
    assert {r.root for r in got} == {min(fps)} and len(got) == len(set(fps)) - 1


def test_gray_rank_inverts_the_code():
    import numpy as np

    x = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_components_of_texts_and_edge_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "One two", "again"), (None, "One two", "no key")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, TEXT2 string").withColumn("fp", __import__("pyspark").sql.functions.lit(1))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(df).collect()]
    assert len(got) == len(rows)
    want = {i: f"{brute_simhash(t):016x}" for i, t in enumerate(TEXTS)}
    assert all(f == want[i if i is not None else 3] for i, f, _ in got)
    assert {c for i, _, c in got if i in (0, 1, 2)} == {0}
    assert {c for i, _, c in got if i in (3, 4, None)} == {3}
    assert simhash_components(df.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in drop_near(df.where("doc_id is not null")).collect())
    assert 0 in kept and 1 not in kept and kept.count(3) == 2 and 4 not in kept


def test_exact_groups(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "One two"), (None, "One two"), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    want = []
    for (i, _), t in zip(rows, norm):
        ids = [j for (j, _), u in zip(rows, norm) if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, exact_groups(df).collect()), key=key) == sorted(want, key=key)
    assert exact_groups(df.limit(0)).count() == 0
    assert drop_exact(df.where("doc_id is not null")).count() == sum(r[3] for r in want if r[0] is not None)


def test_collisions_are_told_apart_by_bytes(spark):
    rows = spark.createDataFrame([(1, "a", b"h"), (2, "b", b"h"), (3, "a", b"h")], "doc_id bigint, norm string, h binary")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in _by_bytes(rows).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}
