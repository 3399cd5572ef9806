"""Fingerprints against a plain reading of the definition."""

import hashlib
import random
import re
from collections import Counter

from wordloom.llm import spotsigs as m
from wordloom.llm.set_links import jaccard


def prose(rng, n=200):
    common = ["the", "of", "and", "is", "la", "der"]
    return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefghi") for _ in range(6)) for _ in range(n))


def test_signatures_are_chains_after_anchors():
    a, b = m.signatures("The quick fox of brown trees"), m.signatures("THE quick, fox... of brown/trees")
    assert len(a) >= 2 and (a == b).all()
    assert len(m.signatures("the quick")) == 2 and len(m.signatures("!!")) == 1 and len(m.signatures("")) == len(m.signatures(None)) == 0
    assert not set(m.signatures("the quick fox")) & set(m.signatures("of quick fox"))
    # repeats count
    assert len(m.signatures("the quick fox " * 9)) >= 9 and set(m.signatures("the quick fox " * 3)) < set(m.signatures("the quick fox " * 9))
    # common words are skipped inside a chain
    assert set(m.signatures("the quick fox")) <= set(m.signatures("the is quick of fox"))


def test_signatures_against_a_plain_reading():
    rng = random.Random(8)
    for n in (0, 1, 2, 3, 5, 40, 300):
        text = prose(rng, n) + " 12 the_end, x-y."
        words = re.findall("[^\\W_]+", text.lower())
        chains = []
        for k, w in enumerate(words):
            after = [x for x in words[k + 1:] if x not in m.COMMON][:m.CHAIN]
            if w in m.COMMON and len(after) == m.CHAIN:
                chains.append((w, *after))
        chains = chains or [(w,) for w in words]
        # As many signatures as chains, each repeat counting, and alike just as far as the chains are.
        own = m.signatures(text)
        assert len(own) == len(chains)
        cut = " ".join(text.split()[: len(text.split()) // 2])
        words = re.findall("[^\\W_]+", cut.lower())
        half = [(w, *after) for k, w in enumerate(words) if w in m.COMMON and len(after := [x for x in words[k + 1:] if x not in m.COMMON][:m.CHAIN]) == m.CHAIN]
        if half and len(chains[0]) > 1:
            shared = sum((Counter(half) & Counter(chains)).values())
            assert abs(jaccard(own, m.signatures(cut)) - shared / (len(half) + len(chains) - shared)) < 1e-9


def test_frequent_words_against_counting(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join("zy"[rng.random() < 0.3] if rng.random() < 0.05 else f"w{rng.randint(0, 3000)}" for _ in range(200))) for i in range(60)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    count = Counter(w for _, t in rows for w in (t or "").split())
    want = sorted(w for w, n in count.items() if n >= 0.005 * count.total())
    monkeypatch.setattr(m, "REMEMBERED", 300)
    assert m.frequent_words(df, share=0.005) == want == ["y", "z"]
    assert m.frequent_words(df.limit(0)) == []


def test_edited(spark, monkeypatch):
    monkeypatch.setattr(m, "STRETCH", 7)
    rng = random.Random(4)
    rows = [(i * 3, prose(rng, rng.randint(0, 120))) for i in range(60)] + [(1000, None), (1001, ""), (1002, "abc"), (9, "same key"), (None, "no key at all"), (5_000_000, "far off the rest"), (5_000_001, "x" * 9001)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, Stretch int")
    hashes = m.Hashes(m.COMMON | frozenset(m.frequent_words(df)))
    sign = lambda t: m.signatures(t, hashes=hashes)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        e = t[:len(t) - k] + after[:k]
        s, n, x = sign(t), sign(e), sign(after)
        want[i, t] = (len(t), hashlib.sha256(e.encode()).hexdigest(), m.as_text(s), m.as_text(n), jaccard(s, n), jaccard(s, x))
    got = m.edited_fingerprints(df).collect()
    texts = {m.as_text(sign(t)): t for _, t in order}
    assert len(got) == len(rows)
    assert {(r.doc_id, texts[r.fingerprint]): tuple(r)[1:7] for r in got} == want
    assert m.edited_fingerprints(df.limit(0)).count() == 0


def test_classes_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(20, 150))) for i in range(40)]
    for i in range(40, 120):
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed" + str(i)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashes = m.Hashes(m.COMMON | frozenset(m.frequent_words(df)))
    sets = {i: set(m.signatures(t, hashes=hashes).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {r.doc_id: r.class_id for r in m.similar_classes(df).collect()} == {i: root(i) for i in sets}
