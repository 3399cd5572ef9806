"""The tagger against brute force over all ways through short sentences."""

import itertools

import numpy as np
import pytest

from wordloom.operators import linguistic, tagger


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(4)
    k, names = len(tagger.STATES), ["a", "b", "c", "d"]
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return tagger.Model({w: i for i, w in enumerate(names)}, norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, len(names)))))


def ways(m, s):
    for path in itertools.product(range(len(tagger.STATES)), repeat=len(s)):
        p = m.start[path[0]] * m.emit[path[0], s[0]]
        for a, b, v in zip(path, path[1:], s[1:]):
            p *= m.follow[a, b] * m.emit[b, v]
        yield path, p


def test_likeliest_states(model):
    sentences = [[0, 1, 2], [3], [2, 2, 0, 1], [1, 3]]
    for s, got in zip(sentences, tagger.best_states(model, sentences)):
        best = max(p for _, p in ways(model, s))
        assert dict(ways(model, s))[tuple(got)] == pytest.approx(best)


def test_expected_counts(model):
    sentences = [[0, 1, 2], [3], [1, 3]]
    start, follow, emit, likelihood = tagger.expected(model, sentences)
    a, b, c, total = np.zeros_like(start), np.zeros_like(follow), np.zeros_like(emit), 0.0
    for s in sentences:
        whole = sum(p for _, p in ways(model, s))
        total += np.log(whole)
        for path, p in ways(model, s):
            a[path[0]] += p / whole
            for x, y in zip(path, path[1:]):
                b[x, y] += p / whole
            for x, v in zip(path, s):
                c[x, v] += p / whole
    assert np.allclose(start, a) and np.allclose(follow, b) and np.allclose(emit, c) and likelihood == pytest.approx(total)


def test_rounds_on_sentences(spark):
    """The likelihood never falls, closed words keep their class, and tokens come with parts of speech."""
    text = ["The old farmer slowly opened the wooden gate", "She was walking to the market and he followed her", "A large dog barked loudly at the children", "They have quickly painted the houses of the village", "It is a useful tool for the teachers", None, "", "123"] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "sent_id bigint, sentence string").repartition(3)
    seen = []
    m = tagger.fit(df, rounds=6, most=20, watch=seen.append)
    assert len(seen) == 6 and all(b >= a - 1e-9 * abs(a) for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]
    assert np.allclose(m.emit.sum(axis=1)[:4], 1) and np.allclose(m.follow.sum(axis=1), 1)
    got = linguistic.annotate(df, tagger.annotator(m)).collect()
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.pos)
        assert r.head == r.i and (text[r.sent_id] or "").lower()[r.char_start:].startswith(r.text)
    assert by["the"] == {"DET"} and by["she"] == {"PRON"} and by["of"] == {"ADP"} and by["is"] == {"AUX"} and by["and"] == {"CCONJ"}
    assert by["slowly"] == {"ADV"} and "NOUN" in by["market"] | by["village"] | by["gate"]
    assert tagger.fit(df.limit(0)).symbols == {}


def test_nothing_is_padded(model):
    """A long sentence among many short ones costs what its own words do."""
    import tracemalloc

    sentences = [[0, 1]] * 2000 + [[2, 3, 1] * 1000]
    tracemalloc.start()
    got, sums = tagger.best_states(model, sentences), tagger.expected(model, sentences)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and got[:-1] == tagger.best_states(model, sentences[:1]) * 2000 and len(got[-1]) == 3000
    assert sums[2].sum() == pytest.approx(7000)


def test_columns_are_the_annotators(spark):
    """A batch that is worked out by column has the rows that the pluggable annotator makes text by text."""
    text = ["The dog's 'barking' at 'em", "", None, "'", "1 + 2", "ÉTÉ naïve İstanbul", "It was slowly painted", "''a''\nb'"] * 7
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "sent_id bigint, sentence string").repartition(2)
    m = tagger.fit(df, rounds=2, most=3)
    want = sorted(map(tuple, linguistic.annotate(df, tagger.annotator(m)).collect()))
    assert sorted(map(tuple, tagger.annotate(df, m).collect())) == want and len(want) > 50
    some = tagger.annotate(df, m, ["pos", "text"])
    assert some.columns == ["text", "pos"] and some.count() == len(want) and tagger.annotate(df.limit(0), m).count() == 0
