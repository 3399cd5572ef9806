"""Sentences as rows: what tokens of one sentence tell of each other needs no shuffle of tokens."""

import pytest

from wordloom.operators import linguistic as L
from wordloom.plans import linguistic_queries as Q
from tests.test_linguistic import S


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name, most", [("token_heads", 2), ("complement_types", 1), ("clause_sizes", 2), ("clause_questions", 2), ("prep_sequences", 5), ("passing_sequences", 6), ("token_collocations", 2), ("promoted_collocations", 3), ("token_roles", 2), ("verb_phrases", 2)])
def test_sentences_are_shuffled_once(spark, sf_dir, name, most):
    """The distinct sentences' shuffle for each time that tokens are read, and those of results; before, tokens met by joins."""
    assert exchanges(Q.QUERIES[name][0](spark, sf_dir)) <= most


def test_packed_is_flat(spark):
    """Both forms of tokens give the same."""
    t = spark.createDataFrame(S, L.TOKEN)
    p = L.packed(t)
    for f in (L.with_head, L.prepositions, L.complement_types, L.prep_sequences, L.verb_phrases, L.collocations, L.roles):
        rows = [sorted(map(str, f(x).collect())) for x in (t, p)]
        assert rows[0] == rows[1] and rows[0]


def test_subtrees(spark):
    """Gaps between places, cycles, heads that aren't there and null ones; a word far below a clause decides."""
    heads = {1: [(2, 2), (5, 2), (7, 5), (9, 7), (11, 40), (12, None)], 2: [(0, 1), (1, 2), (2, 0), (3, 2), (4, 4)], 3: []}
    rows = [(s, i, "w", "w", "X", "X", "dep", h, True, False, "", 0) for s, x in heads.items() for i, h in x]
    t = spark.createDataFrame(rows, L.TOKEN)
    got = {(r.sent_id, r.root, r.i) for r in L.subtrees(t, lambda x: x["i"].isin(1, 5, 11, 12)).collect()}
    assert got == {(1, 5, 5), (1, 5, 7), (1, 5, 9), (1, 11, 11), (1, 12, 12), (2, 1, 0), (2, 1, 1), (2, 1, 2), (2, 1, 3)}
    assert L.subtrees(t, lambda x: x["i"] == 1).count() == 4
