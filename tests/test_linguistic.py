"""Dependency patterns on hand-written parses."""

import pytest

from wordloom.operators import linguistic as L


def sentence(sid, *rows):
    """rows: text, lemma, pos, tag, dep, head (place)."""
    stop = {"the", "a", "of", "on", "in", "to", "very", "is", "she", "he", "it", "."}
    return [(sid, i, t, lem, p, tag, d, h, t.isalpha(), t.lower() in stop, "", 0) for i, (t, lem, p, tag, d, h) in enumerate(rows)]


S = (
    sentence(1, ("She", "she", "PRON", "PRP", "nsubj", 1), ("made", "make", "VERB", "VBD", "ROOT", 1), ("up", "up", "ADP", "RP", "prt", 1), ("a", "a", "DET", "DT", "det", 5), ("wild", "wild", "ADJ", "JJ", "amod", 5), ("story", "story", "NOUN", "NN", "dobj", 1), ("quickly", "quickly", "ADV", "RB", "advmod", 1), (".", ".", "PUNCT", ".", "punct", 1))
    + sentence(2, ("People", "people", "NOUN", "NNS", "nsubj", 1), ("depend", "depend", "VERB", "VBP", "ROOT", 1), ("on", "on", "ADP", "IN", "prep", 1), ("friends", "friend", "NOUN", "NNS", "pobj", 2), ("for", "for", "ADP", "IN", "prep", 1), ("advice", "advice", "NOUN", "NN", "pobj", 4))
    + sentence(3, ("He", "he", "PRON", "PRP", "nsubj", 1), ("succeeds", "succeed", "VERB", "VBZ", "ROOT", 1), ("in", "in", "ADP", "IN", "prep", 1), ("winning", "win", "VERB", "VBG", "pcomp", 2))
    + sentence(4, ("A", "a", "DET", "DT", "det", 1), ("piece", "piece", "NOUN", "NN", "nsubj", 4), ("of", "of", "ADP", "IN", "prep", 1), ("advice", "advice", "NOUN", "NN", "pobj", 2), ("is", "be", "AUX", "VBZ", "ROOT", 4), ("very", "very", "ADV", "RB", "advmod", 6), ("useful", "useful", "ADJ", "JJ", "acomp", 4))
    + sentence(5, ("They", "they", "PRON", "PRP", "nsubj", 1), ("argue", "argue", "VERB", "VBP", "ROOT", 1), ("about", "about", "ADP", "IN", "prep", 1), ("who", "who", "PRON", "WP", "nsubj", 4), ("won", "win", "VERB", "VBD", "pcomp", 2))
    + sentence(6, ("They", "they", "PRON", "PRP", "nsubj", 1), ("have", "have", "VERB", "VBP", "ROOT", 1), ("a", "a", "DET", "DT", "det", 4), ("birthday", "birthday", "NOUN", "NN", "compound", 4), ("party", "party", "NOUN", "NN", "dobj", 1))
)


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame(S, L.TOKEN)


def test_complements_and_sequences(tokens):
    got = {(r.sent_id, r.prep_i): r.obj for r in L.complement_types(tokens).collect()}
    assert got == {(2, 2): "sb", (2, 4): "sth", (3, 2): "doing sth", (4, 2): "sth", (5, 2): "wh-"}
    assert [tuple(r) for r in L.prep_sequences(tokens).collect()] == [(2, 1, "on sb for sth")]


def test_collocations(tokens):
    got = {(r.sent_id, r.lemma, r.pattern, r.display) for r in L.collocations(tokens).collect()}
    assert {
        (1, "story", "verb_w", "make up"), (1, "story", "adj_w", "wild"), (1, "wild", "w_noun", "story"), (1, "make", "w_noun", "story"), (1, "make", "adv_w", "quickly"), (1, "quickly", "verb_w", "make"),
        (2, "people", "w_verb", "depend"), (4, "advice", "quant_of_w", "a piece of"), (4, "very", "w_adj", "useful"), (6, "have", "w_noun", "party"), (6, "party", "verb_w", "have"), (6, "party", "noun_noun", "birthday party"), (6, "birthday", "noun_noun", "birthday party"),
    } == got


def test_roles(tokens):
    got = {}
    for r in L.roles(tokens).collect():
        got.setdefault((r.sent_id, r.lemma), set()).add(r.role)
    assert got[1, "story"] == {"object"} and got[1, "make"] == {"past"} and got[1, "wild"] == {"attributive"} and got[1, "quickly"] == {"final"}
    assert got[2, "people"] == {"subject", "plural"} and got[2, "friend"] == {"after_prep", "plural"} and got[3, "win"] == {"ing", "ing_after_prep"}
    assert got[4, "useful"] == {"predicative"} and got[4, "very"] == {"before_adj"} and got[6, "birthday"] == {"noun_mod"} and got[3, "succeed"] == {"s_form"}


def test_annotator_is_pluggable(spark):
    def start():
        return lambda texts: [[{"i": i, "text": w, "lemma": w.lower(), "pos": "X", "tag": "X", "dep": "dep", "head": 0, "is_alpha": w.isalpha(), "is_stop": False, "ent_type": "", "char_start": 0} for i, w in enumerate(t.split())] for t in texts]

    df = spark.createDataFrame([(1, "Two words"), (2, "")], "sent_id bigint, sentence string")
    assert [(r.sent_id, r.lemma) for r in L.annotate(df, start).orderBy("i").collect()] == [(1, "two"), (1, "words")]
