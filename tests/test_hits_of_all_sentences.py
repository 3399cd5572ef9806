"""A word's shortest sentences are sought among all that have it, not among the first few."""

from wordloom.operators import reports
from wordloom.plans.registry import QUERIES


def test_late_sentences_take_part(spark):
    s = spark.createDataFrame([(i, "cat cats " + "x" * (40 - i)) for i in range(30)], "sid bigint, sentence string")
    forms = spark.createDataFrame([("cat", "cat"), ("cat", "cats"), ("dog", "dog")], "lemma string, form string")
    got = sorted((r.place, r.sid) for r in reports.hits_of_forms(s, forms, first=None).collect())
    assert got == [(1, 29), (2, 28), (3, 27), (4, 26)]


def test_hits_against_all_sentences(spark, sf_dir):
    import re

    found = {}
    for r in QUERIES["sentence_dedup"](spark, sf_dir).collect():
        for t in set(re.findall("[a-z][a-z']*", r.sentence.lower())):
            found.setdefault(t, set()).add((len(r.sentence), r.doc_id * 100000 + r.place))
    want = {(w, sid, i + 1) for w in found for i, (_, sid) in enumerate(sorted(found[w] | found.get(w + "s", set()))[:4])}
    assert {tuple(r) for r in QUERIES["surface_hits"](spark, sf_dir).collect()} == want and max(map(len, found.values())) > 12
