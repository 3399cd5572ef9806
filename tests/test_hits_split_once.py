"""The hits of all words split the texts and compare the sentences once: what is asked of them reads kept sentences and words."""

from wordloom.plans.registry import QUERIES


def test_hits_read_kept_sentences(spark, sf_dir):
    found = QUERIES["surface_hits"](spark, sf_dir)
    assert not any("documents" in f for f in found.inputFiles()) and found.count() > 100
