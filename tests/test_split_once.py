"""Lookups split the documents' texts once, into kept tables of words: nothing that is asked of a word is worked out for each place of it."""

import pytest

from wordloom.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["suggest", "lookup"])
def test_texts_are_not_read_again(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert not any("documents" in f for f in found.inputFiles()) and found.count() > 100
