"""Senses and examples go to their packing as rows, not as lists of one."""

from wordloom.operators import nested
from wordloom.plans.lookup_queries import lexicon


def test_rows_are_dealt_out_before_they_are_packed(spark, sf_dir):
    t = lexicon(spark, sf_dir)
    plan = nested.entry_views(*(t[x] for x in ("entry", "sense", "example", "form", "pronunciation")))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert any("entry_id" in line for line in dealt) and any("sense_id" in line for line in dealt)
