"""Every query with a SQL twin against DuckDB, and stability of the rest under other partitionings."""

import os

import duckdb
import pytest

from wordloom.plans import corpus_queries
from wordloom.plans.registry import ORACLE_SQL, QUERIES


def rows(df):
    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    return sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.astype(object).to_dict("records"))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["freq_rank", "fuzzy_osa", "batch_plan", "good_examples"])
def test_partitions_dont_matter(spark, sf_dir, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        corpus_queries._KEPT.clear()
        found.append(rows(QUERIES[name](spark, sf_dir).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and found[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
