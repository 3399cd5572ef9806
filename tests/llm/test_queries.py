"""The training-data queries with a SQL twin against DuckDB."""

import os

import duckdb
import pytest

from wordloom.llm.queries import ORACLE_SQL, QUERIES


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.astype(object).to_dict("records"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf_dir, name):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), c.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
