"""Every registered query of the library with a SQL oracle gives the oracle's rows at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import registry

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if isinstance(x, float):
            return "null" if x != x else repr(round(x, 6))
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list | tuple):
            return "[" + ",".join(map(plain, x)) + "]"
        return "null" if x is None or x is pd.NaT or x is pd.NA else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, TINY).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, TINY).count() > 0


def test_names_are_registered():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
