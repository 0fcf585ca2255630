"""Every query against its SQL on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from forumlake.plans import records, relations, search, texts

QUERIES = {**search.QUERIES, **texts.QUERIES, **relations.QUERIES, **records.QUERIES}
SQL = {**search.SQL, **texts.SQL, **relations.SQL, **records.SQL}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    def one(x):
        if isinstance(x, (float, np.floating)) and not np.isnan(x):
            return f"{x:.5f}"
        return "" if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else str(x)

    return sorted("|".join(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, small, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
