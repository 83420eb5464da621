"""Every query with SQL gives DuckDB's rows; the others run."""

import math
from pathlib import Path

import pandas as pd
import pytest

from lodeframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return "~"
    if isinstance(value, str):
        return value
    try:
        number = float(value)
        return "~" if math.isnan(number) else repr(round(number, 6) + 0.0)
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


def test_sql_is_text_of_known_queries():
    import __spark_entry__

    sql = __spark_entry__.oracle_sql()
    assert all(isinstance(x, str) for x in sql.values()) and sql.keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
