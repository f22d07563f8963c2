"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pandas as pd
import pytest

from pagemill.plans import documents, events, layout, lifecycle, sources  # noqa: F401
from pagemill.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v).tz_localize(None) if pd.Timestamp(v).tz else pd.Timestamp(v))
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    return v.item() if hasattr(v, "item") else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert len(QUERIES[name](spark, DATA).toPandas()) > 0
