"""Every registered query that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from tessella import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows_of(df):
    df = df[sorted(df.columns)]
    text = lambda v: f"{v:.9g}" if isinstance(v, float | np.floating) else str(int(v)) if isinstance(v, int | np.integer) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_matches_sql(spark, duck, name):
    assert rows_of(plans.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(plans.ORACLE[name]).df())
