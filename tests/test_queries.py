"""Every registered query runs on the smallest tables; those with SQL give the same rows in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from tidewell.plans import chains, queries  # noqa: F401

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "item"):
        return plain(x.item())
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, str(SF))
    got = [tuple(r) for r in df.collect()]
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())


def test_flagship(spark):
    assert queries.flagship(spark, str(SF)).count() > 0
