"""Every query that SQL can say, on the smallest tables, against the same in SQL."""

import glob
import os
import re
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("SQL_TEST_DIR", "/root/testdata/sf0.001")
# these are compared by the same means in tests/llm
CORE = sorted(n for n in entry.oracle_sql() if not re.match(r"p\d+_", n))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float | Decimal):
        return round(float(v), 6)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(v[k]) for k in order]) for v in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, db, name):
    ours = entry.queries()[name](spark, DATA)
    theirs = db.sql(entry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(theirs.columns, theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "source", "title", "seen_at", "impact_score"]
