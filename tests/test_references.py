"""Every registered query against its SQL, on the smallest given tables."""

import datetime as dt
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import QUERIES, entry, oracle_sql, queries  # noqa: E402

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])

    def plain(value):
        if isinstance(value, dt.datetime):
            return value.replace(tzinfo=None)
        return round(value, 9) if isinstance(value, float) else value

    out = [tuple(plain(row[n]) for n in order) for row in rows]
    return sorted(columns), sorted(out, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    df = queries()[name](spark, SF_DIR)
    result = sql.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert comparable(df.columns, df.collect()) == comparable(columns, result.fetchall())


def test_every_catalog_query_has_sql():
    assert not set(QUERIES) - set(oracle_sql())
    assert not set(oracle_sql()) - set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["duplicate_members", "export_rows", "path_known", "disk_stats", "disk_patch"])
def test_same_without_broadcasts(spark, sql, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query_equals_its_sql(spark, sql, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
