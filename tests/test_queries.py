"""Every registered query against its SQL at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
# Hundreds of partition folders each: run by check.py instead.
SLOW = {
    "streamed_lines", "deduplicated_stream", "bulk_loaded_report", "bulk_loaded_baskets", "late_lines_apart", "followed_rules",
    "customer_state_metrics", "customer_state_top", "compacted_lines", "compacted_partitions", "refreshed_rules", "refreshed_clusters",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows(table, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in table)


def test_names_agree():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, db, name):
    df = driver.queries()[name](spark, FOLDER)
    cursor = db.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), columns)


def test_entry(spark):
    assert driver.entry(spark).count() == 10
