"""Registered queries against their SQL, where a finding told of a difference."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry
from postlens import queries
from tools import check

FOLDER = "/root/testdata/sf0.001"


def agree(spark, name):
    con = duckdb.connect()
    for table in check.TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    assert df.columns == [d[0] for d in cur.description]
    assert check.table_of(df.columns, df.collect()) == check.table_of(df.columns, cur.fetchall())


def test_normalize_postings_has_the_columns_of_its_sql(spark):
    agree(spark, "normalize_postings")


def test_bodies_of_all_feeds_come_from_one_reading_of_the_documents(spark):
    plan = queries.paged(spark, FOLDER, *queries.all_feeds())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
