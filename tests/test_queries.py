"""Registered queries against their oracle SQL at the smallest scale.

Set ALL_QUERIES=1 to run every query (some minutes).
"""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from checks import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUICK = ["page_admission", "rule_matches", "rule_matches_by_join", "entropy_candidates", "page_domains", "syntax_findings",
         "merged_findings", "file_risk", "repo_risk", "checked_urls", "archive_scan", "tree_scan"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plain(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]

    def value(v):
        return float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v

    return sorted((tuple(value(row[i]) for i in places) for row in rows), key=lambda r: tuple(map(repr, r)))


def test_every_query_has_an_oracle():
    assert set(registry.ORACLE) == set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert plain(map(tuple, frame.collect()), frame.columns) == plain(cursor.fetchall(), columns)
