"""The registered queries of the training-data operators against their oracle SQL."""

import duckdb
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(str(row[i]) for i in places) for row in rows)


@pytest.mark.parametrize("name", list(corpus_pipeline.ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = corpus_pipeline.QUERIES[name](spark, SF)
    cursor = duck.execute(corpus_pipeline.ORACLE[name])
    assert plain(map(tuple, frame.collect()), frame.columns) == plain(cursor.fetchall(), [d[0] for d in cursor.description])


def test_one_query_per_operator():
    names = list(corpus_pipeline.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
