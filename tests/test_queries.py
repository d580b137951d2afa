"""All registered queries with SQL against it, on the smallest tables."""

import os

import duckdb
import pytest

from tessella.plans import augment_queries, descriptor_queries, evaluation_queries, learning_queries, model_queries, registry, relational_queries, series_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    said = lambda df: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert said(ours) == said(theirs)
