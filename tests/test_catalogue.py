"""Every query with SQL equals DuckDB; the others run."""

import os

import pytest
from compare import DATA, compare

from folioflow import catalogue

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    left, right = compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert {k: TYPES.get(v, v) for k, v in left.items()} == right


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_every_tinted_colour_equals_its_sql(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    from folioflow.functions import numbers as N
    from folioflow.sources import styles

    duckdb.sql(f"COPY (SELECT k + 256 * s AS p_partkey, s::INT AS p_size FROM range(256) a(k), range(1, 20) b(s)) TO '{tmp_path}/part.parquet'")
    compare(spark, catalogue.QUERIES["q_tint"], catalogue.ORACLES["q_tint"], str(tmp_path))  # all there are: both repeat
    ties = [("#7D1B07", -0.7), ("#7D1B07", -0.5), ("#7D1B07", -0.3), ("#2E62EA", 0.5), ("#BA764E", 0.5), ("#449C0C", 0.3)]
    got = spark.createDataFrame(ties, "c string, a double").select("c", "a", N.tint(F.col("c"), F.col("a")).alias("t")).collect()
    assert {(r["c"], r["a"]): r["t"] for r in got} == {x: styles.tint(*x) for x in ties}


def test_entry_works_without_the_training_operators(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    for m in ("folioflow.llm", "folioflow.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, m, None)
    alone = importlib.reload(e)
    try:
        assert set(alone.queries()) == set(catalogue.QUERIES) and set(alone.oracle_sql()) == set(catalogue.ORACLES)
        assert alone.entry(spark).count() > 0
    finally:
        monkeypatch.undo()
        importlib.reload(e)
