"""Driver contract: entry smoke, registry consistency, and every query with
an oracle compared against DuckDB on the sf0.001 tables."""

import os

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns


def test_registry_names():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables not present")
def test_queries_match_duckdb(spark):
    import oracle_check as oc
    con = oc.duck(SMOKE)
    bad = []
    for name, fn in E.queries().items():
        sql = E.oracle_sql().get(name)
        if sql is None:
            fn(spark, SMOKE).count()
            continue
        if not oc.compare(spark, con, name, fn, sql, SMOKE, verbose=False):
            bad.append(name)
    assert not bad, bad


def test_package_is_shipped_to_workers(spark):
    """Python workers import tessera from the shipped zip, whatever the cwd."""
    from pyspark.sql import functions as F
    from tessera.operators import evaluate as ev
    sc = spark.sparkContext
    assert getattr(sc, "_tessera_shipped", False)
    df = spark.createDataFrame([("a b c", "a c")], "r string, p string")
    assert ev.rouge_l(df, "r", "p").first().rouge_l > 0
