"""Every registered query against its SQL twin, values and types, on the whole test tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from fleetlens.suite import oracles
from fleetlens.suite.queries import all_queries

QUERIES = all_queries()
ORACLES = oracles.build()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}
# Plans that cannot grow: pairs of everything, everything in one task, rows through Python.
FORBIDDEN = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "PythonUDF", "ArrowEvalPython", "BatchEvalPython",
    "MapInPandas", "MapInArrow", "FlatMapGroups",
)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return repr(value)


def compare(spark_df, duck, sql):
    columns = sorted(spark_df.columns)
    cursor = duck.execute(sql)
    found = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(found) == columns
    assert {c: TYPES[t] for c, t in spark_df.dtypes} == kinds
    where = [found.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in where) for r in cursor.fetchall())
    got = sorted(tuple(plain(v) for v in r) for r in spark_df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == expected
    plan = spark_df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan], plan


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("partitions", [1, 64])
@pytest.mark.parametrize("name", ["extended_locks", "pinned_labels", "range_select", "replication_lag", "run_counters", "table_health"])
def test_partition_invariance(spark, sf_dir, duck, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
