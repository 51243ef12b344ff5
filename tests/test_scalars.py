"""Scalar rules, one table of cases per rule."""

import math

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators.cluster import parse_version


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first()[0]


CASES = [
    ("status", S.status_code, "string", [("u", 1), ("U", 1), ("d", 0), ("D", 0), (None, 0), ("unknown", 0)]),
    ("role", S.role_code, "string", [("p", 1), ("P", 1), ("m", 2), ("M", 2), (None, 2), ("x", 2)]),
    ("mode", S.mode_code, "string", [("s", 1), ("R", 2), ("c", 3), ("N", 4), (None, 4), ("x", 0)]),
    ("shipping", S.replication_state_code, "string", [("Streaming", 1), ("catchup", 2), ("BACKUP", 3), ("startup", 0), (None, 0)]),
    ("sync", S.sync_state_code, "string", [("sync", 2), ("Async", 1), ("potential", 0.5), ("quorum", 0), (None, 0)]),
    ("or_unknown", S.or_unknown, "string", [(None, "unknown"), ("", ""), ("  ", "  "), ("é\n", "é\n")]),
    ("blank_or_unknown", S.blank_or_unknown, "string", [(None, "unknown"), ("", "unknown"), (" ", " "), ("a", "a")]),
    ("scope", S.scope_tag, "int", [(-1, "master"), (0, "segment"), (7, "segment")]),
    ("round", S.round_half_up, "double", [(0.05, 0.1), (-0.05, 0.0), (1.249, 1.2), (2.25, 2.3), (-1.25, -1.2)]),
    ("bigint", S.to_bigint_half_even, "double", [(0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (2.51, 3), (None, None)]),
    ("limit", S.cpu_limit_label, "int", [(20, "20"), (0, "unlimited"), (-1, "unlimited"), (None, "unlimited")]),
    ("flag", S.flag, "boolean", [(True, 1.0), (False, 0.0), (None, 0.0)]),
    ("zero", S.value_or_zero, "double", [(None, 0.0), (3.5, 3.5)]),
    ("compact", S.compact_epoch, "string", [("20240301120000", 1709294400), ("", None), ("2024", None), (None, None), ("20241301000000", None)]),
]


@pytest.mark.parametrize("name,rule,kind,cases", CASES, ids=[c[0] for c in CASES])
def test_rule(spark, name, rule, kind, cases):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], f"i int, x {kind}")
    got = [r[0] for r in rows.orderBy("i").select(rule("x")).collect()]
    assert got == [e for _, e in cases]


def test_value_or_nan(spark):
    assert math.isnan(one(spark, None, "double", S.value_or_nan("x")))
    assert one(spark, 1.0, "double", S.value_or_nan("x")) == 1.0


@pytest.mark.parametrize("sent,reached,lag", [
    ("1/0", "0/FFFFFFFF", 1), ("0/10", "0/20", 0), ("0/10", None, 0), (None, "0/1", 0), ("FFFFFFFF/0", "FFFFFFFE/0", 2**32),
])
def test_lag(spark, sent, reached, lag):
    row = spark.createDataFrame([(sent, reached)], "a string, b string")
    assert row.select(S.lag_bytes("a", "b")).first()[0] == lag


@pytest.mark.parametrize("actual,expected,state", [(5, 0, 2), (40, 10, 0), (41, 10, 1), (100, 10, 1), (101, 10, 2), (None, 3, 0), (0, 0, 2)])
def test_bloat(spark, actual, expected, state):
    row = spark.createDataFrame([(actual, expected)], "a bigint, b bigint")
    assert row.select(S.bloat_state("a", "b")).first()[0] == state


@pytest.mark.parametrize("live,dead,ratio", [(0, 0, 0.0), (3, 1, 0.25), (0, 5, 1.0)])
def test_dead_ratio(spark, live, dead, ratio):
    row = spark.createDataFrame([(live, dead)], "a bigint, b bigint")
    assert row.select(S.dead_ratio("a", "b")).first()[0] == ratio


@pytest.mark.parametrize("subsystem,expected", [("host", "ns_host_x"), ("", "ns_x"), (None, "ns_x")])
def test_metric_name(subsystem, expected):
    assert S.metric_name("x", subsystem, "ns") == expected


def test_either_column(spark):
    df = spark.createDataFrame([(None, 1), (2, 3)], "new int, old int")
    assert [r[0] for r in df.select(S.either_column(df, ["new", "old"])).collect()] == [1, 2]
    assert [r[0] for r in df.select(S.either_column(df, ["gone", "old"])).collect()] == [1, 3]
    with pytest.raises(ValueError):
        S.either_column(df, ["gone"])


BANNERS = [
    ("PostgreSQL 9.4.26 (X Database 6.27.1 build 1) on x86_64", (6, 27, 1), True),
    ("PostgreSQL 9.4.26 (X Database 6.27.1_x53 build 1) on x86_64", (6, 27, 1), True),
    ("PostgreSQL 12.12 (X Database 7.3.0+dev.840.g5 build 240+git) on x86_64", (7, 3, 0), True),
    ("  PostgreSQL 9.4.26 (X Database 6.26.99 build 1)  ", (6, 26, 99), False),
    ("PostgreSQL 9.4.26 (X Database 6.28.0 build 1)", (6, 28, 0), True),
    ("PostgreSQL 9.4.26 (X Database 6.27.0 build 1)", (6, 27, 0), False),
    ("PostgreSQL 9.4.26 (X Database 5.99.99 build 1)", (5, 99, 99), False),
    ("PostgreSQL (x) 9 (X Database 6.30.2-rc1 build 1)", (6, 30, 2), True),
    ("PostgreSQL 9.4.26 (X Database 6.27 build 1)", None, False),
    ("PostgreSQL 9.4.26 (X Database 6.27.1 builds 1)", None, False),
    ("PostgreSQL 9.4.26 X Database 6.27.1 build 1", None, False),
    ("PostgreSQL 14.0", None, False),
    ("", None, False),
    (None, None, False),
]


@pytest.mark.parametrize("banner,numbers,supported", BANNERS)
def test_version(spark, banner, numbers, supported):
    row = parse_version(spark.createDataFrame([(banner,)], "version_banner string")).first()
    assert (None if row.major is None else (row.major, row.minor, row.patch)) == numbers
    assert row.supported is supported
    assert row.version == (None if numbers is None else ".".join(map(str, numbers)))


def test_value_text(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (7.0,)], "v double")
    assert [r[0] for r in df.select(S.value_text("v", {0: "Unknown", 0.5: "Potential"})).collect()] == ["Unknown", "Potential", "7.0"]
    assert one(spark, 1.0, "double", S.value_text("x", {})) == "1.0"
    assert F is not None


@pytest.mark.parametrize(
    "sent,reached,lag",
    [
        ("0/10", "0/0", 16), ("1/0", "0/FFFFFFFF", 1), ("0/0", "0/10", 0), (None, "0/0", 0), ("0/0", None, 0),
        ("7FFFFFFF/FFFFFFFF", "0/0", 2**63 - 1), ("80000000/0", "0/0", 2**63 - 1), ("FFFFFFFF/0", "0/0", 2**63 - 1),
        ("0/0", "FFFFFFFF/FFFFFFFF", 0), ("x/1", "0/0", 0), ("1/2/3", "0/0", 0), ("123456789/0", "0/0", 0), ("", "0/0", 0),
    ],
)
def test_lag(spark, sent, reached, lag):
    row = spark.createDataFrame([(sent, reached)], "a string, b string").select(S.lag_bytes("a", "b")).first()
    assert row[0] == lag
