"""Sessions: connection states, running queries, running vacuums.

``activity`` carries two columns its landing query adds: ``own_backend`` (the row is the collecting session itself)
and ``major`` (server major version). Both are constant or near-constant within a file, so they cost next to nothing
in Parquet and spare a join of the largest table with a per-snapshot table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.scalars import elapsed_s, elapsed_us, or_unknown, to_bigint_half_even, zero_if_null
from fleetlens.functions.scope import SCOPE, fill_snapshots

# Duration buckets in seconds, lower bound included, upper bound excluded.
DURATION_BUCKETS = (
    ("0_10", 0, 10),
    ("10_60", 10, 60),
    ("60_180", 60, 180),
    ("180_600", 180, 600),
    ("600_plus", 600, None),
)
SLOW_BUCKETS = ("180_600", "600_plus")


def is_client() -> Column:
    """Sessions that count as connections: not the collecting one, and from version 7 on only client backends."""
    return _not_own() & ((F.col("major") < 7) | (F.col("backend_type") == "client backend"))


def of_state(named: Column, unnamed: Column) -> Column:
    """Sessions of the state ``unknown`` from those with that very state and those without one."""
    return F.when((named > 0) & (unnamed > 0), F.least(named, unnamed)).otherwise(named + unnamed)


def _not_own() -> Column:
    return ~F.col("own_backend")


def connections_by_state(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Sessions per state; from version 7 on only client backends count.

    Should a state literally be called ``unknown`` next to a NULL state, the smaller count stays, as the source
    reads states by falling count and the last row of a key wins.
    """
    counted = of_state(F.count("state"), F.count_if(F.col("state").isNull()))
    return (
        tables["activity"]
        .filter(is_client())
        .groupBy(*SCOPE, or_unknown("state").alias("state"))
        .agg(counted.alias("connections"))
    )


def connections_total(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    totals = connections_by_state(tables).groupBy(*SCOPE).agg(F.sum("connections").alias("connections"))
    return fill_snapshots(totals, snapshots, {"connections": 0})


def _bucket_counts(tables: Mapping[str, DataFrame], snapshots: DataFrame | None) -> DataFrame:
    """One row per snapshot with a count per bucket; snapshots whose sessions match nothing keep zeros.

    The predicates sit inside the aggregates: filtering first would drop those snapshots and need a join back.
    """
    counts = tables["activity"].groupBy(*SCOPE).agg(*bucket_counts())
    return fill_snapshots(counts, snapshots, {name: 0 for name, _, _ in DURATION_BUCKETS})


def bucket_counts() -> list[Column]:
    """Aggregates over all session rows of a snapshot: running queries per duration bucket."""
    age = elapsed_us("snapshot_ts", "query_start")
    counted = _not_own() & (F.col("state") == "active") & (F.col("application_name") != "autovacuum")
    second = 1_000_000

    def inside(low: int, high: int | None) -> Column:
        test = counted & (age >= low * second)
        return test if high is None else test & (age < high * second)

    return [F.count_if(inside(low, high)).alias(name) for name, low, high in DURATION_BUCKETS]


def bucket_totals() -> list[Column]:
    total = sum((F.col(name) for name, _, _ in DURATION_BUCKETS[1:]), F.col(DURATION_BUCKETS[0][0]))
    return [total.alias("total"), (F.col(SLOW_BUCKETS[0]) + F.col(SLOW_BUCKETS[1])).alias("slow")]


def active_query_buckets(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    names = [name for name, _, _ in DURATION_BUCKETS]
    return _bucket_counts(tables, snapshots).unpivot(list(SCOPE), names, "bucket", "queries")


def active_query_totals(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    return _bucket_counts(tables, snapshots).select(*SCOPE, *bucket_totals())


def vacuum_seconds() -> Column:
    return zero_if_null(to_bigint_half_even(elapsed_s("snapshot_ts", "xact_start")))


def is_vacuum() -> Column:
    text = F.col("query")
    return (text.ilike("vacuum%") | text.ilike("autovacuum:%")) & (F.col("state") != "idle")


def vacuum_running(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Sessions that run a vacuum now. Narrow, no shuffle."""
    return (
        tables["activity"]
        .filter(is_vacuum())
        .select(
            *SCOPE,
            or_unknown("datname").alias("datname"),
            or_unknown("usename").alias("usename"),
            "pid",
            vacuum_seconds().alias("seconds_running"),
        )
    )


def vacuum_running_flag(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    flags = (
        tables["activity"]
        .groupBy(*SCOPE)
        .agg(F.max(F.when(is_vacuum(), F.lit(1.0)).otherwise(F.lit(0.0))).alias("running"))
    )
    return fill_snapshots(flags, snapshots, {"running": 0.0})
