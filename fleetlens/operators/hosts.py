"""Disk and spill usage per host."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.scalars import ROLE_PRIMARY, zero_if_null
from fleetlens.functions.scope import SCOPE, scope_of
from fleetlens.functions.skew import host_skew

DISK_MEASURES = {
    "disk_total_kb": "total_kb",
    "disk_used_kb": "used_kb",
    "disk_available_kb": "avail_kb",
    "disk_usage_percent": "percent",
}


def primary_hosts(segments: DataFrame) -> DataFrame:
    """Primaries that hold data (the coordinator has content -1)."""
    return segments.filter((F.col("role") == ROLE_PRIMARY) & (F.col("content") >= 0))


def disk_per_host(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Disk figures of each host once. Segments of a host that disagree are settled by the greatest figures.

    One ``max`` over a struct drops duplicates and picks the row in the same pass.
    """
    figures = ["total_kb", "used_kb", "avail_kb", "percent"]
    best = (
        tables["disk_usage"]
        .groupBy(*SCOPE, "hostname")
        .agg(F.max(F.struct(*[zero_if_null(c).cast("double").alias(c) for c in figures])).alias("_d"))
    )
    return best.select(*SCOPE, "hostname", "_d.*")


def disk_skew(
    tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None, truncate: bool = True
) -> DataFrame:
    return host_skew(disk_per_host(tables), DISK_MEASURES, snapshots=snapshots, truncate=truncate)


def spill_per_host(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Spilled bytes summed per segment, then per host of the primaries; a host without spill reports 0."""
    usage, segments = tables["workfile_usage"], tables["segment_config"]
    scope = scope_of(usage, segments)
    per_segment = usage.groupBy(*scope, F.col("segid").alias("content")).agg(F.sum("size").alias("_bytes"))
    return (
        primary_hosts(segments)
        .join(per_segment, [*scope, "content"], "left")
        .groupBy(*SCOPE, "hostname")
        .agg(F.sum(F.coalesce("_bytes", F.lit(0))).cast("double").alias("spill_bytes"))
    )


def spill_skew(
    tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None, truncate: bool = True
) -> DataFrame:
    return host_skew(spill_per_host(tables), {"spill_usage": "spill_bytes"}, snapshots=snapshots, truncate=truncate)
