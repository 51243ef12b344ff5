"""Segment health."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.scalars import STATUS_DOWN, STATUS_UP, mode_code, role_code, status_code
from fleetlens.functions.scope import SCOPE, fill_snapshots

SEGMENT_COLUMNS = (
    "dbid", "content", "role", "preferred_role", "mode", "status", "port", "hostname", "address", "datadir",
)


def segment_health(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every segment with its status, role and mode codes; entity key (hostname, dbid). Narrow, no shuffle."""
    segments = tables["segment_config"]
    return segments.select(
        *SCOPE,
        *[c for c in SEGMENT_COLUMNS if c in segments.columns],
        status_code("status").alias("status_value"),
        role_code("role").alias("role_value"),
        mode_code("mode").alias("mode_value"),
    )


def status_counts() -> list[Column]:
    """Aggregates over the segment rows of a snapshot."""
    status = F.lower("status")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == STATUS_UP).alias("up"),
        F.count_if(status == STATUS_DOWN).alias("down"),
    ]


def segment_counts(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    counts = tables["segment_config"].groupBy(*SCOPE).agg(*status_counts())
    return fill_snapshots(counts, snapshots, {"total": 0, "up": 0, "down": 0})
