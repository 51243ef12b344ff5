"""The (cluster, snapshot) scope that every table and every grouping carries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

SCOPE = ("cluster", "snapshot_ts")


def scope_of(*frames: DataFrame) -> list[str]:
    """Scope columns shared by all frames.

    A dimension without ``snapshot_ts`` holds for every snapshot of its cluster; one without ``cluster``
    holds for the whole fleet.
    """
    return [c for c in SCOPE if all(c in f.columns for f in frames)]


def fill_snapshots(df: DataFrame, snapshots: DataFrame | None, defaults: Mapping[str, object]) -> DataFrame:
    """One row for every snapshot of the spine, with ``defaults`` where a snapshot produced nothing.

    ``df`` holds at most one row per snapshot, so the join adds no fan-out. Without a spine ``df`` is returned.
    """
    if snapshots is None:
        return df
    spine = snapshots.select(*SCOPE).distinct()
    joined = spine.join(df, list(SCOPE), "left")
    return joined.select(
        *SCOPE,
        *[
            F.coalesce(F.col(c), F.lit(defaults[c]).cast(df.schema[c].dataType)).alias(c) if c in defaults else F.col(c)
            for c in df.columns
            if c not in SCOPE
        ],
    )
