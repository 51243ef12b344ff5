"""Log shipping lag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.scalars import (
    ROLE_PRIMARY, blank_or_unknown, either_column, halves_lag, lsn_halves, replication_state_code, scope_tag,
    sync_state_code,
)
from fleetlens.functions.scope import SCOPE, fill_snapshots, scope_of

POSITIONS = ("sent", "write", "flush", "replay")


def normalise_positions(df: DataFrame) -> DataFrame:
    """Positions under one name, whether the source called them ``*_lsn`` or ``*_location``."""
    return df.withColumns({f"{p}_lsn": either_column(df, [f"{p}_lsn", f"{p}_location"]) for p in POSITIONS})


def union_sources(coordinator: DataFrame, segments: DataFrame) -> DataFrame:
    """Coordinator rows tagged content -1, followed by rows that already carry their segment's content."""
    tagged = coordinator.withColumn("content", F.lit(-1).cast(segments.schema["content"].dataType))
    return tagged.unionByName(segments, allowMissingColumns=True)


def shippers_by_content(replication: DataFrame) -> DataFrame:
    """One row per content: the shipper that represents it (``_r``) and the worst replay lag of all its shippers (``_worst``).

    ``max_by`` combines on the map side (ranking shippers in a window would sort a hot content whole in one task).
    """
    named = ["application_name", "state", "sync_state"]
    lags = [f"{p}_lag_bytes" for p in POSITIONS[1:]]
    # Positions are parsed in a step of their own, so that the sent one is parsed once and not per lag.
    parsed = normalise_positions(replication.filter(F.col("state").isin("streaming", "catchup"))).select(
        *SCOPE, "content", *named, *[lsn_halves(f"{p}_lsn").alias(p) for p in POSITIONS]
    )
    shipping = parsed.select(
        *SCOPE,
        "content",
        *named,
        *[halves_lag(F.col("sent"), F.col(p)).alias(f"{p}_lag_bytes") for p in POSITIONS[1:]],
    )
    # Of several shippers the greatest application name stays, NULL last; the rest of the order only settles ties.
    order = F.struct(F.col("application_name").isNull(), "application_name", *reversed(lags), "state", "sync_state")
    return shipping.groupBy(*SCOPE, "content").agg(
        F.max_by(F.struct(*named, *lags), order).alias("_r"), F.max("replay_lag_bytes").alias("_worst")
    )


def _per_content(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The reduced shippers with the host of their content's primary; they are partitioned by the join key already."""
    replication, segments = tables["stat_replication"], tables["segment_config"]
    scope = scope_of(replication, segments)
    primaries = segments.filter(F.col("role") == ROLE_PRIMARY).select(*scope, "content", "hostname")
    return shippers_by_content(replication).join(primaries, [*scope, "content"])


def lag_columns(shipper: str = "_r") -> list[Column]:
    """Columns of a content's lag from its representing shipper, a struct, and the columns ``content`` and ``hostname``."""

    def of(name: str) -> Column:
        return F.col(f"{shipper}.{name}")

    return [
        scope_tag("content").alias("scope"),
        F.col("content"),
        F.col("hostname").alias("host"),
        blank_or_unknown(of("application_name")).alias("application_name"),
        *[of(f"{p}_lag_bytes").alias(f"{p}_lag_bytes") for p in POSITIONS[1:]],
        replication_state_code(of("state")).alias("state_value"),
        sync_state_code(of("sync_state")).alias("sync_state_value"),
    ]


def replication_lag(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Lag per (content, host)."""
    return _per_content(tables).select(*SCOPE, *lag_columns())


def replication_max_lag(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    """Largest replay lag over all shippers, also those that share a key."""
    worst = _per_content(tables).groupBy(*SCOPE).agg(
        F.greatest(F.max("_worst"), F.lit(0)).cast("double").alias("max_lag_bytes")
    )
    return fill_snapshots(worst, snapshots, {"max_lag_bytes": 0.0})
