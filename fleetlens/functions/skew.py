"""Skew statistics over hosts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.scalars import round_half_up
from fleetlens.functions.scope import SCOPE, fill_snapshots


def host_skew(
    df: DataFrame,
    measures: Mapping[str, Column | str],
    host: str = "hostname",
    snapshots: DataFrame | None = None,
    truncate: bool = True,
) -> DataFrame:
    """Sum each measure per host, then max, mean and max/mean over the hosts of a snapshot.

    For a measure ``m`` the columns are ``max_m``, ``avg_m`` and ``m_skew_ratio``, all to one decimal. The ratio
    is cut to a whole number unless ``truncate`` is False. Both levels combine on the map side, so a cluster
    that holds a large share of the rows only sends one partial row per host and task.
    """
    per_host = df.groupBy(*SCOPE, host).agg(
        *[F.sum(F.col(c) if isinstance(c, str) else c).cast("double").alias(m) for m, c in measures.items()]
    )
    stats = per_host.groupBy(*SCOPE).agg(
        *[f(m).alias(f"_{tag}_{m}") for m in measures for tag, f in (("max", F.max), ("avg", F.avg))]
    )
    out = stats.select(*SCOPE, *skew_columns(measures, truncate))
    return fill_snapshots(out, snapshots, {c: 0.0 for c in out.columns if c not in SCOPE})


def skew_columns(measures: Iterable[str], truncate: bool = True) -> list[Column]:
    """``max_m``, ``avg_m`` and ``m_skew_ratio`` from the columns ``_max_m`` and ``_avg_m`` over hosts."""
    columns = []
    for m in measures:
        top, mean = F.coalesce(f"_max_{m}", F.lit(0.0)), F.coalesce(f"_avg_{m}", F.lit(0.0))
        ratio = F.when(top > 0, F.coalesce(F.try_divide(top, mean), F.lit(0.0))).otherwise(F.lit(0.0))
        if truncate:
            ratio = ratio.cast("long").cast("double")
        columns += [
            round_half_up(top).alias(f"max_{m}"),
            round_half_up(mean).alias(f"avg_{m}"),
            round_half_up(ratio).alias(f"{m}_skew_ratio"),
        ]
    return columns
