"""Databases: size, and which of them the per-database collectors visit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.scalars import BYTES_PER_MB, value_or_zero
from fleetlens.functions.scope import SCOPE, fill_snapshots, scope_of

FILTER_MODES = ("all", "include", "exclude", "none")


def database_size(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Whole megabytes per database (integer division, as in the source query); an unknown size is 0."""
    return tables["database_size"].select(
        *SCOPE, "datname", value_or_zero(F.expr(f"bytes div {BYTES_PER_MB}")).alias("size_mb")
    )


def database_size_totals(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    totals = database_size(tables).groupBy(*SCOPE).agg(
        F.sum("size_mb").alias("total_mb"), F.count(F.lit(1)).alias("databases")
    )
    return fill_snapshots(totals, snapshots, {"total_mb": 0.0, "databases": 0})


def database_filter(
    tables: Mapping[str, DataFrame], mode: str = "all", names: DataFrame | Sequence[str] | None = None
) -> DataFrame:
    """Connectable, non-template databases that pass the allow filter.

    ``names`` is a short list of names or a frame with a ``datname`` column (and scope columns, if the list differs
    between clusters). Names are case-sensitive and names that do not exist are ignored.
    """
    if mode not in FILTER_MODES:
        raise ValueError(f"mode {mode!r} is not one of {FILTER_MODES}")
    databases = tables["pg_database"]
    scope = scope_of(databases)
    allowed = databases.filter(F.col("datallowconn") & ~F.col("datistemplate")).select(*scope, "datname").distinct()
    if mode == "all":
        return allowed
    if mode == "none":
        return allowed.filter(F.lit(False))
    if names is None:
        names = []
    if not isinstance(names, DataFrame):
        listed = F.col("datname").isin(list(names))
        return allowed.filter(listed if mode == "include" else ~listed)
    keys = [*scope_of(allowed, names), "datname"]
    how = "left_semi" if mode == "include" else "left_anti"
    return allowed.join(names.select(*keys), keys, how)


def per_database(table: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep the rows of allowed databases: the fan-out over databases is one join, not one query each."""
    keys = [*scope_of(table, allowed), "datname"]
    return table.join(allowed.select(*keys), keys, "left_semi")
