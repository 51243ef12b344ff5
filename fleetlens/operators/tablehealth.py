"""Table bloat and data skew."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.functions.scalars import bloat_state, or_unknown
from fleetlens.functions.scope import SCOPE

# Schemas left out, threshold before rounding, and how many tables a database reports.
SKEW_SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "gp_toolkit")
SKEW_THRESHOLD = "0.1"
SKEW_TOP = 10

_KEY = ("datname", "nspname", "relname")


def _named():
    return [or_unknown(c).alias(c) for c in _KEY]


def table_bloat(tables: Mapping[str, DataFrame]) -> DataFrame:
    return tables["bloat_diag"].select(*SCOPE, *_named(), bloat_state("relpages", "exppages").alias("bloat_state"))


def table_skew_top(tables: Mapping[str, DataFrame], top: int = SKEW_TOP) -> DataFrame:
    """Most skewed tables of each database, ranked by the rounded coefficient, ties by schema and table.

    ``row_number() <= top`` plans as a group limit before the shuffle, so a task ships at most ``top`` rows per
    database however many tables the database has.
    """
    rank = Window.partitionBy(*SCOPE, "datname").orderBy(F.desc("skew_factor"), "nspname", "relname")
    rounded = F.round(F.col("skccoeff").cast("decimal(20,6)"), 1).cast("double")
    return (
        tables["skew_coefficients"]
        .filter((F.col("skccoeff") > F.lit(SKEW_THRESHOLD).cast("decimal(3,1)")) & ~F.col("nspname").isin(*SKEW_SYSTEM_SCHEMAS))
        .select(*SCOPE, *_named(), rounded.alias("skew_factor"))
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= top)
        .drop("_rank")
    )


def table_health(tables: Mapping[str, DataFrame], top: int = SKEW_TOP) -> DataFrame:
    """Bloat and skew merged by table, 0 for the side a table is missing from; bloat alone where skew could not be read.

    A full outer merge written as union and aggregate: one hash aggregation with map-side combine in place of two
    sorted sides, and no broadcast decision to get wrong.
    """
    bloat = table_bloat(tables).withColumn("skew_factor", F.lit(None).cast("double"))
    both = bloat
    if "skew_coefficients" in tables:
        both = bloat.unionByName(table_skew_top(tables, top).withColumn("bloat_state", F.lit(None).cast("int")))
    return (
        both.groupBy(*SCOPE, *_KEY)
        .agg(
            F.coalesce(F.max("bloat_state").cast("double"), F.lit(0.0)).alias("bloat_state"),
            F.coalesce(F.max("skew_factor"), F.lit(0.0)).alias("skew_factor"),
        )
    )
