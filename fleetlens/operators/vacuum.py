"""Vacuum statistics of tables and databases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.scalars import dead_ratio, elapsed_s, or_unknown, to_bigint_half_even, whole_seconds, zero_if_null
from fleetlens.functions.scope import SCOPE, scope_of

# Schemas left out, and the smallest table that counts.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
TUPLE_THRESHOLD = 1000


def table_stats_from_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_stats`` from the three catalog tables it is made of (class, namespace, per-table statistics).

    Namespaces are few per database; class and statistics share their key, so both joins keep the row count.
    """
    classes, spaces, stats = tables["pg_class"], tables["pg_namespace"], tables["pg_stat_all_tables"]
    key = [*scope_of(classes, stats), *(["datname"] if "datname" in classes.columns and "datname" in stats.columns else [])]
    space_key = [*scope_of(classes, spaces), *(["datname"] if "datname" in classes.columns and "datname" in spaces.columns else [])]
    named = classes.withColumnRenamed("relnamespace", "_nsp").join(
        spaces.select(*space_key, F.col("oid").alias("_nsp"), "nspname"), [*space_key, "_nsp"]
    )
    return named.withColumnRenamed("oid", "relid").join(
        stats.select(
            *key, "relid", "n_live_tup", "n_dead_tup", "last_vacuum", "last_autovacuum", "vacuum_count", "autovacuum_count"
        ),
        [*key, "relid"],
    ).drop("relid", "_nsp")


def _candidates(tables: Mapping[str, DataFrame], tuple_threshold: int) -> DataFrame:
    stats = tables["table_stats"] if "table_stats" in tables else table_stats_from_catalog(tables)
    return stats.filter(
        (F.col("relkind") == "r")
        & ~F.col("nspname").isin(*SYSTEM_SCHEMAS)
        & (F.col("n_live_tup") + F.col("n_dead_tup") >= tuple_threshold)
    )


def _last_any():
    return F.greatest("last_vacuum", "last_autovacuum")


def table_vacuum(
    tables: Mapping[str, DataFrame], tuple_threshold: int = TUPLE_THRESHOLD, never_flag: bool = False
) -> DataFrame:
    """Dead tuples and vacuum ages per table. Narrow when ``table_stats`` is given, so nothing shuffles.

    A table that was never vacuumed reports 0 seconds; ``never_flag`` adds a column that tells it apart.
    """
    columns = [
        or_unknown("datname").alias("datname"),
        or_unknown("nspname").alias("nspname"),
        "relname",
        zero_if_null(dead_ratio("n_live_tup", "n_dead_tup")).alias("dead_tuple_ratio"),
        zero_if_null(whole_seconds("snapshot_ts", _last_any())).alias("seconds_since_last_vacuum"),
        zero_if_null(whole_seconds("snapshot_ts", F.coalesce("last_autovacuum", "last_vacuum"))).alias(
            "seconds_since_last_autovacuum"
        ),
        zero_if_null("vacuum_count").alias("vacuum_count"),
        zero_if_null("autovacuum_count").alias("autovacuum_count"),
    ]
    if never_flag:
        columns.append(_last_any().isNull().alias("never_vacuumed"))
    return _candidates(tables, tuple_threshold).select(*SCOPE, *columns)


def db_vacuum(tables: Mapping[str, DataFrame], tuple_threshold: int = TUPLE_THRESHOLD) -> DataFrame:
    ratio = dead_ratio("n_live_tup", "n_dead_tup")
    return (
        _candidates(tables, tuple_threshold)
        .groupBy(*SCOPE, or_unknown("datname").alias("datname"))
        .agg(
            zero_if_null(to_bigint_half_even(F.max(elapsed_s("snapshot_ts", _last_any())))).alias(
                "max_seconds_since_last_vacuum"
            ),
            F.coalesce(F.avg(ratio), F.lit(0.0)).alias("avg_dead_tuple_ratio"),
            F.coalesce(F.max(ratio), F.lit(0.0)).alias("max_dead_tuple_ratio"),
        )
    )
