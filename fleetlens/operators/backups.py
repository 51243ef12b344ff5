"""Backup history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.scalars import compact_epoch
from fleetlens.functions.scope import SCOPE

# Statuses of finished backups and the label of all others.
SUCCESS = "success"
FAILURE = "failure"
IN_PROGRESS = "in_progress"


def backup_history(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Latest backup of each (database, incremental, status) with the size of that group.

    Rank and count come from one aggregation instead of two windows, so a database with very many backups is reduced
    before it is shuffled. Ties on the start time go to the greatest backup id. Statuses group as written and are then
    lower-cased; should two collide, the one that sorts last as written stays.
    """
    raw = (
        tables["backups"]
        .groupBy(*SCOPE, "database_name", "incremental", "status")
        .agg(
            F.count(F.lit(1)).alias("backups"),
            F.max_by(F.struct("timestamp", "end_time"), F.struct("timestamp", "backup_id")).alias("_last"),
        )
    )
    start, end = compact_epoch("_last.timestamp"), compact_epoch("_last.end_time")
    now = F.unix_timestamp(F.col("snapshot_ts").cast("timestamp"))
    stats = F.struct(
        "backups",
        F.coalesce((end - start).cast("double"), F.lit(0.0)).alias("duration_seconds"),
        F.coalesce((now - end).cast("double"), F.lit(0.0)).alias("seconds_since_completion"),
    )
    merged = raw.groupBy(*SCOPE, "database_name", "incremental", F.lower("status").alias("status")).agg(
        F.max_by(stats, F.col("status")).alias("_s")
    )
    return merged.select(*SCOPE, "database_name", "incremental", "status", "_s.*")


def backup_metrics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics each history row may show: a count always, a duration once finished, an age after success.

    Several unfinished statuses carry the same labels; the first by name keeps them.
    """
    history = backup_history(tables)
    kind = F.when(F.col("incremental") == 0, F.lit("full")).otherwise(F.lit("incremental"))
    finished = F.col("status").isin(SUCCESS, FAILURE)
    no_text = F.lit(None).cast("string")

    def row(metric, value, kind_label, incremental_label, status_label):
        return F.struct(
            F.lit(metric).alias("metric"),
            kind_label.alias("type"),
            incremental_label.alias("incremental"),
            status_label.alias("status"),
            value.cast("double").alias("value"),
        )

    rows = F.array(
        row("backup_count", F.col("backups"), kind, no_text, F.when(finished, F.col("status")).otherwise(F.lit(IN_PROGRESS))),
        F.when(
            finished,
            row("last_backup_duration_seconds", F.col("duration_seconds"), no_text, F.col("incremental").cast("string"), F.col("status")),
        ),
        F.when(
            F.col("status") == SUCCESS,
            row("seconds_since_last_backup_completion", F.col("seconds_since_completion"), no_text, kind, no_text),
        ),
    )
    exploded = history.select(
        *SCOPE,
        F.col("database_name").alias("database"),
        F.col("status").alias("_raw"),
        F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("_m"),
    )
    return exploded.groupBy(*SCOPE, "database", "_m.metric", "_m.type", "_m.incremental", "_m.status").agg(
        F.min_by("_m.value", "_raw").alias("value")
    )
