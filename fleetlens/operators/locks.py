"""Lock waits.

Both joins of locks with sessions are many-to-many on a key that can be very hot (one session waiting for many
locks, many backends sharing a session id). Their results are only ever counted or maximised, so each side is reduced
to one row per join key first and the counts are multiplied after the join. The result is the same as counting joined
rows, and the join itself never fans out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.scalars import blank_or_unknown, elapsed_s, or_unknown
from fleetlens.functions.scope import SCOPE, fill_snapshots, scope_of


def is_waiting() -> Column:
    return ((F.col("major") < 7) & F.col("waiting")) | ((F.col("major") >= 7) & (F.col("wait_event_type") == "Lock"))


def of_type(pairs: Column) -> Column:
    """Aggregate over a lock type's rows: blank, NULL and literal 'unknown' types share a key; the source reads them in
    type order and the last one wins."""
    kind = F.col("locktype")
    missing, blank = F.sum(F.when(kind.isNull(), pairs)), F.sum(F.when(kind == "", pairs))
    named = F.sum(F.when(kind != "", pairs))
    none = F.lit(0)
    return F.coalesce(F.nullif(missing, none), F.nullif(named, none), blank)


def longest_wait(oldest: str) -> Column:
    return F.coalesce(elapsed_s("snapshot_ts", oldest).cast("long"), F.lit(0).cast("long"))


def locked_sessions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Waiting sessions per lock type.

    Before version 7 a session waits when its flag is set and the lock is not granted; from 7 on when it waits on a
    lock event, whatever the lock's own state.
    """
    sessions = (
        tables["activity"]
        .filter(is_waiting())
        .groupBy(*SCOPE, "pid")
        .agg(
            F.count_if(F.col("major") < 7).alias("_old"),
            F.count_if(F.col("major") >= 7).alias("_new"),
        )
    )
    locks = (
        tables["locks"]
        .groupBy(*SCOPE, "pid", "locktype")
        .agg(F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("granted")).alias("_ungranted"))
    )
    pairs = F.col("_ungranted") * F.col("_old") + F.col("_all") * F.col("_new")
    return (
        locks.join(sessions, [*SCOPE, "pid"])
        .groupBy(*SCOPE, blank_or_unknown("locktype").alias("lock_type"))
        .agg(of_type(pairs).alias("sessions"))
        .filter(F.col("sessions") > 0)
    )


def locks_waiting_count(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    counts = tables["locks"].groupBy(*SCOPE).agg(F.count_if(~F.col("granted")).alias("waiting"))
    return fill_snapshots(counts, snapshots, {"waiting": 0})


def locked_sessions_total(tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None) -> DataFrame:
    totals = locked_sessions(tables).groupBy(*SCOPE).agg(F.sum("sessions").alias("sessions"))
    return fill_snapshots(totals, snapshots, {"sessions": 0})


def extended_locks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Ungranted locks per (database, lock type, mode, segment): joined-row count and longest wait, as long rows.

    The count is of joined rows on purpose: a lock of a session with three backends counts three times.
    """
    locks, databases = tables["locks"], tables["pg_database"]
    group = ["database", "locktype", "mode", "gp_segment_id"]
    waiting = (
        locks.filter(~F.col("granted"))
        .groupBy(*SCOPE, *group, "mppsessionid")
        .agg(F.count(F.lit(1)).alias("_locks"))
    )
    sessions = (
        tables["activity"]
        .filter(F.col("sess_id").isNotNull())
        .groupBy(*SCOPE, F.col("sess_id").alias("mppsessionid"))
        .agg(F.count(F.lit(1)).alias("_backends"), F.min("query_start").alias("_oldest"))
    )
    per_oid = (
        waiting.join(sessions, [*SCOPE, "mppsessionid"], "left")
        .groupBy(*SCOPE, *group)
        .agg(
            F.sum(F.col("_locks") * F.coalesce("_backends", F.lit(1))).alias("_queries"),
            F.min("_oldest").alias("_oldest"),
        )
    )
    db_scope = scope_of(locks, databases)
    names = databases.select(*db_scope, F.col("oid").alias("database"), "datname")
    label = {
        "database": or_unknown("datname"),
        "lock_type": or_unknown("locktype"),
        "mode": or_unknown("mode"),
        "content": or_unknown(F.col("gp_segment_id").cast("string")),
    }
    stats = (
        per_oid.join(names, [*db_scope, "database"], "left")
        .groupBy(*SCOPE, *[c.alias(n) for n, c in label.items()])
        .agg(F.sum("_queries").alias("_queries"), F.min("_oldest").alias("_oldest"))
    )
    return stats.select(
        *SCOPE, *label, F.col("_queries").alias("lock_waiting_queries"), longest_wait("_oldest").alias("lock_wait_max_wait_seconds")
    ).unpivot(
        [*SCOPE, *label], ["lock_waiting_queries", "lock_wait_max_wait_seconds"], "metric", "value"
    )
