"""The collectors and their metric catalogue."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators import (
    backups, cluster, databases, hosts, locks, replication, resgroups, segments, sessions, tablehealth, vacuum,
)
from fleetlens.operators import runlog
from fleetlens.plans.samples import CollectorSpec, MetricSpec, metric_column_samples

# Subsystems, metric names and label names of the catalogue.
SERVER, DATABASE, EXPORTER, CLUSTER, HOST, QUERY, BACKUP = (
    "server", "database", "exporter", "cluster", "host", "query", "gpbackup",
)


def _metrics(subsystem: str, labels: Sequence[tuple[str, str] | str], **values: str) -> tuple[MetricSpec, ...]:
    pairs = tuple((x, x) if isinstance(x, str) else x for x in labels)
    return tuple(MetricSpec(name, column, pairs, subsystem) for name, column in values.items())


def _skew_metrics(measure: str) -> tuple[MetricSpec, ...]:
    names = (f"max_{measure}", f"avg_{measure}", f"{measure}_skew_ratio")
    return _metrics(HOST, (), **{n: n for n in names})


_TABLE = (("database", "datname"), ("schema", "nspname"), ("table", "relname"))
_GROUP = (("resourceGroupName", "rsgname"),)
_SEGMENT = ("dbid", "content", "hostname", "preferred_role", "role", "port")
_SHIPPER = ("scope", "content", "host", "application_name")

COLLECTORS: tuple[CollectorSpec, ...] = (
    CollectorSpec(
        "cluster_state", "cluster_state", ("cluster_facts", "segment_config", "stat_replication"),
        cluster.cluster_state, on_error="continue",
        metrics=(
            MetricSpec("state", "accessible", (("version", "version"), ("master", "master"), ("standby", "standby")), CLUSTER),
            *_metrics(
                CLUSTER, (), uptime_seconds="uptime", sync="sync",
                config_last_load_time_seconds="config_load_time", max_connections="max_connections",
            ),
        ),
    ),
    CollectorSpec(
        "segment_health", "segment", ("segment_config",), segments.segment_health, ("hostname", "dbid"), absent="nan",
        metrics=_metrics(
            CLUSTER, _SEGMENT, segment_status="status_value", segment_role="role_value", segment_mode="mode_value"
        ),
    ),
    CollectorSpec(
        "segment_counts", "segment", ("segment_config",), segments.segment_counts,
        spine=True, metrics=_metrics(CLUSTER, (), segments_total="total", segments_up="up", segments_down="down"),
    ),
    CollectorSpec(
        "connections_by_state", "connections_by_state", ("activity",), sessions.connections_by_state, ("state",),
        absent="zero", metrics=_metrics(CLUSTER, ("state",), connections_total="connections"),
    ),
    CollectorSpec(
        "connections_total", "connections_by_state", ("activity",), sessions.connections_total,
        spine=True, metrics=_metrics(CLUSTER, (), connections_all_states_total="connections"),
    ),
    CollectorSpec(
        "active_query_buckets", "active_query_duration", ("activity",), sessions.active_query_buckets, ("bucket",),
        absent="zero", on_error="continue",
        spine=True, metrics=_metrics(QUERY, ("bucket",), active_queries_duration_bucket="queries"),
    ),
    CollectorSpec(
        "active_query_totals", "active_query_duration", ("activity",), sessions.active_query_totals, on_error="continue",
        spine=True, metrics=_metrics(QUERY, (), active_queries_total="total", active_queries_slow="slow"),
    ),
    CollectorSpec(
        "locked_sessions", "locked_sessions", ("activity", "locks"), locks.locked_sessions, ("lock_type",),
        absent="zero", metrics=_metrics(SERVER, ("lock_type",), locked_sessions_count="sessions"),
    ),
    CollectorSpec(
        "locks_waiting_count", "locked_sessions", ("locks",), locks.locks_waiting_count,
        spine=True, metrics=_metrics(CLUSTER, (), query_waiting_count="waiting"),
    ),
    CollectorSpec(
        "locked_sessions_total", "locked_sessions", ("activity", "locks"), locks.locked_sessions_total,
        spine=True, metrics=_metrics(SERVER, (), locked_sessions_total="sessions"),
    ),
    CollectorSpec(
        "extended_locks", "extended_locked_sessions", ("activity", "locks", "pg_database"), locks.extended_locks,
        ("metric", "database", "lock_type", "mode", "content"), absent="remove",
        metrics=_metrics(
            SERVER, ("database", "lock_type", "mode", "content"),
            lock_waiting_queries="value", lock_wait_max_wait_seconds="value",
        ),
        to_samples=metric_column_samples(("database", "lock_type", "mode", "content"), SERVER),
    ),
    CollectorSpec(
        "replication_lag", "replication_monitor", ("stat_replication", "segment_config"), replication.replication_lag,
        ("content", "host"), absent="nan", on_error="empty",
        metrics=_metrics(
            CLUSTER, _SHIPPER,
            replication_lag_bytes="replay_lag_bytes", replication_state="state_value",
            replication_sync_state="sync_state_value", replication_write_lag_bytes="write_lag_bytes",
            replication_flush_lag_bytes="flush_lag_bytes",
        ),
    ),
    CollectorSpec(
        "replication_max_lag", "replication_monitor", ("stat_replication", "segment_config"),
        replication.replication_max_lag, on_error="empty",
        spine=True, metrics=_metrics(CLUSTER, (), replication_max_lag_bytes="max_lag_bytes"),
    ),
    CollectorSpec(
        "database_size", "database_size", ("database_size",), databases.database_size, ("datname",), absent="nan",
        metrics=_metrics(HOST, (("dbname", "datname"),), database_name_mb_size="size_mb"),
    ),
    CollectorSpec(
        "database_size_totals", "database_size", ("database_size",), databases.database_size_totals,
        spine=True, metrics=(
            MetricSpec("total_database_size_mb", "total_mb", (), HOST),
            MetricSpec("database_count", "databases", (), SERVER),
        ),
    ),
    CollectorSpec(
        "table_vacuum", "table_vacuum_statistics", ("table_stats",), vacuum.table_vacuum,
        ("datname", "nspname", "relname"), absent="zero", group="per_db",
        metrics=_metrics(
            DATABASE, _TABLE,
            table_dead_tuple_ratio="dead_tuple_ratio", table_seconds_since_last_vacuum="seconds_since_last_vacuum",
            table_seconds_since_last_autovacuum="seconds_since_last_autovacuum", table_vacuum_count="vacuum_count",
            table_autovacuum_count="autovacuum_count",
        ),
    ),
    CollectorSpec(
        "db_vacuum", "db_vacuum_statistics", ("table_stats",), vacuum.db_vacuum, ("datname",), absent="zero",
        group="per_db",
        metrics=_metrics(
            DATABASE, ("datname",),
            db_max_seconds_since_last_vacuum="max_seconds_since_last_vacuum",
            db_avg_dead_tuple_ratio="avg_dead_tuple_ratio", db_max_dead_tuple_ratio="max_dead_tuple_ratio",
        ),
    ),
    CollectorSpec(
        "vacuum_running", "vacuum_running", ("activity",), sessions.vacuum_running, ("datname", "pid", "usename"),
        absent="remove", metrics=_metrics(SERVER, ("datname", "usename", "pid"), vacuum_running_seconds="seconds_running"),
    ),
    CollectorSpec(
        "vacuum_running_flag", "vacuum_running", ("activity",), sessions.vacuum_running_flag,
        spine=True, metrics=_metrics(SERVER, (), vacuum_running="running"),
    ),
    CollectorSpec(
        "table_health", "table_health", ("bloat_diag", "skew_coefficients"), tablehealth.table_health,
        ("datname", "nspname", "relname"), absent="nan", group="per_db", optional=("skew_coefficients",),
        metrics=_metrics(SERVER, _TABLE, table_bloat_state="bloat_state", table_skew_factor="skew_factor"),
    ),
    CollectorSpec(
        "disk_per_host", "disk_per_host", ("disk_usage",), hosts.disk_per_host, ("hostname",), absent="nan",
        on_error="continue",
        metrics=_metrics(
            HOST, ("hostname",), disk_total_kb="total_kb", disk_used_kb="used_kb", disk_available_kb="avail_kb",
            disk_usage_percent="percent",
        ),
    ),
    CollectorSpec(
        "disk_skew", "disk_per_host", ("disk_usage",), hosts.disk_skew, on_error="continue",
        spine=True, metrics=tuple(m for measure in hosts.DISK_MEASURES for m in _skew_metrics(measure)),
    ),
    CollectorSpec(
        "spill_per_host", "spill_per_host", ("workfile_usage", "segment_config"), hosts.spill_per_host, ("hostname",),
        absent="nan", metrics=_metrics(HOST, ("hostname",), spill_usage_bytes="spill_bytes"),
    ),
    CollectorSpec(
        "spill_skew", "spill_per_host", ("workfile_usage", "segment_config"), hosts.spill_skew,
        spine=True, metrics=_skew_metrics("spill_usage"),
    ),
    CollectorSpec(
        "rsg_per_host", "rsg_per_host",
        ("resgroup_status", "resgroup", "resgroup_host", "resgroup_config", "segment_config"),
        resgroups.rsg_per_host, ("hostname", "rsgname"), absent="nan",
        metrics=(
            MetricSpec("mem_usage_mb", "memory_usage", (*_GROUP, ("hostname", "hostname")), HOST),
            MetricSpec(
                "cpu_usage_percentage", "cpu_usage", (*_GROUP, ("limit", "limit"), ("hostname", "hostname")), HOST
            ),
        ),
    ),
    CollectorSpec(
        "rsg_per_group", "rsg_per_host",
        ("resgroup_status", "resgroup", "resgroup_host", "resgroup_config", "segment_config"),
        resgroups.rsg_per_group, ("rsgname",), absent="nan",
        metrics=_metrics(
            HOST, _GROUP, num_running_sessions="num_running", num_queueing_sessions="num_queueing",
            mem_limit_percent="memory_limit", cpu_rate_limit_percentage="cpu_rate_limit",
        ),
    ),
    CollectorSpec(
        "rsg_effective_mem_limit", "rsg_per_host",
        ("resgroup_status", "resgroup", "resgroup_host", "resgroup_config", "segment_config"),
        resgroups.rsg_effective_mem_limit, ("rsgname",), absent="nan",
        metrics=_metrics(HOST, _GROUP, mem_limit_percent_value="effective_mem_limit"),
    ),
    CollectorSpec(
        "rsg_skew", "rsg_per_host",
        ("resgroup_status", "resgroup", "resgroup_host", "resgroup_config", "segment_config"),
        resgroups.rsg_skew, spine=True, metrics=(*_skew_metrics("mem_usage"), *_skew_metrics("cpu_usage")),
    ),
    CollectorSpec(
        "backup_metrics", "backup_history", ("backups",), backups.backup_metrics,
        ("database", "metric", "type", "incremental", "status"), absent="remove",
        metrics=(
            *_metrics(BACKUP, ("database", "type", "status"), backup_count="value"),
            *_metrics(BACKUP, ("database", "incremental", "status"), last_backup_duration_seconds="value"),
            *_metrics(BACKUP, ("database", "incremental"), seconds_since_last_backup_completion="value"),
        ),
        to_samples=metric_column_samples(("database", "type", "incremental", "status"), BACKUP),
    ),
)

# Collectors that are off unless asked for.
OFF_BY_DEFAULT = ("table_health", "backup_history")

COLLECTOR_NAMES = tuple(dict.fromkeys(s.collector for s in COLLECTORS))
_GROUPS = {s.collector: s.group for s in COLLECTORS}


def enabled_collectors(overrides: Mapping[str, bool] | None = None) -> tuple[str, ...]:
    flags = {name: name not in OFF_BY_DEFAULT for name in COLLECTOR_NAMES}
    unknown = set(overrides or ()) - set(flags)
    if unknown:
        raise ValueError(f"no such collector: {sorted(unknown)}")
    flags.update(overrides or {})
    return tuple(name for name, on in flags.items() if on)


def selected_specs(
    overrides: Mapping[str, bool] | None = None, specs: Iterable[CollectorSpec] = COLLECTORS
) -> tuple[CollectorSpec, ...]:
    enabled = set(enabled_collectors(overrides))
    return tuple(s for s in specs if s.collector in enabled or s.collector not in COLLECTOR_NAMES)


def collector_selection(
    databases_allowed: DataFrame,
    clusters: DataFrame,
    overrides: Mapping[str, bool] | None = None,
    per_db_mode: str = "all",
) -> DataFrame:
    """Planned runs: general collectors once per cluster, per-database ones once per allowed database.

    In mode ``none`` the per-database collectors run as general ones, on the base database only.
    """
    enabled = enabled_collectors(overrides)
    as_general = [n for n in enabled if _GROUPS[n] == "general" or per_db_mode == "none"]
    per_db = [n for n in enabled if n not in as_general]

    def runs(df: DataFrame, names: Sequence[str], group: str, datname) -> DataFrame:
        listed = F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>"))
        return df.select("cluster", datname.alias("datname"), F.lit(group).alias("run_group"), listed.alias("collector"))

    plan = runs(clusters.select("cluster").distinct(), as_general, "general", F.lit(None).cast("string"))
    return plan.unionByName(runs(databases_allowed.select("cluster", "datname"), per_db, "per_db", F.col("datname")))


# Run-log metrics, built from the logs and not from a snapshot.
UP = MetricSpec("up", "up")
RUN_STATS_METRICS = _metrics(
    EXPORTER, ("collector",), collector_error_total="errors", collector_duration_seconds="last_duration_ms"
)
SUMMARY_METRICS = _metrics(
    EXPORTER, (),
    total_scraped_total="scrapes", total_error_total="errors",
    scrape_duration_seconds_count="duration_count", scrape_duration_seconds_sum="duration_sum",
    scrape_duration_seconds_max="duration_max", uptime_seconds="uptime_seconds",
)


# Running totals, and the parts of one summary; all other metrics are gauges.
_COUNTERS = ("collector_error_total", "total_scraped_total", "total_error_total")


def _kind(m: MetricSpec) -> MetricSpec:
    kind = "counter" if m.name in _COUNTERS else "summary" if m.name.startswith("scrape_duration_seconds") else m.kind
    return replace(m, kind=kind)


RUN_STATS_METRICS = tuple(map(_kind, RUN_STATS_METRICS))
SUMMARY_METRICS = tuple(map(_kind, SUMMARY_METRICS))


def run_log_tables(tables: Mapping[str, DataFrame]) -> dict[str, tuple[DataFrame, tuple[MetricSpec, ...], str]]:
    """Run-log frames with their metrics and time column (summaries carry the cluster's last scrape time)."""
    last = tables["scrape_log"].groupBy("cluster").agg(F.max("start_ts").alias("ts"))
    return {
        "cluster_up": (cluster.cluster_up(tables), (UP,), "start_ts"),
        "collector_run_stats": (runlog.collector_run_stats(tables).join(last, "cluster"), RUN_STATS_METRICS, "ts"),
        "scrape_summary": (runlog.scrape_summary(tables).join(last, "cluster"), SUMMARY_METRICS, "ts"),
    }
