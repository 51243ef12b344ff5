"""Column layout of the input tables. Every table starts with ``cluster, snapshot_ts`` unless it is a log."""

from __future__ import annotations

from pyspark.sql import types as T

_SCOPED = "cluster string, snapshot_ts timestamp, "

_DDL = {
    "activity": _SCOPED
    + "major int, own_backend boolean, pid bigint, sess_id bigint, datname string, usename string, "
    "application_name string, state string, backend_type string, wait_event_type string, waiting boolean, "
    "query string, query_start timestamp, xact_start timestamp",
    "locks": _SCOPED
    + "pid bigint, locktype string, mode string, database bigint, granted boolean, gp_segment_id int, mppsessionid bigint",
    "pg_database": _SCOPED + "oid bigint, datname string, datallowconn boolean, datistemplate boolean",
    "segment_config": _SCOPED
    + "dbid bigint, content int, role string, preferred_role string, mode string, status string, port int, "
    "hostname string, address string, datadir string",
    "stat_replication": _SCOPED
    + "content int, application_name string, state string, sync_state string, sent_lsn string, write_lsn string, "
    "flush_lsn string, replay_lsn string",
    "cluster_facts": _SCOPED
    + "version_banner string, postmaster_start timestamp, conf_load_time timestamp, max_connections int, "
    "reachable_segments int",
    "table_stats": _SCOPED
    + "datname string, nspname string, relname string, relkind string, n_live_tup bigint, n_dead_tup bigint, "
    "last_vacuum timestamp, last_autovacuum timestamp, vacuum_count bigint, autovacuum_count bigint",
    "bloat_diag": _SCOPED + "datname string, nspname string, relname string, relpages bigint, exppages bigint",
    "skew_coefficients": _SCOPED + "datname string, nspname string, relname string, skccoeff decimal(20,6)",
    "database_size": _SCOPED + "datname string, bytes bigint",
    "disk_usage": _SCOPED
    + "segment int, hostname string, filesystem string, total_kb bigint, used_kb bigint, avail_kb bigint, percent int",
    "workfile_usage": _SCOPED + "segid int, size bigint",
    "resgroup_status": _SCOPED + "groupid bigint, num_running int, num_queueing int",
    "resgroup": _SCOPED + "oid bigint, rsgname string",
    "resgroup_host": _SCOPED + "groupid bigint, hostname string, cpu double, memory_used bigint",
    "resgroup_config": _SCOPED + "groupid bigint, cpu_limit int, memory_limit int",
    "backups": _SCOPED
    + "backup_id bigint, database_name string, incremental int, status string, timestamp string, end_time string",
    "snapshots": _SCOPED + "ok boolean",
    "read_errors": _SCOPED + "source_table string, datname string, error string",
    "metric_samples": "cluster string, ts timestamp, metric string, labels map<string,string>, value double",
    "scrape_log": "cluster string, scrape_id bigint, start_ts timestamp, duration_s double, successful boolean, "
    "probe_ok boolean, version_detected boolean, db_error boolean",
    "collector_run_log": "cluster string, scrape_id bigint, seq bigint, start_ts timestamp, collector string, "
    "duration_ms bigint, failed boolean",
}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


TABLES = tuple(_DDL)
