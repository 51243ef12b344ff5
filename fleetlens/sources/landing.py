"""Landing a snapshot: what is read from a cluster's catalog, per server version, and where it goes.

Each statement is a plain projection into the landed schema. Filtering, joining and counting happen later, over the whole
history, in Spark. ``own_backend`` and ``major`` are added here because only the reading session knows them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.schemas import table_schema
from fleetlens.sources.catalog import jdbc_options, read_databases, write_landed

# Catalog views and their columns. A list of columns stands for "SELECT … FROM view"; an entry is a
# column of the landed table, or "expression AS column".
_POSITIONS = ("sent", "write", "flush", "replay")
_ACTIVITY = ("pid = pg_backend_pid() AS own_backend", "pid", "sess_id", "datname", "usename", "application_name", "state", "query", "query_start", "xact_start")
_SHIPPING = ("application_name", "state", "sync_state")


def _select(view: str, columns: Iterable[str]) -> str:
    return f"SELECT {', '.join(columns)} FROM {view}"


def _positions(suffix: str) -> list[str]:
    return [f"CAST({p}_{suffix} AS text) AS {p}_lsn" for p in _POSITIONS]


def _shipping(suffix: str) -> str:
    """The coordinator's own shippers and those every segment reports."""
    columns = [*_SHIPPING, *_positions(suffix)]
    own = _select("pg_stat_replication", ["-1 AS content", *columns])
    segments = _select("gp_dist_random('pg_stat_replication')", ["gp_execution_segment() AS content", *columns])
    return f"{own} UNION ALL {segments}"


def landing_sql(major: int, disk_table: str = "monitor.segment_disk_usage") -> dict[str, str]:
    """Statements run once per cluster, in its base database."""
    new = major >= 7
    session = (
        ("backend_type", "wait_event_type", "CAST(NULL AS boolean) AS waiting")
        if new
        else ("CAST(NULL AS text) AS backend_type", "CAST(NULL AS text) AS wait_event_type", "waiting")
    )
    usage = ("cpu_usage AS cpu", "memory_usage AS memory_used") if new else ("cpu", "memory_used")
    cpu_limit = "cpu_max_percent" if new else "cpu_rate_limit"
    facts = (
        "version() AS version_banner", "pg_postmaster_start_time() AS postmaster_start", "pg_conf_load_time() AS conf_load_time",
        "CAST(current_setting('max_connections') AS int) AS max_connections", "count(1) AS reachable_segments",
    )
    return {
        "activity": _select("pg_stat_activity", [f"{major} AS major", *_ACTIVITY, *session]),
        "locks": _select("pg_locks", ["pid", "locktype", "mode", "CAST(database AS bigint) AS database", "granted", "gp_segment_id", "mppsessionid"]),
        "pg_database": _select("pg_database", ["CAST(oid AS bigint) AS oid", "datname", "datallowconn", "datistemplate"]),
        "segment_config": _select(
            "gp_segment_configuration",
            ["dbid", "content", "role", "preferred_role", "mode", "status", "port", "hostname", "address", "datadir"],
        ),
        "stat_replication": _shipping("lsn" if new else "location"),
        "cluster_facts": _select("gp_dist_random('gp_id')", facts),
        "database_size": _select("gp_toolkit.gp_size_of_database", ["sodddatname AS datname", "sodddatsize AS bytes"]),
        "disk_usage": _select(
            disk_table,
            ["dfsegment AS segment", "dfhostname AS hostname", "dffilesystem AS filesystem", "dftotal_kb AS total_kb",
             "dfused_kb AS used_kb", "dfavail_kb AS avail_kb", "dfpercent AS percent"],
        ),
        "workfile_usage": _select("gp_toolkit.gp_workfile_usage_per_query", ["segid", "size"]),
        "resgroup_status": _select("gp_toolkit.gp_resgroup_status", ["CAST(groupid AS bigint) AS groupid", "num_running", "num_queueing"]),
        "resgroup": _select("pg_resgroup", ["CAST(oid AS bigint) AS oid", "rsgname"]),
        "resgroup_host": _select("gp_toolkit.gp_resgroup_status_per_host", ["CAST(groupid AS bigint) AS groupid", "hostname", *usage]),
        "resgroup_config": _select(
            "gp_toolkit.gp_resgroup_config",
            ["CAST(groupid AS bigint) AS groupid", f"CAST({cpu_limit} AS int) AS cpu_limit", "CAST(memory_limit AS int) AS memory_limit"],
        ),
    }


# Statements run in every database that passes the allow filter; the reader adds ``datname``.
DATABASE_SQL = {
    "table_stats": _select(
        "pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_stat_all_tables s ON s.relid = c.oid",
        ["n.nspname", "c.relname", "c.relkind", "s.n_live_tup", "s.n_dead_tup", "s.last_vacuum", "s.last_autovacuum", "s.vacuum_count", "s.autovacuum_count"],
    ),
    "bloat_diag": _select("gp_toolkit.gp_bloat_diag", ["bdinspname AS nspname", "bdirelname AS relname", "bdirelpages AS relpages", "bdiexppages AS exppages"]),
    "skew_coefficients": _select("gp_toolkit.gp_skew_coefficients", ["skcnamespace AS nspname", "skcrelname AS relname", "skccoeff"]),
}

# The backup history is a database of its own.
BACKUP_SQL = {"backups": _select("backups", ["rowid AS backup_id", "database_name", "incremental", "status", "timestamp", "end_time"])}

Reader = Callable[[str], DataFrame]


def jdbc_reader(spark: SparkSession, url: str, user: str | None = None, **extra: str) -> Reader:
    return lambda sql: spark.read.format("jdbc").options(**jdbc_options(url, sql, user, **extra)).load()


def conform(rows: DataFrame, table: str, cluster: str, snapshot_ts: dt.datetime) -> DataFrame:
    """Rows of a statement in the landed schema: scope first, fixed types, columns it does not have as NULL."""
    scope = {"cluster": F.lit(cluster), "snapshot_ts": F.lit(snapshot_ts)}
    have = set(rows.columns)
    return rows.select(
        *[
            scope.get(f.name, F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(table)
        ]
    )


def land_snapshot(
    spark: SparkSession,
    root: str,
    cluster: str,
    snapshot_ts: dt.datetime,
    major: int,
    base: Reader,
    databases: Mapping[str, Reader] | None = None,
    backups: Reader | None = None,
    tables: Iterable[str] | None = None,
) -> None:
    """Read one snapshot of a cluster and land it, its manifest row last.

    ``databases`` has a reader per allowed database (leave it out for mode ``none``: the base database then stands for
    all); a database that cannot be read is skipped, and leaves a row (table, database, error) in the landed ``read_errors``.
    """
    statements = {**landing_sql(major)}
    per_database = dict(DATABASE_SQL)
    wanted = set(tables) if tables is not None else {*statements, *per_database, *(BACKUP_SQL if backups else ())}
    for table, sql in statements.items():
        if table in wanted:
            write_landed(conform(base(sql), table, cluster, snapshot_ts), root, table)
    errors: list[tuple[str, str, str]] = []
    for table, sql in per_database.items():
        if table not in wanted:
            continue
        if databases is None:
            rows = base(sql.replace("SELECT ", "SELECT current_database() AS datname, ", 1))
        else:
            failures: list[tuple[str, str]] = []
            rows = read_databases({name: (lambda read=read, sql=sql: read(sql)) for name, read in databases.items()}, failures=failures)
            errors += [(table, name, error) for name, error in failures]
        if rows is not None:
            write_landed(conform(rows, table, cluster, snapshot_ts), root, table)
    if backups is not None and "backups" in wanted:
        write_landed(conform(backups(BACKUP_SQL["backups"]), "backups", cluster, snapshot_ts), root, "backups")
    if errors:
        failed = spark.createDataFrame(errors, "source_table string, datname string, error string")
        write_landed(conform(failed, "read_errors", cluster, snapshot_ts), root, "read_errors")
    done = spark.range(1).select(F.lit(True).alias("ok"))
    write_landed(conform(done, "snapshots", cluster, snapshot_ts), root, "snapshots")

