"""Catalog tables derived from the driver's test tables.

The derivations are SQL that Spark and the checking engine both run, so the two see the same inputs. A name in braces
is a test table or another derivation.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}

_EVENT_SCOPE = (
    "concat('c', CAST(event_id % 3 AS STRING)) AS cluster, "
    "date_trunc('hour', ts) + INTERVAL '1' HOUR AS snapshot_ts"
)
_NOW = "TIMESTAMP '2002-01-01 00:00:00' AS snapshot_ts"

DERIVATIONS = {
    "activity": f"""
SELECT {_EVENT_SCOPE}, CASE WHEN event_id % 3 = 2 THEN 7 ELSE 6 END AS major, event_id % 19 = 0 AS own_backend,
       event_id AS pid, user_id AS sess_id,
       concat('db', CAST(user_id % 5 AS STRING)) AS datname, concat('u', CAST(user_id % 20 AS STRING)) AS usename,
       CASE WHEN event_id % 11 = 0 THEN 'autovacuum' WHEN event_id % 13 = 0 THEN NULL ELSE 'app' END AS application_name,
       CASE event_type WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'idle'
                       WHEN 'signup' THEN 'idle in transaction' ELSE NULL END AS state,
       CASE WHEN event_id % 5 = 0 THEN 'background worker' ELSE 'client backend' END AS backend_type,
       CASE WHEN event_id % 4 = 0 THEN 'Lock' ELSE NULL END AS wait_event_type, event_id % 4 = 0 AS waiting,
       CASE WHEN event_id % 7 = 0 THEN 'VACUUM t' WHEN event_id % 17 = 0 THEN 'autovacuum: VACUUM t'
            ELSE 'select 1' END AS query,
       CASE event_id % 6 WHEN 0 THEN date_trunc('hour', ts) + INTERVAL '1' HOUR - INTERVAL '7' SECOND
                         WHEN 1 THEN date_trunc('hour', ts) + INTERVAL '1' HOUR - INTERVAL '180' SECOND
                         WHEN 2 THEN date_trunc('hour', ts) + INTERVAL '1' HOUR - INTERVAL '59' SECOND
                         ELSE ts END AS query_start,
       ts AS xact_start
FROM {{events}}""",
    "locks": f"""
SELECT {_EVENT_SCOPE}, event_id AS pid,
       CASE event_id % 4 WHEN 0 THEN 'relation' WHEN 1 THEN 'tuple' WHEN 2 THEN 'transactionid' ELSE NULL END AS locktype,
       CASE WHEN event_id % 2 = 0 THEN 'ExclusiveLock' ELSE 'ShareLock' END AS mode,
       user_id % 6 AS database, event_id % 5 <> 0 AS granted, event_id % 4 - 1 AS gp_segment_id, user_id AS mppsessionid
FROM {{events}}""",
    "event_snapshots": f"SELECT DISTINCT {_EVENT_SCOPE} FROM {{events}}",
    # Object ids of databases; oid 5 used by locks has no row.
    "pg_database": """
SELECT CAST(r_regionkey AS BIGINT) AS oid, concat('db', CAST(r_regionkey AS STRING)) AS datname,
       r_regionkey <> 3 AS datallowconn, r_regionkey = 0 AS datistemplate
FROM {region}""",
    # Database lists of the allow filter, a few hundred names per cluster.
    "customer_databases": f"""
SELECT concat('c', CAST(c_custkey % 3 AS STRING)) AS cluster, {_NOW}, c_custkey AS oid,
       concat('db', CAST(c_custkey AS STRING)) AS datname, c_custkey % 7 <> 3 AS datallowconn, c_custkey % 11 = 0 AS datistemplate
FROM {{customer}}""",
    "listed_databases": """
SELECT DISTINCT concat('c', CAST(o_custkey % 3 AS STRING)) AS cluster,
       concat(CASE WHEN o_orderstatus <> 'F' OR o_orderpriority NOT LIKE '1%' THEN 'other' WHEN o_custkey % 10 = 0 THEN 'DB' ELSE 'db' END,
              CAST(o_custkey AS STRING)) AS datname
FROM {orders}""",
    "segment_config": f"""
SELECT concat('c', CAST(s_suppkey % 3 AS STRING)) AS cluster, {_NOW}, s_suppkey AS dbid,
       CAST(floor(floor(s_suppkey / 3.0) / 2.0) AS BIGINT) - 1 AS content,
       CASE WHEN CAST(floor(s_suppkey / 3.0) AS BIGINT) % 2 = 0 THEN 'p' ELSE 'm' END AS role,
       CASE WHEN s_suppkey % 7 = 0 THEN 'm' ELSE 'p' END AS preferred_role,
       CASE s_suppkey % 6 WHEN 0 THEN 's' WHEN 1 THEN 'R' WHEN 2 THEN 'c' WHEN 3 THEN 'n' WHEN 4 THEN NULL ELSE 'x' END AS mode,
       CASE WHEN s_acctbal < 0 THEN 'd' WHEN s_suppkey % 4 = 0 THEN 'U' WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'u' END AS status,
       6000 + s_suppkey AS port, concat('h', CAST(s_nationkey % 6 AS STRING)) AS hostname
FROM {{supplier}}""",
    # The same segments at every snapshot of log shipping too, and every snapshot of a whole run.
    "segment_config_all": """
SELECT * FROM {segment_config}
UNION ALL
SELECT s.cluster, r.snapshot_ts, s.dbid, s.content, s.role, s.preferred_role, s.mode, s.status, s.port, s.hostname
FROM {segment_config} s JOIN (SELECT DISTINCT cluster, snapshot_ts FROM {stat_replication}) r ON r.cluster = s.cluster""",
    "run_snapshots": """
SELECT cluster, snapshot_ts FROM {event_snapshots} UNION SELECT cluster, snapshot_ts FROM {segment_config_all}""",
    "stat_replication": """
SELECT concat('c', CAST(o_orderkey % 3 AS STRING)) AS cluster, date_trunc('month', o_orderdate) + INTERVAL '1' MONTH AS snapshot_ts,
       o_custkey % 3 - 1 AS content,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('wal', CAST(o_orderkey AS STRING)) END AS application_name,
       CASE o_orderstatus WHEN 'F' THEN 'streaming' WHEN 'O' THEN 'catchup' ELSE 'backup' END AS state,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'sync' WHEN '2' THEN 'async' WHEN '3' THEN 'potential' ELSE 'quorum' END AS sync_state,
       CAST(floor(o_totalprice) AS BIGINT) * 100000 AS sent_pos,
       CAST(floor(o_totalprice) AS BIGINT) * 100000 - o_custkey * 3 AS write_pos,
       CAST(floor(o_totalprice) AS BIGINT) * 100000 - o_custkey * 5 AS flush_pos,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) * 100000 - o_custkey * 7 + 500 END AS replay_pos
FROM {orders}""",
    # One row per cluster and month; two thirds of the months have reachable segments.
    "cluster_facts": """
SELECT cluster, snapshot_ts, min(start_ts) AS postmaster_start,
       CASE WHEN CAST(floor(count(*) / 2.0) AS BIGINT) * 2 = count(*) THEN NULL ELSE max(start_ts) END AS conf_load_time,
       CAST(100 + count(*) AS INT) AS max_connections, CAST(count(*) % 3 AS INT) AS reachable_segments,
       CASE cluster WHEN 'c0' THEN 'PostgreSQL 14.0' WHEN 'c1' THEN 'PostgreSQL 9.4.26 (X Database 6.27.1 build 1) on x86_64'
                    ELSE 'PostgreSQL 12.12 (X Database 7.3.0+dev.840.g5 build 240+git) on x86_64' END AS version_banner
FROM (SELECT concat('c', CAST(o_orderkey % 3 AS STRING)) AS cluster,
             date_trunc('month', o_orderdate) + INTERVAL '1' MONTH AS snapshot_ts, o_orderdate AS start_ts FROM {orders}) o
GROUP BY cluster, snapshot_ts""",
    # The same at every hour of the sessions.
    "hourly_facts": f"""
SELECT cluster, snapshot_ts, min(ts) - INTERVAL '90' MINUTE AS postmaster_start, max(ts) AS conf_load_time,
       CAST(5 + count(*) AS INT) AS max_connections, CAST(count(*) AS INT) AS reachable_segments,
       CASE cluster WHEN 'c1' THEN 'PostgreSQL 9.4.26 (X Database 6.27.1 build 1) on x86_64'
                    ELSE 'PostgreSQL 12.12 (X Database 7.3.0 build 240) on x86_64' END AS version_banner
FROM (SELECT {_EVENT_SCOPE}, ts FROM {{events}}) e
GROUP BY cluster, snapshot_ts""",
    # Version banners on both sides of the oldest supported version, one cluster per customer.
    "version_banners": """
SELECT concat('c', CAST(c_custkey AS STRING)) AS cluster,
       CASE WHEN c_custkey % 6 = 5 THEN 'PostgreSQL 14.0'
            ELSE concat('PostgreSQL 9.4.26 (X Database ', CAST(5 + c_custkey % 3 AS STRING), '.', CAST(25 + c_custkey % 4 AS STRING), '.',
                        CAST(c_custkey % 2 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN '+dev.8' ELSE '' END, ' build 1) on x86_64') END AS version_banner
FROM {customer}""",
    "table_stats": f"""
SELECT concat('c', CAST(o_orderkey % 3 AS STRING)) AS cluster, {_NOW},
       concat('db', CAST(o_custkey % 5 AS STRING)) AS datname,
       CASE o_orderstatus WHEN 'P' THEN 'pg_catalog' WHEN 'O' THEN 'public' ELSE 'sales' END AS nspname,
       concat('t', CAST(o_orderkey AS STRING)) AS relname, CASE WHEN o_orderkey % 9 = 0 THEN 'i' ELSE 'r' END AS relkind,
       o_custkey * 9 AS n_live_tup, (o_orderkey % 97) * 11 AS n_dead_tup,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS last_vacuum,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL '30' DAY END AS last_autovacuum,
       o_orderkey % 13 AS vacuum_count, o_orderkey % 29 AS autovacuum_count
FROM {{orders}}""",
    "bloat_diag": f"""
SELECT concat('c', CAST(p_partkey % 3 AS STRING)) AS cluster, {_NOW}, concat('db', CAST(p_partkey % 5 AS STRING)) AS datname,
       CASE WHEN p_partkey % 10 = 0 THEN 'gp_toolkit' ELSE lower(p_type) END AS nspname, concat(CASE WHEN p_partkey % 8 = 1 THEN 'gone' ELSE 't' END, CAST(p_partkey AS STRING)) AS relname,
       CAST(p_size AS BIGINT) * 10 AS relpages, p_partkey % 25 AS exppages
FROM {{part}}""",
    "skew_coefficients": f"""
SELECT concat('c', CAST(p_partkey % 3 AS STRING)) AS cluster, {_NOW}, concat('db', CAST(p_partkey % 5 AS STRING)) AS datname,
       CASE WHEN p_partkey % 10 = 0 THEN 'gp_toolkit' ELSE lower(p_type) END AS nspname, concat('t', CAST(p_partkey AS STRING)) AS relname,
       CAST(CAST(p_partkey * 37 % 1000 AS DECIMAL(12,3)) / 100 AS DECIMAL(20,6)) AS skccoeff
FROM {{part}}""",
    "database_size": f"""
SELECT concat('c', CAST(c_custkey % 3 AS STRING)) AS cluster, {_NOW},
       concat('db', CAST(c_custkey AS STRING)) AS datname, CAST(floor(abs(c_acctbal)) AS BIGINT) * 1000003 AS bytes
FROM {{customer}}""",
    "disk_usage": f"""
SELECT concat('c', CAST(s_suppkey % 3 AS STRING)) AS cluster, {_NOW}, s_suppkey AS segment, concat('h', CAST(s_nationkey % 6 AS STRING)) AS hostname,
       CAST(1000000 AS BIGINT) AS total_kb, CAST(floor(abs(s_acctbal)) AS BIGINT) * 50 AS used_kb,
       1000000 - CAST(floor(abs(s_acctbal)) AS BIGINT) * 50 AS avail_kb, CAST(floor(abs(s_acctbal) * 50 / 10000) AS BIGINT) AS percent
FROM {{supplier}}""",
    # Text as it comes from the hosts; every eleventh line is an error message.
    "disk_usage_lines": """
SELECT concat('c', CAST(s_suppkey % 3 AS STRING)) AS cluster,
       CASE WHEN s_suppkey % 11 = 0 THEN 'df: /data: Transport endpoint is not connected'
            ELSE concat(CAST(s_suppkey AS STRING), ',h', CAST(s_nationkey % 6 AS STRING), ',/dev/sd', CAST(s_suppkey % 4 AS STRING), ',1000000,',
                        CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) * 50 AS STRING), ',',
                        CAST(1000000 - CAST(floor(abs(s_acctbal)) AS BIGINT) * 50 AS STRING), ',',
                        CAST(CAST(floor(abs(s_acctbal) * 50 / 10000) AS BIGINT) AS STRING), '%') END AS value
FROM {supplier}""",
    "workfile_usage": f"""
SELECT concat('c', CAST(l_orderkey % 3 AS STRING)) AS cluster, {_NOW}, CASE WHEN l_suppkey % 12 = 5 THEN 1000005 ELSE l_suppkey % 12 END AS segid,
       CAST(floor(l_extendedprice) AS BIGINT) AS size
FROM {{lineitem}}""",
    "customer_groups": f"""
SELECT concat('c', CAST(c_custkey % 3 AS STRING)) AS cluster, {_NOW},
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS groupid,
       lower(c_mktsegment) AS rsgname, concat('h', CAST(c_nationkey % 8 AS STRING)) AS hostname,
       CAST(floor(abs(c_acctbal)) AS BIGINT) AS used, c_custkey % 100 AS load
FROM {{customer}}""",
    "resgroup_host": """
SELECT cluster, snapshot_ts, groupid, hostname, CAST(sum(used) AS BIGINT) AS memory_used, CAST(max(load) AS DOUBLE) + CAST(0.5 AS DOUBLE) AS cpu
FROM {customer_groups} GROUP BY cluster, snapshot_ts, groupid, hostname""",
    "resgroup_status": """
SELECT cluster, snapshot_ts, groupid, count(*) AS num_running, max(load) AS num_queueing
FROM {customer_groups} GROUP BY cluster, snapshot_ts, groupid""",
    "resgroup": "SELECT DISTINCT cluster, snapshot_ts, groupid AS oid, rsgname FROM {customer_groups}",
    "resgroup_config": """
SELECT DISTINCT cluster, snapshot_ts, CASE WHEN groupid = 5 THEN 55 ELSE groupid END AS groupid, CASE WHEN groupid = 2 THEN -1 ELSE groupid * 10 END AS cpu_limit,
       CASE WHEN groupid = 3 THEN 0 WHEN groupid = 4 THEN -1 ELSE groupid * CASE WHEN cluster = 'c1' THEN 20 ELSE 5 END END AS memory_limit
FROM {customer_groups}""",
    "backups_raw": f"""
SELECT concat('c', CAST(o_orderkey % 3 AS STRING)) AS cluster, {_NOW}, o_orderkey AS backup_id, concat('db', CAST(o_custkey % 5 AS STRING)) AS database_name,
       o_custkey % 2 AS incremental,
       CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'SUCCESS' ELSE 'Success' END WHEN 'O' THEN 'Failure'
                          ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'Queued' ELSE 'In Progress' END END AS status,
       o_orderdate AS start_time, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL '2' HOUR END AS end_time
FROM {{orders}}""",
    "flat_samples": """
SELECT concat('c', CAST(event_id % 3 AS STRING)) AS cluster, ts, concat('m_', event_type) AS metric,
       concat('db', CAST(user_id % 5 AS STRING)) AS label_database, concat('t', CAST(user_id AS STRING)) AS label_table,
       CASE WHEN event_id % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(floor(value * 100) AS DOUBLE) / CAST(100 AS DOUBLE) END AS value
FROM {events}""",
    "collector_run_log": """
SELECT concat('c', CAST(CAST(floor(event_id / 10.0) AS BIGINT) % 3 AS STRING)) AS cluster, CAST(floor(event_id / 10.0) AS BIGINT) AS scrape_id,
       event_id % 10 AS seq, event_type AS collector, ts AS start_ts, CAST(floor(value) AS BIGINT) AS duration_ms, event_type = 'error' AS failed
FROM {events}""",
    "scrape_log": """
SELECT cluster, scrape_id, min(start_ts) AS start_ts, CAST(sum(duration_ms) AS DOUBLE) / CAST(1000 AS DOUBLE) AS duration_s,
       sum(CASE WHEN failed THEN 1 ELSE 0 END) < 3 AND scrape_id % 13 <> 0 AND scrape_id % 17 <> 0 AS successful,
       scrape_id % 13 <> 0 AS probe_ok, scrape_id % 17 <> 0 AS version_detected,
       sum(CASE WHEN failed THEN 1 ELSE 0 END) >= 3 AS db_error
FROM {collector_run_log} GROUP BY cluster, scrape_id""",
    "scrape_requests": """
SELECT concat('c', CAST(event_id % 3 AS STRING)) AS cluster, event_id AS request_id, ts AS request_ts
FROM {events}""",
    # Entities that come and go: users seen per day, with a label that changes over time.
    "entity_days": """
SELECT cluster, snapshot_ts, entity, CASE WHEN max(event_id) % 2 = 0 THEN 'p' ELSE 'm' END AS role, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT concat('c', CAST(event_id % 3 AS STRING)) AS cluster, date_trunc('day', ts) + INTERVAL '1' DAY AS snapshot_ts,
             concat('e', CAST(user_id AS STRING)) AS entity, event_id FROM {events}) e
GROUP BY cluster, snapshot_ts, entity""",
    # All snapshots of the entity tables; every fifth day failed.
    "entity_snapshots": """
SELECT cluster, snapshot_ts, max(CASE WHEN EXTRACT(DAY FROM snapshot_ts) % 5 = 0 THEN 0 ELSE 1 END) = 1 AS ok
FROM (SELECT concat('c', CAST(event_id % 3 AS STRING)) AS cluster, date_trunc('day', ts) + INTERVAL '1' DAY AS snapshot_ts FROM {events}) e
GROUP BY cluster, snapshot_ts""",
}


def dependencies(name: str) -> list[str]:
    return list(dict.fromkeys(field for _, field, _, _ in Formatter().parse(DERIVATIONS[name]) if field))


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE_SCHEMAS:
        return base_table(spark, sf_dir, name)
    inputs = {d: derive(spark, sf_dir, d) for d in dependencies(name)}
    return spark.sql(DERIVATIONS[name], **inputs)


def with_clause(*names: str) -> str:
    """The same derivations as common table expressions, in dependency order."""
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in BASE_SCHEMAS or name in ordered:
            return
        for d in dependencies(name):
            visit(d)
        ordered[name] = DERIVATIONS[name].format(**{d: d for d in dependencies(name)})

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ordered.items())
