"""ANSI SQL twins of the registered queries, over the same derivations.

They are written the plain way (joins that fan out, windows over whole groups), so that they check the reductions the
Spark side makes.
"""

from __future__ import annotations

import re

from fleetlens.plans import panels, registry
from fleetlens.sources.fixtures import with_clause
from fleetlens.suite.queries import (
    MONTH_END, MONTH_START, PANEL_VARIABLES, RANGE_LOOKBACK, RANGE_STEP, VALUE_BANDS, panel_window,
)

EPOCH_NS = "(epoch_us({a}) - epoch_us({b})) / CAST(1000000 AS DOUBLE)"


def seconds(later: str, earlier: str) -> str:
    return EPOCH_NS.format(a=later, b=earlier)


def half_even(expression: str) -> str:
    """A cast from double to bigint rounds half to even here."""
    return f"CAST({expression} AS BIGINT)"


# The number between "(product " and " build": cut at the markers, last word before the second one, first three numbers.
_TOKEN = "list_extract(string_split(split_part(split_part(version_banner, '(', 2), ' build', 1), ' '), -1)"
_IS_VERSION = f"(contains(split_part(version_banner, '(', 2), ' build') AND {_TOKEN} SIMILAR TO '[0-9]+[.][0-9]+[.][0-9]+([+_-].*)?')"
_PARTS = {
    n: f"CASE WHEN {_IS_VERSION} THEN CAST(string_split(string_split_regex({_TOKEN}, '[+_-]')[1], '.')[{i}] AS INTEGER) END"
    for n, i in (("major", 1), ("minor", 2), ("patch", 3))
}
_VERSION = f"""
v AS (SELECT *, {_PARTS['major']} AS major, {_PARTS['minor']} AS minor, {_PARTS['patch']} AS patch FROM {{source}}),
ver AS (SELECT *, CASE WHEN major IS NOT NULL THEN concat(major, '.', minor, '.', patch) END AS version,
        coalesce(major > 6 OR (major = 6 AND (minor > 27 OR (minor = 27 AND patch >= 1))), FALSE) AS supported FROM v)"""

_MODE = "CASE lower(mode) WHEN 's' THEN 1.0 WHEN 'r' THEN 2.0 WHEN 'c' THEN 3.0 WHEN 'n' THEN 4.0 ELSE CASE WHEN mode IS NULL THEN 4.0 ELSE 0.0 END END"
_SEGMENT_CODES = f"""CAST(CASE WHEN lower(status) = 'u' THEN 1 ELSE 0 END AS DOUBLE) AS status_value,
 CAST(CASE WHEN lower(role) = 'p' THEN 1 ELSE 2 END AS DOUBLE) AS role_value, CAST({_MODE} AS DOUBLE) AS mode_value"""

_CONNECTIONS = """conn AS (
 SELECT cluster, snapshot_ts, coalesce(state, 'unknown') AS state, count(*) AS connections FROM activity
 WHERE NOT own_backend AND (major < 7 OR backend_type = 'client backend') GROUP BY 1, 2, 3)"""

_AGES = """ages AS (
 SELECT cluster, snapshot_ts, NOT own_backend AND state = 'active' AND application_name <> 'autovacuum' AS counted,
        (epoch_us(snapshot_ts) - epoch_us(query_start)) AS us FROM activity)"""
_BUCKETS = (("0_10", "us >= 0 AND us < 10000000"), ("10_60", "us >= 10000000 AND us < 60000000"), ("60_180", "us >= 60000000 AND us < 180000000"),
            ("180_600", "us >= 180000000 AND us < 600000000"), ("600_plus", "us >= 600000000"))

_VACUUM = "(lower(query) LIKE 'vacuum%' OR lower(query) LIKE 'autovacuum:%') AND state <> 'idle'"

_LOCKED = """pairs AS (
 SELECT l.cluster, l.snapshot_ts, CASE WHEN l.locktype IS NULL OR l.locktype = '' THEN 'unknown' ELSE l.locktype END AS lock_type
 FROM locks l JOIN activity a ON a.cluster = l.cluster AND a.snapshot_ts = l.snapshot_ts AND a.pid = l.pid
 WHERE (a.major < 7 AND a.waiting AND NOT l.granted) OR (a.major >= 7 AND a.wait_event_type = 'Lock')),
locked AS (SELECT cluster, snapshot_ts, lock_type, count(*) AS sessions FROM pairs GROUP BY 1, 2, 3)"""

_SHIP = """ship AS (
 SELECT r.cluster, r.snapshot_ts, r.content, r.application_name, r.state, r.sync_state, g.hostname,
        greatest(coalesce(sent_pos - write_pos, 0), 0) AS write_lag_bytes, greatest(coalesce(sent_pos - flush_pos, 0), 0) AS flush_lag_bytes,
        greatest(coalesce(sent_pos - replay_pos, 0), 0) AS replay_lag_bytes
 FROM stat_replication r JOIN segment_config g ON g.cluster = r.cluster AND g.content = r.content AND g.role = 'p'
 WHERE r.state IN ('streaming', 'catchup')),
shipped AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, snapshot_ts, content, hostname
   ORDER BY application_name DESC NULLS FIRST, replay_lag_bytes DESC, flush_lag_bytes DESC, write_lag_bytes DESC, state DESC, sync_state DESC) AS rn FROM ship)
 WHERE rn = 1),
lag AS (
 SELECT cluster, snapshot_ts, CASE WHEN content = -1 THEN 'master' ELSE 'segment' END AS scope, content, hostname AS host,
        CASE WHEN application_name IS NULL OR application_name = '' THEN 'unknown' ELSE application_name END AS application_name,
        write_lag_bytes, flush_lag_bytes, replay_lag_bytes,
        CAST(CASE state WHEN 'streaming' THEN 1 WHEN 'catchup' THEN 2 WHEN 'backup' THEN 3 ELSE 0 END AS DOUBLE) AS state_value,
        CAST(CASE sync_state WHEN 'sync' THEN 2 WHEN 'async' THEN 1 WHEN 'potential' THEN 0.5 ELSE 0 END AS DOUBLE) AS sync_state_value
 FROM shipped)"""

_RATIO = "CASE WHEN n_live_tup + n_dead_tup > 0 THEN CAST(n_dead_tup AS DOUBLE) / (n_live_tup + n_dead_tup) ELSE 0 END"
_TAB = """tab AS (
 SELECT *, greatest(last_vacuum, last_autovacuum) AS last_any FROM table_stats
 WHERE relkind = 'r' AND nspname NOT IN ('pg_catalog', 'information_schema', 'pg_toast') AND n_live_tup + n_dead_tup >= 1000)"""

_BLOAT = """bloat AS (
 SELECT cluster, snapshot_ts, datname, nspname, relname,
        CASE WHEN exppages = 0 THEN 2 WHEN CAST(relpages AS DOUBLE) / exppages > 10 THEN 2 WHEN CAST(relpages AS DOUBLE) / exppages > 4 THEN 1 ELSE 0 END AS bloat_state
 FROM bloat_diag)"""
_SKEW_TOP = """skew AS (
 SELECT cluster, snapshot_ts, datname, nspname, relname, skew_factor FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster, snapshot_ts, datname ORDER BY skew_factor DESC, nspname, relname) AS rn FROM (
   SELECT cluster, snapshot_ts, datname, nspname, relname, CAST(round(skccoeff, 1) AS DOUBLE) AS skew_factor
   FROM skew_coefficients WHERE skccoeff > 0.1 AND nspname NOT IN ('pg_catalog', 'information_schema', 'gp_toolkit')))
 WHERE rn <= 10)"""

_DISK = """disk AS (
 SELECT cluster, snapshot_ts, hostname, CAST(total_kb AS DOUBLE) AS total_kb, CAST(used_kb AS DOUBLE) AS used_kb,
        CAST(avail_kb AS DOUBLE) AS avail_kb, CAST(percent AS DOUBLE) AS percent
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster, snapshot_ts, hostname ORDER BY total_kb DESC, used_kb DESC, avail_kb DESC, percent DESC) AS rn
       FROM (SELECT DISTINCT cluster, snapshot_ts, hostname, total_kb, used_kb, avail_kb, percent FROM disk_usage))
 WHERE rn = 1)"""

_SPILL = """per_segment AS (SELECT cluster, snapshot_ts, segid AS content, sum(size) AS spill_bytes FROM workfile_usage GROUP BY 1, 2, 3),
spill AS (
 SELECT c.cluster, c.snapshot_ts, c.hostname, CAST(sum(coalesce(p.spill_bytes, 0)) AS DOUBLE) AS spill_bytes
 FROM segment_config c LEFT JOIN per_segment p ON p.cluster = c.cluster AND p.snapshot_ts = c.snapshot_ts AND p.content = c.content
 WHERE c.role = 'p' AND c.content >= 0 GROUP BY 1, 2, 3)"""

_RSG = """rsg AS (
 SELECT g.cluster, g.snapshot_ts, r.rsgname, h.hostname, CAST(g.num_running AS INTEGER) AS num_running, CAST(g.num_queueing AS INTEGER) AS num_queueing,
        coalesce(cfg.cpu_limit, 0) AS cpu_rate_limit, coalesce(CAST(round(h.cpu) AS INTEGER), 0) AS cpu_usage,
        coalesce(cfg.memory_limit, 0) AS memory_limit, CAST(coalesce(h.memory_used, 0) AS INTEGER) AS memory_usage
 FROM resgroup_status g JOIN resgroup r ON g.cluster = r.cluster AND g.groupid = r.oid
 LEFT JOIN resgroup_host h ON h.cluster = g.cluster AND h.groupid = g.groupid
 LEFT JOIN resgroup_config cfg ON cfg.cluster = g.cluster AND cfg.groupid = g.groupid
 WHERE EXISTS (SELECT 1 FROM segment_config c WHERE c.cluster = g.cluster AND c.hostname = h.hostname AND c.role = 'p' AND c.content >= 0)),
rsg_group AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, snapshot_ts, rsgname ORDER BY hostname) AS rn FROM rsg) WHERE rn = 1)"""


def skew_columns(measures: dict[str, str], truncate: bool = True) -> str:
    columns = []
    for m, c in measures.items():
        ratio = f"CASE WHEN max({c}) > 0 THEN max({c}) / avg({c}) ELSE 0 END"
        if truncate:
            ratio = f"floor({ratio})"
        columns.append(
            f"floor(max({c}) * 10 + 0.5) / CAST(10 AS DOUBLE) AS max_{m}, floor(avg({c}) * 10 + 0.5) / CAST(10 AS DOUBLE) AS avg_{m}, "
            f"floor(({ratio}) * 10 + 0.5) / CAST(10 AS DOUBLE) AS {m}_skew_ratio"
        )
    return ", ".join(columns)


_DISK_MEASURES = {"disk_total_kb": "total_kb", "disk_used_kb": "used_kb", "disk_available_kb": "avail_kb", "disk_usage_percent": "percent"}

_BACKUPS = f"""ranked AS (
 SELECT *, row_number() OVER (PARTITION BY cluster, database_name, incremental, status ORDER BY start_time DESC, backup_id DESC) AS rn,
        count(*) OVER (PARTITION BY cluster, database_name, incremental, status) AS backups FROM backups_raw),
hist AS (
 SELECT cluster, snapshot_ts, database_name, incremental, lower(status) AS status, backups,
        coalesce({seconds('end_time', 'start_time')}, 0) AS duration_seconds, coalesce({seconds('snapshot_ts', 'end_time')}, 0) AS seconds_since_completion
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster, database_name, incremental, lower(status) ORDER BY status DESC) AS keep FROM ranked WHERE rn = 1)
 WHERE keep = 1),
bm AS (
 SELECT cluster, snapshot_ts, database_name AS database, 'backup_count' AS metric, CASE WHEN incremental = 0 THEN 'full' ELSE 'incremental' END AS type,
        CAST(NULL AS VARCHAR) AS incremental, CASE WHEN status IN ('success', 'failure') THEN status ELSE 'in_progress' END AS status,
        CAST(backups AS DOUBLE) AS value
 FROM (SELECT *, row_number() OVER (PARTITION BY cluster, database_name, incremental,
         CASE WHEN status IN ('success', 'failure') THEN status ELSE 'in_progress' END ORDER BY status) AS first FROM hist) WHERE first = 1
 UNION ALL
 SELECT cluster, snapshot_ts, database_name, 'last_backup_duration_seconds', NULL, CAST(incremental AS VARCHAR), status, duration_seconds
 FROM hist WHERE status IN ('success', 'failure')
 UNION ALL
 SELECT cluster, snapshot_ts, database_name, 'seconds_since_last_backup_completion', NULL,
        CASE WHEN incremental = 0 THEN 'full' ELSE 'incremental' END, NULL, seconds_since_completion
 FROM hist WHERE status = 'success')"""

_INSTANT = f"""inst AS (
 SELECT cluster, TIMESTAMP '{MONTH_END}' AS ts, metric, label_database, label_table, value FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster, metric, label_database, label_table ORDER BY ts DESC, value DESC) AS rn
  FROM flat_samples WHERE ts > TIMESTAMP '{MONTH_END}' - INTERVAL '32' DAY AND ts <= TIMESTAMP '{MONTH_END}') WHERE rn = 1)"""

_RANGE = f"""steps AS (
 SELECT unnest(generate_series(TIMESTAMP '{MONTH_START}', TIMESTAMP '{MONTH_END}', INTERVAL '{RANGE_STEP}' SECOND)) AS step_at),
rng AS (
 SELECT cluster, step_at AS ts, metric, label_database, label_table, value FROM (
  SELECT f.cluster, f.metric, f.label_database, f.label_table, f.value, s.step_at,
         row_number() OVER (PARTITION BY f.cluster, f.metric, f.label_database, f.label_table, s.step_at ORDER BY f.ts DESC, f.value DESC) AS rn
  FROM flat_samples f JOIN steps s ON f.ts <= s.step_at AND f.ts > s.step_at - INTERVAL '{RANGE_LOOKBACK}' SECOND) WHERE rn = 1)"""

_FLAT = "cluster, ts, metric, label_database, label_table"

_SPINE = """spine AS (
 SELECT cluster, snapshot_ts, row_number() OVER (PARTITION BY cluster ORDER BY snapshot_ts) - 1 AS idx FROM {snapshots}),
here AS (SELECT e.cluster, e.entity, s.idx FROM {entities} e JOIN spine s USING (cluster, snapshot_ts)),
changes AS (
 SELECT h.cluster, h.entity, h.idx, CASE WHEN p.idx IS NULL THEN 'new' ELSE 'kept' END AS change
 FROM here h LEFT JOIN here p ON p.cluster = h.cluster AND p.entity = h.entity AND p.idx = h.idx - 1
 UNION ALL
 SELECT h.cluster, h.entity, h.idx + 1, 'deleted' FROM here h JOIN spine s ON s.cluster = h.cluster AND s.idx = h.idx + 1
 LEFT JOIN here n ON n.cluster = h.cluster AND n.entity = h.entity AND n.idx = h.idx + 1 WHERE n.idx IS NULL)"""
_ALL_DAYS = _SPINE.format(snapshots="entity_snapshots", entities="entity_days")
_GOOD_DAYS = (
    "good AS (SELECT cluster, snapshot_ts FROM entity_snapshots WHERE ok), "
    "good_days AS (SELECT e.* FROM entity_days e JOIN good USING (cluster, snapshot_ts)), "
    + _SPINE.format(snapshots="good", entities="good_days")
)
_CHANGES = "SELECT c.cluster, s.snapshot_ts, c.entity, c.change FROM changes c JOIN spine s USING (cluster, idx)"

# Neighbouring snapshots of an entity share the difference between their number and their rank.
_LIVES = _ALL_DAYS + """,
seen AS (
 SELECT e.cluster, e.entity, e.role, e.snapshot_ts, s.idx, s.idx - row_number() OVER (PARTITION BY e.cluster, e.entity ORDER BY s.idx) AS run
 FROM entity_days e JOIN spine s USING (cluster, snapshot_ts)),
lives AS (
 SELECT l.cluster, l.entity, l.role, l.low, l.from_ts, CASE WHEN g.idx IS NOT NULL THEN l.last_ts END AS until_ts, g.snapshot_ts AS gone_ts, g.idx AS gone
 FROM (SELECT cluster, entity, arg_min(role, idx) AS role, min(idx) AS low, max(idx) AS high, min(snapshot_ts) AS from_ts, max(snapshot_ts) AS last_ts
       FROM seen GROUP BY cluster, entity, run) l
 LEFT JOIN spine g ON g.cluster = l.cluster AND g.idx = l.high + 1)"""


def _absent(fill: str) -> str:
    return f"""{_ALL_DAYS},
first_seen AS (SELECT cluster, entity, min(idx) AS first_idx FROM here GROUP BY 1, 2)
SELECT s.cluster, s.snapshot_ts, f.entity, CASE WHEN e.entity IS NULL THEN {fill} ELSE e.value END AS value
FROM first_seen f JOIN spine s ON s.cluster = f.cluster AND s.idx >= f.first_idx
LEFT JOIN entity_days e ON e.cluster = s.cluster AND e.snapshot_ts = s.snapshot_ts AND e.entity = f.entity"""


def _bands(value: str = "value") -> str:
    chain = " ".join(f"WHEN {value} >= {bound} AND NOT isnan({value}) THEN '{colour}'" for colour, bound in reversed(VALUE_BANDS[1:]))
    return f"CASE {chain} ELSE '{VALUE_BANDS[0][0]}' END"


def _text(value: str, texts: dict[int, str]) -> str:
    chain = " ".join(f"WHEN {value} = {n} THEN '{t}'" for n, t in texts.items())
    return f"CASE {chain} ELSE CAST({value} AS VARCHAR) END"


_GENERAL = ["cluster_state", "segment", "connections_by_state", "active_query_duration", "locked_sessions", "extended_locked_sessions",
            "replication_monitor", "database_size", "vacuum_running", "spill_per_host", "rsg_per_host"]
_PER_DB = ["table_vacuum_statistics", "db_vacuum_statistics", "table_health"]

_ALLOWED = "allowed AS (SELECT DISTINCT cluster, snapshot_ts, datname FROM customer_databases WHERE datallowconn AND NOT datistemplate)"
_LISTED = "(SELECT cluster, datname FROM listed_databases)"


def _q(tables: str, ctes: str, body: str) -> str:
    head = with_clause(*tables.split())
    return f"{head},\n{ctes}\n{body}" if ctes else f"{head}\n{body}"


def build() -> dict[str, str]:
    q = _q
    versions = _VERSION.format(source="version_banners")
    sql: dict[str, str] = {}
    state = f"""
SELECT f.cluster, f.snapshot_ts, reachable_segments > 0 AS accessible, coalesce(version, 'unknown') AS version,
  coalesce((SELECT max(hostname) FROM segment_config s WHERE s.cluster = f.cluster AND content = -1 AND role = 'p'), 'unknown') AS master,
  coalesce((SELECT max(hostname) FROM segment_config s WHERE s.cluster = f.cluster AND content = -1 AND role = 'm'), '') AS standby,
  CAST(trunc({seconds('f.snapshot_ts', 'postmaster_start')}) AS BIGINT) AS uptime,
  CAST((SELECT count(*) FROM stat_replication r WHERE r.cluster = f.cluster AND r.snapshot_ts = f.snapshot_ts AND r.content = -1 AND r.state = 'streaming') AS DOUBLE) AS sync,
  coalesce(epoch_ms(conf_load_time) / CAST(1000 AS DOUBLE), 0) AS config_load_time, max_connections
FROM ver f"""
    for key, facts in (("cluster_state", "cluster_facts"), ("cluster_state_hourly", "hourly_facts")):
        sql[key] = q(f"{facts} segment_config stat_replication", _VERSION.format(source=facts), state)
    sql["segment_health"] = q("segment_config", "", f"SELECT *, {_SEGMENT_CODES} FROM segment_config")
    sql["segment_counts"] = q("segment_config", "", """
SELECT cluster, snapshot_ts, count(*) AS total, count(*) FILTER (WHERE lower(status) = 'u') AS up, count(*) FILTER (WHERE lower(status) = 'd') AS down
FROM segment_config GROUP BY 1, 2""")
    sql["segment_counts_spine"] = q("segment_config event_snapshots", "", """
SELECT s.cluster, s.snapshot_ts, count(g.dbid) AS total, count(*) FILTER (WHERE lower(g.status) = 'u') AS up,
       count(*) FILTER (WHERE lower(g.status) = 'd') AS down
FROM (SELECT cluster, snapshot_ts FROM event_snapshots UNION SELECT cluster, snapshot_ts FROM segment_config) s
LEFT JOIN segment_config g ON g.cluster = s.cluster AND g.snapshot_ts = s.snapshot_ts GROUP BY 1, 2""")
    sql["cluster_version"] = q("version_banners", versions, "SELECT cluster, major, minor, patch, version, supported FROM ver")
    sql["supported_clusters"] = q("version_banners", versions, "SELECT cluster, major, minor, patch, version FROM ver WHERE supported")
    sql["cluster_up"] = q("scrape_log", "", "SELECT cluster, scrape_id, start_ts, CAST(CASE WHEN probe_ok AND version_detected AND NOT db_error THEN 1 ELSE 0 END AS DOUBLE) AS up FROM scrape_log")
    sql["connections_by_state"] = q("activity", _CONNECTIONS, "SELECT * FROM conn")
    sql["connections_total"] = q("activity event_snapshots", _CONNECTIONS, """
SELECT s.cluster, s.snapshot_ts, CAST(coalesce(sum(connections), 0) AS BIGINT) AS connections
FROM event_snapshots s LEFT JOIN conn USING (cluster, snapshot_ts) GROUP BY 1, 2""")
    sql["active_query_buckets"] = q("activity", _AGES, " UNION ALL ".join(
        f"SELECT cluster, snapshot_ts, '{n}' AS bucket, count(*) FILTER (WHERE counted AND {test}) AS queries FROM ages GROUP BY 1, 2" for n, test in _BUCKETS))
    sql["active_query_totals"] = q("activity", _AGES, """
SELECT cluster, snapshot_ts, count(*) FILTER (WHERE counted AND us >= 0) AS total, count(*) FILTER (WHERE counted AND us >= 180000000) AS slow
FROM ages GROUP BY 1, 2""")
    sql["vacuum_running"] = q("activity", "", f"""
SELECT cluster, snapshot_ts, datname, usename, pid, {half_even(seconds('snapshot_ts', 'xact_start'))} AS seconds_running FROM activity WHERE {_VACUUM}""")
    sql["vacuum_running_flag"] = q("activity event_snapshots", f"running AS (SELECT DISTINCT cluster, snapshot_ts FROM activity WHERE {_VACUUM})", """
SELECT s.cluster, s.snapshot_ts, CAST(CASE WHEN r.cluster IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS running
FROM event_snapshots s LEFT JOIN running r USING (cluster, snapshot_ts)""")
    sql["locked_sessions"] = q("activity locks", _LOCKED, "SELECT * FROM locked")
    sql["locks_waiting_count"] = q("locks", "", "SELECT cluster, snapshot_ts, count(*) FILTER (WHERE NOT granted) AS waiting FROM locks GROUP BY 1, 2")
    sql["locked_sessions_total"] = q("activity locks event_snapshots", _LOCKED, """
SELECT s.cluster, s.snapshot_ts, CAST(coalesce(sum(sessions), 0) AS BIGINT) AS sessions FROM event_snapshots s LEFT JOIN locked USING (cluster, snapshot_ts) GROUP BY 1, 2""")
    key = "cluster, snapshot_ts, coalesce(datname, 'unknown') AS database, coalesce(locktype, 'unknown') AS lock_type, mode, CAST(gp_segment_id AS VARCHAR) AS content"
    sql["extended_locks"] = q("activity locks pg_database", """waiting AS (
 SELECT l.*, d.datname, epoch_us(l.snapshot_ts) - epoch_us(a.query_start) AS wait_us
 FROM locks l LEFT JOIN pg_database d ON d.oid = l.database
 LEFT JOIN activity a ON a.cluster = l.cluster AND a.snapshot_ts = l.snapshot_ts AND a.sess_id = l.mppsessionid
 WHERE granted = FALSE)""", f"""
SELECT {key}, 'lock_waiting_queries' AS metric, count(*) AS value FROM waiting GROUP BY 1, 2, 3, 4, 5, 6
UNION ALL
SELECT {key}, 'lock_wait_max_wait_seconds' AS metric, CAST(trunc(coalesce(max(wait_us), 0) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS value FROM waiting GROUP BY 1, 2, 3, 4, 5, 6""")
    sql["replication_lag"] = q("stat_replication segment_config", _SHIP, "SELECT * FROM lag")
    sql["replication_lag_old_names"] = sql["replication_lag"]
    sql["replication_max_lag"] = q("stat_replication segment_config", _SHIP, "SELECT cluster, snapshot_ts, CAST(max(replay_lag_bytes) AS DOUBLE) AS max_lag_bytes FROM ship GROUP BY 1, 2")
    sql["union_sources"] = q("stat_replication", "", "SELECT cluster, content, state, count(*) AS shippers FROM stat_replication GROUP BY 1, 2, 3")
    size = "CAST(floor(bytes / CAST(1048576 AS DOUBLE)) AS DOUBLE)"
    sql["database_size"] = q("database_size", "", f"SELECT cluster, snapshot_ts, datname, {size} AS size_mb FROM database_size")
    sql["database_size_totals"] = q("database_size", "", f"SELECT cluster, snapshot_ts, sum({size}) AS total_mb, count(*) AS databases FROM database_size GROUP BY 1, 2")
    sql["database_filter"] = q("customer_databases listed_databases", _ALLOWED, f"SELECT * FROM allowed WHERE (cluster, datname) IN {_LISTED}")
    sql["database_filter_exclude"] = q("customer_databases listed_databases", _ALLOWED, f"SELECT * FROM allowed WHERE (cluster, datname) NOT IN {_LISTED}")
    sql["database_filter_all"] = q("customer_databases", _ALLOWED, "SELECT * FROM allowed")
    sql["per_database"] = q("customer_databases listed_databases database_size", _ALLOWED, f"""
SELECT d.* FROM database_size d JOIN allowed a USING (cluster, snapshot_ts, datname) WHERE (d.cluster, d.datname) NOT IN {_LISTED}""")
    sql["table_vacuum"] = q("table_stats", _TAB, f"""
SELECT cluster, snapshot_ts, datname, nspname, relname, CAST({_RATIO} AS DOUBLE) AS dead_tuple_ratio,
 coalesce({half_even(seconds('snapshot_ts', 'last_any'))}, 0) AS seconds_since_last_vacuum,
 coalesce({half_even(seconds('snapshot_ts', 'coalesce(last_autovacuum, last_vacuum)'))}, 0) AS seconds_since_last_autovacuum,
 vacuum_count, autovacuum_count, last_any IS NULL AS never_vacuumed FROM tab""")
    sql["db_vacuum"] = q("table_stats", _TAB, f"""
SELECT cluster, snapshot_ts, datname, coalesce({half_even('max(' + seconds('snapshot_ts', 'last_any') + ')')}, 0) AS max_seconds_since_last_vacuum,
 round(avg(CAST({_RATIO} AS DOUBLE)), 9) AS avg_dead_tuple_ratio, max(CAST({_RATIO} AS DOUBLE)) AS max_dead_tuple_ratio FROM tab GROUP BY 1, 2, 3""")
    sql["table_bloat"] = q("bloat_diag", _BLOAT, "SELECT * FROM bloat")
    sql["table_skew_top"] = q("skew_coefficients", _SKEW_TOP, "SELECT * FROM skew")
    sql["table_health"] = q("bloat_diag skew_coefficients", f"{_BLOAT}, {_SKEW_TOP}", """
SELECT cluster, snapshot_ts, datname, nspname, relname, CAST(coalesce(bloat_state, 0) AS DOUBLE) AS bloat_state, coalesce(skew_factor, 0) AS skew_factor
FROM bloat FULL JOIN skew USING (cluster, snapshot_ts, datname, nspname, relname)""")
    sql["disk_per_host"] = q("disk_usage", _DISK, "SELECT * FROM disk")
    sql["disk_skew"] = q("disk_usage", _DISK, f"SELECT cluster, snapshot_ts, {skew_columns(_DISK_MEASURES)} FROM disk GROUP BY 1, 2")
    sql["host_skew"] = q("disk_usage", _DISK, f"SELECT cluster, snapshot_ts, {skew_columns(_DISK_MEASURES, truncate=False)} FROM disk GROUP BY 1, 2")
    sql["spill_per_host"] = q("workfile_usage segment_config", _SPILL, "SELECT * FROM spill")
    sql["spill_skew"] = q("workfile_usage segment_config", _SPILL, f"SELECT cluster, snapshot_ts, {skew_columns({'spill_usage': 'spill_bytes'})} FROM spill GROUP BY 1, 2")
    bad = "CASE WHEN s_suppkey % 11 <> 0 THEN {} END"
    sql["disk_usage_parse"] = "SELECT concat('c', s_suppkey % 3) AS cluster, " + ", ".join(f"{bad.format(e)} AS {n}" for n, e in (
        ("segment", "CAST(s_suppkey AS INTEGER)"), ("hostname", "concat('h', s_nationkey % 6)"), ("filesystem", "concat('/dev/sd', s_suppkey % 4)"),
        ("total_kb", "CAST(1000000 AS BIGINT)"), ("used_kb", "CAST(floor(abs(s_acctbal)) AS BIGINT) * 50"),
        ("avail_kb", "1000000 - CAST(floor(abs(s_acctbal)) AS BIGINT) * 50"), ("percent", "CAST(floor(abs(s_acctbal) * 50 / 10000) AS INTEGER)"))) + " FROM supplier"
    rsg_tables = "resgroup_status resgroup resgroup_host resgroup_config segment_config"
    sql["rsg_per_host"] = q(rsg_tables, _RSG, """
SELECT cluster, snapshot_ts, rsgname, hostname, memory_usage, cpu_usage, CASE WHEN cpu_rate_limit > 0 THEN CAST(cpu_rate_limit AS VARCHAR) ELSE 'unlimited' END AS "limit" FROM rsg""")
    sql["rsg_per_group"] = q(rsg_tables, _RSG, "SELECT cluster, snapshot_ts, rsgname, num_running, num_queueing, memory_limit, cpu_rate_limit FROM rsg_group")
    sql["rsg_effective_mem_limit"] = q(rsg_tables, _RSG, """
SELECT cluster, snapshot_ts, rsgname, memory_limit, CAST(CASE WHEN memory_limit > 0 THEN memory_limit WHEN 100 - total > 0 THEN 100 - total ELSE 1 END AS BIGINT) AS effective_mem_limit
FROM (SELECT *, sum(memory_limit) OVER (PARTITION BY cluster, snapshot_ts) AS total FROM rsg_group)""")
    sql["rsg_skew"] = q(rsg_tables, _RSG + """,
per_host AS (SELECT cluster, snapshot_ts, hostname, CAST(sum(memory_usage) AS DOUBLE) AS mem, CAST(sum(cpu_usage) AS DOUBLE) AS cpu FROM rsg GROUP BY 1, 2, 3)""",
        f"SELECT cluster, snapshot_ts, {skew_columns({'mem_usage': 'mem', 'cpu_usage': 'cpu'})} FROM per_host GROUP BY 1, 2")
    sql["backup_history"] = q("backups_raw", _BACKUPS, "SELECT * FROM hist")
    sql["backup_metrics"] = q("backups_raw", _BACKUPS, "SELECT * FROM bm")
    labels = "concat('application_name=', application_name, ',content=', content, ',host=', host, ',scope=', scope) AS labels"
    sql["to_samples"] = q("stat_replication segment_config", _SHIP, " UNION ALL ".join(
        f"SELECT cluster, snapshot_ts AS ts, 'fleet_cluster_{m}' AS metric, {labels}, CAST({c} AS DOUBLE) AS value FROM lag" for m, c in (
            ("replication_lag_bytes", "replay_lag_bytes"), ("replication_state", "state_value"), ("replication_sync_state", "sync_state_value"),
            ("replication_write_lag_bytes", "write_lag_bytes"), ("replication_flush_lag_bytes", "flush_lag_bytes"))))
    sql["backup_samples"] = q("backups_raw", _BACKUPS, """
SELECT cluster, snapshot_ts AS ts, concat('fleet_gpbackup_', metric) AS metric,
 concat_ws(',', concat('database=', database), CASE WHEN incremental IS NOT NULL THEN concat('incremental=', incremental) END,
           CASE WHEN status IS NOT NULL THEN concat('status=', status) END, CASE WHEN type IS NOT NULL THEN concat('type=', type) END) AS labels, value FROM bm""")
    # The label value is a, quote, b, backslash, the metric name and a line feed; each is escaped.
    sql["exposition_lines"] = q("flat_samples", "", r"""
SELECT concat(metric, '{cluster="', cluster, '",database="', label_database, '",note="a\"b\\', metric, '\n",table="', label_table, '"} ',
              CASE WHEN isnan(value) THEN 'NaN' ELSE CAST(value AS VARCHAR) END) AS value FROM flat_samples""")
    sql["exposition_text"] = q("flat_samples", "", r"""
SELECT concat(metric, '{cluster="', cluster, '",database="', label_database, '",table="', label_table, '"} ',
              CASE WHEN isnan(value) THEN 'NaN' ELSE CAST(value AS VARCHAR) END) AS value FROM flat_samples
UNION ALL SELECT h.value FROM (VALUES ('m_view', '# HELP m_view Pages\\seen'), ('m_view', '# TYPE m_view gauge'), ('m_click', '# TYPE m_click counter'),
  ('m_absent', '# TYPE m_absent gauge')) h(metric, value) WHERE h.metric IN (SELECT metric FROM flat_samples)""")
    sql["external_label"] = q("flat_samples", "", "SELECT 'main' AS cluster, ts, metric, concat('database=', label_database, ',region=eu,table=', label_table) AS labels, value FROM flat_samples")
    sql["series_store_select"] = q("flat_samples", _INSTANT, """
SELECT * FROM inst WHERE metric IN ('m_view', 'm_click') AND cluster IN ('c0', 'c2') AND label_database IN ('db0', 'db1', 'db2') AND label_table LIKE 't1%'""")
    sql["series_store_label_values"] = q("flat_samples", "", """
SELECT DISTINCT label_table AS label_value FROM flat_samples
WHERE metric = 'm_view' AND cluster IN ('c1', 'c2') AND label_database IN ('db0', 'db1', 'db2', 'db3')""")
    sql["instant_select"] = q("flat_samples", _INSTANT, "SELECT * FROM inst")
    sql["range_select"] = q("flat_samples", _RANGE, "SELECT * FROM rng")
    sql["topk_series"] = q("flat_samples", _RANGE, f"""
SELECT {_FLAT}, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY CASE WHEN isnan(value) THEN CAST('-inf' AS DOUBLE) ELSE value END DESC,
  isnan(value), cluster, metric, label_database, label_table) AS rank FROM rng) WHERE rank <= 5""")
    sql["sum_by_label"] = q("flat_samples", _RANGE, "SELECT ts, label_database AS database, cluster, round(sum(value), 6) AS value FROM rng GROUP BY 1, 2, 3")
    sql["avg_series"] = q("flat_samples", _RANGE, "SELECT ts, round(avg(value), 6) AS value FROM rng GROUP BY 1")
    sql["min_series"] = q("flat_samples", _RANGE, "SELECT ts, coalesce(min(value) FILTER (WHERE NOT isnan(value)), CAST('NaN' AS DOUBLE)) AS value FROM rng GROUP BY 1")
    sql["connection_usage_pct"] = q("flat_samples", "", """
SELECT cluster, ts, CASE WHEN lim = 0 THEN CAST('inf' AS DOUBLE) ELSE conn / lim * 100 END AS value FROM (
 SELECT cluster, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS conn, CAST(count(*) FILTER (WHERE metric = 'm_view') AS DOUBLE) AS lim
 FROM flat_samples GROUP BY 1, 2)""")
    sql["compare_filter"] = q("flat_samples", "", "SELECT * FROM flat_samples WHERE value > 1.5 AND NOT isnan(value)")
    sql["match_labels"] = q("flat_samples", "", """
SELECT * FROM flat_samples WHERE label_database IN ('db1', 'db3', 'db4') AND length(label_table) = 2 AND cluster IN ('c0', 'c1')""")
    sql["label_values"] = q("flat_samples", "", "SELECT DISTINCT label_table AS label_value FROM flat_samples WHERE metric = 'm_view' AND cluster IN ('c1', 'c2')")
    sql["reduce_series"] = q("flat_samples", "", """
SELECT cluster, metric, label_database, label_table, arg_max(value, ts) FILTER (WHERE NOT isnan(value)) AS "lastNotNull", arg_max(value, ts) AS last,
 max(value) FILTER (WHERE NOT isnan(value)) AS max, round(avg(value) FILTER (WHERE NOT isnan(value)), 6) AS mean,
 min(value) FILTER (WHERE NOT isnan(value)) AS min, round(sum(value) FILTER (WHERE NOT isnan(value)), 6) AS sum
FROM flat_samples GROUP BY 1, 2, 3, 4""")
    sql["threshold_band"] = q("flat_samples", "", f"SELECT {_FLAT}, value, {_bands()} AS band FROM flat_samples")
    sql["value_text"] = q("segment_config", f"codes AS (SELECT *, {_SEGMENT_CODES} FROM segment_config)", f"""
SELECT cluster, dbid, {_text('status_value', {0: 'DOWN', 1: 'UP'})} AS status_text, {_text('role_value', {1: 'Primary', 2: 'Mirror'})} AS role_text,
 {_text('mode_value', {1: 'Synchronized', 2: 'Resyncing', 3: 'Change Tracking', 4: 'Not Syncing'})} AS mode_text FROM codes""")
    sql["organize_columns"] = q("flat_samples", _INSTANT, """
SELECT label_table AS "table", label_database AS database, value AS "Value" FROM (
 SELECT *, row_number() OVER (ORDER BY CASE WHEN isnan(value) THEN CAST('-inf' AS DOUBLE) ELSE value END DESC, isnan(value), cluster, label_database, label_table) AS rank
 FROM inst WHERE metric = 'm_view') WHERE rank <= 20""")
    sql["legend"] = q("flat_samples", "", "SELECT cluster, ts, concat(cluster, ' - ', label_database, '.', label_table, ' (lost=)') AS legend, value FROM flat_samples")
    sql["entity_changes"] = q("entity_days entity_snapshots", _ALL_DAYS, _CHANGES)
    sql["entity_changes_good"] = q("entity_days entity_snapshots", _GOOD_DAYS, _CHANGES)
    sql["absent_policy"] = q("entity_days entity_snapshots", _absent("0"), "")
    sql["absent_policy_nan"] = q("entity_days entity_snapshots", _absent("CAST('NaN' AS DOUBLE)"), "")
    sql["absent_policy_remove"] = q("entity_days", "", "SELECT cluster, snapshot_ts, entity, value FROM entity_days")
    sql["pinned_labels"] = q("entity_days entity_snapshots", _ALL_DAYS, """
SELECT cluster, snapshot_ts, entity, value, arg_min(role, snapshot_ts) OVER (PARTITION BY cluster, entity, life) AS role FROM (
 SELECT e.*, sum(CASE WHEN c.change = 'new' THEN 1 ELSE 0 END) OVER (PARTITION BY e.cluster, e.entity ORDER BY e.snapshot_ts) AS life
 FROM entity_days e JOIN spine s USING (cluster, snapshot_ts) JOIN changes c ON c.cluster = e.cluster AND c.entity = e.entity AND c.idx = s.idx)""")
    sql["collect_history"] = q("entity_days entity_snapshots", _ALL_DAYS, """
SELECT cluster, snapshot_ts AS ts, 'fleet_entity_value' AS metric, entity,
       last_value(CASE WHEN present AND NOT coalesce(before, FALSE) THEN role END IGNORE NULLS)
         OVER (PARTITION BY cluster, entity ORDER BY idx ROWS UNBOUNDED PRECEDING) AS role,
       CASE WHEN present THEN value ELSE CAST('NaN' AS DOUBLE) END AS value
FROM (
 SELECT f.cluster, f.entity, s.idx, s.snapshot_ts, e.entity IS NOT NULL AS present, e.role, e.value,
        lag(e.entity IS NOT NULL) OVER (PARTITION BY f.cluster, f.entity ORDER BY s.idx) AS before
 FROM (SELECT cluster, entity, min(idx) AS first_idx FROM here GROUP BY 1, 2) f
 JOIN spine s ON s.cluster = f.cluster AND s.idx >= f.first_idx
 LEFT JOIN entity_days e ON e.cluster = s.cluster AND e.snapshot_ts = s.snapshot_ts AND e.entity = f.entity)""")
    sql["entity_lives"] = q("entity_days entity_snapshots", _LIVES, "SELECT cluster, entity, role, from_ts, until_ts, gone_ts FROM lives")
    sql["life_log"] = sql["entity_lives"]
    sql["life_changes"] = q("entity_days entity_snapshots", _LIVES, """
SELECT l.cluster, s.snapshot_ts, l.entity, l.role,
       CASE WHEN s.idx = l.low THEN 'new' WHEN s.idx = l.gone THEN 'deleted' ELSE 'kept' END AS change
FROM lives l JOIN spine s ON s.cluster = l.cluster AND s.idx >= l.low AND (l.gone IS NULL OR s.idx <= l.gone)""")
    day_spine = _SPINE.format(snapshots="(SELECT DISTINCT cluster, snapshot_ts FROM entity_days)", entities="entity_days")
    sql["absence_spans"] = q("entity_days", day_spine, """
SELECT d.cluster, d.entity, d.idx AS from_idx,
       coalesce((SELECT min(n.idx) - 1 FROM here n WHERE n.cluster = d.cluster AND n.entity = d.entity AND n.idx > d.idx),
                (SELECT max(s.idx) FROM spine s WHERE s.cluster = d.cluster)) AS until_idx
FROM changes d WHERE d.change = 'deleted'""")
    sql["absent_policy_range"] = (
        f"SELECT * FROM ({q('entity_days entity_snapshots', _absent('0.0'), '').strip()}) "
        "WHERE snapshot_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"
    )
    sql["pinned_labels_kept"] = q("entity_days", "", """
SELECT cluster, snapshot_ts, entity, value, arg_min(role, snapshot_ts) OVER (PARTITION BY cluster, entity) AS role FROM entity_days""")
    sql["validate_entities"] = q("flat_samples", "", """
SELECT cluster, ts AS snapshot_ts, CASE WHEN metric <> 'm_error' THEN label_table END AS entity, CASE WHEN metric = 'm_error' THEN 'null key' ELSE 'null value' END AS problem
FROM flat_samples WHERE metric IN ('m_error', 'm_view')""")
    sql["carry_forward"] = q("entity_days entity_snapshots", "", """
SELECT g.cluster, g.snapshot_ts, g.source_ts, e.entity, e.role, e.value FROM (
 SELECT s.cluster, s.snapshot_ts, max(p.snapshot_ts) AS source_ts FROM entity_snapshots s
 JOIN entity_snapshots p ON p.cluster = s.cluster AND p.snapshot_ts <= s.snapshot_ts AND p.ok GROUP BY 1, 2) g
JOIN entity_days e ON e.cluster = g.cluster AND e.snapshot_ts = g.source_ts""")
    sql["entities_at"] = sql["carry_forward"]
    sql["good_intervals"] = q("entity_snapshots", "", """
SELECT cluster, source_ts, max(snapshot_ts) AS until_ts FROM (
 SELECT s.cluster, s.snapshot_ts, max(p.snapshot_ts) AS source_ts FROM entity_snapshots s
 JOIN entity_snapshots p ON p.cluster = s.cluster AND p.snapshot_ts <= s.snapshot_ts AND p.ok GROUP BY 1, 2) GROUP BY 1, 2""")
    # Absences written out as a row for every snapshot, then the latest row at each step.
    sql["range_with_absences"] = f"""
WITH filled AS ({sql['absent_policy_nan']}), steps AS (
 SELECT unnest(generate_series(TIMESTAMP '{MONTH_START}', TIMESTAMP '{MONTH_END}', INTERVAL '{RANGE_STEP}' SECOND)) AS step_at)
SELECT cluster, step_at AS ts, entity, value FROM (
 SELECT f.cluster, f.entity, f.value, s.step_at, row_number() OVER (PARTITION BY f.cluster, f.entity, s.step_at ORDER BY f.snapshot_ts DESC) AS rn
 FROM filled f JOIN steps s ON f.snapshot_ts <= s.step_at AND f.snapshot_ts > s.step_at - INTERVAL '{RANGE_LOOKBACK}' SECOND) WHERE rn = 1"""
    age = seconds("request_ts", "scrape_ts")
    sql["scrape_staleness"] = q("scrape_requests scrape_log", """latest AS (
 SELECT r.cluster, r.request_id, r.request_ts, s.start_ts AS scrape_ts FROM scrape_requests r
 ASOF LEFT JOIN (SELECT DISTINCT cluster, start_ts FROM scrape_log WHERE successful) s ON s.cluster = r.cluster AND s.start_ts <= r.request_ts)""", f"""
SELECT *, {age} AS age_seconds, coalesce({age} > 5400, TRUE) AS stale FROM latest""")
    sql["collector_run_stats"] = q("collector_run_log", "", """
SELECT cluster, collector, CAST(duration_ms AS DOUBLE) AS last_duration_ms, errors FROM (
 SELECT *, row_number() OVER (PARTITION BY cluster, collector ORDER BY start_ts DESC, scrape_id DESC, seq DESC) AS rn,
        count(*) FILTER (WHERE failed) OVER (PARTITION BY cluster, collector) AS errors FROM collector_run_log) WHERE rn = 1""")
    sql["scrape_summary"] = q("scrape_log collector_run_log", "", f"""
SELECT s.cluster, count(*) AS scrapes,
 count(*) FILTER (WHERE NOT successful) + (SELECT count(*) FROM collector_run_log c WHERE c.cluster = s.cluster AND failed) AS errors,
 count(*) AS duration_count, round(sum(duration_s), 6) AS duration_sum, max(duration_s) AS duration_max,
 CAST(floor({seconds('max(start_ts)', 'min(start_ts)')}) AS BIGINT) AS uptime_seconds FROM scrape_log s GROUP BY s.cluster""")
    order = "OVER (PARTITION BY cluster ORDER BY start_ts, scrape_id)"
    sql["run_counters"] = q("scrape_log", "", f"""
SELECT cluster, scrape_id, start_ts, count(*) {order} AS scraped_total, count(*) FILTER (WHERE NOT successful) {order} AS failed_total FROM scrape_log""")
    sql["failfast_cutoff"] = q("collector_run_log", "", """
SELECT cluster, scrape_id, seq, collector, failed, count(*) FILTER (WHERE failed) OVER (
  PARTITION BY cluster, scrape_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 3 AS executed FROM collector_run_log""")
    sql["collector_selection"] = q("customer_databases listed_databases event_snapshots", _ALLOWED, f"""
SELECT cluster, CAST(NULL AS VARCHAR) AS datname, 'general' AS run_group, unnest({_GENERAL!r}) AS collector FROM (SELECT DISTINCT cluster FROM event_snapshots)
UNION ALL
SELECT cluster, datname, 'per_db', unnest({_PER_DB!r}) FROM allowed WHERE (cluster, datname) IN {_LISTED}""")
    sql["collector_selection_none"] = q("event_snapshots", "", f"""
SELECT cluster, CAST(NULL AS VARCHAR) AS datname, 'general' AS run_group, unnest({_GENERAL + _PER_DB!r}) AS collector
FROM (SELECT DISTINCT cluster FROM event_snapshots)""")
    last = "(SELECT max(start_ts) FROM scrape_log l WHERE l.cluster = x.cluster)"
    run_log = ["SELECT cluster, start_ts AS ts, 'fleet_up' AS metric, '' AS labels, up AS value FROM (SELECT * FROM up_rows)"]
    run_log += [
        f"SELECT cluster, {last} AS ts, 'fleet_exporter_{m}' AS metric, concat('collector=', collector) AS labels, CAST({c} AS DOUBLE) AS value FROM stats_rows x"
        for m, c in (("collector_error_total", "errors"), ("collector_duration_seconds", "last_duration_ms"))
    ]
    run_log += [
        f"SELECT cluster, {last} AS ts, 'fleet_exporter_{m}' AS metric, '' AS labels, round(CAST({c} AS DOUBLE), 6) AS value FROM summary_rows x"
        for m, c in (
            ("total_scraped_total", "scrapes"), ("total_error_total", "errors"), ("scrape_duration_seconds_count", "duration_count"),
            ("scrape_duration_seconds_sum", "duration_sum"), ("scrape_duration_seconds_max", "duration_max"), ("uptime_seconds", "uptime_seconds"))
    ]
    sql["run_log_samples"] = q("scrape_log collector_run_log", ", ".join(
        f"{name} AS ({sql[key]})" for name, key in (("up_rows", "cluster_up"), ("stats_rows", "collector_run_stats"), ("summary_rows", "scrape_summary"))),
        " UNION ALL ".join(run_log))
    sql["collect_snapshot"] = _whole_run(sql)
    sql.update({f"panel_{p.key}": panel_sql(sql, p) for p in panels.PANELS})
    sql.update({f"legend_{key}": legend_sql(sql, panels.panel(key)) for key in PANEL_CALCS})
    del sql["cluster_state_hourly"]
    return sql


def _whole_run(sql: dict[str, str]) -> str:
    """All collectors over all snapshots; those that report totals also report 0 for listed snapshots without any row."""
    everywhere = {
        **sql,
        "segment_health": _q("segment_config_all", "", f"SELECT *, {_SEGMENT_CODES} FROM segment_config_all"),
        "segment_counts": _q("segment_config_all", "", """
SELECT cluster, snapshot_ts, count(*) AS total, count(*) FILTER (WHERE lower(status) = 'u') AS up, count(*) FILTER (WHERE lower(status) = 'd') AS down
FROM segment_config_all GROUP BY 1, 2"""),
    }
    spill = _SPILL.replace("segment_config", "segment_config_all")
    everywhere["spill_per_host"] = _q("workfile_usage segment_config_all", spill, "SELECT * FROM spill")
    everywhere["spill_skew"] = _q(
        "workfile_usage segment_config_all", spill,
        f"SELECT cluster, snapshot_ts, {skew_columns({'spill_usage': 'spill_bytes'})} FROM spill GROUP BY cluster, snapshot_ts",
    )
    parts = []
    for spec in registry.COLLECTORS:
        source = f"({everywhere[spec.name]})"
        for m in spec.metrics:
            own = f"SELECT cluster, snapshot_ts AS ts, '{m.full_name('fleet')}' AS metric"
            if spec.to_samples is not None:
                parts.append(f"{own}, CAST(value AS DOUBLE) AS value FROM {source} WHERE metric = '{m.name}'")
                continue
            value = "CASE WHEN accessible THEN 1 ELSE 0 END" if m.value == "accessible" else f'"{m.value}"'
            parts.append(f"{own}, CAST({value} AS DOUBLE) AS value FROM {source}")
            if spec.spine:
                each = f"unnest(range({len(_BUCKETS)}))" if spec.name == "active_query_buckets" else "0"
                parts.append(
                    f"SELECT cluster, ts, metric, 0 AS value FROM ({own}, {each} AS k FROM run_snapshots r WHERE NOT EXISTS "
                    f"(SELECT 1 FROM {source} x WHERE x.cluster = r.cluster AND x.snapshot_ts = r.snapshot_ts))"
                )
    return with_clause("run_snapshots") + f"""
SELECT cluster, ts, metric, count(*) AS samples, round(sum(value), 4) AS total FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3"""


def _metric_sql(sql: dict[str, str], metric: str) -> tuple[str, dict[str, str]]:
    """Source of a metric (cluster, ts, one column per label, value) and its labels."""
    if metric == "up":
        return f"SELECT cluster, start_ts AS ts, up AS value FROM ({sql['cluster_up']})", {}
    spec, m = next((s, m) for s in registry.COLLECTORS for m in s.metrics if m.full_name("") == metric)
    # Panels read session-based inputs where they exist; the full set of snapshots includes those with no sessions.
    source = sql["cluster_state_hourly" if spec.name == "cluster_state" else spec.name]
    labels = {name: f'CAST("{column}" AS VARCHAR)' for name, column in m.labels}
    columns = "".join(f', coalesce({e}, \'unknown\') AS "{n}"' for n, e in labels.items())
    value = "CASE WHEN accessible THEN 1 ELSE 0 END" if m.value == "accessible" else f'"{m.value}"'
    return f"SELECT cluster, snapshot_ts AS ts{columns}, CAST({value} AS DOUBLE) AS value FROM ({source})", labels


def _selected(sql: dict[str, str], metric: str, t: panels.Target, w: panels.Window, instant: bool) -> tuple[str, list[str]]:
    source, labels = _metric_sql(sql, metric)
    tests = [f"regexp_full_match(\"{name}\", '{PANEL_VARIABLES[variable]}')" for name, variable in t.filters]
    where = f"WHERE {' AND '.join(tests)}" if tests else ""
    steps = f"SELECT TIMESTAMP '{w.end}' AS step_at" if instant else (
        f"SELECT unnest(generate_series(TIMESTAMP '{w.start}', TIMESTAMP '{w.end}', INTERVAL '{w.step_seconds}' SECOND)) AS step_at")
    names = ["cluster", *labels]
    key = ", ".join(f'"{n}"' for n in names)
    return f"""SELECT {key}, step_at AS ts, value FROM (
 SELECT m.*, s.step_at, row_number() OVER (PARTITION BY {key}, s.step_at ORDER BY m.ts DESC, value DESC) AS rn
 FROM (SELECT * FROM ({source}) {where}) m JOIN ({steps}) s ON m.ts <= s.step_at AND m.ts > s.step_at - INTERVAL '{w.lookback_seconds}' SECOND) WHERE rn = 1""", names


# Written by hand from the dashboards, apart from the recipes: colour steps, mapped numbers, figures of a legend.
GREEN = "'green'"
_STEPS = {
    "red below 1": "CASE WHEN v >= 1 THEN 'green' ELSE 'red' END",
    "usage": "CASE WHEN v >= 95 THEN 'red' WHEN v >= 85 THEN 'orange' WHEN v >= 70 THEN 'yellow' ELSE 'green' END",
    "red from 1": "CASE WHEN v >= 1 THEN 'red' ELSE 'green' END",
    "1 5": "CASE WHEN v >= 5 THEN 'red' WHEN v >= 1 THEN 'yellow' ELSE 'green' END",
    "5 10": "CASE WHEN v >= 10 THEN 'red' WHEN v >= 5 THEN 'yellow' ELSE 'green' END",
    "1M 10M": "CASE WHEN v >= 10485760 THEN 'red' WHEN v >= 1048576 THEN 'yellow' ELSE 'green' END",
    "512K 5M": "CASE WHEN v >= 5242880 THEN 'red' WHEN v >= 524288 THEN 'yellow' ELSE 'green' END",
    "day week": "CASE WHEN v >= 604800 THEN 'red' WHEN v >= 86400 THEN 'yellow' ELSE 'green' END",
    "0.1 0.3": "CASE WHEN v >= 0.3 THEN 'red' WHEN v >= 0.1 THEN 'yellow' ELSE 'green' END",
    "0.05 0.2": "CASE WHEN v >= 0.2 THEN 'red' WHEN v >= 0.05 THEN 'yellow' ELSE 'green' END",
    "1.5 2": "CASE WHEN v >= 2 THEN 'red' WHEN v >= 1.5 THEN 'yellow' ELSE 'green' END",
    "1 2": "CASE WHEN v >= 2 THEN 'red' WHEN v >= 1 THEN 'yellow' ELSE 'green' END",
    "yellow from 1": "CASE WHEN v >= 1 THEN 'yellow' ELSE 'green' END",
    "2 3 4": "CASE WHEN v >= 4 THEN 'red' WHEN v >= 3 THEN 'orange' WHEN v >= 2 THEN 'yellow' ELSE 'green' END",
}
PANEL_STEPS = {
    "overview_cluster_status": "red below 1", "overview_connection_usage": "usage", "overview_locked_sessions": "1 5",
    "overview_segments_down": "red from 1", "overview_query_activity": "5 10", "overview_replication_lag": "1M 10M",
    "overview_max_replication_lag": "1M 10M", "dbhealth_vacuum_running": "yellow from 1", "dbhealth_max_vacuum_age": "day week",
    "dbhealth_max_dead_ratio": "0.1 0.3", "dbhealth_avg_dead_ratio": "0.05 0.2", "dbhealth_oldest_vacuums": "day week",
    "dbhealth_bloat_state": "1 2", "dbhealth_top_skew": "1.5 2", "dbhealth_bloated_tables": "1 2", "dbhealth_skewed_tables": "1.5 2",
    "replication_segments_down": "red from 1", "replication_sync_replicas": "red below 1", "replication_segment_mode": "2 3 4",
    "replication_max_lag_now": "1M 10M", "replication_avg_lag": "512K 5M", "replication_lag_details": "1M 10M",
}
_STATUS = "(0, 'DOWN', 'red'), (1, 'UP', 'green')"
_BLOATED = "(0, 'No Bloat', 'green'), (1, 'Moderate', 'yellow'), (2, 'Severe', 'red')"
_SYNCED = "(0, 'Unknown', 'red'), (0.5, 'Potential', 'yellow'), (1, 'Async', 'orange'), (2, 'Sync', 'green')"
PANEL_TEXTS = {
    "overview_cluster_status": _STATUS, "replication_segment_status": _STATUS, "replication_segment_table": _STATUS,
    "dbhealth_vacuum_running": "(0, 'Not Running', 'green'), (1, 'Running', 'yellow')",
    "dbhealth_bloat_state": _BLOATED, "dbhealth_bloated_tables": _BLOATED,
    "replication_sync_replicas": "(0, 'No Sync', 'red'), (1, 'Synced', 'green')",
    "replication_segment_role": "(1, 'Primary', 'green'), (2, 'Mirror', 'blue')",
    "replication_segment_mode": "(1, 'Synchronized', 'green'), (2, 'Resyncing', 'yellow'), (3, 'Change Tracking', 'orange'), (4, 'Not Syncing', 'red')",
    "replication_min_sync_state": _SYNCED, "replication_sync_state": _SYNCED,
    "replication_state": "(0, 'Unknown', 'red'), (1, 'Streaming', 'green'), (2, 'Catchup', 'yellow'), (3, 'Backup', 'blue')",
}
PANEL_CALCS = {
    "overview_segment_status": "last max", "overview_connections_by_state": "last max", "overview_query_activity": "last max",
    "overview_query_duration": "last", "overview_replication_lag": "last max", "dbhealth_vacuum_counts": "last sum",
    "dbhealth_top_dead_ratio": "last max", "dbhealth_bloat_state": "last", "dbhealth_top_skew": "last max",
    "replication_segment_status": "last", "replication_segment_role": "last", "replication_segment_mode": "last",
    "replication_lag_details": "last max mean", "replication_state": "last", "replication_sync_state": "last",
}


def _chain(value: str, p: panels.Panel) -> str:
    step = PANEL_STEPS.get(p.key)
    number = f"CASE WHEN NOT isnan({value}) THEN {value} END"
    band = _STEPS[step].replace("v >=", f"({number}) >=") if step else GREEN
    mapped = PANEL_TEXTS.get(p.key)
    if not mapped:
        return f"{band} AS band"
    rows = re.findall(r"\(([0-9.]+), '([^']*)', '([^']*)'\)", mapped)
    colours = " ".join(f"WHEN {value} = {n} THEN '{colour}'" for n, _, colour in rows)
    return f"CASE {colours} ELSE {band} END AS band, {_text(value, {float(n): text for n, text, _ in rows})} AS text"


def legend_sql(sql: dict[str, str], p: panels.Panel) -> str:
    """Figures of each line: the last value by time, and folds over the values that are numbers."""
    folds = {
        "last": "arg_max(value, ts) AS last", "max": "max(value) FILTER (NOT isnan(value)) AS max",
        "sum": "round(sum(value) FILTER (NOT isnan(value)), 6) AS sum", "mean": "round(avg(value) FILTER (NOT isnan(value)), 6) AS mean",
    }
    chosen = ", ".join(folds[c] for c in PANEL_CALCS[p.key].split())
    return f"SELECT cluster, legend, {chosen} FROM ({panel_sql(sql, p)}) GROUP BY cluster, legend"


def panel_sql(sql: dict[str, str], p: panels.Panel) -> str:
    w, instant = panel_window(p), p.kind == "table"
    parts = []
    names: list[str] = []
    for t in p.targets:
        body, names = _selected(sql, t.metric, t, w, instant)
        if t.per:
            other, _ = _selected(sql, t.per, t, w, instant)
            body = f"SELECT a.cluster, a.ts, a.value / b.value * 100 AS value FROM ({body}) a JOIN ({other}) b USING (cluster, ts)"
        if t.above is not None:
            body = f"SELECT * FROM ({body}) WHERE value > {t.above} AND NOT isnan(value)"
        if t.sum_by:
            names = list(t.sum_by)
            body = f"SELECT '' AS cluster, ts, {', '.join(names)}, round(sum(value), 6) AS value FROM ({body}) GROUP BY ALL"
        if t.aggregate:
            names = ["cluster"]
            body = f"SELECT '' AS cluster, ts, {t.aggregate}(value) AS value FROM ({body}) GROUP BY ALL"
        if t.top:
            # Ties go by labels in name order.
            ties = ", ".join(f'"{n}"' for n in ["cluster", *sorted(n for n in names if n != "cluster")])
            body = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY value DESC, {ties}) AS rank FROM ({body})) WHERE rank <= 10"
        if p.kind == "timeseries":
            pieces = [f'"{x[2:-2]}"' if x.startswith("{{") else f"'{x}'" for x in re.split(r"(\{\{\w+\}\})", t.legend) if x]
            body = f"SELECT cluster, ts, concat({', '.join(pieces)}) AS legend, value FROM ({body})"
        parts.append(body)
    if p.kind == "timeseries":
        return f"SELECT *, {_chain('value', p)} FROM ({' UNION ALL '.join(parts)})"
    if p.kind == "table":
        columns = ", ".join('value AS "Value"' if c == "Value" else f'"{c}"' for c in p.columns)
        return f"SELECT *, {_chain('\"Value\"', p)} FROM (SELECT {columns} FROM ({parts[0]}))"
    fold = {"lastNotNull": "arg_max(value, ts)", "mean": "round(avg(value), 6)", "min": "min(value)"}[p.reducer]
    labels = [n for n in names if n != "cluster"] if not p.targets[0].aggregate else []
    text = f"concat_ws(',', {', '.join(f'concat(\'{n}=\', \"{n}\")' for n in sorted(labels))})" if labels else "''"
    return f"SELECT *, {_chain('value', p)} FROM (SELECT cluster, {text} AS labels, {fold} AS value FROM ({parts[0]}) WHERE NOT isnan(value) GROUP BY cluster, {text})"
