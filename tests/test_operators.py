"""Hand-made inputs for the cases that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.ordered import day_chunk, fill_forward, running_sum, snapshot_spine
from fleetlens.functions.skew import host_skew
from fleetlens.operators import backups, cluster, databases, hosts, lifecycle, locks, resgroups, runlog, series, sessions, tablehealth, vacuum

T0 = dt.datetime(2024, 1, 1)
SCOPED = "cluster string, snapshot_ts timestamp, "


def at(seconds=0, days=0):
    return T0 + dt.timedelta(days=days, seconds=seconds)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def scoped(spark, ddl, *data, ts=T0):
    return spark.createDataFrame([("c", ts, *d) for d in data], SCOPED + ddl)


ACTIVITY = "major int, own_backend boolean, pid bigint, sess_id bigint, state string, application_name string, backend_type string, " \
           "wait_event_type string, waiting boolean, query string, query_start timestamp, xact_start timestamp, datname string, usename string"


def session(pid, state="active", age=1, app="app", sess=1, major=6, own=False, backend="client backend", event=None, waiting=False, query="select"):
    started = None if age is None else at(-age)
    return (major, own, pid, sess, state, app, backend, event, waiting, query, started, started, "db", "u")


def test_bucket_edges_and_three_valued_filters(spark):
    ages = [0, 9.999999, 10, 59, 60, 179, 180, 599, 600, 5000, -1, None]
    data = [session(i, age=a) for i, a in enumerate(ages)]
    data += [session(90, app=None), session(91, app="autovacuum"), session(92, own=True), session(93, state="idle"), session(94, state=None)]
    t = {"activity": scoped(spark, ACTIVITY, *data)}
    got = {r[2]: r[3] for r in rows(sessions.active_query_buckets(t))}
    assert got == {"0_10": 2, "10_60": 2, "60_180": 2, "180_600": 2, "600_plus": 2}
    assert rows(sessions.active_query_totals(t))[0][2:] == (10, 4)


def test_snapshots_without_rows_report_zero(spark):
    spine = spark.createDataFrame([("c", T0), ("c", at(days=1)), ("d", T0)], "cluster string, snapshot_ts timestamp")
    t = {"activity": scoped(spark, ACTIVITY, session(1, query="VACUUM x"))}
    assert [r[2] for r in rows(sessions.connections_total(t, spine), "cluster", "snapshot_ts")] == [1, 0, 0]
    assert [r[2] for r in rows(sessions.vacuum_running_flag(t, spine), "cluster", "snapshot_ts")] == [1.0, 0.0, 0.0]
    assert sessions.active_query_buckets(t, spine).count() == 15


def test_states_by_version(spark):
    t = {"activity": scoped(
        spark, ACTIVITY, session(1, state=None, backend="walsender"), session(2, major=7, backend="walsender"),
        session(3, major=7), session(4, major=7, backend=None),
    )}
    assert rows(sessions.connections_by_state(t).drop("cluster", "snapshot_ts"), "state") == [("active", 1), ("unknown", 1)]


def test_vacuum_text(spark):
    t = {"activity": scoped(
        spark, ACTIVITY, session(1, query="vAcuum t", age=2.5), session(2, query="AUTOVACUUM: x"), session(3, query="autovacuum x"),
        session(4, query="vacuum", state="idle"), session(5, query="vacuum", state=None), session(6, query=" vacuum"),
        session(7, query="vacuum", age=None),
    )}
    assert rows(sessions.vacuum_running(t).select("pid", "seconds_running"), "pid") == [(1, 2), (2, 1), (7, 0)]


LOCKS = "pid bigint, locktype string, mode string, database bigint, granted boolean, gp_segment_id int, mppsessionid bigint"


def test_locked_sessions_versions_and_key_collision(spark):
    t = {
        "activity": scoped(
            spark, ACTIVITY, session(1, waiting=True), session(2, waiting=False), session(3, major=7, event="Lock"),
            session(4, major=7, event="IO"), session(5, waiting=True),
        ),
        "locks": scoped(
            spark, LOCKS, (1, "relation", "m", 1, False, 0, 1), (1, "relation", "m", 1, False, 1, 1), (1, "relation", "m", 1, True, 0, 1),
            (2, "relation", "m", 1, False, 0, 1), (3, "relation", "m", 1, True, 0, 1), (4, "tuple", "m", 1, False, 0, 1),
            (5, None, "m", 1, False, 0, 1), (1, "", "m", 1, False, 0, 1), (5, "", "m", 1, False, 0, 1),
        ),
    }
    # NULL and blank share the key 'unknown'; the source reads NULL last.
    assert rows(locks.locked_sessions(t).select("lock_type", "sessions"), "lock_type") == [("relation", 3), ("unknown", 1)]


def test_extended_locks_counts_joined_rows(spark):
    t = {
        "activity": scoped(spark, ACTIVITY, session(1, age=5), session(2, age=90.9), session(3, age=None), session(9, sess=2, age=7)),
        "locks": scoped(
            spark, LOCKS, (1, "relation", "m", 1, False, None, 1), (1, "relation", "m", 1, False, None, 1), (2, None, "m", 99, False, 0, 77),
            (2, "tuple", None, 1, True, 0, 1), (3, "relation", "m", 1, False, None, None),
        ),
        "pg_database": spark.createDataFrame([(1, "one")], "oid bigint, datname string"),
    }
    got = rows(locks.extended_locks(t).drop("cluster", "snapshot_ts").select("database", "lock_type", "mode", "content", "metric", "value"), "database", "metric")
    assert got == [
        ("one", "relation", "m", "unknown", "lock_wait_max_wait_seconds", 90),
        ("one", "relation", "m", "unknown", "lock_waiting_queries", 7),
        ("unknown", "unknown", "m", "0", "lock_wait_max_wait_seconds", 0),
        ("unknown", "unknown", "m", "0", "lock_waiting_queries", 1),
    ]


def test_hot_session_never_fans_out(spark):
    """One session with 3000 waiting locks and 3000 backends: nine million joined rows, counted without making them."""
    n = 3000
    base = spark.range(n).select(F.lit("c").alias("cluster"), F.lit(T0).alias("snapshot_ts"), F.col("id").alias("pid"))
    t = {
        "locks": base.select("*", F.lit("relation").alias("locktype"), F.lit("m").alias("mode"), F.lit(1).alias("database"), F.lit(False).alias("granted"), F.lit(0).alias("gp_segment_id"), F.lit(7).alias("mppsessionid")),
        "activity": base.select("*", F.lit(7).alias("sess_id"), F.lit(T0).alias("query_start")),
        "pg_database": spark.createDataFrame([(1, "one")], "oid bigint, datname string"),
    }
    got = {r.metric: r.value for r in locks.extended_locks(t).collect()}
    assert got == {"lock_waiting_queries": n * n, "lock_wait_max_wait_seconds": 0}


def test_long_absence_is_expanded_in_blocks(spark):
    days = 9000
    spine = spark.range(days).select(F.lit("c").alias("cluster"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id"))).alias("snapshot_ts"))
    e = spark.createDataFrame([("c", T0, "x", 1.0)], SCOPED + "k string, v double")
    shown = lifecycle.absent_policy(e, ["k"], ["v"], "zero", spine)
    assert shown.count() == days and shown.select("snapshot_ts").distinct().count() == days and shown.agg(F.sum("v")).first()[0] == 1.0


def test_cluster_state_defaults(spark):
    facts = spark.createDataFrame(
        [("a", T0, None, at(-10.7), None, 100, 3), ("b", T0, "x", None, at(0.25), None, None)],
        SCOPED + "version_banner string, postmaster_start timestamp, conf_load_time timestamp, max_connections int, reachable_segments int",
    )
    segs = spark.createDataFrame(
        [("a", -1, "p", "h1"), ("a", -1, "p", "h2"), ("b", -1, "p", "h1"), ("b", 0, "m", "h9")], "cluster string, content int, role string, hostname string"
    )
    repl = spark.createDataFrame(
        [("b", -1, "streaming"), ("b", -1, "catchup"), ("b", 0, "streaming")], "cluster string, content int, state string"
    )
    a, b = cluster.cluster_state({"cluster_facts": facts, "segment_config": segs, "stat_replication": repl}).orderBy("cluster").collect()
    # Two coordinators of one role are an error of the source query: everything but accessibility and version falls back.
    assert tuple(a)[2:] == (True, "unknown", "unknown", "", 0, 0.0, 0.0, 0)
    assert tuple(b)[2:] == (False, "unknown", "h1", "", 0, 1.0, T0.replace(tzinfo=dt.timezone.utc).timestamp() + 0.25, 0)


def test_host_skew(spark):
    df = scoped(spark, "hostname string, v double", ("a", 5.0), ("a", 5.0), ("b", 3.0), ("c", 0.16))
    spine = spark.createDataFrame([("c", T0), ("c", at(1))], "cluster string, snapshot_ts timestamp")
    assert [r[2:] for r in rows(host_skew(df, {"v": "v"}, snapshots=spine), "snapshot_ts")] == [(10.0, 4.4, 2.0), (0.0, 0.0, 0.0)]
    assert rows(host_skew(df, {"v": "v"}, truncate=False))[0][4] == 2.3


def test_disk_and_spill(spark):
    disk = scoped(spark, "hostname string, total_kb bigint, used_kb bigint, avail_kb bigint, percent int", ("h", 10, 3, 7, 30), ("h", 10, 3, 7, 30), ("h", 10, 4, 6, 40), ("g", None, 1, 1, 1))
    assert rows(hosts.disk_per_host({"disk_usage": disk}).drop("cluster", "snapshot_ts"), "hostname") == [("g", 0.0, 1.0, 1.0, 1.0), ("h", 10.0, 4.0, 6.0, 40.0)]
    segs = scoped(spark, "content int, role string, hostname string", (-1, "p", "m"), (0, "p", "h"), (1, "p", "h"), (2, "p", "g"), (0, "m", "g"))
    work = scoped(spark, "segid int, size bigint", (0, 5), (0, 6), (1, 7), (-1, 100))
    assert rows(hosts.spill_per_host({"segment_config": segs, "workfile_usage": work}).select("hostname", "spill_bytes"), "hostname") == [("g", 0.0), ("h", 18.0)]


def test_resource_groups(spark):
    t = {
        "segment_config": scoped(spark, "content int, role string, hostname string", (0, "p", "h1"), (1, "p", "h2"), (-1, "p", "h3")),
        "resgroup_status": scoped(spark, "groupid bigint, num_running int, num_queueing int", (1, 4, 1), (2, 0, None), (3, 1, 1), (4, 9, 9)),
        "resgroup": scoped(spark, "oid bigint, rsgname string", (1, "admin"), (2, "free"), (3, "none"), (4, "nohost")),
        "resgroup_host": scoped(
            spark, "groupid bigint, hostname string, cpu double, memory_used bigint", (1, "h2", 2.5, 10), (1, "h1", None, None), (1, "h3", 9.0, 9), (2, "h1", 1.4, 5), (3, "h2", 0.0, 1)
        ),
        "resgroup_config": scoped(spark, "groupid bigint, cpu_max_percent int, memory_limit int", (1, 20, 60), (2, -1, 0)),
    }
    assert rows(resgroups.rsg_per_host(t).drop("cluster", "snapshot_ts"), "rsgname", "hostname") == [
        ("admin", "h1", 0, 0, "20"), ("admin", "h2", 10, 3, "20"), ("free", "h1", 5, 1, "unlimited"), ("none", "h2", 1, 0, "unlimited")]
    assert rows(resgroups.rsg_per_group(t).drop("cluster", "snapshot_ts"), "rsgname") == [("admin", 4, 1, 60, 20), ("free", 0, 0, 0, -1), ("none", 1, 1, 0, 0)]
    assert [r[3] for r in rows(resgroups.rsg_effective_mem_limit(t).drop("cluster"), "rsgname")] == [60, 40, 40]


def test_table_health_merge_and_limit(spark):
    key = "datname string, nspname string, relname string, "
    data = [("db", "s", f"t{i:02d}", None if i == 0 else str(1 + i % 3)) for i in range(15)]
    data += [("db", "pg_catalog", "x", "9"), ("db", None, "x", "9"), ("db2", "s", "low", "0"), ("db2", "s", "just", "0.1"), ("db2", "s", "above", "0.11")]
    skew = scoped(spark, key + "skccoeff string", *data).withColumn("skccoeff", F.col("skccoeff").cast("decimal(20,6)"))
    bloat = scoped(spark, key + "relpages bigint, exppages bigint", ("db", "s", "t02", 50, 10), ("db", "s", "only", 5, 0))
    t = {"skew_coefficients": skew, "bloat_diag": bloat}
    top = rows(tablehealth.table_skew_top(t).filter("datname = 'db'").select("relname", "skew_factor"), F.desc("skew_factor"), "relname")
    assert top == [("t02", 3.0), ("t05", 3.0), ("t08", 3.0), ("t11", 3.0), ("t14", 3.0), ("t01", 2.0), ("t04", 2.0), ("t07", 2.0), ("t10", 2.0), ("t13", 2.0)]
    assert rows(tablehealth.table_skew_top(t).filter("datname = 'db2'").select("relname", "skew_factor")) == [("above", 0.1)]
    merged = {r.relname: (r.bloat_state, r.skew_factor) for r in tablehealth.table_health(t).collect()}
    assert merged["t02"] == (1.0, 3.0) and merged["only"] == (2.0, 0.0) and merged["t05"] == (0.0, 3.0)


def test_never_vacuumed_and_catalog_join(spark):
    t = {
        "pg_class": scoped(spark, "datname string, oid bigint, relname string, relnamespace bigint, relkind string", ("d", 1, "a", 10, "r"), ("d", 2, "b", 11, "r"), ("d", 3, "i", 10, "i")),
        "pg_namespace": scoped(spark, "datname string, oid bigint, nspname string", ("d", 10, "public"), ("d", 11, "pg_toast")),
        "pg_stat_all_tables": scoped(
            spark, "datname string, relid bigint, n_live_tup bigint, n_dead_tup bigint, last_vacuum timestamp, last_autovacuum timestamp, vacuum_count bigint, autovacuum_count bigint",
            ("d", 1, 900, 100, None, None, 1, None), ("d", 2, 9000, 0, None, None, 0, 0), ("d", 3, 9000, 0, None, None, 0, 0),
        ),
    }
    assert rows(vacuum.table_vacuum(t, never_flag=True).drop("cluster", "snapshot_ts")) == [("d", "public", "a", 0.1, 0, 0, 1, 0, True)]
    assert rows(vacuum.table_vacuum(t, tuple_threshold=1001)) == []
    assert rows(vacuum.db_vacuum(t).drop("cluster", "snapshot_ts")) == [("d", 0, 0.1, 0.1)]


def test_database_filter_modes(spark):
    dbs = spark.createDataFrame(
        [("db1", True, False), ("db2", True, False), ("Db3", True, False), ("tmpl", True, True), ("off", False, False)],
        "datname string, datallowconn boolean, datistemplate boolean",
    )

    def names(mode, listed=None):
        return sorted(r[0] for r in databases.database_filter({"pg_database": dbs}, mode, listed).collect())

    assert names("all") == ["Db3", "db1", "db2"]
    assert names("include", ["DB1", "db2", "Db3", "gone", "tmpl"]) == ["Db3", "db2"]
    assert names("exclude", ["db2", "gone"]) == ["Db3", "db1"]
    assert names("include", []) == [] and names("include") == [] and names("exclude") == ["Db3", "db1", "db2"]
    assert names("none", ["db1"]) == []
    assert names("exclude", spark.createDataFrame([("db1",)], "datname string")) == ["Db3", "db2"]
    with pytest.raises(ValueError):
        names("from_db")


def test_backup_status_collisions(spark):
    ddl = "backup_id bigint, database_name string, incremental int, status string, timestamp string, end_time string"
    t = {"backups": scoped(
        spark, ddl, (1, "d", 0, "Success", "20231231000000", "20231231010000"), (2, "d", 0, "Success", "20231231000000", "20231231020000"),
        (3, "d", 0, "SUCCESS", "20230101000000", "20230101000001"), (4, "d", 0, "Queued", "20231231000000", None),
        (5, "d", 0, "In Progress", "20231231000000", ""), (6, "d", 1, "Failure", "bad", "20231231000000"), (7, "d", 0, "Queued", None, None),
    )}
    got = {(r.incremental, r.status): tuple(r)[5:] for r in backups.backup_history(t).collect()}
    # 'Success' sorts after 'SUCCESS', so its row stays; of two equal start times the greater backup id counts.
    assert got[(0, "success")] == (2, 7200.0, 22 * 3600.0)
    assert got[(0, "queued")] == (2, 0.0, 0.0) and got[(1, "failure")] == (1, 0.0, 86400.0)
    metrics = {(r.metric, r.status): r.value for r in backups.backup_metrics(t).filter("type = 'full'").collect()}
    assert metrics == {("backup_count", "success"): 2.0, ("backup_count", "in_progress"): 1.0}


def test_entity_returns_with_new_labels(spark):
    life = [(0, "x", "p"), (1, "x", "m"), (3, "x", "m"), (4, "x", "p"), (0, "y", "p"), (2, "z", "q")]
    e = spark.createDataFrame([("c", at(days=d), k, role, float(d)) for d, k, role in life], SCOPED + "k string, role string, v double")
    spine = spark.createDataFrame([("c", at(days=d)) for d in range(6)], "cluster string, snapshot_ts timestamp")
    pinned = [(r.snapshot_ts.day - 1, r.k, r.role, r.v) for r in lifecycle.pinned_labels(e, ["k"], ["role"], ["v"], spine).orderBy("k", "snapshot_ts").collect()]
    assert pinned == [(0, "x", "p", 0.0), (1, "x", "p", 1.0), (3, "x", "m", 3.0), (4, "x", "m", 4.0), (0, "y", "p", 0.0), (2, "z", "q", 2.0)]
    changes = {(r.snapshot_ts.day - 1, r.k): r.change for r in lifecycle.entity_changes(e, ["k"], spine).collect()}
    assert changes == {
        (0, "x"): "new", (1, "x"): "kept", (2, "x"): "deleted", (3, "x"): "new", (4, "x"): "kept", (5, "x"): "deleted",
        (0, "y"): "new", (1, "y"): "deleted", (2, "z"): "new", (3, "z"): "deleted"}
    shown = lifecycle.absent_policy(e, ["k"], ["v"], "nan", spine).orderBy("k", "snapshot_ts").collect()
    assert [(r.snapshot_ts.day - 1, r.k) for r in shown if math.isnan(r.v)] == [(2, "x"), (5, "x"), (1, "y"), (2, "y"), (3, "y"), (4, "y"), (5, "y"), (3, "z"), (4, "z"), (5, "z")]
    with pytest.raises(ValueError):
        lifecycle.absent_policy(e, ["k"], ["v"], "gone")


def test_carry_forward_skips_failures_before_first_success(spark):
    e = spark.createDataFrame([("c", at(days=d), "x", float(d)) for d in (0, 1, 2)], SCOPED + "k string, v double")
    snaps = spark.createDataFrame([("c", at(days=d), ok) for d, ok in enumerate([False, True, False, False, True])], SCOPED + "ok boolean")
    assert [(r.snapshot_ts.day - 1, r.v) for r in lifecycle.carry_forward(e, snaps).orderBy("snapshot_ts").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_chunked_windows_equal_plain_ones(spark):
    data = [("k%d" % (i % 3), at(i * 7001), i, None if i % 4 else i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, ts timestamp, n bigint, v bigint")
    expected, sums, last = {}, {}, {}
    for k, _, n, v in data:
        sums[k] = sums.get(k, 0) + n
        last[k] = v if v is not None else last.get(k)
        expected[n] = (sums[k], last[k])
    summed = running_sum(df.withColumn("total", F.col("n")), ["k"], ["ts"], ["total"], day_chunk("ts"))
    filled = fill_forward(summed.withColumn("latest", F.col("v")), ["k"], ["ts"], ["latest"], day_chunk("ts"))
    assert {r.n: (r.total, r.latest) for r in filled.collect()} == expected


def test_chunked_histories_shuffle_their_input_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 5000).alias("ts"), F.col("id").alias("n"), "id")
    out = fill_forward(df, ["k"], ["ts"], ["n"], day_chunk("ts"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan and plan.count("Range (0, 1000") == 1, plan


def test_spine_across_days(spark):
    stamps = [0, 15, 86399, 86400 * 3, 86400 * 3 + 1]
    df = spark.createDataFrame([("c", at(s)) for s in stamps] * 2, "cluster string, snapshot_ts timestamp")
    got = snapshot_spine(df).orderBy("idx").collect()
    assert [(r.snapshot_ts, r.idx, r.next_ts, r.last_idx) for r in got] == [
        (at(s), i, at(stamps[i + 1]) if i < 4 else None, 4) for i, s in enumerate(stamps)]


def test_staleness(spark):
    scrapes = spark.createDataFrame([("c", at(0), True), ("c", at(50), False), ("c", at(90000), True)], "cluster string, start_ts timestamp, successful boolean")
    asks = spark.createDataFrame([("c", i, at(s)) for i, s in enumerate([-1, 0, 30, 30.5, 89999, 90000])] + [("d", 9, at(0))], "cluster string, request_id bigint, request_ts timestamp")
    got = {r.request_id: (r.age_seconds, r.stale) for r in runlog.scrape_staleness(asks, scrapes).collect()}
    assert got == {0: (None, True), 1: (0.0, False), 2: (30.0, False), 3: (30.5, True), 4: (89999.0, True), 5: (0.0, False), 9: (None, True)}


def test_failfast(spark):
    runs = spark.createDataFrame([("c", 1, i, f"k{i}", f) for i, f in enumerate([True, False, True, True, False, True])], "cluster string, scrape_id bigint, seq bigint, collector string, failed boolean")
    t = {"collector_run_log": runs}
    assert [r.executed for r in runlog.failfast_cutoff(t).orderBy("seq").collect()] == [True, True, True, True, False, False]
    assert all(r.executed for r in runlog.failfast_cutoff(t, enabled=False).collect())
    assert all(r.executed for r in runlog.failfast_cutoff(t, threshold=5).collect())


NAN = float("nan")


def vector(spark, *data):
    return spark.createDataFrame([("c", at(s), m, labels, v) for s, m, labels, v in data], "cluster string, ts timestamp, metric string, labels map<string,string>, value double")


def test_range_edges(spark):
    v = vector(spark, (0, "m", {}, 1.0), (100, "m", {}, 2.0), (110, "m", {}, 3.0), (-299, "m", {"a": "x"}, 9.0), (-300, "m", {"a": "y"}, 9.0))
    got = series.range_select(v, at(0), at(600), 60, 300)
    lines = {}
    for r in got.orderBy("ts").collect():
        lines.setdefault(r.labels.get("a"), []).append(((r.ts - T0).seconds, r.value))
    assert lines["x"] == [(0, 9.0)] and "y" not in lines
    assert lines[None] == [(0, 1.0), (60, 1.0), (120, 3.0), (180, 3.0), (240, 3.0), (300, 3.0), (360, 3.0)]
    for t in range(0, 601, 60):
        instant = {r.labels.get("a"): r.value for r in series.instant_select(v, at(t), 300).collect()}
        assert instant == {k: dict(points)[t] for k, points in lines.items() if t in dict(points)}


def test_nan_rules(spark):
    v = vector(spark, (0, "m", {"a": "1"}, NAN), (0, "m", {"a": "2"}, -5.0), (0, "m", {"a": "3"}, 7.0), (1, "m", {"a": "1"}, NAN))
    ranked = [(r.labels["a"], r["rank"]) for r in series.topk_series(v.filter(F.col("ts") == F.lit(T0)), 3).orderBy("rank").collect()]
    assert ranked == [("3", 1), ("2", 2), ("1", 3)]
    assert [r.labels["a"] for r in series.compare_filter(v, ">", 0).collect()] == ["3"]
    assert series.compare_filter(v, "!=", 7).count() == 3
    low = {r.ts: r.value for r in series.min_series(v).collect()}
    assert low[T0] == -5.0 and math.isnan(low[at(1)])
    reduced = {r.labels["a"]: r for r in series.reduce_series(v.unionByName(vector(spark, (2, "m", {"a": "3"}, NAN)))).collect()}
    assert reduced["3"].lastNotNull == 7.0 and math.isnan(reduced["3"]["last"]) and reduced["3"]["max"] == 7.0
    assert reduced["1"]["max"] is None and reduced["1"].lastNotNull is None
    bands = [r.band for r in series.threshold_band(v, (("low", None), ("mid", -5), ("high", 7))).orderBy("ts", "labels.a").collect()]
    assert bands == ["low", "mid", "high", "low"]


def test_matchers_are_anchored(spark):
    v = vector(spark, (0, "m", {"db": "db1"}, 1.0), (0, "m", {"db": "db10"}, 2.0), (0, "m", {}, 3.0), (0, "n", {"db": "db1"}, 4.0))
    values = lambda df: sorted(r.value for r in df.collect())
    assert values(series.match_labels(v, {"db": "db1"}, "m")) == [1.0]
    assert values(series.match_labels(v, {"db": "db1|"}, "m")) == [1.0, 3.0]
    assert values(series.match_labels(v, {"db": ".*"}, "m")) == [1.0, 2.0, 3.0]
    assert [r[0] for r in series.label_values(v, "db", "m").collect()] == ["db1", "db10"]


def test_ratio_division(spark):
    a = vector(spark, (0, "x", {"l": "1"}, 5.0), (0, "x", {"l": "2"}, 0.0), (0, "x", {"l": "3"}, 1.0), (0, "x", {"l": "4"}, 1.0))
    b = vector(spark, (0, "y", {"l": "1"}, 20.0), (0, "y", {"l": "2"}, 0.0), (0, "y", {"l": "3"}, 0.0), (1, "y", {"l": "4"}, 1.0))
    got = {r.labels["l"]: r.value for r in series.vector_ratio_pct(a, b).collect()}
    assert got["1"] == 25.0 and math.isnan(got["2"]) and got["3"] == math.inf and "4" not in got


def test_legend_and_organize(spark):
    v = vector(spark, (0, "m", {"h": "a", "p": "1"}, 2.0))
    assert v.select(series.legend("{{h}}:{{p}} (x={{none}}) {{cluster}}")).first()[0] == "a:1 (x=) c"
    assert v.select(series.legend("plain")).first()[0] == "plain"
    table = series.organize_columns(v, ["Time", "p", "h", "Value"], exclude=["Time"])
    assert table.columns == ["p", "h", "Value"] and tuple(table.first()) == ("1", "a", 2.0)


def test_matchers_span_lines_and_whole_values(spark):
    samples = spark.createDataFrame([("c", "m", {"d": v}) for v in ("db1", "db1\n", "a\nb", "xdb1")], "cluster string, metric string, labels map<string,string>")

    def kept(pattern):
        return sorted(r.labels["d"] for r in series.match_labels(samples, {"d": pattern}).collect())

    assert kept("db1") == kept("db[1]") == kept("(db1)") == ["db1"]
    assert kept("a.+b") == ["a\nb"] and kept("db1.") == ["db1\n"] and kept("db1|xdb1") == kept("x?db1") == ["db1", "xdb1"]


def test_unknown_database_size_is_zero(spark):
    rows = spark.createDataFrame([("c", None, "a", None), ("c", None, "b", 3 << 20)], "cluster string, snapshot_ts timestamp, datname string, bytes bigint")
    assert {r.datname: r.size_mb for r in databases.database_size({"database_size": rows}).collect()} == {"a": 0.0, "b": 3.0}
