"""Sources, sinks, the metric catalogue, and how a set of collectors is run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import segments, series
from fleetlens.plans import panels, registry
from fleetlens.plans.collect import collect_samples
from fleetlens.plans.samples import CollectorSpec, MetricSpec, entity_key, exposition_lines, to_samples
from fleetlens.schemas import TABLES, table_schema
from fleetlens.sources import catalog

# Every metric family a user of the dashboards can ask for.
FAMILIES = """
up cluster_state cluster_uptime_seconds cluster_sync cluster_config_last_load_time_seconds cluster_max_connections
cluster_segment_status cluster_segment_role cluster_segment_mode cluster_segments_total cluster_segments_up cluster_segments_down
cluster_connections_total cluster_connections_all_states_total
query_active_queries_duration_bucket query_active_queries_total query_active_queries_slow
server_locked_sessions_count cluster_query_waiting_count server_locked_sessions_total
server_lock_waiting_queries server_lock_wait_max_wait_seconds
cluster_replication_lag_bytes cluster_replication_state cluster_replication_sync_state cluster_replication_write_lag_bytes
cluster_replication_flush_lag_bytes cluster_replication_max_lag_bytes
host_database_name_mb_size host_total_database_size_mb server_database_count
database_table_dead_tuple_ratio database_table_seconds_since_last_vacuum database_table_seconds_since_last_autovacuum
database_table_vacuum_count database_table_autovacuum_count
database_db_max_seconds_since_last_vacuum database_db_avg_dead_tuple_ratio database_db_max_dead_tuple_ratio
server_vacuum_running_seconds server_vacuum_running server_table_bloat_state server_table_skew_factor
host_disk_total_kb host_disk_used_kb host_disk_available_kb host_disk_usage_percent
host_max_disk_total_kb host_avg_disk_total_kb host_disk_total_kb_skew_ratio host_max_disk_used_kb host_avg_disk_used_kb
host_disk_used_kb_skew_ratio host_max_disk_available_kb host_avg_disk_available_kb host_disk_available_kb_skew_ratio
host_max_disk_usage_percent host_avg_disk_usage_percent host_disk_usage_percent_skew_ratio
host_spill_usage_bytes host_max_spill_usage host_avg_spill_usage host_spill_usage_skew_ratio
host_mem_usage_mb host_cpu_usage_percentage host_num_running_sessions host_num_queueing_sessions host_mem_limit_percent
host_mem_limit_percent_value host_cpu_rate_limit_percentage host_max_mem_usage host_avg_mem_usage host_mem_usage_skew_ratio
host_max_cpu_usage host_avg_cpu_usage host_cpu_usage_skew_ratio
gpbackup_backup_count gpbackup_last_backup_duration_seconds gpbackup_seconds_since_last_backup_completion
exporter_total_scraped_total exporter_total_error_total exporter_collector_error_total exporter_collector_duration_seconds
exporter_scrape_duration_seconds_count exporter_scrape_duration_seconds_sum exporter_scrape_duration_seconds_max
exporter_uptime_seconds
""".split()


def test_catalogue_is_complete():
    made = [m.full_name("") for s in registry.COLLECTORS for m in s.metrics]
    made += [m.full_name("") for m in (registry.UP, *registry.RUN_STATS_METRICS, *registry.SUMMARY_METRICS)]
    assert len(made) == len(set(made)) and set(made) == set(FAMILIES)


def test_panels_use_known_metrics():
    assert len(panels.PANELS) == 40 and len({p.key for p in panels.PANELS}) == 40
    assert {m for p in panels.PANELS for m in panels.panel_metrics(p)} <= set(FAMILIES)


def test_inputs_have_schemas():
    assert {t for s in registry.COLLECTORS for t in s.inputs} <= set(TABLES)


def test_landed_round_trip_prunes_days_and_columns(spark, tmp_path):
    ddl = table_schema("database_size")
    days = [("c", dt.datetime(2024, 1, d, 3), f"db{d}", d) for d in range(1, 6)]
    catalog.write_landed(spark.createDataFrame(days, ddl), str(tmp_path), "database_size")
    df = catalog.read_landed(spark, str(tmp_path), "database_size", "2024-01-02", "2024-01-03").filter("bytes > 2").select("datname")
    assert [r[0] for r in df.collect()] == ["db3"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "ReadSchema: struct<datname:string,bytes:bigint>" in scan
    assert "snapshot_date" in scan.split("PartitionFilters:")[1].split("PushedFilters:")[0] and "GreaterThan(bytes,2)" in scan


def test_disk_usage_text(spark, tmp_path):
    (tmp_path / "df.txt").write_text("0,h1,/dev/sda,100,40,60,40%\n-1,h2,/dev/sdb,7,x,7,1\nbroken\n")
    rows = [tuple(r) for r in catalog.read_disk_usage(spark, str(tmp_path / "df.txt")).collect()]
    assert rows == [(0, "h1", "/dev/sda", 100, 40, 60, 40), (-1, "h2", "/dev/sdb", 7, None, 7, 1), (None,) * 7]


def test_jdbc_options():
    options = catalog.jdbc_options("jdbc:x:y", "SELECT 1", user="u", fetch_size=5, driver="d")
    assert options == {"url": "jdbc:x:y", "query": "SELECT 1", "fetchsize": "5", "driver": "d", "user": "u"}


def test_per_database_reader_skips_bad_ones(spark):
    def fail():
        raise OSError("no route")

    got = catalog.read_databases({"a": lambda: spark.range(2), "b": fail, "c": lambda: spark.range(1)})
    assert sorted((r.datname, r.id) for r in got.collect()) == [("a", 0), ("a", 1), ("c", 0)]
    assert catalog.read_databases({"b": fail}) is None
    with pytest.raises(OSError):
        catalog.read_databases({"b": fail}, skip_errors=False)


NOW = dt.datetime(2024, 1, 1)


def _segments(spark):
    ddl = table_schema("segment_config")
    return {"segment_config": spark.createDataFrame([("c", NOW, 1, -1, "p", None, "s", "u", 5, "h", "a", "d")], ddl)}


def test_samples_round_trip_and_lines(spark, tmp_path):
    spec = next(s for s in registry.COLLECTORS if s.name == "segment_health")
    samples = to_samples(segments.segment_health(_segments(spark)), spec.metrics, "ns")
    catalog.write_samples(samples, str(tmp_path / "s"))
    back = catalog.read_samples(spark, str(tmp_path / "s"))
    assert sorted(r.metric for r in back.collect()) == ["ns_cluster_segment_mode", "ns_cluster_segment_role", "ns_cluster_segment_status"]
    catalog.write_exposition(back.select("cluster", "ts", "metric", "labels", "value"), str(tmp_path / "t"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines[2] == 'ns_cluster_segment_status{cluster="c",content="-1",dbid="1",hostname="h",port="5",preferred_role="unknown",role="p"} 1.0'


def test_history_reads_only_the_days_and_metric_it_needs(spark, tmp_path):
    rows = [("c%d" % (i % 2), NOW + dt.timedelta(days=i), m, {"a": "b"}, float(i)) for i in range(5) for m in ("x", "y")]
    ddl = "cluster string, ts timestamp, metric string, labels map<string,string>, value double"
    catalog.write_samples(spark.createDataFrame(rows, ddl), str(tmp_path))
    history = series.match_labels(catalog.read_samples(spark, str(tmp_path)), {"cluster": "c0|c9"}, "x")
    got = series.range_select(history, "2024-01-03 00:00:00", "2024-01-03 00:10:00", 600)
    assert [r.value for r in got.collect()] == [2.0]
    scan = next(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    folders = scan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "date" in folders and "metric" in folders and "In(cluster" in scan
    assert [r.value for r in series.time_range(history, "2024-01-03 00:00:00", 2 * 86400).orderBy("ts").collect()] == [0.0, 2.0]


@pytest.mark.parametrize("value,text", [(float("nan"), "NaN"), (float("inf"), "+Inf"), (float("-inf"), "-Inf"), (1.5, "1.5")])
def test_line_numbers_and_escapes(spark, value, text):
    df = spark.createDataFrame([("c", NOW, "m", {"a": 'q"\\\n'}, value), ("c", NOW, "m", {}, value)], "cluster string, ts timestamp, metric string, labels map<string,string>, value double")
    assert [r[0] for r in exposition_lines(df, cluster_label=False).collect()] == ['m{a="q\\"\\\\\\n"} ' + text, "m " + text]


def test_external_label_keeps_own(spark):
    df = spark.createDataFrame([("c", NOW, "m", {"a": "1"}, 1.0)], "cluster string, ts timestamp, metric string, labels map<string,string>, value double")
    row = series.external_label(df, cluster="x", a="2", b="3").first()
    assert row.cluster == "x" and row.labels == {"a": "1", "b": "3"}


def test_entity_key(spark):
    assert spark.range(1).select(entity_key("id", "id", separator=":")).first()[0] == "0:0"


def test_error_policies(spark):
    def broken(tables):
        return tables["segment_config"].select("cluster", "snapshot_ts", "no_such_column")

    good = next(s for s in registry.COLLECTORS if s.name == "segment_counts")
    metric = (MetricSpec("x", "no_such_column"),)
    soft = CollectorSpec("soft", "mine", ("segment_config",), broken, metrics=metric, on_error="continue")
    hard = CollectorSpec("hard", "mine", ("segment_config",), broken, metrics=metric)
    away = CollectorSpec("away", "mine", ("nowhere",), broken, metrics=metric, on_error="empty")
    assert collect_samples(_segments(spark), [good, soft, away]).count() == 3
    with pytest.raises(Exception, match="no_such_column"):
        collect_samples(_segments(spark), [good, hard])
    with pytest.raises(ValueError):
        collect_samples(_segments(spark), [soft])


def test_selection_defaults_and_modes(spark):
    names = registry.enabled_collectors()
    assert "table_health" not in names and "backup_history" not in names and len(names) == len(registry.COLLECTOR_NAMES) - 2
    assert all(s.collector != "segment" for s in registry.selected_specs({"segment": False}))
    with pytest.raises(ValueError):
        registry.enabled_collectors({"nope": True})
    dbs = spark.createDataFrame([("c", "d1"), ("c", "d2")], "cluster string, datname string")
    per_db = registry.collector_selection(dbs, dbs).groupBy("run_group").count()
    assert {r[0]: r[1] for r in per_db.collect()} == {"general": 12, "per_db": 4}
    alone = registry.collector_selection(dbs, dbs, per_db_mode="none")
    assert alone.count() == 14 and alone.filter(F.col("datname").isNotNull()).count() == 0


def test_legend_values(spark):
    rows = [("c", NOW + dt.timedelta(seconds=15 * i), "fleet_cluster_connections_total", {"state": s}, float(i)) for i in range(4) for s in ("idle", "active")]
    df = spark.createDataFrame(rows, "cluster string, ts timestamp, metric string, labels map<string,string>, value double")
    window = panels.Window("2024-01-01 00:00:00", "2024-01-01 00:01:00")
    got = panels.legend_values(df, panels.panel("overview_connections_by_state"), window)
    assert sorted(tuple(r) for r in got.collect()) == [("c", "active", 3.0, 3.0), ("c", "idle", 3.0, 3.0)]


def test_panel_variables_and_top(spark):
    rows = [("c", NOW, "fleet_database_table_dead_tuple_ratio", {"database": f"d{i % 2}", "schema": "s", "table": f"t{i}"}, i / 10) for i in range(8)]
    df = spark.createDataFrame(rows, "cluster string, ts timestamp, metric string, labels map<string,string>, value double")
    window = panels.Window("2024-01-01 00:00:00", "2024-01-01 00:00:00")
    got = panels.run_panel(df, panels.panel("dbhealth_top_dead_ratio"), window, {"database": "d1"}, top=2)
    assert sorted((r.legend, r.band) for r in got.collect()) == [("d1.s.t5", "green"), ("d1.s.t7", "green")]


def test_failures_are_rows(spark):
    from fleetlens.plans.collect import failure_rows

    def fail():
        raise OSError("gone")

    failures = []
    catalog.read_databases({"a": lambda: spark.range(1), "b": fail}, failures=failures)
    left_out = CollectorSpec("away", "away", ("nowhere",), lambda t: t["nowhere"], on_error="continue")
    kept = CollectorSpec("kept", "kept", ("segment_config",), lambda t: t["segment_config"], metrics=(MetricSpec("m", "dbid"),))
    collect_samples(_segments(spark), [kept, left_out], failures=failures)
    assert [tuple(r) for r in failure_rows(spark, failures).select("name").collect()] == [("b",), ("away",)]


def test_headers():
    from fleetlens.plans.registry import SUMMARY_METRICS
    from fleetlens.plans.samples import exposition_headers

    lines = exposition_headers([*SUMMARY_METRICS, MetricSpec("x", "x", help="two\nlines")])
    assert "# TYPE fleet_exporter_total_scraped_total counter" in lines and "# TYPE fleet_exporter_uptime_seconds gauge" in lines
    assert lines[-2:] == ["# HELP fleet_x two\\nlines", "# TYPE fleet_x gauge"]


def test_text_with_headers_is_in_order(spark, tmp_path):
    from fleetlens.sources.catalog import write_exposition

    samples = spark.createDataFrame(
        [("c", "fleet_b", {"k": "2"}, 1.0), ("c", "fleet_ab", {}, 3.0), ("c", "fleet_b", {"k": "1"}, 2.0), ("c", "other", {"k": "v"}, 4.0)],
        "cluster string, metric string, labels map<string,string>, value double",
    )
    metrics = [MetricSpec("b", "x", help="B"), MetricSpec("b", "y", help="B"), MetricSpec("ab", "x", kind="counter"), MetricSpec("c", "x")]
    write_exposition(samples, f"{tmp_path}/text", metrics=metrics)
    text = [line for part in sorted((tmp_path / "text").glob("part-*")) for line in part.read_text().splitlines()]
    assert text == [
        "# TYPE fleet_ab counter", 'fleet_ab{cluster="c"} 3.0', "# HELP fleet_b B", "# TYPE fleet_b gauge",
        'fleet_b{cluster="c",k="1"} 2.0', 'fleet_b{cluster="c",k="2"} 1.0', 'other{cluster="c",k="v"} 4.0',
    ]
