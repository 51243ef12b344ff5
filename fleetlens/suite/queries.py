"""The registered queries: every operator over tables derived from the whole of the driver's test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fleetlens.functions.scalars import COMPACT_FORMAT, num_to_lsn, value_text
from fleetlens.operators import (
    absences, backups, cluster, databases, hosts, lifecycle, locks, replication, resgroups, runlog, segments, series, sessions,
    tablehealth, vacuum,
)
from fleetlens.plans import panels, registry
from fleetlens.plans.collect import collect_samples
from fleetlens.plans.samples import CollectorSpec, MetricSpec, exposition_lines, exposition_text, spec_samples, to_samples
from fleetlens.session import configure, shared_dir
from fleetlens.sources.catalog import parse_disk_usage
from fleetlens.sources.fixtures import DERIVATIONS, derive
from fleetlens.sources.seriesstore import SeriesStore
from fleetlens.streaming import lives

Query = Callable[[SparkSession, str], DataFrame]

# The month the event-based tables cover.
MONTH_START = "2024-01-01 00:00:00"
MONTH_END = "2024-02-01 00:00:00"
DAY = 86400
RANGE_STEP, RANGE_LOOKBACK = DAY // 4, DAY // 2


class Inputs(dict):
    """Input tables of the collectors, derived when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = configure(spark), sf_dir

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or name in _ADAPT or name in DERIVATIONS

    def __missing__(self, name: str) -> DataFrame:
        self[name] = _ADAPT.get(name, lambda get: get(name))(lambda d: derive(self._spark, self._dir, d))
        return self[name]


def _stat_replication(get) -> DataFrame:
    df = get("stat_replication")
    return df.select(
        "cluster", "snapshot_ts", "content", "application_name", "state", "sync_state",
        *[num_to_lsn(f"{p}_pos").alias(f"{p}_lsn") for p in replication.POSITIONS],
    )


def _backups(get) -> DataFrame:
    df = get("backups_raw")
    return df.select(
        "cluster", "snapshot_ts", "backup_id", "database_name", "incremental", "status",
        F.date_format("start_time", COMPACT_FORMAT).alias("timestamp"),
        F.date_format("end_time", COMPACT_FORMAT).alias("end_time"),
    )


def _metric_samples(get) -> DataFrame:
    df = get("flat_samples")
    labels = F.create_map(F.lit("database"), "label_database", F.lit("table"), "label_table")
    return df.select("cluster", "ts", "metric", labels.alias("labels"), "value")


_ADAPT = {
    "stat_replication": _stat_replication,
    "backups": _backups,
    "metric_samples": _metric_samples,
    # One configuration for all monthly snapshots of a cluster.
    "segment_config_any": lambda get: get("segment_config").drop("snapshot_ts"),
}


def labels_text(labels: str = "labels") -> Column:
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), pair), ",")


def _flat(df: DataFrame, *rest: str, ts: bool = True) -> DataFrame:
    """Label maps as two columns, so results compare as plain values."""
    return df.select(
        "cluster", *(["ts"] if ts else []), "metric",
        F.col("labels")["database"].alias("label_database"), F.col("labels")["table"].alias("label_table"), *rest,
    )


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums and means of doubles depend on the order of addition in their last bits."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _replication(t: Inputs) -> dict[str, DataFrame]:
    return {"stat_replication": t["stat_replication"], "segment_config": t["segment_config_any"]}


def _replication_old_names(t: Inputs) -> dict[str, DataFrame]:
    tables = _replication(t)
    renamed = {f"{p}_lsn": f"{p}_location" for p in replication.POSITIONS}
    return {**tables, "stat_replication": tables["stat_replication"].withColumnsRenamed(renamed)}


def _cluster_tables(t: Inputs) -> dict[str, DataFrame]:
    return {**_replication(t), "cluster_facts": t["cluster_facts"]}


def _union_sources(t: Inputs) -> DataFrame:
    """Coordinator rows without their tag, and segment rows with theirs, put together again."""
    rows = t["stat_replication"]
    both = replication.union_sources(rows.filter("content = -1").drop("content"), rows.filter("content >= 0"))
    return both.groupBy("cluster", "content", "state").agg(F.count(F.lit(1)).alias("shippers"))


def _instant(t: Inputs) -> DataFrame:
    return series.instant_select(t["metric_samples"], MONTH_END, 32 * DAY)


STORE_MATCHERS = {"database": "db[0-2]|", "table": "t1.*", "cluster": "c0|c2"}


def _store(t: Inputs) -> SeriesStore:
    """The whole sample history behind its index."""
    spark = t["metric_samples"].sparkSession
    store = SeriesStore(spark, f"{shared_dir(spark)}/series/{uuid.uuid4().hex}")
    store.append(t["metric_samples"])
    return store


def _store_instant(t: Inputs) -> DataFrame:
    chosen = _store(t).select(["m_view", "m_click"], STORE_MATCHERS)
    return series.instant_select(chosen, MONTH_END, 32 * DAY)


def _range(t: Inputs) -> DataFrame:
    return series.range_select(t["metric_samples"], MONTH_START, MONTH_END, RANGE_STEP, RANGE_LOOKBACK)


def _usage(t: Inputs) -> DataFrame:
    """Two metrics of the same series for the ratio: sessions and twice-a-day limits."""
    flat = t["flat_samples"]
    day = F.date_trunc("day", "ts").alias("ts")
    daily = flat.groupBy("cluster", day).agg(
        F.count(F.lit(1)).cast("double").alias("connections"), F.count_if(F.col("metric") == "m_view").cast("double").alias("limit")
    )
    no_labels = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = F.array(
        F.struct(F.lit("sessions").alias("metric"), no_labels.alias("labels"), F.col("connections").alias("value")),
        F.struct(F.lit("limit").alias("metric"), no_labels.alias("labels"), F.col("limit").alias("value")),
    )
    return daily.select("cluster", "ts", F.explode(rows).alias("_m")).select("cluster", "ts", "_m.*")


VALUE_BANDS = (("green", None), ("yellow", 100.0), ("orange", 250.0), ("red", 400.0))


def _validate(t: Inputs) -> DataFrame:
    rows = t["flat_samples"].select(
        "cluster", F.col("ts").alias("snapshot_ts"),
        F.when(F.col("metric") != "m_error", F.col("label_table")).alias("entity"),
        F.when(F.col("metric") != "m_view", F.col("value")).alias("value"),
    )
    return lifecycle.validate_entities(rows, ["entity"], ["value"]).select("cluster", "snapshot_ts", "entity", "problem")


def _selection(t: Inputs) -> DataFrame:
    allowed = databases.database_filter({"pg_database": t["customer_databases"]}, "include", t["listed_databases"])
    return registry.collector_selection(allowed, t["event_snapshots"], {"table_health": True, "disk_per_host": False})


def _spec(name: str):
    return next(s for s in registry.COLLECTORS if s.name == name)


def _to_samples(t: Inputs) -> DataFrame:
    samples = spec_samples(_spec("replication_lag"), replication.replication_lag(_replication(t)))
    return samples.select("cluster", "ts", "metric", labels_text().alias("labels"), "value")


def _backup_samples(t: Inputs) -> DataFrame:
    samples = spec_samples(_spec("backup_metrics"), backups.backup_metrics(t))
    return samples.select("cluster", "ts", "metric", labels_text().alias("labels"), "value")


def _run_log_samples(t: Inputs) -> DataFrame:
    parts = [to_samples(df, metrics, ts=ts) for df, metrics, ts in registry.run_log_tables(t).values()]
    samples = reduce(DataFrame.unionByName, parts)
    return _rounded(samples.select("cluster", "ts", "metric", labels_text().alias("labels"), "value"), value=6)


# A collector over entities that come and go, with a label that moves.
HISTORY_SPEC = CollectorSpec(
    "entity_days", "entity_days", ("entity_days",), lambda t: t["entity_days"], ("entity",), absent="nan",
    metrics=(MetricSpec("value", "value", (("entity", "entity"), ("role", "role")), "entity"),),
)


def _range_with_absences(t: Inputs) -> DataFrame:
    """Steps of a range over entities that come and go, absences as intervals."""
    rows = t["entity_days"]
    samples = to_samples(rows.select("cluster", "snapshot_ts", "entity", "value"), [MetricSpec("value", "value", (("entity", "entity"),), "entity")])
    intervals = absences.absence_intervals(rows, ["entity"], {"fleet_entity_value": "nan"}, [("entity", "entity")], t["entity_snapshots"])
    out = absences.range_with_absences(samples, intervals, t["entity_snapshots"], MONTH_START, MONTH_END, RANGE_STEP, RANGE_LOOKBACK)
    return out.select("cluster", "ts", F.col("labels")["entity"].alias("entity"), "value")


def _entities_at(t: Inputs) -> DataFrame:
    """Entities as they stood at every snapshot, failed ones included, from the intervals of the good ones."""
    times = t["entity_snapshots"].select("cluster", F.col("snapshot_ts").alias("ts"))
    return lifecycle.entities_at(t["entity_days"], lifecycle.good_intervals(t["entity_snapshots"]), times)


def _life_log(t: Inputs) -> DataFrame:
    """The lives that the change log of keyed state ends with, over the whole history as one batch."""
    feed = lives.snapshot_feed(t["entity_days"], ["entity"], ["role"], t["entity_snapshots"])
    rows = t["entity_days"].schema
    return lives.current_lives(lives.life_log(feed, StructType([rows["entity"]]), StructType([rows["role"]])))


def _life_changes(t: Inputs) -> DataFrame:
    days, listed = t["entity_days"], t["entity_snapshots"]
    return lives.life_changes(lifecycle.entity_lives(days, ["entity"], ["role"], listed), ["entity"], ["role"], listed)


def _collect_history(t: Inputs) -> DataFrame:
    """Samples under the life-cycle rules: pinned labels, and NaN for entities that are gone."""
    tables = {"entity_days": t["entity_days"], "snapshots": t["entity_snapshots"]}
    samples = collect_samples(tables, [HISTORY_SPEC], history=True)
    return samples.select(
        "cluster", "ts", "metric", F.col("labels")["entity"].alias("entity"), F.col("labels")["role"].alias("role"), "value"
    )


def whole_run_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every input of every collector, and the list of all snapshots."""
    return _run_tables(Inputs(spark, sf_dir))


def _run_tables(t: Inputs) -> dict[str, DataFrame]:
    tables = {name: t[name] for s in registry.COLLECTORS for name in s.inputs}
    return {**tables, "segment_config": t["segment_config_all"], "snapshots": t["run_snapshots"]}


def _collect_snapshot(t: Inputs) -> DataFrame:
    """A whole collection run of all collectors over all snapshots, counted and summed per metric."""
    specs = registry.selected_specs({"table_health": True, "backup_history": True})
    totals = collect_samples(_run_tables(t), specs).groupBy("cluster", "ts", "metric").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total")
    )
    return _rounded(totals, total=4)


def _exposition(t: Inputs) -> DataFrame:
    samples = t["metric_samples"].withColumn(
        "labels", F.map_concat("labels", F.create_map(F.lit("note"), F.concat(F.lit('a"b\\'), F.col("metric"), F.lit("\n"))))
    )
    return exposition_lines(samples)


def _exposition_text(t: Inputs) -> DataFrame:
    """All samples under the headers of their families: one with a help text, one of another kind, one that has no samples."""
    metrics = [MetricSpec("view", "value", help="Pages\\seen"), MetricSpec("click", "value", kind="counter"), MetricSpec("absent", "value")]
    return exposition_text(t["metric_samples"], metrics, "m")


def _table(t: Inputs) -> DataFrame:
    top = series.topk_series(series.match_labels(_instant(t), metric="m_view"), 20)
    wanted = ["Time", "__name__", "cluster", "table", "database", "Value"]
    return series.organize_columns(top, wanted, exclude=["Time", "__name__", "cluster"]).orderBy(F.desc("Value"))


_COLLECT: dict[str, Callable[[Inputs], DataFrame]] = {
    # cluster and segments
    "cluster_state": lambda t: cluster.cluster_state(_cluster_tables(t)),
    "segment_health": lambda t: segments.segment_health(t),
    "segment_counts": lambda t: segments.segment_counts(t),
    "segment_counts_spine": lambda t: segments.segment_counts(
        t, t["event_snapshots"].select("cluster", "snapshot_ts").unionByName(t["segment_config"].select("cluster", "snapshot_ts"))
    ),
    "cluster_version": lambda t: cluster.cluster_version({"cluster_facts": t["version_banners"]}),
    "supported_clusters": lambda t: cluster.supported_clusters({"cluster_facts": t["version_banners"]}),
    "cluster_up": lambda t: cluster.cluster_up(t),
    # sessions
    "connections_by_state": lambda t: sessions.connections_by_state(t),
    "connections_total": lambda t: sessions.connections_total(t, t["event_snapshots"]),
    "active_query_buckets": lambda t: sessions.active_query_buckets(t, t["event_snapshots"]),
    "active_query_totals": lambda t: sessions.active_query_totals(t),
    "vacuum_running": lambda t: sessions.vacuum_running(t),
    "vacuum_running_flag": lambda t: sessions.vacuum_running_flag(t, t["event_snapshots"]),
    # locks
    "locked_sessions": lambda t: locks.locked_sessions(t),
    "locks_waiting_count": lambda t: locks.locks_waiting_count(t, t["event_snapshots"]),
    "locked_sessions_total": lambda t: locks.locked_sessions_total(t, t["event_snapshots"]),
    "extended_locks": lambda t: locks.extended_locks(t),
    # replication
    "replication_lag": lambda t: replication.replication_lag(_replication(t)),
    "replication_lag_old_names": lambda t: replication.replication_lag(_replication_old_names(t)),
    "replication_max_lag": lambda t: replication.replication_max_lag(_replication(t)),
    "union_sources": _union_sources,
    # databases and tables
    "database_size": lambda t: databases.database_size(t),
    "database_size_totals": lambda t: databases.database_size_totals(t),
    "database_filter": lambda t: databases.database_filter({"pg_database": t["customer_databases"]}, "include", t["listed_databases"]),
    "database_filter_exclude": lambda t: databases.database_filter({"pg_database": t["customer_databases"]}, "exclude", t["listed_databases"]),
    "database_filter_all": lambda t: databases.database_filter({"pg_database": t["customer_databases"]}),
    "per_database": lambda t: databases.per_database(
        t["database_size"], databases.database_filter({"pg_database": t["customer_databases"]}, "exclude", t["listed_databases"])
    ),
    "table_vacuum": lambda t: vacuum.table_vacuum(t, never_flag=True),
    "db_vacuum": lambda t: _rounded(vacuum.db_vacuum(t), avg_dead_tuple_ratio=9),
    "table_bloat": lambda t: tablehealth.table_bloat(t),
    "table_skew_top": lambda t: tablehealth.table_skew_top(t),
    "table_health": lambda t: tablehealth.table_health(t),
    # hosts
    "disk_per_host": lambda t: hosts.disk_per_host(t),
    "disk_skew": lambda t: hosts.disk_skew(t),
    "host_skew": lambda t: hosts.disk_skew(t, truncate=False),
    "spill_per_host": lambda t: hosts.spill_per_host(t),
    "spill_skew": lambda t: hosts.spill_skew(t),
    "disk_usage_parse": lambda t: parse_disk_usage(t["disk_usage_lines"], keep=["cluster"]),
    "rsg_per_host": lambda t: resgroups.rsg_per_host(t),
    "rsg_per_group": lambda t: resgroups.rsg_per_group(t),
    "rsg_effective_mem_limit": lambda t: resgroups.rsg_effective_mem_limit(t),
    "rsg_skew": lambda t: resgroups.rsg_skew(t),
    # backups
    "backup_history": lambda t: backups.backup_history(t),
    "backup_metrics": lambda t: backups.backup_metrics(t),
    # samples
    "to_samples": _to_samples,
    "backup_samples": _backup_samples,
    "run_log_samples": _run_log_samples,
    "collect_snapshot": _collect_snapshot,
    "exposition_lines": _exposition,
    "exposition_text": _exposition_text,
    "external_label": lambda t: series.external_label(t["metric_samples"], cluster="main", region="eu", table="x").select(
        "cluster", "ts", "metric", labels_text().alias("labels"), "value"
    ),
    # series
    "series_store_select": lambda t: _flat(_store_instant(t), "value"),
    "series_store_label_values": lambda t: panels.variable_values(_store(t), "table", "m_view", {"cluster": "c1|c2", "database": "db[0-3]"}),
    "instant_select": lambda t: _flat(_instant(t), "value"),
    "range_select": lambda t: _flat(_range(t), "value"),
    "topk_series": lambda t: _flat(series.topk_series(_range(t), 5), "value", F.col("rank").cast("bigint")),
    "sum_by_label": lambda t: _rounded(series.sum_by_label(_range(t), "database", "cluster"), value=6),
    "avg_series": lambda t: _rounded(series.avg_series(_range(t)), value=6),
    "min_series": lambda t: series.min_series(_range(t)),
    "connection_usage_pct": lambda t: series.connection_usage_pct(_usage(t), "sessions", "limit").select("cluster", "ts", "value"),
    "compare_filter": lambda t: _flat(series.compare_filter(t["metric_samples"], ">", 1.5), "value"),
    "match_labels": lambda t: _flat(
        series.match_labels(t["metric_samples"], {"database": "db[13]|db4", "table": "t[0-9]", "cluster": "c[01]", "none": ""}), "value"
    ),
    "label_values": lambda t: series.label_values(t["metric_samples"], "table", "m_view", {"cluster": "c1|c2", "database": ".*"}),
    "reduce_series": lambda t: _rounded(_flat(series.reduce_series(t["metric_samples"]), *series.REDUCERS, ts=False), mean=6, sum=6),
    "threshold_band": lambda t: _flat(series.threshold_band(t["metric_samples"], VALUE_BANDS), "value", "band"),
    "value_text": lambda t: segments.segment_health(t).select(
        "cluster", "dbid",
        value_text("status_value", {0: "DOWN", 1: "UP"}).alias("status_text"),
        value_text("role_value", {1: "Primary", 2: "Mirror"}).alias("role_text"),
        value_text("mode_value", {1: "Synchronized", 2: "Resyncing", 3: "Change Tracking", 4: "Not Syncing"}).alias("mode_text"),
    ),
    "organize_columns": _table,
    "legend": lambda t: t["metric_samples"].select(
        "cluster", "ts", series.legend("{{cluster}} - {{database}}.{{table}} (lost={{lost}})").alias("legend"), "value"
    ),
    # lifecycle
    "entity_changes": lambda t: lifecycle.entity_changes(t["entity_days"], ["entity"]),
    "entity_changes_good": lambda t: lifecycle.entity_changes(
        t["entity_days"].join(t["entity_snapshots"].filter("ok"), ["cluster", "snapshot_ts"], "left_semi"),
        ["entity"], t["entity_snapshots"].filter("ok"),
    ),
    "collect_history": _collect_history,
    "entity_lives": lambda t: lifecycle.entity_lives(t["entity_days"], ["entity"], ["role"], t["entity_snapshots"]),
    "life_log": _life_log,
    "life_changes": _life_changes,
    "absence_spans": lambda t: lifecycle.absence_spans(t["entity_days"], ["entity"]),
    "absent_policy_range": lambda t: lifecycle.absent_policy(
        t["entity_days"], ["entity"], ["value"], "zero", start="2024-01-10", end="2024-01-20"
    ),
    "absent_policy": lambda t: lifecycle.absent_policy(t["entity_days"], ["entity"], ["value"], "zero", t["entity_snapshots"]),
    "absent_policy_nan": lambda t: lifecycle.absent_policy(t["entity_days"], ["entity"], ["value"], "nan", t["entity_snapshots"]),
    "absent_policy_remove": lambda t: lifecycle.absent_policy(t["entity_days"], ["entity"], ["value"], "remove"),
    "pinned_labels": lambda t: lifecycle.pinned_labels(t["entity_days"], ["entity"], ["role"], ["value"], t["entity_snapshots"]),
    "pinned_labels_kept": lambda t: lifecycle.pinned_labels(t["entity_days"], ["entity"], ["role"], ["value"], removed=False),
    "validate_entities": _validate,
    "range_with_absences": _range_with_absences,
    "good_intervals": lambda t: lifecycle.good_intervals(t["entity_snapshots"]),
    "entities_at": _entities_at,
    "carry_forward": lambda t: lifecycle.carry_forward(t["entity_days"], t["entity_snapshots"]),
    # run log
    "scrape_staleness": lambda t: runlog.scrape_staleness(t["scrape_requests"], t["scrape_log"], 5400),
    "collector_run_stats": lambda t: runlog.collector_run_stats(t),
    "scrape_summary": lambda t: _rounded(runlog.scrape_summary(t), duration_sum=6),
    "run_counters": lambda t: runlog.run_counters(t),
    "failfast_cutoff": lambda t: runlog.failfast_cutoff(t),
    "collector_selection": _selection,
    "collector_selection_none": lambda t: registry.collector_selection(
        t["customer_databases"], t["event_snapshots"], {"table_health": True, "disk_per_host": False}, per_db_mode="none"
    ),
}


# Time ranges that cover the whole of each group of inputs.
MONTH = panels.Window(MONTH_START, MONTH_END, RANGE_STEP, RANGE_LOOKBACK)
ONE_SNAPSHOT = panels.Window("2001-12-31 22:00:00", "2002-01-01 00:15:00", 900, 1800)
ALL_MONTHS = panels.Window("1995-01-01 00:00:00", "2001-10-01 00:00:00", 10 * DAY, 31 * DAY)
_WINDOWS = {
    "cluster_segment": ONE_SNAPSHOT, "host_": ONE_SNAPSHOT, "server_database": ONE_SNAPSHOT, "database_": ONE_SNAPSHOT,
    "server_table": ONE_SNAPSHOT, "cluster_replication": ALL_MONTHS,
}
PANEL_VARIABLES = {"cluster": "c[012]", "database": "db.*", "schema": ".*", "hostname": "h[0-4]", "role": "p|m"}


def panel_window(p: panels.Panel) -> panels.Window:
    return next((w for prefix, w in _WINDOWS.items() if p.targets[0].metric.startswith(prefix)), MONTH)


def _metric_sources(t: Inputs, metrics: tuple[str, ...]) -> DataFrame:
    """Samples of some metrics, from the collectors that make them; a collector of several runs once."""
    if metrics == ("up",):
        return to_samples(cluster.cluster_up(t), [registry.UP], ts="start_ts")
    parts = []
    for spec in registry.COLLECTORS:
        chosen = [m for m in spec.metrics if m.full_name("") in metrics]
        if not chosen:
            continue
        tables: dict[str, DataFrame] = {n: t[n] for n in spec.inputs if n not in ("cluster_facts", "stat_replication")}
        if "activity" in spec.inputs or "locks" in spec.inputs:
            tables["snapshots"] = t["event_snapshots"]
        if spec.name == "cluster_state":
            tables = {**_replication(t), "cluster_facts": t["hourly_facts"]}
        elif spec.collector == "replication_monitor":
            tables = _replication(t)
        parts.append(to_samples(spec.build(tables), chosen))
    return reduce(DataFrame.unionByName, parts)


def _panel(key: str) -> Callable[[Inputs], DataFrame]:
    p = panels.panel(key)

    def build(t: Inputs) -> DataFrame:
        samples = _metric_sources(t, panels.panel_metrics(p))
        out = panels.run_panel(samples, p, panel_window(p), PANEL_VARIABLES)
        if p.kind in ("stat", "gauge"):
            out = out.withColumn("labels", labels_text())
        if any(x.sum_by or x.aggregate == "avg" for x in p.targets):
            out = _rounded(out, value=6)
        if key == "dbhealth_avg_dead_ratio":
            out = _rounded(out, value=9)
        # The text of an unmapped number is engine-specific in its last digits.
        return out if p.texts else out.drop("text")

    return build


def _legend(key: str) -> Callable[[Inputs], DataFrame]:
    p = panels.panel(key)

    def build(t: Inputs) -> DataFrame:
        samples = _metric_sources(t, panels.panel_metrics(p))
        out = panels.legend_values(samples, p, panel_window(p), variables=PANEL_VARIABLES)
        return _rounded(out, **{c: 6 for c in ("sum", "mean") if c in p.calcs})

    return build


_COLLECT.update({f"panel_{p.key}": _panel(p.key) for p in panels.PANELS})
_COLLECT.update({f"legend_{p.key}": _legend(p.key) for p in panels.PANELS if p.calcs})


def all_queries() -> dict[str, Query]:
    def bind(build: Callable[[Inputs], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(Inputs(spark, sf_dir))

    return {name: bind(build) for name, build in _COLLECT.items()}
