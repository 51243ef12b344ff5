"""Dashboard panels as named recipes over the sample history.

A recipe is data: which metrics, which label filters, what is done at each instant, how a range becomes one number, and
which colour and text a number gets: a number that is mapped to a text takes the colour of that text, any other one the colour
of its threshold step. ``calcs`` are the figures next to the legend of a line. :func:`run_panel` composes the series operators from it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.scalars import value_text
from fleetlens.operators import series
from fleetlens.plans.samples import label_map
from fleetlens.sources.seriesstore import SeriesStore


@dataclass(frozen=True)
class Target:
    """One query of a panel. ``filters`` are (label, variable) pairs; ``per`` divides by a second metric."""

    metric: str
    legend: str = ""
    filters: tuple[tuple[str, str], ...] = ()
    above: float | None = None
    top: bool = False
    sum_by: tuple[str, ...] = ()
    aggregate: str = ""
    per: str = ""


@dataclass(frozen=True)
class Panel:
    key: str
    kind: str
    targets: tuple[Target, ...]
    bands: tuple[tuple[str, float | None], ...] = (("green", None),)
    texts: tuple[tuple[float, str, str], ...] = ()
    calcs: tuple[str, ...] = ()
    reducer: str = "lastNotNull"
    columns: tuple[str, ...] = ()
    order_by: tuple[str, bool] = ("Value", True)


# Metric names, label filters, legends, colour steps and texts of the dashboards.
_C = (("cluster", "cluster"),)
_DB = (("cluster", "cluster"), ("datname", "database"))
_TABLES = (("cluster", "cluster"), ("database", "database"), ("schema", "schema"))
_SEGMENTS = (("cluster", "cluster"), ("hostname", "hostname"), ("role", "role"))
_SHIPPERS = (("cluster", "cluster"), ("host", "hostname"))
_UP_DOWN = ((0, "DOWN", "red"), (1, "UP", "green"))
_BLOAT = ((0, "No Bloat", "green"), (1, "Moderate", "yellow"), (2, "Severe", "red"))
_SYNC = ((0, "Unknown", "red"), (0.5, "Potential", "yellow"), (1, "Async", "orange"), (2, "Sync", "green"))
_LAST = ("last",)
_LAST_MAX = ("last", "max")
_LAG = (("green", None), ("yellow", 1048576), ("red", 10485760))
_AGE = (("green", None), ("yellow", 86400), ("red", 604800))
_RATIO = (("green", None), ("yellow", 0.1), ("red", 0.3))
_BLOAT_BANDS = (("green", None), ("yellow", 1), ("red", 2))
_SKEW = (("green", None), ("yellow", 1.5), ("red", 2))
_TABLE_LEGEND = "{{database}}.{{schema}}.{{table}}"
_SEGMENT_LEGEND = "{{cluster}} - {{hostname}}:{{port}} (content={{content}})"
_SHIPPER_LEGEND = "{{cluster}} - {{host}} content={{content}} ({{application_name}})"


def _stat(key: str, metric: str, filters=_C, **more) -> Panel:
    aggregate = more.pop("aggregate", "")
    return Panel(key, "stat", (Target(metric, filters=filters, aggregate=aggregate),), **more)


def _lines(key: str, *targets: Target, **more) -> Panel:
    return Panel(key, "timeseries", targets, **more)


PANELS: tuple[Panel, ...] = (
    # cluster overview
    _stat("overview_cluster_status", "up", bands=(("red", None), ("green", 1)), texts=_UP_DOWN),
    _stat("overview_cluster_uptime", "cluster_uptime_seconds"),
    _stat("overview_total_databases", "server_database_count"),
    _stat("overview_total_database_size", "host_total_database_size_mb"),
    Panel(
        "overview_connection_usage", "gauge",
        (Target("cluster_connections_all_states_total", filters=_C, per="cluster_max_connections"),),
        bands=(("green", None), ("yellow", 70), ("orange", 85), ("red", 95)),
    ),
    _stat("overview_locked_sessions", "server_locked_sessions_total", bands=(("green", None), ("yellow", 1), ("red", 5))),
    _stat("overview_total_segments", "cluster_segments_total"),
    _stat("overview_segments_up", "cluster_segments_up"),
    _stat("overview_segments_down", "cluster_segments_down", bands=(("green", None), ("red", 1))),
    _lines(
        "overview_segment_status",
        Target("cluster_segment_status", "{{hostname}}:{{port}} (content={{content}}, role={{role}})", _C), calcs=_LAST_MAX,
    ),
    _lines("overview_connections_by_state", Target("cluster_connections_total", "{{state}}", _C), calcs=_LAST_MAX),
    _lines(
        "overview_query_activity",
        Target("query_active_queries_total", "Total Active Queries", _C),
        Target("query_active_queries_slow", "Slow Queries (>180s)", _C),
        Target("cluster_query_waiting_count", "Waiting for Locks", _C),
        bands=(("green", None), ("yellow", 5), ("red", 10)), calcs=_LAST_MAX,
    ),
    _lines("overview_query_duration", Target("query_active_queries_duration_bucket", "{{bucket}}", _C), calcs=_LAST),
    _lines("overview_replication_lag", Target("cluster_replication_lag_bytes", "{{host}} content={{content}}", _C), bands=_LAG, calcs=_LAST_MAX),
    _stat("overview_max_replication_lag", "cluster_replication_max_lag_bytes", bands=_LAG),
    # database health
    _stat("dbhealth_vacuum_running", "server_vacuum_running", bands=(("green", None), ("yellow", 1)), texts=((0, "Not Running", "green"), (1, "Running", "yellow"))),
    _stat("dbhealth_max_vacuum_age", "database_db_max_seconds_since_last_vacuum", _DB, bands=_AGE),
    _stat("dbhealth_max_dead_ratio", "database_db_max_dead_tuple_ratio", _DB, bands=_RATIO),
    _stat("dbhealth_avg_dead_ratio", "database_db_avg_dead_tuple_ratio", _DB, bands=(("green", None), ("yellow", 0.05), ("red", 0.2))),
    Panel(
        "dbhealth_oldest_vacuums", "table",
        (Target("database_table_seconds_since_last_vacuum", filters=_TABLES, top=True),), bands=_AGE,
        columns=("database", "schema", "table", "Value"),
    ),
    _lines(
        "dbhealth_vacuum_counts",
        Target("database_table_vacuum_count", "{{database}} - Manual Vacuum", _TABLES, sum_by=("database",)),
        Target("database_table_autovacuum_count", "{{database}} - Auto Vacuum", _TABLES, sum_by=("database",)),
        calcs=("last", "sum"),
    ),
    _lines("dbhealth_top_dead_ratio", Target("database_table_dead_tuple_ratio", _TABLE_LEGEND, _TABLES, top=True), calcs=_LAST_MAX),
    _lines("dbhealth_bloat_state", Target("server_table_bloat_state", _TABLE_LEGEND, _TABLES, above=0), bands=_BLOAT_BANDS, texts=_BLOAT, calcs=_LAST),
    _lines("dbhealth_top_skew", Target("server_table_skew_factor", _TABLE_LEGEND, _TABLES, above=1.5, top=True), bands=_SKEW, calcs=_LAST_MAX),
    Panel(
        "dbhealth_bloated_tables", "table", (Target("server_table_bloat_state", filters=_TABLES, above=0),),
        bands=_BLOAT_BANDS, texts=_BLOAT, columns=("database", "schema", "table", "Value"),
    ),
    Panel(
        "dbhealth_skewed_tables", "table", (Target("server_table_skew_factor", filters=_TABLES, top=True),),
        bands=_SKEW, columns=("database", "schema", "table", "Value"),
    ),
    # replication and segments
    _stat("replication_total_segments", "cluster_segments_total"),
    _stat("replication_segments_up", "cluster_segments_up"),
    _stat("replication_segments_down", "cluster_segments_down", bands=(("green", None), ("red", 1))),
    _stat("replication_sync_replicas", "cluster_sync", bands=(("red", None), ("green", 1)), texts=((0, "No Sync", "red"), (1, "Synced", "green"))),
    _lines(
        "replication_segment_status",
        Target("cluster_segment_status", "{{cluster}} - {{hostname}}:{{port}} (content={{content}}, role={{role}})", _SEGMENTS),
        texts=_UP_DOWN, calcs=_LAST,
    ),
    _lines("replication_segment_role", Target("cluster_segment_role", _SEGMENT_LEGEND, _SEGMENTS), texts=((1, "Primary", "green"), (2, "Mirror", "blue")), calcs=_LAST),
    _lines(
        "replication_segment_mode", Target("cluster_segment_mode", _SEGMENT_LEGEND, _SEGMENTS),
        bands=(("green", None), ("yellow", 2), ("orange", 3), ("red", 4)),
        texts=((1, "Synchronized", "green"), (2, "Resyncing", "yellow"), (3, "Change Tracking", "orange"), (4, "Not Syncing", "red")),
        calcs=_LAST,
    ),
    _stat("replication_max_lag_now", "cluster_replication_max_lag_bytes", bands=_LAG),
    _stat(
        "replication_avg_lag", "cluster_replication_lag_bytes", aggregate="avg", reducer="mean",
        bands=(("green", None), ("yellow", 524288), ("red", 5242880)),
    ),
    _stat("replication_min_sync_state", "cluster_replication_sync_state", aggregate="min", reducer="min", texts=_SYNC),
    _lines(
        "replication_lag_details",
        Target("cluster_replication_lag_bytes", "{{cluster}} - Replay Lag - {{host}} content={{content}}", _SHIPPERS),
        Target("cluster_replication_write_lag_bytes", "{{cluster}} - Write Lag - {{host}} content={{content}}", _SHIPPERS),
        Target("cluster_replication_flush_lag_bytes", "{{cluster}} - Flush Lag - {{host}} content={{content}}", _SHIPPERS),
        bands=_LAG, calcs=("last", "max", "mean"),
    ),
    _lines(
        "replication_state", Target("cluster_replication_state", _SHIPPER_LEGEND, _SHIPPERS),
        texts=((0, "Unknown", "red"), (1, "Streaming", "green"), (2, "Catchup", "yellow"), (3, "Backup", "blue")), calcs=_LAST,
    ),
    _lines("replication_sync_state", Target("cluster_replication_sync_state", _SHIPPER_LEGEND, _SHIPPERS), texts=_SYNC, calcs=_LAST),
    Panel(
        "replication_segment_table", "table", (Target("cluster_segment_status", filters=_SEGMENTS),), texts=_UP_DOWN,
        columns=("cluster", "hostname", "content", "port", "role", "Value"), order_by=("content", False),
    ),
)

# How far back a dashboard looks, and the choices of its top-k variable.
RANGE_SECONDS = {"overview": 3600, "dbhealth": 10800, "replication": 3600}
TOP_CHOICES = (5, 10, 20, 50)
TOP_DEFAULT = 10
ALL = ".*"


@dataclass(frozen=True)
class Window:
    """Time range of a panel run."""

    start: str
    end: str
    step_seconds: int = 15
    lookback_seconds: int = series.LOOKBACK_SECONDS


def panel(key: str) -> Panel:
    return next(p for p in PANELS if p.key == key)


def panel_metrics(p: Panel) -> tuple[str, ...]:
    return tuple(dict.fromkeys(m for t in p.targets for m in (t.metric, t.per) if m))


def _chosen(samples: DataFrame | SeriesStore, metrics: list[str], filters: Mapping[str, str]) -> DataFrame:
    """Samples of some metrics whose labels match, from a plain history or through the index of a store."""
    if isinstance(samples, SeriesStore):
        return samples.select(metrics, filters)
    return series.match_labels(samples.filter(F.col("metric").isin(*metrics)), filters)


def _bare(df: DataFrame, metric: str, labels: tuple[str, ...] = ()) -> DataFrame:
    """An aggregated vector in sample form; labels that were aggregated away are gone."""
    kept = [x for x in labels if x != "cluster"]
    owner = F.col("cluster") if "cluster" in labels else F.lit("")
    return df.select(
        owner.alias("cluster"), "ts", F.lit(metric).alias("metric"), label_map([(x, x) for x in kept]).alias("labels"), "value"
    )


def target_vector(
    samples: DataFrame | SeriesStore, target: Target, window: Window, variables: Mapping[str, str], top: int, namespace: str, instant: bool
) -> DataFrame:
    """Value of a target at every instant of the window (only at its end with ``instant``)."""

    def select(metric: str) -> DataFrame:
        filters = {name: variables.get(variable, ALL) for name, variable in target.filters}
        chosen = _chosen(samples, [f"{namespace}_{metric}"], filters)
        if instant:
            return series.instant_select(chosen, window.end, window.lookback_seconds)
        return series.range_select(chosen, window.start, window.end, window.step_seconds, window.lookback_seconds)

    vector = select(target.metric)
    if target.per:
        ratio = series.vector_ratio_pct(vector, select(target.per))
        vector = ratio.select("cluster", "ts", F.lit("").alias("metric"), "labels", "value")
    if target.above is not None:
        vector = series.compare_filter(vector, ">", target.above)
    if target.sum_by:
        vector = _bare(series.sum_by_label(vector, *target.sum_by), target.metric, target.sum_by)
    if target.aggregate:
        fold = {"avg": series.avg_series, "min": series.min_series}[target.aggregate]
        vector = _bare(fold(vector), target.metric)
    if target.top:
        vector = series.topk_series(vector, top).drop("rank")
    return vector


def _one_pass(p: Panel) -> bool:
    """Targets that differ in metric and legend alone can share one selection."""
    shapes = {(t.filters, t.above, t.sum_by) for t in p.targets}
    return len(p.targets) > 1 and len(shapes) == 1 and not any(t.top or t.per or t.aggregate for t in p.targets)


def _lines_in_one_pass(
    samples: DataFrame | SeriesStore, p: Panel, window: Window, variables: Mapping[str, str], namespace: str
) -> DataFrame:
    """All lines of such a panel from one scan and one reduction of the history."""
    names = {f"{namespace}_{t.metric}": t for t in p.targets}
    shape = p.targets[0]
    filters = {name: variables.get(variable, ALL) for name, variable in shape.filters}
    chosen = _chosen(samples, list(names), filters)
    vector = series.range_select(chosen, window.start, window.end, window.step_seconds, window.lookback_seconds)
    if shape.above is not None:
        vector = series.compare_filter(vector, ">", shape.above)
    if shape.sum_by:
        summed = series.sum_by_label(vector, "__name__", *shape.sum_by)
        owner = F.col("cluster") if "cluster" in shape.sum_by else F.lit("")
        kept = label_map([(x, x) for x in shape.sum_by if x != "cluster"])
        vector = summed.select(
            owner.alias("cluster"), "ts", F.col("__name__").alias("metric"), kept.alias("labels"), "value"
        )
    texts = [F.when(F.col("metric") == name, series.legend(t.legend)) for name, t in names.items()]
    return vector.select("cluster", "ts", F.coalesce(*texts).alias("legend"), "value")


def run_panel(
    samples: DataFrame | SeriesStore,
    p: Panel,
    window: Window,
    variables: Mapping[str, str] | None = None,
    top: int = TOP_DEFAULT,
    namespace: str = "fleet",
) -> DataFrame:
    """Result of a panel over a sample history or a :class:`~fleetlens.sources.seriesstore.SeriesStore`.

    ``stat`` and ``gauge``: one row per series, ``cluster, labels, value, band, text``. ``timeseries``:
    ``cluster, ts, legend, value, band, text``. ``table``: the panel's columns with ``band`` and ``text``, sorted.
    """
    variables = variables or {}
    texts = {number: text for number, text, _ in p.texts}

    def finish(df: DataFrame, value: str = "value") -> DataFrame:
        banded = series.threshold_band(df, p.bands, value)
        for number, _, colour in p.texts:
            banded = banded.withColumn("band", F.when(F.col(value) == number, F.lit(colour)).otherwise(F.col("band")))
        return banded.withColumn("text", value_text(value, texts))

    if p.kind == "timeseries" and _one_pass(p):
        return finish(_lines_in_one_pass(samples, p, window, variables, namespace))
    vectors = [
        (t, target_vector(samples, t, window, variables, top, namespace, instant=p.kind == "table")) for t in p.targets
    ]
    if p.kind == "timeseries":
        parts = [v.select("cluster", "ts", series.legend(t.legend).alias("legend"), "value") for t, v in vectors]
        return finish(reduce(DataFrame.unionByName, parts))
    vector = vectors[0][1]
    if p.kind == "table":
        column, descending = p.order_by
        table = finish(series.organize_columns(vector, p.columns), "Value")
        return table.orderBy(F.desc(column) if descending else F.asc(column))
    reduced = series.reduce_series(vector, (p.reducer,)).select("cluster", "labels", F.col(p.reducer).alias("value"))
    return finish(reduced)


def variable_values(samples: DataFrame | SeriesStore, name: str, metric: str, chosen: Mapping[str, str] | None = None) -> DataFrame:
    """Choices of a dashboard variable: the values of a label of a metric, given what other variables are set to."""
    if isinstance(samples, SeriesStore):
        return samples.label_values(name, metric, chosen)
    return series.label_values(samples, name, metric, chosen)


def default_window(dashboard: str, end: str, step_seconds: int = 15) -> Window:
    """The time range a dashboard opens with, up to ``end``."""
    start = dt.datetime.fromisoformat(end) - dt.timedelta(seconds=RANGE_SECONDS[dashboard])
    return Window(start.isoformat(" "), end, step_seconds)


def legend_values(samples: DataFrame | SeriesStore, p: Panel, window: Window, calcs: tuple[str, ...] | None = None, **options) -> DataFrame:
    """Figures shown next to each line's legend, by default those of the panel."""
    calcs = calcs or p.calcs
    lines = run_panel(samples, p, window, **options)
    as_series = lines.select(
        "cluster", "ts", F.lit(p.key).alias("metric"), F.create_map(F.lit("legend"), "legend").alias("labels"), "value"
    )
    return series.reduce_series(as_series, calcs).select("cluster", F.col("labels")["legend"].alias("legend"), *calcs)
