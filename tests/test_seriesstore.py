"""The series store: matchers on its postings, samples by number, all panels as over a plain history."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import series
from fleetlens.plans import panels
from fleetlens.sources.seriesstore import SeriesStore, SharedNumber
from fleetlens.suite.queries import MONTH, PANEL_VARIABLES, Inputs, _metric_sources

FIELDS = "cluster string, ts timestamp, metric string, labels map<string,string>, value double"
END = "2024-01-01 00:10:00"


def make(spark, rows):
    typed = "cluster string, ts string, metric string, labels map<string,string>, value double"
    return spark.createDataFrame(rows, typed).withColumn("ts", F.col("ts").cast("timestamp"))


def some_rows():
    rows = []
    for i in range(60):
        labels = {"host": f"h{i % 7}", "role": "pm"[i % 2]} if i % 5 else {"host": f"h{i % 7}"}
        if i % 11 == 0:
            labels = {}
        for k in range(3):
            rows.append((f"c{i % 3}", f"2024-01-01 00:0{k}:{i % 60:02d}", ("up", "down")[i % 4 == 0], labels, float(i + k)))
    rows.append(("c0", END, "up", {"a": "1,1:b", "x": "y"}, 1.0))
    rows.append(("c0", END, "up", {"a": "1", "b": "x,1:x:1:y"}, 2.0))
    rows.append(("c0", END, "up", {"role": ""}, 3.0))
    return list({(c, t, m, tuple(sorted(l.items()))): (c, t, m, l, v) for c, t, m, l, v in rows}.values())


def found(df):
    labels = F.array_sort(F.map_entries("labels")).cast("string")
    return Counter(map(tuple, df.select("cluster", F.col("ts").cast("string"), "metric", labels, "value").collect()))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    made = SeriesStore(spark, str(tmp_path_factory.mktemp("store")))
    rows = some_rows()
    made.append(make(spark, rows[: len(rows) // 2]))
    made.append(make(spark, rows[len(rows) // 2 :]))
    return made


@pytest.mark.parametrize("most_ids", [1024, 2])
@pytest.mark.parametrize(
    "matchers", [{}, {"host": "h[12]"}, {"role": "p|"}, {"role": ""}, {"role": ".+"}, {"cluster": "c1", "host": ".*"}, {"absent": ""}, {"absent": "x"}, {"host": "h1|h2", "role": "p"}]
)
def test_selection_is_that_of_the_plain_history(spark, store, matchers, most_ids):
    plain = make(spark, some_rows())
    asked = SeriesStore(spark, store.path, most_ids=most_ids)
    for metrics in (["up"], ["up", "down"], ["none"]):
        want = series.match_labels(plain.filter(F.col("metric").isin(*metrics)), matchers)
        assert found(asked.select(metrics, matchers)) == found(want)


@pytest.mark.parametrize("matchers", [{}, {"role": "p"}, {"cluster": "c[01]", "host": "h[0-3]"}])
def test_label_values_read_no_samples(spark, store, matchers):
    plain = make(spark, some_rows())
    for name in ("host", "role", "cluster", "absent"):
        got, want = store.label_values(name, "up", matchers), series.label_values(plain, name, "up", matchers)
        assert [r.label_value for r in got.collect()] == [r.label_value for r in want.collect()]
        assert "/data" not in got._jdf.queryExecution().executedPlan().toString()


def test_numbers_reach_the_scan(spark, store):
    chosen = store.select(["up"], {"host": "h3"})
    instant = series.instant_select(chosen, END, 3600)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    scan = next(x for x in instant._jdf.queryExecution().explainString(mode).split("\n\n") if "/data]" in x)
    pushed, folders = (next(line for line in scan.splitlines() if line.startswith(head)) for head in ("PushedFilters", "PartitionFilters"))
    assert "series_id" in pushed and "GreaterThan(ts," in pushed and "date" in folders and "metric" in folders


def test_an_append_adds_no_series_twice(spark, store):
    before = store.series().count()
    again = SeriesStore(spark, store.path)
    fresh = again.series().groupBy("series_id").count()
    assert before == fresh.count() and fresh.filter("count > 1").isEmpty()
    distinct = {(c, m, tuple(sorted(l.items()))) for c, _, m, l, _ in some_rows()}
    assert before == len(distinct)


def test_shared_numbers_are_refused(spark, tmp_path, monkeypatch):
    made = SeriesStore(spark, str(tmp_path / "shared"))
    monkeypatch.setattr(SeriesStore, "number", lambda self: F.lit(7).cast("long"))
    with pytest.raises(SharedNumber):
        made.append(make(spark, some_rows()))
    assert made.series().isEmpty()


@pytest.mark.parametrize("key", ["overview_active_queries", "overview_connection_usage", "overview_segment_status", "dbhealth_top_dead_ratio", "replication_segment_table"])
def test_panels_through_the_store(spark, sf_dir, tmp_path, key):
    keys = [p.key for p in panels.PANELS]
    p = panels.panel(key if key in keys else keys[0])
    t = Inputs(spark, sf_dir)
    samples = _metric_sources(t, panels.panel_metrics(p))
    store = SeriesStore(spark, str(tmp_path / "panel"))
    store.append(samples)
    one, two = (panels.run_panel(x, p, MONTH, PANEL_VARIABLES) for x in (samples, store))
    if "labels" in one.columns:
        one, two = (x.withColumn("labels", F.array_sort(F.map_entries("labels")).cast("string")) for x in (one, two))
    assert Counter(map(repr, one.select(*sorted(one.columns)).collect())) == Counter(map(repr, two.select(*sorted(one.columns)).collect()))


def test_dashboards_open_with_their_range(spark, store):
    window = panels.default_window("dbhealth", "2024-01-01 03:00:00")
    assert (window.start, window.end) == ("2024-01-01 00:00:00", "2024-01-01 03:00:00")
    plain = make(spark, some_rows())
    got = [[r.label_value for r in panels.variable_values(x, "host", "up", {"cluster": "c2"}).collect()] for x in (plain, store)]
    assert got[0] == got[1] and got[0]
