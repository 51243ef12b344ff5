"""Absences as intervals against absences written out; entities as they stood at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import absences, lifecycle, series
from fleetlens.plans.samples import MetricSpec, to_samples

METRICS = [MetricSpec("a", "a", (("host", "host"),)), MetricSpec("b", "b", (("host", "host"),))]


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(4)
    rows, times = [], []
    for c in ("c0", "c1"):
        for k in range(40):
            at = f"2024-01-{1 + k // 8:02d} {(k % 8) * 3:02d}:{rng.randrange(60):02d}:00"
            times.append((c, at))
            if k != 7:  # a snapshot without any entity
                rows += [(c, at, f"h{i}", float(k), float(i)) for i in range(6) if rng.random() < 0.6]
    typed = F.col("snapshot_ts").cast("timestamp")
    entities = spark.createDataFrame(rows, "cluster string, snapshot_ts string, host string, a double, b double").withColumn("snapshot_ts", typed)
    return entities, spark.createDataFrame(times, "cluster string, snapshot_ts string").withColumn("snapshot_ts", typed)


def values(df):
    rows = df.select("cluster", F.col("ts").cast("string").alias("ts"), "metric", F.col("labels")["host"].alias("host"), "value").collect()
    out = {(r.cluster, r.ts, r.metric, r.host): "nan" if math.isnan(r.value) else r.value for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("policy", ["nan", "zero", "remove"])
@pytest.mark.parametrize("step, lookback", [(3600, 4 * 3600), (7 * 3600, 3600), (86400, 2 * 86400)])
def test_intervals_equal_written_absences(history, policy, step, lookback):
    entities, snapshots = history
    start, end = "2024-01-02 01:00:00", "2024-01-04 20:00:00"
    intervals = absences.absence_intervals(entities, ["host"], {"fleet_a": policy, "fleet_b": policy}, [("host", "host")], snapshots)
    got = absences.range_with_absences(to_samples(entities, METRICS), intervals, snapshots, start, end, step, lookback)
    written = to_samples(lifecycle.absent_policy(entities, ["host"], ["a", "b"], policy, snapshots), METRICS)
    assert values(got) == values(series.range_select(written, start, end, step, lookback))
    at = "2024-01-03 10:30:00"
    one = absences.instant_with_absences(to_samples(entities, METRICS), intervals, snapshots, at, lookback)
    assert values(one) == values(series.instant_select(written, at, lookback))


def test_rows_follow_the_absences_and_not_the_snapshots(spark):
    """An entity that is gone for 500 snapshots is one row."""
    times = [("c", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00") for i in range(502)]
    typed = F.col("snapshot_ts").cast("timestamp")
    snapshots = spark.createDataFrame(times, "cluster string, snapshot_ts string").withColumn("snapshot_ts", typed)
    seen = spark.createDataFrame([("c", times[0][1], "h", 1.0), ("c", times[501][1], "h", 2.0)], "cluster string, snapshot_ts string, host string, a double")
    intervals = absences.absence_intervals(seen.withColumn("snapshot_ts", typed), ["host"], {"m": "nan"}, [("host", "host")], snapshots)
    found = intervals.select(F.col("from_ts").cast("string"), F.col("until_ts").cast("string")).collect()
    assert [tuple(r) for r in found] == [(times[1][1], times[500][1])]


def test_entities_at_any_time(history):
    entities, snapshots = history
    marked = snapshots.withColumn("ok", F.minute("snapshot_ts") % 3 != 0)
    intervals = lifecycle.good_intervals(marked)
    assert intervals.count() == marked.filter("ok").count()
    times = snapshots.select("cluster", F.col("snapshot_ts").alias("ts"))
    got, want = (sorted(map(tuple, x.select("cluster", "snapshot_ts", "source_ts", "host", "a").collect())) for x in (
        lifecycle.entities_at(entities, intervals, times), lifecycle.carry_forward(entities, marked)))
    assert got == want and got
    few = times.limit(3)
    assert {r.snapshot_ts for r in lifecycle.entities_at(entities, intervals, few).collect()} <= {r.ts for r in few.collect()}
