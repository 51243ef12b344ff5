"""Absent entities in range queries, without a row for every snapshot that misses them.

An entity that is gone shows NaN or 0 in every snapshot until it returns. Written out, that is a sample per snapshot and absent
entity; here it stays one interval per absence. A range query asks at each step for the latest snapshot of the cluster and finds
the absences that hold it in an interval join, bucketed by day, so what is read and written grows with the absences and
with the steps asked for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.ordered import snapshot_spine
from fleetlens.operators import series
from fleetlens.operators.lifecycle import absence_spans
from fleetlens.plans.samples import label_map

FILLS = {"nan": float("nan"), "zero": 0.0}


def absence_intervals(
    entities: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], labels: Sequence[tuple[str, str]], snapshots: DataFrame | None = None
) -> DataFrame:
    """``cluster, metric, labels, from_ts, until_ts, value``: one row per absence and metric.

    ``metrics`` names the policy of each metric (``nan`` or ``zero``; one of ``remove`` has no absences), ``labels`` the label and key
    column pairs. Both ends of an interval are snapshots that miss the entity.
    """
    shown = {m: FILLS[policy] for m, policy in metrics.items() if policy in FILLS}
    listed = entities if snapshots is None else snapshots
    times = snapshot_spine(listed).select("cluster", "idx", "snapshot_ts")
    spans = absence_spans(entities, keys, snapshots)
    for bound in ("from", "until"):
        at = times.select("cluster", F.col("idx").alias(f"{bound}_idx"), F.col("snapshot_ts").alias(f"{bound}_ts"))
        spans = spans.join(at, ["cluster", f"{bound}_idx"])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(v).alias("value")) for m, v in shown.items()])
    rows = rows if shown else F.array().cast("array<struct<metric:string,value:double>>")
    return spans.select("cluster", label_map(labels).alias("labels"), "from_ts", "until_ts", F.explode(rows).alias("_m")).select(
        "cluster", "_m.metric", "labels", "from_ts", "until_ts", "_m.value"
    )


def latest_snapshots(
    snapshots: DataFrame, start: dt.datetime | str, end: dt.datetime | str, step_seconds: int, lookback_seconds: int
) -> DataFrame:
    """``cluster, ts, seen_ts``: the latest snapshot of each cluster at each step, where one lies within the lookback."""
    times = snapshots.select("cluster", F.col("snapshot_ts").alias("ts")).distinct()
    marks = times.select(
        "cluster", "ts", F.lit("").alias("metric"), label_map([]).alias("labels"), F.unix_micros("ts").cast("double").alias("value")
    )  # microseconds of any date in use are whole doubles
    held = series.range_select(marks, start, end, step_seconds, lookback_seconds)
    return held.select("cluster", "ts", F.timestamp_micros(F.col("value").cast("long")).alias("seen_ts"))


def range_with_absences(
    samples: DataFrame,
    intervals: DataFrame,
    snapshots: DataFrame,
    start: dt.datetime | str,
    end: dt.datetime | str,
    step_seconds: int,
    lookback_seconds: int = series.LOOKBACK_SECONDS,
) -> DataFrame:
    """:func:`~fleetlens.operators.series.range_select` over present samples, as if each absence were written out.

    ``samples`` are those of present entities, taken at the snapshots. At a step whose latest snapshot lies in an absence the series
    shows the absence's value; its older sample would no longer be the latest.
    """
    present = series.range_select(samples, start, end, step_seconds, lookback_seconds)
    seen = latest_snapshots(snapshots, start, end, step_seconds, lookback_seconds)
    # Days outside of what the steps can see are left out before an interval is cut.
    first = F.to_date(F.lit(start).cast("timestamp") - F.make_dt_interval(secs=F.lit(lookback_seconds)))
    low = F.greatest(F.to_date("from_ts"), first)
    high = F.least(F.to_date("until_ts"), F.to_date(F.lit(end).cast("timestamp")))
    cut = intervals.withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    by_day = cut.select("cluster", "metric", "labels", "from_ts", "until_ts", "value", F.explode(F.sequence("_low", "_high")).alias("_day"))
    met = seen.withColumn("_day", F.to_date("seen_ts")).join(by_day, ["cluster", "_day"])
    gone = met.filter((F.col("from_ts") <= F.col("seen_ts")) & (F.col("seen_ts") <= F.col("until_ts")))
    return series.prefer(present, gone.select("cluster", "metric", "labels", "ts", "value"))


def instant_with_absences(
    samples: DataFrame, intervals: DataFrame, snapshots: DataFrame, at: dt.datetime | str, lookback_seconds: int = series.LOOKBACK_SECONDS
) -> DataFrame:
    """:func:`range_with_absences` at one instant."""
    return range_with_absences(samples, intervals, snapshots, at, at, 1, lookback_seconds)
