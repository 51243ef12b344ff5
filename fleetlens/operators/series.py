"""Time-series operators over ``samples(cluster, ts, metric, labels, value)``.

A series is (cluster, metric, labels) and has at most one sample per instant. Label maps are grouped through their sorted entries, which is exact for any
labels. The cluster is a column and is treated as one more label by the matchers.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

LOOKBACK_SECONDS = 300
_PLAIN_NAMES = re.compile(r"[\w-]+(\|[\w-]+)*")
_SERIES = ("cluster", "metric", "_labels")


def label(name: str) -> Column:
    """Value of a label; a missing label is the empty string. The metric's name is the label ``__name__``."""
    if name == "__name__":
        return F.col("metric")
    return F.col("cluster") if name == "cluster" else F.coalesce(F.col("labels")[name], F.lit(""))


def label_key(labels: Column | str = "labels") -> Column:
    """Labels as sorted entries: can be grouped, joined and ordered, unlike a map."""
    return F.array_sort(F.map_entries(labels))


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_labels", label_key())


def _from_key(df: DataFrame, *rest: str) -> DataFrame:
    return df.select("cluster", "metric", F.map_from_entries("_labels").alias("labels"), *rest)


def matches_all(pattern: str) -> bool:
    return pattern in (".*", "$__all")


def label_test(value: Column, pattern: str) -> Column:
    """Whether a label value matches an anchored pattern. Plain names become a list test, which can reach a scan."""
    if _PLAIN_NAMES.fullmatch(pattern):
        return value.isin(pattern.split("|"))
    return value.rlike(rf"(?s)\A(?:{pattern})\z")


def match_labels(samples: DataFrame, matchers: Mapping[str, str] | None = None, metric: str | None = None) -> DataFrame:
    """Keep a metric and the series whose labels match anchored regular expressions (``.*`` matches all).

    A pattern has to match the whole value, line breaks included, and ``.`` stands for any character.

    Plain names, alone or separated by ``|``, become a list test, which reaches the scan for the cluster column.
    """
    out = samples if metric is None else samples.filter(F.col("metric") == metric)
    for name, pattern in (matchers or {}).items():
        if not matches_all(pattern):
            out = out.filter(label_test(label(name), pattern))
    return out


def _within(samples: DataFrame, after: Column, until: Column, closed: bool = False) -> DataFrame:
    """Samples in ``(after, until]``, or ``[after, until]`` when closed.

    History tables are foldered by ``date``; the same bounds on it leave other folders unread.
    """
    low = F.col("ts") >= after if closed else F.col("ts") > after
    kept = samples.filter(low & (F.col("ts") <= until))
    if "date" in samples.columns:
        kept = kept.filter((F.col("date") >= after.cast("date")) & (F.col("date") <= until.cast("date")))
    return kept


def time_range(samples: DataFrame, end: dt.datetime | str, seconds: int) -> DataFrame:
    """Samples of the last ``seconds`` up to ``end``. Plain bounds on ``ts``, so they reach the scan."""
    stop = F.lit(end).cast("timestamp")
    return _within(samples, stop - F.make_dt_interval(secs=F.lit(seconds)), stop, closed=True)


def instant_select(samples: DataFrame, at: dt.datetime | str, lookback_seconds: int = LOOKBACK_SECONDS) -> DataFrame:
    """Latest sample of each series in ``(at - lookback, at]``.

    ``max_by`` over plain columns keeps its state in fixed-width buffers, so this is a hash aggregation.
    """
    stop = F.lit(at).cast("timestamp")
    start = stop - F.make_dt_interval(secs=F.lit(lookback_seconds))
    latest = (
        _with_key(_within(samples, start, stop))
        .groupBy(*_SERIES)
        .agg(F.max_by("value", "ts").alias("value"))
    )
    return _from_key(latest, stop.alias("ts"), "value")


def _floor_div(dividend: Column, divisor: int) -> Column:
    """Whole-number division toward minus infinity, exact in longs."""
    by = F.lit(divisor).cast("long")
    return F.call_function("div", dividend - F.pmod(dividend, by), by)


def range_select(
    samples: DataFrame,
    start: dt.datetime | str,
    end: dt.datetime | str,
    step_seconds: int,
    lookback_seconds: int = LOOKBACK_SECONDS,
) -> DataFrame:
    """:func:`instant_select` at ``start, start + step, …, end`` in one pass.

    Samples are first reduced to the latest per series and step, which combines on the map side and leaves at most one
    row per series and step of the range. Each of those is then held until the series' next row or until its lookback
    ends, so a sample is never copied into steps it does not decide.
    """
    to_us = 1_000_000
    step, hold = step_seconds * to_us, lookback_seconds * to_us
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    first_us = F.unix_micros(first)
    last_step = _floor_div(F.unix_micros(last) - first_us, step)
    since_us = F.unix_micros("ts") - first_us
    # Number of the first step at or after the sample; samples before the range fall on step 0.
    step_no = F.greatest(_floor_div(since_us + (step - 1), step), F.lit(0).cast("long"))
    # Last step that still sees a sample: strictly less than lookback later.
    reach = _floor_div(since_us + (hold - 1), step)
    in_range = _within(samples, first - F.make_dt_interval(secs=F.lit(lookback_seconds)), last)
    reduced = (
        _with_key(in_range)
        .withColumn("_step", step_no)
        .groupBy(*_SERIES, "_step")
        .agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    )
    following = F.lead("_step").over(Window.partitionBy(*_SERIES).orderBy("_step"))
    until = F.least(F.coalesce(following - 1, last_step), reach, last_step)
    spread = (
        reduced.withColumn("_until", until)
        .filter(F.col("_until") >= F.col("_step"))
        .withColumn("_at", F.explode(F.sequence("_step", "_until")))
    )
    at = F.timestamp_micros(first_us + F.col("_at") * F.lit(step))
    return _from_key(spread, at.alias("ts"), "value")


def prefer(vector: DataFrame, other: DataFrame) -> DataFrame:
    """The samples of both vectors; where both have one for a series and instant, that of ``other``."""
    both = vector.select(*other.columns).withColumn("_rank", F.lit(0)).unionByName(other.withColumn("_rank", F.lit(1)))
    chosen = _with_key(both).groupBy(*_SERIES, "ts").agg(F.max_by("value", "_rank").alias("value"))
    return _from_key(chosen, "ts", "value")


def topk_series(vector: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` largest samples of each instant, NaN last, ties by labels. Plans as a group limit before the shuffle."""
    rank = Window.partitionBy("ts", *by).orderBy(
        F.desc(F.nanvl("value", F.lit(float("-inf")))), F.isnan("value"), "cluster", "metric", "_labels"
    )
    ranked = _with_key(vector).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return ranked.select("cluster", "ts", "metric", "labels", "value", "rank")


def sum_by_label(vector: DataFrame, *names: str) -> DataFrame:
    """Sum at each instant by the given labels (all other labels are dropped)."""
    return vector.groupBy("ts", *[label(n).alias(n) for n in names]).agg(F.sum("value").alias("value"))


def avg_series(vector: DataFrame) -> DataFrame:
    return vector.groupBy("ts").agg(F.avg("value").alias("value"))


def min_series(vector: DataFrame) -> DataFrame:
    """Smallest value at each instant. NaN counts only when nothing else is there."""
    return vector.groupBy("ts").agg(
        F.coalesce(F.min(F.when(~F.isnan("value"), F.col("value"))), F.lit(float("nan"))).alias("value")
    )


def vector_ratio_pct(numerator: DataFrame, denominator: DataFrame) -> DataFrame:
    """``a / b * 100`` of series with equal labels at equal instants; the metric name plays no part.

    Division by zero follows IEEE arithmetic: 0/0 is NaN, x/0 is infinite.
    """
    keys = ["cluster", "ts", "_labels"]
    a = _with_key(numerator).select(*keys, "labels", F.col("value").alias("_a"))
    b = _with_key(denominator).select(*keys, F.col("value").alias("_b"))
    zero = F.col("_b") == 0
    ieee = (
        F.when(zero & (F.isnan("_a") | (F.col("_a") == 0)), F.lit(float("nan")))
        .when(zero, F.signum("_a") * F.lit(float("inf")))
        .otherwise(F.try_divide("_a", "_b"))
    )
    return a.join(b, keys).select("cluster", "ts", "labels", (ieee * 100).alias("value"))


def connection_usage_pct(samples: DataFrame, total: str, limit: str) -> DataFrame:
    """Connections in percent of the maximum, per cluster and instant."""
    return vector_ratio_pct(match_labels(samples, metric=total), match_labels(samples, metric=limit))


COMPARISONS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def compare_filter(vector: DataFrame, op: str, bound: float) -> DataFrame:
    """Samples for which the comparison holds. NaN compares false (and true for ``!=``), unlike Spark's ordering."""
    test = COMPARISONS[op](F.col("value"), F.lit(float(bound)))
    nan = F.isnan("value")
    return vector.filter((test | nan) if op == "!=" else (test & ~nan))


def label_values(samples: DataFrame, name: str, metric: str | None = None, matchers: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct values of a label, sorted; series without the label do not count."""
    chosen = match_labels(samples, matchers, metric)
    return chosen.select(label(name).alias("label_value")).filter(F.col("label_value") != "").distinct().orderBy("label_value")


REDUCERS = ("lastNotNull", "last", "max", "mean", "min", "sum")


def reduce_series(samples: DataFrame, reducers: Sequence[str] = REDUCERS) -> DataFrame:
    """One row per series. All reducers but ``last`` pass over NaN; a series of nothing but NaN gives NULL."""
    number = F.when(~F.isnan("value"), F.col("value"))
    aggregates = {
        "lastNotNull": F.max_by("value", F.when(number.isNotNull(), F.col("ts"))),
        "last": F.max_by("value", "ts"),
        "max": F.max(number),
        "mean": F.avg(number),
        "min": F.min(number),
        "sum": F.sum(number),
    }
    reduced = _with_key(samples).groupBy(*_SERIES).agg(*[aggregates[r].alias(r) for r in reducers])
    return _from_key(reduced, *reducers)


def threshold_band(df: DataFrame, steps: Sequence[tuple[str, float | None]], value: str = "value", out: str = "band") -> DataFrame:
    """Colour of the last step whose bound the value reaches; the first step has no bound."""
    band = F.lit(steps[0][0])
    number = F.when(~F.isnan(value), F.col(value))
    chain = None
    for colour, bound in reversed(steps[1:]):
        test = number >= F.lit(float(bound))
        chain = F.when(test, F.lit(colour)) if chain is None else chain.when(test, F.lit(colour))
    return df.withColumn(out, band if chain is None else chain.otherwise(band))


def organize_columns(df: DataFrame, columns: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Result table of a panel: labels become columns in the given order, without the excluded ones."""
    special = {"Time": F.col("ts"), "Value": F.col("value"), "__name__": F.col("metric")}
    kept = [c for c in columns if c not in set(exclude)]
    return df.select(*[special.get(c, label(c)).alias(c) for c in kept])


def legend(template: str) -> Column:
    """Text of a ``{{label}}`` template."""
    parts: list[Column] = []
    for piece in template.split("{{"):
        if "}}" in piece:
            name, rest = piece.split("}}", 1)
            parts.append(label(name.strip()))
            if rest:
                parts.append(F.lit(rest))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def external_label(samples: DataFrame, **labels: str) -> DataFrame:
    """Attach static labels; ``cluster`` sets the cluster column. Labels a sample already has stay."""
    out = samples
    if "cluster" in labels:
        out = out.withColumn("cluster", F.lit(labels["cluster"]))
    rest = {k: v for k, v in labels.items() if k != "cluster"}
    if rest:
        static = F.create_map(*[F.lit(x) for pair in rest.items() for x in pair])
        missing = F.map_filter(static, lambda k, _: ~F.array_contains(F.map_keys("labels"), k))
        out = out.withColumn("labels", F.map_concat("labels", missing))
    return out
