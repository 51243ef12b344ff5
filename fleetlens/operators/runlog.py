"""The collector's own run log: counters, durations, fail-fast, freshness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.functions.ordered import fill_forward, hour_chunk, running_sum
from fleetlens.functions.scalars import elapsed_s

# Default limits of the scrape loop.
CACHE_MAX_AGE_SECONDS = 30
FAILURE_THRESHOLD = 3


def scrape_staleness(
    requests: DataFrame, scrapes: DataFrame, max_age_seconds: float = CACHE_MAX_AGE_SECONDS
) -> DataFrame:
    """For each request the latest successful scrape at or before it, its age, and whether that is too old.

    As-of lookup without a range join: scrapes and requests are put on one time line per cluster and the last scrape
    is filled forward. ``requests`` has ``cluster, request_id, request_ts``.
    """
    ticks = scrapes.filter("successful").select(
        "cluster", F.lit(None).cast("long").alias("request_id"), F.col("start_ts").alias("_ts"), F.lit(0).alias("_side"),
        F.col("start_ts").alias("scrape_ts"),
    )
    asks = requests.select(
        "cluster", F.col("request_id").cast("long"), F.col("request_ts").alias("_ts"), F.lit(1).alias("_side"),
        F.lit(None).cast("timestamp").alias("scrape_ts"),
    )
    line = ticks.unionByName(asks)
    # Ties in the order do not matter: equal rows of one side carry the same scrape.
    filled = fill_forward(line, ["cluster"], ["_ts", "_side"], ["scrape_ts"], hour_chunk("_ts"))
    age = elapsed_s("_ts", "scrape_ts")
    return filled.filter(F.col("_side") == 1).select(
        "cluster",
        "request_id",
        F.col("_ts").alias("request_ts"),
        "scrape_ts",
        age.alias("age_seconds"),
        F.coalesce(age > F.lit(float(max_age_seconds)), F.lit(True)).alias("stale"),
    )


def collector_run_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Last duration (milliseconds) and error count of each collector."""
    return (
        tables["collector_run_log"]
        .groupBy("cluster", "collector")
        .agg(
            F.max_by("duration_ms", F.struct("start_ts", "scrape_id", "seq")).cast("double").alias("last_duration_ms"),
            F.count_if("failed").alias("errors"),
        )
    )


def scrape_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Scrapes started, errors (failed scrapes and failed collectors), duration count/sum/max, uptime in seconds."""
    scrapes = (
        tables["scrape_log"]
        .groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("scrapes"),
            F.count_if(~F.col("successful")).alias("_failed"),
            F.count("duration_s").alias("duration_count"),
            F.sum("duration_s").alias("duration_sum"),
            F.max("duration_s").alias("duration_max"),
            F.floor(elapsed_s(F.max("start_ts"), F.min("start_ts"))).cast("long").alias("uptime_seconds"),
        )
    )
    failures = tables["collector_run_log"].groupBy("cluster").agg(F.count_if("failed").alias("_collector_failed"))
    return scrapes.join(failures, "cluster", "left").select(
        "cluster",
        "scrapes",
        (F.col("_failed") + F.coalesce("_collector_failed", F.lit(0))).alias("errors"),
        "duration_count",
        "duration_sum",
        "duration_max",
        "uptime_seconds",
    )


def run_counters(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Counter history: scrapes and failed scrapes so far, at every scrape."""
    scrapes = tables["scrape_log"].select(
        "cluster",
        "scrape_id",
        "start_ts",
        F.lit(1).cast("long").alias("scraped_total"),
        F.when(F.col("successful"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("failed_total"),
    )
    return running_sum(
        scrapes, ["cluster"], ["start_ts", "scrape_id"], ["scraped_total", "failed_total"], hour_chunk("start_ts")
    )


def failfast_cutoff(
    tables: Mapping[str, DataFrame], threshold: int = FAILURE_THRESHOLD, enabled: bool = True
) -> DataFrame:
    """Which planned runs of a scrape take place: those after its ``threshold``-th failure are skipped.

    Only the position of that failure matters, so failures are ranked with a group limit (a task ships at most
    ``threshold`` rows per scrape) and the position is joined back, in place of a running count over all runs.
    """
    runs = tables["collector_run_log"]
    columns = ["cluster", "scrape_id", "seq", "collector", "failed"]
    if not enabled:
        return runs.select(*columns, F.lit(True).alias("executed"))
    order = Window.partitionBy("cluster", "scrape_id").orderBy("seq")
    cut = (
        runs.filter("failed")
        .select("cluster", "scrape_id", "seq", F.row_number().over(order).alias("_rank"))
        .filter(F.col("_rank") <= threshold)
        .groupBy("cluster", "scrape_id")
        .agg(F.max(F.when(F.col("_rank") == threshold, F.col("seq"))).alias("_cut"))
    )
    executed = F.coalesce(F.col("seq") <= F.col("_cut"), F.lit(True))
    return runs.join(cut, ["cluster", "scrape_id"], "left").select(*columns, executed.alias("executed"))
