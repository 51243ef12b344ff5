"""Cluster-wide facts: version, reachability, state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.scalars import ROLE_PRIMARY, UNKNOWN, elapsed_s, epoch_with_millis
from fleetlens.functions.scope import SCOPE, fill_snapshots, scope_of

# The oldest supported version, and the content id of the coordinator.
MIN_VERSION = (6, 27, 1)
COORDINATOR = -1


def banner_numbers(banner: Column | str) -> Column:
    """Major, minor and patch number of a version banner as an array; NULL when it names no version.

    A banner reads ``... (product version build ...) ...``: in a pair of parentheses, the word before ``build``, up to its first
    ``+``, ``_`` or ``-``, is the version.
    """
    text = F.col(banner) if isinstance(banner, str) else banner
    opened = F.split(text, r"\(")
    inside = F.transform(
        F.slice(opened, 2, F.greatest(F.size(opened) - 1, F.lit(0))), lambda part: F.split(F.substring_index(part, ")", 1), r"\s+")
    )

    def version(words: Column) -> Column:
        before = F.get(words, F.array_position(words, "build").cast("int") - 2)
        numbers = F.split(F.get(F.split(before, "[+_-]"), F.lit(0)), r"\.")
        sound = (F.size(numbers) == 3) & F.forall(numbers, lambda n: n.rlike("^[0-9]+$"))
        return F.when(sound, F.transform(numbers, lambda n: n.try_cast("int")))

    found = F.filter(F.transform(inside, version), lambda numbers: numbers.isNotNull())
    return F.get(found, F.lit(0))


def parse_version(df: DataFrame, banner: str = "version_banner") -> DataFrame:
    """Add ``major, minor, patch, version, supported``; all NULL/False where no version is recognised."""
    numbers = df.withColumn("_numbers", banner_numbers(banner))
    parts = numbers.withColumns({n: F.get("_numbers", F.lit(i)) for i, n in enumerate(("major", "minor", "patch"))}).drop("_numbers")
    known = F.col("major").isNotNull()
    oldest = F.struct(*[F.lit(v).alias(n) for n, v in zip(("major", "minor", "patch"), MIN_VERSION)])
    return parts.withColumns(
        {
            "version": F.when(known, F.concat_ws(".", "major", "minor", "patch")),
            "supported": known & (F.struct("major", "minor", "patch") >= oldest),
        }
    )


def cluster_version(tables: Mapping[str, DataFrame]) -> DataFrame:
    facts = tables["cluster_facts"]
    return parse_version(facts).select(*scope_of(facts), "major", "minor", "patch", "version", "supported")


def supported_clusters(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Gate: only clusters whose version is known and supported are collected."""
    return cluster_version(tables).filter("supported").drop("supported")


def cluster_up(tables: Mapping[str, DataFrame]) -> DataFrame:
    """1 for a scrape whose probe succeeded, whose version was recognised and that raised no database error."""
    ok = F.col("probe_ok") & F.col("version_detected") & ~F.coalesce("db_error", F.lit(False))
    return tables["scrape_log"].select(
        "cluster", "scrape_id", "start_ts", F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0)).alias("up")
    )


def cluster_state(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row of state per snapshot.

    The coordinator pair is a conditional aggregate over the segment table and the replica count an aggregate over
    the coordinator's replication rows, so each source is reduced to one row per snapshot before any join. Two
    coordinators of one role are an error in the source query and give the default state.
    """
    facts, segments, replication = (tables[t] for t in ("cluster_facts", "segment_config", "stat_replication"))
    seg_scope = scope_of(facts, segments)
    pair = (
        segments.filter((F.col("content") == COORDINATOR) & F.col("role").isin(ROLE_PRIMARY, "m"))
        .groupBy(*seg_scope)
        .agg(*coordinator_pair())
    )
    rep_scope = scope_of(facts, replication)
    replicas = streaming_replicas(replication, rep_scope)
    joined = parse_version(facts).join(pair, seg_scope, "left").join(replicas, rep_scope, "left")
    return joined.select(*SCOPE, *state_columns())


def coordinator_pair() -> list[Column]:
    """Aggregates over segment rows: the hosts of both coordinators, and whether a role is taken twice."""
    is_master = (F.col("content") == COORDINATOR) & (F.col("role") == ROLE_PRIMARY)
    is_standby = (F.col("content") == COORDINATOR) & (F.col("role") == "m")
    return [
        F.max(F.when(is_master, F.col("hostname"))).alias("_master"),
        F.max(F.when(is_standby, F.col("hostname"))).alias("_standby"),
        ((F.count_if(is_master) > 1) | (F.count_if(is_standby) > 1)).alias("_ambiguous"),
    ]


def streaming_replicas(replication: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    rows = replication.filter((F.col("content") == COORDINATOR) & (F.col("state") == "streaming"))
    return rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("_replicas"))


def state_columns() -> list[Column]:
    """The state from a snapshot's facts (with their parsed version), its coordinator pair and its replica count."""
    good = ~F.coalesce("_ambiguous", F.lit(False))

    def state(col: Column, default: object) -> Column:
        return F.coalesce(F.when(good, col), F.lit(default))

    return [
        (F.coalesce("reachable_segments", F.lit(0)) > 0).alias("accessible"),
        F.coalesce("version", F.lit(UNKNOWN)).alias("version"),
        state(F.col("_master"), UNKNOWN).alias("master"),
        state(F.col("_standby"), "").alias("standby"),
        state(elapsed_s("snapshot_ts", "postmaster_start").cast("long"), 0).alias("uptime"),
        state(F.col("_replicas").cast("double"), 0.0).alias("sync"),
        state(epoch_with_millis("conf_load_time"), 0.0).alias("config_load_time"),
        state(F.col("max_connections"), 0).cast("int").alias("max_connections"),
    ]
