"""Resource groups: usage per host, limits per group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.scalars import cpu_limit_label, either_column, zero_if_null
from fleetlens.functions.scope import SCOPE, scope_of
from fleetlens.functions.skew import host_skew
from fleetlens.operators.hosts import primary_hosts

FULL_MEMORY_PERCENT = 100
LAST_RESORT_PERCENT = 1


def usage_by_host(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Status, group name, usage and limits per (group, host), hosts of data-holding primaries only.

    The source joins hosts with an outer join and then requires the host to be a primary's, which drops the unmatched
    rows again; an inner join says so directly and lets the planner reorder it.
    """
    status, groups, usage, limits, segments = (
        tables[t] for t in ("resgroup_status", "resgroup", "resgroup_host", "resgroup_config", "segment_config")
    )
    usage_columns = usage.select(
        *scope_of(usage),
        "groupid",
        "hostname",
        zero_if_null(F.round(either_column(usage, ["cpu_usage", "cpu"])).cast("int")).alias("cpu_usage"),
        zero_if_null(either_column(usage, ["memory_usage", "memory_used"]).cast("int")).alias("memory_usage"),
    )
    limit_columns = limits.select(
        *scope_of(limits),
        "groupid",
        either_column(limits, ["cpu_max_percent", "cpu_rate_limit", "cpu_limit"]).cast("int").alias("cpu_rate_limit"),
        F.col("memory_limit").cast("int").alias("memory_limit"),
    )
    names = groups.select(*scope_of(groups), F.col("oid").alias("groupid"), "rsgname")
    hosts = primary_hosts(segments).select(*scope_of(segments), "hostname")
    return (
        usage_columns.join(hosts, [*scope_of(usage, hosts), "hostname"], "left_semi")
        .join(status, [*scope_of(usage, status), "groupid"])
        .join(names, [*scope_of(usage, names), "groupid"])
        .join(limit_columns, [*scope_of(usage, limit_columns), "groupid"], "left")
        .select(
            *SCOPE,
            "rsgname",
            "hostname",
            *[
                zero_if_null(c).cast("int").alias(c)
                for c in ("num_running", "num_queueing", "cpu_rate_limit", "cpu_usage", "memory_limit", "memory_usage")
            ],
        )
    )


def rsg_per_host(tables: Mapping[str, DataFrame]) -> DataFrame:
    return usage_by_host(tables).select(
        *SCOPE,
        "rsgname",
        "hostname",
        "memory_usage",
        "cpu_usage",
        cpu_limit_label("cpu_rate_limit").alias("limit"),
    )


def rsg_per_group(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Sessions and limits of a group, from its first host by name."""
    figures = ["num_running", "num_queueing", "memory_limit", "cpu_rate_limit"]
    first = usage_by_host(tables).groupBy(*SCOPE, "rsgname").agg(F.min_by(F.struct(*figures), "hostname").alias("_g"))
    return first.select(*SCOPE, "rsgname", "_g.*")


def effective_limit(own: Column, total: Column) -> Column:
    left = F.lit(FULL_MEMORY_PERCENT) - total
    return F.when(own > 0, own).when(left > 0, left).otherwise(F.lit(LAST_RESORT_PERCENT)).cast("long")


def rsg_effective_mem_limit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A group's own limit, else what all limits leave of 100 percent, else 1 percent.

    The sum runs over all groups of the snapshot, those without a limit included with their zero or negative number.
    """
    groups = rsg_per_group(tables)
    totals = groups.groupBy(*SCOPE).agg(F.sum("memory_limit").alias("_sum"))
    effective = effective_limit(F.col("memory_limit"), F.col("_sum")).alias("effective_mem_limit")
    return groups.join(totals, list(SCOPE)).select(*SCOPE, "rsgname", "memory_limit", effective)


def rsg_skew(
    tables: Mapping[str, DataFrame], snapshots: DataFrame | None = None, truncate: bool = True
) -> DataFrame:
    return host_skew(
        usage_by_host(tables), {"mem_usage": "memory_usage", "cpu_usage": "cpu_usage"}, snapshots=snapshots, truncate=truncate
    )
