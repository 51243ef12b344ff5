"""Collectors that run together give what each gives alone, and read their inputs once."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import fused, registry
from fleetlens.plans.collect import collect_samples
from fleetlens.plans.samples import spec_samples
from fleetlens.suite.queries import whole_run_tables

GROUPED = frozenset().union(*(g.collectors for g in fused.GROUPS))


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """Every input as a file of its own, so that plans name the tables they scan."""
    folder = tmp_path_factory.mktemp("inputs")
    out = {}
    for name, df in whole_run_tables(spark, sf_dir).items():
        df.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows_of(samples):
    labels = F.array_sort(F.map_entries("labels")).cast("string")
    found = samples.select("cluster", F.col("ts").cast("string"), "metric", labels, F.round("value", 9)).collect()
    return Counter(map(tuple, found))


@pytest.mark.parametrize("listed", [True, False])
@pytest.mark.parametrize("group", fused.GROUPS, ids=lambda g: sorted(g.collectors)[0])
def test_group_gives_what_its_collectors_give(tables, group, listed):
    given = dict(tables) if listed else {k: v for k, v in tables.items() if k != "snapshots"}
    specs = fused.fusable(group, registry.COLLECTORS, given)
    assert {s.name for s in specs} == group.collectors
    apart = [spec_samples(s, s.build(given)) for s in specs]
    want = sum(map(rows_of, apart), Counter())
    got = rows_of(fused.group_samples(group, specs, given, "fleet"))
    assert got == want
    assert {key[2] for key in got} == {m.full_name() for s in specs for m in s.metrics}


@pytest.mark.parametrize("names", [("replication_lag", "segment_health"), ("spill_per_host", "spill_skew"), ("cluster_state", "segment_counts"), ("connections_total", "vacuum_running"), ("locked_sessions_total", "extended_locks"), ("rsg_skew", "rsg_effective_mem_limit")])
def test_part_of_a_group(tables, names):
    group = next(g for g in fused.GROUPS if names[0] in g.collectors)
    specs = [s for s in registry.COLLECTORS if s.name in names]
    want = sum((rows_of(spec_samples(s, s.build(tables))) for s in specs), Counter())
    assert rows_of(fused.group_samples(group, specs, tables, "fleet")) == want


def test_whole_run_is_the_sum_of_its_collectors(tables):
    specs = registry.selected_specs({"table_health": True, "backup_history": True})
    assert len(specs) == len(registry.COLLECTORS)
    want = sum((rows_of(spec_samples(s, s.build(tables))) for s in specs), Counter())
    assert rows_of(collect_samples(tables, specs)) == want


def scans(df):
    """How often each input is read once the plan is final; reused exchanges are not read again."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return Counter(re.findall(r"Location: InMemoryFileIndex.*?/inputs\d+/(\w+)", final))


def test_a_run_scans_no_input_more_than_twice(spark, tables):
    specs = registry.selected_specs({"table_health": True, "backup_history": True})
    found = scans(collect_samples(tables, specs))
    assert set(found) == set(tables) - {"snapshots"} | {"snapshots"} and max(found.values()) <= 2, found


def test_collectors_of_other_makers_run_alone(tables):
    """A collector that shares a name with a registered one and is none keeps its own transform."""
    from dataclasses import replace

    own = replace(next(s for s in registry.COLLECTORS if s.name == "connections_total"), transform=lambda t, snapshots=None: t["activity"].groupBy("cluster", "snapshot_ts").agg(F.lit(7).alias("connections")))
    other = next(s for s in registry.COLLECTORS if s.name == "vacuum_running_flag")
    got = collect_samples(tables, [own, other]).filter("metric = 'fleet_cluster_connections_all_states_total'")
    assert {r.value for r in got.select("value").distinct().collect()} == {7.0}


def test_a_group_that_does_not_fit_runs_one_by_one(tables):
    """Without the positions replication leaves its group, and its own policy decides."""
    given = {**tables, "stat_replication": tables["stat_replication"].drop("sent_lsn")}
    names = {"segment_health", "segment_counts", "replication_lag", "replication_max_lag"}
    specs = [s for s in registry.COLLECTORS if s.name in names]
    failures = []
    got = collect_samples(given, specs, failures=failures)
    assert {name for name, _ in failures} == {"replication_lag", "replication_max_lag"}
    want = sum((rows_of(spec_samples(s, s.build(given))) for s in specs if s.name.startswith("segment")), Counter())
    assert rows_of(got) == want
