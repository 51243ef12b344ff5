"""Collectors of one subject from one pass over their inputs.

Run one by one, the collectors of a subject each read the same table: sessions are read nine times, segments twelve times. Here a row is
given every key it counts under (its state, its session, its whole snapshot, ...) and one aggregation serves all of these
grouping sets. Totals and skew figures come from their siblings, over the rows of their snapshot, and all results leave as samples
in one step, so nothing branches back to a scan.

A group is a function from tables to rows that carry one struct column per result (null where a row has nothing to say of it), and
the list of these columns with the collector each belongs to. What a column holds is what the collector itself returns; the
expressions are the collectors' own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.scalars import ROLE_PRIMARY, blank_or_unknown, cpu_limit_label, mode_code, or_unknown, role_code, status_code
from fleetlens.functions.scope import SCOPE
from fleetlens.functions.skew import skew_columns
from fleetlens.operators import cluster, locks, replication, resgroups, segments, sessions
from fleetlens.plans.samples import CollectorSpec, label_map

Rows = tuple[DataFrame, list[tuple[str, str]]]  # rows, and (collector, struct column) pairs

def _over_snapshot(value: Column) -> Column:
    """An aggregate over the rows of the snapshot; these are few (its segments, hosts, groups, lock types)."""
    return value.over(Window.partitionBy(*SCOPE))


def _key(tag: str, names: Mapping[str, str], **values: Column) -> Column:
    """One key of a row: what it counts under, with the parts of the key that this tag has."""
    parts = [values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names.items()]
    return F.struct(F.lit(tag).alias("tag"), *parts)


def _keyed(df: DataFrame, *keys: Column) -> DataFrame:
    """Each row once for every key that is not null, in the column ``_k``."""
    return df.select("*", F.explode(F.array(*keys)).alias("_k")).filter(F.col("_k").isNotNull())


def _with_spine(rows: DataFrame, snapshots: DataFrame | None, names: Mapping[str, str]) -> DataFrame:
    """``rows`` and a row of its own for each listed snapshot, under the snapshot's key."""
    rows = rows.withColumn("_listed", F.lit(False))
    if snapshots is None:
        return rows
    spine = snapshots.select(*SCOPE).distinct().select(*SCOPE, _key("snapshot", names).alias("_k"), F.lit(True).alias("_listed"))
    return rows.unionByName(spine, allowMissingColumns=True)


def _total(snapshots: DataFrame | None, found: Column) -> Column:
    """Whether a snapshot's row reports totals: if it is listed, or where there is no list, if anything was found."""
    return F.col("tag").eqNullSafe("snapshot") & (found if snapshots is None else F.col("_listed"))


def _grouped(rows: DataFrame, names: Mapping[str, str], *aggregates: Column) -> DataFrame:
    keys = [F.col(f"_k.{n}").alias(n) for n in ("tag", *names)]
    return rows.groupBy(*SCOPE, *keys).agg(F.max("_listed").alias("_listed"), *aggregates)


def _if(test: Column, **values: Column) -> Column:
    return F.when(test, F.struct(*[v.alias(n) for n, v in values.items()]))


def session_rows(tables: Mapping[str, DataFrame], wanted: frozenset[str]) -> Rows:
    """States, running queries and vacuums of sessions: one scan, one shuffle of at most a row per state and task."""
    snapshots, names = tables.get("snapshots"), {"name": "string", "usename": "string", "pid": "long"}
    state = F.col("state")
    rows = _keyed(
        tables["activity"], _key("snapshot", names), F.when(sessions.is_client(), _key("state", names, name=or_unknown("state"))),
        F.when(sessions.is_vacuum(), _key("vacuum", names, name=or_unknown("datname"), usename=or_unknown("usename"), pid=F.col("pid"))),
    )
    client = sessions.is_client()
    out = _grouped(
        _with_spine(rows, snapshots, names), names,
        F.count_if(client & (state != "unknown")).alias("_known"), F.count_if(client & (state == "unknown")).alias("_named"),
        F.count_if(client & state.isNull()).alias("_unnamed"), *sessions.bucket_counts(),
        F.max(F.when(sessions.is_vacuum(), F.lit(1.0)).otherwise(F.lit(0.0))).alias("_running"),
        F.max(sessions.vacuum_seconds()).alias("_seconds"),
    )
    total, slow = sessions.bucket_totals()
    listed = _total(snapshots, F.lit(True))
    connections = F.col("_known") + sessions.of_state(F.col("_named"), F.col("_unnamed"))
    columns = {
        "connections_by_state": ("connections_by_state", _if(F.col("tag") == "state", state=F.col("name"), connections=connections)),
        "connections_total": ("connections_total", _if(_total(snapshots, connections > 0), connections=connections)),
        "active_query_totals": ("active_query_totals", F.when(listed, F.struct(total, slow))),
        "vacuum_running": ("vacuum_running", _if(F.col("tag") == "vacuum", datname=F.col("name"), usename=F.col("usename"), pid=F.col("pid"), seconds_running=F.col("_seconds"))),
        "vacuum_running_flag": ("vacuum_running_flag", _if(listed, running=F.col("_running"))),
        **{
            f"bucket_{name}": ("active_query_buckets", _if(listed, bucket=F.lit(name), queries=F.col(name)))
            for name, _, _ in sessions.DURATION_BUCKETS
        },
    }
    return _columns(out, columns, wanted)


def lock_rows(tables: Mapping[str, DataFrame], wanted: frozenset[str]) -> Rows:
    """All figures of lock waits: locks and sessions are read once each and meet in one join, by process and by session id."""
    snapshots = tables.get("snapshots")
    names = {"key": "long", "locktype": "string", "database": "long", "mode": "string", "gp_segment_id": "long"}
    session_names = {"key": "long"}
    backends = _keyed(
        tables["activity"], F.when(locks.is_waiting(), _key("process", session_names, key=F.col("pid"))),
        F.when(F.col("sess_id").isNotNull(), _key("session", session_names, key=F.col("sess_id"))),
    ).groupBy(*SCOPE, F.col("_k.tag").alias("tag"), F.col("_k.key").alias("key")).agg(
        F.count_if(F.col("major") < 7).alias("_old"), F.count_if(F.col("major") >= 7).alias("_new"),
        F.count(F.lit(1)).alias("_backends"), F.min("query_start").alias("_oldest"),
    )
    parts = {n: F.col(n) for n in names if n != "key"}
    rows = _keyed(
        tables["locks"], _key("snapshot", names), _key("process", names, key=F.col("pid"), locktype=F.col("locktype")),
        F.when(~F.col("granted"), _key("session", names, key=F.col("mppsessionid"), **parts)),
    )
    held = _grouped(
        _with_spine(rows, snapshots, names), names, F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("granted")).alias("_ungranted")
    )
    met = held.join(backends, [*SCOPE, "tag", "key"], "left")
    by_oid = met.groupBy(*SCOPE, "tag", *parts).agg(
        F.sum(F.col("_ungranted") * F.col("_old") + F.col("_all") * F.col("_new")).alias("_pairs"),
        F.sum(F.col("_all") * F.coalesce("_backends", F.lit(1))).alias("_queries"), F.min("_oldest").alias("_oldest"),
        F.sum("_ungranted").alias("_waiting"), F.max("_listed").alias("_listed"),
    )
    databases = tables["pg_database"]
    scope = [c for c in SCOPE if c in databases.columns]
    named = by_oid.join(databases.select(*scope, F.col("oid").cast("long").alias("database"), "datname"), [*scope, "database"], "left")
    session, process = F.col("tag") == "session", F.col("tag") == "process"
    labelled = named.groupBy(
        *SCOPE, "tag", F.when(session, or_unknown("datname")).alias("_database"),
        F.when(session, or_unknown("locktype")).when(process, blank_or_unknown("locktype")).alias("_type"),
        F.when(session, or_unknown("mode")).alias("_mode"), F.when(session, or_unknown(F.col("gp_segment_id").cast("string"))).alias("_content"),
    ).agg(
        locks.of_type(F.col("_pairs")).alias("_sessions"), F.sum("_queries").alias("_queries"), F.min("_oldest").alias("_oldest"),
        F.sum("_waiting").alias("_waiting"), F.max("_listed").alias("_listed"),
    )
    found = F.when(process & (F.col("_sessions") > 0), F.col("_sessions"))
    out = labelled.withColumn("_all_sessions", _over_snapshot(F.sum(found)))
    columns = {
        "locked_sessions": ("locked_sessions", _if(found.isNotNull(), lock_type=F.col("_type"), sessions=F.col("_sessions"))),
        "locked_sessions_total": (
            "locked_sessions_total",
            _if(_total(snapshots, F.col("_all_sessions").isNotNull()), sessions=F.coalesce("_all_sessions", F.lit(0))),
        ),
        "locks_waiting_count": ("locks_waiting_count", _if(_total(snapshots, F.lit(True)), waiting=F.col("_waiting"))),
        "extended_locks": (
            "extended_locks",
            _if(
                session, database=F.col("_database"), lock_type=F.col("_type"), mode=F.col("_mode"), content=F.col("_content"),
                lock_waiting_queries=F.col("_queries"), lock_wait_max_wait_seconds=locks.longest_wait("_oldest"),
            ),
        ),
    }
    return _columns(out, columns, wanted)


# Facts of a cluster that its state is made of, beside the version.
_FACTS = ("reachable_segments", "postmaster_start", "conf_load_time", "max_connections")


def segment_rows(tables: Mapping[str, DataFrame], wanted: frozenset[str]) -> Rows:
    """Segments with what is reported by content: shippers and spill files are reduced to one row per content and joined once."""
    snapshots = tables.get("snapshots")
    names = {
        "hostname": "string", "dbid": "long", "content": "long", "role": "string", "preferred_role": "string", "mode": "string",
        "status": "string", "port": "long",
    }
    by_content = []
    if wanted & {"replication_lag", "replication_max_lag"}:
        by_content.append(replication.shippers_by_content(tables["stat_replication"]).withColumn("content", F.col("content").cast("long")))
    if wanted & {"spill_per_host", "spill_skew"}:
        spilled = tables["workfile_usage"].groupBy(*SCOPE, F.col("segid").cast("long").alias("content")).agg(F.sum("size").alias("_bytes"))
        by_content.append(spilled)
    own = [F.col(n).cast(kind).alias(n) for n, kind in names.items()]
    rows = tables["segment_config"].select(*SCOPE, *own, F.lit(True).alias("_segment"))
    if by_content:
        both = by_content[0]
        if len(by_content) == 2:
            both = both.unionByName(by_content[1], allowMissingColumns=True)
            both = both.groupBy(*SCOPE, "content").agg(F.first("_r", True).alias("_r"), F.max("_worst").alias("_worst"), F.max("_bytes").alias("_bytes"))
        rows = rows.join(both, [*SCOPE, "content"], "left")
    missing = {"_r": "struct<application_name:string,state:string,sync_state:string>", "_worst": "long", "_bytes": "long"}
    for name, kind in missing.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    primary = F.col("role") == ROLE_PRIMARY
    shipping = primary & F.col("_r").isNotNull()
    rows = _keyed(
        rows, _key("snapshot", names), _key("segment", names, **{n: F.col(n) for n in names}),
        F.when(shipping, _key("shipper", names, hostname=F.col("hostname"), content=F.col("content"))),
        F.when(primary & (F.col("content") >= 0), _key("host", names, hostname=F.col("hostname"))),
    )
    if "cluster_state" in wanted:
        facts = cluster.parse_version(tables["cluster_facts"]).select(
            *SCOPE, _key("snapshot", names).alias("_k"), F.struct("version", *_FACTS).alias("_facts")
        )
        replicas = cluster.streaming_replicas(tables["stat_replication"]).withColumn("_k", _key("snapshot", names))
        rows = rows.unionByName(facts, allowMissingColumns=True).unionByName(replicas, allowMissingColumns=True)
    else:
        rows = rows.withColumns({"_facts": F.lit(None).cast("struct<version:string>"), "_replicas": F.lit(None).cast("long")})
    _, up, down = segments.status_counts()
    grouped = _grouped(
        _with_spine(rows, snapshots, names), names,
        F.count_if("_segment").alias("total"), up, down, *cluster.coordinator_pair(), F.first("_r", True).alias("_r"),
        F.max(F.when(shipping, F.col("_worst"))).alias("_worst"), F.sum(F.coalesce("_bytes", F.lit(0))).cast("double").alias("_spill"),
        F.first("_facts", True).alias("_facts"), F.max("_replicas").alias("_replicas"),
    )
    host = F.col("tag") == "host"
    spill = F.when(host, F.col("_spill"))
    out = grouped.withColumns(
        {"_max_spill_usage": _over_snapshot(F.max(spill)), "_avg_spill_usage": _over_snapshot(F.avg(spill)), "_hosts": _over_snapshot(F.count(spill))}
    )
    lag = F.coalesce(F.greatest(F.col("_worst"), F.lit(0)).cast("double"), F.lit(0.0))
    health = [F.col(n) for n in names] + [
        status_code("status").alias("status_value"), role_code("role").alias("role_value"), mode_code("mode").alias("mode_value")
    ]
    columns = {
        "segment_health": ("segment_health", F.when(F.col("tag") == "segment", F.struct(*health))),
        "segment_counts": ("segment_counts", F.when(_total(snapshots, F.col("total") > 0), F.struct("total", "up", "down"))),
        "replication_max_lag": ("replication_max_lag", _if(_total(snapshots, F.col("_worst").isNotNull()), max_lag_bytes=lag)),
        "spill_per_host": ("spill_per_host", _if(host, hostname=F.col("hostname"), spill_bytes=F.col("_spill"))),
        "spill_skew": ("spill_skew", F.when(_total(snapshots, F.col("_hosts") > 0), F.struct(*skew_columns(["spill_usage"])))),
    }
    if wanted & {"replication_lag"}:
        columns["replication_lag"] = ("replication_lag", F.when(F.col("tag") == "shipper", F.struct(*replication.lag_columns())))
    if "cluster_state" in wanted:
        out = out.select("*", *[F.col(f"_facts.{n}").alias(n) for n in ("version", *_FACTS)])
        state = F.struct(*cluster.state_columns())
        columns["cluster_state"] = ("cluster_state", F.when(F.col("_facts").isNotNull(), state))
    return _columns(out, columns, wanted)


def resgroup_rows(tables: Mapping[str, DataFrame], wanted: frozenset[str]) -> Rows:
    """Usage by group and host, and what is summed up from it by group, by host and by snapshot."""
    snapshots, names = tables.get("snapshots"), {"rsgname": "string", "hostname": "string"}
    rows = _keyed(
        resgroups.usage_by_host(tables), _key("snapshot", names), _key("pair", names, rsgname=F.col("rsgname"), hostname=F.col("hostname")),
        _key("group", names, rsgname=F.col("rsgname")), _key("host", names, hostname=F.col("hostname")),
    )
    # The first host of a group by name; key parts are named like columns of the rows, so the latter are taken along.
    figures = F.struct("num_running", "num_queueing", "memory_limit", "cpu_rate_limit")
    grouped = _grouped(
        _with_spine(rows, snapshots, names), names, F.min_by(figures, F.col("hostname")).alias("_first"),
        *[F.sum(c).cast("double").alias(f"_{c}") for c in ("memory_usage", "cpu_usage")],
        F.max("cpu_rate_limit").alias("_limit"),
    )
    host, group = F.col("tag") == "host", F.col("tag") == "group"
    measures = {"mem_usage": "_memory_usage", "cpu_usage": "_cpu_usage"}
    out = grouped.withColumns(
        {
            "_sum": _over_snapshot(F.sum(F.when(group, F.col("_first.memory_limit")))), "_hosts": _over_snapshot(F.count(F.when(host, F.lit(1)))),
            **{f"_max_{m}": _over_snapshot(F.max(F.when(host, F.col(c)))) for m, c in measures.items()},
            **{f"_avg_{m}": _over_snapshot(F.avg(F.when(host, F.col(c)))) for m, c in measures.items()},
        }
    )
    limit = F.col("_first.memory_limit")
    columns = {
        "rsg_per_host": (
            "rsg_per_host",
            _if(
                F.col("tag") == "pair", rsgname=F.col("rsgname"), hostname=F.col("hostname"), memory_usage=F.col("_memory_usage"),
                cpu_usage=F.col("_cpu_usage"), limit=cpu_limit_label("_limit"),
            ),
        ),
        "rsg_per_group": (
            "rsg_per_group",
            _if(group, rsgname=F.col("rsgname"), **{c: F.col(f"_first.{c}") for c in ("num_running", "num_queueing", "memory_limit", "cpu_rate_limit")}),
        ),
        "rsg_effective_mem_limit": (
            "rsg_effective_mem_limit", _if(group, rsgname=F.col("rsgname"), effective_mem_limit=resgroups.effective_limit(limit, F.col("_sum"))),
        ),
        "rsg_skew": ("rsg_skew", F.when(_total(snapshots, F.col("_hosts") > 0), F.struct(*skew_columns(list(measures))))),
    }
    return _columns(out, columns, wanted)


def _columns(rows: DataFrame, columns: Mapping[str, tuple[str, Column]], wanted: frozenset[str]) -> Rows:
    chosen = {f"_of_{name}": (collector, value) for name, (collector, value) in columns.items() if collector in wanted}
    return rows.select(*SCOPE, *[v.alias(n) for n, (_, v) in chosen.items()]), [(c, n) for n, (c, _) in chosen.items()]


@dataclass(frozen=True)
class Group:
    collectors: frozenset[str]
    rows: Callable[[Mapping[str, DataFrame], frozenset[str]], Rows]


GROUPS = (
    Group(
        frozenset({"connections_by_state", "connections_total", "active_query_buckets", "active_query_totals", "vacuum_running", "vacuum_running_flag"}),
        session_rows,
    ),
    Group(frozenset({"locked_sessions", "locks_waiting_count", "locked_sessions_total", "extended_locks"}), lock_rows),
    Group(
        frozenset({"cluster_state", "segment_health", "segment_counts", "replication_lag", "replication_max_lag", "spill_per_host", "spill_skew"}),
        segment_rows,
    ),
    Group(frozenset({"rsg_per_host", "rsg_per_group", "rsg_effective_mem_limit", "rsg_skew"}), resgroup_rows),
)


def fusable(group: Group, specs: Iterable[CollectorSpec], tables: Mapping[str, DataFrame]) -> list[CollectorSpec]:
    """The collectors of a group that can go together: their inputs are at hand and hold for one snapshot each."""
    own = [s for s in specs if s.name in group.collectors and all(t in tables for t in s.inputs)]
    return [s for s in own if all(set(SCOPE) <= set(tables[t].columns) for t in s.inputs if t != "pg_database" and not t.startswith("resgroup"))]


def group_samples(group: Group, specs: list[CollectorSpec], tables: Mapping[str, DataFrame], namespace: str) -> DataFrame:
    """The samples of some collectors of a group, in the form of :func:`fleetlens.plans.samples.spec_samples`."""
    by_name = {s.name: s for s in specs}
    rows, pieces = group.rows(tables, frozenset(by_name))
    samples = []
    for collector, column in pieces:
        metrics = by_name[collector].metrics
        if by_name[collector].to_samples is not None:  # one metric per row there, one per column here
            metrics = tuple(replace(m, value=m.name) for m in metrics)
        for m in metrics:
            labels = label_map([(name, f"{column}.{c}") for name, c in m.labels])
            value = F.col(f"{column}.{m.value}").cast("double")
            sample = F.struct(F.lit(m.full_name(namespace)).alias("metric"), labels.alias("labels"), value.alias("value"))
            samples.append(F.when(F.col(column).isNotNull(), sample))
    listed = rows.select("cluster", F.col("snapshot_ts").alias("ts"), F.explode(F.array(*samples)).alias("_m"))
    return listed.filter(F.col("_m").isNotNull()).select("cluster", "ts", "_m.*")
