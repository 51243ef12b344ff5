"""Continuous collection over newly landed snapshots.

A snapshot is complete in itself, so collecting one needs no stream state: a manifest row in ``snapshots`` (landed after
all tables of the snapshot) starts its collection, and every micro-batch runs the ordinary batch transforms on the
snapshots it announces. Appearance and disappearance of entities compare with the previous snapshot of the cluster;
the live entities of every cluster are kept as a table next to the checkpoint, and the batch operators run over that
table and the new rows together. A cluster's entities are therefore spread over all tasks, where keyed stream state
would hold a whole cluster under one key.

Everything a batch writes goes to a place of its own that a repeated batch overwrites, so results stay exact when
executors are lost or the driver restarts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.scope import SCOPE
from fleetlens.operators.absences import FILLS
from fleetlens.operators.lifecycle import entity_changes, pinned_labels, sound_entities
from fleetlens.plans.collect import collect_samples, entity_history, entity_labels, entity_values
from fleetlens.plans.registry import selected_specs
from fleetlens.plans.samples import CollectorSpec, spec_samples
from fleetlens.schemas import TABLES, table_schema
from fleetlens.session import shared_dir
from fleetlens.sources.catalog import DATE_COLUMN, read_landed
from fleetlens.streaming.lives import snapshot_feed


@dataclass(frozen=True)
class Tracked:
    """Entities whose life is followed: a collector, its key columns, and the labels pinned at first sight."""

    spec: CollectorSpec
    labels: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (*SCOPE, *self.spec.keys, *self.labels)


def announced(manifest: DataFrame) -> DataFrame:
    """Distinct successful snapshots of a batch."""
    return manifest.filter(F.coalesce("ok", F.lit(True))).select(*SCOPE).distinct()


def snapshot_tables(spark: SparkSession, landing: str, names: Iterable[str], snapshots: DataFrame) -> dict[str, DataFrame]:
    """Landed rows of the given snapshots.

    Their first and last time go into the plan as literals: folders of other days are not listed, and row groups of other times
    are skipped by their statistics.
    """
    bounds = snapshots.agg(
        F.unix_micros(F.min("snapshot_ts")).alias("first"), F.unix_micros(F.max("snapshot_ts")).alias("last"),
        F.min(F.to_date("snapshot_ts")).alias("first_day"), F.max(F.to_date("snapshot_ts")).alias("last_day"),
    ).first()
    # Instants travel as numbers: as local times of the driver, those of a doubled hour could not be told apart.
    first, last = bounds["first"], bounds["last"]
    tables = {}
    for name in names:
        rows = read_landed(spark, landing, name, bounds["first_day"], bounds["last_day"])
        rows = rows.filter(F.lit(False)) if first is None else rows.filter(F.col("snapshot_ts").between(F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))))
        tables[name] = rows.join(snapshots, list(SCOPE), "left_semi").drop(DATE_COLUMN)
    return tables


def _slot(root: str, name: str, batch_id: int) -> str:
    """Two alternating places: a batch reads what the one before wrote and never overwrites it."""
    return f"{root}/{name}/slot={batch_id % 2}"


class LostState(RuntimeError):
    """State that an earlier batch wrote is gone; going on without it would report all entities as new."""


def _previous(spark: SparkSession, root: str, name: str, batch_id: int, like: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """What the batch before wrote; nothing for the first batch, or for a state that no earlier batch knew of.

    ``known`` names the states that the batch before wrote; without it this one is taken to be among them.
    """
    if batch_id > 0 and (known is None or name in known):
        try:
            return spark.read.schema(like.schema).parquet(_slot(root, name, batch_id - 1))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise LostState(f"{_slot(root, name, batch_id - 1)} is missing; start the job anew under another home") from error
    return like.filter(F.lit(False))


def advance_entities(
    tracked: Tracked, previous: DataFrame, entities: DataFrame, seen: DataFrame, fresh: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes and pinned labels of the fresh snapshots, and the live entities after them.

    ``previous`` holds the live entities of every cluster at its last snapshot, with the labels they are pinned to;
    ``seen`` the last snapshot of every cluster; ``fresh`` the new snapshots.
    """
    keys = list(tracked.spec.keys)
    columns = list(tracked.columns)
    current = entities.select(*columns)
    history = previous.select(*columns).unionByName(current)
    spine = seen.unionByName(fresh)
    changes = entity_changes(history, keys, spine).join(fresh, list(SCOPE), "left_semi")
    pinned_all = pinned_labels(history, keys, tracked.labels, snapshots=spine) if tracked.labels else history
    last = spine.groupBy("cluster").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    live = pinned_all.join(last, list(SCOPE), "left_semi").select(*columns)
    return changes, pinned_all.join(fresh, list(SCOPE), "left_semi"), live


def history_samples(
    tracked: Tracked, previous: DataFrame, gone: DataFrame, entities: DataFrame, seen: DataFrame, fresh: DataFrame, namespace: str
) -> tuple[DataFrame, DataFrame]:
    """Samples of the fresh snapshots under the collector's life-cycle rules, and who is gone after them.

    ``gone`` holds the entities that were known and not there at the last snapshot, with the labels they had: they show NaN or 0 in each
    fresh snapshot until they return, and are pinned anew then.
    """
    spec, keys = tracked.spec, list(tracked.spec.keys)
    values, labels = entity_values(spec), entity_labels(spec)
    if not set(labels) <= set(tracked.labels):
        raise ValueError(f"{spec.name} needs its labels {labels} tracked")
    numbers = [F.col(v).cast("double").alias(v) for v in values]
    prior = previous.select(*SCOPE, *keys, *labels, *[F.lit(0.0).alias(v) for v in values])
    current = sound_entities(entities, keys, values).select(*SCOPE, *keys, *labels, *numbers)
    columns = [*SCOPE, *keys, *labels, *values]
    rows = entity_history(spec, prior.unionByName(current), seen.unionByName(fresh)).join(fresh, list(SCOPE), "left_semi").select(*columns)
    if spec.absent not in FILLS:
        return spec_samples(spec, rows, namespace), gone
    back = current.groupBy("cluster", *keys).agg(F.min("snapshot_ts").alias("_back"))
    missed = gone.join(back, ["cluster", *keys], "left").join(fresh, "cluster").filter(F.col("_back").isNull() | (F.col("snapshot_ts") < F.col("_back")))
    still = missed.select(*SCOPE, *keys, *labels, *[F.lit(FILLS[spec.absent]).alias(v) for v in values])
    # A struct of the labels is only taken with something in it.
    pin = F.struct(F.lit(1).alias("_any"), *labels).alias("_pin")
    at = F.col("snapshot_ts").alias("_at")
    known = rows.select("cluster", *keys, pin, at).unionByName(prior.select("cluster", *keys, pin, at))
    known = known.unionByName(gone.select("cluster", *keys, pin, F.lit(None).cast("timestamp").alias("_at")))
    last = known.groupBy("cluster", *keys).agg(F.max_by("_pin", F.struct("_at")).alias("_pin"))
    newest = seen.unionByName(fresh).groupBy("cluster").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    there = prior.unionByName(current).join(newest, list(SCOPE), "left_semi").select("cluster", *keys)
    after = last.join(there, ["cluster", *keys], "left_anti").join(newest, "cluster", "left_semi").select("cluster", *keys, *[F.col(f"_pin.{c}").alias(c) for c in labels])
    return spec_samples(spec, rows.unionByName(still), namespace), after


def collect_batch(
    spark: SparkSession,
    manifest: DataFrame,
    batch_id: int,
    landing: str,
    out: str,
    state: str,
    specs: tuple[CollectorSpec, ...],
    tracked: tuple[Tracked, ...] = (),
    namespace: str = "fleet",
    retain_days: int | None = None,
    history: bool = False,
    feed_buckets: int | None = None,
) -> None:
    """One micro-batch: samples of the announced snapshots, changes and pinned labels of tracked entities.

    Every announced snapshot gives samples, late ones too, as a snapshot needs no other. Life cycles need order: for them,
    snapshots not later than the last one processed for their cluster are left aside. With ``history`` the samples of tracked collectors
    carry pinned labels and show what gone entities show (late snapshots give the rows they hold). With ``feed_buckets`` the rows of
    tracked collectors, late ones too, are also written for the life log (:mod:`fleetlens.streaming.lives`), which corrects lives.
    """
    all_new = announced(manifest)
    names = spark.createDataFrame([], "name string, batch long")
    listed = _previous(spark, state, "names", batch_id, names).collect()
    if any(r["batch"] != batch_id - 1 for r in listed):
        raise LostState(f"the state under {state} is not that of batch {batch_id - 1}")
    known = frozenset(r["name"] for r in listed)
    seen = _previous(spark, state, "seen", batch_id, all_new)
    last = seen.withColumnRenamed("snapshot_ts", "_last")
    is_new = F.col("_last").isNull() | (F.col("snapshot_ts") > F.col("_last"))
    fresh = all_new.join(last, "cluster", "left").filter(is_new).select(*SCOPE)

    inputs = sorted({t for s in (*specs, *(x.spec for x in tracked)) for t in s.inputs})
    tables: dict[str, DataFrame] = snapshot_tables(spark, landing, inputs, all_new)
    tables["snapshots"] = all_new
    apart = {x.spec.name for x in tracked if x.spec.keys and x.spec.to_samples is None} if history else set()
    together = tuple(s for s in specs if s.name not in apart)
    parts = [collect_samples(tables, together, namespace)] if together else []
    written = {"names", "seen"}
    for one in tracked:
        name = one.spec.name
        # Written once and read back: several results are made from it.
        place = f"{state}/{name}/entities={batch_id % 2}"
        whole = one.spec.build(tables)
        needed = list(dict.fromkeys((*one.columns, *(entity_values(one.spec) if name in apart else ()))))
        built = whole.select(*needed)
        built.write.mode("overwrite").parquet(place)
        stored = spark.read.schema(built.schema).parquet(place)
        entities = stored.join(fresh, list(SCOPE), "left_semi")
        if feed_buckets is not None:
            feed = snapshot_feed(stored, one.spec.keys, one.labels, all_new, feed_buckets)
            feed.write.mode("overwrite").parquet(f"{out}/feed/{name}/batch={batch_id}")
        previous = _previous(spark, state, name, batch_id, entities.select(*one.columns), known)
        changes, pinned, live = advance_entities(one, previous, entities, seen, fresh)
        changes.write.mode("overwrite").parquet(f"{out}/changes/{name}/batch={batch_id}")
        if one.labels:
            pinned.write.mode("overwrite").parquet(f"{out}/pinned/{name}/batch={batch_id}")
        live.write.mode("overwrite").parquet(_slot(state, name, batch_id))
        written.add(name)
        if name in apart:
            like = entities.select("cluster", *one.spec.keys, *entity_labels(one.spec))
            gone = _previous(spark, state, f"{name}-gone", batch_id, like, known)
            own, after = history_samples(one, previous, gone, entities, seen, fresh, namespace)
            after.write.mode("overwrite").parquet(_slot(state, f"{name}-gone", batch_id))
            written.add(f"{name}-gone")
            late = stored.join(fresh, list(SCOPE), "left_anti")
            parts += [own, spec_samples(one.spec, late, namespace)]
    samples = reduce(DataFrame.unionByName, parts).withColumn("date", F.to_date("ts"))
    samples.hint("rebalance", "date", "metric").write.mode("overwrite").partitionBy("date", "metric").parquet(
        f"{out}/samples/batch={batch_id}"
    )
    after = seen.unionByName(fresh).groupBy("cluster").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    if retain_days is not None:
        # Clusters that stopped reporting long ago leave the state.
        newest = after.agg(F.max("snapshot_ts")).first()[0]
        oldest = F.lit(newest) - F.make_dt_interval(days=F.lit(retain_days))
        after = after.filter(F.col("snapshot_ts") >= oldest)
    after.write.mode("overwrite").parquet(_slot(state, "seen", batch_id))
    marks = spark.createDataFrame([(n, batch_id) for n in sorted(written)], names.schema)
    marks.coalesce(1).write.mode("overwrite").parquet(_slot(state, "names", batch_id))


def start_collecting(
    spark: SparkSession,
    landing: str,
    out: str,
    name: str = "fleetlens",
    specs: Iterable[CollectorSpec] | None = None,
    tracked: Iterable[Tracked] = (),
    namespace: str = "fleet",
    interval: str | None = "15 seconds",
    max_files_per_trigger: int | None = None,
    retain_days: int | None = None,
    home: str | None = None,
    history: bool = False,
    feed_buckets: int | None = None,
) -> StreamingQuery:
    """Start the job. With ``interval=None`` it processes what has landed and stops.

    Checkpoint and entity tables live under ``home``, by default a folder called ``name`` in the shared folder of the
    cluster.
    """
    chosen = tuple(selected_specs() if specs is None else specs)
    followed = tuple(tracked)
    home = home or f"{shared_dir(spark)}/{name}"
    reader = spark.readStream.schema(table_schema("snapshots").add(DATE_COLUMN, "date"))
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    manifest = reader.parquet(f"{landing.rstrip('/')}/snapshots")

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        collect_batch(
            session, batch, batch_id, landing, out, f"{home}/state", chosen, followed, namespace, retain_days, history, feed_buckets
        )

    writer = manifest.writeStream.queryName(name).option("checkpointLocation", f"{home}/checkpoint").foreachBatch(run)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def stream_samples(
    spark: SparkSession, landing: str, spec: CollectorSpec, watermark: str = "1 minute", namespace: str = "fleet"
) -> DataFrame:
    """Samples of a collector with one input and one aggregation, as a streaming frame for append output.

    A snapshot's rows are final once the watermark on ``snapshot_ts`` has passed it.
    """
    if len(spec.inputs) != 1 or spec.inputs[0] not in TABLES:
        raise ValueError(f"{spec.name} reads more than one table")
    table = spec.inputs[0]
    rows = (
        spark.readStream.schema(table_schema(table).add(DATE_COLUMN, "date"))
        .parquet(f"{landing.rstrip('/')}/{table}")
        .drop(DATE_COLUMN)
        .withWatermark("snapshot_ts", watermark)
    )
    inputs: Mapping[str, DataFrame] = {table: rows}
    return spec_samples(spec, spec.transform(inputs), namespace)
