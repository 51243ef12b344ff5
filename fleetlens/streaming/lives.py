"""Lives of entities as a change log on keyed state, right for snapshots in any order of arrival.

A life is an unbroken run of snapshots that show an entity: ``from_ts`` and ``until_ts`` are its first and last one, ``gone_ts`` is
the first that misses it. A life that is still going on has neither ``until_ts`` nor ``gone_ts``, so a snapshot that changes nothing
writes nothing. ``sign`` is 1 for a life that holds from now on and -1 for one that is withdrawn: a late snapshot may split a life,
join two, move its ends or the labels pinned at its start, and the log then takes the old row back. The rows whose signs add up to
one are the lives as the batch operator :func:`~fleetlens.operators.lifecycle.entity_lives` finds them (:func:`current_lives`).

State is keyed by (cluster, bucket), where a bucket is a hash of the entity's key: a cluster is spread over as many keys as there are
buckets, and a batch reads and writes the state of the clusters it names and no other. Each row of the feed says in full which
entities of a bucket a snapshot shows, an empty list included, so absence is seen bucket by bucket and no row waits for another.

* A snapshot that is repeated is ignored, whatever it shows the second time; a feed that is written twice is harmless.
* With ``retain`` the state keeps that much time behind the newest snapshot of a cluster. Older snapshots that still arrive can't be
  placed; each gives a row per bucket with ``sign`` 0 and its time in ``from_ts``, and changes nothing.
* Rows with a null in their key, without cluster or time, or of snapshots that are not listed are left out, as in batch. Of rows that
  repeat an entity within a snapshot the greatest labels count.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from fleetlens.functions.ordered import expand_range, snapshot_spine
from fleetlens.functions.scope import SCOPE

FEED = "cluster string, bucket int, at bigint, members array<struct<entity:string,labels:string>>"
LOG = "cluster string, entity string, labels string, first bigint, last bigint, gone bigint, sign int"
BUCKETS = 64

Span = tuple[int, int | None]
Run = tuple[int, str]


def snapshot_feed(
    entities: DataFrame, keys: Sequence[str], labels: Sequence[str], snapshots: DataFrame, buckets: int = BUCKETS
) -> DataFrame:
    """One row per snapshot and bucket with the entities it shows, their keys and labels as JSON text.

    ``buckets`` should leave some thousand entities of the largest cluster to a bucket, and stays the same for the life of a log.
    """
    known = entities.select(*SCOPE, *keys, *labels).dropna(subset=[*SCOPE, *keys]).join(snapshots.select(*SCOPE).distinct(), list(SCOPE), "left_semi")
    one = known.groupBy(*SCOPE, *keys).agg(F.max(F.struct(F.lit(0).alias("_any"), *labels)).alias("_labels"))
    text = F.to_json(F.struct(*[F.col("_labels")[c].alias(c) for c in labels])) if labels else F.lit("{}")
    named = one.select(*SCOPE, F.to_json(F.struct(*keys)).alias("entity"), text.alias("labels"))
    shown = named.groupBy(*SCOPE, F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.collect_list(F.struct("entity", "labels")).alias("members")
    )
    listed = snapshots.select(*SCOPE).dropna().distinct()
    every = listed.select(*SCOPE, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    none = F.array().cast("array<struct<entity:string,labels:string>>")
    return every.join(shown, [*SCOPE, "bucket"], "left").select(
        "cluster", "bucket", F.unix_micros("snapshot_ts").alias("at"), F.coalesce("members", none).alias("members")
    )


def _label_at(runs: list[Run], at: int) -> str | None:
    """Labels hold from the time they were seen until others are."""
    found = bisect_left(runs, (at + 1,))
    return runs[found - 1][1] if found else None


def _place(spans: list[Span], at: int, before: int | None, after: int | None, present: bool) -> list[Span]:
    """Spans of an entity once the snapshot ``at``, between its neighbours, shows it or not."""
    if after is None:
        is_open = bool(spans) and spans[-1][1] is None
        if is_open == present:
            return spans
        return [*spans, (at, None)] if present else [*spans[:-1], (spans[-1][0], before)]
    out: list[Span] = []
    low, high = at, at
    covered = False
    for first, last in spans:
        if first < at and (last is None or last > at):
            covered = True
            out += [(first, last)] if present else [(first, before), (after, last)]
        elif present and last is not None and last == before:
            low = first
        elif present and first == after:
            high = last
        else:
            out.append((first, last))
    if present and not covered:
        out.append((low, high))
    return sorted(out, key=lambda s: s[0])


class Entity:
    """Lives of one entity and the labels it showed, in order of time."""

    def __init__(self, spans: list[Span], runs: list[Run]):
        self.spans, self.runs = spans, runs

    def see(self, at: int, before: int | None, after: int | None, labels: str | None) -> None:
        if labels is not None:
            self._label(at, after, labels)
        self.spans = _place(self.spans, at, before, after, labels is not None)

    def _label(self, at: int, after: int | None, labels: str) -> None:
        covered = any(first < at and (last is None or last > at) for first, last in self.spans)
        shown = after if covered else min((first for first, _ in self.spans if first > at), default=None)
        kept = None if shown is None else _label_at(self.runs, shown)
        if _label_at(self.runs, at) != labels:
            self.runs = sorted([*self.runs, (at, labels)])
        if shown is not None and _label_at(self.runs, shown) != kept:
            self.runs = sorted([*self.runs, (shown, kept)])

    def lives(self, spine: list[int]) -> set[tuple]:
        """(first, last, gone, labels) of each life."""
        out = set()
        for first, last in self.spans:
            gone = None if last is None else spine[bisect_left(spine, last + 1)]
            out.add((first, last, gone, _label_at(self.runs, first)))
        return out

    def forget(self, floor: int) -> None:
        """Leave out lives that ended before ``floor``, and labels that nothing later can need."""
        self.spans = [s for s in self.spans if s[1] is None or s[1] >= floor]
        needed = [floor, *(first for first, _ in self.spans)]
        held = {self.runs[bisect_left(self.runs, (t + 1,)) - 1] for t in needed if _label_at(self.runs, t) is not None}
        self.runs = [r for r in self.runs if r[0] > floor or r in held]


class LifeLog(StatefulProcessor):
    """Per (cluster, bucket): the times of its snapshots, and of each entity the lives and labels."""

    def __init__(self, retain: int | None = None):
        self.retain = retain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spine = handle.getValueState("spine", "times array<bigint>")
        self.entities = handle.getMapState(
            "entities", "entity string", "spans array<struct<first:bigint,last:bigint>>, runs array<struct<at:bigint,labels:string>>"
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cluster = key[0]
        spine = list(self.spine.get()[0]) if self.spine.exists() else []
        held = {
            k[0]: Entity([tuple(s) for s in v[0]], [tuple(r) for r in v[1]]) for k, v in self.entities.iterator()
        }
        stored = {name: (e.spans, e.runs) for name, e in held.items()}
        before = {name: e.lives(spine) for name, e in held.items()}
        for row in rows:
            at = row["at"]
            if self.retain is not None and spine and at < spine[-1] - self.retain:
                yield Row(cluster=cluster, entity=None, labels=None, first=at, last=None, gone=None, sign=0)
                continue
            where = bisect_left(spine, at)
            if where < len(spine) and spine[where] == at:
                continue
            shown = {m["entity"]: m["labels"] for m in row["members"]}
            for name in shown.keys() - held.keys():
                held[name] = Entity([], [])
            earlier = spine[where - 1] if where else None
            later = spine[where] if where < len(spine) else None
            for name, entity in held.items():
                entity.see(at, earlier, later, shown.get(name))
            spine.insert(where, at)
        for name, entity in held.items():
            old, new = before.get(name, set()), entity.lives(spine)
            for sign, lives in ((-1, old - new), (1, new - old)):
                for first, last, gone, labels in lives:
                    yield Row(cluster=cluster, entity=name, labels=labels, first=first, last=last, gone=gone, sign=sign)
        self._keep(spine, held, stored)

    def _keep(self, spine: list[int], held: dict[str, Entity], stored: dict[str, tuple]) -> None:
        """Write what changed. The newest snapshot beyond what is retained stays, as the neighbour of those after it."""
        if self.retain is not None and spine:
            spine = spine[max(0, bisect_left(spine, spine[-1] - self.retain) - 1):]
        self.spine.update((spine,))
        for name, entity in held.items():
            if self.retain is not None and spine:
                entity.forget(spine[0])
            if not entity.spans:
                if name in stored:
                    self.entities.removeKey((name,))
            elif (entity.spans, entity.runs) != stored.get(name):
                self.entities.updateValue((name,), (entity.spans, entity.runs))

    def close(self) -> None:
        pass


def life_log(feed: DataFrame, keys: StructType, labels: StructType, retain_seconds: int | None = None) -> DataFrame:
    """The log of a feed (a stream, or a table taken as one batch), with the key and label columns of the given types."""
    retain = None if retain_seconds is None else retain_seconds * 1_000_000
    # Executors look for the driver's registry of state, which a session without a stream has not started yet; naming its streams does.
    _ = feed.sparkSession.streams.active
    log = feed.groupBy("cluster", "bucket").transformWithState(LifeLog(retain), LOG, "Append", "None")
    read = {"_keys": F.from_json("entity", keys), "_labels": F.from_json("labels", labels)}
    instants = [F.timestamp_micros(source).alias(name) for source, name in (("first", "from_ts"), ("last", "until_ts"), ("gone", "gone_ts"))]
    named = [F.col(part)[c].alias(c) for part, kinds in (("_keys", keys), ("_labels", labels)) for c in kinds.names]
    return log.withColumns(read).select("cluster", *named, *instants, "sign")


def current_lives(log: DataFrame) -> DataFrame:
    """The lives that stand after all corrections."""
    columns = [c for c in log.columns if c != "sign"]
    total = log.groupBy(*columns).agg(F.sum("sign").alias("_sign"))
    return total.filter("_sign > 0").select(*columns)


def life_changes(lives: DataFrame, keys: Sequence[str], labels: Sequence[str], snapshots: DataFrame) -> DataFrame:
    """What :func:`~fleetlens.operators.lifecycle.entity_changes` gives, from lives: ``new``, ``kept``, ``deleted``, with pinned labels.

    A life is expanded along the numbers of its snapshots, block by block; rows of entities are not read.
    """
    spine = snapshot_spine(snapshots)
    born = spine.select("cluster", F.col("snapshot_ts").alias("from_ts"), F.col("idx").alias("_low"), "last_idx")
    died = spine.select("cluster", F.col("snapshot_ts").alias("gone_ts"), F.col("idx").alias("_gone"))
    placed = lives.join(born, ["cluster", "from_ts"]).join(died, ["cluster", "gone_ts"], "left")
    bounds = placed.select("cluster", *keys, *labels, "_low", "_gone", F.col("_low").alias("_from"), F.coalesce("_gone", "last_idx").alias("_to"))
    rows = expand_range(bounds, "_from", "_to", "idx").join(spine.select("cluster", "idx", "snapshot_ts"), ["cluster", "idx"])
    change = F.when(F.col("idx") == F.col("_low"), "new").when(F.col("idx") == F.col("_gone"), "deleted").otherwise("kept")
    return rows.select(*SCOPE, *keys, *labels, change.alias("change"))


def start_lives(
    spark: SparkSession,
    feed: str,
    out: str,
    home: str,
    keys: StructType,
    labels: StructType,
    retain_seconds: int | None = None,
    interval: str | None = "15 seconds",
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Keep the log of a feed folder under ``out``; state and progress live under ``home``. ``interval=None`` stops at the feed's end.

    A batch of the collecting job that is repeated replaces its feed files by equal ones. A file that is gone has such a
    successor, so it is passed over.
    """
    reader = spark.readStream.schema(FEED).option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    log = life_log(reader.parquet(feed), keys, labels, retain_seconds)
    writer = log.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", home)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
