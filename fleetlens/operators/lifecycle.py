"""Entities across snapshots: appearance, disappearance, what their metrics show meanwhile.

Presence is compared between neighbouring snapshots by marking every entity row twice, once in its own snapshot and
once in the next, and aggregating the marks by (cluster, entity, snapshot). Nothing is ordered per entity or per
cluster, so neither a cluster nor an entity with a very long history ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.ordered import (
    block_chunk, day_chunk, expand_range, fill_forward, next_in_order, snapshot_spine,
)
from fleetlens.functions.scope import SCOPE

ABSENT_POLICIES = ("remove", "nan", "zero")


def _marks(entities: DataFrame, keys: Sequence[str], spine: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Per (cluster, key, snapshot): was it there, was it there one snapshot earlier, and its payload.

    Without payload the aggregation state is two flags, which hash aggregation updates in place.
    """
    rows = entities.select(*SCOPE, *keys, *payload).join(spine, list(SCOPE))
    data = [F.struct(*payload).alias("data")] if payload else []
    no_data = [F.lit(None).cast(rows.select(*data).schema["data"].dataType).alias("data")] if payload else []
    here = F.struct("snapshot_ts", "idx", F.lit(True).alias("present"), *data)
    later = F.struct(
        F.col("next_ts").alias("snapshot_ts"), (F.col("idx") + 1).alias("idx"), F.lit(False).alias("present"), *no_data
    )
    marks = rows.select(
        "cluster", *keys, "last_idx", F.explode(F.array(here, F.when(F.col("next_ts").isNotNull(), later))).alias("_m")
    ).filter(F.col("_m").isNotNull())
    return marks.groupBy("cluster", *keys, "_m.snapshot_ts", "_m.idx", "last_idx").agg(
        F.max("_m.present").alias("_present"),
        F.max(~F.col("_m.present")).alias("_before"),
        *([F.max("_m.data").alias("_data")] if payload else []),
    )


def _change() -> Column:
    return (
        F.when(F.col("_present") & F.col("_before"), F.lit("kept"))
        .when(F.col("_present"), F.lit("new"))
        .otherwise(F.lit("deleted"))
    )


def entity_changes(entities: DataFrame, keys: Sequence[str], snapshots: DataFrame | None = None) -> DataFrame:
    """``new``, ``kept`` and ``deleted`` keys of every snapshot.

    ``snapshots`` lists all (successful) snapshots, so that one without any entity still ends their lives.
    """
    spine = snapshot_spine(entities if snapshots is None else snapshots)
    return _marks(entities, keys, spine).select(*SCOPE, *keys, _change().alias("change"))


def absence_spans(entities: DataFrame, keys: Sequence[str], snapshots: DataFrame | None = None) -> DataFrame:
    """One row per absence: ``cluster, keys, from_idx, until_idx``, the numbers of the first and last snapshot without the entity.

    This is the compact result: an entity that is gone for a month is one row, however often its cluster was looked at.
    """
    spine = snapshot_spine(entities if snapshots is None else snapshots)
    turns = _marks(entities, keys, spine).withColumn("change", _change()).filter(F.col("change") != "kept")
    # Turns alternate between new and deleted, so an absence ends right before the turn that follows it.
    followed = next_in_order(
        turns.select("cluster", *keys, "idx", "last_idx", "change"), ["cluster", *keys], "idx", "_turn", block_chunk("idx")
    )
    return followed.filter(F.col("change") == "deleted").select(
        "cluster", *keys, F.col("idx").alias("from_idx"), F.coalesce(F.col("_turn") - 1, F.col("last_idx")).alias("until_idx")
    )


def entity_lives(
    entities: DataFrame, keys: Sequence[str], labels: Sequence[str] = (), snapshots: DataFrame | None = None
) -> DataFrame:
    """One row per life: ``cluster, keys, labels, from_ts, until_ts, gone_ts``, with the labels of its first snapshot.

    ``until_ts`` is the last snapshot that shows the entity, ``gone_ts`` the one after it; both are NULL while it is there.
    Rows with a NULL in their key have no life.
    """
    spine = snapshot_spine(entities if snapshots is None else snapshots)
    marks = _marks(entities, keys, spine, labels).withColumn("change", _change()).filter(F.col("change") != "kept")
    first = [F.col("_data")[c].alias(c) for c in labels]
    turns = marks.select("cluster", *keys, "idx", "snapshot_ts", "change", *first)
    followed = next_in_order(turns, ["cluster", *keys], "idx", "_turn", block_chunk("idx")).filter(F.col("change") == "new")
    ends = spine.select("cluster", (F.col("idx") + 1).alias("_turn"), F.col("snapshot_ts").alias("until_ts"), F.col("next_ts").alias("gone_ts"))
    return followed.join(ends, ["cluster", "_turn"], "left").select(
        "cluster", *keys, *labels, F.col("snapshot_ts").alias("from_ts"),
        F.when(F.col("_turn").isNotNull(), F.col("until_ts")).alias("until_ts"), F.when(F.col("_turn").isNotNull(), F.col("gone_ts")).alias("gone_ts"),
    )


def absent_policy(
    entities: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    policy: str,
    snapshots: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Values of every known entity in every snapshot from its first sight on.

    ``remove``: an absent entity has no row. ``nan`` / ``zero``: it keeps a row with that value until it returns. Absences are
    expanded in place, and only for the snapshots between ``start`` and ``end`` where these are given; rows of present entities are
    cut to the same range.
    """
    if policy not in ABSENT_POLICIES:
        raise ValueError(f"policy {policy!r} is not one of {ABSENT_POLICIES}")

    def asked(df: DataFrame) -> DataFrame:
        for bound, keep in ((start, lambda b: F.col("snapshot_ts") >= b), (end, lambda b: F.col("snapshot_ts") <= b)):
            df = df if bound is None else df.filter(keep(F.lit(bound).cast("timestamp")))
        return df

    present = asked(entities.select(*SCOPE, *keys, *[F.col(v).cast("double").alias(v) for v in values]))
    if policy == "remove":
        return present
    fill = F.lit(float("nan") if policy == "nan" else 0.0)
    spine = snapshot_spine(entities if snapshots is None else snapshots)
    wanted = asked(spine)
    spans = absence_spans(entities, keys, snapshots)
    if start is not None or end is not None:
        reach = wanted.groupBy("cluster").agg(F.min("idx").alias("_low"), F.max("idx").alias("_high"))
        spans = spans.join(reach, "cluster").select(
            "cluster", *keys, F.greatest("from_idx", "_low").alias("from_idx"), F.least("until_idx", "_high").alias("until_idx")
        ).filter("from_idx <= until_idx")
    gaps = expand_range(spans, "from_idx", "until_idx", "idx")
    absent = gaps.join(wanted.select("cluster", "idx", "snapshot_ts"), ["cluster", "idx"]).select(
        *SCOPE, *keys, *[fill.alias(v) for v in values]
    )
    return present.unionByName(absent)


def pinned_labels(
    entities: DataFrame,
    keys: Sequence[str],
    labels: Sequence[str],
    values: Sequence[str] = (),
    snapshots: DataFrame | None = None,
    removed: bool = True,
) -> DataFrame:
    """Entity rows with the labels they had when first seen; only values move.

    With ``removed`` the labels are pinned anew whenever the entity returns after an absence, without it they stay
    from the very first sight.
    """
    if not removed:
        first = entities.groupBy("cluster", *keys).agg(F.min_by(F.struct(*labels), "snapshot_ts").alias("_pin"))
        return (
            entities.select(*SCOPE, *keys, *values)
            .join(first, ["cluster", *keys])
            .select(*SCOPE, *keys, *values, "_pin.*")
        )
    spine = snapshot_spine(entities if snapshots is None else snapshots)
    birth = F.when(~F.col("_before"), F.struct(*[F.col("_data")[c].alias(c) for c in labels]))
    rows = (
        _marks(entities, keys, spine, [*labels, *values])
        .filter("_present")
        .select(*SCOPE, *keys, *[F.col("_data")[v].alias(v) for v in values], birth.alias("_pin"))
    )
    pinned = fill_forward(rows, ["cluster", *keys], ["snapshot_ts"], ["_pin"], day_chunk("snapshot_ts"))
    return pinned.select(*SCOPE, *keys, *values, "_pin.*")


def _problem(keys: Sequence[str], values: Sequence[str]) -> Column:
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    no_value = reduce(Column.__and__, [F.col(v).isNull() for v in values])
    return F.when(no_key, F.lit("null key")).when(no_value, F.lit("null value"))


def validate_entities(entities: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows that break the entity contract, with the reason; empty when all is well."""
    return entities.withColumn("problem", _problem(keys, values)).filter(F.col("problem").isNotNull())


def sound_entities(entities: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows that keep the contract."""
    return entities.filter(_problem(keys, values).isNull())


def good_intervals(snapshots: DataFrame, ok: str = "ok") -> DataFrame:
    """``cluster, source_ts, until_ts``: for how long each good snapshot stands, up to the snapshot before the next good one.

    One row per good snapshot, whatever number of failed ones it stands in for; rows of entities are not touched.
    """
    spine = snapshots.groupBy(*SCOPE).agg(F.when(F.max(ok), F.col("snapshot_ts")).alias("source_ts"))
    held = fill_forward(spine, ["cluster"], ["snapshot_ts"], ["source_ts"], day_chunk("snapshot_ts")).filter(F.col("source_ts").isNotNull())
    return held.groupBy("cluster", "source_ts").agg(F.max("snapshot_ts").alias("until_ts"))


def entities_at(entities: DataFrame, intervals: DataFrame, times: DataFrame) -> DataFrame:
    """Entities as they stood at the ``times`` (cluster, ts) asked for: rows of the good snapshot whose interval holds the time.

    The as-of join is an interval join bucketed by day over snapshots; only then are the rows of the snapshots met that were hit.
    """
    by_day = intervals.select(
        "cluster", "source_ts", "until_ts", F.explode(F.sequence(F.to_date("source_ts"), F.to_date("until_ts"))).alias("_day")
    )
    met = times.select("cluster", "ts").distinct().withColumn("_day", F.to_date("ts")).join(by_day, ["cluster", "_day"])
    hit = met.filter((F.col("source_ts") <= F.col("ts")) & (F.col("ts") <= F.col("until_ts"))).select("cluster", "ts", "source_ts")
    rest = [c for c in entities.columns if c not in SCOPE]
    rows = entities.withColumnRenamed("snapshot_ts", "source_ts").join(hit, ["cluster", "source_ts"])
    return rows.select("cluster", F.col("ts").alias("snapshot_ts"), "source_ts", *rest)


def carry_forward(entities: DataFrame, snapshots: DataFrame, ok: str = "ok") -> DataFrame:
    """The last good snapshot of a cluster, repeated for snapshots that failed after it.

    ``snapshots`` lists all snapshots with a success flag. Rows of failed snapshots are ignored. ``source_ts`` is the
    snapshot the values come from.
    """
    good = F.when(F.max(ok), F.col("snapshot_ts"))
    spine = snapshots.groupBy(*SCOPE).agg(good.alias("source_ts"))
    carried = fill_forward(spine, ["cluster"], ["snapshot_ts"], ["source_ts"], day_chunk("snapshot_ts")).filter(
        F.col("source_ts").isNotNull()
    )
    source = entities.withColumnRenamed("snapshot_ts", "source_ts")
    rest = [c for c in entities.columns if c not in SCOPE]
    return carried.select(*SCOPE, "source_ts").join(source, ["cluster", "source_ts"]).select(*SCOPE, "source_ts", *rest)
