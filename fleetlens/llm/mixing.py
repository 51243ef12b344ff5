"""Mixing sources to target weights by subset sums.

Each source gets a target number of words. ``floor(target / size)`` whole passes over the source come first; what is left of the
target, less than one pass, is a subset-sum problem: choose documents whose word counts add up to it. Only the counts of
documents by exact length matter for that:

1. The same share of every length is taken, rounded down, so the choice keeps the source's mix of lengths.
2. One more of some lengths, longest first, until what remains is below ``dp_words``.
3. A bounded knapsack over the lengths still to be had finds the sum nearest to the remainder.

Then that many documents of each length are chosen by a seeded hash of their id. Where a length has very many documents, the
hash range is cut into cells and counted by cell, so only the cell in which the limit falls has to be ordered, about
``cell_rows`` rows of it.

Defined results: a null source is a source of its own, last in order. A null text has size 0 and takes nothing. Rows without an id
or with equal ids are ordered by a hash of their text too; of rows equal in both exactly as many are chosen as are wanted, and they are
numbered where they lie, so any number of them is spread over many tasks. A source of size 0 has target 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, numbered, settle

WEIGHTS = (5.0, 2.0, 1.0)


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[float, ...] = WEIGHTS  # of the sources in order, repeating
    share: float = 1.0  # of all words
    passes: int = 3  # no document is taken more often
    seed: int = 7
    dp_words: int = 1 << 16
    cell_rows: int = 1024
    most_cells: int = 1 << 16


def source_targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """``sizes`` (source, source_size) to the same with ``target``.

    With every source capped at ``passes`` times its size, sharing and resharing by weight ends at one level: the targets are
    least(level * weight, cap) and add up to the budget. In the order of cap / weight the level follows from running sums over the
    sources (one row each).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(spec.weights)
    table = F.array(*[F.lit(float(w)) for w in spec.weights])
    weighted = sizes.withColumn("weight", F.get(table, place)).withColumn("cap", (spec.passes * F.col("source_size")).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    budget = spec.share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source, in this order, that its cap does not bind fixes the level for itself and all after it.
    marked = weighted.withColumn("own", level).withColumn("free", F.col("cap") >= F.col("own") * F.col("weight"))
    fixed = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("own").alias("own")))).over(everything)["own"]
    target = F.coalesce(F.least(F.col("cap"), fixed * F.col("weight")), F.col("cap"))
    return marked.select("source", "source_size", target.alias("target"))


def choose_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``, or as near as found."""
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    # Whole numbers throughout: a float share could round up and overshoot.
    taken[:] = [int(c) * budget // total for c in counts]
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    spare = counts - taken
    while left > dp_words:
        before = left
        for k in order:
            if left <= dp_words:
                break
            more = min(1, int(spare[k])) if lengths[k] <= left else 0
            taken[k] += more
            spare[k] -= more
            left -= more * int(lengths[k])
        if left == before:
            break  # every length still to be had is longer than what is left
    return taken + _knapsack(lengths, spare, left)


def _knapsack(lengths: np.ndarray, spare: np.ndarray, left: int) -> np.ndarray:
    """Bounded knapsack: for each sum that can be reached, the step that reached it first."""
    room = left + int(lengths[spare > 0].min(initial=left + 1))  # one document may go over, if that is nearer
    came = np.full(room + 1, -1, np.int64)
    came[0] = 0
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    steps: list[tuple[int, int]] = [(0, 0)]
    for k in np.argsort(-lengths, kind="stable").tolist():
        have, piece = min(int(spare[k]), room // int(lengths[k])), 1
        while have and not reached[left]:
            piece = min(piece, have)
            width = piece * int(lengths[k])
            if width <= room:
                fresh = np.flatnonzero(reached[: room + 1 - width] & ~reached[width:]) + width
                steps.append((k, piece))
                came[fresh] = len(steps) - 1
                reached[fresh] = True
            have -= piece
            piece *= 2
        if reached[left]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    taken = np.zeros(len(lengths), np.int64)
    while at:
        k, piece = steps[came[at]]
        taken[k] += piece
        at -= piece * int(lengths[k])
    return taken


def length_plan(lengths: DataFrame, targets: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, size, passes, extra): whole passes, and how many documents of each length get one more."""

    def fit(key, group):
        size = group.column("size").to_numpy()
        counts = group.column("docs").to_numpy()
        total, target = int((size * counts).sum()), float(group.column("target")[0].as_py())
        passes = min(spec.passes, int(target // total)) if total else 0
        budget = min(max(0, round(target - passes * total)), (spec.passes - passes) * total)
        extra = choose_lengths(size, counts, budget, spec.dp_words)
        return pa.table(
            {
                "source": group.column("source"), "size": group.column("size"), "docs": group.column("docs"),
                "passes": pa.array(np.full(len(size), passes), pa.int32()), "extra": pa.array(extra, pa.int64()),
            }
        )

    joined = lengths.filter("size > 0").join(targets, lengths["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    return (
        joined.select("source", "size", "docs", "target").groupBy("source")
        .applyInArrow(fit, "source string, size long, docs long, passes int, extra long")
    )


def _measures(spec: MixSpec) -> tuple[Column, Column, Column]:
    """Source, size in words, and the seeded draw of a row of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(spec.seed), F.col("doc_id"), F.xxhash64(text)), 1)
    return F.col("source").cast("string"), F.regexp_count(text, F.lit(WORD)).cast("long"), draw


def mix_plan(docs: DataFrame, spec: MixSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(measured rows, targets by source, plan by source and size).

    The plan has one row per source and length: ``passes`` for all its documents, and one more for those whose (draw, doc_id) lies
    before (last_draw, last_id) and for ``last_take`` of the ``last_rows`` that share it; ``all_extra`` says that all get it.
    """
    source, size, draw = _measures(spec)
    measured = settle(docs.select("doc_id", source.alias("source"), size.alias("size"), draw.alias("draw")), "sizes")
    lengths = settle(measured.groupBy("source", "size").agg(F.count("*").alias("docs")), "lengths")
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = settle(source_targets(sizes, spec), "targets")
    plan = settle(length_plan(lengths, targets, spec), "length-plan")

    # Only lengths of which some documents get one more and others do not need an order among their documents.
    split = plan.filter("extra > 0 and extra < docs").withColumn(
        "cells", F.least(F.lit(spec.most_cells), F.ceil(F.col("docs") / spec.cell_rows)).cast("long")
    )
    same = measured["source"].eqNullSafe(split["source"]) & (measured["size"] == split["size"])
    cell = F.floor(F.col("draw") / F.ceil(F.lit(float(1 << 63)) / F.col("cells"))).cast("long")
    in_cells = measured.join(split, same).select(measured["source"], measured["size"], "doc_id", "draw", "extra", cell.alias("cell"))
    by_cell = in_cells.groupBy("source", "size", "extra", "cell").agg(F.count("*").alias("rows"))
    running = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = settle(
        by_cell.withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
        .filter("before < extra and before + rows >= extra")
        .select(F.col("source").alias("cut_source"), F.col("size").alias("cut_size"), F.col("cell").alias("edge"), (F.col("extra") - F.col("before")).alias("wanted")),
        "edge-cells",
    )
    here = F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("size") == F.col("cut_size")) & (F.col("cell") == F.col("edge"))
    order = Window.partitionBy("source", "size", "cell").orderBy("draw", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # Rows that share draw and id are one row here.
    alike = in_cells.join(cut, here).groupBy("source", "size", "cell", "wanted", "draw", "doc_id").agg(F.count("*").alias("last_rows"))
    limit = (
        alike.withColumn("last_take", F.col("wanted") - F.coalesce(F.sum("last_rows").over(order), F.lit(0)))
        .filter("last_take > 0 and last_take <= last_rows")
        .select(
            F.col("source").alias("cut_source"), F.col("size").alias("cut_size"), F.col("draw").alias("last_draw"), F.col("doc_id").alias("last_id"),
            "last_take", "last_rows",
        )
    )
    found = F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("size") == F.col("cut_size"))
    full = plan.join(limit, found, "left").select(
        F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), "passes",
        (F.col("extra") >= F.col("docs")).alias("all_extra"), (F.col("extra") > 0).alias("some_extra"), "last_draw", "last_id", "last_take", "last_rows",
    )
    return measured, targets, settle(full, "mix-plan")


def _chosen(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (row: a struct with source, size, draw and doc_id, and more) with ``times``, how often each is taken.

    Without a plan row, as for empty texts, never.
    """
    def p(name: str) -> Column:
        return F.col(f"plan.{name}")

    inner = plan.select(F.struct("*").alias("plan"))
    same = F.col("row.source").eqNullSafe(F.col("plan.plan_source")) & (F.col("row.size") == F.col("plan.plan_size"))
    planned = rows.join(inner, same, "left")
    doc_id, draw = F.col("row.doc_id"), F.col("row.draw")
    # Rows without an id come after all others of their draw.
    earlier = (draw < p("last_draw")) | ((draw == p("last_draw")) & F.coalesce(doc_id < p("last_id"), doc_id.isNotNull() & p("last_id").isNull()))
    last = (draw == p("last_draw")) & doc_id.eqNullSafe(p("last_id"))
    whole = F.col("last_take") >= F.col("last_rows")

    def times(last_too: Column) -> Column:
        chosen = p("all_extra") | (p("some_extra") & (earlier | (last & last_too)))
        return F.coalesce(p("passes") + F.when(chosen, 1).otherwise(0), F.lit(0)).cast("int").alias("times")

    if plan.filter(~whole).isEmpty():
        return planned.select("row", times(F.lit(True)))
    some = F.coalesce(last & (p("last_take") < p("last_rows")), F.lit(False))
    group = F.concat_ws(":", F.col("row.size").cast("string"), F.when(F.col("row.source").isNull(), "").otherwise(F.concat(F.lit("="), "row.source")))
    tied = numbered(planned.filter(some).withColumn("group", group), "group", [], "tied-rows")
    return planned.filter(~some).select("row", times(F.lit(True))).unionByName(tied.select("row", times(F.col("place") < p("last_take"))))


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """doc_id, size, source_size, target and taken words of each row of ``docs`` (doc_id, source, text)."""
    measured, targets, plan = mix_plan(docs, spec)
    taken = _chosen(measured.select(F.struct("*").alias("row")), plan).select("row.*", (F.col("row.size") * F.col("times")).cast("long").alias("taken"))
    of_source = targets.withColumnRenamed("source", "target_source")
    return taken.join(of_source, F.col("source").eqNullSafe(F.col("target_source")), "left").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them; documents without words go."""
    _, _, plan = mix_plan(docs, spec)
    source, size, draw = _measures(spec)
    rows = docs.select(F.struct("doc_id", source.alias("source"), size.alias("size"), draw.alias("draw"), F.struct("*").alias("doc")).alias("row"))
    copies = F.sequence(F.lit(1), F.col("times"))
    return (
        _chosen(rows, plan).select("row.doc", "times").filter("times > 0")
        .select("doc", F.explode(copies).alias("copy")).select("doc.*")
    )
