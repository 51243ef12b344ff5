"""Ordered computations over long per-key histories.

A plain window over one key puts that key's whole history into one task. Here a history is cut into chunks (days,
hours or blocks of numbers, as the caller says): windows run inside a chunk, one summary row per chunk is carried across chunks, and the two
are joined. A key that holds a third of all rows is then spread over as many tasks as it has chunks, and the only
per-key window runs over the chunk summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_CHUNK = "_chunk"
_BEFORE = (Window.unboundedPreceding, -1)


def day_chunk(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def hour_chunk(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts))


# Numbers per block of an ordinal. Blocks keep both the rows of a window and the arrays of an expansion short.
BLOCK = 4096


def block_chunk(number: str) -> Column:
    return F.floor(F.col(number) / F.lit(BLOCK))


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Rows with a key and a chunk. The test stands here because the join with the edges implies it for them; without it
    the two sides would differ below their shuffle and each would run it."""
    out = df.withColumn(_CHUNK, chunk)
    return out.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, _CHUNK)]))


def _edge_rows(inner: DataFrame, keys: Sequence[str], pick, order: Column) -> DataFrame:
    """First or last whole row of each chunk, as ``_edge``.

    The whole row is taken, though only some of its columns are needed: the rows and their edges then ask the shuffle
    below them for the same columns, so Spark runs that shuffle, and all that feeds it, once and reads it twice.
    """
    rest = [c for c in inner.columns if c not in keys and c != _CHUNK]
    return inner.groupBy(*keys, _CHUNK).agg(pick(F.struct(*rest), order).alias("_edge"))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: Column
) -> DataFrame:
    """Replace each of ``columns`` by its running total up to and including the row.

    Rows without a key are left out; ``order`` must be total.
    """
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chunked = _chunked(df, keys, chunk)
    inner = chunked.select(
        *[F.sum(c).over(inside).alias(c) if c in columns else F.col(c) for c in chunked.columns]
    )
    across = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(*_BEFORE)
    carry = _edge_rows(inner, keys, F.max_by, F.struct(*order)).select(
        *keys, _CHUNK, *[F.sum(F.col("_edge")[c]).over(across).alias(f"_carry_{c}") for c in columns]
    )
    joined = inner.join(carry, [*keys, _CHUNK], "left")
    total = lambda c: F.coalesce(f"_carry_{c}", F.lit(0)) + F.coalesce(c, F.lit(0))
    return joined.select(*[total(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: Column
) -> DataFrame:
    """Replace NULLs in ``columns`` by the last non-null value before the row.

    Rows without a key are left out; ``order`` must be total and must not contain the filled columns.
    """
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chunked = _chunked(df, keys, chunk)
    inner = chunked.select(
        *[F.last(c, ignorenulls=True).over(inside).alias(c) if c in columns else F.col(c) for c in chunked.columns]
    )
    across = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(*_BEFORE)
    carry = _edge_rows(inner, keys, F.max_by, F.struct(*order)).select(
        *keys,
        _CHUNK,
        *[F.last(F.col("_edge")[c], ignorenulls=True).over(across).alias(f"_carry_{c}") for c in columns],
    )
    joined = inner.join(carry, [*keys, _CHUNK], "left")
    return joined.select(*[F.coalesce(c, f"_carry_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def next_in_order(df: DataFrame, keys: Sequence[str], order: str, out: str, chunk: Column) -> DataFrame:
    """Add the following value of ``order`` within the key, NULL at the end. ``order`` must be unique per key."""
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    inner = _chunked(df, keys, chunk).withColumn(out, F.lead(order).over(inside))
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    carry = _edge_rows(inner, keys, F.min_by, F.col(order)).select(
        *keys, _CHUNK, F.lead(F.col("_edge")[order]).over(across).alias("_carry")
    )
    joined = inner.join(carry, [*keys, _CHUNK], "left")
    return joined.select(*df.columns, F.coalesce(out, "_carry").alias(out))


def expand_range(df: DataFrame, low: str, high: str, out: str) -> DataFrame:
    """One row for each number from ``low`` to ``high``, block by block, so no long array is ever built."""
    keep = [c for c in df.columns if c not in (low, high)]
    first_block, last_block = block_chunk(low), block_chunk(high)
    blocks = df.filter(F.col(low) <= F.col(high)).select(
        *keep, low, high, F.explode(F.sequence(first_block, last_block)).alias("_block")
    )
    start = F.greatest(F.col(low), F.col("_block") * BLOCK)
    stop = F.least(F.col(high), F.col("_block") * BLOCK + (BLOCK - 1))
    return blocks.select(*keep, F.explode(F.sequence(start, stop)).alias(out))


def snapshot_spine(snapshots: DataFrame, key: str = "cluster", ts: str = "snapshot_ts") -> DataFrame:
    """Distinct snapshots of each cluster, numbered: ``cluster, snapshot_ts, idx, next_ts, last_idx``."""
    spine = snapshots.select(key, ts).distinct().withColumn(_CHUNK, day_chunk(ts))
    inside = Window.partitionBy(key, _CHUNK).orderBy(ts)
    inner = spine.withColumns(
        {"_pos": F.row_number().over(inside), "_next": F.lead(ts).over(inside)}
    )
    days = inner.groupBy(key, _CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first"))
    across = Window.partitionBy(key).orderBy(_CHUNK)
    carry = days.select(
        key,
        _CHUNK,
        F.coalesce(F.sum("_n").over(across.rowsBetween(*_BEFORE)), F.lit(0)).alias("_offset"),
        F.lead("_first").over(across).alias("_next_first"),
        (F.sum("_n").over(Window.partitionBy(key)) - 1).alias("last_idx"),
    )
    return inner.join(carry, [key, _CHUNK], "left").select(
        key,
        ts,
        (F.col("_offset") + F.col("_pos") - 1).cast("long").alias("idx"),
        F.coalesce("_next", "_next_first").alias("next_ts"),
        F.col("last_idx").cast("long").alias("last_idx"),
    )
