"""Bloom filters built by Spark in segments and used as one numpy bit array inside tasks.

An item has a key, which chooses one segment of 1 MiB, and two 64-bit hashes, which choose its bits inside the segment:
``first + i * (second | 1)``, scrambled and reduced to the segment's bits. Items with one key share a segment, so a key is sent to its
segment once, whatever number of items it stands for. Segments are built in as many parts as the number of items asks for, and the
parts are joined by OR, so the number of tasks grows with the input and not with the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix

SEGMENT_BITS = 1 << 23
PART_ITEMS = 1 << 21  # rows that one task puts into a segment
MOST_BITS = 1 << 30  # of a filter that only rules rows out; beyond that it is fuller and more rows are looked up
Hashes = tuple[np.ndarray, np.ndarray]


@dataclass
class Bloom:
    bits: np.ndarray  # bytes, eight bits each
    size: int  # in bits
    probes: int

    def starts(self, key: np.ndarray) -> np.ndarray:
        """Where the segment of each key begins, in bits."""
        segments, width = layout(self.size)
        return (key.view(np.int64) % segments).astype(np.uint64) * np.uint64(width)

    def contains(self, key: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each item may be in the filter; probes stop early for the items already ruled out."""
        return self.contains_at(self.starts(key), first, second)

    def contains_at(self, start: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``contains`` of items whose segments begin at ``start``. Quickest for some thousand items, the segments in order."""
        found = np.zeros(len(first), bool)
        alive = None  # all
        width = np.uint64(layout(self.size)[1])
        step, at = second | np.uint64(1), first
        for i in range(self.probes):
            if i:
                at = at + step
            bit = mix(at)
            bit = (bit - bit // width * width + start).view(np.int64)  # the remainder; numpy divides faster than it takes one
            hit = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            if not hit.all():
                alive = np.flatnonzero(hit) if alive is None else alive[hit]
                if not len(alive):
                    return found
                start, at, step = start[hit], at[hit], step[hit]
        found[slice(None) if alive is None else alive] = True
        return found


def layout(size: int) -> tuple[int, int]:
    """Segments of a filter and the bits of each, a multiple of eight."""
    segments = max(1, -(-size // SEGMENT_BITS))
    return segments, -(-size // (8 * segments)) * 8


def probe(first: np.ndarray, second: np.ndarray, i: int, width: int) -> np.ndarray:
    return mix(first + np.uint64(i) * (second | np.uint64(1))) % np.uint64(width)


def size_for(items: int, bits: int = 12) -> int:
    """Bits of a filter of so many items that only rules rows out."""
    return max(1 << 12, min(MOST_BITS, bits * items))


def batchwise(function: Callable) -> Callable:
    """The worker looks at these to tell batch-wise functions of a group from whole-table ones."""
    function.__annotations__ = {
        "key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch],
    }
    return function


def parts_of(rows: int, segments: int) -> int:
    """In how many parts each segment is built."""
    return max(1, -(-rows // (segments * PART_ITEMS)))


def build(items: DataFrame, hashes: Callable[[pa.RecordBatch], Hashes], size: int, probes: int, rows: int | None = None) -> Bloom:
    """The filter of all items; ``items`` has a long column ``key``, ``rows`` is their number where it is known.

    ``hashes`` turns a batch of ``items`` into the two hash arrays of what it inserts, all under the keys of their rows. A task builds
    its part of a segment from the rows with its share of the keys, batch by batch, and holds the bits only; another one ORs the parts.
    What reaches the driver is the filter itself, ``size`` bits whatever the number of items.
    """
    segments, width = layout(size)
    parts = parts_of(items.count() if rows is None else rows, segments)

    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, bool)
        for batch in batches:
            first, second = hashes(batch)
            for i in range(probes):
                held[probe(first, second, i, width)] = True
        packed = np.packbits(held, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([packed], pa.binary())], ["segment", "bits"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width // 8, np.uint8)
        for batch in batches:
            for bits in batch.column("bits"):
                held |= np.frombuffer(bits.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["segment", "bits"])

    placed = items.withColumn("segment", F.pmod("key", F.lit(segments).cast("long")))
    if parts == 1:
        filled = placed.groupBy("segment").applyInArrow(batchwise(fill), "segment long, bits binary")
    else:
        salted = placed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts).cast("long")))
        filled = salted.groupBy("segment", "part").applyInArrow(batchwise(fill), "segment long, bits binary")
        filled = filled.groupBy("segment").applyInArrow(batchwise(merge), "segment long, bits binary")
    held = np.zeros(segments * width // 8, np.uint8)
    for row in filled.collect():
        start = row.segment * width // 8
        held[start : start + width // 8] = np.frombuffer(row.bits, np.uint8)
    return Bloom(held, size, probes)


def row_key() -> Column:
    """The identity of a row for the stages that drop copies: its id and its text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"), 256))


def one_row_of_copies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``copies`` (row_key, stays: one row per key) says go; of rows that share a key that stays, one.

    A filter of the keys is broadcast. Rows that it rules out stay where they are; only the others, which are the copies and some
    false positives, meet ``copies`` in a join.
    """
    rows = copies.count()
    size = size_for(rows)

    def halves(batch: pa.RecordBatch) -> Hashes:
        keys = batch.column("key").to_numpy().view(np.uint64)
        return mix(keys), keys

    items = copies.select(F.xxhash64("row_key").alias("key"))
    bits = docs.sparkSession.sparkContext.broadcast(build(items, halves, size, 4, rows).bits)

    @F.pandas_udf("boolean")
    def listed(keys: pd.Series) -> pd.Series:
        own = keys.to_numpy().astype(np.int64).view(np.uint64)
        return pd.Series(Bloom(bits.value, size, 4).contains(own, mix(own), own))

    whole = docs.select(F.struct("*").alias("row"), row_key().alias("own_key"))
    maybe = listed(F.xxhash64("own_key"))
    met = whole.filter(maybe).join(copies, F.col("own_key") == F.col("row_key"), "left").filter("stays is null or stays")
    # Rows that only look listed are told apart by their number; those that share a key are reduced to one.
    apart = met.withColumn("own", F.when(F.col("stays").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return whole.filter(~maybe).select("row.*").unionByName(apart.dropDuplicates(["own_key", "own"]).select("row.*"))
