"""How five filters interact, in every order in which they could be applied.

Each text is read once by a finite-state transducer over its UTF-8 bytes. A byte's class and the state before it (in a gap or in a
word) choose a row of a table that says what the byte does: begin or end a word, count a code point, a capital or a symbol. Whole
runs of documents go through the table at once. The spans of words are put into an open hash table, keyed by document and hash;
what a slot holds is compared byte by byte, so two words that share a hash stay two, and the number of filled slots is the number of
distinct words.

What is left of a document is a mask of the filters it fails. Masks are counted by part, quality and toxicity (at most 32 masks a part), and
all orders are worked out from those counts: a document is removed by the first filter of the order that is in its mask.

Filters (fixed rules): A under 200 words; B fewer distinct words than half the words; C more than 2 % capitals of the code points; D
any of ``#$%&*|``; E another row with a smaller id has the same text.

Defined results: a null text is empty. Rows without an id never fail E and never make others fail; rows that repeat an id and a text
do not make each other fail. Rows of a source that is null or empty are one part. A document is good or toxic if any of its label rows says
so; rows without an id have no labels. Repeated rows count as often as they come. Very long texts go through the transducer in
pieces cut at spaces. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix, settle

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
RUN_BYTES = 1 << 20

# Classes of bytes, and what the transducer does on a byte of each class in either state.
GAP, CAPITAL, SYMBOL, INNER, OTHER = range(5)
BEGIN, END, POINT, UPPER, SIGN = 1, 2, 4, 8, 16
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = INNER  # a byte inside a character
CLASS[0x41:0x5B] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[[0x20, *range(0x09, 0x0E)]] = GAP
IN_WORD = np.array([0, 1, 1, 1, 1], np.uint8)  # the state after a byte of each class
ACTIONS = np.array(
    [
        [POINT, BEGIN | POINT | UPPER, BEGIN | POINT | SIGN, BEGIN, BEGIN | POINT],  # in a gap
        [END | POINT, POINT | UPPER, POINT | SIGN, 0, POINT],  # in a word
    ],
    np.uint8,
)


class Spans:
    """Spans of words in a buffer, read eight bytes at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray):
        padded = np.r_[data, np.zeros(8, np.uint8)]
        self.windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.starts, self.sizes, self.docs = starts, ends - starts, docs

    def block(self, spans: np.ndarray, j: int) -> np.ndarray:
        """Bytes 8 j to 8 j + 8 of each span, zeros after its end; only for spans longer than 8 j."""
        raw = self.windows[self.starts[spans] + 8 * j].view("<u8").ravel()
        left = np.minimum(self.sizes[spans] - 8 * j, 8).astype(np.uint64)
        return raw & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))

    def hashes(self) -> np.ndarray:
        found = mix(self.docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.sizes.astype(np.uint64))
        spans, j = np.arange(len(self.starts)), 0
        while len(spans):
            found[spans] = mix(found[spans] ^ self.block(spans, j))
            j += 1
            spans = spans[self.sizes[spans] > 8 * j]
        return found

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (self.docs[a] == self.docs[b]) & (self.sizes[a] == self.sizes[b])
        open_, j = np.flatnonzero(same), 0
        while len(open_):
            differs = self.block(a[open_], j) != self.block(b[open_], j)
            same[open_[differs]] = False
            j += 1
            open_ = open_[~differs]
            open_ = open_[self.sizes[a[open_]] > 8 * j]
        return same

    def distinct(self, hashes: np.ndarray | None = None) -> np.ndarray:
        """One span for each distinct word of each document: the filled slots of the hash table."""
        hashes = self.hashes() if hashes is None else hashes
        size = 1 << max(4, int(2 * len(hashes)).bit_length())
        table = np.full(size, -1, np.int64)
        waiting, slots = np.arange(len(hashes)), (hashes & np.uint64(size - 1)).astype(np.int64)
        while len(waiting):
            free = table[slots] < 0
            table[slots[free]] = waiting[free]
            lost = ~self.equal(waiting, table[slots])  # the slot holds another word
            waiting, slots = waiting[lost], (slots[lost] + 1) & (size - 1)
        return table[table >= 0]


def transduce(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, Spans]:
    """(words, capitals, code points, symbols) of each document, one column each, and the spans of their words.

    Document i is ``data[bounds[i]:bounds[i + 1]]``.
    """
    n = len(bounds) - 1
    classes = CLASS[data]
    state = IN_WORD[classes]
    before = np.zeros(len(data), np.uint8)
    before[1:] = state[:-1]
    nonempty = bounds[1:] > bounds[:-1]
    before[bounds[:-1][nonempty]] = 0
    done = ACTIONS[before, classes]
    ended = np.zeros(len(data) + 1, bool)
    ended[:-1] = done & END != 0
    last = bounds[1:][nonempty]
    ended[last] |= state[last - 1] == 1

    def counted(action: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(done & action)
        doc = np.searchsorted(bounds, at, "right") - 1
        return at, doc

    starts, doc = counted(BEGIN)
    running = np.r_[0, np.cumsum(done & POINT != 0)]
    counts = np.stack(
        [
            np.bincount(doc, minlength=n), np.bincount(counted(UPPER)[1], minlength=n),
            running[bounds[1:]] - running[bounds[:-1]], np.bincount(counted(SIGN)[1], minlength=n),
        ],
        axis=1,
    )
    return counts, Spans(data, starts, np.flatnonzero(ended), doc)


def measure(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, distinct words, capitals, code points, symbols) of each document of a run."""
    counts, spans = transduce(data, bounds)
    distinct = np.bincount(spans.docs[spans.distinct()], minlength=len(bounds) - 1)
    return np.insert(counts, 1, distinct, axis=1)


def measure_long(data: np.ndarray, piece: int = RUN_BYTES) -> np.ndarray:
    """The same for one long document, in pieces that end at a space."""
    total, words, start = np.zeros(4, np.int64), set(), 0
    while start < len(data):
        end = min(start + piece, len(data))
        while end < len(data):
            gaps = np.flatnonzero(CLASS[data[end : end + piece]] == GAP)
            end = end + int(gaps[0]) if len(gaps) else min(end + piece, len(data))
            if len(gaps):
                break
        part = data[start:end]
        counts, spans = transduce(part, np.array([0, len(part)]))
        total += counts[0]
        held = spans.distinct()
        words.update(part[s : s + k].tobytes() for s, k in zip(spans.starts[held].tolist(), spans.sizes[held].tolist()))
        start = end
    return np.insert(total, 1, len(words))


def measure_all(data: np.ndarray, bounds: np.ndarray, run: int = RUN_BYTES) -> np.ndarray:
    """All documents of a buffer, in runs of about ``run`` bytes."""
    parts, first, n = [], 0, len(bounds) - 1
    while first < n:
        end = int(np.searchsorted(bounds, bounds[first] + run, "right")) - 1
        if end <= first:
            parts.append(measure_long(data[bounds[first] : bounds[first + 1]], run)[None])
            end = first + 1
        else:
            parts.append(measure(data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]))
        first = end
    return np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow column of texts without nulls, not copied."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, name (the digest of the text), mask of the filters A to D, for each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, distinct, capitals, points, signs = measure_all(*buffers(batch.column("text"))).T
            mask = (
                (words < FEW_WORDS) + 2 * (100 * distinct < DISTINCT_PERCENT * words)
                + 4 * (100 * capitals > CAPITAL_PERCENT * points) + 8 * (signs > 0)
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "name")), pa.array(mask, pa.int32())], ["doc_id", "part", "name", "mask"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("name"), text.alias("text"),
    )
    return rows.mapInArrow(read, f"doc_id {kind}, part string, name binary, mask int")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: documents by the filters they fail, and how many of them are labelled good or toxic."""
    rows = settle(own_failures(docs), "audit-rows")
    # Only texts that several rows have are joined back, from a written table; Spark splits the partitions a large group makes.
    again = rows.groupBy("name").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows"))
    again = settle(again.filter("rows > 1 and least_id is not null").select("name", "least_id"), "audit-texts")
    later = F.coalesce(F.col("doc_id") > F.col("least_id"), F.lit(False))
    masked = rows.join(again, "name", "left").select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))

    def said(column: str) -> Column:
        return F.max(F.when(F.col(column) == 1, 1).otherwise(0)).alias(column)

    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(said("quality"), said("toxic"))
    each = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("docs"))  # repeated ids are one row before the join

    def where(column: str) -> Column:
        return F.sum(F.when(F.col(column) == 1, F.col("docs")).otherwise(0))

    return (
        each.join(known, each["doc_id"] == known["label_id"], "left").groupBy("part", "mask")
        .agg(F.sum("docs").alias("docs"), where("quality").alias("good"), where("toxic").alias("toxic"))
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each, for every order of the filters."""
    counts = settle(failure_counts(docs, labels), "audit-counts")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))  # 32 at most
    cases = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            cases.append(("".join(order), step, before, bit))
            before |= bit
    orders = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(x).alias("bit")) for o, s, b, x in cases])
    rows = parts.select("part", "cells", F.inline(orders))

    def total(chosen, value) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(chosen(c["mask"]), value(c)).otherwise(F.lit(0)).cast("long"))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("bit")) != 0

    def gone(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("before")) != 0

    def removed(mask: Column) -> Column:
        return fails(mask) & ~gone(mask)

    # Of all orders of k filters each comes first in one of k.
    n_orders = len(cases) // len(FILTERS)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~gone(m), lambda c: c["docs"]).alias("kept"),
        total(removed, lambda c: c["docs"]).alias("removed"),
        total(lambda m: fails(m) & gone(m), lambda c: c["docs"]).alias("redundant"),
        total(lambda m: m == F.col("bit"), lambda c: c["docs"]).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["docs"] * (F.lit(n_orders) / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )
