"""Exact duplicates by content-defined chunk recipes.

A text (A to Z lower-cased, UTF-8) is cut where a rolling hash of its last 32 bytes hits a pattern, so equal texts get equal
cuts. Each chunk is named by a digest and a text by its recipe, the ordered list of its chunks' names. Two texts are equal if
and only if their recipes are, provided no two different chunks share a name; that is verified: the contents of all chunks whose
name occurs more than once are moved once, reduced to distinct (name, content) pairs on the way, and counted by name. If a name
turns out to have two contents, all names are made anew with the next seed and a longer digest, until none has.

Texts are never moved for the comparison itself; only recipes are (16 bytes for about 2 KB of text).

Defined results: a null text counts as empty and has the empty recipe. Of equal texts the row with the largest id stays; rows
without an id come before all others. Rows that repeat both id and text are one document: all get the same result. An empty table
gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bloom import Bloom, build, one_row_of_copies, row_key, size_for
from .common import settle

# Random numbers for the rolling hash, one per byte value.
GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class ChunkSpec:
    least: int = 512
    most: int = 16384
    mask_bits: int = 11  # a cut every 2 KB on average
    digest_bytes: int = 16
    run_bytes: int = 1 << 22  # of texts whose chunks are held at once


def cuts(data: bytes, spec: ChunkSpec) -> list[int]:
    """End offsets of the chunks of ``data``.

    The rolling hash is the sum of gear[byte] << age over 32 bytes, summed by doubling the width five times.
    """
    n = len(data)
    if n <= spec.least:
        return [n] if n else []
    rolling = GEAR[np.frombuffer(data, np.uint8)]
    for power in range(5):
        age = 1 << power
        older = rolling[:-age] << np.uint32(age)
        rolling = rolling.copy()
        rolling[age:] += older
    hits = np.flatnonzero(rolling >> np.uint32(32 - spec.mask_bits) == 0) + 1
    ends, start = [], 0
    for hit in hits.tolist():
        while hit - start > spec.most:
            start += spec.most
            ends.append(start)
        if hit - start >= spec.least:
            ends.append(hit)
            start = hit
    while n - start > spec.most:
        start += spec.most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def pieces(data: bytes, spec: ChunkSpec) -> list[bytes]:
    ends = cuts(data, spec)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def name_of(chunk: bytes, seed: int, size: int) -> bytes:
    raw = xxhash.xxh3_128_digest(chunk, seed=seed)
    if size > 16:
        raw += hashlib.sha256(chunk).digest()
    return raw[:size]


def runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``size`` bytes of text each, and one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def _normal(text: str | None) -> bytes:
    return b"" if text is None else text.encode().lower()


def recipes(docs: DataFrame, spec: ChunkSpec, seed: int, size: int) -> DataFrame:
    """recipe (chunk names in order) and text_sha256 of each row, next to its columns other than the text."""
    kept = [c for c in docs.columns if c != "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, spec.run_bytes):
            names, digests = [], []
            for text in batch.column("text"):
                data = _normal(text.as_py())
                names.append([name_of(c, seed, size) for c in pieces(data, spec)])
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names, pa.list_(pa.binary())), pa.array(digests, pa.string())],
                [*kept, "recipe", "text_sha256"],
            )

    chosen = docs.select(*kept, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return chosen.mapInArrow(read, f"{kinds}, recipe array<binary>, text_sha256 string")


def name_clashes(docs: DataFrame, made: DataFrame, spec: ChunkSpec, seed: int, size: int) -> int:
    """How many chunk names stand for two or more different contents.

    Only chunks whose name occurs twice can clash, so a filter of those names (its size follows their number up to a bound; a
    false positive only moves a chunk needlessly) is broadcast and decides what is moved.
    """
    def halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _name_hashes(batch.column("name").to_pylist())[1:]

    shared = made.select(F.explode("recipe").alias("name")).groupBy("name").count().filter("count > 1")
    shared = settle(shared.select("name", F.xxhash64("name").alias("key")), "repeated-names")
    n_shared = shared.count()
    if not n_shared:
        return 0
    filter_bits = size_for(n_shared)
    listed = build(shared, halves, filter_bits, 4, n_shared)
    bits = docs.sparkSession.sparkContext.broadcast(listed.bits)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bloom(bits.value, filter_bits, 4)
        for batch in runs(batches, spec.run_bytes):
            # The same chunk of a run is sent once; a set tells apart contents that share a name.
            pairs = {(name_of(c, seed, size), c) for text in batch.column("text") for c in pieces(_normal(text.as_py()), spec)}
            if not pairs:
                continue
            names, chunks = zip(*pairs)
            keep = pa.array(held.contains(*_name_hashes(list(names))))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(chunks, pa.binary())], ["name", "content"]).filter(keep)

    texts = docs.select(F.col("text").cast("string").alias("text"))
    pairs = texts.mapInArrow(contents, "name binary, content binary").groupBy("name", "content").agg(F.lit(1).alias("one"))
    return pairs.groupBy("name").count().filter("count > 1").count()


def _name_hashes(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and two hashes of each name; the key is Spark's xxhash64."""
    key = np.array([xxhash.xxh64_intdigest(n, 42) for n in names], np.uint64)
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(n) for n in names), "<u8").reshape(-1, 2)
    return key, raw[:, 0].copy(), raw[:, 1].copy()


def verified_recipes(docs: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """Recipes whose names are proven to stand for one content each."""
    seed, size = 0, spec.digest_bytes
    while True:
        made = settle(recipes(docs, spec, seed, size), "recipes")
        if not name_clashes(docs, made, spec, seed, size):
            return made
        seed, size = seed + 1, min(2 * size, 48)


def exact_groups(docs: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs`` (doc_id, text)."""
    made = verified_recipes(docs.select("doc_id", "text"), spec)
    groups = made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Only recipes that occur again are joined back, from a written table: both sides of the join are then plain shuffles, of
    # which Spark splits the partitions that a large group makes.
    again = settle(groups.filter("group_size > 1"), "repeated-recipes")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return made.join(again, "recipe", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """The rows of ``docs`` without exact copies: of equal texts one row with the largest id stays (one without an id if none has one).

    Rows are told apart by id and text together, so a row goes only with its own text, and of repeated rows one stays.
    """
    made = verified_recipes(docs.select("doc_id", "text", row_key().alias("row_key")), spec)
    tops = made.groupBy("recipe").agg(F.count("*").alias("rows"), F.max(F.struct("doc_id", "row_key")).alias("top"))
    tops = settle(tops.filter("rows > 1").select("recipe", F.col("top.row_key").alias("top_key")), "repeated-recipes")
    copies = made.join(tops, "recipe").groupBy("row_key").agg(F.max(F.col("row_key") == F.col("top_key")).alias("stays"))
    return one_row_of_copies(docs, settle(copies, "exact-copies"))
