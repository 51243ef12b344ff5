"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints of equal value are one node. Two nodes link if they differ in ``radius`` bits or fewer. Then at least one of
``radius + 1`` blocks of the 64 bits is equal in both, so each distinct fingerprint is sent to one shard per block, keyed by the
block's place and value, and only fingerprints of one shard are compared.

Within a shard the fingerprints form BK-trees (children keyed by their integer distance to the parent; a search for q goes
only along the edges within ``radius`` of q's distance to the node). A shard of up to ``tree_rows`` fingerprints is one tree. A
larger one, as a third of all rows being variations of one text would make it, is cut into several trees; every tree is then
given to every fingerprint of its shard, block by block, so no task holds more than two blocks.

A tree goes to its queries through the shuffle and not as a broadcast: all trees together grow with the corpus, so they have no
size bound that would allow a broadcast.

Links themselves are never written: a task keeps a union-find over what its searches meet and emits one edge per fingerprint
that hangs on another. Components of those edges are found on tables (components.py).

Defined results: a null or empty text has fingerprint zero and is linked like any other. A component's id is the least doc_id in
it, rows without an id left aside (null if there is no other). Repeated rows give repeated results, other columns are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bloom import one_row_of_copies, row_key
from .common import settle, words_of
from .components import component_roots

SEED = 42


@dataclass(frozen=True)
class SimHashSpec:
    words: int = 3
    radius: int = 2
    tree_rows: int = 2048


def fingerprint(words: list[bytes], width: int) -> int:
    """Bits set in over half of the hashes of all ``width``-word shingles, repeats included."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-width] + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        some = hashes[part : part + (1 << 16)]
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, spec: SimHashSpec) -> DataFrame:
    """The columns of ``docs`` other than the text, and fp, the fingerprint as a signed number."""
    kept = [c for c in docs.columns if c != "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(words_of(t.as_py()), spec.words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values.view(np.int64), pa.int64())], [*kept, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(read, f"{kinds}, fp long")


class BKTree:
    """A BK-tree in arrays, searched for many fingerprints at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{}]
        # Fingerprints walk down together: at a node each goes on to the child of its own distance, the first one becomes it.
        waiting = [(0, np.arange(1, len(values)))]
        self.children += [{} for _ in range(len(values) - 1)]
        while waiting:
            node, below = waiting.pop()
            if not len(below):
                continue
            distance = np.bitwise_count(values[below] ^ values[node])
            for d in np.unique(distance).tolist():
                group = below[distance == d]
                self.children[node][d] = int(group[0])
                waiting.append((int(group[0]), group[1:]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(tree position, positions of the queries within the radius) of every node that some query reaches."""
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, asking = waiting.pop()
            distance = np.bitwise_count(queries[asking] ^ self.values[node]).astype(np.int16)
            near = asking[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = asking[np.abs(distance - edge) <= radius]
                if len(follow):
                    waiting.append((child, follow))


class Forest:
    """Union-find over positions."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _block_columns(radius: int) -> list[F.Column]:
    """One (place, value) for each of radius + 1 blocks of the fingerprint."""
    count = radius + 1
    bounds = [64 * i // count for i in range(count + 1)]
    return [
        F.struct(
            F.lit(i).alias("place"),
            F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")).alias("value"),
        )
        for i, (low, high) in enumerate(zip(bounds, bounds[1:]))
    ]


def shard_links(nodes: DataFrame, spec: SimHashSpec) -> DataFrame:
    """Edges (a, b) that connect all fingerprints linked directly or through others; ``nodes`` holds distinct fp."""
    placed = nodes.select("fp", F.explode(F.array(*_block_columns(spec.radius))).alias("block")).select("fp", "block.*")
    sizes = placed.groupBy("place", "value").agg(F.count("*").alias("rows")).filter("rows > 1")
    trees = F.ceil(F.col("rows") / spec.tree_rows).cast("int")
    known = placed.join(sizes, ["place", "value"]).withColumn("trees", trees)
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    # Block (i, j), i <= j, compares the fingerprints of parts i and j; a part of its own is met in (i, i).
    others = F.transform(
        F.sequence(F.lit(0), F.col("trees") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))
    )
    spread = known.select("fp", "place", "value", own.alias("part"), F.explode(others).alias("pair")).select(
        "fp", "part", "place", "value", "pair.*"
    )
    radius = spec.radius
    # Small shards are put together, some thousand rows to a task call; large ones keep a key of their own.
    single = (F.col("i") == 0) & (F.col("j") == 0)
    groups = max(1, nodes.sparkSession.sparkContext.defaultParallelism * 4)
    total = nodes.count()
    groups = max(groups, total * (radius + 1) // 8192)
    bundle = F.when(single, F.pmod(F.xxhash64("place", "value"), F.lit(groups))).otherwise(F.xxhash64("place", "value", "i", "j"))

    def link(key, group):
        data = group.select(["place", "value", "i", "j", "part", "fp"])
        columns = [data.column(c).to_numpy() for c in data.column_names]
        order = np.lexsort(columns[4::-1])
        place, value, i, j, part, fp = (c[order] for c in columns)
        fresh = np.r_[True, (np.diff(place) != 0) | (np.diff(value) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]
        bounds = np.r_[np.flatnonzero(fresh), len(fp)]
        a, b = [], []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            values = fp[start:end].view(np.uint64)
            if len(values) < 2:
                continue
            if len(values) == 2:
                if int(values[0] ^ values[1]).bit_count() <= radius:
                    a.append(fp[start]), b.append(fp[start + 1])
                continue
            # In a block of two parts the first is the tree and the second asks.
            split = int(np.searchsorted(part[start:end], i[start], "right")) if i[start] != j[start] else len(values)
            asking = np.arange(len(values)) if split == len(values) else np.arange(split, len(values))
            if not len(asking) or not split:
                continue
            forest = Forest(len(values))
            for node, near in BKTree(values[:split]).search(values[asking], radius):
                for at in asking[near].tolist():
                    forest.join(node, at)
            for at in range(len(values)):
                root = forest.root(at)
                if root != at:
                    a.append(fp[start + root]), b.append(fp[start + at])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.withColumn("bundle", bundle).groupBy("bundle").applyInArrow(link, "a long, b long")


def near_roots(nodes: DataFrame, spec: SimHashSpec) -> DataFrame:
    """``nodes`` (fp, and more) with root, the same for all fingerprints of a component."""
    roots = component_roots(shard_links(nodes.select("fp"), spec))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_groups(docs: DataFrame, spec: SimHashSpec = SimHashSpec()) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of each row of ``docs`` (doc_id, text)."""
    marked = settle(fingerprints(docs.select("doc_id", "text"), spec), "fingerprints")
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    placed = near_roots(nodes, spec)
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = placed.join(least, "root").select("fp", "component_id")
    return marked.join(of_node, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, spec: SimHashSpec = SimHashSpec()) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row with the least id stays (one without an id if none has one).

    Rows are told apart by id and text together, so a row goes only with its own text, and of repeated rows one stays.
    """
    marked = settle(fingerprints(docs.select("doc_id", "text", row_key().alias("row_key")), spec), "fingerprints")
    # Least by id, rows without an id last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    nodes = settle(marked.groupBy("fp").agg(first.alias("first"), F.count("*").alias("rows")), "distinct-fingerprints")
    placed = settle(near_roots(nodes, spec), "near-components")
    groups = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).filter("rows > 1")
    groups = groups.select("root", F.col("first.row_key").alias("first_key"))
    of_node = settle(placed.select("fp", "root").join(groups, "root").select("fp", "first_key"), "near-kept")
    copies = marked.join(of_node, "fp").groupBy("row_key").agg(F.max(F.col("row_key") == F.col("first_key")).alias("stays"))
    return one_row_of_copies(docs, settle(copies, "near-copies"))
