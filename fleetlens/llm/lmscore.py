"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale: a gram of quantised count q is put into the filter q
times, as (gram, 1) .. (gram, q). Asking for (gram, 1), (gram, 2), ... until the filter says no gives q back, and with it the
count. A pair is asked for ``guards`` times before its first level counts; their number follows from the number of words, so that a
context meets less than ``false_pairs`` invented pairs over the whole vocabulary.

Model of a text: the product over its words and one closing end token of

    P(w | h) = (q(h w) - discount) / q(h) + back(h) P(w)       P(w) = (q(w) + 0.5) / total

with the least count of a pair's level, the greatest of a context's and the middle for P(w). back(h) is what the pairs of h leave
over, in 64ths. It is summed from the answers that the finished filter gives (right or not) and kept in a second filter as two
unary digits, so that P(. | h) sums to one within a 64th or so over the vocabulary and one unseen word. The first word has no history.

The filters grow with the corpus up to ``filter_bits``. Beyond that the pairs of the least counts stay out of the filter, and then
the words of the least counts. What the filter does not know is looked up by joins with the counts: same levels, same score. The
levels of a document's words come before it is scored, those of its pairs after.

``base_score`` does not use the filter: it takes exact counts. Those of the most frequent levels, ``hot_tokens`` rows at most, are broadcast; all other tokens of a document are joined with the table of counts.

Defined results: a null or empty text is the end token alone. Rows without an id belong to the training fold. Rows that repeat
an id and a text give as many equal result rows. With no training rows all counts are 0 and ``base_score`` is 0. Very long texts
are a slice of their own; their cost is linear. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .bloom import Bloom, batchwise, build
from .common import fold, mix, settle

END = b"\n"  # no word holds a line break
TOKENS, PAIRS, COARSE, FINE = 1, 2, 3, 4
REMEMBERED = 1 << 19  # tokens whose answers a task keeps
ASKED = 1 << 13  # grams for which a filter is asked in one go
GRAM = "kind byte, h1 long, h2 long, n long"


@dataclass(frozen=True)
class ModelSpec:
    folds: int = 5
    held_fold: int = 1
    base: float = 2.0**0.5  # of the logarithmic scale
    min_pair: int = 2  # pairs seen less often are no evidence
    discount: float = 0.9
    filter_bits: int = 1 << 30
    bits_per_event: float = 10.0
    probes: int = 6
    false_pairs: float = 1 / 64  # of a context, over all words
    share_bits: float = 20.0  # per event of the second filter
    share_probes: int = 14
    hot_tokens: int = 1 << 18
    slice_bytes: int = 6 << 20
    cell_bytes: int = 4 << 20  # of text for each range of hashes in which grams are added up

    @property
    def skipped(self) -> int:
        """Levels below that of ``min_pair``, which no pair has."""
        return int(level_of(np.array([self.min_pair]), self.base)[0]) - 1

    def guards(self, words: int) -> int:
        """How often a pair is asked for before it counts."""
        wrong = (1 - math.exp(-self.probes / self.bits_per_event)) ** self.probes
        return max(1, math.ceil(math.log((words + 1) / self.false_pairs) / -math.log(wrong)))



def level_of(count: np.ndarray, base: float) -> np.ndarray:
    """Quantised count: 1 + floor(log_base(count))."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(base) + 1e-9).astype(np.int64)


def least_count(level: np.ndarray, base: float) -> np.ndarray:
    return np.where(level > 0, np.ceil(base ** (level - 1.0) - 1e-9), 0.0)


def greatest_count(level: np.ndarray, base: float) -> np.ndarray:
    return np.where(level > 0, np.maximum(np.ceil(base**level - 1e-9) - 1, least_count(level, base)), 0.0)


def expected(level: np.ndarray, base: float) -> np.ndarray:
    """Middle of the counts that share a level; level 0 is no count."""
    return (least_count(level, base) + greatest_count(level, base)) / 2


def pair_value(level: np.ndarray, spec: ModelSpec) -> np.ndarray:
    """Discounted count of a pair."""
    return np.where(level > 0, np.maximum(least_count(level + spec.skipped, spec.base) - spec.discount, 0), 0.0)


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    """Two 64-bit halves of the 128-bit hash of each token."""
    raw = b"".join([xxhash.xxh3_128_digest(t) for t in tokens])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) + np.uint64(0x9E3779B97F4A7C15) * word)


def context_key(context: np.ndarray) -> np.ndarray:
    """40 bits of a context, which travel with each pair so that the mass of a context can be summed."""
    return context >> np.uint64(24)


@dataclass
class Slice:
    """Some documents as token numbers, one after the other."""

    docs: pa.RecordBatch
    ids: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray  # of each token number


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Slice]:
    """Documents in runs of about ``limit`` bytes of ``text``."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(sizes):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield _slice(batch.slice(start, stop - start))
            start = stop


def _slice(docs: pa.RecordBatch) -> Slice:
    """ASCII white space is what cuts words, and only A to Z have an ASCII lower case.

    Lower case comes before the cast: a cast slice starts at an offset that is not 0, of which ``ascii_lower`` loses the text.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(docs.column("text").fill_null("")).cast(pa.large_string()))
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    ids, voc = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
    word = (pc.binary_length(voc).to_numpy() > 0)[ids]  # the split leaves empty ends
    ends = np.r_[0, np.cumsum(word)][offsets - offsets[0]]
    ids = np.insert(ids[word], ends[1:], len(voc))
    return Slice(docs, ids, ends[:-1] + np.arange(docs.num_rows), token_hashes([*voc.to_numpy(zero_copy_only=False), END]))


def _pairs(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of second tokens (all but the first of each document) and the pair numbers there."""
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    return at, ids[at - 1] * np.int64(size) + ids[at]


def gram_counts(docs: DataFrame, spec: ModelSpec) -> DataFrame:
    """Counts of every token, and of every pair seen ``min_pair`` times or more, in the training fold.

    A task counts its slices and sorts each by hash. The hashes are cut into ranges, cells, whose number follows the size of the texts; a
    slice's grams of a cell travel as one row of arrays, and the rows of a cell are added up together.
    """
    training = docs.filter(fold("doc_id", spec.folds) != spec.held_fold).select(F.col("text").cast("string").alias("text"))
    size = training.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cells, least = size // spec.cell_bytes + 1, {TOKENS: 1, PAIRS: spec.min_pair}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _slices(batches, spec.slice_bytes):
            ids, starts, hashes = held.ids, held.starts, held.hashes
            n = np.bincount(ids, minlength=len(hashes))
            seen = np.flatnonzero(n)
            yield _celled(TOKENS, hashes[seen, 0], hashes[seen, 1], n[seen], cells)
            _, keys = _pairs(ids, starts, len(hashes))
            keys, n = np.unique(keys, return_counts=True)
            for cut in range(0, len(keys), 1 << 22):
                part = slice(cut, cut + (1 << 22))
                context, word = hashes[keys[part] // len(hashes), 0], hashes[keys[part] % len(hashes), 0]
                yield _celled(PAIRS, pair_key(context, word), context_key(context), n[part], cells)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = key[0].as_py()
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("h1", "h2", "n")), strict=True):
                held.append(tuple(np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.uint64, np.uint64, np.int64), strict=True)))
            if sum(len(h1) for h1, _, _ in held[1:]) > max(1 << 21, len(held[0][0])):
                held = [_added(held)]
        h1, h2, n = _added(held)
        kept = n >= least[kind]
        yield _rows(kind, h1[kept], h2[kept], n[kept])

    counted = training.mapInArrow(count, "kind byte, cell long, h1 binary, h2 binary, n binary")
    return counted.groupBy("kind", "cell").applyInArrow(batchwise(add), GRAM)


def _celled(kind: int, h1: np.ndarray, h2: np.ndarray, n: np.ndarray, cells: int) -> pa.RecordBatch:
    """A row for each cell that the grams meet, with the arrays of its grams."""
    order = np.argsort(h1)
    h1, h2, n = h1[order], h2[order], n[order].astype(np.int64)
    cell = ((h1 >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[len(cell) > 0, cell[1:] != cell[:-1]])
    offsets = pa.py_buffer((8 * np.r_[first, len(cell)]).astype(np.int32))
    arrays = [pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(v)]) for v in (h1, h2, n)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(first), kind, np.int8)), pa.array(cell[first].astype(np.int64)), *arrays], ["kind", "cell", "h1", "h2", "n"]
    )


def _added(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams of some runs, each with the sum of its counts."""
    h1, h2, n = (np.concatenate(c) for c in zip(*runs, strict=True))
    order = np.argsort(h1)
    same = h1[order[1:]] == h1[order[:-1]]
    if (same & (h2[order[1:]] != h2[order[:-1]])).any():  # grams that share a half only
        order = np.lexsort((h2, h1))
    h1, h2, n = h1[order], h2[order], n[order]
    first = np.flatnonzero(np.r_[len(h1) > 0, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    return h1[first], h2[first], np.add.reduceat(n, first) if len(first) else n


def _rows(kind: int, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(h1), kind, np.int8)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n.astype(np.int64))],
        ["kind", "h1", "h2", "n"],
    )


@dataclass
class Model:
    filter: Bloom
    shares: Bloom | None
    spec: ModelSpec
    train_tokens: int
    distinct_tokens: int
    total: float  # denominator of P(w)
    least_token: int = 1  # least levels of what the filter holds; lesser answers are wrong ones
    least_pair: int = 1
    least_hot: int = 1  # least level of the tokens whose exact counts are broadcast

    def _steps(self, held: Bloom, kind: int, first: np.ndarray, second: np.ndarray, most: int | None = None) -> np.ndarray:
        """Probe (gram, 1), (gram, 2), ... for all grams at once until each is missed.

        Grams of one segment of the filter stand together and are asked some thousand at a time, so that both stay in the cache.
        """
        steps = np.zeros(len(first), np.int64)
        start = held.starts(first)
        alive = np.argsort(start)
        first, second, start = first[alive], second[alive], start[alive]
        step = 0
        while len(alive) and (most is None or step < most):
            step += 1
            found = np.empty(len(alive), bool)
            for cut in range(0, len(alive), ASKED):
                part = slice(cut, cut + ASKED)
                found[part] = held.contains_at(start[part], *event(kind, first[part], second[part], np.array([step])))
            alive, first, second, start = alive[found], first[found], second[found], start[found]
            steps[alive] = step
        return steps

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Levels of tokens, 0 of those that the filter does not hold."""
        level = self._steps(self.filter, TOKENS, hashes[:, 0].copy(), hashes[:, 1].copy())
        return np.where(level >= self.least_token, level, 0)

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        level = self._steps(self.filter, PAIRS, keys, np.zeros(len(keys), np.uint64)) - self.spec.guards(self.distinct_tokens) + 1
        return np.where(level >= self.least_pair, level, 0)

    def shares_of(self, first: np.ndarray, level: np.ndarray) -> np.ndarray:
        """What the pairs of each token take; nothing where the token was not counted."""
        share, known = np.zeros(len(first)), np.flatnonzero(level > 0)
        share[known] = self.direct_mass(context_key(first[known]))
        return share

    def direct_mass(self, contexts: np.ndarray) -> np.ndarray:
        """What the pairs of each context (its key) take of its probability."""
        zero = np.zeros(len(contexts), np.uint64)
        coarse, fine = (self._steps(self.shares, kind, contexts, zero, 7) for kind in (COARSE, FINE))
        return (8 * coarse + fine) / 64


def event(kind: int, first: np.ndarray, second: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes under which step ``step`` of a gram is in the filter."""
    scrambled = np.uint64(0xD6E8FEB86659FD93) * (step.astype(np.uint64) * np.uint64(4) + np.uint64(kind & 3))
    return mix(first + scrambled), mix(second ^ first) + scrambled


def _filled(rows: DataFrame, events: int, number: int, bits: float, probes: int) -> Bloom:
    """The filter of all events of ``rows`` (kind, h1, h2, steps)."""

    def hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        kind, h1, h2, steps = (batch.column(c).to_numpy() for c in ("kind", "h1", "h2", "steps"))
        which = np.repeat(np.arange(len(steps)), steps)
        step = np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps, steps) + 1
        first, second, kind = h1.view(np.uint64)[which], h2.view(np.uint64)[which], kind[which]
        second = np.where(kind == TOKENS, second, np.uint64(0))  # the context is no part of a pair's key
        one, two = np.empty(len(which), np.uint64), np.empty(len(which), np.uint64)
        for k in (TOKENS, PAIRS, COARSE, FINE):
            at = kind == k
            one[at], two[at] = event(k, first[at], second[at], step[at])
        return one, two

    size = max(1024, 8 * int(events * bits / 8 + 1))
    return build(rows.withColumn("key", F.col("h1")), hashes, size, probes, number)


def _level(count: Column, base: float) -> Column:
    return (1 + F.floor(F.log(count.cast("double")) / math.log(base) + F.lit(1e-9))).cast("long")


def fit(counts: DataFrame, spec: ModelSpec) -> Model:
    """Choose what the filter holds, build it, and sum up what the model needs to know of the whole table."""
    pair = F.col("kind") == PAIRS
    levelled = counts.withColumn("level", _level(F.col("n"), spec.base) - F.when(pair, spec.skipped).otherwise(0))
    histogram = levelled.groupBy("kind", "level").agg(F.count("*").alias("grams"), F.sum("n").alias("n")).collect()
    tokens, pairs = ([r for r in histogram if r.kind == k] for k in (TOKENS, PAIRS))
    total, distinct = sum(r.n for r in tokens), sum(r.grams for r in tokens)
    guards, room = spec.guards(distinct), int(spec.filter_bits / spec.bits_per_event)

    def choose(rows: list, extra: int, used: int) -> tuple[int, int]:
        """Least level of the grams for which there is room, and the events then used."""
        least = max((r.level for r in rows), default=0) + 1
        for r in sorted(rows, key=lambda r: -r.level):
            if used + r.grams * (r.level + extra) > room:
                return least, used
            used, least = used + r.grams * (r.level + extra), r.level
        return 1, used

    hot, least_hot = 0, max((r.level for r in tokens), default=0) + 1
    for r in sorted(tokens, key=lambda r: -r.level):
        hot += r.grams
        if hot > spec.hot_tokens:
            break
        least_hot = r.level
    least_token, used = choose(tokens, 0, 0)
    least_pair, used = choose(pairs, guards - 1, used)
    mass = sum(r.grams * float(expected(np.array([r.level]), spec.base)[0]) for r in tokens)
    denominator = max(mass + 0.5 * (distinct + 1), 0.5)

    held = levelled.filter(F.col("level") >= F.when(pair, least_pair).otherwise(least_token))
    held = held.select("kind", "h1", "h2", (F.col("level") + F.when(pair, guards - 1).otherwise(0)).alias("steps"))
    number = sum(r.grams for r in tokens if r.level >= least_token) + sum(r.grams for r in pairs if r.level >= least_pair)
    grams = _filled(held, used, number, spec.bits_per_event, spec.probes)
    model = Model(grams, None, spec, total, distinct, denominator, least_token, least_pair, least_hot)
    model.shares = _shares(levelled, model)
    return model


def _shares(levelled: DataFrame, model: Model) -> Bloom:
    """The filter of what the pairs of each context take, by the answers that the filter of grams gives and the levels of what it lacks."""
    spec, least_token, least_pair = model.spec, model.least_token, model.least_pair
    shared = levelled.sparkSession.sparkContext.broadcast((model.filter.bits, model.filter.size))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shared.value
        asked = Model(Bloom(bits, size, spec.probes), None, spec, 0, model_words, 1.0, least_token, least_pair)
        for batch in batches:
            kind, h1, h2, level = (batch.column(c).to_numpy() for c in ("kind", "h1", "h2", "level"))
            token = kind == TOKENS
            first, second = h1.view(np.uint64), h2.view(np.uint64)
            own = np.empty(len(kind), np.int64)
            own[~token], own[token] = asked.pairs(first[~token]), asked.tokens(np.stack([first[token], second[token]], 1))
            own = np.where(own > 0, own, level)
            value = np.empty(len(kind))
            value[~token], value[token] = pair_value(own[~token], spec), greatest_count(own[token], spec.base)
            context = np.where(token, context_key(first), second).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(context), pa.array(value)], ["token", "h1", "value"])

    model_words = model.distinct_tokens
    read = levelled.select("kind", "h1", "h2", "level").mapInArrow(answers, "token boolean, h1 long, value double")
    taken = read.groupBy("h1").agg(
        F.sum(F.when(~F.col("token"), F.col("value"))).alias("mass"), F.min(F.when(F.col("token") & (F.col("value") > 0), F.col("value"))).alias("n")
    ).filter("mass is not null and n is not null")
    parts = F.least(F.lit(63), F.round(64 * F.col("mass") / F.col("n"))).cast("long")
    digits = F.array(
        F.struct(F.lit(COARSE).cast("byte").alias("kind"), F.shiftright("parts", 3).alias("steps")),
        F.struct(F.lit(FINE).cast("byte").alias("kind"), F.col("parts").bitwiseAND(F.lit(7)).alias("steps")),
    )
    rows = settle(
        taken.select("h1", parts.alias("parts")).filter("parts > 0").select("h1", F.explode(digits).alias("digit"))
        .select("digit.kind", "h1", F.lit(0).cast("long").alias("h2"), "digit.steps").filter("steps > 0"),
        "context-shares",
    )
    sizes = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("steps"), F.lit(0)).alias("events")).first()
    shared.destroy()  # the written table needs it no more
    return _filled(rows, sizes.events, sizes.rows, spec.share_bits, spec.share_probes)


@dataclass
class Seen:
    """Tokens of a task's earlier slices, by their hashes, with the filters' answers; many come again."""

    h1: np.ndarray
    h2: np.ndarray
    level: np.ndarray
    share: np.ndarray

    @staticmethod
    def none() -> Seen:
        return Seen(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0))

    def values(self, model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level of each token, and what the pairs of that context take; only tokens not seen are asked for, and remembered."""
        own = hashes.view(np.int64)
        place = _find(self.h1, self.h2, np.arange(1, len(self.h1) + 1), own)
        old, new = np.flatnonzero(place > 0), np.flatnonzero(place == 0)
        level, share = np.zeros(len(own), np.int64), np.zeros(len(own))
        level[old], share[old] = self.level[place[old] - 1], self.share[place[old] - 1]
        level[new] = model.tokens(hashes[new])
        share[new] = model.shares_of(hashes[new, 0], level[new])
        added = (own[new, 0], own[new, 1], level[new], share[new])
        if len(self.h1) + len(new) > REMEMBERED:
            held = (own[:, 0], own[:, 1], level, share)
        else:
            held = tuple(np.concatenate(c) for c in zip((self.h1, self.h2, self.level, self.share), added, strict=True))
        order = np.argsort(held[0])
        self.h1, self.h2, self.level, self.share = (c[order] for c in held)
        return level, share


@dataclass
class Unknown:
    """Pairs of a slice that the filter does not hold: where they stand, and what their probability needs beside their count."""

    at: np.ndarray
    context: np.ndarray  # token numbers
    word: np.ndarray
    scale: np.ndarray  # 1 / q(h)
    most: np.ndarray  # of the direct part
    back: np.ndarray  # back(h) P(w)


def slice_scores(
    model: Model, ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, level: np.ndarray | None = None, share: np.ndarray | None = None
) -> tuple[np.ndarray, Unknown | None]:
    """log10 P of each document of a slice, and the pairs to look up elsewhere if the filter does not hold all.

    ``level`` and ``share`` are of the tokens, where they are known already.
    """
    spec, size = model.spec, len(hashes)
    level = model.tokens(hashes) if level is None else level
    p = (expected(level, spec.base) + 0.5) / model.total
    count = greatest_count(level, spec.base)
    first = hashes[:, 0].copy()
    share = model.shares_of(first, level) if share is None else share
    at, keys = _pairs(ids, starts, size)
    logs = np.log10(p)[ids]
    unknown = None
    if len(at):
        pairs, where = np.unique(keys, return_inverse=True)
        del keys
        h, w = pairs // size, pairs % size
        # A pair can only be known if its context has pairs and its word was counted.
        maybe = np.flatnonzero((share[h] > 0) & (level[w] > 0))
        q = np.zeros(len(pairs))
        for cut in range(0, len(maybe), 1 << 18):
            some = maybe[cut : cut + (1 << 18)]
            q[some] = pair_value(model.pairs(pair_key(first[h[some]], first[w[some]])), spec)
        scale = 1 / np.maximum(count[h], 1)
        back = (1 - share[h]) * p[w]
        logs[at] = np.log10(np.minimum(q * scale, share[h]) + back)[where]
        if model.least_pair > 1:
            missed = np.zeros(len(pairs), bool)
            missed[maybe] = q[maybe] == 0
            there = np.flatnonzero(missed[where])
            one = where[there]
            unknown = Unknown(at[there], h[one], w[one], scale[one], share[h[one]], back[one])
    return np.add.reduceat(logs, starts), unknown


def with_rare_words(docs: DataFrame, tokens: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with ``rare``, the levels of those of its words that were counted but are not in the filter."""
    spec, least_token = model.spec, model.least_token
    shared = docs.sparkSession.sparkContext.broadcast((model.filter.bits, model.filter.size))

    def unheld(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shared.value
        asked = Model(Bloom(bits, size, spec.probes), None, spec, 0, 0, 1.0, least_token)
        for held in _slices(batches, spec.slice_bytes):
            ids, hashes = held.ids, held.hashes
            doc = np.repeat(np.arange(len(held.starts)), np.diff(np.r_[held.starts, len(ids)]))
            open_ = (asked.tokens(hashes) == 0)[ids]
            words = np.unique(doc[open_] * len(hashes) + ids[open_], return_counts=True)[0]  # sorts, which is faster here
            at, token = pa.array(words // len(hashes)), words % len(hashes)
            yield pa.RecordBatch.from_arrays(
                [held.docs.column("doc_id").take(at), held.docs.column("text_key").take(at),
                 *(pa.array(hashes[token, k].view(np.int64)) for k in (0, 1))],
                ["rare_id", "rare_key", "h1", "h2"],
            )

    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    level = _level(F.col("c"), spec.base)
    rare = tokens.filter(level < least_token).select("h1", "h2", level.alias("level"))
    words = keyed.mapInArrow(unheld, "rare_id long, rare_key long, h1 long, h2 long").join(rare, ["h1", "h2"])
    lists = words.groupBy("rare_id", "rare_key").agg(F.collect_set(F.struct("h1", "h2", "level")).alias("rare"))
    same = F.col("doc_id").eqNullSafe(F.col("rare_id")) & (F.col("text_key") == F.col("rare_key"))
    return keyed.join(lists, same, "left").select("doc_id", "text", "rare")


def _listed(rare: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and levels of the rare words of some documents, in the order of the hashes."""
    h1, h2, level = (c.to_numpy() for c in rare.flatten().flatten())
    order = np.lexsort((h2, h1))
    return h1[order], h2[order], level[order]


def score(docs: DataFrame, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """Train on one part of ``docs`` (doc_id, text) and score all of it; see the module text for the columns."""
    spark = docs.sparkSession
    counts = settle(gram_counts(docs, spec), "gram-counts")
    model = fit(counts, spec)
    tokens = counts.filter(F.col("kind") == TOKENS).select("kind", "h1", "h2", F.col("n").alias("c"))
    hot = tokens.filter(_level(F.col("c"), spec.base) >= model.least_hot).select("h1", "h2", "c").toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
    # Plain arrays and numbers only: the filters, at most filter_bits and share_bits for each context in it, and hot_tokens rows of 24 bytes.
    shared = spark.sparkContext.broadcast(
        (model.filter.bits, model.filter.size, model.shares.bits, model.shares.size, model.distinct_tokens, model.total,
         model.least_token, model.least_pair, *(hot[c].to_numpy() for c in ("h1", "h2", "c")))
    )
    scale = model.train_tokens + 0.5 * (model.distinct_tokens + 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size, share_bits, share_size, words, total, least_token, least_pair, hot1, hot2, hot_n = shared.value
        own = Model(Bloom(bits, size, spec.probes), Bloom(share_bits, share_size, spec.share_probes), spec, 0, words, total, least_token, least_pair)
        seen = Seen.none()
        for held in _slices(batches, spec.slice_bytes):
            yield from rows_of(held, own, seen, (hot1, hot2, hot_n))

    def rows_of(held: Slice, own: Model, seen: Seen, counted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The rows of one slice, whose arrays are gone before the next one is cut."""
        ids, starts, hashes = held.ids, held.starts, held.hashes
        doc_ids = held.docs.column("doc_id")
        texts = held.docs.column("text").cast(pa.large_binary()).to_pylist()
        key = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts], np.uint64).view(np.int64)
        if own.least_token > 1:
            level, share = own.tokens(hashes), None
            level = np.where(level > 0, level, _find(*_listed(held.docs.column("rare")), hashes.view(np.int64)))
        else:
            level, share = seen.values(own, hashes)
        scores, unknown = slice_scores(own, ids, starts, hashes, level, share)
        known = _find(*counted, hashes.view(np.int64))
        base = np.where(known > 0, np.log10((known + 0.5) / scale), 0.0)
        sizes = np.diff(np.r_[starts, len(ids)])
        doc = np.repeat(np.arange(len(starts)), sizes)
        yield _measured(
            doc_ids, key, kind=0, h1=key, n_tokens=sizes, n_known=np.add.reduceat(known[ids] > 0, starts, dtype=np.int64),
            base=np.add.reduceat(base[ids], starts), score=scores, rows=np.ones(len(starts), np.int64),
        )
        cold = known[ids] == 0
        pairs, n = np.unique(doc[cold] * len(hashes) + ids[cold], return_counts=True)
        at, token = pairs // len(hashes), pairs % len(hashes)
        yield _measured(doc_ids.take(pa.array(at)), key[at], kind=TOKENS, h1=hashes[token, 0], h2=hashes[token, 1], n=n)
        if unknown is not None and len(unknown.at):
            first, at = hashes[:, 0], doc[unknown.at]
            yield _measured(
                doc_ids.take(pa.array(at)), key[at], kind=PAIRS, h1=pair_key(first[unknown.context], first[unknown.word]),
                h2=context_key(first[unknown.context]), n=np.ones(len(at), np.int64), scale=unknown.scale, most=unknown.most, back=unknown.back,
            )

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model.least_token > 1:
        whole = with_rare_words(whole, tokens, model)
    parts = whole.mapInArrow(measure, ", ".join(["doc_id long", "text_key long", *(f"{c} {t}" for c, t in MEASURED.items())]))
    if model.least_pair > 1:
        level = _level(F.col("n"), spec.base)
        q = F.ceil(F.pow(F.lit(spec.base), level - 1) - 1e-9) - spec.discount
        rare = counts.filter((F.col("kind") == PAIRS) & (level - spec.skipped < model.least_pair))
        found = tokens.withColumn("q", F.lit(None).cast("double")).unionByName(rare.select("kind", "h1", "h2", F.lit(None).cast("long").alias("c"), q.alias("q")))
    else:
        found = tokens.withColumn("q", F.lit(None).cast("double"))
    c = F.coalesce(F.col("c"), F.lit(0))
    token, looked_up = F.col("kind") == TOKENS, F.least(F.col("q") * F.col("scale"), F.col("most")) / F.col("back")
    return (
        parts.join(found, ["kind", "h1", "h2"], "left")
        .groupBy("doc_id", "text_key")
        .agg(
            F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("score") + F.when(F.col("q").isNotNull(), F.log10(1 + looked_up)).otherwise(0)).alias("score"),
            F.sum(F.col("n_known") + F.when(token & (c > 0), F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.when(token, F.col("n") * F.log10((c + 0.5) / F.lit(scale))).otherwise(0)).alias("base_score"),
        )
        .select(
            "doc_id", (fold("doc_id", spec.folds) == spec.held_fold).alias("held_out"),
            (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"),
            (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"),
            F.lit(model.train_tokens).cast("long").alias("train_tokens"),
            (F.col("base_score") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
        )
        .drop("copy")
    )


MEASURED = {
    "kind": "byte", "h1": "long", "h2": "long", "n": "long", "n_tokens": "long", "n_known": "long", "base": "double", "score": "double",
    "rows": "long", "scale": "double", "most": "double", "back": "double",
}


def _measured(doc_ids: pa.Array, key: np.ndarray, kind: int, **given: np.ndarray) -> pa.RecordBatch:
    """Rows of a document: its own (kind 0; joins nothing, its text's hash spreads such rows) or one for each count to look up."""
    columns = [doc_ids, pa.array(key)]
    for name, type_ in MEASURED.items():
        if name == "kind":
            columns.append(pa.array(np.full(len(key), kind, np.int8)))
        elif name == "h2" and name not in given:
            columns.append(pa.nulls(len(key), pa.int64()))
        else:
            value = given.get(name, np.zeros(len(key)))
            columns.append(pa.array(value.view(np.int64) if value.dtype == np.uint64 else value.astype(np.int64 if type_ == "long" else np.float64)))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", *MEASURED])


def _find(hot1: np.ndarray, hot2: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Counts of tokens among the broadcast ones, 0 where absent. Equal first halves are walked through."""
    out = np.zeros(len(own), np.int64)
    at = np.searchsorted(hot1, own[:, 0])
    open_ = np.arange(len(own))
    while len(open_):
        open_ = open_[at[open_] < len(hot1)]
        open_ = open_[hot1[at[open_]] == own[open_, 0]]
        match = hot2[at[open_]] == own[open_, 1]
        out[open_[match]] = n[at[open_[match]]]
        open_ = open_[~match]
        at[open_] += 1
    return out
