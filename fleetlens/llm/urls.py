"""URL lists as cascades of Bloom filters.

A rule is a (host, path) pair; its key is ``host + path``. The candidate keys of a url are all suffixes of its host at a dot,
each with every prefix of its path that is as long as some rule's path. Whether a candidate is a listed key is asked of a
cascade: level 0 holds the listed keys; level 1 holds the unlisted keys that level 0 wrongly accepts; level 2 the listed keys
that level 1 wrongly accepts; and so on until nothing is left. The first level that says no decides, by its parity. As the
levels are built over every candidate key that the corpus has, the answer is exact for each of them, and no url is joined
with any list.

The size of a cascade follows from the list and only the logarithm of the corpus: level 0 gets a false positive rate of about
listed / unlisted, so as many unlisted keys pass as there are listed ones. The driver sees nothing but those filters.
``max_filter_bytes`` is checked before they are broadcast; a list too large for it is looked up by a join.

Defined results: a null url and one without ``://`` have empty host and path, match no rule and get the default verdict. Host and
path are taken as they stand (ports and user names are part of a host). Repeated rows give repeated results, other columns are
ignored, an empty table or list works. If two rules have one key, block wins; of several rules that fit, the longest
``host + path`` wins, and of equally long ones that with the longer host.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bloom import Bloom, build
from .common import settle

LATER_RATE = 0.5


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every page."""
    rest = F.regexp_extract(F.col("url").cast("string"), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.select(
        "page_id", F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0), F.lit("")).alias("path"),
    )


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Candidate keys, longest first, of equally long ones the longer host first."""
    labels = host.split(".") if host else []
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    found = [(len(h) + n, len(h), h + path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [k for _, _, k in sorted(found, key=lambda x: (-x[0], -x[1]))]


def key_hashes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys), "<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def salted(first: np.ndarray, level: int) -> np.ndarray:
    return first ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))


@dataclass
class Cascade:
    levels: list[Bloom]

    def contains(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe the cascade was built over."""
        answer = np.zeros(len(first), bool)
        alive = np.arange(len(first))
        for i, level in enumerate(self.levels):
            passed = level.contains(first[alive], salted(first[alive], i), second[alive])
            answer[alive[~passed]] = i % 2 == 1
            alive = alive[passed]
        answer[alive] = len(self.levels) % 2 == 1
        return answer

    @property
    def n_bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def _shape(items: int, rate: float) -> tuple[int, int]:
    """Bits and probes of a filter for so many items at so many false positives."""
    rate = min(max(rate, 1e-12), 0.5)
    size = max(64, math.ceil(items * -math.log(rate) / math.log(2) ** 2))
    return size, max(1, round(-math.log2(rate)))


def key_universe(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """Every distinct candidate key of the corpus with its hashes."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: set[str] = set()
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                keys.update(candidates(host, path, lengths))
            ordered = sorted(keys)
            first, second = key_hashes(ordered)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ordered, pa.string()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))], ["key", "h1", "h2"]
            )

    return urls.select("host", "path").mapInArrow(expand, "key string, h1 long, h2 long").distinct()


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int | None = None) -> Cascade | None:
    """``listed`` (key) and ``universe`` (key, h1, h2) of all keys that will ever be asked; a key of both is listed.

    None if the levels take more than ``max_bytes``; each level's size is known, and looked at, before it is built.
    """

    def hashes(batch: pa.RecordBatch, level: int) -> tuple[np.ndarray, np.ndarray]:
        return salted(batch.column("h1").to_numpy().view(np.uint64), level), batch.column("h2").to_numpy().view(np.uint64)

    # Marking runs through a join of the distinct keys (not of urls), once per list.
    marked = settle(universe.join(listed.withColumn("listed", F.lit(True)), "key", "left"), "url-universe")
    inside = marked.filter("listed").select("h1", "h2")
    outside = marked.filter("listed is null").select("h1", "h2")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Bloom] = []
    rate = min(0.5, math.sqrt(0.5) * n_in / n_out) if n_in and n_out else 0.5
    while n_in:
        level = len(levels)
        size, probes = _shape(n_in, rate)
        if max_bytes is not None and sum(len(x.bits) for x in levels) + size // 8 > max_bytes:
            return None
        one = build(inside.withColumn("key", F.col("h1")), lambda batch: hashes(batch, level), size, probes, n_in)
        levels.append(one)
        bits = one.bits

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Bloom(bits, size, probes)
            for batch in batches:
                yield batch.filter(pa.array(held.contains(batch.column("h1").to_numpy().view(np.uint64), *hashes(batch, level))))

        # What wrongly passes is what the next level holds; the sides change places.
        wrong = settle(outside.mapInArrow(passing, "h1 long, h2 long"), "url-false-positives")
        inside, outside = wrong, inside
        n_in, rate = wrong.count(), LATER_RATE
    return Cascade(levels)


def judge(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow", max_filter_bytes: int = 64 << 20
) -> DataFrame:
    """page_id, host, path, the rule that decides (or null) and the verdict."""
    spark = pages.sparkSession
    urls = split_url(pages)
    blocked = {r.key for r in rules if r.verdict == "block"}
    lists = {"block": blocked, "allow": {r.key for r in rules} - blocked}
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    universe = settle(key_universe(urls, lengths), "url-keys")
    cascades, left = {}, max_filter_bytes
    for verdict, keys in lists.items():
        made = build_cascade(universe, spark.createDataFrame([(k,) for k in sorted(keys)], "key string"), left)
        if made is None:
            return _judge_by_join(spark, urls, lists, lengths, default)
        cascades[verdict] = made
        left -= made.n_bytes
    shared = spark.sparkContext.broadcast({v: [(x.bits, x.size, x.probes) for x in c.levels] for v, c in cascades.items()})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {v: Cascade([Bloom(*x) for x in levels]) for v, levels in shared.value.items()}
        for batch in batches:
            per_url = [
                candidates(h, p, lengths) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            ]
            flat = [k for keys in per_url for k in keys]
            first, second = key_hashes(flat)
            verdict = np.full(len(flat), "", object)
            for name, cascade in held.items():
                verdict[cascade.contains(first, second)] = name
            rule, final, at = [], [], 0
            for keys in per_url:
                hit = next((i for i in range(at, at + len(keys)) if verdict[i]), None)
                rule.append(None if hit is None else flat[hit])
                final.append(default if hit is None else verdict[hit])
                at += len(keys)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(final, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(decide, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(spark: SparkSession, urls: DataFrame, lists: dict, lengths: list[int], default: str) -> DataFrame:
    """The way for lists beyond the broadcast bound: candidate keys join the list, the longest hit decides."""
    distinct = urls.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path"))
    keys = (
        distinct.filter("host <> ''")
        .select("page_id", "host", "path", F.explode(suffixes).alias("suffix"))
        .select("*", F.explode(sizes).alias("n"))
        .select("page_id", "host", "path", F.char_length("suffix").alias("h"), F.concat("suffix", F.expr("substr(path, 1, n)")).alias("key"))
    )
    table = spark.createDataFrame([(k, v) for v, held in lists.items() for k in sorted(held)], "key string, verdict string")
    hits = (
        keys.join(table, "key")
        .groupBy(F.col("page_id").alias("hit_page"), F.col("host").alias("hit_host"), F.col("path").alias("hit_path"))
        .agg(F.max_by(F.struct("key", "verdict"), F.struct(F.char_length("key"), "h")).alias("hit"))
    )
    same = F.col("page_id").eqNullSafe(F.col("hit_page")) & (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path"))
    return distinct.join(hits, same, "left").select(
        "page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
