"""What the operators share: tables in the shared folder, splitting text into words, and 64-bit mixing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetlens.session import shared_dir

# A word is a run of anything but space and the control characters 9 to 13, which is also what bytes.split() cuts at.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and return the written table.

    Cuts the lineage: later actions read files, and a lost executor costs only the tasks it ran.
    """
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``place``, its rows' places 0, 1, ... within their ``group`` (a column without nulls), and ``members``, the group's size.

    Rows are cut into ranges of (group, order) and sorted inside each, so a group of any size is spread over many tasks; windows run
    over one row per range and group. Rows equal in ``order`` are cut anywhere, in the order in which they were read.
    """
    inner = (1 << 33) - 1  # monotonically_increasing_id is the partition's number and, in 33 bits, the row's
    cut = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_read")
    rows = settle(cut.sortWithinPartitions(group, *order, "_read").drop("_read").withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(inner)))
    ranges = rows.groupBy(group, "_range").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    own = Window.partitionBy(group)
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        group, "_range", "_low", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias("members")
    )
    return rows.join(starts, [group, "_range"]).withColumn("place", F.expr("_at - _low + _before")).drop("_range", "_at", "_low", "_before")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def ascii_lower(column: str) -> Column:
    """Lower-case A to Z only; all other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(column), upper, upper.lower())


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A to Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return [] if text is None else text.encode().lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
