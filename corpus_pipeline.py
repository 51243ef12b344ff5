"""The corpus pipeline: stages over documents, each written and read again before the next.

Quality rules drop what the current policy rejects; exact dedup keeps the row with the largest id of equal texts; near-dedup keeps
the row with the least id of each group of texts whose SimHash fingerprints (three-word shingles) are linked by two differing bits or fewer; mixing keeps each document as often as its source's target asks
for, so a document may come twice or thrice and some go; the last stage encodes and decodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm.chunks import drop_exact_copies
from fleetlens.llm.common import read_table, settle
from fleetlens.llm.mixing import mixed_documents
from fleetlens.llm.queries import bpe_digests
from fleetlens.llm.rules import filter_documents
from fleetlens.llm.simhash import drop_near_copies
from fleetlens.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return filter_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_codec", bpe_codec),
]

# No SQL twin: fingerprints, subset sums and merges of a vocabulary can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
