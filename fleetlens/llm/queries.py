"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import bpe, chat, chunks, filteraudit, licenses, lmscore, merkle, mixing, oracles, rules, simhash, tokencount, toxicity, urls
from fleetlens.llm.common import read_table
from fleetlens.session import configure

Query = Callable[[SparkSession, str], DataFrame]
MULTI = "byte_bpe_multi_50k.tiktoken"
SINGLE = "byte_bpe_50k.json"


def _over(table: str, apply: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: apply(read_table(configure(spark), sf_dir, table))


def bpe_digests(docs: DataFrame) -> DataFrame:
    return bpe.digest_documents(docs, public_tokenizers.path(MULTI), public_tokenizers.PATTERN)


def token_counts(docs: DataFrame) -> DataFrame:
    return tokencount.count_tokens(docs, public_tokenizers.path(SINGLE), public_tokenizers.PATTERN)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def license_labels(docs: DataFrame) -> DataFrame:
    return licenses.scan(docs).drop("matches")


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return filteraudit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def preference_digests(conversations: DataFrame) -> DataFrame:
    """Each pair with its shared turns, text sizes and digests, and how many turns of each side are learned."""

    def ones(mask: str) -> F.Column:
        return F.when(F.col(mask).isNotNull(), F.size(F.filter(mask, lambda x: x == 1)).cast("long"))

    def digest(column: str) -> F.Column:
        return F.sha2(F.col(column), 256).alias(f"{column}_sha256")

    return chat.preference_examples(conversations).select(
        "chosen_id", "rejected_id", "shared_turns", F.char_length("prompt").cast("long").alias("prompt_chars"),
        digest("prompt"), digest("chosen"), digest("rejected"),
        ones("chosen_mask").alias("chosen_learned"), ones("rejected_mask").alias("rejected_learned"),
    )


QUERIES: dict[str, Query] = {
    "op1_lm_score": _over("documents", lmscore.score),
    "op2_quality_rules": _over("documents", rules.verdicts),
    "op3_simhash_near_dedup": _over("documents", simhash.near_groups),
    "op4_url_filter": _over("pages", urls.judge),
    "op5_source_mix": _over("documents", mixing.mix),
    "op6_exact_dedup": _over("documents", chunks.exact_groups),
    "op7_bpe_codec": _over("documents", bpe_digests),
    "op8_preference_format": _over("conversations", preference_digests),
    "op9_toxicity": toxicity_scores,
    "op10_token_count": _over("documents", token_counts),
    "op11_merkle_manifest": _over("documents", merkle.manifest),
    "op12_license_scan": _over("documents", license_labels),
    "op13_filter_audit": filter_audit,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": oracles.QUALITY,
    "op4_url_filter": oracles.URLS,
    "op6_exact_dedup": oracles.EXACT,
    "op8_preference_format": oracles.PREFERENCE,
    "op11_merkle_manifest": oracles.MERKLE,
    "op12_license_scan": oracles.licenses(licenses.BASE, licenses.TEMPLATES, licenses.LEAST_SHARE),
    "op13_filter_audit": oracles.AUDIT,
}
