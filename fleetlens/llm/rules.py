"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves one bit (set: the rule failed) in a ledger row, next to the measurements
behind it. A policy is a named version of "these bits reject": it is applied to ledgers by bitwise operations, so a new policy
or an ablation never reads a text again. Ablations group the ledger by its bits first (at most 2^rules groups) and then compare
masks.

All of it is built-in column functions.

Defined results: a null text has no words, so it fails ``few_words``. Rows are independent: repeated rows give repeated ledger
rows, ids may be null, other columns are carried along by ``filter_documents`` and ignored elsewhere. A repeated-window count on
very long texts costs n log n. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, settle

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words that the text holds twice or more.

    Hashes only rule texts out: if no two window hashes are equal, no two windows are. Otherwise the windows themselves are
    sorted and compared.
    """
    starts = F.sequence(F.lit(1), F.size(words) - F.lit(width - 1))
    hashes = F.sort_array(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width))))
    any_equal = F.size(hashes) > F.size(F.array_distinct(hashes))

    ordered = F.sort_array(F.transform(starts, lambda i: F.struct(F.slice(words, i, width).alias("w"), i.alias("i"))))

    def mark(sorted_: Column) -> Column:
        def equal(a: Column, b: Column) -> Column:
            return F.coalesce(F.get(sorted_, a)["w"] == F.get(sorted_, b)["w"], F.lit(False))

        hit = F.filter(sorted_, lambda x, k: equal(k, k - 1) | equal(k, k + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    # A window covers its words up to where the next repeated window begins.
    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    def bind(value: Column, body) -> Column:
        """Evaluate ``value`` once and hand it to ``body``."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    exact = bind(bind(ordered, mark), covered)
    return F.when(F.size(words) <= width, F.lit(0)).when(any_equal, exact).otherwise(F.lit(0)).cast("long")


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns computed once per row, whatever filters and expressions are put on top.

    A filter on a column is otherwise rewritten as a filter on its expression, which is then evaluated again for every mention,
    and for each element where the mention is inside a lambda. Nothing is moved below a generator, so one of a single row is put here.
    """
    return df.select("doc_id", F.inline(F.array(F.struct(*columns))))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and every measurement that a rule uses; texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = " \t\n\x0b\x0c\r"
    cut = docs.select(F.col("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.filter(F.split(F.btrim("text", F.lit(blank)), SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(blank)) != "").alias("lines"),
    )
    source = _once(cut, "text", "words", "lines")
    joined = F.concat_ws("", "words")
    measured = source.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.char_length(joined).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
    )
    return _once(measured, *measured.columns[1:])


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str  # SQL condition over the measurements


# The position of a rule is its bit. Append only: stored ledgers depend on it.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("capitals", "10 * n_upper > 3 * word_chars"),
    Rule("shouting", "4 * n_shouts > n_words"),
    Rule("poor_vocabulary", "n_words >= 50 and 100 * n_distinct_words < 20 * least(n_words, 500)"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]  # failing any of them rejects

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(name) for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("2024-1", tuple(r.name for r in RULES[:4])),
    Policy("2024-2", tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[-1]


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed_bits`` of each document."""
    bits = [F.when(F.expr(r.failed), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measurements(docs).withColumn("failed_bits", total.cast("long"))


def rejected(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """One row per ledger row and policy version."""
    versions = F.array(*[F.struct(F.lit(p.version).alias("version"), rejected(p).alias("rejected")) for p in policies])
    return book.select("*", F.inline(versions))


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule in it: documents that fail the rule, that only this rule rejects, and that the policy rejects.

    ``common_bits`` and ``any_bits`` are the bitwise AND and OR over the rejected documents.
    """
    groups = book.groupBy("failed_bits").agg(F.count("*").alias("docs"))
    cases = F.array(
        *[
            F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit"))
            for p in policies
            for i, r in enumerate(RULES)
            if r.name in p.rules
        ]
    )
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    docs = F.col("docs")
    return (
        groups.select("*", F.inline(cases))
        .groupBy("version", "rule")
        .agg(
            F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, docs).otherwise(0)).alias("failing"),
            F.sum(F.when(hit == F.col("bit"), docs).otherwise(0)).alias("only_this_rule"),
            F.sum(F.when(hit != 0, docs).otherwise(0)).alias("rejected"),
            F.bit_and(F.when(hit != 0, hit)).alias("common_bits"), F.bit_or(F.when(hit != 0, hit)).alias("any_bits"),
        )
    )


def kept_column(policy: Policy) -> str:
    return "kept_" + policy.version.replace("-", "_")


def verdicts(docs: DataFrame, policy: Policy = CURRENT, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The written ledger with every policy version applied, and what the ablations of ``policy`` say.

    ``sole_rule`` is the rule that alone rejects a document, ``sole_rule_docs`` how many documents it alone rejects, so how many come
    back if it is left out; both are null for all other documents.
    """
    book = settle(ledger(docs), "rules-ledger")
    hit = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    sole = F.element_at(
        F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(1 << i).cast("long"), F.lit(r.name))]), F.when(F.bit_count(hit) == 1, hit)
    )
    alone = ablations(book, (policy,)).select(F.col("rule").alias("sole_rule"), F.col("only_this_rule").alias("sole_rule_docs"))
    judged = book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejected(BASE).alias("base_failed"), (~(rejected(BASE) | rejected(policy))).alias("kept"),
        "failed_bits", F.lit(policy.version).alias("policy"), *[(~rejected(p)).alias(kept_column(p)) for p in policies], sole.alias("sole_rule"),
    )
    return judged.join(F.broadcast(alone), "sole_rule", "left")  # one row per rule


def filter_documents(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they were.

    The ledger is computed beside each row, so no join on ids is needed.
    """
    row = docs.select(F.struct("*").alias("row"))
    book = ledger(row.select(F.col("row").alias("doc_id"), F.col("row.text").alias("text")))
    return book.filter(~(rejected(BASE) | rejected(policy))).select("doc_id.*")
