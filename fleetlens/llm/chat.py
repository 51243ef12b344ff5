"""Preference formatting of conversations.

A preference pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role and text, from the
first turn on) is the prompt and is rendered once; what follows in each is its completion. Both examples of a pair share the
prompt; the mask of an example says which of its segments are learned: those that an assistant wrote after the prompt.

Pairs are a table of their own. Where none is given, ``preference_examples`` makes a pair of every conversation: it is the chosen one,
and the rejected one is the same conversation up to its last assistant turn, with the last assistant turn of its neighbour (id XOR 1) in that
turn's place. ``pairs_by_number`` takes conversations 2 n and 2 n + 1 as chosen and rejected, and ``pairs_by_opening`` those that open with the same turn: the one with the most assistant text is the chosen one
(ties: the least id), and each other one is rejected against it, one pair per rejected member and never all pairs within.

All of it is built-in column functions. Prefixes are found by comparing turns in place of whole conversations: each rejected turn
meets the chosen turn of the same number in a join, and the first that differs is a minimum. Only the rendered text of one
example is ever put together in one row, since that row is the result.

Defined results: a null role renders as ``unknown`` and a null text as empty. Turns are ordered by number, nulls last; turns with the
same number by role and text, and are then numbered anew, so gaps and repeats in the numbers do not matter. Rows without a
conv_id are left aside. Repeated rows are turns said twice. Equal conversations have an empty completion on both sides. A conversation
without an assistant turn, or whose neighbour has none, is returned without a rejected side (nulls): its prompt ends before its own last
assistant turn, or is all of it. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    learned_role: str = "assistant"

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.open), role, F.lit("\n"), text, F.lit(self.close))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (0, 1, ...), role, text: a window over one conversation, which is one example."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return (
        conversations.filter("conv_id is not null")
        .select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .select("conv_id", (F.row_number().over(order) - 1).alias("k"), "role", "text")
    )


def pairs_by_opening(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """chosen_id, rejected_id: each conversation against the best of those with its opening turn."""
    merit = F.sum(F.when(F.col("role") == template.learned_role, F.char_length("text")).otherwise(0))
    heads = F.max(F.when(F.col("k") == 0, F.sha2(F.concat_ws("\x00", "role", "text"), 256)))
    each = turns.groupBy("conv_id").agg(heads.alias("opening"), merit.alias("merit"))
    best = each.groupBy("opening").agg(
        F.max_by("conv_id", F.struct("merit", -F.col("conv_id"))).alias("chosen_id"), F.count("*").alias("members")
    )
    return (
        each.join(best.filter("members > 1"), "opening").filter("conv_id <> chosen_id")
        .select("chosen_id", F.col("conv_id").alias("rejected_id"))
    )


def pairs_by_number(turns: DataFrame) -> DataFrame:
    """chosen_id, rejected_id: conversation 2 n is chosen over conversation 2 n + 1; one without a partner gives no pair."""
    both = turns.groupBy(F.shiftright("conv_id", 1)).agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"))
    return both.filter("chosen_id < rejected_id").select("chosen_id", "rejected_id")


def format_pairs(turns: DataFrame, pairs: DataFrame, template: Template = Template(), others: DataFrame | None = None) -> DataFrame:
    """One row per pair: prompt, both completions, both segment masks, and the number of shared turns.

    The turns of rejected conversations are among ``others``, or else among ``turns`` like those of the chosen ones.
    """
    others = turns if others is None else others
    lengths = others.groupBy(F.col("conv_id").alias("rejected_id")).agg(F.count("*").alias("rejected_turns"))
    sized = pairs.join(lengths, "rejected_id")
    chosen = turns.select(F.col("conv_id").alias("chosen_id"), "k", F.col("role").alias("c_role"), F.col("text").alias("c_text"))
    rejected = others.select(F.col("conv_id").alias("rejected_id"), "k", "role", "text")
    # The first rejected turn that the chosen conversation does not have in its place.
    met = sized.join(rejected, "rejected_id").join(chosen, ["chosen_id", "k"], "left")
    same = F.coalesce((F.col("role") == F.col("c_role")) & (F.col("text") == F.col("c_text")), F.lit(False))
    rendered = template.render(F.col("role"), F.col("text"))
    learned = F.when(F.col("role") == template.learned_role, 1).otherwise(0)
    segment = F.struct("k", rendered.alias("text"), learned.alias("learned"))
    reject_side = (
        met.groupBy("chosen_id", "rejected_id", "rejected_turns")
        .agg(F.min(F.when(~same, F.col("k"))).alias("differs"), F.sort_array(F.collect_list(segment)).alias("said"))
        .withColumn("shared", F.coalesce("differs", "rejected_turns").cast("int"))
    )
    choose_side = turns.groupBy(F.col("conv_id").alias("chosen_id")).agg(F.sort_array(F.collect_list(segment)).alias("chosen_said"))

    def text(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda s: s["text"]), "")

    def mask(parts: Column) -> Column:
        return F.transform(parts, lambda s: s["learned"])

    shared, said, other = F.col("shared"), F.col("said"), F.col("chosen_said")
    rest = F.slice(said, shared + 1, F.greatest(F.size(said) - shared, F.lit(0)))
    best = F.slice(other, shared + 1, F.greatest(F.size(other) - shared, F.lit(0)))
    zeros = F.when(shared > 0, F.array_repeat(F.lit(0), shared)).otherwise(F.array().cast("array<int>"))
    return reject_side.join(choose_side, "chosen_id").select(
        "chosen_id", "rejected_id", shared.cast("long").alias("shared_turns"),
        text(F.slice(said, F.lit(1), shared)).alias("prompt"), text(best).alias("chosen"), text(rest).alias("rejected"),
        F.concat(zeros, mask(best)).alias("chosen_mask"), F.concat(zeros, mask(rest)).alias("rejected_mask"),
    )


def swapped_replies(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, at (its last assistant turn), reply_id, reply_role and reply (the neighbour's last assistant turn; null without one)."""
    spoken = F.when(F.col("role") == template.learned_role, F.struct("k", "role", "text"))
    each = turns.groupBy("conv_id").agg(F.max(spoken).alias("last"), F.count("*").alias("turns"))
    own = each.select("conv_id", F.coalesce("last.k", "turns").alias("at"), F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("beside"), F.col("last").isNotNull().alias("speaks"))
    other = each.filter("last is not null").select(F.col("conv_id").alias("reply_id"), F.col("last.role").alias("reply_role"), F.col("last.text").alias("reply"))
    return own.join(other, (F.col("beside") == F.col("reply_id")) & F.col("speaks"), "left").drop("beside", "speaks")


def preference_examples(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply; see the module text."""
    turns = numbered_turns(conversations)
    swaps = swapped_replies(turns, template)
    swapped = F.col("k") == F.col("at")
    others = turns.join(swaps.filter("reply_id is not null"), "conv_id").filter("k <= at").select(
        "conv_id", "k", F.when(swapped, F.col("reply_role")).otherwise(F.col("role")).alias("role"),
        F.when(swapped, F.col("reply")).otherwise(F.col("text")).alias("text"),
    )
    same = swaps.filter("reply_id is not null").select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    pairs = format_pairs(turns, same, template, others).withColumn("rejected_id", F.col("chosen_id").bitwiseXOR(F.lit(1).cast("long")))
    # Conversations that stay alone are met with an empty rejected side.
    alone = turns.join(swaps.filter("reply_id is null").select("conv_id", "at"), "conv_id")
    learned = F.when((F.col("role") == template.learned_role) & (F.col("k") >= F.col("at")), 1).otherwise(0)
    segment = F.struct("k", template.render(F.col("role"), F.col("text")).alias("text"), learned.alias("learned"))
    said = alone.groupBy("conv_id", "at").agg(F.sort_array(F.collect_list(segment)).alias("said"))

    def text(chosen) -> Column:
        return F.array_join(F.transform(F.filter("said", chosen), lambda s: s["text"]), "")

    return pairs.unionByName(
        said.select(
            F.col("conv_id").alias("chosen_id"), F.lit(None).cast("long").alias("rejected_id"), F.col("at").cast("long").alias("shared_turns"),
            text(lambda s: s["k"] < F.col("at")).alias("prompt"), text(lambda s: s["k"] >= F.col("at")).alias("chosen"),
            F.lit(None).cast("string").alias("rejected"), F.transform("said", lambda s: s["learned"]).alias("chosen_mask"),
            F.lit(None).cast("array<int>").alias("rejected_mask"),
        )
    )
