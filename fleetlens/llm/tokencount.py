"""Token counts with a shortcut for pre-tokens that are one token.

Offline, once per vocabulary, each vocabulary string is encoded on its own; those that come out as exactly one token are the
proven set. It is broadcast (at most one string per vocabulary entry). A text is first cut at the special strings, each of which is
one token, then into pre-tokens by the pattern. Pre-tokens in the proven set count 1 without being looked at again; only the
distinct rest of a run of texts is merged, in one call of the tokenizers library.

That pre-tokens may be encoded apart from each other is a property of the pattern: cutting a pre-token again gives the pre-token. The
proof set and the rest both rely on it, nothing else is assumed of the vocabulary.

Defined results: a null text is empty and has 0 bytes and 0 tokens. Rows are independent; null and repeated ids are carried along, other
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT = 512
KEPT_PRETOKENS = 200_000
RUN_TOKENS = 1 << 18


def load(data: str):
    import tokenizers

    return tokenizers.Tokenizer.from_str(data)


def single_tokens(data: str) -> list[str]:
    """The vocabulary strings that encode alone as one token, in the form in which they occur in texts."""
    tokenizer = load(data)
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    strings = [s for s in dict.fromkeys(strings) if s and "�" not in s]  # a part of a character is no text
    special = set(special_strings(data))
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, found) if len(e.ids) == 1 and s not in special]


def special_strings(data: str) -> list[str]:
    """Added tokens; those that take neighbours along or ask for whole words would need more than cutting."""
    added = json.loads(data)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("added tokens with conditions are not supported")
    return [t["content"] for t in added]


class Counting:
    """Counts the tokens of texts."""

    def __init__(self, data: str, single: list[str], pattern: str):
        import regex

        self.tokenizer = load(data)
        special = sorted(special_strings(data), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(pattern).findall
        self.single = dict.fromkeys(single, 1)
        self.known = dict(self.single)

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings."""
        if self.cut is None or not self.cut.search(text):
            return self.split(text), 0
        parts = self.cut.split(text)
        return [t for part in parts for t in self.split(part)], len(parts) - 1

    def _settle(self, waiting: list[tuple[list[str], int]]) -> Iterator[int]:
        """Counts of texts whose pre-tokens are at hand: what is not known yet is merged once for all of them."""
        if len(self.known) > len(self.single) + KEPT_PRETOKENS:
            self.known = dict(self.single)
        new = list(set().union(*(tokens for tokens, _ in waiting)).difference(self.known))
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            self.known.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch(part, add_special_tokens=False))))
        size = self.known.__getitem__
        for tokens, special in waiting:
            yield special + sum(map(size, tokens))

    def count(self, texts: Iterable[str]) -> Iterator[int]:
        """The counts of many texts, in runs of about ``RUN_TOKENS`` pre-tokens."""
        waiting, held = [], 0
        for text in texts:
            waiting.append(self.pre_tokens(text))
            held += len(waiting[-1][0])
            if held >= RUN_TOKENS:
                yield from self._settle(waiting)
                waiting, held = [], 0
        yield from self._settle(waiting)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text)."""
    with open(path, encoding="utf-8") as file:
        data = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((data, single_tokens(data)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(*shared.value, pattern)
        for batch in batches:
            counts = list(counting.count(t.as_py() or "" for t in batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(
        measure, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
