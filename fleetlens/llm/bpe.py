"""Byte-level BPE through a sentencepiece model that is written from the vocabulary.

A rank file lists byte strings by merge rank. Its sentencepiece twin has one piece per entry: the bytes mapped one by one to
printable characters, the score the negative rank, so that sentencepiece, which merges the best-scored pair first, merges in the
order of the ranks. Its normaliser is the identity. Piece 0 is the unknown piece that the format asks for (no text reaches it, as
every single byte is an entry), so piece = rank + 1.

A text is cut into pre-tokens by the pattern; a pre-token that is itself an entry is that entry, any other one goes through the model.
Decoding maps each id back to its bytes.

Defined results: a null text is empty, an empty text has no ids (and the digests of nothing). Rows are independent; null and repeated
ids are carried along, other columns are ignored, an empty table gives an empty result. Long texts take time in proportion (n log n within
one pre-token).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

KEPT_PRETOKENS = 200_000  # remembered per task, then forgotten all at once


def byte_characters() -> str:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


def read_ranks(data: bytes) -> list[bytes]:
    """The entries of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    pairs = (line.split() for line in data.splitlines() if line)
    ranked = sorted((int(rank), base64.b64decode(entry)) for entry, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be consecutive from 0")
    return [entry for _, entry in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of the wire format: bytes, whole number or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


# Field numbers and values of the public sentencepiece_model.proto (fixed values).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TYPE_NORMAL, TYPE_UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, MODEL_BPE = 3, 4, 40, 41, 42, 43, 2
NORMALIZER_NAME, DUMMY_PREFIX, EXTRA_WHITESPACE, ESCAPE_WHITESPACE = 1, 3, 4, 5
NO_ID = (1 << 64) - 1  # -1


def model_bytes(entries: list[bytes]) -> bytes:
    """The serialised sentencepiece model of a vocabulary."""
    table = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(PIECES, _field(PIECE_TEXT, text.encode()) + _field(PIECE_SCORE, score) + _field(PIECE_TYPE, kind))

    unknown = piece("⁇", 0.0, TYPE_UNKNOWN)  # no mapped byte has this character
    pieces = [piece(e.decode("latin-1").translate(table), -float(rank), TYPE_NORMAL) for rank, e in enumerate(entries)]
    trainer = b"".join(
        _field(n, v)
        for n, v in ((MODEL_TYPE, MODEL_BPE), (VOCAB_SIZE, len(entries) + 1), (UNK_ID, 0), (BOS_ID, NO_ID), (EOS_ID, NO_ID), (PAD_ID, NO_ID))
    )
    normalizer = _field(NORMALIZER_NAME, b"identity") + b"".join(
        _field(n, 0) for n in (DUMMY_PREFIX, EXTRA_WHITESPACE, ESCAPE_WHITESPACE)
    )
    return unknown + b"".join(pieces) + _field(TRAINER, trainer) + _field(NORMALIZER, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, entries: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.entries = entries
        self.whole = {e: (rank,) for rank, e in enumerate(entries)}
        self.table = byte_characters()
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        known = self.known
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if new:
            self._learn(new)
        ids = list(chain.from_iterable(map(known.__getitem__, tokens)))
        if len(known) > KEPT_PRETOKENS:
            known.clear()
        return ids

    def _learn(self, tokens: list[str]) -> None:
        merge = []
        for token in tokens:
            own = self.whole.get(token.encode())
            if own:
                self.known[token] = own
            else:
                merge.append(token)
        mapped = [t.encode().decode("latin-1").translate(self.table) for t in merge]
        for token, pieces in zip(merge, self.model.encode(mapped, num_threads=1) if merge else ()):
            self.known[token] = tuple(p - 1 for p in pieces)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


def vocabulary(spark: SparkSession, path: str) -> list[bytes]:
    """Entries of the rank file at a path that the driver or Spark can read (some 50,000 of them, a fixed size)."""
    with open(path, "rb") as file:
        return read_ranks(file.read())


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded bytes of each row of ``docs`` (doc_id, text)."""
    return _coded(docs, path, pattern, "ids array<int>, decoded binary", lambda ids, data: (ids, data))


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes, so neither leaves its task."""

    def digests(ids: list[int], data: bytes) -> tuple[str, str]:
        listed = ",".join(map(str, ids))
        return hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(data).hexdigest()

    return _coded(docs, path, pattern, "ids_sha256 string, decoded_sha256 string", digests)


def _coded(docs: DataFrame, path: str, pattern: str, columns: str, make) -> DataFrame:
    entries = vocabulary(docs.sparkSession, path)
    shared = docs.sparkSession.sparkContext.broadcast((entries, model_bytes(entries)))
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in columns.split(", ")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts, made = [], []
                for text in part.column("text"):
                    ids = codec.encode(text.as_py() or "")
                    counts.append(len(ids))
                    made.append(make(ids, codec.decode(ids)))
                values = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(counts, np.int64)), *values], ["doc_id", "n_tokens", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(code, f"doc_id {kind}, n_tokens long, {columns}")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each row of ``coded`` (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary(coded.sparkSession, path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in batches:
            texts = [b"".join(entries[i] for i in ids.as_py() or ()).decode(errors="replace") for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(read, f"doc_id {kind}, text string")
