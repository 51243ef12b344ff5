"""Licence scans by a positional index of rare licence words.

A template is a passage of a licence with one or more key phrases, which must stand in their places for the licence to count. The
index maps every word of a key phrase to its postings (template, position). How rare a licence word is comes from the whole table:
the number of texts that hold it.

A text's licence words are looked up from the rarest (of the highest inverse document frequency) on. The first posting of a template
turns each occurrence p of the word into a place p - position where the template may begin; every further posting keeps
the places where its word stands at the same distance. A template with a word that the text lacks, or without places left, is out, so common
words are hardly ever looked up, and no occurrence is missed: all words of all key phrases are verified in the end. Places
that are left count if enough of the whole template stands there.

The phrases of ``BASE`` are templates that are one key phrase. The index (fixed templates) and the counts of its words are broadcast.

Defined results: a null text has no words. ``score`` is the greatest share of a template found in place, 0 without any. Rows
are independent: repeated rows, null and repeated ids give a result each; other columns are ignored; an empty table gives an empty
result. A word's occurrences in a very long text are one array, and templates are compared word by word, so memory is linear.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing A to Z
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(LETTERS).split()


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # phrases that must stand in their places

    def words(self) -> list[bytes]:
        return words_of(self.text)

    def key_places(self) -> list[int]:
        words, places = self.words(), set()
        for phrase in self.keys:
            key = words_of(phrase)
            at = [i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key]
            if not at:
                raise ValueError(f"{phrase!r} is no part of the template {self.label}")
            places.update(range(at[0], at[0] + len(key)))
        return sorted(places)


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,))


# Fixed values.
BASE = (_phrase("cc-by", "cc by"), _phrase("gpl", "general public license"), _phrase("reserved", "all rights reserved"))

# Passages of the public texts of licences. A version number or a name inside a passage may differ.
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("unlicense", "free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("public domain", "cc0")),
    Template("spdx", "spdx license identifier", ("spdx license identifier",)),
    Template("copyright", "copyright c all rights reserved", ("copyright c",)),
    Template("proprietary", "no part of this publication may be reproduced without the prior written permission of the publisher", ("may be reproduced", "written permission")),
)
LEAST_SHARE = 0.6


@dataclass(frozen=True)
class Match:
    template: int
    place: int  # of the template's first word, negative if the text begins inside it
    share: float


class Index:
    """Postings of the words in key phrases, by rarity."""

    def __init__(self, templates: tuple[Template, ...], texts_with: dict[bytes, int], least_share: float):
        self.words = [t.words() for t in templates]
        self.least_share = least_share
        self.numbers: dict[bytes, int] = {}
        for words in self.words:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers))
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[frozenset[bytes]] = []
        for number, (template, words) in enumerate(zip(templates, self.words)):
            places = template.key_places()
            self.needed.append(frozenset(words[p] for p in places))
            for p in places:
                self.postings[words[p]].append((number, p))
        self.order = sorted(self.postings, key=lambda w: (texts_with.get(w, 0), w))
        # A template is only thought of where its own rarest word stands.
        self.by_rarest: dict[bytes, list[int]] = defaultdict(list)
        for number, needed in enumerate(self.needed):
            self.by_rarest[min(needed, key=self.order.index)].append(number)
        self.rarest = frozenset(self.by_rarest)

    def matches(self, words: list[bytes]) -> list[Match]:
        present = set(words)
        possible = {t for w in self.rarest & present for t in self.by_rarest[w] if self.needed[t] <= present}
        if not possible:
            return []
        get = self.numbers.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        places: dict[int, np.ndarray] = {}
        for word in self.order:
            if word not in present:
                continue
            number, found = self.numbers[word], None
            for template, position in self.postings[word]:
                if template not in possible:
                    continue
                if template in places:
                    places[template] = places[template][self._stands(ids, places[template] + position, number)]
                else:
                    found = np.flatnonzero(ids == number) if found is None else found
                    places[template] = found - position
                if not len(places[template]):
                    possible.discard(template)
        out = []
        for template in possible:
            at, own = places[template], self.words[template]
            share = sum(self._stands(ids, at + i, self.numbers[w]).astype(np.int64) for i, w in enumerate(own)) / len(own)
            good = share >= self.least_share
            out += [Match(template, p, s) for p, s in zip(at[good].tolist(), share[good].tolist())]
        return out

    @staticmethod
    def _stands(ids: np.ndarray, at: np.ndarray, number: int) -> np.ndarray:
        inside = (at >= 0) & (at < len(ids))
        return inside & (ids[np.where(inside, at, 0)] == number)


def texts_with_words(docs: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each of the wanted words stands; one row per word comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, int] = defaultdict(int)
            for text in batch.column("text"):
                for w in wanted.intersection(words_of(text.as_py())):
                    held[w] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the places found, of each row of ``docs`` (doc_id, text).

    ``matches`` lists (label, place, share), ordered by place.
    """
    every = (*BASE, *templates)
    wanted = frozenset(w for t in every for w in t.words())
    counts = docs.sparkSession.sparkContext.broadcast(texts_with_words(docs, wanted))
    names = [t.label for t in every]
    n_base = len(BASE)
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    match_type = pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64()), ("share", pa.float64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(every, counts.value, least_share)
        for batch in batches:
            out: list[list] = [[] for _ in columns[1:]]
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found = index.matches(words)
                base = [m for m in found if m.template < n_base]
                said = sorted(({"label": names[m.template], "place": m.place, "share": m.share} for m in found), key=lambda m: (m["place"], m["label"], m["share"]))
                row = (
                    len(words), len(base), min((m.place for m in base), default=None), max((m.place for m in base), default=None),
                    ",".join(sorted({names[m.template] for m in base})), ",".join(sorted({m["label"] for m in said})),
                    max((m.share for m in found), default=0.0), said,
                )
                for held, value in zip(out, row):
                    held.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match_type]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out, kinds))], columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        read,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<label: string, place: long, share: double>>",
    )
