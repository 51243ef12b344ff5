"""Manifest, licence scan and filter audit on awkward rows against the rules said plainly."""

import hashlib
import os
import re
import sys
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from cases import awkward, frame, lower, normal, words  # noqa: E402

from fleetlens.llm import common, filteraudit, licenses, merkle  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows, extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], extra=True)


# Manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Root, and for every node its siblings from below with the side they stand on."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, i in zip(paths, at):
            other = i ^ 1
            path.append((other < i, level[other] if other < len(level) else ""))
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return (level[0] if level else None), paths


def plain_manifest(rows):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        told = n_chars
        if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            told = n_chars + 1
        trees[lang].append((doc_id, plain_leaf(doc_id, text, lang, source, n_chars), plain_leaf(doc_id, text, lang, source, told)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made[lang] = plain_tree([r[1] for r in trees[lang]])
    root, tops = plain_tree([made[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for (doc_id, leaf, told), path in zip(trees[lang], made[lang][1]):
            node = told
            for left, sibling in path + top:
                node = H(sibling, node) if left else H(node, sibling)
            out.append((doc_id, leaf, made[lang][0], root, H(*(s for _, s in path + top)), node, node == root))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest(docs, rows, empty):
    expected = plain_manifest(rows)
    assert normal(merkle.manifest(docs).select(*MANIFEST).collect()) == normal(expected)
    assert {r[-1] for r in expected} == {True, False}
    assert merkle.manifest(empty).collect() == []


@pytest.mark.parametrize("n", [1, 3, 8])
def test_manifest_of_every_shape(spark, n):
    rows = [(i, f"text {i}", "en", "a", i) for i in range(n)] + [(100 + i, "x", f"l{i}", None, None) for i in range(n - 1)]
    got = merkle.manifest(frame(spark, rows)).select(*MANIFEST).collect()
    assert normal(got) == normal(plain_manifest(rows))


def test_manifest_extremes(spark):
    rows = [(2**63 - 1, "a", None, "s", 2**63 - 1), (-(2**63), "b", "", "s", -1), (0, "", "\U0001f600", "", 0), (None, None, None, None, None)]
    rows += [(i, "a", "￿", "s", 2**63 - 1) for i in range(40)]
    assert normal(merkle.manifest(frame(spark, rows)).select(*MANIFEST).collect()) == normal(plain_manifest(rows))


def test_places_of_a_hot_group(spark):
    """Places are 0, 1, ... in every group, also where equal rows fill many ranges."""
    rows = [("hot", i % 3 if i % 2 else 7) for i in range(5000)] + [("cold", i) for i in range(5)] + [("", 1)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(13)
    got = common.numbered(df, "g", ["x"], "places-test").collect()
    for g in ("hot", "cold", ""):
        own = sorted((r.place, r.x) for r in got if r.g == g)
        values = sorted(x for k, x in rows if k == g)
        assert own == list(enumerate(values))
        assert {r.members for r in got if r.g == g} == {len(values)}


# Licences


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_scan(text, templates, least):
    """Every template tried at every place."""
    own = licence_words(text)
    found, n_base = [], len(licenses.BASE)
    for number, t in enumerate((*licenses.BASE, *templates)):
        want = [w.decode() for w in t.words()]
        first = t.key_places()[0]
        for place in range(-len(want) + 1, len(own)):
            if not (0 <= place + first < len(own) and own[place + first] == want[first]):
                continue
            same = [0 <= place + i < len(own) and own[place + i] == w for i, w in enumerate(want)]
            if all(same[i] for i in t.key_places()) and sum(same) / len(want) >= least:
                found.append((number < n_base, t.label, place, sum(same) / len(want)))
    base = [f for f in found if f[0]]
    return (
        len(own), len(base), min((f[2] for f in base), default=None), max((f[2] for f in base), default=None),
        ",".join(sorted({f[1] for f in base})), ",".join(sorted({f[1] for f in found})), max((f[3] for f in found), default=0.0),
    )


def licence_rows():
    apache = "Licensed under the Apache License, Version 2.0"
    texts = [
        None, "", "CC-BY", "cc BY cc by, cc/by by cc", "All rights\nreserved. all rights all rights reserved", apache, f"é{apache}", f"é {apache}",
        "under the Apache License, version 1.1 of it", "Apache License", "GNU General Public License " * 3, "general public license",
        "the terms of the GNU Lesser General Public License", "mit license", "released under the MIT-license", "word " * 5000 + apache + " cc by" * 3000,
        "copyright (c) 2020 someone, all rights reserved", "Copyright (c) All rights reserved", "free unencumbered software", "released into the public domain",
        "SPDX-License-Identifier: MIT", "0cc by", "cc by0", "CC\x00BY",
    ]
    for t in licenses.TEMPLATES:
        own = t.text.split()
        texts += [t.text, t.text.upper() + "!", " ".join(own[1:]), " ".join(own[:-1]), " ".join(own[2:-2]), " ".join([*own[:3], "odd", *own[3:]])]
    return [(i, t, "en", "a", 0) for i, t in enumerate(texts)]


SCAN = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


@pytest.mark.parametrize("least", [0.6, 0.0, 1.0])
def test_licences(spark, docs, rows, empty, least):
    some = licence_rows()
    got = licenses.scan(frame(spark, some), least_share=least).select(*SCAN).collect()
    expected = {r[0]: plain_scan(r[1], licenses.TEMPLATES, least) for r in some}
    assert {r.doc_id: tuple(r)[1:] for r in got} == expected
    awk = licenses.scan(docs, least_share=least).select(*SCAN).collect()
    assert normal(awk) == normal((r[0], *plain_scan(r[1], licenses.TEMPLATES, least)) for r in rows)
    assert licenses.scan(empty).collect() == []


def test_licence_word_bytes():
    for i in range(0x80):
        c = chr(i)
        assert licenses.words_of(f" {c} ") == [w.encode() for w in licence_words(f" {c} ")]


def test_rarity_changes_the_order_and_not_the_result():
    texts = [r[1] for r in licence_rows()]
    every = (*licenses.BASE, *licenses.TEMPLATES)
    vocabulary = sorted({w for t in every for w in t.words()})
    rng = np.random.default_rng(3)
    want = None
    for _ in range(4):
        counts = dict(zip(vocabulary, rng.integers(0, 1000, len(vocabulary)).tolist()))
        index = licenses.Index(every, counts, 0.6)
        got = [sorted((m.template, m.place, m.share) for m in index.matches(licenses.words_of(t))) for t in texts]
        want = want or got
        assert got == want


def test_texts_with_words_counts_texts(docs, rows):
    got = licenses.texts_with_words(docs, frozenset([b"the", b"one", b"absent"]))
    plain = {w: sum(w.decode() in licence_words(r[1]) for r in rows) for w in (b"the", b"one", b"absent")}
    assert got == {w: n for w, n in plain.items() if n}


# Filter audit


def plain_counts(text):
    own = words(text)
    text = text or ""
    return [len(own), len(set(own)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def plain_audit(rows, labels):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    masks = []
    for doc_id, text, _, source, _ in rows:
        n, distinct, capitals, points, signs = plain_counts(text)
        fails = set()
        if n < 200:
            fails.add("A")
        if 100 * distinct < 50 * n:
            fails.add("B")
        if 100 * capitals > 2 * points:
            fails.add("C")
        if signs:
            fails.add("D")
        if doc_id is not None and doc_id > least[text or ""]:
            fails.add("E")
        masks.append((source or "", fails, doc_id in good, doc_id in toxic))
    orders = list(permutations("ABCDE"))
    out = []
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        shapley = {f: sum(f in fails and not fails & set(o[: o.index(f)]) for o in orders for fails, _, _ in own) for f in "ABCDE"}
        for o in orders:
            for step, f in enumerate(o, 1):
                before = set(o[: step - 1])
                gone = [x for x in own if f in x[0] and not x[0] & before]
                out.append(
                    (
                        part, "".join(o), step, sum(not x[0] & (before | {f}) for x in own), len(gone), sum(f in x[0] and bool(x[0] & before) for x in own),
                        sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone), shapley[f],
                    )
                )
    return out


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit(spark, docs, rows, empty):
    labels = [(5, 1, 0), (7, 0, 1), (7, 1, None), (None, 1, 1), (16, 0, 1), (101, 1, 1), (101, 1, 1), (9999, 1, 1), (19, None, 1), (9, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert normal(filteraudit.audit(docs, table).select(*AUDIT).collect()) == normal(plain_audit(rows, labels))
    assert filteraudit.audit(empty, table).collect() == []
    none = plain_audit(rows, [])
    assert normal(filteraudit.audit(docs, table.limit(0)).select(*AUDIT).collect()) == normal(none)


def packed(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)


@pytest.mark.parametrize("run", [1, 7, 64, 1 << 20])
def test_transducer(rows, run):
    texts = [r[1] for r in rows if len(r[1] or "") < 5000] + ["a", " a", "a ", "", " ", "ab\tab\nAB#", "é" * 9 + " " + "é" * 9, "x" * 17 + " " + "x" * 16 + "y", "\x1c\x85  \x00"]
    assert filteraudit.measure_all(*packed(texts), run=run).tolist() == [plain_counts(t) for t in texts]


def test_words_that_share_a_hash_stay_apart():
    data, bounds = packed(["one two three one two", "one", "abcdefgh1 abcdefgh2 abcdefgh1"])
    _, spans = filteraudit.transduce(data, bounds)
    for hashes in (np.zeros(len(spans.starts), np.uint64), np.arange(len(spans.starts), dtype=np.uint64) // np.uint64(3) * np.uint64(0), None):
        held = spans.distinct(hashes)
        assert np.bincount(spans.docs[held]).tolist() == [3, 1, 2]


def test_arrow_buffers_of_a_slice():
    import pyarrow as pa

    column = pa.array(["left out", "é", "", "last"]).slice(1, 3)
    data, bounds = filteraudit.buffers(column)
    assert [data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])] == ["é", "", "last"]
