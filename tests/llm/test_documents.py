"""Each operator on awkward rows against the rule said plainly; whole test tables against SQL."""

import glob
import hashlib
import math
import os
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from cases import awkward, crc, frame, lower, normal, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from fleetlens.llm import bloom, bpe, chat, chunks, lmscore, mixing, queries, rules, simhash, tokencount, toxicity, urls  # noqa: E402
from fleetlens.llm.components import component_roots  # noqa: E402

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows, extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], extra=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = queries.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert normal(found.select(*columns).collect()) == normal(cursor.fetchall())


# Language-model scores


def test_base_scores(docs, rows):
    tokens = [[*words(lower(r[1])), "\n"] for r in rows]
    train = Counter(t for r, ts in zip(rows, tokens) if crc(r[0], 5) != 1 for t in ts)
    n, v = sum(train.values()), len(train)
    scale = n + 0.5 * (v + 1)
    expected = normal(
        (r[0], crc(r[0], 5) == 1 and r[0] is not None, len(ts), sum(train[t] > 0 for t in ts), n, round(sum(math.log10((train[t] + 0.5) / scale) for t in ts), 6))
        for r, ts in zip(rows, tokens)
    )
    for hot in (1 << 18, 3):  # with three hot tokens nearly all go through the join
        got = lmscore.score(docs, lmscore.ModelSpec(hot_tokens=hot)).collect()
        assert normal((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
        assert all(r.score < 0 for r in got)


def test_base_scores_of_texts_cut_into_slices(spark, rows):
    """Batches above ``slice_bytes`` are cut; the later slices keep their texts."""
    texts = [r[1] for r in rows]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    for limit in (1, 2000, 1 << 30):
        found = []
        for held in lmscore._slices(iter([batch]), limit):
            sizes = np.diff(np.r_[held.starts, len(held.ids)])
            found += [held.hashes[ids].tolist() for ids in np.split(held.ids, np.cumsum(sizes)[:-1])]
        assert found == [lmscore.token_hashes([*(w.encode() for w in words(lower(t))), lmscore.END]).tolist() for t in texts]
    docs = frame(spark, rows).coalesce(1)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    whole, cut = (lmscore.score(docs, lmscore.ModelSpec(slice_bytes=limit, cell_bytes=limit)).collect() for limit in (1 << 30, 3000))
    assert normal((*(r[c] for c in columns), round(r.base_score, 6), round(r.score, 6)) for r in cut) == normal(
        (*(r[c] for c in columns), round(r.base_score, 6), round(r.score, 6)) for r in whole
    )


def test_grams_of_slices_are_added_up():
    """Runs of a cell are summed; grams that share one half of their hash only stay apart."""
    rng = np.random.default_rng(3)
    runs = [(*rng.integers(0, 4, (2, n)).astype(np.uint64), rng.integers(1, 9, n)) for n in (0, 1, 40, 300)]
    want = Counter()
    for run in runs:
        for h1, h2, n in zip(*run, strict=True):
            want[int(h1), int(h2)] += int(n)
    h1, h2, n = lmscore._added(runs)
    assert len(h1) == len(want) and {(int(a), int(b)): int(c) for a, b, c in zip(h1, h2, n, strict=True)} == want
    h1 = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    found = lmscore._celled(lmscore.PAIRS, h1, h1 + np.uint64(1), np.arange(1, 5001), 7)
    assert found.column("cell").to_pylist() == list(range(7))
    back = [np.frombuffer(b"".join(found.column(c).to_pylist()), np.uint64) for c in ("h1", "h2", "n")]
    order = np.argsort(h1)
    assert all((x == y).all() for x, y in zip(back, (h1[order], h1[order] + np.uint64(1), np.arange(1, 5001)[order]), strict=True))


def masses(model, vocabulary, contexts):
    """Sum of P(. | h) over the vocabulary for each context h, and of P(.)."""
    import numpy as np

    hashes = lmscore.token_hashes([w.encode() for w in vocabulary])
    size = len(vocabulary)
    single = 10 ** lmscore.slice_scores(model, np.arange(size), np.arange(size), hashes)[0]
    found = []
    for at in contexts:
        ids = np.stack([np.full(size, at), np.arange(size)], 1).ravel()
        both = 10 ** lmscore.slice_scores(model, ids, np.arange(0, len(ids), 2), hashes)[0]
        found.append((both / single[at]).sum())
    return np.array(found), single.sum()


def training_words(texts):
    counts = Counter(t for doc_id, text in texts if crc(doc_id, 5) != 1 for t in [*words(lower(text)), "\n"])
    return [w for w, _ in counts.most_common()]


def test_model_probabilities(spark, docs, rows):
    """P(. | h) sums to one over the vocabulary and one unseen word, for frequent and for rare words h."""
    spec = lmscore.ModelSpec()
    model = lmscore.fit(lmscore.gram_counts(docs, spec), spec)
    vocabulary = [*training_words((r[0], r[1]) for r in rows), "one-unseen-word"]
    found, single = masses(model, vocabulary, range(0, len(vocabulary) - 1, 97))
    assert 0.99 < single < 1.01
    assert ((found > 0.98) & (found < 1.02)).mean() > 0.98 and found.max() < 1.3


def test_model_probabilities_of_a_large_vocabulary(spark):
    """Invented pairs grow with the vocabulary; their guards grow as well."""
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    spec = lmscore.ModelSpec()
    model = lmscore.fit(lmscore.gram_counts(whole, spec), spec)
    vocabulary = [*training_words((r.doc_id, r.text) for r in whole.collect()), "one-unseen-word"]
    contexts = sorted({int(len(vocabulary) ** (i / 60)) for i in range(1, 60)})
    found, single = masses(model, vocabulary, contexts)
    assert 0.99 < single < 1.01
    assert ((found > 0.98) & (found < 1.02)).mean() > 0.95 and found.max() < 1.6, sorted(found)


def test_counts_come_back_from_the_filter(docs):
    import numpy as np

    spec = lmscore.ModelSpec()
    counts = lmscore.gram_counts(docs, spec)
    model = lmscore.fit(counts, spec)
    for kind in (lmscore.TOKENS, lmscore.PAIRS):
        table = counts.filter(f"kind = {kind}").toPandas()
        h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        level = lmscore.level_of(table.n.to_numpy(), spec.base)
        if kind == lmscore.TOKENS:
            want, got = level, model.tokens(np.stack([h1, h2], 1))
        else:
            want, got = level - spec.skipped, model.pairs(h1)
            assert (lmscore.least_count(want + spec.skipped, spec.base) <= table.n).all()
        assert len(table) and (got >= want).all() and (got > want).mean() < 0.03


def test_pairs_that_the_filter_cannot_hold_are_looked_up(spark):
    """A filter with room for the words alone, or for a part of the pairs, gives the scores of one that holds all."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    spec = lmscore.ModelSpec()
    whole = {r.doc_id: r.score for r in lmscore.score(docs, spec).collect()}
    counts = lmscore.gram_counts(docs, spec)
    full = lmscore.fit(counts, spec)
    assert full.least_pair == 1
    tokens = int(lmscore.level_of(counts.filter(f"kind = {lmscore.TOKENS}").toPandas().n.to_numpy(), spec.base).sum())
    pairs = full.filter.size / spec.bits_per_event - tokens
    for share in (0, 0.5):
        small = lmscore.ModelSpec(filter_bits=int((tokens + share * pairs + 2) * spec.bits_per_event))
        model = lmscore.fit(lmscore.gram_counts(docs, small), small)
        assert model.least_token == 1 and model.least_pair > 1
        got = {r.doc_id: r.score for r in lmscore.score(docs, small).collect()}
        assert got.keys() == whole.keys()
        apart = sorted(abs(got[i] - whole[i]) / -whole[i] for i in whole)
        assert apart[-1] < 0.02, apart[-5:]  # false positives differ


def test_words_that_the_filter_cannot_hold_are_looked_up(spark, docs):
    """A filter with room for half or a tenth of the words gives the scores of one that holds all; rare words keep their own counts."""
    for table in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), docs):
        whole = {(r.doc_id, r.n_tokens): r.score for r in lmscore.score(table).collect()}
        spec = lmscore.ModelSpec()
        counts = lmscore.gram_counts(table, spec)
        full = lmscore.fit(counts, spec)
        tokens = int(lmscore.level_of(counts.filter(f"kind = {lmscore.TOKENS}").toPandas().n.to_numpy(), spec.base).sum())
        for share in (0.5, 0.1):
            small = lmscore.ModelSpec(filter_bits=int(share * tokens * spec.bits_per_event), slice_bytes=100_000)
            model = lmscore.fit(counts, small)
            assert model.least_token > 1 and model.total == full.total
            got = {(r.doc_id, r.n_tokens): r.score for r in lmscore.score(table, small).collect()}
            assert got.keys() == whole.keys()
            apart = sorted(abs(got[i] - whole[i]) / -whole[i] for i in whole)
            assert apart[-1] < 0.03 and apart[len(apart) // 2] < 0.005, apart[-5:]  # false positives differ


def test_small_filter_keeps_the_frequent_grams(docs):
    spec = lmscore.ModelSpec(filter_bits=4096)
    got = lmscore.score(docs, spec)
    assert got.count() == docs.count() and got.filter("score is null or score >= 0 or isnan(score)").isEmpty()


def test_scores_without_training_rows(spark, empty):
    assert lmscore.score(empty).count() == 0
    only = next(i for i in range(100) if crc(i, 5) == 1)
    got = lmscore.score(frame(spark, [(only, "never seen", None, None, None)])).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(only, 3, 0, 0, 0.0)]


def test_held_out_texts_score_above_the_base(spark):
    got = queries.QUERIES["op1_lm_score"](spark, "/root/testdata/sf0.01").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


# Quality rules


def plain_measures(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measurements(docs, rows):
    got = rules.verdicts(docs).collect()
    assert normal((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == normal((r[0], *plain_measures(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_equal_windows_overlap(spark):
    texts = ["a a a a a a a a", "a b c d e a b c d e", "a b c d e f a b c d e", "a b c d e x b c d e f", "a b c d e", "a a a a a a"]
    got = {r.doc_id: r.n_repeat_words for r in rules.verdicts(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == {i: plain_measures(t)[4] for i, t in enumerate(texts)}


def test_filter_keeps_rows_whole(docs, empty):
    kept = rules.filter_documents(docs)
    assert kept.columns == docs.columns
    want = rules.verdicts(docs).filter("kept").count()
    assert kept.count() == want and rules.filter_documents(empty).count() == 0


def test_ablations(docs):
    book = rules.ledger(docs)
    bits = [r.failed_bits for r in book.collect()]
    names = [r.name for r in rules.RULES]
    policies = {p.version: p for p in rules.POLICIES}
    for r in rules.ablations(book).collect():
        mask, bit = policies[r.version].mask, 1 << names.index(r.rule)
        assert r.failing == sum(b & bit != 0 for b in bits)
        assert r.only_this_rule == sum(b & mask == bit for b in bits)
        assert r.rejected == sum(b & mask != 0 for b in bits)
    for p in rules.POLICIES:
        assert rules.apply_policies(book).filter(f"version = '{p.version}' and rejected").count() == sum(b & p.mask != 0 for b in bits)


def test_verdicts_of_every_version(docs, rows):
    book = {(r.doc_id, r.n_words, r.failed_bits) for r in rules.ledger(docs).collect()}
    got = rules.verdicts(docs).collect()
    assert {(r.doc_id, r.n_words, r.failed_bits) for r in got} == book and len(got) == len(rows)
    names = [r.name for r in rules.RULES]
    sole = Counter(r.failed_bits for r in got)
    for r in got:
        for p in rules.POLICIES:
            assert r[rules.kept_column(p)] == (r.failed_bits & p.mask == 0)
        one = r.failed_bits.bit_count() == 1
        assert r.sole_rule == (names[r.failed_bits.bit_length() - 1] if one else None)
        assert r.sole_rule_docs == (sole[r.failed_bits] if one else None)


def test_quality_labels(spark):
    """Clean documents stay and junk goes."""
    book = rules.verdicts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    joined = book.join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    table = {(r.quality, r.kept): r["count"] for r in joined}
    assert table.get((1, False), 0) == 0
    assert table.get((0, True), 0) <= 0.1 * table.get((0, False), 1)


# SimHash


def plain_fingerprint(text):
    w = [x.encode() for x in words(lower(text))]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_near_groups(docs, rows, empty):
    values = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_components(values, 2)
    least = defaultdict(list)
    for r, g in zip(rows, groups):
        if r[0] is not None:
            least[g].append(r[0])
    want = normal((r[0], f"{v:016x}", min(least[g]) if g in least else None) for r, v, g in zip(rows, values, groups))
    assert normal((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()) == want
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    alone = {g for r, g in zip(rows, groups) if r[0] is None and g not in least}
    assert normal(kept.select("doc_id").collect()) == normal([(min(x),) for x in least.values()] + [(None,)] * len(alone))


@pytest.mark.parametrize("tree_rows", [4, 2048])
def test_links_of_hot_shards(spark, tree_rows):
    """Variations of one fingerprint, far more than one tree holds, and chains of small steps."""
    import random

    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    chain = rng.getrandbits(64)
    for b in range(0, 60, 2):
        values.add(chain)
        chain ^= 3 << b
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in component_roots(simhash.shard_links(nodes, simhash.SimHashSpec(tree_rows=tree_rows))).collect()}
    got = [roots.get(s, s) for s in signed]
    want = plain_components(values, 2)
    pairs = lambda x: {(a, b) for a in range(len(x)) for b in range(a) if x[a] == x[b]}
    assert pairs(got) == pairs(want)


def test_tree_search_is_complete():
    import numpy as np

    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    values = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    found = {(n, int(q)) for n, near in simhash.BKTree(values).search(values, 2) for q in near}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000)]
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(201)}) == 1 and 5000 not in got
    assert got[0] != got[1000]


# Stages that drop copies

REPEATS = [
    (5, "same text", 1), (7, "same text", 2), (5, "another text that is unique", 3), (9, "r", 4), (9, "r", 5), (None, "nn", 6), (None, "nn", 7),
    (None, "same text", 8), (11, "Case", 9), (11, "case", 10), (12, None, 11), (12, "", 12),
]


@pytest.mark.parametrize("stage", ["exact_dedup", "simhash_near_dedup"])
def test_copies_go_by_row_and_not_by_id(spark, stage):
    """Repeated and missing ids: no text is lost, of every group of copies one row stays."""
    docs = frame(spark, [(i, t, "en", "a", k) for i, t, k in REPEATS], extra=True)
    kept = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert kept.columns == docs.columns
    same = 7 if stage == "exact_dedup" else 5
    want = [(same, "same text"), (5, "another text that is unique"), (9, "r"), (None, "nn"), (11, "case"), (12, "")]
    assert normal((r.doc_id, lower(r.text)) for r in kept.collect()) == normal(want)


def test_filters_are_built_in_parts(spark, monkeypatch):
    """The number of tasks follows the rows, and parts joined by OR are the filter of all items."""
    import numpy as np

    items = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    halves = lambda batch: (batch.column("key").to_numpy().view(np.uint64), batch.column("key").to_numpy().view(np.uint64) * np.uint64(3))
    assert [bloom.parts_of(n, 8) for n in (0, 10**6, 10**9, 10**12)] == [1, 1, 60, 59605]
    whole = bloom.build(items, halves, 1 << 24, 4)
    monkeypatch.setattr(bloom, "PART_ITEMS", 1500)
    assert bloom.parts_of(20_000, 2) == 7
    assert (bloom.build(items, halves, 1 << 24, 4).bits == whole.bits).all() and whole.bits.any()


# URL lists

URLS = [
    "http://example.org/es/1", "https://a.b.Example.ORG/en/12?q", "http://example.org", "http://example.org/", "http://example.org?x/y",
    "http://notexample.org/en/1", "http://x.com/fr/", "http://x.com/de/2#a", "http://x.com/it", "ftp://org/", "mailto:a@b.org", None, "",
    "://", "x://y://z/", "http://user@example.org:80/es/", "http://com/de/", "http://.org/", "http://org./", "HTTP://EXAMPLE.org/EN/1",
    "http://a.org/\nes/", "http://a.org/es/", "http://a.org/es/",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_verdicts(spark, bound):
    pages = spark.createDataFrame([(i if i != 3 else None, u, "h", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string").repartition(3)
    got = urls.judge(pages, max_filter_bytes=bound).collect()
    assert normal(got) == normal((i if i != 3 else None, *plain_verdict(u)) for i, u in enumerate(URLS))
    assert urls.judge(pages.limit(0), max_filter_bytes=bound).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    import numpy as np

    keys = [f"k{i}" for i in range(3000)]
    first, second = urls.key_hashes(keys)
    universe = spark.createDataFrame([(k, int(a), int(b)) for k, a, b in zip(keys, first.view(np.int64), second.view(np.int64))], "key string, h1 long, h2 long")
    listed = set(keys[::7])
    cascade = urls.build_cascade(universe, spark.createDataFrame([(k,) for k in listed], "key string"))
    assert len(cascade.levels) > 2
    assert cascade.contains(first, second).tolist() == [k in listed for k in keys]


# Mixing


def plain_targets(sizes, weights, share, passes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), share * sum(sizes.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > passes * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = passes * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = plain_targets(sizes, mixing.WEIGHTS, 1.0, 3)
    source = {(r[0], len(words(r[1]))): r[3] for r in rows}
    taken = Counter()
    assert normal((r.doc_id, r.size) for r in got) == normal((r[0], len(words(r[1]))) for r in rows)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        longest = max(len(words(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - targets[s]) <= longest
    assert normal(mixing.mix(docs.repartition(7)).collect()) == normal(got)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r.size for r in got if r.size)


def test_equal_rows_are_taken_one_by_one(spark):
    """A thousand equal rows in each of two sources: as many are taken as the targets ask for."""
    rows = [(1, "one two three", None, "a", None)] * 1000 + [(2, "one two three", None, "b", None)] * 1000
    docs = frame(spark, rows, extra=True)
    for cell_rows in (16, 1024):
        spec = mixing.MixSpec(cell_rows=cell_rows)
        got = mixing.mix(docs, spec)
        by = {r.doc_id: r for r in got.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("rows")).collect()}
        assert all(abs(r.taken - r.target) <= 3 and r.rows == 1000 for r in by.values())
        assert mixing.mixed_documents(docs, spec).count() == sum(r.taken for r in by.values()) // 3


def test_mix_hits_targets_of_real_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"] + 20 for r in by)


def test_choice_in_cells_is_the_choice_in_order(spark):
    rows = [(i, "w " * (1 + i % 2), None, "ab"[i % 3 == 0], None) for i in range(3000)]
    docs = frame(spark, rows)
    one, two = (normal(mixing.mix(docs, mixing.MixSpec(cell_rows=c)).collect()) for c in (16, 1 << 20))
    assert one == two


@pytest.mark.parametrize("seed", range(6))
def test_lengths_reach_the_budget(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 400, 40))
    counts = rng.integers(1, 9, len(lengths))
    budget = int(rng.integers(1, (lengths * counts).sum()))
    for dp_words in (64, 1 << 16):
        taken = mixing.choose_lengths(lengths, counts, budget, dp_words)
        assert (taken >= 0).all() and (taken <= counts).all() and abs(int((taken * lengths).sum()) - budget) <= (2 if dp_words > 64 else lengths.max())


# Exact duplicates


def test_exact_groups(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = []
    for r in rows:
        text = lower(r[1])
        keep = max((x for x in groups[text] if x is not None), default=None)
        want.append((r[0], keep, len(groups[text]), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert normal(chunks.exact_groups(docs).select(columns).collect()) == normal(want)
    # Names of one byte clash at first and are made longer until none does.
    assert normal(chunks.exact_groups(docs, chunks.ChunkSpec(digest_bytes=1)).select(columns).collect()) == normal(want)
    assert chunks.exact_groups(empty).count() == 0
    kept = chunks.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {w[0] for w in want if w[3]} | {None}


def test_chunks_follow_content():
    import random

    rng = random.Random(1)
    spec = chunks.ChunkSpec()
    data = bytes(rng.randrange(97, 123) for _ in range(60000))
    parts = chunks.pieces(data, spec)
    assert b"".join(parts) == data and all(len(p) <= spec.most for p in parts) and all(len(p) >= spec.least for p in parts[:-1])
    moved = chunks.pieces(b"inserted" + data, spec)
    assert len(set(parts) & set(moved)) > len(parts) / 2
    assert chunks.pieces(b"", spec) == [] and chunks.pieces(b"a" * 100000, spec) != []


# Byte-level BPE


def library_ids(text):
    import base64

    import tiktoken

    if not hasattr(library_ids, "encoding"):
        with open(public_tokenizers.path(queries.MULTI), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        library_ids.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return library_ids.encoding.encode_ordinary(text or "")


def test_codec_equals_the_library(docs, rows, empty):
    want = []
    for r in rows:
        ids = library_ids(r[1])
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert normal(queries.bpe_digests(docs).collect()) == normal(want)
    assert queries.bpe_digests(empty).count() == 0
    coded = bpe.encode_documents(docs, public_tokenizers.path(queries.MULTI), PATTERN)
    texts = bpe.decode_documents(coded, public_tokenizers.path(queries.MULTI)).collect()
    assert normal((r.doc_id, r.text) for r in texts) == normal((r[0], r[1] or "") for r in rows)


def test_codec_on_every_character():
    entries = bpe.vocabulary(None, public_tokenizers.path(queries.MULTI))
    codec = bpe.Codec(entries, bpe.model_bytes(entries), PATTERN)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(every), 4096):
        text = " a".join(every[start : start + 4096])
        assert codec.encode(text) == library_ids(text), hex(start)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_codec_on_every_entry():
    entries = bpe.vocabulary(None, public_tokenizers.path(queries.MULTI))
    codec = bpe.Codec(entries, bpe.model_bytes(entries), PATTERN)
    for e in entries:
        text = e.decode(errors="ignore")
        for t in (text, text + text, " " + text + "q"):
            assert codec.encode(t) == library_ids(t)


# Token counts


def test_counts_equal_the_library(docs, rows, empty):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.SINGLE))
    counts = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    want = normal((r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, counts))
    assert normal(queries.token_counts(docs).collect()) == want
    assert queries.token_counts(empty).count() == 0


def test_counts_on_every_character():
    import tokenizers

    path = public_tokenizers.path(queries.SINGLE)
    library = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        data = f.read()
    single = tokencount.single_tokens(data)
    assert len(single) > 40000
    counting = tokencount.Counting(data, single, PATTERN)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(every), 1024):
        text = " a".join(every[start : start + 1024])
        assert list(counting.count([text]))[0] == len(library.encode(text, add_special_tokens=False).ids), hex(start)


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.7 and hit / max(1, sum(r.predicted for r in rows)) > 0.9


def test_toxicity_of_awkward_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (8, None), (None, 1), (9, 0), (10, 0), (19, 1), (777, 1), (15, 7)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert normal((r.doc_id, r.held_out) for r in got) == normal((r[0], r[0] is not None and crc(r[0], 4) == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score(empty, labels).count() == 0


def plain_weights(rows, spec):
    """FTRL-proximal as published, a row and a coordinate at a time: (coordinate, weight) without zeros, and the intercept."""
    z, n = {}, {}
    intercept = 1 << spec.bits

    def weight(i):
        bound = 0.0 if i == intercept else spec.l1
        if abs(z.get(i, 0.0)) <= bound:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * bound) / ((spec.beta + math.sqrt(n[i])) / spec.alpha + spec.l2)

    def coordinates(text):
        cores = [w.strip(toxicity.EDGES) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())]
        hashes = [xxhash.xxh3_64_intdigest(c) for c in cores]
        found = set(hashes) | {xxhash.xxh3_64_intdigest(c[: spec.stem_bytes], seed=1) for c in cores}
        for gap in spec.gaps:
            for left, right in zip(hashes, hashes[gap + 1 :]):
                found.add((int(toxicity.mix(np.array([left], np.uint64))[0]) * 3 + right + gap) % 2**64)
        mixed = [int(toxicity.mix(np.array([h], np.uint64))[0]) >> (64 - spec.bits) for h in found]
        return sorted({*mixed, intercept})

    ordered = sorted(rows, key=lambda r: xxhash.xxh3_64_intdigest(str(r[0])))
    for _ in range(spec.epochs):
        for _, text, label in ordered:
            own = coordinates(text)
            current = {i: weight(i) for i in own}
            gradient = 1 / (1 + math.exp(-sum(current.values()))) - label
            for i in own:
                step = (math.sqrt(n.get(i, 0.0) + gradient**2) - math.sqrt(n.get(i, 0.0))) / spec.alpha
                z[i] = z.get(i, 0.0) + gradient - step * current[i]
                n[i] = n.get(i, 0.0) + gradient**2
    return {i: weight(i) for i in z if i != intercept and weight(i)}, weight(intercept)


def test_weights_against_plain_rules(spark):
    """A small bound of L1 leaves weights on the few rows; some of the words are shared, doubled, or bare punctuation."""
    texts = ["Bad bad word, here", "good morning all", "bad people (here)", "a good word", None, "", "!!! bad", "all good people here", "word"]
    rows = [(i, t, int("bad" in (t or "").lower())) for i, t in enumerate(texts * 4)]
    spec = toxicity.ToxicSpec(bits=12, l1=0.4, epochs=3)
    used = [r for r in rows if crc(r[0], spec.folds) != spec.held_fold]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    at, weight, intercept = toxicity.train(docs, labels, spec)
    expected, base = plain_weights(used, spec)
    got = dict(zip(at.tolist(), weight.tolist()))
    assert set(got) == set(expected) and len(got) > 5 and intercept == pytest.approx(base)
    assert got == pytest.approx(expected)


def test_labels_of_the_held_out_fold_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert normal(toxicity.score(docs, labels).collect()) == normal(toxicity.score(docs.drop("lang", "source"), turned).collect())


# Preference pairs

TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "other"), (1, 3, "assistant", "no"), (1, 4, "assistant", "no"),
    (2, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, None, None), (5, 7, "assistant", None), (5, None, "user", "late"), (5, 7, "assistant", ""),
    (6, 0, "user", "alone"), (None, 0, "user", "lost"), (8, 0, "user", "a"), (8, 1, "assistant", "b"), (9, 0, "user", "a"),
]


def show(*turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, k string").repartition(3)


def test_pairs_of_two_conversations(talks):
    turns = chat.numbered_turns(talks)
    got = {(r.chosen_id, r.rejected_id): r for r in chat.format_pairs(turns, chat.pairs_by_number(turns)).collect()}
    assert set(got) == {(0, 1), (2, 3), (4, 5), (8, 9)}
    first = got[0, 1]
    assert first.shared_turns == 2 and first.prompt == show(("user", "hi"), ("assistant", "good"))
    assert first.chosen == show(("user", "more"), ("assistant", "yes")) and first.chosen_mask == [0, 0, 0, 1]
    assert first.rejected == show(("user", "other"), ("assistant", "no"), ("assistant", "no")) and first.rejected_mask == [0, 0, 0, 1, 1]
    same = got[2, 3]
    assert (same.shared_turns, same.prompt, same.chosen, same.rejected) == (1, show(("user", "q")), "", "")
    apart = got[4, 5]
    assert apart.shared_turns == 0 and apart.prompt == "" and apart.chosen == show(("unknown", ""))
    assert apart.rejected == show(("assistant", ""), ("assistant", ""), ("user", "late"))
    short = got[8, 9]
    assert short.shared_turns == 1 and short.rejected == "" and short.chosen == show(("assistant", "b"))
    by_opening = chat.pairs_by_opening(turns).collect()
    assert normal(by_opening) == [(1, 0), (2, 3), (8, 9)] or normal(by_opening) == [(0, 1), (2, 3), (8, 9)]


def plain_examples(rows):
    """chosen_id to (rejected_id, shared turns, prompt, chosen, rejected, masks)."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is None, turn or 0, role or "unknown", text or ""))
    said = {c: [t[2:] for t in sorted(turns)] for c, turns in said.items()}
    last = {c: max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=None) for c, turns in said.items()}
    out = {}
    for c, own in said.items():
        other = c ^ 1
        learned = lambda turns, start: [int(i >= start and t[0] == "assistant") for i, t in enumerate(turns)]
        if last[c] is None or last.get(other) is None:
            at = len(own) if last[c] is None else last[c]
            out[c] = (None, at, show(*own[:at]), show(*own[at:]), None, learned(own, at), None)
            continue
        bad = [*own[: last[c]], said[other][last[other]]]
        shared = next((i for i, (a, b) in enumerate(zip(own, bad)) if a != b), len(bad))
        out[c] = (other, shared, show(*own[:shared]), show(*own[shared:]), show(*bad[shared:]), learned(own, shared), learned(bad, shared))
    return out


def test_preference_examples(spark, talks):
    big = 2**62
    more = [(big, 0, "user", "u"), (big, 1, "assistant", "a"), (big + 1, 0, "assistant", "b"), (big + 2, 0, "assistant", "c"), (-2, 0, "assistant", "m"), (-1, 0, "assistant", "m")]
    table = talks.unionByName(spark.createDataFrame([(*t, "x") for t in more], talks.schema))
    got = {r.chosen_id: tuple(r)[1:] for r in chat.preference_examples(table).select(
        "chosen_id", "rejected_id", "shared_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask").collect()}
    assert got == plain_examples(TURNS + more)
    assert got[-2][:2] == (-1, 1) and got[big][2] == show(("user", "u")) and got[big + 2][0] is None
    assert chat.preference_examples(table.limit(0)).count() == 0


def test_prompts_are_shared_in_the_given_table(spark, sf_dir):
    got = queries.QUERIES["op8_preference_format"](spark, sf_dir).collect()
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert len(got) == given.select("conv_id").distinct().count()
    assert all(r.prompt_chars > 0 for r in got if r.rejected_id is not None) and any(r.rejected_id is not None for r in got)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_preference_format"])
def test_native_plans_hold_no_python(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# Pipeline


def test_pipeline_against_plain_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in rules.verdicts(docs).filter("kept").collect()}
    latest = {}
    for i in sorted(kept):
        latest[lower(rows[i].text)] = i
    unique = sorted(latest.values())
    groups = plain_components([plain_fingerprint(rows[i].text) for i in unique], 2)
    least = {}
    for i, g in zip(unique, groups):
        least[g] = min(i, least.get(g, i))
    left = sorted(least.values())
    mixed = {r.doc_id: r.taken // r.size for r in mixing.mix(docs.filter(docs.doc_id.isin(left))).collect()}
    want = []
    for i in left:
        ids = library_ids(rows[i].text)
        digest = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[i].text.encode()).hexdigest())
        want += [digest] * mixed[i]
    assert normal(corpus_pipeline.run(spark, sf_dir).collect()) == normal(want)


def test_stages_on_awkward_rows(spark, docs, empty):
    for start in (docs, empty):
        table = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == start.columns
            table = out
        table.count()
