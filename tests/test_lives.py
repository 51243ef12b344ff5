"""The change log of lives: any order of arrival ends with the lives of the batch run."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.operators.lifecycle import entity_changes, entity_lives, pinned_labels
from fleetlens.plans import registry
from fleetlens.sources.catalog import DATE_COLUMN, read_landed, write_landed
from fleetlens.streaming.job import Tracked, start_collecting
from fleetlens.streaming.lives import Entity, current_lives, life_changes, life_log, snapshot_feed, start_lives

from test_streaming import _day, _rows

KEYS = StructType().add("entity", "string").add("part", "integer")
LABELS = StructType().add("role", "string").add("port", "integer")


def plain_lives(shown: dict[int, str]) -> set[tuple]:
    """Lives of one entity over snapshots 0, 1, …: None where it is not there, else its label."""
    times, out, at = sorted(shown), set(), 0
    while at < len(times):
        if shown[times[at]] is None:
            at += 1
            continue
        end = at
        while end + 1 < len(times) and shown[times[end + 1]] is not None:
            end += 1
        done = end + 1 < len(times)
        out.add((times[at], times[end] if done else None, times[end + 1] if done else None, shown[times[at]]))
        at = end + 1
    return out


def _one_order(pick):
    shown = {t * 10: pick.choice([None, "p", "p", "m"]) for t in range(pick.randint(1, 9))}
    order = list(shown)
    pick.shuffle(order)
    entity, spine, log = Entity([], []), [], Counter()
    for at in order:
        before = entity.lives(spine)
        earlier = [t for t in spine if t < at]
        later = [t for t in spine if t > at]
        entity.see(at, max(earlier, default=None), min(later, default=None), shown[at])
        spine = sorted([*spine, at])
        log.subtract(before)
        log.update(entity.lives(spine))
        expected = plain_lives({t: shown[t] for t in spine})
        assert entity.lives(spine) == expected
        assert {k for k, n in log.items() if n} == expected and all(n in (0, 1) for n in log.values())


@pytest.mark.parametrize("seed", range(0, 3000, 1000))
def test_every_order_of_arrival(seed):
    for case in range(seed, seed + 1000):
        _one_order(random.Random(case))


def test_forgetting_changes_no_later_life():
    """Two records of one entity, one of which forgets behind each snapshot; what arrives later is told alike."""
    for seed in range(300):
        pick = random.Random(seed)
        retain, spine = 30, []
        whole, short = Entity([], []), Entity([], [])
        short_spine = []
        for _ in range(40):
            newest = max(spine, default=0)
            at = pick.randint(max(0, newest - retain), newest + 12)
            if at in spine:
                continue
            label = pick.choice([None, "p", "m"])
            changes = []
            for entity, times in ((whole, spine), (short, short_spine)):
                before = entity.lives(times)
                entity.see(at, max((t for t in times if t < at), default=None), min((t for t in times if t > at), default=None), label)
                times.append(at)
                times.sort()
                after = entity.lives(times)
                changes.append((before - after, after - before))
            assert changes[0] == changes[1]
            floor = max((t for t in short_spine if t < short_spine[-1] - retain), default=short_spine[0])
            short_spine = [t for t in short_spine if t >= floor]
            short.forget(floor)
        assert len(short.runs) <= len(whole.runs) and len(short.spans) <= len(whole.spans)


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Each task of keyed state starts a Python worker."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def history(spark):
    """Entities that come, go and change labels, a null key, a repeated row, a row of no listed snapshot, an empty snapshot."""
    pick = random.Random(5)
    rows = [
        (f"c{c}", f"2024-05-{d:02d} 00:00:00", f"e{e}", e % 2, pick.choice("pm"), pick.choice([1, 2, 10, None]))
        for c in range(2) for d in range(1, 9) for e in range(12) if pick.random() < 0.6 and d != 4
    ]
    rows += [("c0", "2024-05-02 00:00:00", None, 1, "p", 1), rows[0], ("c0", "2024-06-01 00:00:00", "e1", 1, "p", 1), (None, "2024-05-02 00:00:00", "e1", 1, "p", 1)]
    entities = spark.createDataFrame(rows, "cluster string, snapshot_ts string, entity string, part int, role string, port int")
    snapshots = spark.createDataFrame([(f"c{c}", f"2024-05-{d:02d} 00:00:00") for c in range(2) for d in range(1, 9)], "cluster string, snapshot_ts string")
    at = F.col("snapshot_ts").cast("timestamp")
    return entities.withColumn("snapshot_ts", at), snapshots.withColumn("snapshot_ts", at)


@pytest.mark.parametrize("order", [(3, 7, 1, 8, 2, 4, 6, 5), (8, 7, 6, 5, 4, 3, 2, 1)])
def test_log_of_a_stream_equals_batch(spark, history, tmp_path, order):
    """A file a day in a disturbed order, one of them twice, over two runs that share state."""
    entities, snapshots = history
    feed, out, home = (str(tmp_path / n) for n in ("feed", "out", "home"))
    keys, labels = KEYS.names, LABELS.names

    def run():
        start_lives(spark, feed, out, home, KEYS, LABELS, interval=None, max_files_per_trigger=3).awaitTermination(300)

    for part in (order[:4], (*order[4:], order[0])):
        for day in part:
            told = snapshot_feed(entities, keys, labels, snapshots.filter(F.dayofmonth("snapshot_ts") == day), 3)
            told.coalesce(1).write.mode("append").parquet(feed)
        run()
    log = spark.read.parquet(out)
    lives = current_lives(log)
    expected = entity_lives(entities.dropna(subset=["cluster"]), keys, labels, snapshots)
    assert _rows(lives) == _rows(expected)
    assert log.filter("sign = -1").count() > 0
    known = entities.dropna(subset=["cluster", "entity"])
    changes = life_changes(lives, keys, labels, snapshots)
    assert _rows(changes.drop(*labels)) == _rows(entity_changes(known, keys, snapshots))
    pinned = pinned_labels(known, keys, labels, snapshots=snapshots).distinct()
    assert _rows(changes.filter("change <> 'deleted'").drop("change")) == _rows(pinned)


def test_state_written_is_that_of_what_changed(spark, history, tmp_path):
    """A second snapshot of one cluster that shows the same entities writes the times of its three buckets and nothing else."""
    entities, snapshots = history
    feed, out, home = (str(tmp_path / n) for n in ("feed", "out", "home"))
    first = snapshots.filter(F.dayofmonth("snapshot_ts") == 1)
    told = snapshot_feed(entities, KEYS.names, LABELS.names, first, 3)
    again = told.filter("cluster = 'c0'").withColumn("at", F.col("at") + 1)
    written = []
    for part in (told, again):
        part.coalesce(1).write.mode("append").parquet(feed)
        query = start_lives(spark, feed, out, home, KEYS, LABELS, interval=None)
        query.awaitTermination(300)
        busy = [p for p in query.recentProgress if p["numInputRows"]]
        written.append((busy[0]["numInputRows"], busy[0]["stateOperators"][0]["numRowsUpdated"]))
    assert written[0][0] == 6 and written[0][1] > 6
    assert written[1] == (3, 3)


def test_too_late_and_empty(spark, history):
    entities, snapshots = history
    feed = snapshot_feed(entities, KEYS.names, [], snapshots.filter("cluster = 'c0'"), 1)
    log = life_log(feed.orderBy(F.desc("at")).coalesce(1), KEYS, StructType([]), retain_seconds=2 * 86400)
    got = [(r.sign, r.from_ts) for r in log.collect()]
    assert {s for s, _ in got} <= {0, 1} and all((s == 0) == (t.day < 6) for s, t in got)
    nothing = life_log(feed.limit(0), KEYS, StructType([]))
    assert nothing.collect() == [] and current_lives(nothing).columns == ["cluster", "entity", "part", "from_ts", "until_ts", "gone_ts"]
    bare = snapshot_feed(entities.limit(0), KEYS.names, [], snapshots, 4)
    assert bare.count() == 16 * 4 and life_log(bare, KEYS, StructType([])).collect() == []


def test_late_snapshot_corrects_lives_of_the_job(spark, tmp_path):
    """The collecting job feeds the log; a snapshot that lands after a later one is told in it."""
    root, out, home = (str(tmp_path / n) for n in ("landing", "out", "home"))
    spec = next(s for s in registry.COLLECTORS if s.name == "segment_health")
    for day in (2, 4, 3, 5):
        for name, df in _day(spark, day).items():
            write_landed(df, root, name)
        start_collecting(
            spark, root, out, name="corrected", specs=(spec,), tracked=(Tracked(spec, ("role",)),), interval=None, home=home, feed_buckets=4
        ).awaitTermination(300)
    tables = {n: read_landed(spark, root, n).drop(DATE_COLUMN) for n in ("segment_config", "snapshots")}
    entities = spec.transform(tables)
    rows = entities.schema
    keys, labels = StructType([rows[k] for k in spec.keys]), StructType([rows["role"]])
    start_lives(spark, f"{out}/feed/segment_health", str(tmp_path / "log"), str(tmp_path / "lives"), keys, labels, interval=None).awaitTermination(300)
    lives = current_lives(spark.read.parquet(str(tmp_path / "log")))
    assert _rows(lives) == _rows(entity_lives(entities, list(spec.keys), ["role"], tables["snapshots"]))
    changes = life_changes(lives, list(spec.keys), ["role"], tables["snapshots"]).drop("role")
    assert _rows(changes) == _rows(entity_changes(entities, list(spec.keys), tables["snapshots"]))
