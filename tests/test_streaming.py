"""The streaming job gives what the batch transforms give, whatever the batches look like."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.lifecycle import entity_changes, pinned_labels
from fleetlens.plans import registry
from fleetlens.plans.collect import collect_samples
from fleetlens.sources.catalog import DATE_COLUMN, read_landed, write_landed
from fleetlens.streaming.job import LostState, Tracked, collect_batch, snapshot_tables, start_collecting, stream_samples

SPECS = {s.name: s for s in registry.COLLECTORS}
CHOSEN = tuple(SPECS[n] for n in ("segment_health", "segment_counts", "connections_by_state", "connections_total", "vacuum_running_flag"))
TRACKED = (Tracked(SPECS["segment_health"], ("role",)),)


def _day(spark, day: int) -> dict[str, DataFrame]:
    """Two clusters; segments come, go and switch roles; every third day has no sessions."""
    ts = f"2024-03-{day:02d} 00:00:00"
    present = [d for d in range(6) if (d + day) % 4 != 0]
    segments = [
        ("c%d" % c, d, d // 2 - 1, "p" if (d + day) % 3 else "m", "p", "s", "u", 6000 + d, f"h{d % 3}", "a", "/data")
        for c in range(2)
        for d in present
    ]
    sessions = [] if day % 3 == 0 else [
        (f"c{c}", 6 + c, p == 0, p, ["active", "idle", None][p % 3], "VACUUM" if p == 4 else "select", "client backend")
        for c in range(2)
        for p in range(5 + day % 2)
    ]
    at = F.lit(ts).cast("timestamp").alias("snapshot_ts")
    segment_rows = spark.createDataFrame(
        segments,
        "cluster string, dbid bigint, content int, role string, preferred_role string, mode string, status string, "
        "port int, hostname string, address string, datadir string",
    )
    session_rows = spark.createDataFrame(
        sessions, "cluster string, major int, own_backend boolean, pid bigint, state string, query string, backend_type string"
    )
    return {
        "segment_config": segment_rows.select("cluster", at, *segment_rows.columns[1:]),
        "activity": session_rows.select("cluster", at, *session_rows.columns[1:]),
        "snapshots": spark.range(2).select(F.concat(F.lit("c"), F.col("id")).alias("cluster"), at, F.lit(True).alias("ok")),
    }


def _rows(df: DataFrame):
    return sorted(tuple(map(repr, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("landing"))
    # Files land day by day; the manifest of a day lands last.
    for day in range(1, 6):
        for name, df in _day(spark, day).items():
            write_landed(df, root, name)
    return root


@pytest.mark.parametrize("files", [1, None])
def test_micro_batches_equal_batch(spark, landing, tmp_path, files):
    out = str(tmp_path / "out")
    query = start_collecting(
        spark, landing, out, name=f"job{files}", specs=CHOSEN, tracked=TRACKED, interval=None, max_files_per_trigger=files,
        home=str(tmp_path / "home"),
    )
    query.awaitTermination(240)

    tables = {n: read_landed(spark, landing, n).drop(DATE_COLUMN) for n in ("segment_config", "activity", "snapshots")}
    expected = collect_samples(tables, CHOSEN)
    columns = ["cluster", "ts", "metric", F.to_json("labels").alias("labels"), "value"]
    samples = spark.read.parquet(f"{out}/samples")
    assert _rows(samples.select(*columns)) == _rows(expected.select(*columns))

    entities = SPECS["segment_health"].transform(tables)
    keys = list(SPECS["segment_health"].keys)
    changes = spark.read.parquet(f"{out}/changes/segment_health").drop("batch")
    assert _rows(changes) == _rows(entity_changes(entities, keys, tables["snapshots"]))
    pinned = spark.read.parquet(f"{out}/pinned/segment_health").drop("batch")
    assert _rows(pinned) == _rows(pinned_labels(entities, keys, ["role"], snapshots=tables["snapshots"]))


def test_late_snapshot_gives_samples_and_restart_resumes(spark, tmp_path):
    root, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def land(day):
        for name, df in _day(spark, day).items():
            write_landed(df, root, name)

    def run():
        start_collecting(spark, root, out, name="late", specs=CHOSEN[:2], tracked=TRACKED, interval=None, home=str(tmp_path / "home")).awaitTermination(240)

    for day in (2, 4):
        land(day)
        run()
    land(3)
    run()
    land(5)
    run()
    days = [r[0].day for r in spark.read.parquet(f"{out}/samples").select("ts").distinct().orderBy("ts").collect()]
    assert days == [2, 3, 4, 5]  # the life cycle below goes without the late one
    tables = reduce(DataFrame.unionByName, [_day(spark, d)["segment_config"] for d in (2, 4, 5)])
    entities = SPECS["segment_health"].transform({"segment_config": tables})
    changes = spark.read.parquet(f"{out}/changes/segment_health").drop("batch")
    assert _rows(changes) == _rows(entity_changes(entities, list(SPECS["segment_health"].keys)))


def test_single_table_collector_as_stream(spark, landing, tmp_path):
    frame = stream_samples(spark, landing, SPECS["segment_counts"])
    query = (
        frame.writeStream.format("memory").queryName("segment_counts_stream").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    got = spark.table("segment_counts_stream")
    tables = {"segment_config": read_landed(spark, landing, "segment_config").drop(DATE_COLUMN)}
    expected = collect_samples(tables, [SPECS["segment_counts"]])
    # The newest snapshot stays open until a later one moves the watermark.
    newest = expected.agg(F.max("ts")).first()[0]
    columns = ["cluster", "ts", "metric", "value"]
    assert _rows(got.select(*columns)) == _rows(expected.filter(F.col("ts") < newest).select(*columns))


def test_collector_joins_a_running_job(spark, tmp_path):
    root, out = str(tmp_path / "landing"), str(tmp_path / "out")
    more = (*TRACKED, Tracked(SPECS["connections_by_state"]))
    for day, tracked in ((1, TRACKED), (2, more)):
        for name, df in _day(spark, day).items():
            write_landed(df, root, name)
        start_collecting(
            spark, root, out, name="joined", specs=CHOSEN, tracked=tracked, interval=None, home=str(tmp_path / "home")
        ).awaitTermination(240)
    changes = spark.read.parquet(f"{out}/changes/connections_by_state")
    assert {r.snapshot_ts.day for r in changes.collect()} == {2}


def test_batch_reads_only_the_times_it_needs(spark, landing):
    days = [_day(spark, k)["snapshots"].filter("cluster = 'c0'").drop("ok") for k in (2, 3)]
    rows = snapshot_tables(spark, landing, ["segment_config"], days[0].unionByName(days[1]))["segment_config"]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = rows._jdf.queryExecution().explainString(mode)
    assert "GreaterThanOrEqual(snapshot_ts,2024-03-02" in plan and "LessThanOrEqual(snapshot_ts,2024-03-03" in plan
    assert {r.snapshot_ts.day for r in rows.collect()} == {2, 3}


@pytest.mark.parametrize("files", [4, None])
def test_history_samples_equal_batch(spark, landing, tmp_path, files):
    """Pinned labels, NaN and 0 of gone entities of real collectors, over batches as over the whole history."""
    out = str(tmp_path / "out")
    followed = (Tracked(SPECS["segment_health"], ("content", "preferred_role", "role", "port")), Tracked(SPECS["connections_by_state"]))
    start_collecting(
        spark, landing, out, name=f"history{files}", specs=CHOSEN, tracked=followed, interval=None, max_files_per_trigger=files,
        home=str(tmp_path / "home"), history=True,
    ).awaitTermination(400)
    tables = {n: read_landed(spark, landing, n).drop(DATE_COLUMN) for n in ("segment_config", "activity", "snapshots")}
    expected = collect_samples(tables, CHOSEN, history=True)
    columns = ["cluster", "ts", "metric", F.to_json("labels").alias("labels"), "value"]
    got = _rows(spark.read.parquet(f"{out}/samples").select(*columns))
    assert got == _rows(expected.select(*columns))
    assert any("nan" in r for r in got)


def test_lost_state_is_no_empty_state(spark, landing, tmp_path):
    manifest = _day(spark, 2)["snapshots"]
    run = lambda k: collect_batch(spark, manifest, k, landing, str(tmp_path / "out"), str(tmp_path / "state"), CHOSEN[:2], TRACKED)
    with pytest.raises(LostState):
        run(5)
    run(0)
    run(1)
    with pytest.raises(LostState):
        run(3)
