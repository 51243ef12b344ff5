"""Landing a fleet: a job per table over all clusters, faults as rows, backup files."""

import datetime as dt
import sqlite3

import pytest

from fleetlens.plans.collect import collect_samples
from fleetlens.plans.registry import selected_specs
from fleetlens.sources.catalog import DATE_COLUMN, read_landed
from fleetlens.sources.fleet import ERROR, Place, land_fleet, read_backup_files, read_fleet, split_errors

NOW = dt.datetime(2024, 5, 1, 12)
CLUSTERS = 100


def connect_fake(down=(), dead_databases=(), late=()):
    """A connection that answers catalog statements of one cluster; those of ``late`` fail after their first rows."""

    class Cursor:
        def __init__(self, place):
            self.place = place

        def close(self):
            pass

        def execute(self, sql):
            number = int(self.place.cluster[1:])
            if "gp_segment_configuration" in sql:
                self.names = "dbid content role preferred_role mode status port hostname address datadir".split()
                self.rows = [(i, i - 1, "p", "p", "s", "u" if i < 4 else "d", 5, f"h{i}", "a", "/d") for i in range(5)]
            elif "pg_stat_activity" in sql:
                self.names = ["MAJOR", "own_backend", "pid", "state"]
                self.rows = [(self.place.major, i == 0, i, "idle") for i in range(number % 4 + 1)]
            elif "pg_database" in sql:
                self.names = "oid datname datallowconn datistemplate".split()
                self.rows = [(1, "a", True, False), (2, "b", True, False), (3, "t", True, True)]
            else:
                assert "pg_stat_all_tables" in sql and "current_database()" in sql
                self.names = "datname nspname relname relkind n_live_tup n_dead_tup last_vacuum".split()
                self.rows = [(self.place.datname or "base", "public", "t", "r", 900, 100 * number, dt.datetime(2024, 4, 30))]
            self.description = [(n,) for n in self.names]
            self.at = 0

        def fetchmany(self, size):
            if self.at and self.place.cluster in late:
                raise OSError("connection lost")
            got, self.at = self.rows[self.at : self.at + 2], self.at + 2
            return got

    class Connection:
        def __init__(self, place):
            self.place = place

        def cursor(self):
            return Cursor(self.place)

        def close(self):
            pass

    def connect(place):
        if place.cluster in down or (place.cluster, place.datname) in dead_databases:
            raise ConnectionError(f"{place.cluster} unreachable")
        return Connection(place)

    return connect


PLACES = [Place(f"c{i}", 6 + i % 2) for i in range(CLUSTERS)]
WANTED = ["segment_config", "activity", "pg_database", "table_stats"]


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("fleet"))
    land_fleet(spark, root, NOW, PLACES, connect_fake({"c7"}, {("c9", "b")}, {"c11"}), tables=WANTED)
    return {t: read_landed(spark, root, t).drop(DATE_COLUMN) for t in [*WANTED, "read_errors", "snapshots"]}


def test_one_partition_per_cluster(spark):
    rows = read_fleet(spark, "segment_config", PLACES, connect_fake(), NOW)
    assert rows.rdd.getNumPartitions() == CLUSTERS and rows.count() == 5 * CLUSTERS
    assert rows.filter(f"{ERROR} is not null").count() == 0
    assert read_fleet(spark, "segment_config", [], connect_fake(), NOW).count() == 0


def test_a_fleet_lands_but_for_what_failed(landed):
    segments = {(r["cluster"], r["count"]) for r in landed["segment_config"].groupBy("cluster").count().collect()}
    assert segments == {(f"c{i}", 5) for i in range(CLUSTERS) if i not in (7, 11)}
    assert landed["segment_config"].select("snapshot_ts").distinct().first()[0] == NOW
    stats = {(r.cluster, r.datname): r.n_dead_tup for r in landed["table_stats"].collect()}
    assert len(stats) == 2 * (CLUSTERS - 2) - 1 and ("c9", "b") not in stats and stats["c9", "a"] == 900


def test_faults_are_rows(landed):
    errors = sorted((r.cluster, r.source_table, r.datname, r.error) for r in landed["read_errors"].filter("cluster <> 'c11'").collect())
    down = "ConnectionError: c7 unreachable"
    assert errors == [("c7", t, None, down) for t in ("activity", "pg_database", "segment_config")] + [("c9", "table_stats", "b", "ConnectionError: c9 unreachable")]
    lost = {r.source_table for r in landed["read_errors"].filter("cluster = 'c11'").collect()}
    assert lost == {"activity", "pg_database", "segment_config"}
    manifest = {r.cluster: r.ok for r in landed["snapshots"].collect()}
    assert manifest == {f"c{i}": i not in (7, 11) for i in range(CLUSTERS)}


def test_landed_fleet_is_collected(landed):
    tables = {t: landed[t] for t in WANTED} | {"snapshots": landed["snapshots"].filter("ok")}
    specs = [s for s in selected_specs() if set(s.inputs) <= set(tables)]
    samples = collect_samples(tables, specs)
    up = {r.cluster: r.value for r in samples.filter("metric = 'fleet_cluster_segments_up'").collect()}
    assert up == {f"c{i}": 4.0 for i in range(CLUSTERS) if i not in (7, 11)}


def test_rows_before_a_failure_do_not_count(spark):
    rows = read_fleet(spark, "segment_config", PLACES[:3], connect_fake(late={"c1"}), NOW)
    assert {(r["cluster"], r["count"]) for r in rows.groupBy("cluster").count().collect()} == {("c0", 5), ("c1", 3), ("c2", 5)}
    good, errors = split_errors(rows, "segment_config")
    assert {r.cluster for r in good.collect()} == {"c0", "c2"}
    assert [(r.cluster, r.error) for r in errors.collect()] == [("c1", "OSError: connection lost")]


def test_base_database_stands_for_all(spark, tmp_path):
    land_fleet(spark, str(tmp_path), NOW, PLACES[:2], connect_fake(), tables=["table_stats"], mode="none")
    got = read_landed(spark, str(tmp_path), "table_stats").collect()
    assert {(r.cluster, r.datname) for r in got} == {("c0", "base"), ("c1", "base")}
    with pytest.raises(ValueError):
        land_fleet(spark, str(tmp_path), NOW, [PLACES[0], PLACES[0]], connect_fake())


def test_backup_files(spark, tmp_path):
    for name in ("c1", "c2"):
        (tmp_path / name).mkdir()
        with sqlite3.connect(tmp_path / name / "history.db") as db:
            if name == "c2":
                db.execute("PRAGMA journal_mode=WAL")
            db.execute("CREATE TABLE backups (database_name text, incremental int, status text, timestamp text, end_time text)")
            db.executemany("INSERT INTO backups VALUES (?, 0, 'Success', '20240501120000', '20240501130000')", [("d",), (None,)])
        db.close()
    (tmp_path / "c3").mkdir()
    (tmp_path / "c3" / "history.db").write_bytes(b"no database" * 50)
    rows = read_backup_files(spark, f"{tmp_path}/*/history.db", NOW)
    good, errors = split_errors(rows, "backups")
    got = sorted((r.cluster, r.backup_id, r.database_name or "", r.incremental, r.snapshot_ts) for r in good.collect())
    assert got == [(c, i, "" if i == 2 else "d", 0, NOW) for c in ("c1", "c2") for i in (1, 2)]
    assert [(r.cluster, r.source_table) for r in errors.collect()] == [("c3", "backups")]
    big = read_backup_files(spark, f"{tmp_path}/c1/history.db", NOW, max_bytes=10).collect()
    assert [(r.cluster, r[ERROR]) for r in big] == [("c1", "ValueError: larger than 10 bytes")]
