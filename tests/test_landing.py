"""Landing a snapshot from readers, then collecting it."""

import datetime as dt

import pytest

from fleetlens.plans.collect import collect_samples
from fleetlens.plans.registry import selected_specs
from fleetlens.schemas import table_schema
from fleetlens.sources.catalog import DATE_COLUMN, read_landed
from fleetlens.sources.landing import BACKUP_SQL, DATABASE_SQL, conform, land_snapshot, landing_sql

NOW = dt.datetime(2024, 5, 1, 12)


def names(sql):
    first = sql.split(" UNION ALL ")[0]
    listed = first[len("SELECT "):first.index(" FROM ")]
    return [c.split(" AS ")[-1].split(".")[-1].rstrip(")") if " AS " in c else c.split(".")[-1] for c in listed.split(", ")]


@pytest.mark.parametrize("major", [6, 7])
def test_statements_fill_the_schemas(spark, major):
    for table, sql in {**landing_sql(major), **DATABASE_SQL, **BACKUP_SQL}.items():
        expected = {f.name for f in table_schema(table)} - {"cluster", "snapshot_ts"}
        assert set(names(sql)) == expected - ({"datname"} if table in DATABASE_SQL else set()), table


def test_conform_adds_missing_columns(spark):
    row = conform(spark.range(1).selectExpr("id AS oid", "'x' AS rsgname"), "resgroup", "c", NOW).first()
    assert tuple(row) == ("c", NOW, 0, "x")
    assert conform(spark.range(1), "resgroup", "c", NOW).first().rsgname is None


def test_land_and_collect(spark, tmp_path):
    def base(sql):
        if "gp_segment_configuration" in sql:
            return spark.createDataFrame([(1, -1, "p", "p", "s", "u", 5, "h", "h", "/d")], "dbid int, content int, role string, preferred_role string, mode string, status string, port int, hostname string, address string, datadir string")
        assert "pg_stat_activity" in sql
        return spark.createDataFrame([(6, i == 0, i, "idle") for i in range(3)], "major int, own_backend boolean, pid int, state string")

    def good(sql):
        return spark.createDataFrame([("public", "t", "r", 900, 300)], "nspname string, relname string, relkind string, n_live_tup int, n_dead_tup int")

    def bad(sql):
        raise OSError("unreachable")

    wanted = ["segment_config", "activity", "table_stats"]
    land_snapshot(spark, str(tmp_path), "c", NOW, 6, base, {"a": good, "b": bad}, tables=wanted)
    errors = read_landed(spark, str(tmp_path), "read_errors").drop(DATE_COLUMN).collect()
    assert [tuple(r) for r in errors] == [("c", NOW, "table_stats", "b", "unreachable")]
    tables = {t: read_landed(spark, str(tmp_path), t).drop(DATE_COLUMN) for t in [*wanted, "snapshots"]}
    specs = [s for s in selected_specs() if set(s.inputs) <= set(wanted)]
    values = {(r.metric, tuple(sorted(r.labels.items()))): r.value for r in collect_samples(tables, specs).collect()}
    assert values[("fleet_cluster_connections_total", (("state", "idle"),))] == 2.0
    assert values[("fleet_database_table_dead_tuple_ratio", (("database", "a"), ("schema", "public"), ("table", "t")))] == 0.25
    assert values[("fleet_cluster_segments_up", ())] == 1.0
