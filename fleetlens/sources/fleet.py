"""Landing a whole fleet: one job per table reads all clusters, and what could not be read is data too.

Each place to read (a cluster, or one database of a cluster) is a partition of its own, so clusters are read by all executors at
once and a lost executor costs only the places it was reading. Nothing that was read passes through the driver; it knows the list of
places alone, which is as long as the fleet and not as its tables.

Connections follow Python's database interface (PEP 249): ``connect`` takes a place and returns a connection. It runs inside the
tasks and finds its own credentials there, so none are part of a plan.
"""

from __future__ import annotations

import datetime as dt
import logging
import sqlite3
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.functions.scope import SCOPE
from fleetlens.operators.databases import database_filter
from fleetlens.schemas import table_schema
from fleetlens.session import shared_dir
from fleetlens.sources.catalog import write_landed
from fleetlens.sources.landing import BACKUP_SQL, DATABASE_SQL, landing_sql

log = logging.getLogger(__name__)

ERROR = "_error"
FETCH_ROWS = 4096
MAX_FILE_BYTES = 256 << 20


@dataclass(frozen=True)
class Place:
    """Where to read: a cluster with its server version, and the database to connect to (None: its base database)."""

    cluster: str
    major: int
    address: str = ""
    datname: str | None = None


Connect = Callable[[Place], object]


def _with_error(table: str) -> T.StructType:
    return table_schema(table).add(ERROR, "string")


def _conformed(names: list[str], rows: list[tuple], fixed: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a statement in ``schema``; columns it does not have are null."""
    columns = dict(zip(names, zip(*rows))) if rows else {}
    arrays = []
    for field in schema:
        values = [fixed[field.name]] * len(rows) if field.name in fixed else list(columns.get(field.name, [None] * len(rows)))
        arrays.append(pa.array(values).cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def read_place(connection: object, sql: str, fixed: dict[str, object], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What one statement returns, a batch at a time: no more than ``FETCH_ROWS`` rows are held."""
    with closing(connection.cursor()) as cursor:
        cursor.execute(sql)
        names = [c[0].lower() for c in cursor.description]
        while rows := cursor.fetchmany(FETCH_ROWS):
            yield _conformed(names, rows, fixed, schema)


def _error_row(error: Exception, fixed: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    text = f"{type(error).__name__}: {error}"
    return _conformed([], [()], {**fixed, ERROR: text}, schema)


def fleet_source(table: str, places: Iterable[Place], connect: Connect, snapshot_ts: dt.datetime) -> type[DataSource]:
    """A data source over ``table`` of all ``places``: the landed columns and ``_error``.

    A place that fails has a row with its error and no values; rows that came before the failure stay and are for the caller to leave
    out (:func:`land_fleet` does).
    """
    chosen = tuple(places)
    ddl = _with_error(table)
    when = snapshot_ts if snapshot_ts.tzinfo else snapshot_ts.replace(tzinfo=dt.timezone.utc)
    inside = table in DATABASE_SQL

    def statement(place: Place) -> str:
        if not inside:
            return landing_sql(place.major)[table]
        return DATABASE_SQL[table].replace("SELECT ", "SELECT current_database() AS datname, ", 1)

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            # One partition at least, also for a fleet without places.
            return [InputPartition(p) for p in chosen] or [InputPartition(None)]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            place = partition.value
            if place is None:
                return
            arrow = to_arrow_schema(ddl)
            fixed: dict[str, object] = {"cluster": place.cluster, "snapshot_ts": when}
            if inside and place.datname is not None:
                fixed["datname"] = place.datname
            try:
                with closing(connect(place)) as connection:
                    yield from read_place(connection, statement(place), fixed, arrow)
            except Exception as error:  # any fault of a cluster is a finding, not the end of the job
                yield _error_row(error, fixed, arrow)

    class Fleet(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"fleet_{table}"

        def schema(self) -> T.StructType:
            return ddl

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    return Fleet


def read_fleet(spark: SparkSession, table: str, places: Iterable[Place], connect: Connect, snapshot_ts: dt.datetime) -> DataFrame:
    source = fleet_source(table, places, connect, snapshot_ts)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


def split_errors(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the places that were read to their end, and the ``read_errors`` of the others.

    A place is known by cluster and, in tables that have it, database. Read ``rows`` from a written table: they are used twice.
    """
    keys = ["cluster", *(["datname"] if table in DATABASE_SQL else [])]
    failed = rows.filter(F.col(ERROR).isNotNull())
    bad = failed.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    good = rows.filter(F.col(ERROR).isNull()).join(bad, same, "left_anti").drop(ERROR)
    name = F.col("datname") if "datname" in keys else F.lit(None).cast("string")
    errors = failed.select(*SCOPE, F.lit(table).alias("source_table"), name.alias("datname"), F.col(ERROR).alias("error"))
    return good, errors


def database_places(spark: SparkSession, places: Iterable[Place], databases: DataFrame) -> list[Place]:
    """A place per allowed database (cluster, datname) of the given clusters."""
    names = {c: [r["datname"] for r in rows] for c, rows in groupby(databases.select("cluster", "datname").orderBy("cluster", "datname").collect(), lambda r: r["cluster"])}
    return [replace(p, datname=name) for p in places for name in names.get(p.cluster, [])]


def land_fleet(
    spark: SparkSession,
    root: str,
    snapshot_ts: dt.datetime,
    places: Iterable[Place],
    connect: Connect,
    tables: Iterable[str] | None = None,
    mode: str = "all",
    names: DataFrame | Iterable[str] | None = None,
    stage: str | None = None,
) -> None:
    """Land one snapshot of a fleet, a read and a write per table, its manifest last.

    ``mode`` and ``names`` choose the databases that per-database tables are read from, out of each cluster's ``pg_database``; with
    ``none`` the base database stands for all. What fails is left out whole and leaves a row in ``read_errors``. A cluster of which a
    table other than the per-database ones could not be read gets a manifest row that is not ``ok``, so that its entities are carried
    from its last good snapshot and not taken to be gone. Every landed row comes from one written read: a task that runs again while the
    cluster moves on changes nothing that was landed. That read lies under ``stage``, by default in the shared folder; the next landing
    writes over it, so landings that run at once need a ``stage`` each.
    """
    places = tuple(places)
    if len({p.cluster for p in places}) < len(places):
        raise ValueError("a cluster is listed twice")
    wanted = [t for t in (*landing_sql(7), *DATABASE_SQL) if tables is None or t in set(tables)]
    by_database = [t for t in wanted if t in DATABASE_SQL]
    stage = stage or f"{shared_dir(spark)}/landing"
    when = snapshot_ts if snapshot_ts.tzinfo else snapshot_ts.replace(tzinfo=dt.timezone.utc)

    def staged(table: str, where: Iterable[Place]) -> DataFrame:
        read_fleet(spark, table, where, connect, snapshot_ts).write.mode("overwrite").parquet(f"{stage}/{table}")
        return spark.read.schema(_with_error(table)).parquet(f"{stage}/{table}")

    errors: list[DataFrame] = []
    frames: dict[str, DataFrame] = {}
    needed = ["pg_database"] if by_database and mode != "none" and "pg_database" not in wanted else []
    for table in [*needed, *(t for t in wanted if t not in by_database)]:
        frames[table], failed = split_errors(staged(table, places), table)
        errors.append(failed)
        if table in wanted:
            write_landed(frames[table], root, table)
    down = [e.filter(F.col("datname").isNull()) for e in errors]
    inner = places
    if by_database and mode != "none":
        listed = names if names is None or isinstance(names, DataFrame) else list(names)
        inner = database_places(spark, places, database_filter({"pg_database": frames["pg_database"]}, mode, listed))
    for table in by_database:
        good, failed = split_errors(staged(table, inner), table)
        errors.append(failed)
        write_landed(good, root, table)
    found = errors[0] if errors else spark.createDataFrame([], table_schema("read_errors"))
    for more in errors[1:]:
        found = found.unionByName(more)
    write_landed(found, root, "read_errors")
    failed_clusters = down[0] if down else found
    for more in down[1:]:
        failed_clusters = failed_clusters.unionByName(more)
    listing = spark.createDataFrame([(p.cluster, when) for p in places], "cluster string, snapshot_ts timestamp")
    bad = failed_clusters.select("cluster").distinct().withColumn("_bad", F.lit(True))
    manifest = listing.join(bad, "cluster", "left").select(*SCOPE, F.col("_bad").isNull().alias("ok"))
    write_landed(manifest, root, "snapshots")


def read_backup_files(
    spark: SparkSession, path: str, snapshot_ts: dt.datetime, cluster: Column | None = None, max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """Backup histories of many clusters, an SQLite file each: the landed ``backups`` columns and ``_error``.

    Spark's own reader fetches the files, so they may lie in any store; each is opened in the memory of its task. ``cluster`` names the
    cluster by the file's ``path`` (by default its folder). A file that is broken, or above ``max_bytes``, gives one row with the error
    and no others. What a write-ahead log beside the file holds is not seen.
    """
    ddl = _with_error("backups")
    when = snapshot_ts if snapshot_ts.tzinfo else snapshot_ts.replace(tzinfo=dt.timezone.utc)
    owner = F.element_at(F.split("path", "/"), -2) if cluster is None else cluster
    files = spark.read.format("binaryFile").load(path)
    small = F.when(F.col("length") <= max_bytes, F.col("content"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(ddl)
        for batch in batches:
            for name, content in zip(batch.column("cluster"), batch.column("content")):
                fixed = {"cluster": name.as_py(), "snapshot_ts": when}
                try:
                    if not content.is_valid:
                        raise ValueError(f"larger than {max_bytes} bytes")
                    # Bytes 18 and 19 say that a log belongs to the file; in memory there is none.
                    image = bytearray(content.as_py())
                    image[18:20] = b"\x01\x01"
                    with closing(sqlite3.connect(":memory:")) as history:
                        history.deserialize(bytes(image))
                        whole = list(read_place(history, BACKUP_SQL["backups"], fixed, arrow))
                    yield from whole
                except Exception as error:  # as for clusters: a broken file is a finding
                    yield _error_row(error, fixed, arrow)

    return files.select(owner.alias("cluster"), small.alias("content")).mapInArrow(rows, ddl)
