"""Sources: landed snapshots, catalog views over JDBC, disk-usage text; sinks: sample table and text lines."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.plans.samples import MetricSpec, exposition_lines, exposition_text
from fleetlens.schemas import table_schema

log = logging.getLogger(__name__)

# Landed tables are laid out as <root>/<table>/snapshot_date=<day>/…parquet, so a time range prunes folders.
DATE_COLUMN = "snapshot_date"


def read_landed(spark: SparkSession, root: str, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A landed table with its fixed schema (nothing is inferred), optionally for the days ``start`` to ``end``."""
    schema = table_schema(table).add(DATE_COLUMN, "date")
    df = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{table}")
    if start is not None:
        df = df.filter(F.col(DATE_COLUMN) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(DATE_COLUMN) <= F.lit(end).cast("date"))
    return df


def write_landed(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Land snapshots, one folder per day; rows of a day are spread by cluster and size, not sent to one writer."""
    dated = df.withColumn(DATE_COLUMN, F.to_date("snapshot_ts"))
    dated.hint("rebalance", DATE_COLUMN).write.mode(mode).partitionBy(DATE_COLUMN).parquet(f"{root.rstrip('/')}/{table}")


def jdbc_options(url: str, query: str, user: str | None = None, fetch_size: int = 10_000, **extra: str) -> dict[str, str]:
    options = {"url": url, "query": query, "fetchsize": str(fetch_size), **extra}
    if user is not None:
        options["user"] = user
    return options


def read_jdbc(spark: SparkSession, cluster: str, options: Mapping[str, str], snapshot_ts: Column | None = None) -> DataFrame:
    """One catalog query of one cluster, tagged with its cluster and snapshot time.

    The query adds what only the server knows about the reading session, e.g. ``pid = pg_backend_pid() AS
    own_backend`` for ``activity``.
    """
    rows = spark.read.format("jdbc").options(**options).load()
    when = F.current_timestamp() if snapshot_ts is None else snapshot_ts
    return rows.select(F.lit(cluster).alias("cluster"), when.alias("snapshot_ts"), *rows.columns)


def read_databases(
    readers: Mapping[str, object], skip_errors: bool = True, failures: list[tuple[str, str]] | None = None
) -> DataFrame | None:
    """Union over databases of what each reader returns, tagged ``datname``.

    ``readers`` maps a database name to a function without arguments that returns its frame. A database that fails is skipped, logged,
    and noted as (database, error) in ``failures``.
    """
    parts: list[DataFrame] = []
    for name, read in readers.items():
        try:
            df = read()  # type: ignore[operator]
        except Exception as error:
            if not skip_errors:
                raise
            log.warning("database %s left out: %s", name, error)
            if failures is not None:
                failures.append((name, str(error)))
            continue
        parts.append(df.withColumn("datname", F.lit(name)))
    return reduce(DataFrame.unionByName, parts) if parts else None


DISK_FIELDS = (
    ("segment", "int"), ("hostname", "string"), ("filesystem", "string"),
    ("total_kb", "bigint"), ("used_kb", "bigint"), ("avail_kb", "bigint"), ("percent", "int"),
)


def parse_disk_usage(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Disk-usage text, ``segment,host,filesystem,total,used,available,percent`` per line, percent sign dropped.

    A line that does not fit keeps its row with NULL figures, so bad lines can be counted.
    """
    parts = F.split(F.replace(F.col(column), F.lit("%"), F.lit("")), ",")
    sound = F.size(parts) == len(DISK_FIELDS)
    fields = [
        F.when(sound, F.trim(F.get(parts, F.lit(i))).try_cast(kind)).alias(name)
        for i, (name, kind) in enumerate(DISK_FIELDS)
    ]
    return lines.select(*keep, *fields)


def read_disk_usage(spark: SparkSession, path: str) -> DataFrame:
    return parse_disk_usage(spark.read.text(path))


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Sample history, a folder per day and metric; a big metric is split over several files."""
    dated = samples.withColumn("date", F.to_date("ts"))
    dated.hint("rebalance", "date", "metric").write.mode(mode).partitionBy("date", "metric").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    schema = table_schema("metric_samples").add("date", "date")
    return spark.read.schema(schema).parquet(path)


def write_exposition(samples: DataFrame, path: str, mode: str = "append", metrics: Sequence[MetricSpec] | None = None) -> None:
    """Text lines of samples; with ``metrics``, in order of their families and under their header lines."""
    lines = exposition_lines(samples) if metrics is None else exposition_text(samples, metrics)
    lines.write.mode(mode).text(path)
