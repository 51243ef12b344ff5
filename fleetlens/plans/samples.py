"""From wide entity rows to long metric samples, and from samples to text lines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.scalars import metric_name, or_unknown
from fleetlens.functions.scope import SCOPE


@dataclass(frozen=True)
class MetricSpec:
    """One metric family: its name, the column that holds the value, and the columns that become labels.

    ``kind`` is ``gauge``, ``counter`` or ``summary``.
    """

    name: str
    value: str
    labels: tuple[tuple[str, str], ...] = ()
    subsystem: str | None = None
    kind: str = "gauge"
    help: str = ""

    def full_name(self, namespace: str = "fleet") -> str:
        return metric_name(self.name, self.subsystem, namespace)


@dataclass(frozen=True)
class CollectorSpec:
    """A collector: what it reads, how it transforms, and what its metrics do.

    Users register their own by building one of these; ``transform`` takes the input tables by name.
    ``collector`` names the switch that turns it on, ``absent`` what a metric shows once its entity is gone
    (``remove``, ``nan``, ``zero`` or None for figures that always exist), ``on_error`` whether a failure stops
    the run (``fail``), leaves the collector out (``continue``) or yields an empty snapshot (``empty``). Inputs in
    ``optional`` may be missing; the transform then goes without. With
    ``spine`` the transform also takes the list of all snapshots, to report zeros for those without any row.
    """

    name: str
    collector: str
    inputs: tuple[str, ...]
    transform: Callable[[Mapping[str, DataFrame]], DataFrame]
    keys: tuple[str, ...] = ()
    metrics: tuple[MetricSpec, ...] = ()
    absent: str | None = None
    on_error: str = "fail"
    group: str = "general"
    optional: tuple[str, ...] = ()
    spine: bool = False
    to_samples: Callable[[DataFrame, str], DataFrame] | None = field(default=None, compare=False)

    def build(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        if self.spine and "snapshots" in tables:
            return self.transform(tables, snapshots=tables["snapshots"])
        return self.transform(tables)


def label_map(labels: Sequence[tuple[str, str]]) -> Column:
    if not labels:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.create_map(
        *[c for name, column in labels for c in (F.lit(name), or_unknown(F.col(column).cast("string")))]
    )


def to_samples(df: DataFrame, metrics: Sequence[MetricSpec], namespace: str = "fleet", ts: str = "snapshot_ts") -> DataFrame:
    """``cluster, ts, metric, labels, value``: one row per entity and metric. Narrow, reads the input once.

    Metrics with the same labels share one map, built before the rows are multiplied.
    """
    label_sets = list(dict.fromkeys(m.labels for m in metrics))
    values = list(dict.fromkeys(m.value for m in metrics))
    wide = df.select(
        "cluster",
        F.col(ts).alias("ts"),
        *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)],
        *[label_map(pairs).alias(f"_l{i}") for i, pairs in enumerate(label_sets)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m.full_name(namespace)).alias("metric"),
                F.col(f"_l{label_sets.index(m.labels)}").alias("labels"),
                F.col(f"_v{values.index(m.value)}").alias("value"),
            )
            for m in metrics
        ]
    )
    return wide.select("cluster", "ts", F.explode(rows).alias("_m")).select("cluster", "ts", "_m.*")


def metric_column_samples(
    labels: Sequence[str], subsystem: str
) -> Callable[[DataFrame, str], DataFrame]:
    """Sample form of a frame that already holds one metric per row (columns ``metric`` and ``value``).

    A label that is NULL does not belong to the row's metric.
    """

    def convert(df: DataFrame, namespace: str = "fleet") -> DataFrame:
        pairs = label_map([(c, c) for c in labels])
        present = F.map_filter(pairs, lambda k, v: v.isNotNull())
        given = F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c).isNotNull())])
        kept = F.map_filter(present, lambda k, v: given[k])
        return df.select(
            "cluster",
            F.col("snapshot_ts").alias("ts"),
            F.concat_ws("_", F.lit(namespace), F.lit(subsystem), "metric").alias("metric"),
            kept.alias("labels"),
            F.col("value").cast("double").alias("value"),
        )

    return convert


def spec_samples(spec: CollectorSpec, entities: DataFrame, namespace: str = "fleet") -> DataFrame:
    if spec.to_samples is not None:
        return spec.to_samples(entities, namespace)
    return to_samples(entities, spec.metrics, namespace)


def _escape(col: Column) -> Column:
    quoted = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(quoted, F.lit("\n"), F.lit("\\n"))


def exposition_lines(samples: DataFrame, cluster_label: bool = True) -> DataFrame:
    """Text lines ``name{label="value",…} value`` in one column, ready for ``df.write.text``."""
    labels = F.map_entries("labels")
    if cluster_label:
        own = F.array(F.struct(F.lit("cluster").alias("key"), F.col("cluster").alias("value")))
        labels = F.concat(labels, own)
    pairs = F.transform(
        F.array_sort(labels), lambda e: F.concat(e["key"], F.lit('="'), _escape(e["value"]), F.lit('"'))
    )
    body = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    number = (
        F.when(F.isnan("value"), F.lit("NaN"))
        .when(F.col("value") == float("inf"), F.lit("+Inf"))
        .when(F.col("value") == float("-inf"), F.lit("-Inf"))
        .otherwise(F.col("value").cast("string"))
    )
    return samples.select(F.concat("metric", body, F.lit(" "), number).alias("value"))


def exposition_headers(metrics: Sequence[MetricSpec], namespace: str = "fleet") -> list[str]:
    """Help and type lines, which stand before the lines of their metric family."""
    lines = []
    for m in metrics:
        name = m.full_name(namespace)
        if m.help:
            text = m.help.replace("\\", "\\\\").replace("\n", "\\n")
            lines.append(f"# HELP {name} {text}")
        lines.append(f"# TYPE {name} {m.kind}")
    return lines


def exposition_text(samples: DataFrame, metrics: Sequence[MetricSpec], namespace: str = "fleet") -> DataFrame:
    """The whole text, in order: the header lines of each metric family that has samples, then its lines.

    Families are in order of name. Sorting deals ranges of lines to the tasks, so a family with most of the samples is spread over several
    files that follow each other. A family that ``metrics`` does not list has no header.
    """
    listed: dict[str, list[str]] = {}
    for m in metrics:
        listed.setdefault(m.full_name(namespace), exposition_headers([m], namespace))
    rows = [(name, at, line) for name, lines in listed.items() for at, line in enumerate(lines)]
    spark = samples.sparkSession
    known = spark.createDataFrame(rows, "metric string, at int, value string")
    headers = known.join(samples.select("metric").distinct(), "metric", "left_semi")
    # exposition_lines keeps the line alone; a line starts with the name of its family, which ends at "{" or a space.
    lines = exposition_lines(samples).select(F.regexp_extract("value", "^[^{ ]+", 0).alias("metric"), F.lit(None).cast("int").alias("at"), "value")
    return headers.unionByName(lines).orderBy("metric", F.asc_nulls_last("at"), "value").select("value")


def entity_key(*columns: str, separator: str = ".") -> Column:
    """Display form of an entity key (keys stay separate columns everywhere else)."""
    return F.concat_ws(separator, *[F.col(c).cast("string") for c in columns])


__all__ = [
    "SCOPE", "CollectorSpec", "MetricSpec", "entity_key", "exposition_headers", "exposition_lines", "exposition_text", "label_map",
    "metric_column_samples", "spec_samples", "to_samples",
]
