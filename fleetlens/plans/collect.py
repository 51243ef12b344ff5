"""Run a set of collectors over landed tables and return their samples."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions.ordered import day_chunk, fill_forward
from fleetlens.functions.scope import SCOPE
from fleetlens.operators.lifecycle import absent_policy, pinned_labels, sound_entities
from fleetlens.plans.fused import GROUPS, fusable, group_samples
from fleetlens.plans.registry import COLLECTORS, selected_specs
from fleetlens.plans.samples import CollectorSpec, spec_samples

log = logging.getLogger(__name__)


def collect_samples(
    tables: Mapping[str, DataFrame],
    specs: Iterable[CollectorSpec] | None = None,
    namespace: str = "fleet",
    failures: list[tuple[str, str]] | None = None,
    history: bool = False,
) -> DataFrame:
    """Union of the samples of all collectors whose inputs are at hand.

    A collector whose policy is to continue or to yield nothing is left out when its inputs do not fit it (a
    missing table or column), and noted as (collector, error) in ``failures``; one that must not fail raises. Errors while Spark
    runs the job fail the job. A table named ``snapshots`` serves as the list of all snapshots.

    Collectors of one subject are run together, in one pass over what they read (:mod:`fleetlens.plans.fused`), where their inputs allow
    it; should a group not fit its inputs, its collectors run one by one and each keeps its own policy.

    With ``history`` the tables are read as one history: entities keep the labels of their first sight, and those that are
    gone show what their collector says of absent ones (:func:`entity_history`).
    """
    specs = tuple(selected_specs() if specs is None else specs)
    parts, done = ([], set()) if history else _together(tables, specs, namespace)
    for spec in specs:
        if spec.name in done:
            continue
        try:
            missing = [t for t in spec.inputs if t not in tables and t not in spec.optional]
            if missing:
                raise KeyError(f"{spec.name} needs {missing}")
            entities = spec.build(tables)
            if history:
                entities = entity_history(spec, entities, tables.get("snapshots"))
            parts.append(spec_samples(spec, entities, namespace))
        except (KeyError, PySparkException) as error:
            if spec.on_error == "fail":
                raise
            log.warning("collector %s left out: %s", spec.name, error)
            if failures is not None:
                failures.append((spec.name, str(error)))
    if not parts:
        raise ValueError("no collector could run")
    return reduce(DataFrame.unionByName, parts)


def _together(tables: Mapping[str, DataFrame], specs: Iterable[CollectorSpec], namespace: str) -> tuple[list[DataFrame], set[str]]:
    """Samples of the collectors that can be run in groups, and their names."""
    parts, done = [], set()
    for group in GROUPS:
        chosen = fusable(group, [s for s in specs if s in COLLECTORS], tables)
        if len(chosen) < 2:
            continue
        try:
            parts.append(group_samples(group, chosen, tables, namespace))
        except (KeyError, PySparkException) as error:
            log.info("collectors %s run one by one: %s", [s.name for s in chosen], error)
        else:
            done.update(s.name for s in chosen)
    return parts, done


def failure_rows(spark: SparkSession, failures: Iterable[tuple[str, str]]) -> DataFrame:
    """What was left out of a run, as rows ``name, error`` to be kept next to its samples."""
    return spark.createDataFrame(list(failures), "name string, error string")


def entity_values(spec: CollectorSpec) -> list[str]:
    return list(dict.fromkeys(m.value for m in spec.metrics))


def entity_labels(spec: CollectorSpec) -> list[str]:
    """Label columns that are no part of an entity's key, so that are pinned."""
    return [c for c in dict.fromkeys(c for m in spec.metrics for _, c in m.labels) if c not in spec.keys]


def entity_history(spec: CollectorSpec, entities: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Entity rows over several snapshots under the life-cycle rules of their collector.

    Rows that break the entity contract (a null key, no value at all) go. Labels that are no keys are those of the first sight of each
    life. Where the collector shows NaN or 0 for gone entities, these get rows, with the labels they had.
    """
    if not spec.keys or spec.to_samples is not None:
        return entities
    keys, values, labels = list(spec.keys), entity_values(spec), entity_labels(spec)
    sound = sound_entities(entities, keys, values)
    spine = sound if snapshots is None else snapshots
    pinned = pinned_labels(sound, keys, labels, values, snapshots=spine) if labels else sound.select(*SCOPE, *keys, *values)
    if spec.absent not in ("nan", "zero"):
        return pinned
    filled = absent_policy(pinned, keys, values, spec.absent, snapshots=spine)
    if not labels:
        return filled
    pins = pinned.select(*SCOPE, *keys, F.struct(*labels).alias("_pin"))
    labelled = filled.join(pins, [*SCOPE, *keys], "left")
    carried = fill_forward(labelled, ["cluster", *keys], ["snapshot_ts"], ["_pin"], day_chunk("snapshot_ts"))
    return carried.select(*SCOPE, *keys, *values, "_pin.*")
