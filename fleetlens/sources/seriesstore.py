"""Sample history behind an index of its series.

A series is (cluster, metric, labels). Instead of repeating its labels with every sample, the store keeps

* ``series``: one row per series with its number,
* ``postings``: for every label value (the cluster is one more label) the numbers of the series that have it,
* ``data``: date, metric, series number, ts, value; foldered by day and metric and sorted by series number.

Label matchers run on the postings, which grow with the series and not with the samples. Samples are then read by series number: the
scan gets the numbers as a filter and skips row groups by their bounds. A selection of very many series is met in a join.

A number is a 64-bit hash of the series under the store's seed. That no two series share one is verified whenever series are added;
should it happen, the append is refused before anything is written, and the store has to be written anew with another seed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.operators.series import label_key, label_test, matches_all

SERIES = "series_id long, cluster string, labels map<string,string>, metric string"
POSTINGS = "series_id long, name string, value string, metric string"
DATA = "series_id long, ts timestamp, value double, date date, metric string"


class SharedNumber(ValueError):
    """Two series have one number."""


class SeriesStore:
    """A store in a folder. ``most_ids``: up to so many series are named to the scan one by one; more are joined."""

    def __init__(self, spark: SparkSession, path: str, seed: int = 0, most_ids: int = 1024):
        self.spark, self.path, self.most_ids = spark, path.rstrip("/"), most_ids
        self.seed = seed

    def _table(self, name: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.path}/{name}")
        except Exception as error:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def series(self) -> DataFrame:
        return self._table("series", SERIES)

    def postings(self) -> DataFrame:
        return self._table("postings", POSTINGS)

    def number(self) -> Column:
        """The number of a row's series. Labels are hashed in order, each with its length, so no two label sets read alike."""
        parts = F.transform(label_key(), lambda e: F.concat_ws(":", F.char_length(e["key"]).cast("string"), e["key"], F.char_length(e["value"]).cast("string"), e["value"]))
        return F.xxhash64(F.lit(self.seed), "cluster", "metric", F.array_join(parts, ","))

    def append(self, samples: DataFrame) -> None:
        """Add samples (cluster, ts, metric, labels, value): new series first, then their data.

        Series that are there already are not written again, so an append that is repeated after a failure adds no series twice.
        """
        rows = samples.withColumn("series_id", self.number())
        found = rows.groupBy("series_id", "cluster", "metric", label_key().alias("_labels")).agg(F.lit(1).alias("_one")).drop("_one")
        known = self.series().select("series_id", "cluster", "metric", label_key().alias("_labels"))
        both = found.unionByName(known).distinct()
        if not both.groupBy("series_id").count().filter("count > 1").isEmpty():
            raise SharedNumber(f"two series share a number under seed {self.seed}")
        fresh = found.join(known, "series_id", "left_anti").select("series_id", "cluster", F.map_from_entries("_labels").alias("labels"), "metric")
        labels = F.map_entries("labels")
        entries = F.concat(labels, F.array(F.struct(F.lit("cluster").alias("key"), F.col("cluster").alias("value"))))
        # A series becomes known with its last table, so a repeated append writes its postings again rather than never.
        postings = fresh.select("series_id", F.explode(entries).alias("_e"), "metric").select("series_id", "_e.key", "_e.value", "metric").toDF("series_id", "name", "value", "metric")
        postings.hint("rebalance", "metric").sortWithinPartitions("metric", "name", "value").write.mode("append").partitionBy("metric").parquet(f"{self.path}/postings")
        fresh.hint("rebalance", "metric").sortWithinPartitions("metric", "series_id").write.mode("append").partitionBy("metric").parquet(f"{self.path}/series")
        data = rows.select("series_id", "ts", "value", F.to_date("ts").alias("date"), "metric")
        data.hint("rebalance", "date", "metric").sortWithinPartitions("date", "metric", "series_id", "ts").write.mode("append").partitionBy("date", "metric").parquet(f"{self.path}/data")

    def matching(self, metrics: Sequence[str], matchers: Mapping[str, str] | None = None) -> DataFrame:
        """series_id of the series of some metrics whose labels match; a label that a series lacks is the empty string."""
        chosen = self.series().filter(F.col("metric").isin(*metrics)).select("series_id")
        entries = self.postings().filter(F.col("metric").isin(*metrics))
        for name, pattern in (matchers or {}).items():
            if matches_all(pattern):
                continue
            own, test = entries.filter(F.col("name") == name), label_test(F.col("value"), pattern)
            if self._matches_empty(pattern):
                chosen = chosen.join(own.filter(~test).select("series_id"), "series_id", "left_anti")
            else:
                chosen = chosen.join(own.filter(test).select("series_id"), "series_id", "left_semi")
        return chosen

    def _matches_empty(self, pattern: str) -> bool:
        return bool(self.spark.range(1).select(label_test(F.lit(""), pattern)).first()[0])

    def select(self, metrics: Sequence[str], matchers: Mapping[str, str] | None = None) -> DataFrame:
        """The samples of the matching series, in sample form, with the folder column ``date``."""
        chosen = self.matching(metrics, matchers)
        data = self._table("data", DATA).filter(F.col("metric").isin(*metrics))
        few = [r.series_id for r in chosen.limit(self.most_ids + 1).collect()]
        if len(few) <= self.most_ids:
            data = data.filter(F.col("series_id").isin(few))
            names = self.series().filter(F.col("metric").isin(*metrics) & F.col("series_id").isin(few))
        else:
            names = self.series().filter(F.col("metric").isin(*metrics)).join(chosen, "series_id", "left_semi")
        return data.join(names.drop("metric"), "series_id").select("cluster", "ts", "metric", "labels", "value", "date")

    def label_values(self, name: str, metric: str, matchers: Mapping[str, str] | None = None) -> DataFrame:
        """Distinct values of a label, sorted, from the postings alone."""
        entries = self.postings().filter((F.col("metric") == metric) & (F.col("name") == name) & (F.col("value") != ""))
        if any(not matches_all(p) for p in (matchers or {}).values()):
            entries = entries.join(self.matching([metric], matchers), "series_id", "left_semi")
        return entries.select(F.col("value").alias("label_value")).distinct().orderBy("label_value")
