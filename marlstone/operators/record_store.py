"""A stored record set with its revisions, partitioned by app, dataset and a hash of the key; hard deletion of records and datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.stored import escaped, exists, remove, replace_partitions, slot_of, within

BY = ["app", "dataset", "slot"]
TABLES = ("records", "revisions")


@dataclass(frozen=True)
class Store:
    """Records and revisions under ``path``; a key's rows of both lie in one partition of each."""

    path: str
    slots: int = 16

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """Rows of ``records`` or ``revisions`` without the partition's hash."""
        return self._partitioned(spark, name).drop("slot")

    def _partitioned(self, spark: SparkSession, name: str) -> DataFrame:
        schema = spark.read.parquet(f"{self.path}/{name}.layout").schema
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("slot", slot_of(F.col("key"), self.slots))

    def write(self, records: DataFrame, revisions: DataFrame) -> None:
        """Start the store with these rows (app, dataset, key, ...)."""
        for name, df in zip(TABLES, (records, revisions), strict=True):
            rows = self._placed(df)
            rows = rows.select(*[c for c in rows.columns if c not in BY], *BY)
            rows.limit(0).coalesce(1).write.parquet(f"{self.path}/{name}.layout")
            rows.hint("rebalance", *BY).write.partitionBy(*BY).parquet(f"{self.path}/{name}")

    def delete_records(self, spark: SparkSession, keys: DataFrame) -> int:
        """Remove the records of ``keys`` (app, dataset, key) with all their revisions; the number of records that were there.

        Only partitions that hold one of the keys are rewritten, revisions
        first: a run that fails between leaves records without history, which
        the same call then removes. Unknown and null keys are no error, and a
        second call changes nothing.
        """
        keys = self._placed(keys.select("app", "dataset", "key").where("app is not null and dataset is not null and key is not null").distinct())
        found = self._partitioned(spark, "records").select(*BY, "key").join(keys, [*BY, "key"], "left_semi")
        removed = found.count()
        for name in reversed(TABLES):
            parts = [tuple(r) for r in self._partitioned(spark, name).select(*BY).distinct().join(keys.select(*BY).distinct(), BY, "left_semi").collect()]  # partitions
            if parts:
                kept = self._partitioned(spark, name).where(within(BY, parts)).join(keys.drop("slot"), ["app", "dataset", "key"], "left_anti")
                replace_partitions(kept.select(self._partitioned(spark, name).columns), f"{self.path}/{name}", BY, parts)
        return removed

    def delete_dataset(self, spark: SparkSession, app: str, dataset: str) -> int:
        """Remove a dataset with all revisions; the number of its records. Its folders go, nothing is rewritten."""
        removed = self._partitioned(spark, "records").where((F.col("app") == app) & (F.col("dataset") == dataset)).count()
        for name in reversed(TABLES):
            path = f"{self.path}/{name}/app={escaped(spark, app)}/dataset={escaped(spark, dataset)}"
            if exists(spark, path):
                remove(spark, path)
        return removed
