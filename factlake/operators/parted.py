"""Tables kept by organisation, changed in place one batch after another.

A table lies in folders ``org_id=…/bucket=…``; the bucket is a hash of the row's
key, so a large organisation is many folders too. A batch of changes reads and
rewrites only the folders that hold a changed key: they are joined in as
dimensions, which Spark turns into partition filters of the scan, and Spark's
dynamic overwrite replaces exactly the folders that are written. A batch leaves
a marker when it is through and is skipped when it comes again. One that broke
off is run again from the start, so a change must have the same effect twice;
those below do.

Defined cases: rows and changes without an organisation belong to no folder and
are left out; a change of an unknown key does what its function says (nodes are
added, others ignored); an empty batch changes nothing; several changes of one
key follow the rules of their function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import memory

BUCKETS = 16
PLACE = ["org_id", "bucket"]


@dataclass(frozen=True)
class Parted:
    path: str
    schema: T.StructType
    key: str
    buckets: int = BUCKETS

    def _placed(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        bucket = F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")
        return rows.filter(F.col("org_id").isNotNull()).withColumn("bucket", bucket)

    def _write(self, rows: DataFrame) -> None:
        # Rebalancing gives a folder few files, and a large one to several tasks.
        rows = self._placed(rows.select(*self.schema.names)).hint("rebalance", *PLACE)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(f"{self.path}/rows")

    def create(self, rows: DataFrame) -> Parted:
        self._write(rows)
        return self

    def _folders(self, spark: SparkSession) -> DataFrame:
        data = [f for f in self.schema.fields if f.name != "org_id"]
        place = [T.StructField("org_id", T.StringType()), T.StructField("bucket", T.IntegerType())]
        try:
            return spark.read.schema(T.StructType([*data, *place])).parquet(f"{self.path}/rows")
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], T.StructType([*data, *place]))

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows; a filter on ``org_id`` reads only the folders of that organisation."""
        return self._folders(spark).select(*self.schema.names)

    def touched(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """The rows of all folders that hold one of ``keys`` (``org_id`` and the table's key)."""
        # Spark prunes folders by a dimension only if that has a filter of its own.
        folders = self._placed(keys.select("org_id", self.key)).select(*PLACE).distinct().filter(F.col("bucket") >= 0)
        return self._folders(spark).join(folders, PLACE, "left_semi").select(*self.schema.names)

    def done(self, spark: SparkSession, batch: str) -> bool:
        try:
            return not spark.read.schema("n bigint").parquet(f"{self.path}/batches/{batch}").isEmpty()
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def merge(self, spark: SparkSession, batch: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Replaces the folders of ``keys`` by what ``change`` makes of their rows; False if the batch was through already."""
        if self.done(spark, batch):
            return False
        self._write(change(self.touched(spark, keys)))
        spark.range(1).select(F.col("id").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True


def supersede(table: Parted, batch: str, changes: DataFrame, now: Column) -> bool:
    """``memory.supersede`` in place; ``changes`` has ``seq, org_id, old_id, new_id``."""
    keys = changes.select("org_id", F.explode(F.array("old_id", "new_id")).alias(table.key))
    return table.merge(changes.sparkSession, batch, keys, lambda rows: memory.supersede(rows, changes, now)[0])


def mark_processed(table: Parted, batch: str, done: DataFrame, now: Column) -> bool:
    """Sets ``processed_at`` of the sources in ``done`` (``org_id, id``)."""
    return table.merge(done.sparkSession, batch, done, lambda rows: memory.mark_processed(rows, done, now))


def upsert_nodes(table: Parted, batch: str, changes: DataFrame) -> bool:
    """As ``graph.upsert_nodes``, in place; a node is known by organisation and id."""
    changes = changes.filter(F.col("org_id").isNotNull())

    def change(rows: DataFrame) -> DataFrame:
        latest = changes.groupBy("org_id", "entity_id").agg(
            F.min_by(F.struct("entity_type", F.coalesce("name", F.lit("")).alias("name")), "seq").alias("made"), F.max_by("content", "seq").alias("new_content"))
        old = rows.select("org_id", "entity_id", F.struct("entity_type", "name").alias("old"), "content")
        return old.join(latest, ["org_id", "entity_id"], "full_outer").withColumn("kept", F.coalesce("old", "made")).select(
            "org_id", "entity_id", "kept.*", F.coalesce("new_content", "content").alias("content"))

    return table.merge(changes.sparkSession, batch, changes, change)
