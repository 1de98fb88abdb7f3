"""A persistent index of ids for repeated ingest: which ids and which files earlier runs have brought.

The ids lie in a table that is bucketed and sorted by id; each run of an ingest is a batch with one
row in a manifest.  A batch counts once its manifest row is written, which is the last step, so a
run that is lost half-way leaves nothing behind that counts: the same files are pending again, and their ids are
new again.  Appends add a file to every bucket; ``compact`` writes one sorted file a bucket anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import written

FILES = "file string, batch string, rows bigint, new_ids bigint, duplicate_ids bigint"


class IdIndex:
    """Tables ``name`` (``id, batch``) and ``name_files`` (a row for each file of a committed batch), created when absent."""

    def __init__(self, spark: SparkSession, name: str, kind: str = "bigint", buckets: int = 64):
        self.spark, self.name, self.kind, self.buckets = spark, name, kind, buckets
        self.files_name, self.next = f"{name}_files", f"{name}_compacted"
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE IF EXISTS {self.next}")  # of a compaction that did not end
        elif spark.catalog.tableExists(self.next):
            spark.sql(f"ALTER TABLE {self.next} RENAME TO {name}")  # of one that ended but for this step
        else:
            self._save(spark.createDataFrame([], f"id {kind}, batch string").coalesce(1), name)
        if not spark.catalog.tableExists(self.files_name):
            spark.createDataFrame([], FILES).write.format("parquet").saveAsTable(self.files_name)

    def _write(self, ids: DataFrame, name: str) -> None:
        bucket = F.pmod(F.hash("id"), F.lit(self.buckets)).cast("int")  # as the table deals its rows
        self._save(ids.repartitionById(self.buckets, bucket), name)  # a task per bucket: one sorted file for each

    def _save(self, ids: DataFrame, name: str) -> None:
        ids.write.mode("append").format("parquet").bucketBy(self.buckets, "id").sortBy("id").saveAsTable(name)

    def manifest(self) -> DataFrame:
        return self.spark.table(self.files_name)

    def ids(self) -> DataFrame:
        """Ids of committed batches."""
        return self.spark.table(self.name).join(F.broadcast(self.manifest().select("batch").distinct()), "batch", "left_semi").select("id")  # a row a run

    def pending(self, files: DataFrame, column: str = "file") -> DataFrame:
        """The files that no committed batch has."""
        seen = self.manifest().select(F.col("file").alias("_seen"))
        return files.join(seen, F.col(column) == F.col("_seen"), "left_anti")

    def fresh(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose id no committed batch has; a null id is never known."""
        known = self.ids().withColumnRenamed("id", "_known")
        return rows.join(known.hint("merge"), F.col(column) == F.col("_known"), "left_anti")

    def commit(self, batch: str, new_ids: DataFrame, files: DataFrame) -> None:
        """Append the ids of a batch, then, which makes it count, its files (``file, rows, new_ids, duplicate_ids``)."""
        self._write(new_ids.select(F.col("id").cast(self.kind).alias("id"), F.lit(batch).alias("batch")), self.name)
        named = files.select("file", F.lit(batch).alias("batch"), *(F.col(c).cast("long").alias(c) for c in ("rows", "new_ids", "duplicate_ids")))
        written(named, "index-files").coalesce(1).write.mode("append").format("parquet").saveAsTable(self.files_name)

    def compact(self) -> None:
        """Committed ids once each, in one sorted file a bucket; an interrupted call leaves the table or its successor whole."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.next}")
        counted = self.manifest().select("batch").distinct()
        kept = self.spark.table(self.name).join(F.broadcast(counted), "batch", "left_semi").groupBy("id").agg(F.min("batch").alias("batch"))
        self._write(kept, self.next)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {self.next} RENAME TO {self.name}")
