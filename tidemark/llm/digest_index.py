"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the
normalised text.  It is a log of claims: a batch of documents is digested, grouped by digest (with
map-side combining, so a digest that a third of all rows share costs one row
per task), and sort-merge anti-joined with the index; unseen digests are
appended.  A digest that the index has is claimed again only where the batch brings a better document, so the
best claim of a digest, ``winners``, is always the document that stays of all batches so far.
Each batch adds a file to every bucket that it has news for; ``compact`` writes the winners anew, one sorted
file a bucket.

Every document learns which row stays by a join on the digest;
one side of that join has one row per digest, so adaptive execution can split a
hot digest on the other side.

Of equal texts that with the most code points stays, then the smallest doc_id.

Defined cases: null text counts as empty; texts without any visible character
are equal to each other; repeated rows with the same ``doc_id`` are separate
rows of which one stays; a null ``doc_id`` sorts after all others; extra columns
are ignored; texts of any length are digested whole; an empty batch gives an empty result and leaves the index as it is.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, first_of_repeats, staged, text_or_empty, without

INDEX_SCHEMA = "digest binary, keep_id bigint, chars bigint, batch string"
BATCHES = 3  # of one table, as the query brings it to the index


def rank(chars: str, doc_id: str) -> list[Column]:
    """Ascending order of claims to a digest, the best one first."""
    return [(-F.col(chars)).alias("a"), F.col(doc_id).isNull().alias("b"), F.col(doc_id).alias("c")]


class DigestIndex:
    """The index table ``name`` with ``buckets`` buckets, created when absent."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.next = f"{name}_compacted"
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE IF EXISTS {self.next}")  # of a compaction that did not end
        elif spark.catalog.tableExists(self.next):
            spark.sql(f"ALTER TABLE {self.next} RENAME TO {name}")  # of one that ended but for this step
        else:
            self._save(spark.createDataFrame([], INDEX_SCHEMA).coalesce(1), name)

    def _write(self, rows: DataFrame, name: str) -> None:
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets)).cast("int")  # as the table deals its rows
        self._save(rows.repartitionById(self.buckets, bucket), name)  # a task per bucket: one sorted file for each

    def _save(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def winners(self) -> DataFrame:
        """``digest, keep_id, chars, batch`` of the document that stays of each digest; of equal claims the earliest batch name."""
        claim = F.struct(*rank("chars", "keep_id"), F.col("batch").alias("d"))
        best = self.table().groupBy("digest").agg(F.min(claim).alias("w"))  # no shuffle: the buckets hold digests together
        return best.select("digest", F.col("w.c").alias("keep_id"), (-F.col("w.a")).alias("chars"), F.col("w.d").alias("batch"))

    def compact(self) -> None:
        """One claim a digest in one sorted file a bucket; an interrupted call leaves the table or its successor whole."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.next}")
        self._write(self.winners(), self.next)
        self.drop()
        self.spark.sql(f"ALTER TABLE {self.next} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")

    def claim(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of ``groups`` (``digest, own_id, own_chars``) that are new, or better than what the index has."""
        known = self.winners().select("digest", "keep_id", "chars")
        fresh = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        better = groups.join(known.hint("merge"), "digest").filter(F.struct(*rank("own_chars", "own_id")) < F.struct(*rank("chars", "keep_id")))
        names = ["digest", F.col("own_id").alias("keep_id"), F.col("own_chars").alias("chars"), F.lit(batch).alias("batch")]
        # written before the table that it is read from grows
        self._write(staged(fresh.select(*names).unionAll(better.select(*names)), "digest-claims"), self.name)

    def add(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch inside itself and against the index, and append its claims.

        Returns one row per input row: ``doc_id, keep_id`` (of all batches so far), ``group_size`` (rows of
        this batch with an equal text), ``kept``, ``digest``, ``row``.  Name a ``batch`` that may have
        to be run again: a rerun finds its own claims in the index, adds what is missing and
        returns the same verdicts.
        """
        batch = batch or uuid.uuid4().hex
        rows = staged(digest_rows(docs, id_col, text_col), "digest-rows")
        groups = staged(digest_groups(rows), "digest-groups")
        self.claim(groups, batch)
        return verdicts(rows, groups.withColumn("batch", F.lit(batch)), self.winners())


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("chars"),
        digest_of(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        *more,
    )


def digest_groups(rows: DataFrame) -> DataFrame:
    """``digest``, its best row of ``rows`` (``own_id, own_chars, own_row``) and its ``size``."""
    best = F.min(F.struct(*rank("chars", "doc_id"), "row")).alias("w")
    groups = rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("size"))
    return groups.select("digest", F.col("w.c").alias("own_id"), (-F.col("w.a")).alias("own_chars"), F.col("w.row").alias("own_row"), "size")


def verdicts(rows: DataFrame, groups: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows with what stays of their digest; ``groups`` are those of one batch or of several (with their ``batch``).

    A row is kept if its batch has the winning claim and it is the batch's best row.
    """
    sizes = groups.groupBy("digest").agg(F.sum("size").alias("group_size"))
    own = groups.select("digest", "batch", F.col("own_row").alias("keep_row"))
    # a batch whose claim lost has no row that stays
    decided = sizes.join(winners.select("digest", "keep_id", "batch"), "digest").join(own, ["digest", "batch"], "left")
    joined = rows.join(decided.select("digest", "keep_id", "group_size", "keep_row"), "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest", "row")


def dedup_batches(docs: DataFrame, buckets: int = 64, batches: int = BATCHES) -> DataFrame:
    """The verdicts on a table that comes to an index of its own in several batches, by a checksum of doc_id.

    Later batches meet the digests of earlier ones; the index is compacted between them and goes when the verdicts are written.
    """
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}", buckets)
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % batches, F.lit(0)).alias("part")
    rows = staged(digest_rows(docs, "doc_id", "text", part), "digest-rows")
    parts = []
    for k in range(batches):
        groups = staged(digest_groups(rows.filter(F.col("part") == k)), "digest-groups")
        index.claim(groups, f"{k}")
        parts.append(groups.withColumn("batch", F.lit(f"{k}")))
        if k == batches // 2:
            index.compact()
    decided = staged(verdicts(rows, reduce(DataFrame.unionAll, parts), index.winners()), "dedup-decided")
    index.drop()
    return decided


def digest_of(text):
    """SHA-256 of a text without its white space."""
    return F.unhex(F.sha2(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "").cast("binary"), 256))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns."""
    decided = dedup_batches(docs)
    # rows that agree in doc_id and text go down to one here; they aren't dropped by key
    same = decided.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    keys = {"doc_id": F.col("doc_id").cast("long"), "digest": digest_of(text_or_empty())}
    same = staged(same, "dedup-keys")
    left = without(docs, same.filter("NOT kept"), keys)
    return first_of_repeats(left, keys, same.filter("kept AND n > 1"))


def dedup_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup_batches(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
k AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""
