"""Sharding by extendible hashing: shards named by hash-prefix bits, each within a byte limit.

A document hashes to 120 bits: 60 of its key first and then
60 of the row, so rows that share a key (however many) still part.  The
directory starts as one bucket; only buckets above the limit are split on one
more bit, until every shard fits.

The directory is built from a histogram of prefix cells, not from the rows: one
aggregation of ``depth`` bits gives the bytes of each cell, every bucket above it
is a sum of cells, and a bucket is a shard when it fits and none above it does.
Cells that are still too large get a finer histogram of their own rows alone, as
often as needed.

A single row above the limit, and rows whose 120 bits are equal, cannot be
parted; they form a shard of their own at the full depth, marked ``oversize``.

Defined cases: null text has no bytes; a null key is a key; repeated rows get row
bits by their number; empty shards don't exist; an empty table gives no shard.  Texts of any length count whole;
extra columns are ignored by the assignment and kept by ``write_shards``, whose shard column gets underscores until no
column of the table begins with its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_beside, staged, text_or_empty

BITS = 120


def _hex_bits(column):
    """The bits of 15 hexadecimal digits (60 bits)."""
    return F.lpad(F.conv(column, 16, 2), 60, "0")


def hashed_rows(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, key, bytes, bits``, written once. The bits are those of the key's MD5, then of key and row number.

    ``keep`` adds the row's own columns as the struct ``doc``.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.octet_length(text_or_empty(text_col)).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"), *([F.struct(*docs.columns).alias("doc")] if keep else [])
    )
    bits = F.concat(_hex_bits(F.substring(F.md5(F.col("key").cast("binary")), 1, 15)), _hex_bits(F.substring(F.md5(F.concat_ws("/", "key", F.col("row").cast("string")).cast("binary")), 1, 15)))
    return staged(rows.withColumn("bits", bits), "shard-rows")


def directory(rows: DataFrame, limit: int, spare_bits: int = 6) -> DataFrame:
    """``shard, depth, shard_bytes, shard_rows, oversize`` from hashed rows."""
    total = rows.agg(F.sum("bytes")).first()[0]
    base, depth, found = 0, 0, None
    # bits enough for the limit if hashes spread evenly, and some to spare
    depth = min(BITS, max(0, (int(total or 0) // max(limit, 1)).bit_length() + spare_bits))
    part = rows.select("bits", "bytes")
    while True:
        cells = staged(part.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-cells")
        levels = cells.select(F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"), "cell", "bytes", "n")
        buckets = levels.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        # a fitting bucket is a shard if the one above it is too large
        last = F.col("depth") == F.lit(BITS)
        fits = (F.col("shard_bytes") <= limit) | last
        above = buckets.filter(~fits).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("above"))
        own = buckets.filter(fits).withColumn("above", F.expr("substring(shard, 1, greatest(depth - 1, 0))"))
        shards = own.join(above, ["depth", "above"], "left_semi") if base or depth else own
        if not base:
            shards = shards.unionByName(own.filter("depth = 0")) if depth else shards
        shards = staged(shards.select("shard", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversize")), "shards")
        found = shards if found is None else found.unionByName(shards)
        large = cells.filter(F.col("bytes") > limit).select("cell")
        if depth == BITS or large.isEmpty():
            return found
        part = staged(part.withColumn("cell", F.substring("bits", 1, depth)).join(large, "cell", "left_semi").select("bits", "bytes"), "shard-large")
        base, depth = depth, min(BITS, depth + 8)


def assign_shards(docs: DataFrame, limit: int, key_col: str = "doc_id") -> DataFrame:
    """Every row with its shard: ``doc_id, bytes, shard, depth, shard_bytes, shard_rows, oversize``.

    Rows look their prefix up at each depth that occurs in the directory (a few).
    """
    return _placed(hashed_rows(docs, key_col), limit).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversize")


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    shards = staged(directory(rows, limit), "directory")
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most BITS + 1 values
    if not depths:
        depths = [0]
    tries = rows.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths))))
    tries = tries.withColumn("shard", F.expr("substring(bits, 1, depth)"))
    return tries.join(shards, ["depth", "shard"])


def write_shards(docs: DataFrame, path: str, limit: int, key_col: str = "doc_id") -> None:
    """Write the documents partitioned by shard; a shard, being within the limit, is one task's and one file."""
    placed = _placed(hashed_rows(docs, key_col, keep=True), limit)
    name = prefix_beside(docs, "shard_name")
    named = placed.select("doc.*", F.concat(F.lit("s"), "shard").alias(name))
    named.repartition(name).write.partitionBy(name).parquet(path)


LIMIT = 4 << 20


def sharding_query(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    return assign_shards(docs, limit).select("doc_id", "bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_rows", "oversize")


def oracle(limit: int = LIMIT) -> str:
    """The same in DuckDB SQL, for tables without a document over the limit."""
    return rf"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
                  lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
l AS (SELECT *, substr(bits, 1, depth) AS shard FROM r, range(0, 41) t(depth)),
b AS (SELECT depth, shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY 1, 2)
SELECT doc_id, bytes, shard, depth, shard_bytes, shard_rows, FALSE AS oversize
FROM l JOIN b USING (depth, shard) WHERE shard_bytes <= {limit}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
