"""Quality rules at the level of a host.

Every document is measured on its own; the share of failing documents of a host
is then shrunk towards the corpus with a beta prior whose two parameters are
estimated from all hosts (method of moments), and hosts whose shrunken failure
rate exceeds a limit lose all their documents.

The prior keeps small hosts near the corpus rate: one bad page out of one does
not condemn a host.  Host statistics are sums, combined on the map side, so a
host with a third of all rows is no hot group; the join back has one row per
host on one side, so adaptive execution may split the other.

Defined cases: null or blank text has no words and fails; a null host is a host
of its own; without rows the result is empty; when no or every document fails,
the prior is degenerate and the shrunken rate is that common rate.  Repeated rows are measured one by one and all
count for their host; texts of any length are measured whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, arrow_map, staged

SYMBOLS = "#*$%&|<>"
FEATURES = "doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(words: list, window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found twice or more (first included)."""
    n = len(words)
    if n <= window:
        return 0
    distinct = dict.fromkeys(words)
    if len(distinct) == n:
        return 0
    code = dict(zip(distinct, range(len(distinct)), strict=True))
    ids = np.fromiter(map(code.__getitem__, words), np.int64, n)
    key, base = ids[: n - window + 1], len(code)
    bound = base
    for k in range(1, window):
        if bound > 2**62 // base:  # keep the next product in 63 bits
            key, bound = np.unique(key, return_inverse=True)[1], n
        key, bound = key * base + ids[k : n - window + 1 + k], bound * base
    twice = pd.Series(key).duplicated(keep=False).to_numpy()
    inside = np.zeros(n, bool)
    for k in range(window):
        inside[k : n - window + 1 + k] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
        elif line.strip(SPACE_CHARS):
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), lines, repeated_words(words)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        found = np.array([measure(t) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(5))], ["doc_id", "host", *names]
        )


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return arrow_map(narrow, ["doc_id", "host", "text"], _measure_batches, FEATURES)


def failed(min_words: int = 50, max_repeat_percent: int = 50):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(features: DataFrame) -> DataFrame:
    """Per host: documents, failures and the failure rate shrunk by the empirical beta prior."""
    hosts = features.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    total = hosts.agg(
        F.sum("host_docs").cast("double").alias("n"),
        F.sum("host_failed").cast("double").alias("k"),
        F.count(F.lit(1)).cast("double").alias("h"),
        F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")).alias("ss"),
    ).select(F.try_divide("k", "n").alias("mean"), "n", "h", "ss")
    # spread of host rates around the mean, less what sampling alone gives
    noise = F.col("mean") * (1 - F.col("mean"))
    spread = F.col("ss") / F.col("n") - F.col("mean") * F.col("mean") - noise * F.col("h") / F.col("n")
    share = F.when(noise > 0, F.least(F.greatest(spread / noise, F.lit(1e-4)), F.lit(0.9999)))
    prior = total.select("mean", (F.lit(1.0) / share - 1).alias("strength"))
    rate = F.when(F.col("strength").isNull(), F.col("mean")).otherwise(
        (F.col("host_failed") + F.col("strength") * F.col("mean")) / (F.col("host_docs") + F.col("strength"))
    )
    return hosts.crossJoin(F.broadcast(prior)).select("host", "host_docs", "host_failed", rate.alias("host_rate"))  # prior is one row


def apply_host_rules(docs: DataFrame, max_host_rate: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Features, own verdict and host verdict of every document."""
    features = staged(document_features(docs).withColumn("base_failed", failed(min_words, max_repeat_percent)), "host-features")
    rates = host_rates(features).withColumnRenamed("host", "rated_host")
    joined = features.join(rates, F.col("host").eqNullSafe(F.col("rated_host")))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).drop("rated_host")


def host_query(docs: DataFrame) -> DataFrame:
    return apply_host_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_docs", "host_failed"
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, w || chr(1) || lead(w) OVER o || chr(1) || lead(w, 2) OVER o AS k FROM p
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT w.doc_id, host, len(ws) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dl.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT host, count(*) AS host_docs, sum(base_failed::BIGINT)::BIGINT AS host_failed FROM b GROUP BY host),
s AS (SELECT sum(host_docs)::DOUBLE AS n, sum(host_failed)::DOUBLE / sum(host_docs) AS m, count(*) AS hs,
             sum(host_failed * host_failed / host_docs::DOUBLE) AS ss FROM h),
q AS (SELECT m, CASE WHEN m * (1 - m) > 0 THEN 1 / least(greatest((ss / n - m * m - m * (1 - m) * hs / n) / (m * (1 - m)), 1e-4), 0.9999) - 1 END AS st FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE WHEN st IS NULL THEN m ELSE (host_failed + st * m) / (host_docs + st) END <= 0.5 AS kept,
       b.host, host_docs, host_failed
FROM b JOIN h ON b.host IS NOT DISTINCT FROM h.host CROSS JOIN q
"""
