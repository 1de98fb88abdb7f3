"""Structured Streaming counterparts (an extension): late data is bounded by watermarks, results by triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.temporal import asof_join


def dedupe_stream(events: DataFrame, id_column: str, time_column: str, late: str = "2 days") -> DataFrame:
    """First arrival of every id within the watermark; state is dropped after it."""
    return events.withWatermark(time_column, late).dropDuplicatesWithinWatermark([id_column])


def windowed_counts(events: DataFrame, time_column: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    window = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    counted = events.withWatermark(time_column, late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "rows", "total")


def sessions(events: DataFrame, time_column: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    counted = events.withWatermark(time_column, late).groupBy(F.session_window(time_column, gap), key).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "rows")


def asof_stream(decisions: DataFrame, observations: Callable[[], DataFrame], sink: str, checkpoint: str, by: list[str], payload: list[str]) -> StreamingQuery:
    """Each micro-batch of decisions is aligned with the observations as stored when it runs."""

    def align(batch: DataFrame, batch_id: int) -> None:
        out = asof_join(batch, observations(), by, "decision_time", "information_time", payload)
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")  # a repeated batch overwrites itself

    return decisions.writeStream.foreachBatch(align).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
