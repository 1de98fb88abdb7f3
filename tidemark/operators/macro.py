"""Macro vintages: parsing, availability, as-of state, wide features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import asof_join, latest_per

def with_availability(vintages: DataFrame) -> DataFrame:
    """Conservatively known one day after the vintage began, at midnight."""
    default = F.date_trunc("day", F.col("realtime_start") + F.expr("INTERVAL 1 DAY")).cast(vintages.schema["realtime_start"].dataType)
    known = F.coalesce("available_date_conservative", default) if "available_date_conservative" in vintages.columns else default
    return vintages.withColumn("available_date_conservative", known)


def unpivot_vintages(raw: DataFrame) -> DataFrame:
    """Wide vintage rows ``series_id, date, values map<string,string>`` to long ones; keys are ``<series>_<yyyyMMdd>``."""
    long = raw.select("series_id", "date", F.explode("values").alias("key", "text"))
    suffix = F.regexp_extract("key", r"^(.*)_(\d{8})$", 2)
    named = F.regexp_extract("key", r"^(.*)_(\d{8})$", 1) == F.col("series_id")
    kept = long.filter(named & (suffix != "") & F.col("text").isNotNull() & ~F.col("text").isin("", "."))
    vintage = F.try_to_timestamp(suffix, F.lit("yyyyMMdd"))
    return kept.select("series_id", "date", F.expr("try_cast(text AS DOUBLE)").alias("value"), vintage.alias("realtime_start"), vintage.alias("realtime_end")).dropna()


def latest_vintage(vintages: DataFrame, moment) -> DataFrame:
    """The last vintage of every date known at an exact moment."""
    return latest_per(with_availability(vintages).filter(F.col("available_date_conservative") <= moment), ["series_id", "date"], [F.col("realtime_start").desc(), F.col("value").desc_nulls_last()])


def macro_state(vintages: DataFrame) -> DataFrame:
    """What is current in a series from each availability on: the newest date known, in its last vintage.

    A late revision of an older date does not displace a newer date: the running
    maximum is over (date, availability, vintage).
    """
    rows = with_availability(vintages)
    packed = F.struct("date", F.col("available_date_conservative").alias("known"), "realtime_start", "value")
    running = Window.partitionBy("series_id").orderBy("available_date_conservative").rangeBetween(Window.unboundedPreceding, 0)
    state = rows.withColumn("best", F.max(packed).over(running)).select("series_id", F.col("available_date_conservative").alias("known_from"), "best")
    return latest_per(state, ["series_id", "known_from"], [F.col("best").desc()]).select("series_id", "known_from", "best.date", "best.known", "best.realtime_start", "best.value")


def _by_day(dated: DataFrame, vintages: DataFrame, series: list[str]) -> DataFrame:
    """``_day, series_id`` with what the date knows, for the distinct ``_day`` of decisions.

    ``series`` is a fixed short list, so the grid has as many rows per date.
    """
    grid = dated.select("_day").distinct().withColumn("series_id", F.explode(F.array(*(F.lit(s) for s in series))))
    return asof_join(grid, macro_state(vintages), ["series_id"], "_day", "known_from", ["date", "value", "realtime_start"], prefix="macro_").drop("macro_time")


def _dated(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("_day", F.date_trunc("day", F.col("decision_time")).cast(decisions.schema["decision_time"].dataType))


def macro_align(decisions: DataFrame, vintages: DataFrame, series: list[str]) -> DataFrame:
    """Every decision with every series: what its UTC date knows.

    Decisions are reduced to distinct dates before the as-of join and joined back after it.
    """
    dated = _dated(decisions)
    out = dated.join(_by_day(dated, vintages, series), "_day")
    return out.withColumn("available", F.col("macro_date").isNotNull()).drop("_day")


def macro_wide(decisions: DataFrame, vintages: DataFrame, series: list[str], key: str | list[str] = "_decision_id") -> DataFrame:
    """One row per decision (``key``: its unique columns): value and age in whole days of every series, by name.

    Series become columns while rows are dates, before decisions are joined back.
    """
    keys = [key] if isinstance(key, str) else list(key)
    dated = _dated(decisions.select(*dict.fromkeys([*keys, "decision_time"])))
    wide = _by_day(dated, vintages, series).groupBy("_day").pivot("series_id", series).agg(F.first("macro_value").alias("value"), F.first("macro_date").alias("date"))
    out = dated.join(wide, "_day")
    columns = {}
    for s in series:
        columns[f"macro_{s}"] = F.col(f"`{s}_value`")
        columns[f"macro_{s}_age_days"] = F.datediff(F.col("decision_time"), F.col(f"`{s}_date`")).cast("long")
    return out.select(*keys, *(value.alias(name) for name, value in columns.items()))


def audit_vintages(vintages: DataFrame) -> DataFrame:
    """Nulls, inverted windows, duplicate rows (all members), vintages, revised dates and a status."""
    keys = ["series_id", "date", "realtime_start"]
    per_date = vintages.groupBy("series_id", "date").agg(F.count_distinct("realtime_start").alias("v"))
    revised = per_date.agg(F.count_if(F.col("v") > 1).alias("revised_dates"))
    repeated = vintages.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_rows"))
    base = vintages.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value").isNull()).alias("null_values"),
        F.count_if(F.col("realtime_end") < F.col("realtime_start")).alias("inverted_windows"),
        F.count_distinct("realtime_start").alias("vintages"),
    )
    out = base.crossJoin(repeated).crossJoin(revised)  # single rows
    bad = (F.col("rows") == 0) | (F.col("inverted_windows") > 0) | (F.col("duplicate_rows") > 0)
    return out.withColumn("status", F.when(bad | (F.col("vintages") <= 1), "FAIL").otherwise("PASS"))
