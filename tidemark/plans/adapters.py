"""The driver's tables as the domain's tables, in Spark and as DuckDB CTEs of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str, unit: str = "day"):
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def bars(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value > 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), _day("ts").alias("timestamp"), "ts", "value")
    return e.groupBy("symbol", "timestamp").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


BARS = """bars AS (SELECT 'u' || user_id AS symbol, date_trunc('day', ts)::TIMESTAMP AS timestamp, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events WHERE value > 0 GROUP BY 1, 2)"""


def news(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type IN ('view', 'error')")
    return e.select(
        F.col("ts").alias("timestamp"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("asset"), F.col("value").alias("sentiment"), (F.col("value") / 2).alias("sentiment_change"),
        F.get_json_object("props", "$.k").cast("double").alias("surprise"), "event_type",
    )


NEWS = """news AS (SELECT ts AS timestamp, 'u' || user_id AS asset, value AS sentiment, value / 2 AS sentiment_change,
  json_extract_string(props, '$.k')::DOUBLE AS surprise, event_type FROM events WHERE event_type IN ('view', 'error'))"""


def decisions(spark, sf_dir) -> DataFrame:
    """Purchases as decisions of a user."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return e.select("event_id", F.col("user_id").alias("cik"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("decision_time"))


DECISIONS = "decisions AS (SELECT event_id, user_id AS cik, 'u' || user_id AS symbol, ts AS decision_time FROM events WHERE event_type = 'purchase')"


def facts(spark, sf_dir) -> DataFrame:
    """Revisions of quarterly sums: supplier as entity, return flag as metric, month of shipping as time of knowledge."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("cik"), F.when(F.col("l_returnflag") == "A", "assets").when(F.col("l_returnflag") == "N", "revenue").otherwise("net_income").alias("metric"),
        _day("o_orderdate", "quarter").alias("q"), _day("l_shipdate", "month").alias("information_time"), "l_linenumber", "l_extendedprice",
    )
    sums = rows.groupBy("cik", "metric", "q", "information_time").agg(F.round(F.sum("l_extendedprice"), 2).alias("val_num"), F.max("l_linenumber").cast("long").alias("lines"))
    return sums.select(
        "cik", "metric", F.lit("USD").alias("unit"), F.when(F.col("metric") != "assets", F.col("q")).alias("start"), (F.col("q") + F.expr("INTERVAL 3 MONTH") - F.expr("INTERVAL 1 DAY")).alias("end"), "information_time", "val_num", "lines"
    )


FACTS = """facts AS (SELECT cik, metric, 'USD' AS unit, CASE WHEN metric <> 'assets' THEN q END AS "start", q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS "end", information_time, val_num, lines FROM (
  SELECT l_suppkey AS cik, CASE l_returnflag WHEN 'A' THEN 'assets' WHEN 'N' THEN 'revenue' ELSE 'net_income' END AS metric, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q,
    date_trunc('month', l_shipdate)::TIMESTAMP AS information_time, round(sum(l_extendedprice), 2) AS val_num, max(l_linenumber)::BIGINT AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4))"""


def fact_decisions(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("cik"), (_day("l_shipdate", "month") + F.expr("INTERVAL 14 DAY")).alias("decision_time")).distinct()


FACT_DECISIONS = "fact_decisions AS (SELECT DISTINCT l_suppkey AS cik, date_trunc('month', l_shipdate)::TIMESTAMP + INTERVAL 14 DAY AS decision_time FROM lineitem)"


def vintages(spark, sf_dir) -> DataFrame:
    """Monthly sums by priority, revised twice: after 10, 20 and all days of the month are counted."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), _day("o_orderdate", "month").alias("date"), F.dayofmonth("o_orderdate").alias("d"), "o_totalprice")
    wide = o.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter((F.col("v") == 3) | (F.col("d") <= 10 * F.col("v")))
    out = wide.groupBy("series_id", "date", "v").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    start = F.col("date") + F.expr("make_interval(0, v)")
    return out.select("series_id", "date", "value", start.cast("timestamp_ntz").alias("realtime_start"), (start + F.expr("INTERVAL 27 DAY")).cast("timestamp_ntz").alias("realtime_end"))


VINTAGES = """vintages AS (SELECT series_id, date, round(sum(o_totalprice), 2) AS value, date + to_months(v::INT) AS realtime_start, date + to_months(v::INT) + INTERVAL 27 DAY AS realtime_end FROM (
  SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::TIMESTAMP AS date, day(o_orderdate) AS d, o_totalprice FROM orders), (SELECT unnest([1, 2, 3]) AS v)
  WHERE v = 3 OR d <= 10 * v GROUP BY series_id, date, v)"""

SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
METRICS = ["assets", "net_income", "revenue"]


def master(spark, sf_dir) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(  # nation is a fixed list of countries
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_suppkey").alias("cik"),
        F.when(F.col("s_suppkey") % 10 == 0, "etf").when(F.col("s_suppkey") % 17 == 0, "leveraged_etf").otherwise("common_equity").alias("security_type"), F.col("n_name").alias("exchange"),
        (F.col("s_suppkey") % 10 != 0).alias("is_common_equity"), (F.col("s_suppkey") % 10 == 0).alias("is_etf"), (F.col("s_suppkey") % 17 == 0).alias("is_leveraged"), F.lit(False).alias("is_inverse"), F.lit(False).alias("is_adr"),
    )


MASTER = """master AS (SELECT 's' || s_suppkey AS symbol, s_suppkey AS cik, CASE WHEN s_suppkey % 10 = 0 THEN 'etf' WHEN s_suppkey % 17 = 0 THEN 'leveraged_etf' ELSE 'common_equity' END AS security_type,
  n_name AS exchange, s_suppkey % 10 <> 0 AS is_common_equity, s_suppkey % 10 = 0 AS is_etf, s_suppkey % 17 = 0 AS is_leveraged, FALSE AS is_inverse, FALSE AS is_adr FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def predictions(spark, sf_dir) -> DataFrame:
    """Bars with a trailing three-bar return as score."""
    from tidemark.operators.bars import change

    return bars(spark, sf_dir).withColumn("score", F.round(change("close", 3), 9))


PREDICTIONS = f"""{BARS}, predictions AS (SELECT *, round(close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY timestamp) - 1, 9) AS score FROM bars)"""


def pairs(spark, sf_dir) -> DataFrame:
    """Score and what followed: predicted and actual return of every bar."""
    from tidemark.operators.bars import forward_target

    return forward_target(predictions(spark, sf_dir)).select("symbol", "timestamp", F.col("score").alias("predicted"), F.round("target_return", 9).alias("actual"), "target_timestamp")


PAIRS = f"""{PREDICTIONS}, pairs AS (SELECT symbol, timestamp, score AS predicted, round(lead(close, 3) OVER w / lead(open) OVER w - 1, 9) AS actual, lead(timestamp, 3) OVER w AS target_timestamp
  FROM predictions WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))"""
