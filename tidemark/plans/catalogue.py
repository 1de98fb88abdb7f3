"""Registry of queries over the driver's tables and their DuckDB SQL.

Each query applies one operator to an adapter of the driver's tables (see
``adapters``); doubles are rounded on both sides, as sums differ in the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import LEVERAGED_INVERSE
from tidemark.functions import scalars
from tidemark.operators import audits, bars as bar_ops, facts as fact_ops, macro, models, news as news_ops, panel, research, temporal
from tidemark.plans import adapters as a
from tidemark.sources import feeds

QUERIES: dict = {}
ORACLES: dict = {}
DIGITS = 6


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def rounded(df: DataFrame, *but: str) -> DataFrame:
    """Doubles rounded, but for the columns named."""
    return df.select(*(F.round(c, DIGITS).alias(c) if kind == "double" and c not in but else F.col(c) for c, kind in df.dtypes))


def r(*names: str) -> str:
    return ", ".join(f"round({n}, {DIGITS}) AS {n}" for n in names)


W = "WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)"
OHLC = "symbol, timestamp, open, high, low, close, volume"

# bars ---------------------------------------------------------------------


@register(f"WITH {a.BARS} SELECT {OHLC} FROM bars")
def daily_bars(spark, sf_dir):
    return a.bars(spark, sf_dir)


@register(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC, l_suppkey DESC, l_quantity DESC) = 1"""
)
def market_dedupe_keep_last(spark, sf_dir):
    rows = a.table(spark, sf_dir, "lineitem")
    last = bar_ops.keep_last(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice", "l_suppkey", "l_quantity"])
    return last.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")


def _rolled(fn: str, x: str, n: int, least: int | None = None) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least or n} THEN {fn}({x}) {over} END"


QUANT = ["return_1", "log_return_1"] + [f"{c}_{n}" for n in (3, 5) for c in ("momentum", "volatility", "distance_sma", "zscore", "atr")] + ["volume_change_1", "relative_volume_20"]
_per_window = ", ".join(
    f"close / lag(close, {n}) OVER w - 1 AS momentum_{n}, {_rolled('stddev_samp', 'return_1', n)} AS volatility_{n}, close / {_rolled('avg', 'close', n)} - 1 AS distance_sma_{n}, "
    f"(close - {_rolled('avg', 'close', n)}) / nullif({_rolled('stddev_samp', 'close', n)}, 0) AS zscore_{n}, {_rolled('avg', 'tr', n)} AS atr_{n}"
    for n in (3, 5)
)


@register(
    f"""WITH {a.BARS}, x AS (SELECT *, close / lag(close) OVER w - 1 AS return_1, ln(close) - ln(lag(close) OVER w) AS log_return_1,
        greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W}),
      y AS (SELECT *, {_per_window}, volume / lag(volume) OVER w - 1 AS volume_change_1, volume / {_rolled('avg', 'volume', 20)} AS relative_volume_20 FROM x {W})
      SELECT {OHLC}, {r(*QUANT)} FROM y"""
)
def quant_features(spark, sf_dir):
    out = bar_ops.quant_features(a.bars(spark, sf_dir), (3, 5))
    return rounded(out.select(*OHLC.split(", "), *QUANT))


DATASET = ["ret_1", "ret_3", "ret_5", "vol_10", "close_to_ma10", "range_pct", "volume_ratio_20"]


@register(
    f"""WITH {a.BARS}, x AS (SELECT *, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 3) OVER w - 1 AS ret_3, close / lag(close, 5) OVER w - 1 AS ret_5 FROM bars {W}),
      y AS (SELECT *, {_rolled('stddev_samp', 'ret_1', 10, 5)} AS vol_10, close / {_rolled('avg', 'close', 10, 5)} - 1 AS close_to_ma10, (high - low) / close AS range_pct, volume / {_rolled('avg', 'volume', 20, 10)} AS volume_ratio_20 FROM x)
      SELECT {OHLC}, {r(*DATASET)} FROM y"""
)
def dataset_features(spark, sf_dir):
    return rounded(bar_ops.dataset_features(a.bars(spark, sf_dir)).select(*OHLC.split(", "), *DATASET))


@register(
    f"""WITH {a.BARS}, x AS (SELECT *, close / lag(close) OVER w - 1 AS rr FROM bars {W}), y AS (SELECT *, {_rolled('stddev_samp', 'rr', 5)} AS sd FROM x),
      z AS (SELECT *, (close / lag(close, 5) OVER w - 1) / nullif(sd, 0) AS trend_strength, sd * sqrt(5.0) AS realized_vol FROM y {W}),
      v AS (SELECT *, (realized_vol - {_rolled('avg', 'realized_vol', 60)}) / nullif({_rolled('stddev_samp', 'realized_vol', 60)}, 0) AS vol_regime_z FROM z)
      SELECT symbol, timestamp, {r('trend_strength', 'realized_vol', 'vol_regime_z')}, CASE WHEN trend_strength > 1 THEN 'bull_trend' WHEN trend_strength < -1 THEN 'bear_trend' ELSE 'range_or_unclear' END AS regime_label FROM v"""
)
def regime_features(spark, sf_dir):
    return rounded(bar_ops.regime_features(a.bars(spark, sf_dir), 5).select("symbol", "timestamp", "trend_strength", "realized_vol", "vol_regime_z", "regime_label"))


_LABEL = "lead(open) OVER w AS entry_price, lead(timestamp) OVER w AS entry_timestamp, lead(timestamp, 3) OVER w AS target_timestamp, lead(close, 3) OVER w AS exit_price, lead(close, 3) OVER w / lead(open) OVER w - 1 AS target_return"


@register(f"WITH {a.BARS}, x AS (SELECT *, {_LABEL} FROM bars {W}) SELECT symbol, timestamp, entry_price, entry_timestamp, target_timestamp, exit_price, {r('target_return')}, coalesce((target_return > 0)::INT, 0) AS forward_positive FROM x")
def forward_label(spark, sf_dir):
    out = bar_ops.forward_target(a.bars(spark, sf_dir))
    return rounded(out.select("symbol", "timestamp", "entry_price", "entry_timestamp", "target_timestamp", "exit_price", "target_return", "forward_positive"))


@register(f"WITH {a.BARS}, x AS (SELECT *, {_LABEL} FROM bars {W}) SELECT symbol, timestamp, round(target_return, {DIGITS}) AS forward_return_3d, (target_return > 0)::INT AS positive_3d_return, target_return IS NOT NULL AS label_available FROM x")
def three_day_label(spark, sf_dir):
    return rounded(bar_ops.three_day_labels(a.bars(spark, sf_dir)).select("symbol", "timestamp", "forward_return_3d", "positive_3d_return", "label_available"))


def _ny(hour: str) -> str:
    return f"timezone('UTC', timezone('America/New_York', date_trunc('day', timestamp)::TIMESTAMP + INTERVAL '{hour}'))"


@register(
    f"""WITH {a.BARS}, x AS (SELECT *, {_ny('16 hours')} AS decision_time, {_ny('9 hours 30 minutes')} AS open_time FROM bars)
      SELECT symbol, timestamp, decision_time, lead(open_time) OVER w AS entry_time, lead(decision_time, 3) OVER w AS target_time, round(lead(close, 3) OVER w / lead(open) OVER w - 1, {DIGITS}) AS forward_return_3d FROM x {W}"""
)
def session_times(spark, sf_dir):
    return rounded(bar_ops.us_equity_labels(a.bars(spark, sf_dir)).select("symbol", "timestamp", "decision_time", "entry_time", "target_time", "forward_return_3d"))


@register(f"WITH {a.BARS} SELECT symbol, timestamp AS decision_time, lead(timestamp) OVER w AS entry_time, lead(timestamp, 3) OVER w AS target_time, round(lead(close, 3) OVER w / lead(open) OVER w - 1, {DIGITS}) AS forward_return_3d FROM bars {W}")
def generic_session_label(spark, sf_dir):
    return rounded(bar_ops.generic_labels(a.bars(spark, sf_dir)).select("symbol", "decision_time", "entry_time", "target_time", "forward_return_3d"))


# as-of joins ----------------------------------------------------------------


@register(
    f"""WITH {a.DECISIONS}, {a.NEWS} SELECT event_id, symbol, decision_time, n.timestamp AS pit_time, n.sentiment AS pit_sentiment
      FROM decisions d ASOF LEFT JOIN news n ON d.symbol = n.asset AND d.decision_time >= n.timestamp"""
)
def asof_backward(spark, sf_dir):
    right = a.news(spark, sf_dir).withColumnRenamed("asset", "symbol")
    out = temporal.asof_join(a.decisions(spark, sf_dir), right, ["symbol"], "decision_time", "timestamp", ["sentiment"])
    return out.select("event_id", "symbol", "decision_time", "pit_time", "pit_sentiment")


@register(
    f"""WITH {a.DECISIONS}, {a.NEWS}, j AS (SELECT n.timestamp AS t FROM decisions d ASOF LEFT JOIN news n ON d.symbol = n.asset AND d.decision_time >= n.timestamp)
      SELECT count(*) AS rows, count(t) AS matched, count(*) - count(t) AS unmatched FROM j"""
)
def asof_match_report(spark, sf_dir):
    return temporal.match_report(asof_backward(spark, sf_dir))


@register(
    f"""WITH {a.BARS}, {a.NEWS}, b AS (SELECT *, lead(close, 1) OVER w / close - 1 AS r1, lead(close, 3) OVER w / close - 1 AS r3 FROM bars {W})
      SELECT n.asset AS symbol, n.timestamp, b.timestamp AS base_time, b.close AS base_close, round(r1, {DIGITS}) AS return_1, round(r3, {DIGITS}) AS return_3
      FROM news n ASOF JOIN b ON n.asset = b.symbol AND n.timestamp <= b.timestamp"""
)
def asof_forward_event_study(spark, sf_dir):
    events = a.news(spark, sf_dir).select(F.col("asset").alias("symbol"), "timestamp")
    return rounded(news_ops.event_study(events, a.bars(spark, sf_dir), (1, 3)), "base_close")


_BY_PERIOD = f"""WITH {a.FACTS}, {a.FACT_DECISIONS}, p AS (SELECT DISTINCT cik, metric, "start", "end" FROM facts), g AS (SELECT d.cik, d.decision_time, metric, "start", "end" FROM fact_decisions d JOIN p USING (cik)),
  j AS (SELECT g.*, f.information_time AS pit_time, f.val_num AS pit_val_num FROM g ASOF LEFT JOIN (SELECT *, coalesce("start", TIMESTAMP '1900-01-01') AS s FROM facts) f
        ON g.cik = f.cik AND g.metric = f.metric AND coalesce(g."start", TIMESTAMP '1900-01-01') = f.s AND g."end" = f."end" AND g.decision_time >= f.information_time)"""


@register(_BY_PERIOD + """ SELECT cik, decision_time, metric, "start", "end", pit_time, pit_val_num, pit_time IS NOT NULL AS available FROM j""")
def asof_by_period(spark, sf_dir):
    out = temporal.asof_by_period(a.fact_decisions(spark, sf_dir), a.facts(spark, sf_dir), identity=("metric", "start", "end"))
    return out.select("cik", "decision_time", "metric", "start", "end", "pit_time", "pit_val_num", "available")


@register(_BY_PERIOD + f""" SELECT cik, metric, count(*) AS rows, count(pit_time) AS known, round(avg(epoch(decision_time - pit_time) / 86400.0), {DIGITS}) AS mean_age_days FROM j GROUP BY cik, metric""")
def observation_ages(spark, sf_dir):
    from tidemark.schema import days_between

    out = asof_by_period(spark, sf_dir).withColumn("age", days_between(F.col("decision_time"), F.col("pit_time")))
    return rounded(out.groupBy("cik", "metric").agg(F.count(F.lit(1)).alias("rows"), F.count("pit_time").alias("known"), F.avg("age").alias("mean_age_days")))


@register(
    f"""WITH {a.FACTS}, {a.FACT_DECISIONS}, k AS (SELECT DISTINCT cik, metric, unit FROM facts), g AS (SELECT d.cik, decision_time, metric, unit FROM fact_decisions d JOIN k USING (cik)),
      l AS (SELECT cik, metric, unit, information_time, arg_max(val_num, ("end", val_num)) AS v FROM facts GROUP BY 1, 2, 3, 4)
      SELECT g.cik, g.metric, g.decision_time, l.information_time AS pit_time, l.v AS pit_val_num FROM g ASOF LEFT JOIN l ON g.cik = l.cik AND g.metric = l.metric AND g.unit = l.unit AND g.decision_time >= l.information_time"""
)
def asof_latest(spark, sf_dir):
    facts = a.facts(spark, sf_dir)
    grid = a.fact_decisions(spark, sf_dir).join(facts.select("cik", "metric", "unit").distinct(), "cik")
    out = temporal.asof_join(grid, facts, ["cik", "metric", "unit"], "decision_time", "information_time", ["val_num"], ["end", "val_num"])
    return out.select("cik", "metric", "decision_time", "pit_time", "pit_val_num")


@register(_BY_PERIOD + " SELECT count(*) AS leaks FROM j WHERE pit_time > decision_time")
def leakage_guard(spark, sf_dir):
    return temporal.leaks(asof_by_period(spark, sf_dir)).agg(F.count(F.lit(1)).alias("leaks"))


@register(f"WITH {a.DECISIONS} SELECT row_number() OVER (ORDER BY symbol, decision_time, event_id) - 1 AS _decision_id, event_id, symbol, decision_time FROM decisions")
def number_decisions(spark, sf_dir):
    out = temporal.number_decisions(a.decisions(spark, sf_dir), ["symbol", "decision_time", "event_id"])
    return out.select(F.col("_decision_id").cast("long").alias("_decision_id"), "event_id", "symbol", "decision_time")


# news -------------------------------------------------------------------------


@register(
    f"""WITH {a.BARS}, {a.NEWS} SELECT symbol, b.timestamp, count(n.timestamp) AS news_count_24h, round(coalesce(avg(n.sentiment), 0), {DIGITS}) AS sentiment_mean_24h,
      round(coalesce(avg(n.sentiment_change) + avg(n.surprise), 0), {DIGITS}) AS sentiment_shock_24h
      FROM bars b LEFT JOIN news n ON b.symbol = n.asset AND n.timestamp <= b.timestamp AND n.timestamp > b.timestamp - INTERVAL 24 HOUR GROUP BY symbol, b.timestamp"""
)
def news_window_join(spark, sf_dir):
    out = news_ops.news_window(a.bars(spark, sf_dir), a.news(spark, sf_dir))
    return rounded(out.select("symbol", "timestamp", "news_count_24h", "sentiment_mean_24h", "sentiment_shock_24h"))


_STATE = f"""WITH {a.BARS}, {a.NEWS}, s AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY timestamp, sentiment) AS n, avg(sentiment) OVER (PARTITION BY asset ORDER BY timestamp, sentiment ROWS 19 PRECEDING) AS m20,
  avg(surprise) OVER (PARTITION BY asset ORDER BY timestamp, sentiment ROWS 19 PRECEDING) AS event_surprise FROM news)"""


@register(
    _STATE + f""" SELECT b.symbol, b.timestamp, s.sentiment AS sentiment_mean, round(s.sentiment - m20, {DIGITS}) AS sentiment_shock, CASE WHEN n IS NULL THEN 0 ELSE least(n, 20) END AS sentiment_count, round(event_surprise, {DIGITS}) AS event_surprise
      FROM bars b ASOF LEFT JOIN s ON b.symbol = s.asset AND b.timestamp >= s.timestamp"""
)
def sentiment_last20(spark, sf_dir):
    out = news_ops.sentiment_state(a.bars(spark, sf_dir), a.news(spark, sf_dir))
    return rounded(out.select("symbol", "timestamp", "sentiment_mean", "sentiment_shock", "sentiment_count", "event_surprise"))


@register(
    _STATE + f""", w AS (SELECT x.asset, x.timestamp, x.n, sum(y.sentiment * power(1 - 2 / (least(x.n, 10) + 1), x.n - y.n)) / sum(power(1 - 2 / (least(x.n, 10) + 1), x.n - y.n)) AS e
        FROM s x JOIN s y ON x.asset = y.asset AND y.n <= x.n AND x.n - y.n < 160 GROUP BY 1, 2, 3)
      SELECT b.symbol, b.timestamp, round(e, {DIGITS}) AS sentiment_ewm FROM bars b ASOF LEFT JOIN w ON b.symbol = w.asset AND b.timestamp >= w.timestamp"""
)
def sentiment_ewm(spark, sf_dir):
    out = news_ops.sentiment_state(a.bars(spark, sf_dir), a.news(spark, sf_dir))
    return rounded(out.select("symbol", "timestamp", "sentiment_ewm"))


# facts -------------------------------------------------------------------------

_KEYS = 'cik, metric, unit, "start", "end"'
MOMENT = "TIMESTAMP '1999-06-15 00:00:00'"
MOMENT_NTZ = "TIMESTAMP_NTZ '1999-06-15 00:00:00'"


@register(f'WITH {a.FACTS} SELECT {_KEYS}, information_time, val_num FROM facts QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY information_time DESC, val_num DESC) = 1')
def latest_revision(spark, sf_dir):
    return fact_ops.latest_revision(a.facts(spark, sf_dir)).select(*fact_ops.IDENTITY, "information_time", "val_num")


@register(f"WITH {a.FACTS} SELECT {_KEYS}, information_time, val_num FROM facts WHERE information_time <= {MOMENT} AND metric IN ('revenue', 'assets') QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY information_time DESC, val_num DESC) = 1")
def latest_asof(spark, sf_dir):
    return fact_ops.latest_asof(a.facts(spark, sf_dir), F.expr(MOMENT_NTZ), metrics=["revenue", "assets"]).select(*fact_ops.IDENTITY, "information_time", "val_num")


@register(
    f"""WITH {a.FACTS}, c AS (SELECT * FROM facts WHERE information_time <= {MOMENT} QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY information_time DESC, val_num DESC) = 1)
      SELECT {_KEYS}, information_time, val_num FROM c QUALIFY "end" = max("end") OVER (PARTITION BY cik, metric, unit)"""
)
def latest_period(spark, sf_dir):
    return fact_ops.latest_period(a.facts(spark, sf_dir), F.expr(MOMENT_NTZ)).select(*fact_ops.IDENTITY, "information_time", "val_num")


_TAGGED = "CASE WHEN lines % 3 = 0 THEN 'Revenues' WHEN lines % 3 = 1 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'NetIncomeLoss' END"
_CANON = f"""WITH {a.FACTS}, t AS (SELECT cik, unit, TIMESTAMP '1995-01-01' AS "start", "end", date_trunc('year', information_time)::TIMESTAMP AS information_time, val_num, {_TAGGED} AS tag, CASE WHEN lines <> 5 THEN lines::VARCHAR END AS accn FROM facts),
  m AS (SELECT *, CASE tag WHEN 'NetIncomeLoss' THEN 'net_income' ELSE 'revenue' END AS metric, CASE tag WHEN 'Revenues' THEN 10 ELSE 20 END AS p FROM t)"""


def _tagged(spark, sf_dir):
    f = a.facts(spark, sf_dir)
    return f.select(
        "cik", "unit", F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'").alias("start"), "end", F.date_trunc("year", "information_time").cast("timestamp_ntz").alias("information_time"), "val_num",
        F.expr(_TAGGED).alias("tag"), F.when(F.col("lines") != 5, F.col("lines").cast("string")).alias("accn"),
    )


@register(_CANON + f""" SELECT {_KEYS}, information_time, val_num, tag, p AS tag_precedence, CASE WHEN floor(epoch("end" - "start") / 86400) = 0 THEN 'instant' WHEN floor(epoch("end" - "start") / 86400) BETWEEN 300 AND 380 THEN 'annual' ELSE 'duration' END AS period_type
  FROM m QUALIFY row_number() OVER (PARTITION BY {_KEYS}, information_time ORDER BY p DESC, tag DESC, accn DESC NULLS FIRST, val_num DESC) = 1""")
def canonical_resolve(spark, sf_dir):
    out = fact_ops.resolve_observations(_tagged(spark, sf_dir))
    return out.select(*fact_ops.IDENTITY, "information_time", "val_num", "tag", "tag_precedence", "period_type")


@register(
    _CANON
    + f""", g AS (SELECT count(*) AS n FROM m GROUP BY {_KEYS}, information_time),
      x AS (SELECT count(*) AS n FROM m GROUP BY cik, tag, unit, "start", "end", information_time, accn, val_num)
      SELECT (SELECT count(*) FROM t) AS input_rows,
        (SELECT count(*) FROM m) AS eligible_rows,
        (SELECT count(DISTINCT cik) FROM m) AS ciks,
        count(*) AS output_rows,
        coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS collision_rows,
        (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM x) AS exact_source_duplicates,
        (SELECT count(*) FROM m) - count(*) AS rows_reduced
      FROM g"""
)
def canonical_report(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    return fact_ops.resolve_report(rows, fact_ops.with_metric(rows), fact_ops.resolve_observations(rows))


@register(
    """WITH s AS (SELECT o_custkey AS cik, o_orderkey % 50 AS accn, o_orderkey AS position, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS acceptance_time, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate + INTERVAL 1 DAY END AS filing_date FROM orders),
      l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cik, accn ORDER BY position DESC) = 1)
      SELECT f.l_orderkey, f.cik, f.accn, coalesce(l.acceptance_time, l.filing_date, f.filed) AS information_time FROM (SELECT l_orderkey, l_suppkey AS cik, l_partkey % 50 AS accn, l_shipdate AS filed FROM lineitem) f LEFT JOIN l USING (cik, accn)"""
)
def attach_information_time(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    subs = o.select(
        F.col("o_custkey").alias("cik"), (F.col("o_orderkey") % 50).alias("accn"), F.col("o_orderkey").alias("position"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("acceptance_time"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("filing_date"),
    )
    f = a.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("cik"), (F.col("l_partkey") % 50).alias("accn"), F.col("l_shipdate").alias("filed"))
    return fact_ops.attach_information_time(f, subs).select("l_orderkey", "cik", "accn", "information_time")


_DAYS = 'epoch("end" - "start") / 86400.0'
_SEMANTIC = f"""x AS (SELECT *, "start" IS NULL OR metric = 'assets' AS is_instant, {_DAYS} AS period_days FROM facts),
  sem AS (SELECT *, CASE WHEN NOT is_instant THEN CASE WHEN period_days BETWEEN 70 AND 120 THEN 'quarter' WHEN period_days BETWEEN 150 AND 210 THEN 'half_year' WHEN period_days BETWEEN 240 AND 300 THEN 'nine_month'
    WHEN period_days BETWEEN 320 AND 390 THEN 'annual' ELSE 'other_duration' END END AS duration_kind FROM x)"""


@register(
    f"""WITH {a.FACTS}, {_SEMANTIC} SELECT cik, metric, "start", "end", information_time, round(period_days, {DIGITS}) AS period_days, CASE WHEN is_instant THEN 'instant' ELSE 'duration' END AS reporting_kind, duration_kind,
      coalesce(duration_kind = 'quarter', FALSE) AS is_quarter, coalesce(duration_kind = 'annual', FALSE) AS is_annual, is_instant, 'sec_' || metric || '_' || coalesce(duration_kind, 'instant') AS feature_name FROM sem"""
)
def period_semantics(spark, sf_dir):
    out = fact_ops.period_semantics(a.facts(spark, sf_dir))
    return rounded(out.select("cik", "metric", "start", "end", "information_time", "period_days", "reporting_kind", "duration_kind", "is_quarter", "is_annual", "is_instant", "feature_name"))


_GROWN = f"""WITH {a.FACTS}, {_SEMANTIC}, q AS (SELECT *, count(*) OVER (PARTITION BY cik, metric, unit) AS raw FROM sem WHERE duration_kind = 'quarter'),
  l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY information_time DESC, val_num DESC) = 1),
  n AS (SELECT *, date_diff('day', lag("end") OVER w, "end") AS gap, lag(val_num) OVER w AS pv, lag(val_num, 4) OVER w AS yv, date_diff('day', lag("end", 4) OVER w, "end") AS yspan FROM l WINDOW w AS (PARTITION BY cik, metric, unit ORDER BY "end")),
  grown AS (SELECT *, CASE WHEN gap BETWEEN 70 AND 110 THEN val_num / nullif(pv, 0) - 1 END AS qoq_growth, CASE WHEN yspan BETWEEN 300 AND 430 AND raw >= 5 THEN val_num / nullif(yv, 0) - 1 END AS yoy_growth,
    CASE WHEN raw >= 4 AND count(*) OVER (v ROWS 3 PRECEDING) = 4 AND sum(CASE WHEN gap BETWEEN 70 AND 110 THEN 1 ELSE 0 END) OVER (v ROWS 2 PRECEDING) = 3 THEN sum(val_num) OVER (v ROWS 3 PRECEDING) END AS ttm
    FROM n WINDOW v AS (PARTITION BY cik, metric, unit ORDER BY "end"))"""


@register(_GROWN + f""" SELECT f.cik, f.metric, f."start", f."end", f.information_time, {r('qoq_growth', 'yoy_growth')}, round(ttm, 2) AS ttm, ttm IS NOT NULL AS ttm_available
  FROM facts f LEFT JOIN grown g ON f.cik = g.cik AND f.metric = g.metric AND f."start" IS NOT DISTINCT FROM g."start" AND f."end" = g."end" AND f.information_time = g.information_time""")
def derived_growth(spark, sf_dir):
    out = fact_ops.derived_features(a.facts(spark, sf_dir)).withColumn("ttm", F.round("ttm", 2))
    return rounded(out.select("cik", "metric", "start", "end", "information_time", "qoq_growth", "yoy_growth", "ttm", "ttm_available"))


@register(
    f"""WITH {a.FACTS}, c AS (SELECT * FROM facts WHERE information_time <= {MOMENT} QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY information_time DESC, val_num DESC) = 1),
      y AS (SELECT cik, metric, CASE WHEN metric = 'assets' THEN NULL ELSE "end" - INTERVAL 365 DAY END AS "start", "end", unit, information_time, val_num FROM c),
      n AS (SELECT * FROM y WHERE cik IS NOT NULL AND ("start" IS NULL OR {_DAYS} BETWEEN 300 AND 380) QUALIFY row_number() OVER (PARTITION BY cik, metric ORDER BY "end" DESC, information_time DESC, unit DESC, val_num DESC) = 1)
      SELECT cik, max(val_num) FILTER (metric = 'assets') AS assets, max(val_num) FILTER (metric = 'net_income') AS net_income, max(val_num) FILTER (metric = 'revenue') AS revenue,
        round(max(val_num) FILTER (metric = 'net_income') / nullif(max(val_num) FILTER (metric = 'revenue'), 0), {DIGITS}) AS net_margin FROM n GROUP BY cik"""
)
def fundamental_snapshot(spark, sf_dir):
    current = fact_ops.latest_asof(a.facts(spark, sf_dir), F.expr(MOMENT_NTZ))
    yearly = current.withColumn("start", F.when(F.col("metric") != "assets", F.col("end") - F.expr("INTERVAL 365 DAY")))
    return rounded(fact_ops.fundamental_snapshot(yearly, a.METRICS).select("cik", *a.METRICS, "net_margin"))


@register(
    """WITH u AS (SELECT DISTINCT ' ' || lower(s_name) || '.us' AS symbol FROM supplier UNION ALL SELECT 'Customer#000000001.x'), e AS (SELECT s_nationkey AS cik, string_agg(s_name, ';' ORDER BY s_name) AS tickers FROM supplier GROUP BY 1 UNION ALL SELECT 999, 'Supplier#000000001;Supplier#000000002'),
      x AS (SELECT cik, split_part(upper(trim(unnest(string_split(tickers, ';')))), '.', 1) AS ticker FROM e), d AS (SELECT DISTINCT cik, ticker FROM x WHERE ticker <> ''),
      j AS (SELECT symbol, split_part(upper(trim(symbol)), '.', 1) AS ticker_root, cik FROM u JOIN d ON d.ticker = split_part(upper(trim(symbol)), '.', 1))
      SELECT *, count(*) OVER (PARTITION BY symbol) AS cik_count, CASE WHEN count(*) OVER (PARTITION BY symbol) = 1 THEN 'unique' ELSE 'ambiguous' END AS mapping_status FROM j"""
)
def universe_map(spark, sf_dir):
    s = a.table(spark, sf_dir, "supplier")
    universe = s.select(F.concat(F.lit(" "), F.lower("s_name"), F.lit(".us")).alias("symbol")).distinct().unionAll(spark.range(1).select(F.lit("Customer#000000001.x").alias("symbol")))
    entities = s.groupBy(F.col("s_nationkey").alias("cik")).agg(F.array_join(F.array_sort(F.collect_list("s_name")), ";").alias("tickers"))
    entities = entities.unionAll(spark.range(1).select(F.lit(999).alias("cik"), F.lit("Supplier#000000001;Supplier#000000002").alias("tickers")))
    return fact_ops.universe_map(universe, entities).select("symbol", "ticker_root", "cik", "cik_count", "mapping_status")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(spark, sf_dir):
    keys = a.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return a.table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_filter(spark, sf_dir):
    keys = a.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return a.table(spark, sf_dir, "customer").join(keys, "c_custkey", "left_anti").select("c_custkey", "c_name")


# macro -------------------------------------------------------------------------

_AVAILABLE = "known AS (SELECT *, date_trunc('day', realtime_start + INTERVAL 1 DAY)::TIMESTAMP AS available_date_conservative FROM vintages)"


@register(f"WITH {a.VINTAGES}, {_AVAILABLE} SELECT series_id, date, value, realtime_start FROM known WHERE available_date_conservative <= {MOMENT} QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY realtime_start DESC, value DESC) = 1")
def latest_vintage(spark, sf_dir):
    return macro.latest_vintage(a.vintages(spark, sf_dir), F.expr(MOMENT_NTZ)).select("series_id", "date", "value", "realtime_start")


_ALIGN = f"""WITH {a.VINTAGES}, {_AVAILABLE}, {a.DECISIONS}, dd AS (SELECT event_id, decision_time + INTERVAL '-9130' DAY AS decision_time FROM decisions), days AS (SELECT DISTINCT date_trunc('day', decision_time)::TIMESTAMP AS d FROM dd), ids AS (SELECT DISTINCT series_id FROM vintages),
  al AS (SELECT d, i.series_id, max({{'date': date, 'known': available_date_conservative, 'rt': realtime_start, 'value': value}}) AS b FROM days CROSS JOIN ids i LEFT JOIN known k ON k.series_id = i.series_id AND k.available_date_conservative <= d GROUP BY 1, 2)"""


def _macro_decisions(spark, sf_dir):
    d = a.decisions(spark, sf_dir)
    return d.select("event_id", (F.col("decision_time") - F.expr("INTERVAL 9130 DAY")).alias("decision_time"))


@register(_ALIGN + " SELECT event_id, decision_time, series_id, b.date AS macro_date, b.value AS macro_value, b.rt AS macro_realtime_start, b.date IS NOT NULL AS available FROM dd JOIN al ON al.d = date_trunc('day', decision_time)::TIMESTAMP")
def macro_align(spark, sf_dir):
    out = macro.macro_align(_macro_decisions(spark, sf_dir), a.vintages(spark, sf_dir), a.SERIES)
    return out.select("event_id", "decision_time", "series_id", "macro_date", "macro_value", "macro_realtime_start", "available")


@register(
    _ALIGN + " SELECT event_id, " + ", ".join(f"max(b.value) FILTER (series_id = '{s}') AS \"macro_{s}\", max(date_diff('day', b.date, decision_time)) FILTER (series_id = '{s}') AS \"macro_{s}_age_days\"" for s in a.SERIES)
    + " FROM dd JOIN al ON al.d = date_trunc('day', decision_time)::TIMESTAMP GROUP BY event_id"
)
def macro_wide(spark, sf_dir):
    return macro.macro_wide(_macro_decisions(spark, sf_dir), a.vintages(spark, sf_dir), a.SERIES, "event_id")


@register(
    f"""WITH {a.VINTAGES}, v AS (SELECT count(DISTINCT realtime_start) AS n FROM vintages GROUP BY series_id, date), g AS (SELECT count(*) AS n FROM vintages GROUP BY series_id, date, realtime_start)
      SELECT (SELECT count(*) FROM vintages) AS rows, (SELECT count(*) FROM vintages WHERE value IS NULL) AS null_values, (SELECT count(*) FROM vintages WHERE realtime_end < realtime_start) AS inverted_windows,
        (SELECT count(DISTINCT realtime_start) FROM vintages) AS vintages, (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM g) AS duplicate_rows, (SELECT count(*) FROM v WHERE n > 1) AS revised_dates, 'PASS' AS status"""
)
def macro_audit(spark, sf_dir):
    return macro.audit_vintages(a.vintages(spark, sf_dir))


# panel ----------------------------------------------------------------------------


def _sec_decisions(spark, sf_dir):
    d = a.fact_decisions(spark, sf_dir)
    return d.withColumn("_decision_id", F.concat_ws("|", F.col("cik").cast("string"), F.date_format("decision_time", "yyyy-MM-dd")))


_SNAP = f"""WITH {a.FACTS}, {a.FACT_DECISIONS}, {_SEMANTIC}, k AS (SELECT d.cik, d.decision_time, s.* EXCLUDE (cik) FROM fact_decisions d JOIN sem s ON s.cik = d.cik AND s.information_time <= d.decision_time),
  rawn AS (SELECT *, sum((duration_kind = 'quarter')::INT) OVER (PARTITION BY cik, decision_time, metric, unit) AS raw FROM k),
  cur AS (SELECT * FROM rawn QUALIFY row_number() OVER (PARTITION BY decision_time, {_KEYS} ORDER BY information_time DESC, val_num DESC) = 1),
  inst AS (SELECT cik, decision_time, metric, arg_max(val_num, "end") AS v, arg_max(information_time, "end") AS t FROM cur WHERE is_instant GROUP BY 1, 2, 3),
  qn AS (SELECT *, date_diff('day', lag("end") OVER w, "end") AS gap, lag(val_num) OVER w AS pv, lag(val_num, 4) OVER w AS yv, date_diff('day', lag("end", 4) OVER w, "end") AS yspan FROM cur WHERE duration_kind = 'quarter' WINDOW w AS (PARTITION BY cik, decision_time, metric, unit ORDER BY "end")),
  qg AS (SELECT *, CASE WHEN gap BETWEEN 70 AND 110 THEN val_num / nullif(pv, 0) - 1 END AS qoq, CASE WHEN yspan BETWEEN 300 AND 430 AND raw >= 5 THEN val_num / nullif(yv, 0) - 1 END AS yoy,
    CASE WHEN raw >= 4 AND count(*) OVER (v ROWS 3 PRECEDING) = 4 AND sum(CASE WHEN gap BETWEEN 70 AND 110 THEN 1 ELSE 0 END) OVER (v ROWS 2 PRECEDING) = 3 THEN sum(val_num) OVER (v ROWS 3 PRECEDING) END AS ttm FROM qn WINDOW v AS (PARTITION BY cik, decision_time, metric, unit ORDER BY "end")),
  ql AS (SELECT * FROM qg QUALIFY row_number() OVER (PARTITION BY cik, decision_time, metric ORDER BY "end" DESC) = 1),
  wide AS (SELECT d.cik, d.decision_time, i.v AS sec_assets_instant, epoch(d.decision_time - i.t) / 86400.0 AS sec_assets_instant_age_days, q.val_num AS sec_revenue_quarter, epoch(d.decision_time - q.information_time) / 86400.0 AS sec_revenue_quarter_age_days,
    q.qoq AS sec_revenue_qoq_growth, q.yoy AS sec_revenue_yoy_growth, q.ttm AS sec_revenue_ttm FROM fact_decisions d LEFT JOIN inst i ON i.cik = d.cik AND i.decision_time = d.decision_time AND i.metric = 'assets' LEFT JOIN ql q ON q.cik = d.cik AND q.decision_time = d.decision_time AND q.metric = 'revenue')"""
_SEC = ["sec_assets_instant_age_days", "sec_revenue_quarter_age_days", "sec_revenue_qoq_growth", "sec_revenue_yoy_growth"]


@register(_SNAP + f" SELECT cik || '|' || strftime(decision_time, '%Y-%m-%d') AS _decision_id, sec_assets_instant, sec_revenue_quarter, round(sec_revenue_ttm, 2) AS sec_revenue_ttm, {r(*_SEC)} FROM wide")
def sec_features_wide(spark, sf_dir):
    out = panel.sec_features(_sec_decisions(spark, sf_dir), a.facts(spark, sf_dir), a.METRICS).withColumn("sec_revenue_ttm", F.round("sec_revenue_ttm", 2))
    return rounded(out.select("_decision_id", "sec_assets_instant", "sec_revenue_quarter", "sec_revenue_ttm", *_SEC))


def _panel_inputs(spark, sf_dir):
    """Monthly bars of suppliers, so that bars, facts and vintages share one calendar."""
    li = a.table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("symbol"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("timestamp"))
    monthly = g.agg(F.min("l_extendedprice").alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return monthly, a.facts(spark, sf_dir), a.vintages(spark, sf_dir), a.master(spark, sf_dir)


_MONTHLY = "mb AS (SELECT 's' || l_suppkey AS symbol, l_suppkey AS cik, date_trunc('month', l_shipdate)::TIMESTAMP AS timestamp, min(l_extendedprice) AS open, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2, 3)"
_PANEL = (
    _SNAP.replace(a.FACT_DECISIONS, f"{_MONTHLY}, lab AS (SELECT *, {_ny('16 hours')} AS decision_time, lead(close, 3) OVER w / lead(open) OVER w - 1 AS fr FROM mb {W}), ok AS (SELECT * FROM lab WHERE fr IS NOT NULL), fact_decisions AS (SELECT DISTINCT cik, decision_time FROM ok)")
    + f""", {a.VINTAGES}, {_AVAILABLE}, mac AS (SELECT d, max({{'date': date, 'known': available_date_conservative, 'rt': realtime_start, 'value': value}}) AS b FROM (SELECT DISTINCT date_trunc('day', decision_time)::TIMESTAMP AS d FROM ok) JOIN known ON available_date_conservative <= d WHERE series_id = '5-LOW' GROUP BY d)"""
)


@register(
    _PANEL + f""" SELECT ok.symbol, ok.timestamp, ok.decision_time, ok.cik, round(fr, {DIGITS}) AS forward_return_3d, sec_assets_instant, sec_revenue_quarter, round(sec_revenue_ttm, 2) AS sec_revenue_ttm, {r(*_SEC)}, mac.b.value AS "macro_5-LOW"
      FROM ok LEFT JOIN wide ON wide.cik = ok.cik AND wide.decision_time = ok.decision_time LEFT JOIN mac ON mac.d = date_trunc('day', ok.decision_time)::TIMESTAMP"""
)
def unified_panel(spark, sf_dir):
    monthly, facts, vintages, master = _panel_inputs(spark, sf_dir)
    out = panel.unified_panel(monthly, facts, vintages, master, a.METRICS, a.SERIES).withColumn("sec_revenue_ttm", F.round("sec_revenue_ttm", 2))
    return rounded(out.select("symbol", "timestamp", "decision_time", "cik", "forward_return_3d", "sec_assets_instant", "sec_revenue_quarter", "sec_revenue_ttm", *_SEC, "macro_5-LOW"))


@register(
    f"""WITH {a.BARS}, {a.NEWS}, x AS (SELECT symbol, timestamp, close, {_LABEL} FROM bars {W})
      SELECT x.symbol, x.timestamp, x.close, round(target_return, {DIGITS}) AS target_return, n.timestamp AS pit_time, n.sentiment AS pit_sentiment FROM x ASOF LEFT JOIN news n ON x.symbol = n.asset AND x.timestamp >= n.timestamp"""
)
def flagship_panel(spark, sf_dir):
    """Daily bars, their forward label and the last news known at each bar."""
    labelled = bar_ops.forward_target(a.bars(spark, sf_dir))
    right = a.news(spark, sf_dir).withColumnRenamed("asset", "symbol")
    out = temporal.asof_join(labelled, right, ["symbol"], "timestamp", "timestamp", ["sentiment"])
    return rounded(out.select("symbol", "timestamp", "close", "target_return", "pit_time", "pit_sentiment"))


# audits and reference data ------------------------------------------------------------


@register(
    f"""WITH {a.BARS}, p AS (SELECT symbol, count(*) AS n, min(timestamp) AS s, max(timestamp) AS e FROM bars GROUP BY symbol)
      SELECT sum(n)::BIGINT AS rows, count(*) AS symbols, min(n) AS min_rows, median(n) AS median_rows, max(n) AS max_rows, min(s) AS start, max(e) AS "end", date_diff('day', min(s), max(e)) AS calendar_days,
        CASE WHEN count(*) < 5 OR min(n) < 5 THEN 'NOT_READY' WHEN date_diff('day', min(s), max(e)) < 730 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS status, NOT (count(*) < 5 OR min(n) < 5) AS ready_for_ml FROM p"""
)
def readiness(spark, sf_dir):
    return audits.readiness(a.bars(spark, sf_dir), min_rows=5)


_EVENTS_AS_FACTS = """ft AS (
  SELECT l_suppkey AS cik, l_returnflag AS metric, l_linestatus AS unit, NULL::TIMESTAMP AS "start", date_trunc('year', l_shipdate)::TIMESTAMP AS "end",
    l_shipdate AS information_time, 'T' AS tag, 'T' AS taxonomy, l_linenumber AS accn, l_quantity AS val_num,
    date_trunc('month', l_shipdate)::TIMESTAMP AS filed, CASE WHEN l_orderkey % 3 = 0 THEN '10-K' ELSE '10-Q' END AS form
  FROM lineitem)"""


def _lineitem_facts(spark, sf_dir):
    li = a.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("cik"), F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("unit"),
        F.lit(None).cast("timestamp_ntz").alias("start"), F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("end"),
        F.col("l_shipdate").alias("information_time"), F.lit("T").alias("tag"), F.lit("T").alias("taxonomy"), F.col("l_linenumber").alias("accn"), F.col("l_quantity").alias("val_num"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("filed"), F.when(F.col("l_orderkey") % 3 == 0, "10-K").otherwise("10-Q").alias("form"),
    )


_E6 = 'cik, metric, unit, "start", "end", information_time'
_SOURCE_COLUMNS = 'cik, taxonomy, tag, unit, "start", "end", filed, form, accn, val_num, information_time'


@register(
    f"""WITH {_EVENTS_AS_FACTS},
      x AS (SELECT count(*) AS d FROM (SELECT DISTINCT {_E6}, accn, form, filed, val_num FROM ft)),
      e AS (SELECT count(*) AS d FROM (SELECT DISTINCT {_E6} FROM ft)),
      c AS (
        SELECT count(*) AS rows, count(DISTINCT cik) AS ciks,
          count(*) - count(information_time) AS null_information_time, count(*) - count(val_num) AS null_values,
          count(*) FILTER (information_time > filed + INTERVAL 1 DAY) AS late_rows,
          min(information_time) AS first_time, max(information_time) AS last_time,
          0::BIGINT AS time_parse_failures, count(*) - count("start") AS null_start, count(*) - count(accn) AS null_accn,
          count(*) - (SELECT d FROM x) AS exact_duplicates, count(*) - (SELECT d FROM e) AS economic_duplicates
        FROM ft)
      SELECT *,
        CASE WHEN rows = 0 OR null_information_time > 0 THEN 'FAIL'
          WHEN exact_duplicates > 0 OR economic_duplicates > 0 OR late_rows > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status,
        ((rows = 0)::INT + (null_information_time > 0)::INT + (exact_duplicates > 0)::INT + (economic_duplicates > 0)::INT + (late_rows > 0)::INT)::INT AS warnings
      FROM c"""
)
def audit_events(spark, sf_dir):
    row = audits.audit_facts(_lineitem_facts(spark, sf_dir))
    flat = row.withColumns({"null_start": F.col("required_nulls.start"), "null_accn": F.col("required_nulls.accn"), "warnings": F.size("warnings")})
    return flat.drop("required_nulls")


@register(
    f"""WITH {_EVENTS_AS_FACTS},
      g AS (
        SELECT 'source_exact' AS grain, count(*) AS d FROM (SELECT DISTINCT {_SOURCE_COLUMNS} FROM ft)
        UNION ALL SELECT 'metric_alias', count(*) FROM (SELECT DISTINCT {_E6}, accn FROM ft)
        UNION ALL SELECT 'economic', count(*) FROM (SELECT DISTINCT {_E6} FROM ft)),
      t AS (SELECT count(*) AS n FROM ft)
      SELECT grain, n AS rows, d AS distinct_keys, n - d AS duplicates, round((n - d) / n, {DIGITS}) AS rate FROM g, t"""
)
def duplicate_diagnostics(spark, sf_dir):
    return rounded(audits.duplicate_counts(_lineitem_facts(spark, sf_dir)))


@register("SELECT coalesce(o_orderpriority, 'NA') AS o_orderpriority, count(*) AS rows FROM orders GROUP BY 1 ORDER BY rows DESC, 1 LIMIT 3")
def top_forms(spark, sf_dir):
    return audits.histogram(a.table(spark, sf_dir, "orders"), "o_orderpriority", "NA", 3)


@register("SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def metric_histogram(spark, sf_dir):
    return audits.histogram(a.table(spark, sf_dir, "events"), "event_type")


@register(
    f"""WITH {a.MASTER} SELECT *, CASE WHEN violations = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT concat_ws(',', CASE WHEN (SELECT count(*) FROM (SELECT symbol FROM master GROUP BY symbol HAVING count(*) > 1)) > 0 THEN 'duplicate_symbols' END,
      CASE WHEN bool_or(security_type NOT IN ('common_equity', 'etf', 'leveraged_etf', 'inverse_etf', 'adr', 'preferred', 'fund', 'warrant', 'other')) THEN 'unsupported_security_type' END,
      CASE WHEN bool_or(is_common_equity AND (is_etf OR is_leveraged OR is_inverse)) THEN 'invalid_common_equity' END, CASE WHEN bool_or(is_leveraged AND security_type NOT IN ('leveraged_etf', 'etf')) THEN 'leveraged_conflict' END,
      CASE WHEN bool_or(is_inverse AND security_type NOT IN ('inverse_etf', 'etf')) THEN 'inverse_conflict' END) AS violations FROM master)"""
)
def security_master_validate(spark, sf_dir):
    return audits.validate_security_master(a.master(spark, sf_dir))


@register("SELECT upper(trim(o_orderpriority)) AS symbol, min(o_custkey) AS cik FROM orders GROUP BY 1")
def security_master_build(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("symbol"), F.col("o_custkey").alias("cik"), F.lit("other").alias("security_type"))
    return audits.build_security_master(rows).select("symbol", "cik")


@register(
    f"""WITH {a.BARS}, x AS (SELECT symbol, timestamp, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 3) OVER w - 1 AS ret_3, lead(close, 3) OVER w IS NOT NULL AS ok FROM bars {W})
      SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(timestamp) AS start, max(timestamp) AS "end", round(avg(ok::INT), {DIGITS}) AS label_rate, round(avg((ret_1 IS NULL)::INT), {DIGITS}) AS null_ret_1, round(avg((ret_3 IS NULL)::INT), {DIGITS}) AS null_ret_3 FROM x"""
)
def null_fraction_report(spark, sf_dir):
    frame = bar_ops.dataset_features(bar_ops.three_day_labels(a.bars(spark, sf_dir)))
    return rounded(audits.panel_report(frame, ["ret_1", "ret_3"]))


@register(
    f"""WITH {a.BARS}, x AS (SELECT *, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp, close) - 1) > 0.5 AS jump FROM bars)
      SELECT count(*) AS rows, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high) OR least(open, high, low, close) <= 0) AS invalid_ohlc_rows, count(*) FILTER (jump) AS extreme_return_rows,
        0::BIGINT AS duplicate_keys, FALSE AS has_adjusted_close, 'equity' AS asset_class, 'PASS_WITH_WARNINGS' AS status FROM x"""
)
def market_audit(spark, sf_dir):
    return audits.audit_bars(a.bars(spark, sf_dir))


@register(f"WITH {a.BARS} SELECT substr(symbol, 1, 2) AS file, count(*) AS rows, string_agg(DISTINCT symbol, ';' ORDER BY symbol) AS symbols, min(timestamp) AS start, max(timestamp) AS \"end\" FROM bars GROUP BY 1")
def market_catalog(spark, sf_dir):
    return audits.catalog(a.bars(spark, sf_dir).withColumn("file", F.substring("symbol", 1, 2)))


_STATS = f"""WITH {a.BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS p, abs(close) * abs(volume) AS dollars FROM bars),
  st AS (SELECT symbol, count(*) AS rows, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, arg_max(close, timestamp) AS last_close, median(close) FILTER (p <= 10) AS median_close_lookback,
    median(dollars) FILTER (p <= 10) AS median_dollar_volume_lookback, avg(dollars) FILTER (p <= 10) AS avg_dollar_volume_lookback FROM x GROUP BY symbol)"""
_MEDIANS = ["last_close", "median_close_lookback", "median_dollar_volume_lookback", "avg_dollar_volume_lookback"]


@register(_STATS + f" SELECT symbol, rows, first_timestamp, last_timestamp, {r(*_MEDIANS)} FROM st")
def universe_statistics(spark, sf_dir):
    return rounded(audits.universe_statistics(a.bars(spark, sf_dir), 10).select("symbol", "rows", "first_timestamp", "last_timestamp", *_MEDIANS))


@register(
    _STATS + f""", e AS (SELECT symbol, rows, {r(*_MEDIANS)}, CASE WHEN rows < 25 THEN 'insufficient_history' WHEN last_close < 10 OR median_close_lookback < 10 THEN 'low_price' WHEN median_dollar_volume_lookback < 60 THEN 'low_liquidity' WHEN regexp_matches(symbol, '(?i)-WS|-WT|-WW|-WSA|-WTA|-UN|-U$|-R$|-P$|_') THEN 'obvious_non_common_symbol_pattern' END AS exclusion_reason, median_dollar_volume_lookback AS raw FROM st)
      SELECT symbol, rows, {', '.join(_MEDIANS)}, exclusion_reason, exclusion_reason IS NULL AS eligible, exclusion_reason IS NULL AND row_number() OVER (ORDER BY exclusion_reason IS NULL DESC, raw DESC, rows DESC, symbol) <= 40 AS selected FROM e"""
)
def universe_screen(spark, sf_dir):
    stats = audits.universe_statistics(a.bars(spark, sf_dir), 10)
    out = audits.screen_universe(stats, 25, 10, 60, 40, LEVERAGED_INVERSE)
    return rounded(out.select("symbol", "rows", *_MEDIANS, "exclusion_reason", "eligible", "selected"))


@register(
    """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'tqqq.us' WHEN 1 THEN 'S' || s_suppkey || '-WS' WHEN 2 THEN 'S' || s_suppkey || '_P' WHEN 3 THEN 'FNGD' ELSE 'S' || s_suppkey || '.US' END AS symbol FROM supplier)
      SELECT s_suppkey, symbol, CASE WHEN s_suppkey % 6 IN (0, 3) THEN 'profile_excluded_leveraged_inverse' WHEN s_suppkey % 6 IN (1, 2) THEN 'profile_excluded_non_common_pattern' END AS reason FROM s"""
)
def universe_profiles(spark, sf_dir):
    key, kind = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 6
    symbol = F.when(kind == 0, "tqqq.us").when(kind == 1, F.concat(F.lit("S"), key, F.lit("-WS"))).when(kind == 2, F.concat(F.lit("S"), key, F.lit("_P"))).when(kind == 3, "FNGD").otherwise(F.concat(F.lit("S"), key, F.lit(".US")))
    named = a.table(spark, sf_dir, "supplier").select("s_suppkey", symbol.alias("symbol"))
    return named.withColumn("reason", audits.classify_profile(F.col("symbol"), "core_equity_etf"))


# research ---------------------------------------------------------------------------------


@register(
    f"""WITH {a.BARS}, x AS (SELECT symbol, timestamp, close / lag(close) OVER w - 1 AS s FROM bars {W}),
      k AS (SELECT *, CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY timestamp ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY timestamp, s) - 1) / 2.0) / count(s) OVER (PARTITION BY timestamp) END AS cross_rank,
        (s - avg(s) OVER (PARTITION BY timestamp)) / nullif(stddev_pop(s) OVER (PARTITION BY timestamp), 0) AS cross_z FROM x)
      SELECT symbol, timestamp, {r('cross_rank', 'cross_z')} FROM k"""
)
def cross_section_rank(spark, sf_dir):
    scored = a.bars(spark, sf_dir).withColumn("s", bar_ops.change("close"))
    return rounded(research.rank_cross_section(scored, "s").select("symbol", "timestamp", "cross_rank", "cross_z"))


@register(
    f"""WITH {a.BARS}, k AS (SELECT symbol, timestamp, (rank() OVER (PARTITION BY timestamp ORDER BY volume) + (count(*) OVER (PARTITION BY timestamp, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY timestamp) AS cr FROM bars),
      s AS (SELECT *, CASE WHEN cr >= 0.8 THEN 1 WHEN cr <= 0.2 THEN -1 END AS side FROM k)
      SELECT symbol, timestamp, side, round(side / count(*) OVER (PARTITION BY timestamp, side), {DIGITS}) AS weight FROM s WHERE side IS NOT NULL"""
)
def top_bottom_portfolio(spark, sf_dir):
    return rounded(research.top_bottom_portfolio(a.bars(spark, sf_dir), "volume").select("symbol", "timestamp", "side", "weight"))


_SIGNAL = f"""{a.PREDICTIONS}, sg AS (SELECT symbol, timestamp, score, CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END AS signal, lead(close, 3) OVER w / lead(open) OVER w - 1 AS ar FROM predictions {W}),
  tr AS (SELECT *, signal * ar AS gross_return, CASE WHEN signal <> 0 THEN 0.001 ELSE 0 END AS cost FROM sg WHERE ar IS NOT NULL)"""


@register(f"WITH {_SIGNAL} SELECT symbol, timestamp, signal, round(gross_return, {DIGITS}) + 0.0 AS gross_return, round(cost, {DIGITS})::DOUBLE AS cost, round(gross_return - cost, {DIGITS}) + 0.0 AS net_return FROM tr")
def signal_backtest(spark, sf_dir):
    out = research.signals(a.predictions(spark, sf_dir), "score", threshold=0.1)
    return rounded(out.select("symbol", "timestamp", "signal", "gross_return", "cost", "net_return"))


@register(f"WITH {_SIGNAL} SELECT symbol, timestamp, score, signal FROM tr WHERE signal <> 0 QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY abs(score) DESC, symbol) <= 5")
def topk_per_timestamp(spark, sf_dir):
    out = research.top_k_signals(research.signals(a.predictions(spark, sf_dir), "score", threshold=0.1), "score", 5)
    return out.select("symbol", "timestamp", "score", "signal")


_PORT = f"""WITH {_SIGNAL}, act AS (SELECT * FROM tr WHERE signal <> 0 QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY abs(score) DESC, symbol) <= 5),
  pf AS (SELECT t.timestamp, coalesce(avg(gross_return), 0) AS gross_return, CASE WHEN count(gross_return) > 0 THEN 0.001 ELSE 0 END AS cost, count(*) FILTER (signal > 0) AS longs, count(*) FILTER (signal < 0) AS shorts
    FROM (SELECT DISTINCT timestamp FROM tr) t LEFT JOIN act ON act.timestamp = t.timestamp GROUP BY t.timestamp)"""


@register(_PORT + f" SELECT timestamp, round(gross_return, {DIGITS}) AS gross_return, cost::DOUBLE AS cost, round(gross_return - cost, {DIGITS}) AS net_return, longs, shorts, longs + shorts AS positions FROM pf")
def portfolio_backtest(spark, sf_dir):
    return rounded(research.portfolio(a.predictions(spark, sf_dir), "score", threshold=0.1, most=5))


@register(_PORT + f""", c AS (SELECT timestamp, product(1 + gross_return - cost) OVER (ORDER BY timestamp) AS equity FROM pf)
      SELECT timestamp, round(ln(equity), {DIGITS}) AS log_equity, round(equity / max(equity) OVER (ORDER BY timestamp) - 1, {DIGITS}) AS drawdown FROM c""")
def drawdown(spark, sf_dir):
    port = research.portfolio(a.predictions(spark, sf_dir), "score", threshold=0.1, most=5).withColumn("name", F.lit("all"))
    return rounded(research.equity_curve(port, ["name"]).select("timestamp", F.ln("equity").alias("log_equity"), "drawdown"))


@register(
    f"""WITH {_SIGNAL}, n AS (SELECT symbol, timestamp, gross_return - cost AS nr FROM tr), e AS (SELECT *, product(1 + nr) OVER w AS eq FROM n {W}), d AS (SELECT *, eq / max(eq) OVER w - 1 AS dd FROM e {W})
      SELECT symbol, count(nr) AS observations, round(avg(nr), {DIGITS}) AS mean_return, round(stddev_samp(nr), {DIGITS}) AS std_return, round(avg(nr) / nullif(stddev_samp(nr), 0) * sqrt(252.0), {DIGITS}) AS sharpe, round(min(dd), {DIGITS}) AS max_drawdown, round(avg((nr > 0)::INT), {DIGITS}) AS win_rate FROM d GROUP BY symbol"""
)
def strategy_summary(spark, sf_dir):
    return rounded(research.summarize(research.signals(a.predictions(spark, sf_dir), "score", threshold=0.1), ["symbol"]))


@register(
    f"""WITH {a.PAIRS}, g AS (SELECT *, sign(predicted) * actual AS gain FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL)
      SELECT symbol, count(*) AS rows, round(avg(gain), {DIGITS}) AS mean_return, round(avg(gain) / nullif(stddev_samp(gain), 0) * sqrt(252.0), {DIGITS}) AS sharpe, round(avg((gain > 0)::INT), {DIGITS}) AS win_rate, round(avg((sign(predicted) = sign(actual))::INT), {DIGITS}) AS sign_agreement FROM g GROUP BY symbol"""
)
def market_summary(spark, sf_dir):
    known = a.pairs(spark, sf_dir).filter("predicted IS NOT NULL AND actual IS NOT NULL")
    return rounded(research.summarize_market(known))


_TIMES = "tm AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM pairs))"


@register(
    f"""WITH {a.PAIRS}, {_TIMES}, c AS (SELECT timestamp AS cut FROM tm WHERE i = least(greatest(floor(n * 0.7), 1), n - 1)), lp AS (SELECT DISTINCT timestamp FROM pairs, c WHERE timestamp < cut AND target_timestamp < cut ORDER BY timestamp DESC LIMIT 2)
      SELECT symbol, timestamp, CASE WHEN timestamp >= cut THEN 'test' WHEN target_timestamp < cut AND timestamp NOT IN (SELECT timestamp FROM lp) THEN 'train' END AS part FROM pairs, c"""
)
def purged_split(spark, sf_dir):
    return research.purged_split(a.pairs(spark, sf_dir), 0.7, 2).select("symbol", "timestamp", "part")


@register(
    f"""WITH {a.PAIRS}, n AS (SELECT *, row_number() OVER (ORDER BY timestamp, symbol) - 1 AS i, count(*) OVER () AS total FROM pairs), f AS (SELECT unnest(range(0, (SELECT greatest((max(total) - 1200) // 400 + 1, 0)::BIGINT FROM n)))::INT AS fold),
      x AS (SELECT fold, symbol, timestamp, target_timestamp, CASE WHEN i < fold * 400 + 1000 THEN 'train' ELSE 'test' END AS part FROM n JOIN f ON i >= fold * 400 AND i < fold * 400 + 1200), o AS (SELECT fold, min(timestamp) AS t FROM x WHERE part = 'test' GROUP BY fold)
      SELECT fold, symbol, timestamp, part FROM x JOIN o USING (fold) WHERE part = 'test' OR target_timestamp < t"""
)
def walk_forward_folds(spark, sf_dir):
    return research.walk_forward_folds(a.pairs(spark, sf_dir), 1000, 200, 400, ["timestamp", "symbol"]).select("fold", "symbol", "timestamp", "part")


@register(
    """WITH x AS (SELECT event_type AS symbol, ts AS timestamp, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events)
      SELECT event_id, symbol, CASE WHEN p <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM x WHERE n >= 80 AND floor(n * 0.7) >= 50 AND floor(n * 0.7) < n"""
)
def per_symbol_cut(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"))
    return research.per_symbol_cut(e).select("event_id", "symbol", "part")


_DIAG = ["information_coefficient", "directional_accuracy", "sign_accuracy", "mae", "rmse"]
_DIAG_SQL = f"""count(*) AS pairs, round(CASE WHEN count(*) >= 3 THEN corr(predicted, actual) END, {DIGITS}) AS information_coefficient, round(avg(CASE WHEN actual <> 0 THEN ((predicted > 0) = (actual > 0))::INT END), {DIGITS}) AS directional_accuracy,
  round(avg((sign(predicted) = sign(actual))::INT), {DIGITS}) AS sign_accuracy, round(avg(abs(predicted - actual)), {DIGITS}) AS mae, round(sqrt(avg((predicted - actual) ** 2)), {DIGITS}) AS rmse FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL"""


@register(f"WITH {a.PAIRS} SELECT {_DIAG_SQL}")
def information_coefficient(spark, sf_dir):
    return rounded(research.diagnostics(a.pairs(spark, sf_dir), "predicted", "actual").select("pairs", *_DIAG))


@register(f"WITH {a.PAIRS} SELECT symbol, {_DIAG_SQL} GROUP BY symbol")
def directional_accuracy(spark, sf_dir):
    return rounded(research.diagnostics(a.pairs(spark, sf_dir), "predicted", "actual", ["symbol"]).select("symbol", "pairs", *_DIAG))


@register(
    f"""WITH {a.PAIRS}, k AS (SELECT predicted, actual FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL), e AS (SELECT list_distinct(quantile_cont(predicted, [0.2, 0.4, 0.6, 0.8])) AS q FROM k)
      SELECT len(list_filter(q, lambda x: x < predicted)) AS bucket, count(*) AS rows, round(avg(actual), {DIGITS}) AS mean_actual, round(median(actual), {DIGITS}) AS median_actual FROM k, e GROUP BY 1"""
)
def bucket_summary(spark, sf_dir):
    frame = a.pairs(spark, sf_dir)
    return rounded(research.bucket_summary(frame, "predicted", "actual"))


_PROB = "pr AS (SELECT (value - floor(value)) AS p, (event_type = 'purchase')::INT AS y FROM events)"


def _probabilities(spark, sf_dir):
    return a.table(spark, sf_dir, "events").select((F.col("value") - F.floor("value")).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))


@register(
    f"""WITH {_PROB}, b AS (SELECT greatest(ceil(p * 10), 1)::BIGINT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS o FROM pr WHERE p BETWEEN 0 AND 1 GROUP BY 1)
      SELECT g AS bin, coalesce(n, 0) AS rows, round(mp, {DIGITS}) AS mean_probability, round(o, {DIGITS}) AS observed_rate FROM (SELECT unnest(range(1, 11)) AS g) LEFT JOIN b ON b.bin = g"""
)
def probability_bins(spark, sf_dir):
    return rounded(research.probability_bins(_probabilities(spark, sf_dir), "p", "y").select("bin", "rows", "mean_probability", "observed_rate"))


@register(f"WITH {_PROB} SELECT round(avg((p - y) ** 2), {DIGITS}) AS brier FROM pr")
def brier(spark, sf_dir):
    return rounded(research.brier(_probabilities(spark, sf_dir), "p", "y"))


@register()
def bootstrap_ci(spark, sf_dir):
    return rounded(research.bootstrap_mean(a.pairs(spark, sf_dir), "actual"))


# decision support ----------------------------------------------------------------------------

_OPP = f"{a.PREDICTIONS}, opp AS (SELECT symbol, timestamp, score AS expected_return, {_rolled('stddev_samp', 'score', 10, 5)} AS volatility_20, close / 500 - 0.5 AS sentiment_mean, (high - low) / 500 AS event_surprise, score * 3 AS trend_strength FROM predictions WHERE score IS NOT NULL)"


def _opportunities(spark, sf_dir):
    p = a.predictions(spark, sf_dir).filter("score IS NOT NULL")
    return p.select("symbol", "timestamp", F.col("score").alias("expected_return"), bar_ops.rolling(F.stddev_samp, F.col("score"), 10, 5).alias("volatility_20"), (F.col("close") / 500 - 0.5).alias("sentiment_mean"), ((F.col("high") - F.col("low")) / 500).alias("event_surprise"), (F.col("score") * 3).alias("trend_strength"))


@register(
    f"""WITH {_OPP}, g AS (SELECT quantile_cont(abs(expected_return), 0.8) AS p80, median(expected_return) AS me, median(volatility_20) AS mv FROM opp),
      s AS (SELECT *, CASE WHEN expected_return >= 0 THEN 'LONG' ELSE 'SHORT' END AS direction, expected_return / nullif(volatility_20, 0) AS risk_adjusted_alpha, least(greatest(50 + expected_return / (p80 + 1e-9) * 50, 0), 100) AS quant_score,
        least(greatest(50 + 50 * coalesce(sentiment_mean, 0), 0), 100) AS a1, least(greatest(50 + 50 * coalesce(event_surprise, 0), 0), 100) AS a2, least(greatest(50 + 25 * tanh(coalesce(trend_strength, 0)), 0), 100) AS a3, 50 + 50 * tanh(me / mv) AS model_context_score FROM opp, g)
      SELECT symbol, timestamp, direction, {r('risk_adjusted_alpha', 'quant_score')}, round((quant_score + a1 + a2 + a3) / 4, {DIGITS}) AS opportunity_score, round(model_context_score, {DIGITS}) AS model_context_score FROM s"""
)
def opportunity_rank(spark, sf_dir):
    out = research.rank_opportunities(_opportunities(spark, sf_dir))
    return rounded(out.select("symbol", "timestamp", "direction", "risk_adjusted_alpha", "quant_score", "opportunity_score", "model_context_score"))


@register(
    f"""WITH {_OPP} SELECT symbol, timestamp, concat_ws(';', CASE WHEN trend_strength > 0 THEN 'positive trend regime' END, CASE WHEN event_surprise > 0.2 THEN 'positive event surprise' END) AS positives,
      concat_ws(';', CASE WHEN trend_strength <= 0 THEN 'negative trend regime' END, CASE WHEN event_surprise <= 0.2 THEN 'negative event surprise' END) AS negatives FROM opp"""
)
def explain_opportunity(spark, sf_dir):
    frame = _opportunities(spark, sf_dir)
    plus, minus = scalars.explain_opportunity(frame.columns)
    return frame.select("symbol", "timestamp", F.array_join(plus, ";").alias("positives"), F.array_join(minus, ";").alias("negatives"))


@register(
    f"""WITH {a.BARS}, q AS (SELECT symbol, timestamp, close AS entry, abs(close - low) AS unit, 100000 * 0.01 / nullif(abs(close - low), 0) AS raw, 100000 * 0.2 / close AS cap, abs(high + 10 - close) AS reward FROM bars WHERE close <> low),
      k AS (SELECT *, floor(least(raw, cap)) AS quantity FROM q)
      SELECT symbol, timestamp, quantity, round(quantity * entry, {DIGITS}) AS capital_required, round(quantity * unit, {DIGITS}) AS risk_amount, round(reward / unit, {DIGITS}) AS reward_to_risk, concat_ws(';', CASE WHEN cap < raw THEN 'capped by position value' END, CASE WHEN quantity < 50 THEN 'below minimum quantity' END, CASE WHEN quantity <= 0 THEN 'no feasible quantity' END) AS warnings FROM k"""
)
def position_size(spark, sf_dir):
    b = a.bars(spark, sf_dir).filter("close <> low")
    sized = scalars.position_size(F.col("close"), F.col("low"), F.col("high") + 10, F.lit(100_000.0), 1.0, 20.0, 1.0, 50.0)
    out = b.withColumns(sized).withColumn("warnings", F.array_join("warnings", ";"))
    return rounded(out.select("symbol", "timestamp", "quantity", "capital_required", "risk_amount", "reward_to_risk", "warnings"))


_RESULTS = f"""WITH {_SIGNAL}, rs AS (SELECT substr(symbol, 1, 2) AS name, count(*) AS rows, round(avg(gross_return - cost), {DIGITS}) AS mean_return, round(avg(gross_return - cost) / nullif(stddev_samp(gross_return - cost), 0) * sqrt(252.0), {DIGITS}) AS sharpe FROM tr GROUP BY 1)"""


def _results(spark, sf_dir):
    traded = research.signals(a.predictions(spark, sf_dir), "score", threshold=0.1)
    return rounded(traded.groupBy(F.substring("symbol", 1, 2).alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.avg("net_return").alias("mean_return"), research.sharpe(F.col("net_return")).alias("sharpe")))


@register(
    _RESULTS + """, e AS (SELECT *, rows >= 100 AND coalesce(sharpe, '-inf'::DOUBLE) >= 0.25 AND coalesce(mean_return, '-inf'::DOUBLE) > 0 AS eligible FROM rs)
      SELECT name, rows, mean_return, sharpe, eligible, concat_ws('; ', CASE WHEN rows < 100 THEN 'too few rows' END, CASE WHEN coalesce(sharpe, '-inf'::DOUBLE) < 0.25 THEN 'sharpe below minimum' END, CASE WHEN coalesce(mean_return, '-inf'::DOUBLE) <= 0 THEN 'mean return not positive' END) AS reasons
      FROM e ORDER BY eligible DESC, sharpe DESC NULLS LAST, mean_return DESC NULLS LAST, name LIMIT 1"""
)
def candidate_gate(spark, sf_dir):
    return research.select_candidate(_results(spark, sf_dir))


@register(_RESULTS + " SELECT name, rows, mean_return, sharpe FROM rs")
def experiment_ranking(spark, sf_dir):
    return research.rank_experiments(_results(spark, sf_dir)).select("name", "rows", "mean_return", "sharpe")


@register("SELECT s_name AS name, s_acctbal AS balance, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, NULL, c_mktsegment FROM customer")
def union_by_name(spark, sf_dir):
    s = a.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    c = a.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@register("SELECT DISTINCT c_nationkey AS nation FROM customer EXCEPT SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_symbols(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return c.subtract(a.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@register("SELECT region, nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM (SELECT r_name AS region, n_name AS nation, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ROLLUP (region, nation)")
def audit_rollup(spark, sf_dir):
    """Grouping sets over an audit (an extension)."""
    n = a.table(spark, sf_dir, "nation").join(a.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = a.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# feeds -------------------------------------------------------------------------------------------


@register(
    """SELECT user_id AS cik, event_type AS tag, 'USD' AS unit, strftime(ts, '%Y-%m-%d') AS filed, value AS val FROM events"""
)
def companyfacts_explode(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    fact = F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.col("value").alias("val"), F.lit("x").alias("accn"), F.lit(2024).alias("fy"), F.lit("Q1").alias("fp"), F.lit("10-Q").alias("form"), F.date_format("ts", "yyyy-MM-dd").alias("filed"), F.lit(None).cast("string").alias("frame"))
    tags = e.groupBy("user_id", "event_type").agg(F.collect_list(fact).alias("items"))
    body = F.struct(F.lit("l").alias("label"), F.lit("d").alias("description"), F.create_map(F.lit("USD"), F.col("items")).alias("units"))
    docs = tags.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", body))).alias("tags"))
    document = F.to_json(F.struct(F.col("user_id").alias("cik"), F.lit("n").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("tags")).alias("facts")))
    raw = docs.select(F.from_json(document, feeds.COMPANY_FACTS).alias("j")).select("j.*")
    return feeds.explode_company_facts(raw).select("cik", "tag", "unit", "filed", "val")


@register("SELECT o_custkey AS cik, o_orderkey::VARCHAR AS \"accessionNumber\", strftime(o_orderdate, '%Y-%m-%d') AS \"filingDate\", o_orderpriority AS form FROM orders")
def submissions_zip_arrays(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderpriority").alias("p"))).alias("l"))
    part = lambda c: F.transform("l", lambda x: x[c])
    recent = F.struct(part("k").alias("accessionNumber"), part("d").alias("acceptanceDateTime"), part("d").alias("filingDate"), part("p").alias("form"))
    document = F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings")))
    raw = o.select(F.from_json(document, feeds.SUBMISSIONS).alias("j")).select("j.*")
    return feeds.explode_submissions(raw).select("cik", "accessionNumber", "filingDate", "form")


@register("SELECT o_orderpriority AS series_id, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value, strptime('20240105', '%Y%m%d') AS realtime_start FROM orders WHERE o_orderkey % 7 <> 0")
def vintage_unpivot(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))
    raw = o.select(F.col("o_orderpriority").alias("series_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.create_map(F.concat("o_orderpriority", F.lit("_20240105")), text, F.lit("other"), F.lit("1")).alias("values"))
    return macro.unpivot_vintages(raw).select("series_id", "date", "value", F.col("realtime_start").cast("timestamp_ntz").alias("realtime_start"))


@register(f"WITH {a.BARS} SELECT {OHLC} FROM bars")
def klines_parse(spark, sf_dir):
    b = a.bars(spark, sf_dir)
    cells = F.array(F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string"), *(F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")))
    raw = b.groupBy("symbol").agg(F.to_json(F.collect_list(cells)).alias("body"))
    return feeds.parse_klines(raw).select(*OHLC.split(", "))


@register("SELECT o_orderpriority AS series_id, o_orderdate AS timestamp, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value FROM orders")
def observations_parse(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    item = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 7 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    raw = o.select(F.col("o_orderpriority").alias("series_id"), F.to_json(F.struct(F.array(item).alias("observations"))).alias("body"))
    return feeds.parse_observations(raw).select("series_id", "timestamp", "value")


@register("SELECT event_id::VARCHAR AS \"GLOBALEVENTID\", event_type AS \"EventCode\", value AS \"GoldsteinScale\", strftime(ts, '%Y-%m-%d') AS event_date FROM events WHERE event_id >= 0")
def gdelt_dedupe(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    fields = {0: F.col("event_id").cast("string"), 1: F.date_format("ts", "yyyyMMdd"), 26: F.col("event_type"), 30: F.col("value").cast("string"), 59: F.date_format("ts", "yyyyMMddHHmmss"), 60: F.lit("u")}
    line = F.concat_ws("\t", *(fields.get(k, F.lit("")) for k in range(feeds.GDELT_FIELDS)))
    twice = e.withColumn("file", F.explode(F.array(F.lit(1), F.lit(2)))).select(line.alias("value"), "file")
    return feeds.dedupe_events(feeds.parse_events(twice), ["file"]).select(F.col("GlobalEventID").cast("string").alias("GLOBALEVENTID"), "EventCode", "GoldsteinScale", F.col("event_date").cast("string").alias("event_date"))


# models (rows only: trees differ between engines) ------------------------------------------------------


def _frame(spark, sf_dir):
    return bar_ops.forward_target(bar_ops.dataset_features(a.bars(spark, sf_dir)))


@register()
def ml_experiment(spark, sf_dir):
    return models.run_experiment(_frame(spark, sf_dir), "all", DATASET)


@register()
def ml_direction(spark, sf_dir):
    frame = research.purged_split(_frame(spark, sf_dir), 0.7)
    model = models.fit_classifier(frame.filter("part = 'train'"), DATASET, "target_return")
    return models.predict(model, frame.filter("part = 'test'"), DATASET, "probability_up").select("symbol", "timestamp", "probability_up")


@register()
def ml_ridge(spark, sf_dir):
    frame = research.purged_split(_frame(spark, sf_dir), 0.7)
    model = models.fit_ridge(frame.filter("part = 'train'"), DATASET, "target_return")
    return models.predict(model, frame.filter("part = 'test'"), DATASET).select("symbol", "timestamp", "predicted")


@register()
def ml_ensemble(spark, sf_dir):
    frame = research.purged_split(_frame(spark, sf_dir), 0.7)
    out = models.ensemble(frame.filter("part = 'train'"), frame.filter("part = 'test'"), DATASET[:3], DATASET, "target_return")
    return out.select("symbol", "timestamp", "expected_return", "probability_up")


@register()
def ml_suite(spark, sf_dir):
    return models.run_suite(_frame(spark, sf_dir), {"returns": DATASET[:3], "all": DATASET})


_FOLD_SQL = f"""WITH {a.PAIRS}, u AS (SELECT * FROM pairs WHERE predicted IS NOT NULL AND actual IS NOT NULL), n AS (SELECT *, row_number() OVER (ORDER BY timestamp, symbol) - 1 AS i, count(*) OVER () AS total FROM u),
  f AS (SELECT unnest(range(0, (SELECT greatest((max(total) - 1000) // 200 + 1, 0)::BIGINT FROM n)))::INT AS fold),
  x AS (SELECT n.*, fold, CASE WHEN i < fold * 200 + 800 THEN 'train' ELSE 'test' END AS part FROM n JOIN f ON i >= fold * 200 AND i < fold * 200 + 1000), o AS (SELECT fold, min(timestamp) AS t FROM x WHERE part = 'test' GROUP BY fold),
  k AS (SELECT x.* FROM x JOIN o USING (fold) WHERE part = 'test' OR target_timestamp < t),
  m AS (SELECT fold, max(timestamp) AS train_end, avg(predicted) AS mx, avg(actual) AS my, count(*) AS rows, coalesce(covar_pop(predicted, actual) / nullif(var_pop(predicted), 0), 0) * count(*) / (count(*) + 1.0) AS w FROM k WHERE part = 'train' GROUP BY fold),
  s AS (SELECT k.*, train_end, my + w * (predicted - mx) AS p FROM k JOIN m USING (fold) WHERE part = 'test' AND rows >= 50)
  SELECT fold, train_end, min(timestamp) AS test_start, max(timestamp) AS test_end, count(*) AS rows, round(avg(abs(actual - p)), {DIGITS}) AS mae, round(1 - avg((actual - p) ** 2) / nullif(var_pop(actual), 0), {DIGITS}) AS r2,
    round(avg((sign(p) = sign(actual))::INT), {DIGITS}) AS directional_accuracy, round(avg(sign(p) * actual), {DIGITS}) AS mean_strategy_return, round(avg(sign(p) * actual) - 0.001, {DIGITS}) AS net_mean_strategy_return FROM s GROUP BY fold, train_end"""


@register(_FOLD_SQL)
def walk_forward_ridge(spark, sf_dir):
    """With one feature, so that the closed form fits into SQL."""
    return rounded(models.walk_forward_ridge(a.pairs(spark, sf_dir), ["predicted"], 800, 200, 200, "actual", cost_bps=5.0))


@register(
    f"""WITH e AS (SELECT event_type AS symbol, ts AS timestamp, event_id, value, user_id::DOUBLE AS x FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS p FROM e),
      k AS (SELECT *, CASE WHEN p <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM c WHERE n >= 80 AND floor(n * 0.7) >= 50 AND floor(n * 0.7) < n),
      m AS (SELECT symbol, avg(x) AS mx, avg(value) AS my, covar_pop(x, value) / nullif(var_pop(x), 0) * count(*) / (count(*) + 1.0) AS w FROM k WHERE part = 'train' GROUP BY symbol)
      SELECT event_id, symbol, round(my + w * (x - mx), {DIGITS}) AS expected_return, sign(my + w * (x - mx))::DOUBLE AS signal FROM k JOIN m USING (symbol) WHERE part = 'test'"""
)
def per_symbol_ridge(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("target_return"))
    return rounded(models.fit_predict_ridge(e, ["x"]).select("event_id", "symbol", "expected_return", "signal"))


@register()
def walk_forward_regression(spark, sf_dir):
    """Boosted trees per fold, of the score and the day's range."""
    pairs = a.pairs(spark, sf_dir)
    ranges = a.bars(spark, sf_dir).select("symbol", "timestamp", (F.col("high") / F.col("low")).alias("range"))
    return models.walk_forward_regression(pairs.join(ranges, ["symbol", "timestamp"]), ["predicted", "range"], 800, 200, 200, "actual", cost_bps=5.0)


@register()
def per_symbol_oos(spark, sf_dir):
    """Boosted trees per event type."""
    e = a.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("target_return"))
    return models.fit_predict_oos(e, ["x"]).select("event_id", "symbol", "expected_return", "signal")


@register()
def ml_pooled(spark, sf_dir):
    return models.evaluate_pooled(_frame(spark, sf_dir), DATASET)
