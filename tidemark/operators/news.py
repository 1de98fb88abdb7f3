"""News windows, sentiment state and event studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import asof_join
from tidemark.schema import finite, or_null


def news_window(bars: DataFrame, news: DataFrame, lookback_hours: int = 24) -> DataFrame:
    """Count, mean sentiment and mean shock of the asset's news in ``(t - lookback, t]``.

    Bars and news go through one RANGE window per asset in microseconds, so a
    burst of news costs its own rows, not rows times bars.  No news gives zeros.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    zero = lambda c: F.coalesce(or_null(news, c), F.lit(0.0))
    left = bars.select(F.struct(*bars.columns).alias("row"), F.col("symbol").alias("asset"), micros("timestamp").alias("us"), *(F.lit(None).cast("double").alias(c) for c in ("s", "c", "u")))
    right = news.select(F.lit(None).alias("row"), "asset", micros("timestamp").alias("us"), zero("sentiment").alias("s"), zero("sentiment_change").alias("c"), zero("surprise").alias("u"))
    span = Window.partitionBy("asset").orderBy("us").rangeBetween(-(lookback_hours * 3_600_000_000 - 1), 0)
    out = left.unionByName(right).withColumns({"n": F.count("s").over(span), "mean_s": F.avg("s").over(span), "shock": F.avg("c").over(span) + F.avg("u").over(span)})
    return out.filter(F.col("row").isNotNull()).select(
        "row.*", F.col("n").alias("news_count_24h"), F.coalesce("mean_s", F.lit(0.0)).alias("sentiment_mean_24h"), F.coalesce("shock", F.lit(0.0)).alias("sentiment_shock_24h")
    )


BLOCK = 64  # events whose weighted sum is one number for those after them


def weighted_means(numbered: DataFrame, span_most: int = 10) -> DataFrame:
    """``numbered`` (``asset, n`` from 1, ``sentiment``) with ``sentiment_ewm``, the exponentially weighted mean of all events so far with span ``min(span_most, n)``.

    From event ``span_most`` on the span is fixed and the mean a linear recurrence. It is taken in blocks: a running sum inside
    the block, and what earlier blocks leave, of which four matter: the weight of a fifth is below 1e-17.
    """
    order = Window.partitionBy("asset").orderBy("n")
    x, n = F.col("sentiment"), F.col("n")
    # while the span grows, all weights change with every event: a handful of events is summed anew
    young = 1 - 2 / (n + 1.0)
    early = sum((F.pow(young, F.lit(k)) * F.coalesce(F.lag("sentiment", k).over(order), F.lit(0.0)) for k in range(1, span_most)), x)
    early = early / F.when(n == 1, F.lit(1.0)).otherwise((1 - F.pow(young, n)) / (1 - young))
    d = 1 - 2 / (span_most + 1.0)
    placed = numbered.withColumns({"_block": F.floor((n - 1) / BLOCK), "_at": (n - 1) % BLOCK, "_early": F.when(n < span_most, early)})
    inside = Window.partitionBy("asset", "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_own", F.pow(F.lit(d), F.col("_at")) * F.sum(x * F.pow(F.lit(1 / d), F.col("_at"))).over(inside))
    totals = placed.groupBy("asset", "_block").agg(F.max_by("_own", "n").alias("_total"))
    along = Window.partitionBy("asset").orderBy("_block")
    left = sum((F.lit(d ** (BLOCK * k)) * F.coalesce(F.lag("_total", k + 1).over(along), F.lit(0.0)) for k in range(4)), F.lit(0.0))
    carried = totals.select(F.col("asset").alias("_asset"), F.col("_block").alias("_of"), left.alias("_left"))
    joined = placed.join(carried, F.col("asset").eqNullSafe(F.col("_asset")) & (F.col("_block") == F.col("_of")))
    late = (F.col("_own") + F.pow(F.lit(d), F.col("_at") + 1) * F.col("_left")) / ((1 - F.pow(F.lit(d), n)) / (1 - d))
    return joined.withColumn("sentiment_ewm", F.coalesce("_early", late)).select(*numbered.columns, "sentiment_ewm")


def sentiment_state(bars: DataFrame, events: DataFrame, last: int = 20, span_most: int = 10) -> DataFrame:
    """State of an asset's events at each bar; events without a sentiment don't count.

    Latest sentiment (named ``sentiment_mean``), its distance to the mean of the
    last 20, an exponentially weighted mean over all events so far with span
    ``min(10, n)``, and means of the other attributes over the last 20.
    """
    attributes = ["surprise", "novelty", "relevance", "credibility"]
    names = {a: f"event_{a}" for a in attributes} | {"credibility": "source_credibility"}
    base = events.select("timestamp", "asset", finite("sentiment").alias("sentiment"), *(or_null(events, a).alias(a) for a in attributes)).filter("sentiment IS NOT NULL")
    order = Window.partitionBy("asset").orderBy("timestamp", "sentiment")
    recent = order.rowsBetween(-(last - 1), 0)
    numbered = base.withColumns(
        {"n": F.row_number().over(order), "recent_mean": F.avg("sentiment").over(recent), **{name: F.avg(a).over(recent) for a, name in names.items()}}
    )
    state = weighted_means(numbered, span_most).withColumn("sentiment_count", F.least(F.col("n"), F.lit(last)).cast("long"))
    state = state.withColumn("sentiment_shock", F.col("sentiment") - F.col("recent_mean")).withColumnRenamed("asset", "symbol")
    payload = ["sentiment", "sentiment_shock", "sentiment_ewm", "sentiment_count", *names.values()]
    joined = asof_join(bars, state, ["symbol"], "timestamp", "timestamp", payload, ["n"], prefix="at_")
    out = joined.withColumn("at_sentiment_count", F.coalesce("at_sentiment_count", F.lit(0).cast("long"))).withColumnRenamed("at_sentiment", "sentiment_mean")
    for name in payload[1:]:
        out = out.withColumnRenamed(f"at_{name}", name)
    return out.drop("at_time")


def add_sentiment(frame: DataFrame, sentiment: DataFrame) -> DataFrame:
    return frame.join(sentiment, ["timestamp", "symbol"], "left")


def event_study(events: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Returns from the first bar at or after an event to bars further on; events without a bar drop out."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    ahead = bars.select("symbol", "timestamp", "close", *(F.try_divide(F.lead("close", h).over(w), F.col("close")).alias(f"x{h}") for h in horizons))
    joined = asof_join(events, ahead, ["symbol"], "timestamp", "timestamp", ["close", *(f"x{h}" for h in horizons)], forward=True, prefix="base_")
    out = joined.filter(F.col("base_time").isNotNull())
    return out.select(*events.columns, F.col("base_time"), F.col("base_close"), *((F.col(f"base_x{h}") - 1).alias(f"return_{h}") for h in horizons))
