"""Splits, cross-sections, backtests, statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, directional_score, mean_of_known
from tidemark.operators.scans import BROADCAST_ROWS, HOT_ROWS, hot_keys, large, parted, percentiles, running
from tidemark.operators.temporal import latest_per
from tidemark.schema import finite
from tidemark.session import written

YEAR = 252.0


# splits -----------------------------------------------------------------


def _cut_time(frame: DataFrame, fraction: float) -> DataFrame:
    """One row: the distinct timestamp at index ``clamp(int(n * fraction), 1, n - 1)``.

    Days are counted first, so no task ranks more than the days, or the timestamps of one day.
    """
    times = frame.select("timestamp").distinct().withColumn("_day", F.to_date("timestamp"))
    days = times.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    up_to = F.sum("_n").over(Window.orderBy(F.col("_day").asc_nulls_first()))
    days = days.withColumns({"_before": up_to - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy())})
    at = F.least(F.greatest(F.floor(F.col("_all") * fraction), F.lit(1)), F.greatest(F.col("_all") - 1, F.lit(0)))
    day = days.filter((at >= F.col("_before")) & (at < F.col("_before") + F.col("_n"))).select(F.col("_day").alias("_of"), (at - F.col("_before")).alias("_at"))
    inside = times.join(F.broadcast(day), F.col("_day").eqNullSafe(F.col("_of")))  # one row
    ranked = inside.withColumn("_i", F.row_number().over(Window.partitionBy("_day").orderBy("timestamp")) - 1)
    return ranked.filter(F.col("_i") == F.col("_at")).select(F.col("timestamp").alias("_cut"))


def purged_split(frame: DataFrame, fraction: float = 0.7, purge_bars: int = 0) -> DataFrame:
    """Adds ``part``: train rows lie before the cut and have their target before it; test rows from the cut on; else null.

    ``purge_bars`` also takes the last distinct train timestamps out.
    """
    marked = frame.crossJoin(F.broadcast(_cut_time(frame, fraction)))  # one row
    train = (F.col("timestamp") < F.col("_cut")) & F.coalesce(F.col("target_timestamp") < F.col("_cut"), F.lit(False))
    out = marked.withColumn("part", F.when(train, "train").when(F.col("timestamp") >= F.col("_cut"), "test")).drop("_cut")
    if purge_bars:
        last = out.filter("part = 'train'").select("timestamp").distinct().orderBy(F.desc("timestamp")).limit(purge_bars).select("timestamp", F.lit(True).alias("_purged"))
        out = out.join(F.broadcast(last), "timestamp", "left").withColumn("part", F.when(F.col("_purged") & (F.col("part") == "train"), F.lit(None)).otherwise(F.col("part"))).drop("_purged")
    return out


def walk_forward_folds(frame: DataFrame, train_size: int, test_size: int, step: int, order: list[str]) -> DataFrame:
    """Rows by fold and part over row-count windows of the time-ordered frame; targets reaching the test are purged.

    Rows are numbered across partitions without one global sort task.
    """
    if min(train_size, test_size, step) < 1:
        raise ValueError("sizes and step must be at least one")
    from tidemark.operators.temporal import number_decisions

    rows = number_decisions(frame, order).withColumnRenamed("_decision_id", "_n")
    folds = -(-max(rows.count() - train_size - test_size + 1, 0) // step)
    first = F.greatest(F.ceil((F.col("_n") - (train_size + test_size) + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("_n") / step), F.lit(folds - 1))
    spread = rows.withColumn("fold", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    spread = spread.withColumn("part", F.when(F.col("_n") < F.col("fold") * step + train_size, "train").otherwise("test"))
    opening = spread.filter("part = 'test'").groupBy("fold").agg(F.min("timestamp").alias("_test_from"))
    opening = F.broadcast(opening) if folds <= BROADCAST_ROWS else opening  # one row a fold
    kept = spread.join(opening, "fold").filter("part = 'test' OR target_timestamp < _test_from")
    return kept.select(*frame.columns, F.col("fold").cast("int").alias("fold"), "part")


def per_symbol_cut(frame: DataFrame, fraction: float = 0.7, least: int = 80) -> DataFrame:
    """Train and test by row place inside each symbol with enough rows."""
    w = Window.partitionBy("symbol")
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy("timestamp"))
    out = frame.withColumns({"_n": n, "_p": place}).filter(F.col("_n") >= least).withColumn("_cut", F.floor(F.col("_n") * fraction))
    return out.filter((F.col("_cut") >= 50) & (F.col("_cut") < F.col("_n"))).withColumn("part", F.when(F.col("_p") <= F.col("_cut"), "train").otherwise("test")).drop("_n", "_p", "_cut")


# cross-section ------------------------------------------------------------


def rank_cross_section(frame: DataFrame, score: str) -> DataFrame:
    """Average-rank share and population z-score of a score inside its timestamp; null scores have neither."""
    at = Window.partitionBy("timestamp")
    place = F.rank().over(at.orderBy(F.col(score).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy("timestamp", score)) - 1) / 2.0
    spread = F.stddev_pop(score).over(at)
    return frame.withColumns(
        {"cross_rank": F.when(F.col(score).isNotNull(), place / F.count(score).over(at)), "cross_z": F.try_divide(F.col(score) - F.avg(score).over(at), F.when(spread != 0, spread))}
    )


def top_bottom_portfolio(frame: DataFrame, score: str, quantile: float = 0.2) -> DataFrame:
    """Long the top and short the bottom quantile, each side equally weighted to one."""
    ranked = rank_cross_section(frame, score)
    side = F.when(F.col("cross_rank") >= 1 - quantile, 1).when(F.col("cross_rank") <= quantile, -1)
    sided = ranked.withColumn("side", side).filter(F.col("side").isNotNull())
    return sided.withColumn("weight", F.col("side") / F.count(F.lit(1)).over(Window.partitionBy("timestamp", "side")))


# backtests ----------------------------------------------------------------


def signals(frame: DataFrame, column: str, hold: int = 3, threshold: float = 0.0, long_only: bool = False, cost_bps: float = 5.0) -> DataFrame:
    """Signal of a prediction, entry at the next open, exit at the close ``hold`` bars on, gross and net return."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    p = finite(column)
    direction = F.when(p > threshold, 1).when(p < -threshold, F.lit(0 if long_only else -1)).otherwise(0)
    out = frame.withColumns({"entry": F.lead("open").over(w), "exit": F.lead("close", hold).over(w), "signal": direction})
    out = out.withColumn("asset_return", F.try_divide("exit", F.col("entry")) - 1).filter(F.col("asset_return").isNotNull())
    cost = F.when(F.col("signal") != 0, F.lit(2 * cost_bps / 10_000)).otherwise(F.lit(0.0))
    return out.withColumns({"gross_return": F.col("signal") * F.col("asset_return"), "cost": cost}).withColumn("net_return", F.col("gross_return") - F.col("cost"))


def top_k_signals(traded: DataFrame, column: str, most: int) -> DataFrame:
    """Of each timestamp's active signals the ``most`` strongest; ties go to the smaller symbol."""
    return latest_per(traded.filter("signal <> 0"), ["timestamp"], [F.abs(F.col(column)).desc(), F.col("symbol")], most)


def portfolio(frame: DataFrame, column: str, hold: int = 3, threshold: float = 0.0, long_only: bool = False, cost_bps: float = 5.0, most: int | None = None) -> DataFrame:
    """Equal-weight return per timestamp of the active signals; a timestamp without one has zeros."""
    traded = signals(frame, column, hold, threshold, long_only, cost_bps)
    active = top_k_signals(traded, column, most) if most else traded.filter("signal <> 0")
    sums = active.groupBy("timestamp").agg(F.avg("gross_return").alias("g"), F.count_if(F.col("signal") > 0).alias("longs"), F.count_if(F.col("signal") < 0).alias("shorts"))
    out = traded.select("timestamp").distinct().join(sums, "timestamp", "left")
    zero = F.lit(0).cast("long")
    cost = F.when(F.col("g").isNotNull(), F.lit(2 * cost_bps / 10_000)).otherwise(F.lit(0.0))
    return out.select(
        "timestamp", F.coalesce("g", F.lit(0.0)).alias("gross_return"), cost.alias("cost"), (F.coalesce("g", F.lit(0.0)) - cost).alias("net_return"),
        F.coalesce("longs", zero).alias("longs"), F.coalesce("shorts", zero).alias("shorts"), (F.coalesce("longs", zero) + F.coalesce("shorts", zero)).alias("positions"),
    )


def equity_curve(returns: DataFrame, group: list[str], column: str = "net_return", order: str = "timestamp", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equity, its running maximum and drawdown per group; the starting equity of one is no maximum.

    A group with more than ``hot_rows`` rows is a scan over many tasks: products and maxima of ranges, which are combined.
    """
    growth = 1 + F.coalesce(F.col(column), F.lit(0.0))

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("equity", F.product(growth).over(w))
        return out.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)

    hot = hot_keys(returns, group, hot_rows)
    if hot is None:
        return plain(returns)
    cold, rows = parted(returns, hot, group)
    named = rows.withColumns({"_group": F.to_json(F.struct(*group)), "_growth": growth.cast("double")})
    grown = running(named, "_group", [F.col(order)], "equity", {"_growth": "product"}).withColumnRenamed("run__growth", "equity").drop("run_place")
    topped = running(grown, "_group", [F.col(order)], "peak", {"equity": "max"}).withColumnRenamed("run_equity", "peak")
    topped = topped.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    out = plain(cold)
    return out.unionByName(topped.select(*out.columns))


def sharpe(column: Column, periods: float = YEAR) -> Column:
    spread = F.stddev_samp(column)
    return F.try_divide(F.avg(column), F.when(spread != 0, spread)) * F.sqrt(F.lit(periods))


def summarize(returns: DataFrame, group: list[str], column: str = "net_return") -> DataFrame:
    """Observations, mean, deviation, Sharpe ratio, worst drawdown and share of gains per group."""
    curve = equity_curve(returns.filter(F.col(column).isNotNull()), group, column)
    c = F.col(column)
    return curve.groupBy(*group).agg(
        F.count(c).alias("observations"), F.avg(c).alias("mean_return"), F.stddev_samp(c).alias("std_return"), sharpe(c).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg((c > 0).cast("double")).alias("win_rate"),
    )


def summarize_market(oos: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    gain = F.signum(predicted) * F.col(actual)
    return oos.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.avg(gain).alias("mean_return"), sharpe(gain).alias("sharpe"), F.avg((gain > 0).cast("double")).alias("win_rate"), F.avg((F.signum(predicted) == F.signum(actual)).cast("double")).alias("sign_agreement"))


# statistics ---------------------------------------------------------------


def diagnostics(frame: DataFrame, predicted: str, actual: str, group: list[str] = ()) -> DataFrame:
    """Information coefficient, directional and sign accuracy and errors over pairs that are both known."""
    p, a = finite(predicted), finite(actual)
    pairs = frame.withColumns({"_p": p, "_a": a}).filter(F.col("_p").isNotNull() & F.col("_a").isNotNull())
    p, a = F.col("_p"), F.col("_a")
    return pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pairs"), F.when(F.count(F.lit(1)) >= 3, F.corr(p, a)).alias("information_coefficient"),
        F.avg(F.when(a != 0, ((p > 0) == (a > 0)).cast("double"))).alias("directional_accuracy"), F.avg((F.signum(p) == F.signum(a)).cast("double")).alias("sign_accuracy"),
        F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
    )


def bucket_summary(frame: DataFrame, predicted: str, actual: str, buckets: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count, mean and median of the actual value by quantile bucket of the prediction (equal edges merge).

    Quantiles of large frames are sought by counts (``scans.percentiles``), never from one buffer.
    """
    known = frame.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    shares = [k / buckets for k in range(buckets + 1)]
    big = large(frame, hot_rows)
    if big:
        found = dict.fromkeys(percentiles(known, F.col(predicted), shares))
        placed = known.withColumn("edges", F.array(*(F.lit(v).cast("double") for v in found)))
    else:
        edges = known.agg(F.array_distinct(F.percentile(predicted, F.array(*map(F.lit, shares)))).alias("edges"))
        placed = known.crossJoin(F.broadcast(edges))  # one row
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 1, F.lit(0)))
    placed = placed.withColumn("bucket", F.size(F.filter(inner, lambda e: e < F.col(predicted))).cast("long"))
    sums = [F.count(F.lit(1)).alias("rows"), F.avg(actual).alias("mean_actual")]
    if not big:
        return placed.groupBy("bucket").agg(*sums, F.median(actual).alias("median_actual"))
    counted = written(placed.groupBy("bucket").agg(*sums), "buckets")
    middle = F.lit(None).cast("double")
    for b in [r["bucket"] for r in counted.select("bucket").collect()]:  # a handful
        middle = F.when(F.col("bucket") == b, F.lit(percentiles(placed.filter(F.col("bucket") == b), F.col(actual), [0.5])[0])).otherwise(middle)
    return counted.withColumn("median_actual", middle)


def probability_bins(frame: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Right-closed bins of equal width with their empty ones; a probability outside [0, 1] or without an outcome is in none."""
    spark = frame.sparkSession
    grid = spark.range(1, bins + 1).withColumnRenamed("id", "bin")
    inside = frame.filter(F.col(probability).between(0, 1) & finite(outcome).isNotNull())
    filled = inside.withColumn("bin", F.greatest(F.ceil(F.col(probability) * bins), F.lit(1)).cast("long")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg(outcome).alias("observed_rate"))
    return grid.join(filled, "bin", "left").withColumn("rows", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


def brier(frame: DataFrame, probability: str, outcome: str) -> DataFrame:
    return frame.agg(F.avg(F.pow(F.col(probability) - F.col(outcome), 2)).alias("brier"))


def bootstrap_mean(frame: DataFrame, column: str, rounds: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: every row draws its own weight in every round.

    Draws are hashes of the row's values, so the interval doesn't depend on the partitioning; equal
    rows are one row with a count, each of which draws for itself.  Rounds are rows, summed within each task
    before the exchange, so ``rounds`` rows a task are moved at most.
    """
    hashed = frame.select(finite(column).alias("x"), F.xxhash64(*frame.columns).alias("_hash")).filter("x IS NOT NULL")
    equal = hashed.groupBy("x", "_hash").agg(F.count(F.lit(1)).alias("_times"))
    values = equal.withColumn("_id", F.explode(F.sequence(F.lit(1), F.col("_times")))).withColumn("_id", F.xxhash64("_hash", "_id")).select("x", "_id")
    totals = values.agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    tasks = max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), frame.sparkSession.sparkContext.defaultParallelism)
    drawn = values.repartition(tasks).select("x", "_id", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_round")).select("_round", "x", _poisson(F.col("_round"), seed).alias("w"))
    means = drawn.groupBy("_round").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    limits = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    out = totals.crossJoin(F.broadcast(limits))  # one row each
    return out.select("n", "mean", F.when(F.col("n") >= 2, F.col("low")).alias("low"), F.when(F.col("n") >= 2, F.col("high")).alias("high"))


def _poisson(round_number: Column, seed: int) -> Column:
    """Poisson(1) weight by inversion of a hash of the row and round."""
    u = F.pmod(F.xxhash64("_id", round_number, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    steps = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0)).cast("double")


def summarize_folds(folds: DataFrame, measures: list[str]) -> DataFrame:
    return folds.agg(F.count(F.lit(1)).alias("folds"), *(F.avg(m).alias(m) for m in measures))


# ranking and gates ----------------------------------------------------------


def rank_opportunities(frame: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Direction, scores by family and their mean, with the order they imply."""
    known = frame.columns
    e = F.col("expected_return")
    volatility = F.col("volatility_20") if "volatility_20" in known else F.lit(None).cast("double")
    alpha = F.try_divide(e, F.when(volatility != 0, volatility)) if "volatility_20" in known else e
    scales = {"_p80": (F.abs(e), 0.8), "_me": (e, 0.5), "_mv": (volatility, 0.5)}
    if large(frame, hot_rows):
        out = frame.withColumns({name: F.lit(percentiles(frame, value, [share])[0]).cast("double") for name, (value, share) in scales.items()})
    else:
        scale = frame.agg(*(F.percentile(value, F.lit(share)).alias(name) for name, (value, share) in scales.items()))
        out = frame.crossJoin(F.broadcast(scale))  # one row
    columns = {"direction": F.when(e >= 0, "LONG").otherwise("SHORT"), "risk_adjusted_alpha": alpha, "quant_score": clip(50 + e / (F.col("_p80") + 1e-9) * 50, 0, 100)}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scores = []
    for name, source, score in (("sentiment_score", "sentiment_mean", lambda c: 50 + 50 * zero(c)), ("event_score", "event_surprise", lambda c: 50 + 50 * zero(c)), ("regime_score", "trend_strength", lambda c: 50 + 25 * F.tanh(zero(c)))):
        if source in known:
            columns[name] = clip(score(source), 0, 100)
            scores.append(name)
    out = out.withColumns(columns)
    out = out.withColumns({"opportunity_score": mean_of_known(F.col("quant_score"), *map(F.col, scores)), "model_context_score": directional_score(F.col("_me"), F.col("_mv"))}).drop("_p80", "_me", "_mv")
    return out.orderBy(F.desc_nulls_last("opportunity_score"), F.desc_nulls_last("risk_adjusted_alpha"))


def rank_experiments(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("sharpe"), F.desc_nulls_last("mean_return"), "name")


def select_candidate(results: DataFrame, min_rows: int = 100, min_sharpe: float = 0.25, min_mean: float = 0.0) -> DataFrame:
    """The best result that passes the gate, else the best of all, with the reasons against it."""
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("rows", F.lit(0)) < min_rows, F.lit("too few rows")),
            F.when(F.coalesce(F.col("sharpe"), F.lit(float("-inf"))) < min_sharpe, F.lit("sharpe below minimum")),
            F.when(F.coalesce(F.col("mean_return"), F.lit(float("-inf"))) <= min_mean, F.lit("mean return not positive")),
        )
    )
    rated = results.withColumn("_reasons", reasons).withColumn("eligible", F.size("_reasons") == 0)
    best = rated.orderBy(F.desc("eligible"), F.desc_nulls_last("sharpe"), F.desc_nulls_last("mean_return"), "name").limit(1)
    return best.withColumn("reasons", F.array_join("_reasons", "; ")).drop("_reasons")


def promotion_decision(results: DataFrame, **limits) -> DataFrame:
    """One row in any case: the candidate with a reason for its verdict, or that there are no results."""
    best = select_candidate(results, **limits)
    passed = F.when(F.col("eligible"), "passes the preliminary gate; no approval for production").otherwise(F.col("reasons"))
    one = results.sparkSession.range(1).select(F.lit(True).alias("_one"))
    out = one.join(best.withColumn("reasons", passed).withColumn("_has", F.lit(True)), F.col("_has") == F.col("_one"), "left")
    return out.withColumns({"eligible": F.coalesce("eligible", F.lit(False)), "reasons": F.coalesce("reasons", F.lit("no experiment results"))}).drop("_one", "_has")


def diagnose_predictions(frame: DataFrame, predicted: str, actual: str, rounds: int = 2000) -> DataFrame:
    """The diagnostics of all pairs beside the bootstrap interval of the actual values' mean, in one row."""
    pairs = frame.filter(finite(predicted).isNotNull() & finite(actual).isNotNull())
    interval = bootstrap_mean(pairs, actual, rounds).select(F.col("mean").alias("mean_actual"), "low", "high")
    return diagnostics(pairs, predicted, actual).crossJoin(interval)  # single rows
