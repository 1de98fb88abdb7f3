"""Per-symbol window features and labels on bars.

All columns of a group share one sort.  A symbol with very many bars is computed in slices with a halo
(``scans.sliced``), so no symbol has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import session_times
from tidemark.operators.scans import HOT_ROWS, sliced
from tidemark.schema import require_columns


def _series(symbol: str = "symbol", time: str = "timestamp"):
    return Window.partitionBy(symbol).orderBy(time)


def _tail(n: int):
    return _series().rowsBetween(-(n - 1), 0)


def by_slices(back: Callable[..., int], ahead: Callable[..., int]):
    """Deal symbols with more than ``hot_rows`` rows over slices; ``back`` and ``ahead`` say, from the arguments, how many rows the windows reach."""

    def wrap(features: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(features)
        def run(bars: DataFrame, *args, hot_rows: int = HOT_ROWS, **named) -> DataFrame:
            return sliced(bars, lambda rows: features(rows, *args, **named), back(*args, **named), ahead(*args, **named), hot_rows=hot_rows)

        return run

    return wrap


_NONE = lambda *_, **__: 0
_HORIZON = lambda horizon=3: max(horizon, 1)


def rolling(aggregate, column: Column, n: int, least: int | None = None) -> Column:
    """Rolling aggregate over n rows, null until ``least`` (default n) values are known."""
    return F.when(F.count(column).over(_tail(n)) >= (n if least is None else least), aggregate(column).over(_tail(n)))


def change(column: str, steps: int = 1) -> Column:
    return F.try_divide(F.col(column), F.lag(column, steps).over(_series())) - 1


@by_slices(lambda windows=(5, 20, 60): max(*windows, 20) + 1, _NONE)
def quant_features(bars: DataFrame, windows: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """Returns, momentum, volatility, distance to averages, z-scores, true range, volume ratios."""
    require_columns(bars, ["symbol", "timestamp", "open", "high", "low", "close"], "bars")
    previous = F.lag("close").over(_series())
    first = bars.withColumns(
        {
            "return_1": change("close"),
            "log_return_1": F.ln("close") - F.ln(previous),
            "_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)),
        }
    )
    columns: dict[str, Column] = {}
    for n in windows:
        mean = rolling(F.avg, F.col("close"), n)
        columns |= {
            f"momentum_{n}": change("close", n),
            f"volatility_{n}": rolling(F.stddev_samp, F.col("return_1"), n),
            f"distance_sma_{n}": F.try_divide(F.col("close"), mean) - 1,
            f"zscore_{n}": F.try_divide(F.col("close") - mean, rolling(F.stddev_samp, F.col("close"), n)),
            f"atr_{n}": rolling(F.avg, F.col("_range"), n),
        }
    if "volume" in bars.columns:
        columns |= {"volume_change_1": change("volume"), "relative_volume_20": F.try_divide(F.col("volume"), rolling(F.avg, F.col("volume"), 20))}
    return first.withColumns(columns).drop("_range")


@by_slices(lambda: 21, _NONE)
def dataset_features(bars: DataFrame) -> DataFrame:
    """The compact feature set, with shorter warm-up than the windows."""
    first = bars.withColumns({f"ret_{k}": change("close", k) for k in (1, 3, 5)})
    return first.withColumns(
        {
            "vol_10": rolling(F.stddev_samp, F.col("ret_1"), 10, 5),
            "close_to_ma10": F.try_divide(F.col("close"), rolling(F.avg, F.col("close"), 10, 5)) - 1,
            "range_pct": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
            "volume_ratio_20": F.try_divide(F.col("volume"), rolling(F.avg, F.col("volume"), 20, 10)),
        }
    )


@by_slices(lambda window=20: window + 61, _NONE)
def regime_features(bars: DataFrame, window: int = 20) -> DataFrame:
    """Trend strength, realised volatility, its z-score over 60 bars and a label."""
    first = bars.withColumn("_r", change("close")).withColumn("_sd", rolling(F.stddev_samp, F.col("_r"), window))
    second = first.withColumns({"trend_strength": F.try_divide(change("close", window), F.col("_sd")), "realized_vol": F.col("_sd") * F.sqrt(F.lit(float(window)))})
    z = F.try_divide(F.col("realized_vol") - rolling(F.avg, F.col("realized_vol"), 60), rolling(F.stddev_samp, F.col("realized_vol"), 60))
    label = F.when(F.col("trend_strength") > 1, "bull_trend").when(F.col("trend_strength") < -1, "bear_trend").otherwise("range_or_unclear")
    return second.withColumns({"vol_regime_z": z, "regime_label": label}).drop("_r", "_sd")


@by_slices(_NONE, _HORIZON)
def forward_target(bars: DataFrame, horizon: int = 3) -> DataFrame:
    """Enter at the next open, leave at the close ``horizon`` bars ahead; an unknown target counts as not positive."""
    w = _series()
    out = bars.withColumns({"entry_price": F.lead("open").over(w), "entry_timestamp": F.lead("timestamp").over(w), "target_timestamp": F.lead("timestamp", horizon).over(w), "_exit": F.lead("close", horizon).over(w)})
    out = out.withColumn("target_return", F.try_divide("_exit", F.col("entry_price")) - 1).withColumnRenamed("_exit", "exit_price")
    return out.withColumn("forward_positive", F.coalesce((F.col("target_return") > 0).cast("int"), F.lit(0)))


@by_slices(_NONE, _HORIZON)
def three_day_labels(bars: DataFrame, horizon: int = 3) -> DataFrame:
    """As ``forward_target``, but an unknown target leaves the label unknown."""
    out = forward_target.__wrapped__(bars, horizon).drop("forward_positive").withColumnRenamed("target_return", "forward_return_3d")
    return out.withColumns({"positive_3d_return": (F.col("forward_return_3d") > 0).cast("int"), "label_available": F.col("forward_return_3d").isNotNull()})


@by_slices(_NONE, _HORIZON)
def us_equity_labels(bars: DataFrame, horizon: int = 3) -> DataFrame:
    """Decide at the New York close of the bar's date, enter at the next session's open, target three sessions on."""
    close, opening = session_times(F.col("timestamp"))
    timed = bars.withColumns({"decision_time": close, "_open_time": opening})
    w = _series()
    out = timed.withColumns({"entry_time": F.lead("_open_time").over(w), "target_time": F.lead("decision_time", horizon).over(w), "entry_price": F.lead("open").over(w), "exit_price": F.lead("close", horizon).over(w)})
    out = out.withColumn("forward_return_3d", F.try_divide("exit_price", F.col("entry_price")) - 1)
    return out.withColumns(
        {"positive_3d_return": F.coalesce((F.col("forward_return_3d") > 0).cast("int"), F.lit(0)), "label_available": F.col("forward_return_3d").isNotNull(), "horizon_sessions": F.lit(horizon), "entry_sessions_after": F.lit(1)}
    ).drop("_open_time")


def generic_labels(bars: DataFrame, horizon: int = 3) -> DataFrame:
    """The same for markets without sessions: decide at the bar's own time."""
    out = three_day_labels(bars.withColumn("decision_time", F.col("timestamp")), horizon)
    return out.withColumnRenamed("entry_timestamp", "entry_time").withColumnRenamed("target_timestamp", "target_time")


def keep_last(rows: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """Of rows with one key, the last by position (file, then line)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(p).desc() for p in position)))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")
