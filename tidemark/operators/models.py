"""Baseline models: boosted regression, direction, ensemble, experiments, and one model a fold or symbol."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import QUANT_FEATURES, REGIME_FEATURES, SENTIMENT_FEATURES
from tidemark.functions.scalars import logistic_confidence
from tidemark.operators.boosting import GROUP_ROWS, BoostConfig, Boosted, boosted_predictions, fit_pooled, predict_groups
from tidemark.operators.research import diagnostics, per_symbol_cut, purged_split, signals, summarize, walk_forward_folds
from tidemark.schema import finite, require_columns
from tidemark.session import written


FITS = 4  # models that are fitted at once


@dataclass(frozen=True)
class ModelConfig:
    """Depth, step, rounds and seed of the boosted trees; fewest rows to fit on."""

    depth: int = 3
    step: float = 0.05
    rounds: int = 250
    seed: int = 42
    least_rows: int = 50


    def boost(self) -> BoostConfig:
        return BoostConfig(self.depth, self.step, self.rounds)


@dataclass(frozen=True)
class ExperimentConfig:
    cost_bps: float = 5.0
    threshold: float = 0.0
    hold: int = 3
    long_only: bool = False
    train_fraction: float = 0.7
    least_usable: int = 100
    least_train: int = 50
    least_test: int = 20
    model: ModelConfig = field(default_factory=ModelConfig)


@dataclass(frozen=True)
class ModelCard:
    name: str
    features: tuple[str, ...]
    rows: int
    metrics: dict

    def to_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.to_dict(), indent=2, sort_keys=True))


def _stages(features: list[str]):
    filled = [f"{f}__filled" for f in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]


def _ready(frame: DataFrame, features: list[str]) -> DataFrame:
    return frame.withColumns({f: finite(f) for f in features})


def _dealt(train: DataFrame, rows: int, part: int = 50_000) -> DataFrame:
    """Training rows in tasks of ``part`` rows: trees pass over them hundreds of times."""
    return train.repartition(rows // part + 1)


@dataclass(frozen=True)
class Regressor:
    """Medians that fill features, and one boosted model of the whole frame."""

    filler: object
    features: tuple[str, ...]
    model: Boosted

    def transform(self, frame: DataFrame) -> DataFrame:
        filled = self.filler.transform(frame).withColumn("_all", F.lit(0))
        return predict_groups(filled, "_all", list(self.features), {0: self.model}, "prediction")


def fit_regressor(frame: DataFrame, features: list[str], target: str, config: ModelConfig = ModelConfig(), group_rows: int = GROUP_ROWS) -> Regressor:
    """Boosted trees on features whose missing values are their medians; beyond ``group_rows`` rows they grow over the whole table."""
    train = _ready(frame, features).filter(finite(target).isNotNull()).select(*dict.fromkeys([*features, target]))
    train = written(train, "train")  # read for medians, edges and means before the trees
    rows = train.count()
    if rows < config.least_rows:
        raise ValueError(f"fewer than {config.least_rows} rows to fit on")
    filled = [f"{f}__filled" for f in features]
    filler = Imputer(strategy="median", inputCols=features, outputCols=filled).fit(train)
    return Regressor(filler, tuple(filled), fit_pooled(filler.transform(train), filled, target, rows, config.boost(), group_rows))


def fit_classifier(frame: DataFrame, features: list[str], target: str, config: ModelConfig = ModelConfig()):
    train = _ready(frame, features).filter(finite(target).isNotNull()).withColumn("_up", (F.col(target) > 0).cast("double"))
    found = train.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_up").alias("classes")).first()
    if found["n"] < config.least_rows or found["classes"] < 2:
        raise ValueError("both directions and enough rows are needed")
    train = _dealt(train, found["n"])
    trees = GBTClassifier(labelCol="_up", maxDepth=config.depth, stepSize=config.step, maxIter=config.rounds, seed=config.seed)
    return Pipeline(stages=[*_stages(features), trees]).fit(train)


def predict(model, frame: DataFrame, features: list[str], name: str = "predicted") -> DataFrame:
    out = model.transform(_ready(frame, features))
    if "probability" in out.columns:
        out = out.withColumn(name, vector_to_array("probability")[1]).drop("prediction")
    else:
        out = out.withColumnRenamed("prediction", name)
    return out.select(*frame.columns, name)


def fit_ridge(frame: DataFrame, features: list[str], target: str, penalty: float = 1.0):
    model = LinearRegression(labelCol=target, regParam=penalty, elasticNetParam=0.0)
    return Pipeline(stages=[*_stages(features), model]).fit(_ready(frame, features).filter(finite(target).isNotNull()))


def _together(spark: SparkSession, fit: Callable, each: list) -> list:
    """``fit`` of each, several at a time: trees are many short jobs, which leave cores idle between them."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), each))


def ensemble(train: DataFrame, test: DataFrame, quant: list[str], combined: list[str], target: str, config: ModelConfig = ModelConfig(), weight: float = 0.35) -> DataFrame:
    """Weighted prediction of two models and a confidence by the spread of the predictions of the frame predicted."""
    train = written(train.select(*dict.fromkeys([*quant, *combined, target])), "ensemble-train")
    a, b = _together(train.sparkSession, lambda features: fit_regressor(train, features, target, config), [quant, combined])
    out = predict(b, predict(a, test, quant, "quant_prediction"), combined, "combined_prediction")
    out = written(out.withColumn("expected_return", weight * F.col("quant_prediction") + (1 - weight) * F.col("combined_prediction")), "ensemble")
    scale = out.agg(F.stddev_pop("expected_return").alias("_scale"))
    return out.crossJoin(F.broadcast(scale)).withColumn("probability_up", logistic_confidence(F.col("expected_return"), F.col("_scale"))).drop("_scale")  # one row


def run_experiment(frame: DataFrame, name: str, features: list[str], target: str = "target_return", config: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    """One result row: rows, mean, Sharpe ratio, drawdown, gains and directional accuracy out of sample.

    Only rows that have all features and the target are used.
    """
    if not features:
        raise ValueError("an experiment needs features")
    return _experiment(_split(frame, features, target, config), name, features, target, config)


def _split(frame: DataFrame, features: list[str], target: str, config: ExperimentConfig) -> DataFrame:
    """The usable rows by ``part``, written once: counts, fit and predictions read them."""
    used = _usable(frame, features, target).select(*dict.fromkeys(["symbol", "timestamp", "target_timestamp", "open", "close", *features, target]))
    return written(purged_split(used, config.train_fraction), "split")


def _experiment(split: DataFrame, name: str, features: list[str], target: str, config: ExperimentConfig) -> DataFrame:
    counts = split.agg(F.count(F.lit(1)).alias("usable"), F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test")).first()
    for what, least in (("usable", config.least_usable), ("train", config.least_train), ("test", config.least_test)):
        if counts[what] < least:
            raise ValueError(f"{counts[what]} {what} rows; {least} are needed")
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    scored = written(predict(fit_regressor(train, features, target, config.model), test, features), "scored")
    traded = signals(scored, "predicted", config.hold, config.threshold, config.long_only, config.cost_bps).withColumn("name", F.lit(name))
    accuracy = diagnostics(scored.withColumn("name", F.lit(name)), "predicted", target, ["name"]).select("name", "directional_accuracy")
    return summarize(traded, ["name"]).join(accuracy, "name").select("name", F.col("observations").alias("rows"), "mean_return", "sharpe", "max_drawdown", "win_rate", "directional_accuracy")


def evaluate_pooled(frame: DataFrame, features: list[str], target: str = "target_return", config: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    """One model of all symbols together, judged on the rows after the cut: ``symbols`` and the columns of an experiment but its name."""
    require_columns(frame, ["timestamp", "symbol", "close", target, *features], "frame")
    pooled = ExperimentConfig(**{**vars(config), "least_usable": 0})
    split = _split(frame, features, target, pooled)
    result = _experiment(split, "pooled", features, target, pooled)
    return split.filter("part = 'test'").agg(F.count_distinct("symbol").alias("symbols")).crossJoin(result).drop("name")  # single rows


def default_experiment_specs(columns: list[str]) -> dict[str, list[str]]:
    """The default feature sets, of columns that are present; an error where none is."""
    present = lambda names: [c for c in names if c in columns]
    quant, sentiment, regime = present(QUANT_FEATURES), present(SENTIMENT_FEATURES), present(REGIME_FEATURES)
    both = quant + sentiment
    if not both:
        raise ValueError("no column of the default feature sets")
    specs = {"quant_only": quant, "sentiment_only": sentiment, "quant_plus_sentiment": both if quant and sentiment else [], "combined_regime": both + regime}
    return {name: own for name, own in specs.items() if own}


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """Feature sets by column name, the empty ones left out."""
    groups = {
        "momentum": ("ret_", "momentum_"), "volatility": ("vol_", "volatility_", "range_", "atr_"), "volume": ("volume_", "relative_volume"), "sentiment": ("sentiment_", "event_", "news_"),
    }
    sets = {name: [c for c in columns if c.startswith(start)] for name, start in groups.items()}
    sets["all"] = [c for own in sets.values() for c in own]
    return {k: v for k, v in sets.items() if v}


def run_suite(frame: DataFrame, sets: dict[str, list[str]] | None = None, target: str = "target_return", config: ExperimentConfig = ExperimentConfig()) -> DataFrame:
    """All feature sets on one frame; the loop is over a handful of sets, the work of each is distributed."""
    results, sets = None, sets or feature_sets(frame.columns)
    needed = list(dict.fromkeys(["symbol", "timestamp", "target_timestamp", "open", "close", *(c for own in sets.values() for c in own), target]))
    require_columns(frame, needed, "frame")
    frame = written(frame.select(*needed), "suite")
    for one in _together(frame.sparkSession, lambda named: run_experiment(frame, *named, target, config), list(sets.items())):
        results = one if results is None else results.unionByName(one)
    return results


def naive_zero(frame: DataFrame, name: str = "predicted") -> DataFrame:
    """The baseline that expects nothing."""
    return frame.withColumn(name, F.lit(0.0))


# one linear model per group, all groups in one pass ------------------------------


def _solver(features: int, penalty: float):
    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        """Intercept and weights of ridge regression on standardised features, from the sums over a group."""
        out = []
        for row in sums:
            n, y = row[0], row[1]
            x, xy = np.array(row[2 : 2 + features]), np.array(row[2 + features : 2 + 2 * features])
            products = np.zeros((features, features))
            products[np.triu_indices(features)] = row[2 + 2 * features :]
            products = products + np.triu(products, 1).T
            spread = np.sqrt(np.maximum(np.diag(products) / n - (x / n) ** 2, 0))
            unit = np.where(spread > 0, spread, 1.0)
            gram = (products - np.outer(x, x) / n) / np.outer(unit, unit)
            weights = np.linalg.solve(gram + penalty * np.eye(features), (xy - x * y / n) / unit) / unit
            out.append([float(y / n - weights @ x / n), *map(float, weights)])
        return pd.Series(out)

    return solve


def grouped_ridge(train: DataFrame, groups: list[str], features: list[str], target: str, penalty: float = 1.0) -> DataFrame:
    """One row per group: its columns, ``train_rows`` and ``model`` (intercept, then weights).

    Sums of products are combined on the map side, so a group costs one row a task however
    many rows it has, and any number of groups is fitted in one pass.
    """
    y, x = F.col(target), [F.col(f) for f in features]
    pairs = [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
    terms = [F.lit(1.0), y, *x, *(c * y for c in x), *pairs]
    sums = train.groupBy(*groups).agg(F.count(F.lit(1)).alias("train_rows"), F.array(*(F.sum(t.cast("double")) for t in terms)).alias("_sums"))
    return sums.select(*groups, "train_rows", _solver(len(features), penalty)("_sums").alias("model"))


def _scored(test: DataFrame, models: DataFrame, groups: list[str], features: list[str], name: str) -> DataFrame:
    fitted = test.join(models, groups)
    value = sum((F.get("model", F.lit(k)) * F.col(f) for k, f in enumerate(features, 1)), F.get("model", F.lit(0)))
    return fitted.withColumn(name, value)


def _usable(frame: DataFrame, features: list[str], target: str) -> DataFrame:
    require_columns(frame, ["timestamp", target, *features], "frame")
    known = F.lit(True)
    for c in (*features, target):
        known &= finite(c).isNotNull()
    return frame.filter(known)


def _fold_results(scored: DataFrame, target: str, cost_bps: float) -> DataFrame:
    """Span, rows, errors, direction and mean returns before and after costs of each fold; ``_p`` is the prediction."""
    a, p = F.col(target), F.col("_p")
    gross = F.avg(F.signum(p) * a)
    return scored.groupBy("fold", "train_end").agg(
        F.min("timestamp").alias("test_start"), F.max("timestamp").alias("test_end"), F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(a - p)).alias("mae"), (1 - F.try_divide(F.avg((a - p) * (a - p)), F.when(F.var_pop(a) > 0, F.var_pop(a)))).alias("r2"),
        F.avg((F.signum(p) == F.signum(a)).cast("double")).alias("directional_accuracy"), gross.alias("mean_strategy_return"), (gross - 2 * cost_bps / 10_000).alias("net_mean_strategy_return"),
    )


def _folds(frame: DataFrame, features: list[str], target: str, sizes: tuple[int, int, int], order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``fold`` and ``part``, written once, and the end of each fold's train part."""
    if min(sizes) < 1:
        raise ValueError("train_size, test_size and step are 1 at least")
    rows = written(walk_forward_folds(_usable(frame, features, target), *sizes, list(order)), "folds")
    ends = rows.filter("part = 'train'").groupBy("fold").agg(F.max("timestamp").alias("train_end"))
    return rows, ends


def walk_forward_regression(
    frame: DataFrame, features: list[str], train_size: int, test_size: int, step: int, target: str = "target_return", cost_bps: float = 0.0, order: tuple[str, ...] = ("timestamp", "symbol"), least_train: int = 50,
    config: ModelConfig = ModelConfig(), group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per fold, predicted by boosted trees of the fold's own train rows; folds with few train rows are left out."""
    rows, ends = _folds(frame, features, target, (train_size, test_size, step), order)
    slim = rows.select("fold", "part", "timestamp", target, *features)
    scored = boosted_predictions(slim, "fold", features, target, "_p", config.boost(), least_train, group_rows)
    return _fold_results(scored.join(ends, "fold"), target, cost_bps)


def walk_forward_ridge(
    frame: DataFrame, features: list[str], train_size: int, test_size: int, step: int, target: str = "target_return", cost_bps: float = 0.0, order: tuple[str, ...] = ("timestamp", "symbol"), least_train: int = 50, penalty: float = 1.0,
) -> DataFrame:
    """As ``walk_forward_regression``, with a ridge regression per fold."""
    rows, ends = _folds(frame, features, target, (train_size, test_size, step), order)
    models = grouped_ridge(rows.filter("part = 'train'"), ["fold"], features, target, penalty).filter(F.col("train_rows") >= least_train).join(ends, "fold")
    return _fold_results(_scored(rows.filter("part = 'test'"), models, ["fold"], features, "_p"), target, cost_bps)


def fit_predict_oos(frame: DataFrame, features: list[str], target: str = "target_return", train_fraction: float = 0.7, config: ModelConfig = ModelConfig(), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Test rows of every symbol with enough rows, with ``expected_return`` of the symbol's own boosted trees and its ``signal``."""
    parts = written(per_symbol_cut(_usable(frame, features, target), train_fraction), "symbol-parts")
    if parts.isEmpty():
        raise ValueError("no symbol has enough rows")
    scored = boosted_predictions(parts, "symbol", features, target, "expected_return", config.boost(), config.least_rows, group_rows)
    return scored.withColumn("signal", F.signum("expected_return")).drop("part")


def fit_predict_ridge(frame: DataFrame, features: list[str], target: str = "target_return", train_fraction: float = 0.7, penalty: float = 1.0) -> DataFrame:
    """As ``fit_predict_oos``, with a ridge regression per symbol."""
    parts = per_symbol_cut(_usable(frame, features, target), train_fraction)
    models = grouped_ridge(parts.filter("part = 'train'"), ["symbol"], features, target, penalty)
    scored = _scored(parts.filter("part = 'test'"), models, ["symbol"], features, "expected_return")
    return scored.withColumn("signal", F.signum("expected_return")).drop("part", "train_rows", "model")


def research_summary(results: DataFrame) -> DataFrame:
    """Experiments, how many have a positive Sharpe ratio, and the best by it."""
    best = F.struct("sharpe", "name")
    return results.agg(F.count(F.lit(1)).alias("experiments"), F.count_if(F.col("sharpe") > 0).alias("positive_sharpe"), F.max(F.when(F.col("sharpe").isNotNull(), best)).alias("_b")).select("experiments", "positive_sharpe", F.col("_b.name").alias("best_name"), F.col("_b.sharpe").alias("best_sharpe"))
