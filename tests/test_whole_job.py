"""Registered queries do the whole job: rounds and resamples are those of the operators and the reference."""

import inspect

import numpy as np
import pytest

from tidemark.operators import models, research
from tidemark.plans import catalogue

SMALL = "/root/testdata/sf0.001"


class Stopped(Exception):
    pass


@pytest.mark.parametrize(("query", "fit"), [("ml_experiment", "fit_regressor"), ("ml_direction", "fit_classifier")])
def test_model_queries_fit_all_rounds(spark, monkeypatch, query, fit):
    seen = []

    def record(frame, features, target, config=models.ModelConfig()):
        seen.append(config.rounds)
        raise Stopped

    monkeypatch.setattr(models, fit, record)
    with pytest.raises(Stopped):
        catalogue.QUERIES[query](spark, SMALL)
    assert seen == [250]


def test_bootstrap_draws_two_thousand_resamples(spark, monkeypatch):
    assert inspect.signature(research.bootstrap_mean).parameters["rounds"].default == 2000
    asked, own = [], research.bootstrap_mean

    def record(frame, column, rounds=2000, **more):
        asked.append(rounds)
        return own(frame, column, rounds, **more)

    monkeypatch.setattr(research, "bootstrap_mean", record)
    got = catalogue.QUERIES["bootstrap_ci"](spark, SMALL).first()
    assert asked == [2000] and got["low"] < got["mean"] < got["high"]


def test_bootstrap_interval_has_the_width_of_the_mean(spark):
    x = np.random.default_rng(3).normal(1.0, 2.0, 400)
    frame = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    got = research.bootstrap_mean(frame, "x").first()
    assert got["n"] == 400 and abs(got["mean"] - x.mean()) < 1e-9
    half = 1.96 * x.std() / 20
    assert abs(got["low"] - (x.mean() - half)) < 0.15 * half and abs(got["high"] - (x.mean() + half)) < 0.15 * half
    for few in ([], [(2.0,)]):
        one = research.bootstrap_mean(spark.createDataFrame(few, "x double"), "x").first()
        assert one["n"] == len(few) and one["low"] is None and one["high"] is None


def test_ages_shuffle_no_grid(spark):
    plan = catalogue.QUERIES["observation_ages"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # before: a window over all rows of decisions and periods


def test_leakage_guard_shuffles_no_grid(spark):
    plan = catalogue.QUERIES["leakage_guard"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
