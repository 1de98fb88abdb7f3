"""Panel builders: company features per decision, macro features, the unified panel.

Company features change only when something becomes known.  They are therefore
computed per (cik, metric, epoch), an epoch being a distinct information time of the
metric, carried forward over the company's epochs, and decisions then look their epoch
up with one as-of join.  Growth is computed on what each epoch knew, never on later
revisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import generic_labels, us_equity_labels
from tidemark.operators.facts import growth_columns, period_semantics
from tidemark.operators.macro import macro_wide
from tidemark.operators.temporal import asof_join, latest_per
from tidemark.schema import assert_unique, days_between
from tidemark.session import written

SUFFIXES = ("instant", "quarter", "qoq_growth", "yoy_growth", "ttm")


#: Days before the newest quarter's end in which growth and trailing sums look back.
REACH = 430


def epoch_features(observations: DataFrame) -> DataFrame:
    """``cik, epoch, metric, instant, instant_time, quarter, quarter_time, qoq_growth, yoy_growth, ttm``, a row where a metric changes.

    The newest period and its latest revision are a running maximum over what became known.  Growth needs the
    quarters of the ``REACH`` days before it only, so an epoch meets the revisions of those few, by a
    bucket of their ends, and never all revisions of its metric.
    """
    read = ["cik", "metric", "unit", "start", "end", "information_time", "val_num"]
    facts = written(observations.select(*read).filter(F.col("information_time").isNotNull()), "observations")  # three branches read them
    facts = period_semantics(facts)
    group = ["cik", "metric", "epoch"]
    so_far = Window.partitionBy("cik", "metric").orderBy("information_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # later ends first, then units, then starts (none before all); of one period the latest revision, then the larger value
    parts = [F.col("end").isNotNull(), "end", F.col("unit").isNotNull(), "unit", F.col("start").isNull(), "start", "information_time", F.col("val_num").isNotNull(), "val_num"]
    ranked = F.struct(*(F.col(c).alias(c) if isinstance(c, str) else c.alias(f"o{k}") for k, c in enumerate(parts)))
    newest = facts.select(
        "cik", "metric", F.col("information_time").alias("epoch"), F.max(F.when(F.col("is_instant"), ranked)).over(so_far).alias("i"), F.max(F.when(F.col("is_quarter"), ranked)).over(so_far).alias("q")
    ).dropDuplicates(group)
    return newest.join(_quarter_growth(newest.filter("q IS NOT NULL"), facts.filter("is_quarter")), group, "left").select(
        "cik", "epoch", "metric", F.col("i.val_num").alias("instant"), F.col("i.information_time").alias("instant_time"), F.col("q.val_num").alias("quarter"), F.col("q.information_time").alias("quarter_time"),
        "qoq_growth", "yoy_growth", "ttm",
    )


def _quarter_growth(newest: DataFrame, quarters: DataFrame) -> DataFrame:
    """``cik, metric, epoch`` and the growth of the newest quarter ``q``, from what its epoch knew."""
    keys = ["cik", "metric", "unit"]
    bucket = F.floor(F.datediff("end", F.lit("1970-01-01")) / REACH)
    # a revision is current from its own time to the next one's
    revisions = Window.partitionBy(*keys, "start", "end").orderBy("information_time", F.col("val_num").asc_nulls_first())
    timed = quarters.select(*keys, "start", "end", "val_num", F.col("information_time").alias("_since"), F.lead("information_time").over(revisions).alias("_until"), bucket.alias("_bucket"))
    asked = newest.select("cik", "metric", "epoch", F.col("q.unit").alias("unit"), F.col("q.end").alias("end"))
    # how many quarter rows of the unit an epoch knows: counted before epochs meet revisions, so that only their own rows are shuffled for it
    steps = quarters.groupBy(*keys, F.col("information_time").alias("epoch")).agg(F.count(F.lit(1)).alias("_raw"))
    steps = steps.withColumn("_asked", F.lit(False)).unionByName(asked.withColumns({"_raw": F.lit(0).cast("long"), "_asked": F.lit(True)}), allowMissingColumns=True)
    known = F.sum("_raw").over(Window.partitionBy(*keys).orderBy("epoch").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = steps.withColumn("_raw", known).filter("_asked").drop("_asked")
    both = counted.withColumn("_bucket", F.explode(F.array(bucket, bucket - 1))).withColumnRenamed("end", "_last")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*keys, "_bucket")]
    met = both.alias("a").join(timed.alias("t"), same).filter("t._since <= a.epoch AND (t._until IS NULL OR a.epoch < t._until)")
    near = met.filter(F.datediff("a._last", "t.end").between(0, REACH)).select(*(f"a.{c}" for c in keys), "a.epoch", "a._raw", "t.start", "t.end", "t.val_num")
    grown = growth_columns(near, [*keys, "epoch"], "_raw")
    last = latest_per(grown, [*keys, "epoch"], [F.col("end").desc(), F.col("start").desc_nulls_first()])
    return last.select("cik", "metric", "epoch", "qoq_growth", "yoy_growth", "ttm")


def sec_features(decisions: DataFrame, observations: DataFrame, metrics: list[str], key: str | list[str] = "_decision_id") -> DataFrame:
    """One row per decision (``key``: its unique columns) with ``sec_<metric>_<feature>`` and ages in days; a null cik has only nulls."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = (*SUFFIXES, "instant_time", "quarter_time")
    states = epoch_features(observations).groupBy("cik", "epoch").pivot("metric", metrics).agg(F.first(F.struct(*parts)))
    so_far = Window.partitionBy("cik").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    carried = states.withColumns({m: F.last(m, ignorenulls=True).over(so_far) for m in metrics})
    wide = carried.select("cik", "epoch", *(F.col(f"`{m}`.{p}").alias(f"{m}_{p}") for m in metrics for p in parts))
    payload = [c for c in wide.columns if c not in ("cik", "epoch")]
    asked = decisions.select(*dict.fromkeys([*keys, "cik", "decision_time"])).filter(F.col("cik").isNotNull())
    joined = asof_join(asked, wide, ["cik"], "decision_time", "epoch", payload, prefix="sec_")
    columns = {}
    for m in metrics:
        for kind in ("instant", "quarter"):
            columns[f"sec_{m}_{kind}_age_days"] = days_between(F.col("decision_time"), F.col(f"sec_{m}_{kind}_time"))
    times = [f"sec_{m}_{k}_time" for m in metrics for k in ("instant", "quarter")]
    out = joined.withColumns(columns).drop("sec_time", *times, *(c for c in ("decision_time", "cik") if c not in keys))
    return decisions.select(*keys).join(out, keys, "left")


def unified_panel(bars: DataFrame, observations: DataFrame, vintages: DataFrame, master: DataFrame, metrics: list[str], series: list[str], session: str = "us_equity_daily") -> DataFrame:
    """One row per symbol and decision: bar, label, company and macro features known at the decision.

    Joins go by symbol and decision time; bars that would give two rows of one decision are refused.
    """
    assert_unique(bars, ["symbol", "timestamp"], "bars")
    if session == "us_equity_daily":
        labelled = us_equity_labels(bars)
    elif session == "generic_daily":
        labelled = generic_labels(bars)
    else:
        raise ValueError(f"unknown market session {session!r}")
    complete = labelled.filter("label_available")
    key = ["symbol", "decision_time"]
    unique_master = latest_per(master.select("symbol", F.col("cik").alias("_cik")), ["symbol"], [F.col("_cik").asc_nulls_last()])
    keyed = complete.join(unique_master, "symbol", "left")
    keyed = keyed.withColumn("cik", F.coalesce("cik", "_cik") if "cik" in bars.columns else F.col("_cik")).drop("_cik")
    keyed = written(keyed, "panel-decisions")  # three branches read it
    with_sec = keyed.join(sec_features(keyed, observations, metrics, key), key, "left")
    return with_sec.join(macro_wide(keyed, vintages, series, key), key, "left")
