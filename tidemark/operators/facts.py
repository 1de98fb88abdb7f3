"""Bitemporal company facts: canonical picks, period semantics, growth, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import LEGACY_TAGS, TAG_METRICS, TAG_PRECEDENCE
from tidemark.functions.scalars import INSTANT_METRICS, duration_kind, period_type
from tidemark.operators.temporal import latest_per
from tidemark.schema import days_between, require_columns

IDENTITY = ["cik", "metric", "unit", "start", "end"]


def _lookup(mapping: dict, key, default=None):
    table = F.create_map(*(v for k, x in mapping.items() for v in (F.lit(k), F.lit(x))))
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def tag_metrics(tags: dict[str, tuple[str, ...]] = LEGACY_TAGS) -> dict[str, str]:
    """The metric of each tag, from the tags of each metric; for ``with_metric``."""
    return {tag: metric for metric, own in tags.items() for tag in own}


def with_metric(facts: DataFrame, tags: dict[str, str] = TAG_METRICS) -> DataFrame:
    """Metric of a fact by its own column or its tag; unmapped facts drop out."""
    known = _lookup(tags, F.col("tag"))
    metric = F.coalesce("metric", known) if "metric" in facts.columns else known
    return facts.withColumn("metric", metric).filter(F.col("metric").isNotNull())


def resolve_observations(facts: DataFrame) -> DataFrame:
    """One fact per (cik, metric, unit, start, end, information_time): best tag, then tag, then accession (null last, so it wins)."""
    rows = with_metric(facts).withColumn("tag_precedence", _lookup(TAG_PRECEDENCE, F.col("tag"), 0))
    rows = rows.withColumn("period_type", period_type(F.col("start"), F.col("end")))
    order = [F.col("tag_precedence").desc(), F.col("tag").desc_nulls_first(), F.col("accn").desc_nulls_first(), F.col("val_num").desc_nulls_last()]
    return latest_per(rows, [*IDENTITY, "information_time"], order)


# The columns of a source row's identity.
SOURCE_IDENTITY = ("cik", "tag", "unit", "start", "end", "information_time", "accn", "val_num")


def resolve_report(facts: DataFrame, eligible: DataFrame, resolved: DataFrame) -> DataFrame:
    """Input, eligible and output rows, how many went, all rows that collided, all rows with an equal source row, entities."""

    def repeated(keys: list[str], name: str) -> DataFrame:
        sizes = eligible.groupBy(*keys).count().filter("count > 1")
        return sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias(name))

    out = (
        facts.agg(F.count(F.lit(1)).alias("input_rows"))
        .crossJoin(eligible.agg(F.count(F.lit(1)).alias("eligible_rows")))
        .crossJoin(resolved.agg(F.count(F.lit(1)).alias("output_rows"), F.count_distinct("cik").alias("ciks")))
        .crossJoin(repeated([*IDENTITY, "information_time"], "collision_rows"))
        .crossJoin(repeated([c for c in SOURCE_IDENTITY if c in eligible.columns], "exact_source_duplicates"))  # five single rows
    )
    return out.withColumn("rows_reduced", F.col("eligible_rows") - F.col("output_rows"))


def attach_information_time(facts: DataFrame, submissions: DataFrame) -> DataFrame:
    """When a fact became known: acceptance time, else the filing date, else the fact's own filed date.

    Of several rows of an accession the last by ``position`` counts.
    """
    last = latest_per(submissions, ["cik", "accn"], [F.col("position").desc()]).select("cik", "accn", F.col("acceptance_time").alias("_accepted"), F.col("filing_date").alias("_filing"))
    joined = facts.join(last, ["cik", "accn"], "left")
    return joined.withColumn("information_time", F.coalesce("_accepted", "_filing", "filed")).drop("_accepted", "_filing")


def period_semantics(observations: DataFrame) -> DataFrame:
    """Length and kind of the reporting period and the feature name that goes with it."""
    require_columns(observations, ["metric", "start", "end"], "observations")
    instant = F.col("start").isNull() | F.col("metric").isin(*INSTANT_METRICS)
    out = observations.withColumn("period_days", days_between(F.col("end"), F.col("start")))
    out = out.withColumn("reporting_kind", F.when(instant, "instant").otherwise("duration")).withColumn("duration_kind", F.when(~instant, duration_kind(F.col("period_days"))))
    return out.withColumns(
        {
            "is_quarter": F.coalesce(F.col("duration_kind") == "quarter", F.lit(False)),
            "is_annual": F.coalesce(F.col("duration_kind") == "annual", F.lit(False)),
            "is_instant": instant,
            "feature_name": F.concat_ws("_", F.lit("sec"), "metric", F.coalesce("duration_kind", F.lit("instant"))),
        }
    )


def latest_revision(observations: DataFrame, keys: list[str] = IDENTITY, ties: tuple[str, ...] = ("val_num",)) -> DataFrame:
    return latest_per(observations, keys, [F.col("information_time").desc(), *(F.col(t).desc_nulls_last() for t in ties)])


def latest_asof(facts: DataFrame, moment, ciks: list[int] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Facts as known at one moment: last per period by time, then accession."""
    seen = facts.filter(F.col("information_time") <= moment)
    if ciks:
        seen = seen.filter(F.col("cik").isin(ciks))
    if metrics:
        seen = seen.filter(F.col("metric").isin(metrics))
    return latest_revision(seen, ties=("accn",) if "accn" in facts.columns else ("val_num",))


def latest_period(observations: DataFrame, moment) -> DataFrame:
    """Of the facts known at a moment those of the newest period end of each metric and unit (may be several)."""
    current = latest_asof(observations, moment)
    newest = F.max("end").over(Window.partitionBy("cik", "metric", "unit"))
    return current.withColumn("_newest", newest).filter(F.col("end").eqNullSafe(F.col("_newest"))).drop("_newest")


def growth_columns(quarters: DataFrame, group: list[str], raw_count: str, value: str = "val_num") -> DataFrame:
    """Quarter-over-quarter and year-over-year growth and trailing sums of consecutive quarters.

    ``quarters`` has one row per period of a group.  Ends of neighbours lie 70 to 110
    days apart, of a year 300 to 430; a year's growth looks four rows back and needs
    five raw rows, a trailing sum needs four rows without a gap.
    """
    w = Window.partitionBy(*group).orderBy("end", F.col("start").asc_nulls_last())
    gap = F.datediff("end", F.lag("end").over(w))
    steps = quarters.withColumns({"_near": gap.between(70, 110), "_prev": F.lag(value).over(w), "_year": F.lag(value, 4).over(w), "_span": F.datediff("end", F.lag("end", 4).over(w))})
    last3, last4 = w.rowsBetween(-2, 0), w.rowsBetween(-3, 0)
    whole = (F.count(value).over(last4) == 4) & (F.sum(F.when(F.col("_near"), 1).otherwise(0)).over(last3) == 3)
    out = steps.withColumns(
        {
            "qoq_growth": F.when(F.col("_near"), F.try_divide(F.col(value), F.col("_prev")) - 1),
            "yoy_growth": F.when(F.col("_span").between(300, 430) & (F.col(raw_count) >= 5), F.try_divide(F.col(value), F.col("_year")) - 1),
            "ttm": F.when(whole & (F.col(raw_count) >= 4), F.sum(value).over(last4)),
        }
    )
    return out.withColumn("ttm_available", F.col("ttm").isNotNull()).drop("_near", "_prev", "_year", "_span")


def derived_features(observations: DataFrame) -> DataFrame:
    """Growth and trailing sums on the latest revision of each quarter; other rows stay and are null.

    Ties in information time go to the larger value.
    """
    group = ["cik", "metric", "unit"]
    semantic = observations if "is_quarter" in observations.columns else period_semantics(observations)
    place = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(F.col("information_time").desc(), F.col("val_num").desc_nulls_last()))
    raw = F.sum(F.col("is_quarter").cast("int")).over(Window.partitionBy(*group))
    marked = semantic.withColumn("_raw", raw).withColumn("_last", (place == 1) & F.col("is_quarter"))
    filled = growth_columns(marked.filter("_last"), group, "_raw")
    rest = marked.filter("NOT _last")
    return filled.unionByName(rest, allowMissingColumns=True).withColumn("ttm_available", F.coalesce("ttm_available", F.lit(False))).drop("_raw", "_last")


def fundamental_snapshot(current: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per cik with the newest yearly or instant value of each metric, and two ratios."""
    fits = F.col("start").isNull() | F.col("end").isNull() | days_between(F.col("end"), F.col("start")).between(300, 380)
    newest = latest_per(current.filter(fits & F.col("cik").isNotNull()), ["cik", "metric"], [F.col("end").desc_nulls_last(), F.col("information_time").desc(), F.col("unit").desc_nulls_last(), F.col("val_num").desc_nulls_last()])
    wide = newest.groupBy("cik").pivot("metric", metrics).agg(F.first("val_num"))
    return snapshot_ratios(wide)


def snapshot_ratios(wide: DataFrame) -> DataFrame:
    have = set(wide.columns)
    ratio = lambda a, b: F.try_divide(F.col(a), F.when(F.col(b) != 0, F.col(b))) if {a, b} <= have else F.lit(None).cast("double")
    return wide.withColumns({"net_margin": ratio("net_income", "revenue"), "debt_to_assets_proxy": ratio("liabilities", "assets")})


def universe_map(universe: DataFrame, entities: DataFrame) -> DataFrame:
    """Symbols joined with the entities whose ticker list has their root; ``unique`` or ``ambiguous``."""
    from tidemark.functions.scalars import ticker_root

    listed = entities.withColumn("ticker", F.explode(F.array_distinct(F.transform(F.split("tickers", ";"), lambda t: F.split_part(F.upper(F.trim(t)), F.lit("."), F.lit(1)))))).filter("ticker <> ''")
    rooted = universe.withColumn("ticker_root", ticker_root(F.col("symbol")))
    joined = rooted.join(listed.drop("tickers"), F.col("ticker_root") == F.col("ticker")).drop("ticker")
    counts = joined.groupBy("symbol").agg(F.count_distinct("cik").alias("cik_count"))
    return joined.join(counts, "symbol").withColumn("mapping_status", F.when(F.col("cik_count") == 1, "unique").otherwise("ambiguous"))
