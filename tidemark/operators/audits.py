"""Readiness gates, data audits, reports and reference-data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import LEVERAGED_INVERSE, SECURITY_TYPES, UNIVERSE_PROFILES, UNIVERSES
from tidemark.functions.scalars import non_common, ticker_root
from tidemark.operators.temporal import latest_per
from tidemark.schema import to_number, to_time

# The columns, where a table has them, that make rows duplicates at each grain.
SOURCE_KEYS = ("cik", "taxonomy", "tag", "unit", "start", "end", "filed", "form", "frame", "fy", "fp", "accn", "val", "information_time")
FILING_KEYS = ("cik", "metric", "start", "end", "unit", "information_time", "accn", "form", "filed", "val")
ALIAS_KEYS = ("cik", "metric", "unit", "start", "end", "information_time", "accn")
ECONOMIC_KEYS = ("cik", "metric", "unit", "start", "end", "information_time")

# Columns that a fact event must have.
FACT_REQUIRED = ("cik", "entity_name", "taxonomy", "tag", "unit", "start", "end", "filed", "form", "accn", "val", "information_time")


def readiness(frame: DataFrame, min_rows: int = 750, min_symbols: int = 5, min_days: int = 730) -> DataFrame:
    """Rows per symbol, span and a status: too few symbols or rows is NOT_READY, a short span warns."""
    per = frame.filter(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    out = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("symbols"), F.min("n").alias("min_rows"), F.median("n").alias("median_rows"), F.max("n").alias("max_rows"),
        F.min("a").alias("start"), F.max("b").alias("end"),
    ).withColumn("calendar_days", F.datediff("end", "start").cast("long"))
    few = (F.col("symbols") < min_symbols) | (F.coalesce("min_rows", F.lit(0)) < min_rows)
    short = F.coalesce("calendar_days", F.lit(0)) < min_days
    return out.withColumn("status", F.when(few, "NOT_READY").when(short, "READY_WITH_WARNINGS").otherwise("READY")).withColumn("ready_for_ml", F.col("status") != "NOT_READY")


def grain_columns(facts: DataFrame, keys: tuple[str, ...]) -> list[str]:
    """The columns of a grain that the table has; ``val_num`` stands for a missing ``val``."""
    names = set(facts.columns)
    return [c if c in names else "val_num" for c in keys if c in names or (c == "val" and "val_num" in names)]


def duplicate_counts(facts: DataFrame, grains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows, distinct keys and repeated rows at each grain; nulls are equal."""
    grains = grains or {"source_exact": SOURCE_KEYS, "metric_alias": ALIAS_KEYS, "economic": ECONOMIC_KEYS}
    parts = []
    for grain, keys in grains.items():
        cut = facts.groupBy(*grain_columns(facts, keys)).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"))
        repeats = F.col("rows") - F.col("distinct_keys")
        parts.append(cut.select(F.lit(grain).alias("grain"), "rows", "distinct_keys", repeats.alias("duplicates"), F.try_divide(repeats, F.col("rows")).alias("rate")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def duplicate_samples(facts: DataFrame, keys: tuple[str, ...] = SOURCE_KEYS, limit: int = 20) -> DataFrame:
    """Up to ``limit`` repeated rows: a report's sample."""
    place = F.row_number().over(Window.partitionBy(*grain_columns(facts, keys)).orderBy(*(F.col(c).asc_nulls_last() for c in facts.columns)))
    return facts.withColumn("_place", place).filter("_place > 1").drop("_place").limit(limit)


def audit_facts(facts: DataFrame) -> DataFrame:
    """Counts, nulls of every required column, late-known rows, repeats, a status and what it warns of, in one row.

    Exact duplicates agree in the whole filing key, economic ones in metric, period, unit and time
    (they may be restatements).  FAIL dominates.  Times that are text count as parse failures where they are no timestamps.
    """
    info = F.expr("try_cast(information_time AS TIMESTAMP)")
    base = facts.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cik").alias("ciks"),
        F.count_if(F.col("information_time").isNull()).alias("null_information_time"), F.count_if(F.col("val_num").isNull()).alias("null_values"),
        F.count_if(F.col("information_time") > F.col("filed") + F.expr("INTERVAL 1 DAY")).alias("late_rows"),
        F.min("information_time").alias("first_time"), F.max("information_time").alias("last_time"),
        F.count_if(info.isNull()).alias("time_parse_failures"),
        F.struct(*(F.count_if(F.col(c).isNull()).alias(c) for c in FACT_REQUIRED if c in facts.columns)).alias("required_nulls"),
    )
    counts = duplicate_counts(facts, {"exact": FILING_KEYS, "economic": ECONOMIC_KEYS}).groupBy().pivot("grain", ["exact", "economic"]).agg(F.first("duplicates"))
    out = base.crossJoin(counts.select(F.col("exact").alias("exact_duplicates"), F.col("economic").alias("economic_duplicates")))  # single rows
    fails = {"no fact rows": F.col("rows") == 0, "rows without information_time": F.col("null_information_time") > 0}
    warns = {
        "repeated metric, period and time, which may be restatements and need an order of precedence": F.col("economic_duplicates") > 0,
        "repeated filing rows in the source or its import": F.col("exact_duplicates") > 0,
        "rows known more than a day after their filing date": F.col("late_rows") > 0,
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(text)) for text, rule in (fails | warns).items())))
    either = lambda rules: F.greatest(*rules.values())
    status = F.when(either(fails), "FAIL").when(either(warns), "PASS_WITH_WARNINGS").otherwise("PASS")
    return out.withColumns({"status": status, "warnings": found})


def audit_company_facts(facts: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """Totals with nulls of every column, taxonomies, and the most frequent forms of a Company Facts table."""
    totals = facts.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cik").alias("ciks"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"),
        F.struct(*(F.count_if(F.col(c).isNull()).alias(c) for c in facts.columns)).alias("nulls"),
    )
    return {"totals": totals, "taxonomies": histogram(facts, "taxonomy", "NA"), "forms": histogram(facts, "form", "NA", top)}


def histogram(frame: DataFrame, column: str, missing: str = "<missing>", top: int | None = None) -> DataFrame:
    counts = frame.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), column).limit(top) if top else counts


def validate_security_master(master: DataFrame) -> DataFrame:
    """Names of the violated rules and PASS or FAIL, in one row."""
    repeated = master.groupBy("symbol").count().agg(F.coalesce(F.max(F.col("count") > 1), F.lit(False)).alias("duplicate_symbols"))
    kind = F.col("security_type")
    rules = {
        "unsupported_security_type": ~F.coalesce(kind.isin(*SECURITY_TYPES), F.lit(False)),
        "invalid_common_equity": F.col("is_common_equity") & (F.col("is_etf") | F.col("is_leveraged") | F.col("is_inverse")),
        "leveraged_conflict": F.col("is_leveraged") & ~kind.isin("leveraged_etf", "etf"),
        "inverse_conflict": F.col("is_inverse") & ~kind.isin("inverse_etf", "etf"),
    }
    flags = master.agg(*(F.coalesce(F.max(rule), F.lit(False)).alias(name) for name, rule in rules.items()))
    names = ["duplicate_symbols", *rules]
    both = repeated.crossJoin(flags)  # single rows
    found = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))
    return both.select(F.array_join(found, ",").alias("violations"), F.when(F.size(found) == 0, "PASS").otherwise("FAIL").alias("status"))


def build_security_master(rows: DataFrame) -> DataFrame:
    """Symbols upper-cased and trimmed; per symbol the first by cik (null last) and type."""
    clean = rows.withColumn("symbol", F.upper(F.trim("symbol")))
    return latest_per(clean, ["symbol"], [F.col("cik").asc_nulls_last(), F.col("security_type").asc_nulls_last()])


def panel_report(panel: DataFrame, features: list[str], label: str = "label_available") -> DataFrame:
    """Rows, symbols, span, share of nulls per feature and of available labels."""
    share = lambda c: F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}")
    return panel.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.avg(F.col(label).cast("double")).alias("label_rate"), *(share(c) for c in features),
    )


def _invalid_ohlc() -> Column:
    """A bar that contradicts itself, or whose lowest price isn't positive."""
    wrong = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return wrong | (F.least("open", "high", "low", "close") <= 0)


def audit_bars(bars: DataFrame, asset_class: str = "equity", extreme: float = 0.5) -> DataFrame:
    """Duplicate keys, bars that contradict themselves, extreme returns, and a status.

    An equity file without an adjusted close warns; crypto needs none.
    """
    w = Window.partitionBy("symbol").orderBy("timestamp", "close")
    jump = F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) > extreme
    distinct = bars.groupBy("symbol", "timestamp").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_keys"))
    counts = bars.withColumn("_jump", jump).agg(F.count(F.lit(1)).alias("rows"), F.count_if(_invalid_ohlc()).alias("invalid_ohlc_rows"), F.count_if("_jump").alias("extreme_return_rows"))
    out = counts.crossJoin(distinct)  # single rows
    adjusted = "adjusted_close" in bars.columns
    warn = (F.col("extreme_return_rows") > 0) | F.lit(asset_class == "equity" and not adjusted)
    status = F.when((F.col("duplicate_keys") > 0) | (F.col("invalid_ohlc_rows") > 0), "FAIL").when(warn, "PASS_WITH_WARNINGS").otherwise("PASS")
    return out.withColumns({"has_adjusted_close": F.lit(adjusted), "asset_class": F.lit(asset_class), "status": status})


def audit_market_files(raw: DataFrame, extreme: float = 0.5) -> DataFrame:
    """One row per file of raw rows (strings, with ``_file`` and ``_columns``): what ``audit_bars`` counts, rows that can't be read, and warnings.

    Nothing is cleaned before.  A file whose name says crypto needs no adjusted close.
    """
    prices = ["open", "high", "low", "close"]
    number = lambda c: to_number(c) if c in raw.columns else F.lit(None).cast("double")
    rows = raw.select(F.col("_file").alias("file"), "_columns", F.trim("symbol").alias("symbol"), to_time("timestamp").alias("timestamp"), *(number(c).alias(c) for c in prices))
    whole = F.col("symbol").isNotNull() & F.col("timestamp").isNotNull() & F.least(*(F.col(c).isNotNull() for c in prices))
    w = Window.partitionBy("file", "symbol").orderBy("timestamp", "close")
    jump = F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) > extreme
    same = F.row_number().over(Window.partitionBy("file", "symbol", "timestamp").orderBy("close")) > 1
    marked = rows.withColumns({"_jump": jump, "_same": same & F.col("timestamp").isNotNull(), "_whole": whole})
    crypto = F.lower(F.regexp_extract("file", "[^/]*$", 0)).rlike("usdt|usdc|btc|eth|crypto|binance|coin")
    out = marked.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.count_if("_same").alias("duplicate_keys"), F.count_if(_invalid_ohlc()).alias("invalid_ohlc_rows"), F.count_if(~F.col("_whole")).alias("unreadable_rows"),
        F.count_if("_jump").alias("extreme_return_rows"), F.array_contains(F.first("_columns"), "adjusted_close").alias("has_adjusted_close"),
    ).withColumn("asset_class", F.when(crypto, "crypto").otherwise("equity"))
    fails = {"repeated keys": F.col("duplicate_keys") > 0, "bars that contradict themselves": F.col("invalid_ohlc_rows") > 0, "rows that can't be read": F.col("unreadable_rows") > 0}
    warns = {"extreme returns": F.col("extreme_return_rows") > 0, "no adjusted close": (F.col("asset_class") == "equity") & ~F.col("has_adjusted_close")}
    found = F.array_compact(F.array(*(F.when(rule, F.lit(text)) for text, rule in (fails | warns).items())))
    status = F.when(F.greatest(*fails.values()), "FAIL").when(F.greatest(*warns.values()), "PASS_WITH_WARNINGS").otherwise("PASS")
    return out.withColumns({"warnings": found, "status": status})


def validate_ohlcv(bars: DataFrame) -> None:
    row = audit_bars(bars).first()
    if row["invalid_ohlc_rows"]:
        raise ValueError(f"{row['invalid_ohlc_rows']} bars contradict themselves")


def catalog(bars: DataFrame, file_column: str = "file") -> DataFrame:
    return bars.groupBy(file_column).agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set("symbol")), ";").alias("symbols"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))


def universe_statistics(bars: DataFrame, lookback: int = 90) -> DataFrame:
    """Per symbol: rows, span, last close, medians and mean of the last ``lookback`` rows (exact)."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("timestamp")))
    tail = bars.withColumn("_place", place).withColumn("dollars", F.abs(F.col("close")) * F.abs(F.col("volume")))
    recent = lambda c: F.when(F.col("_place") <= lookback, F.col(c))
    return tail.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.max_by("close", "timestamp").alias("last_close"),
        F.median(recent("close")).alias("median_close_lookback"), F.median(recent("dollars")).alias("median_dollar_volume_lookback"), F.avg(recent("dollars")).alias("avg_dollar_volume_lookback"),
    )


def classify_profile(symbol: Column, profile: str = "broad") -> Column:
    """Why a universe profile leaves a symbol out; NULL where it doesn't."""
    if profile not in UNIVERSE_PROFILES:
        raise ValueError(f"unknown universe profile {profile!r}")
    leveraged, shapes = UNIVERSE_PROFILES[profile]
    root, reason = ticker_root(symbol), F.lit(None).cast("string")
    if shapes:
        reason = F.when(F.rlike(root, F.lit(shapes)), "profile_excluded_non_common_pattern")
    if leveraged:
        reason = F.when(root.isin(*LEVERAGED_INVERSE), "profile_excluded_leveraged_inverse").otherwise(reason)
    return reason


def screen_universe(stats: DataFrame, min_rows: int = 750, min_price: float = 5.0, min_dollars: float = 20e6, most: int = 500, denied: tuple[str, ...] = (), profile: str = "broad") -> DataFrame:
    """The first reason that excludes a symbol (the profile's last), and the ``most`` most liquid of the others.

    The cap is the operator's own limit.
    """
    reason = (
        F.when(F.col("rows") < min_rows, "insufficient_history")
        .when((F.col("last_close") < min_price) | (F.col("median_close_lookback") < min_price), "low_price")
        .when(F.col("median_dollar_volume_lookback") < min_dollars, "low_liquidity")
        .when(non_common(F.col("symbol")), "obvious_non_common_symbol_pattern")
    )
    if denied:
        reason = reason.when(ticker_root(F.col("symbol")).isin(*denied), "profile_excluded_leveraged_inverse")
    reason = F.coalesce(reason, classify_profile(F.col("symbol"), profile))
    out = stats.withColumn("exclusion_reason", reason).withColumn("eligible", F.col("exclusion_reason").isNull())
    best = out.filter("eligible").orderBy(F.desc("median_dollar_volume_lookback"), F.desc("rows"), "symbol").limit(most).select("symbol", F.lit(True).alias("_in"))
    return out.join(best, "symbol", "left").withColumn("selected", F.coalesce("_in", F.lit(False))).drop("_in")


def panel_master(mapping: DataFrame, symbols: DataFrame, allowed_without_cik: tuple[str, ...] = ()) -> DataFrame:
    """``symbol, cik`` for a panel's symbols.

    Every symbol needs a unique mapping with a cik, but for those allowed without one,
    which are added with a null cik.  Raises ValueError naming what is missing.
    """
    wanted = symbols.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    mapped = mapping.withColumn("symbol", F.upper(F.trim("symbol"))).join(wanted, "symbol", "left_semi")
    good = latest_per(mapped.filter((F.col("mapping_status") == "unique") & F.col("cik").isNotNull()), ["symbol"], [F.col("cik")]).select("symbol", "cik")
    rest = wanted.join(good, "symbol", "left_anti")
    allowed = rest.filter(F.col("symbol").isin(*allowed_without_cik)) if allowed_without_cik else rest.limit(0)
    missing = [r[0] for r in rest.join(allowed, "symbol", "left_anti").orderBy("symbol").limit(20).collect()]  # for the message
    if missing:
        raise ValueError(f"no unique mapping for {missing}")
    return good.unionByName(allowed.withColumn("cik", F.lit(None).cast(good.schema["cik"].dataType)))


def universes(spark, names: tuple[str, ...] = tuple(UNIVERSES)) -> DataFrame:
    """The default universes as a small table ``universe, asset_class, symbol``."""
    rows = [(n, UNIVERSES[n][0], s) for n in names for s in UNIVERSES[n][1]]
    return spark.createDataFrame(rows, "universe string, asset_class string, symbol string")
