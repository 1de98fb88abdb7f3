"""Logical tables, plan-time column checks and the null policy.

Missing values are NULL everywhere.  NaN and infinities are turned into NULL on
the way in, because a comparison with NaN is true in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_BAR = "timestamp timestamp, open double, high double, low double, close double, volume double, symbol string"
NEWS_EVENT = "timestamp timestamp, asset string, sentiment double, sentiment_change double, surprise double, novelty double, relevance double, credibility double, event_type string"
COMPANY_FACT = (
    "cik bigint, entity_name string, taxonomy string, tag string, label string, description string, unit string, "
    "start string, end string, filed string, form string, frame string, fy int, fp string, accn string, val double"
)
SUBMISSION = "cik bigint, accessionNumber string, acceptanceDateTime string, filingDate string, form string"
VINTAGE = "series_id string, date timestamp, value double, realtime_start timestamp, realtime_end timestamp"
COMPANY_FACT_FIELDS = tuple(part.split()[0] for part in COMPANY_FACT.split(", "))


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> None:
    """Raise ValueError with the sorted missing columns; looks at the plan only."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def finite(column: Column | str) -> Column:
    """The number as double, NULL where it is NaN or infinite."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_number(column: str) -> Column:
    return finite(F.expr(f"try_cast(`{column}` AS DOUBLE)"))


def to_time(column: str, fmt: str | None = None) -> Column:
    """Timestamp in the session's zone (UTC); NULL for what does not parse."""
    return F.try_to_timestamp(F.col(column).cast("string"), F.lit(fmt)) if fmt else F.expr(f"try_cast(`{column}` AS TIMESTAMP)")


def or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    """An optional column, NULL where the table has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """An action: raise when two rows share a key."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what}: duplicate {keys}")
