"""Row-level expressions: scores, sizing, period classes, sessions, ticker rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import days_between, finite

# Metrics measured at an instant.
INSTANT_METRICS = (
    "assets", "liabilities", "equity", "equity_including_nci", "cash", "debt_current", "debt_noncurrent", "debt_total",
)
# Day ranges (inclusive) of the reporting periods.
DURATIONS = (("quarter", 70, 120), ("half_year", 150, 210), ("nine_month", 240, 300), ("annual", 320, 390))
# Fixed value: ticker shapes of warrants, units, rights and preferred shares.
NON_COMMON = r"(?i)-WS|-WT|-WW|-WSA|-WTA|-UN|-U$|-R$|-P$|_"
EXCHANGE_ZONE = "America/New_York"


def ticker_root(symbol: Column) -> Column:
    return F.split_part(F.upper(F.trim(symbol)), F.lit("."), F.lit(1))


def non_common(symbol: Column) -> Column:
    return F.rlike(symbol, F.lit(NON_COMMON))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def percentile_score(value: Column, low: Column, high: Column) -> Column:
    """Place of a value between two bounds on 0..100; 50 where it can't be told."""
    share = F.try_divide(finite(value) - low, high - low) * 100
    return F.when((high > low) & finite(value).isNotNull(), clip(share, 0, 100)).otherwise(F.lit(50.0))


def directional_score(expected: Column, volatility: Column) -> Column:
    e, v = finite(expected), finite(volatility)
    scaled = F.when(v > 0, 50 + 50 * F.tanh(F.try_divide(e, v))).otherwise(clip(50 + 1000 * e, 0, 100))
    return F.when(e.isNull(), F.lit(50.0)).otherwise(scaled)


def mean_of_known(first: Column, *others: Column) -> Column:
    """Mean of the first score and those others that are known."""
    total, known = first, F.lit(1)
    for other in map(finite, others):
        total = total + F.coalesce(other, F.lit(0.0))
        known = known + F.when(other.isNotNull(), 1).otherwise(0)
    return total / known


#: Fixed values.  Feature, what it must exceed, and the text for and against (None: no text).
EXPLANATION_RULES = (
    ("momentum_20", 0.02, "positive 20-bar momentum", "weak/negative 20-bar momentum"),
    ("momentum_5", 0.01, "positive short-term momentum", "weak/negative short-term momentum"),
    ("relative_volume_20", 1.5, "abnormal volume", None),
    ("trend_strength", 0.0, "positive trend regime", "negative trend regime"),
    ("sentiment_shock", 0.2, "positive sentiment shock", "negative sentiment shock"),
    ("event_surprise", 0.2, "positive event surprise", "negative event surprise"),
)


def explain_opportunity(columns: list[str]) -> tuple[Column, Column]:
    """Arrays of the texts for and against, over the rules whose feature is present; unknown values say nothing."""
    have = [r for r in EXPLANATION_RULES if r[0] in columns]
    plus = [F.when(F.col(name) > limit, F.lit(text)) for name, limit, text, _ in have]
    minus = [F.when(F.col(name) <= limit, F.lit(text)) for name, limit, _, text in have if text]
    some = lambda items: F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")
    return some(plus), some(minus)


def position_size(entry: Column, stop: Column, target: Column, equity: Column, risk_percent: float = 1.0, cap_percent: float | None = None, increment: float | None = None, minimum: float | None = None, multiplier: Column | None = None) -> dict[str, Column]:
    """Quantity by risk per unit, capped by value and floored to the increment, with what follows from it and warnings."""
    if not 0 < risk_percent < 100:
        raise ValueError("risk_percent must lie between 0 and 100")
    if cap_percent is not None and not 0 < cap_percent <= 100:
        raise ValueError("cap_percent must be above 0 and 100 at most")
    if increment is not None and not increment > 0:
        raise ValueError("increment must be positive")
    multiplier = F.lit(1.0) if multiplier is None else multiplier
    unit_risk = F.abs(entry - stop) * multiplier
    quantity = F.try_divide(equity * risk_percent / 100, unit_risk)
    capped = F.lit(False)
    if cap_percent is not None:
        most = F.try_divide(equity * cap_percent / 100, entry * multiplier)
        capped, quantity = most < quantity, F.least(quantity, most)
    if increment is not None:
        quantity = F.floor(quantity / increment) * F.lit(float(increment))
    warnings = [F.when(capped, F.lit("capped by position value")), F.when(quantity <= 0, F.lit("no feasible quantity"))]
    if minimum is not None:
        warnings.insert(1, F.when(quantity < minimum, F.lit("below minimum quantity")))
    reward = F.abs(target - entry) * multiplier
    return {
        "quantity": quantity,
        "capital_required": quantity * entry * multiplier,
        "risk_amount": quantity * unit_risk,
        "risk_percent": F.try_divide(quantity * unit_risk, equity) * 100,
        "reward_amount": quantity * reward,
        "reward_to_risk": F.try_divide(reward, unit_risk),
        "warnings": F.array_compact(F.array(*warnings)),
    }


def period_type(start: Column, end: Column) -> Column:
    """instant, annual (300..380 whole days) or duration."""
    days = F.floor(days_between(end, start))
    return F.when(start.isNull() | (days == 0), "instant").when(days.between(300, 380), "annual").otherwise("duration")


def duration_kind(days: Column) -> Column:
    kind = F.lit("other_duration")
    for name, low, high in reversed(DURATIONS):
        kind = F.when(days.between(low, high), name).otherwise(kind)
    return kind


def session_times(timestamp: Column) -> tuple[Column, Column]:
    """Close (16:00) and open (09:30) in New York of a bar's UTC date, as UTC wall-clock times."""
    day = timestamp.cast("date").cast("timestamp_ntz")

    def at(offset: str) -> Column:
        return F.convert_timezone(F.lit(EXCHANGE_ZONE), F.lit("UTC"), day + F.expr(f"INTERVAL '{offset}' HOUR TO MINUTE"))

    return at("16:00"), at("09:30")


def multiple_testing_warning(tests: Column, alpha: float = 0.05) -> Column:
    return F.when(tests >= 10, F.concat(F.lit("multiple testing: expect "), F.round(tests * alpha, 2).cast("string"), F.lit(" false positives")))


def logistic_confidence(value: Column, scale: Column) -> Column:
    """Logistic of value over scale (at least 1e-6), the exponent kept within 30."""
    return 1 / (1 + F.exp(-clip(value / F.greatest(scale, F.lit(1e-6)), -30, 30)))


@dataclass(frozen=True)
class PortfolioContext:
    """What sizing knows about an account."""

    equity: float
    risk_percent: float = 1.0
    cap_percent: float | None = None

    def validate(self) -> PortfolioContext:
        if not self.equity > 0:
            raise ValueError("equity must be positive")
        return self

    def size(self, entry: Column, stop: Column, target: Column, **limits) -> dict[str, Column]:
        self.validate()
        return position_size(entry, stop, target, F.lit(float(self.equity)), self.risk_percent, self.cap_percent, **limits)
