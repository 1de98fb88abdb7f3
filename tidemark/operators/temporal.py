"""As-of joins, latest-per-group picks and leakage guards.

All as-of joins are one union and one window over the key: both sides are tagged
and sorted together, and the last payload seen is carried along.  That is a single
shuffle on the key for each side, without a join and without a fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import BROADCAST_ROWS, HOT_ROWS, hot_keys
from tidemark.schema import require_columns
from tidemark.session import written

MOST_SPANS = 2000  # of one hot key
MOST_REVISIONS = 64  # of a period whose revisions are looked at by every decision


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, payload: list[str], ties: list[str] | None = None, prefix: str = "pit_", forward: bool = False,
    bucket_days: int | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """LEFT as-of join: to each left row the last right row at or before it (``forward``: first at or after).

    ``ties`` order right rows of one time; the last (forward: first) of them is
    taken, nulls counting as last.  Null keys match null keys.  Payload columns come back with ``prefix``;
    ``<prefix>time`` is the right row's time.

    A key is one task's work, unless both sides have more than ``hot_rows`` rows of it: it is then dealt over spans
    of time with about equal numbers of rows, and each span's last right row is carried to the spans after it, which are
    one row a span.  With ``bucket_days`` all keys are dealt over spans of that many days.
    """
    require_columns(left, [*by, left_time], "left side")
    require_columns(right, [*by, right_time, *payload], "right side")
    packed = F.struct(F.col(right_time).alias("time"), *(F.col(c) for c in payload))
    sides_left = left.select(F.struct(*left.columns).alias("row"), *(F.col(c).alias(f"k_{c}") for c in by), F.col(left_time).alias("t"), F.lit(0 if forward else 1).alias("side"), F.lit(None).alias("payload"), F.lit(None).alias("ties"))
    order = F.struct(*(F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")) for c in (ties or [right_time])))
    sides_right = right.filter(F.col(right_time).isNotNull()).select(F.lit(None).alias("row"), *(F.col(c).alias(f"k_{c}") for c in by), F.col(right_time).alias("t"), F.lit(1 if forward else 0).alias("side"), packed.alias("payload"), order.alias("ties"))
    both = sides_left.unionByName(sides_right)
    keys = [f"k_{c}" for c in by]
    micros = F.unix_micros(F.col("t").cast("timestamp"))
    dealt = True
    if bucket_days:
        both = both.withColumn("bucket", F.floor(micros / F.lit(bucket_days * 86_400_000_000)))
    else:
        hot = hot_keys(both, keys, hot_rows)
        dealt = hot is not None
        if dealt:
            both = _in_spans(both, keys, hot, micros, hot_rows)
    span = Window.partitionBy(*keys, *(["bucket"] if dealt else [])).orderBy(F.col("t").asc_nulls_first(), "side", F.col("ties").asc_nulls_first())
    if forward:
        pick = F.first("payload", ignorenulls=True).over(span.rowsBetween(0, Window.unboundedFollowing))
    else:
        pick = F.last("payload", ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, 0))
    matched = both.withColumn("hit", F.when(F.col("t").isNotNull(), pick)).filter(F.col("row").isNotNull())
    if dealt:
        carried = _carried(both, keys, forward)
        if not bucket_days:
            carried = written(carried, "carried")
            carried = F.broadcast(carried) if carried.count() <= BROADCAST_ROWS else carried
        same = [F.col(f"m.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        condition = F.col("m.bucket") == F.col("c.bucket")
        for one in same:
            condition &= one
        matched = matched.alias("m").join(carried.alias("c"), condition, "left").select("m.row", F.coalesce("m.hit", F.when(F.col("m.t").isNotNull(), F.col("c.carry"))).alias("hit"))
    return matched.select("row.*", F.col("hit.time").alias(f"{prefix}time"), *(F.col(f"hit.{c}").alias(f"{prefix}{c}") for c in payload))


def _in_spans(both: DataFrame, keys: list[str], hot: DataFrame, micros: Column, hot_rows: int) -> DataFrame:
    """``both`` with ``bucket``: the span of a hot key's row, null for all other keys."""
    most = hot.agg(F.max("n")).first()[0]
    count = min(MOST_SPANS, -(-most // hot_rows))
    mark = F.broadcast(hot.select(*(F.col(k).alias(f"_{k}") for k in keys)))  # at most as many as hot_rows goes into the rows
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    shares = F.array(*(F.lit(k / count) for k in range(1, count)))
    hot_rows_only = both.select(*keys, micros.alias("us")).join(mark, same, "left_semi")
    cuts = written(hot_rows_only.groupBy(*keys).agg(F.percentile_approx("us", shares, 10_000).alias("cuts")), "span-cuts")
    marked = both.join(F.broadcast(cuts.select("cuts", *(F.col(k).alias(f"_{k}") for k in keys))), same, "left")
    place = F.when(micros.isNull(), F.lit(-1)).otherwise(F.size(F.filter("cuts", lambda c: c < micros)))
    bucket = F.when(F.col("cuts").isNotNull(), place).cast("long")
    return marked.select(*both.columns, bucket.alias("bucket"))


def _carried(both: DataFrame, keys: list[str], forward: bool) -> DataFrame:
    """Per key and bucket the right row that comes from the buckets before it (``forward``: after it)."""
    ordered = F.when(F.col("payload").isNotNull(), F.struct("t", "ties"))
    edge = F.min_by("payload", ordered) if forward else F.max_by("payload", ordered)
    edges = both.filter("bucket IS NOT NULL").groupBy(*keys, "bucket").agg(edge.alias("edge"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    if forward:
        carry = F.first("edge", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    else:
        carry = F.last("edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return edges.select(*keys, "bucket", carry.alias("carry"))


def match_report(aligned: DataFrame, time_column: str = "pit_time") -> DataFrame:
    return aligned.agg(F.count(F.lit(1)).alias("rows"), F.count(time_column).alias("matched"), F.count_if(F.col(time_column).isNull()).alias("unmatched"))


def latest_per(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``; null keys group together."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= keep).drop("_place")


def known_by(df: DataFrame, time: str, moment: Column) -> DataFrame:
    """Causal filter; it has to come before any latest-per-group pick."""
    return df.filter(F.col(time) <= moment)


def asof_by_period(
    decisions: DataFrame, observations: DataFrame, entity: str = "cik", identity: tuple[str, ...] = ("metric", "unit", "period_type", "start", "end"), payload: tuple[str, ...] = ("val_num",), ties: tuple[str, ...] = ("val_num",), most_revisions: int = MOST_REVISIONS,
) -> DataFrame:
    """One row per decision and period known for its entity, with the value known then (or null).

    A null ``start`` is a period like another.  Decisions of entities without any
    observation drop out.

    A revision holds until the next one, so decisions meet the spans of their entity's revisions: the two inputs
    are shuffled, never the rows of decisions and periods.  Of a period with more than ``most_revisions`` revisions
    that would look at too many pairs, so it is matched by ``asof_join``.
    """
    keys = [entity, *identity]
    spans = written(_spans(observations, keys, payload, ties), "revisions")
    at, since, until = F.col("decision_time"), F.col("_since"), F.col("_until")
    holds = (since.isNull() & at.isNull()) | ((since.isNull() | (since <= at)) & (until.isNull() | (at < until)))
    known = [since.alias("pit_time"), *(F.col(f"_{c}").alias(f"pit_{c}") for c in payload)]
    aligned = decisions.join(spans.filter(F.col("_revisions") <= most_revisions), entity).filter(holds).select(*decisions.columns, *identity, *known)
    many = spans.filter(F.col("_revisions") > most_revisions)
    if not many.isEmpty():
        revised = many.filter(since.isNotNull()).select(*keys, since.alias("information_time"), *(F.col(f"_{c}").alias(c) for c in payload))
        grid = decisions.join(many.filter(since.isNull()).select(*keys), entity)
        aligned = aligned.unionByName(asof_join(grid.select(*decisions.columns, *identity), revised, keys, "decision_time", "information_time", list(payload)))
    return aligned.withColumn("available", F.col("pit_time").isNotNull())


def _spans(observations: DataFrame, keys: list[str], payload: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """``keys, _since, _until, _revisions`` and payload of each revision of a period, and one span without them before the first."""
    period = Window.partitionBy(*keys)
    order = [F.col("information_time").asc_nulls_first(), *(F.col(c).asc_nulls_last() for c in ties)]
    timed = observations.select(
        *keys, F.col("information_time").alias("_since"), F.lead("information_time").over(period.orderBy(*order)).alias("_until"), F.row_number().over(period.orderBy(*order)).alias("_place"),
        F.count("information_time").over(period).alias("_revisions"), F.min("information_time").over(period).alias("_first"), *(F.col(c).alias(f"_{c}") for c in payload),
    )
    own = F.struct("_since", "_until", *(f"_{c}" for c in payload))
    kinds = dict(timed.dtypes)
    before = F.struct(F.lit(None).cast(kinds["_since"]).alias("_since"), F.col("_first").alias("_until"), *(F.lit(None).cast(kinds[f"_{c}"]).alias(f"_{c}") for c in payload))
    # of revisions of one time the last one holds
    kept = F.when(F.col("_since").isNotNull() & ~F.col("_since").eqNullSafe(F.col("_until")), own)
    both = F.array_compact(F.array(F.when(F.col("_place") == 1, before), kept))
    return timed.select(*keys, "_revisions", F.explode(both).alias("_span")).select(*keys, "_revisions", "_span.*")


def align_periods(decisions: DataFrame, observations: DataFrame, entity: str = "cik", identity: tuple[str, ...] = ("metric", "unit", "period_type", "start", "end"), payload: tuple[str, ...] = ("val_num",)) -> DataFrame:
    """``asof_by_period``, but where no decision's entity has an observation all decisions come back with nulls (an action finds out)."""
    known = decisions.filter(F.col(entity).isNotNull() & F.col("decision_time").isNotNull())
    if not known.join(observations.select(entity), entity, "left_semi").isEmpty():
        return asof_by_period(known, observations, entity, identity, payload)
    kinds = {f.name: f.dataType for f in observations.schema.fields}
    nothing = {**{c: c for c in identity}, "pit_time": "information_time", **{f"pit_{c}": c for c in payload}}
    return known.select("*", *(F.lit(None).cast(kinds[c]).alias(name) for name, c in nothing.items()), F.lit(False).alias("available"))


def leaks(aligned: DataFrame, information: str = "pit_time", decision: str = "decision_time") -> DataFrame:
    """Rows that saw information after their decision; empty for a sound panel."""
    return aligned.filter(F.col(information) > F.col(decision))


def assert_no_future_information(aligned: DataFrame, information: str = "pit_time", decision: str = "decision_time") -> None:
    if not leaks(aligned, information, decision).isEmpty():
        raise ValueError("a row uses information from after its decision")


def number_decisions(decisions: DataFrame, order: list[str]) -> DataFrame:
    """``_decision_id`` 0..n-1 in a stable order.

    Rows are dealt by range and written once with their part and place; ids come from the
    parts' sizes, not from one global window.  A range exchange samples its bounds
    anew each time it runs, so parts are only comparable within what was written.
    """
    require_columns(decisions, order, "decisions")
    ascending = [F.col(c).asc_nulls_last() for c in order]
    ranged = decisions.repartitionByRange(*ascending).sortWithinPartitions(*ascending)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tagged = written(ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return tagged.join(F.broadcast(offsets), "_part").withColumn("_decision_id", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
