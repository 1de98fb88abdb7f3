"""Windows over keys that may hold very many rows: running values as scans, rolling features over slices.

A window function puts a key into one task.  Here hot keys are found first (a count of rows a key, which is only
taken where the input is large enough to have one) and dealt over tasks; all other keys keep their plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.session import written

HOT_ROWS = 2_000_000  # rows of a key beyond which it is dealt over tasks
SMALL_BYTES = 256 << 20  # estimated input below which no key can be that large
BROADCAST_ROWS = 100_000  # of carried values that go to all tasks; beyond it they are shuffled

#: How the running values of a column combine.
UNDONE = {np.add: np.subtract, np.bitwise_xor: np.bitwise_xor}
OPS = {"sum": np.add, "xor": np.bitwise_xor, "product": np.multiply, "max": np.maximum}


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of all that a plan reads, by the optimizer's estimates of its sources; no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``keys, n`` of the keys with more than ``hot_rows`` rows, written; None where there is none.

    There are at most as many as ``hot_rows`` goes into the rows.
    """
    if hot_rows >= HOT_ROWS and estimated_bytes(df) < SMALL_BYTES:
        return None
    found = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows), "hot-keys")
    return None if found.isEmpty() else found


def parted(df: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of other keys, and those of hot keys; nulls are equal."""
    mark = F.broadcast(hot.select(*(F.col(k).alias(f"_hot_{k}") for k in keys)))  # few by their definition
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return df.join(mark, same, "left_anti"), df.join(mark, same, "left_semi")


def _accumulated(ufunc: np.ufunc, values: np.ndarray, starts: np.ndarray, carry) -> np.ndarray:
    if values.dtype == np.int64 and ufunc in UNDONE:  # one pass over all keys, less what stood before each
        out = ufunc.accumulate(values)
        before = UNDONE[ufunc](out, values)[starts]
        out = UNDONE[ufunc](out, np.repeat(before, np.diff(np.append(starts, len(values)))))
    else:
        out = values.copy()
        _each(ufunc, values, starts, out)
    if carry is not None:
        first = slice(0, starts[1] if len(starts) > 1 else len(values))
        out[first] = ufunc(carry, out[first])
    return out


def _each(ufunc: np.ufunc, values: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
        ufunc.accumulate(values[a:b], out=out[a:b])


def _within_parts(names: list[str], key: str, ops: dict[str, str], kinds: dict[str, type]):
    """Over rows sorted by ``key``: the running values of every row inside its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carry = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(key)).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            if last is None or keys[0] != last[0]:
                carry = {}
            out = {"place": _accumulated(np.add, np.ones(len(keys), np.int64), starts, carry.get("place"))}
            for name, op in ops.items():
                values = batch.column(names.index(name)).to_numpy(zero_copy_only=False).astype(kinds[name])
                out[name] = _accumulated(OPS[op], values, starts, carry.get(name))
            last, carry = (keys[-1],), {name: values[-1] for name, values in out.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out.values()), pa.array(np.full(len(keys), part, np.int64))], [*names, *(f"run_{name}" for name in out), "part"])

    return run


def running(df: DataFrame, key: str, order: list[Column], label: str, ops: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``run_place`` (1 for a key's first row) and, for each column in ``ops``, its running sum, XOR, product or maximum as ``run_<name>``.

    All are up to and including the row, in ``order`` within the ``key`` (without nulls, as the columns of ``ops``); rows that tie come in any order.
    Columns of whole numbers are taken as longs, others as doubles.
    Rows are dealt by ranges of key, order and row, so a key with very many rows is many
    tasks; each works on its range, and what keys bring along from earlier ranges, one row a range, is added after.
    The result is written.
    """
    ops = ops or {}
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("_tie")]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    whole = {name: df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long") for name in ops}
    kinds = {name: np.int64 if whole[name] else np.float64 for name in ops}
    own = [StructField("run_place", LongType()), *(StructField(f"run_{name}", LongType() if whole[name] else DoubleType()) for name in ops), StructField("part", LongType())]
    tagged = written(dealt.mapInArrow(_within_parts(df.columns, key, ops, kinds), StructType([*df.schema.fields, *own])), f"{label}-parts")
    ends = tagged.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b"))  # a row a part
    spanning = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    spanning = written(spanning, f"{label}-spanning")
    if spanning.isEmpty():
        return tagged.drop("part")
    every = {"place": "sum"} | ops
    totals = tagged.join(_sent(spanning), key, "left_semi").groupBy(key, "part").agg(*(F.max_by(f"run_{name}", "run_place").alias(name) for name in every))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "xor": F.bit_xor, "product": F.product, "max": F.max}
    carries = written(totals.select(key, "part", *(over[op](name).over(before).alias(f"from_{name}") for name, op in every.items())), f"{label}-carries")
    joined = tagged.join(_sent(carries), [key, "part"], "left")

    def combined(name: str, op: str) -> Column:
        run, carried = F.col(f"run_{name}"), F.col(f"from_{name}")
        both = {"sum": run + carried, "xor": run.bitwiseXOR(carried), "product": run * carried, "max": F.greatest(run, carried)}[op]
        return F.when(carried.isNull(), run).otherwise(both)

    fixed = {f"run_{name}": combined(name, op) for name, op in every.items()}
    return written(joined.withColumns(fixed).select(*df.columns, *fixed), label)


def _sent(rows: DataFrame) -> DataFrame:
    """Written rows of keys that span tasks (about one a task) with a broadcast hint, if their count allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def sliced(df: DataFrame, features: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, key: str = "symbol", time: str = "timestamp", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``features(df)``, whose windows go by ``key`` in order of ``time`` and look ``back`` and ``ahead`` rows at most.

    A hot key is cut into slices of ``hot_rows`` rows; each is computed with a halo of the rows before and after it,
    so no window needs the whole key in one task.  Slices may be shorter than the windows.
    """
    hot = hot_keys(df, [key], hot_rows)
    if hot is None:
        return features(df)
    cold_rows, rows = parted(df, hot, [key])
    cold = features(cold_rows)
    keyed = rows.filter(F.col(key).isNotNull())  # rows without a key are left to the plain way
    placed = running(keyed, key, [F.col(time)], "slices")
    place = F.col("run_place") - 1
    own = F.floor(place / hot_rows)
    low, high = F.greatest(F.floor((place - ahead) / hot_rows), F.lit(0)), F.floor((place + back) / hot_rows)
    copies = placed.withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(low, high)))
    kind = df.schema[key].dataType
    named = copies.withColumn("_key", F.col(key)).withColumn(key, F.concat(F.col(key).cast("string"), F.lit("\x00"), F.col("_slice").cast("string")))
    done = features(named.drop("run_place")).filter(F.col("_own") == F.col("_slice")).withColumn(key, F.col("_key").cast(kind))
    out = cold.unionByName(done.select(*cold.columns))
    without = rows.filter(F.col(key).isNull())
    return out if without.isEmpty() else out.unionByName(features(without))


# exact percentiles ---------------------------------------------------------------

COLLECTED = 100_000  # values that are sorted on the driver at last
NEARNESS = 2e-4  # of a rank to the bracket's ends, as a share; twice what the estimate allows


def large(df: DataFrame, hot_rows: int = HOT_ROWS) -> bool:
    """Whether a frame may have too many rows for one buffer."""
    return hot_rows < HOT_ROWS or estimated_bytes(df) >= SMALL_BYTES


def percentiles(df: DataFrame, column: Column, shares: list[float], collected: int = COLLECTED) -> list[float | None]:
    """The exact percentiles of a column's known values, interpolated between neighbours, without a buffer of all values.

    A rank is bracketed by estimated quantiles, which count what lies below, and sought again between them;
    each round leaves about ``2 * NEARNESS`` of the values.
    """
    values = df.select(column.cast("double").alias("x")).filter("x IS NOT NULL")
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    found = _ranked(values, n, sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))}), collected)
    return [found[int(p)] + (p - int(p)) * (found[min(int(p) + 1, n - 1)] - found[int(p)]) for p in places]


def _ranked(values: DataFrame, n: int, ranks: list[int], collected: int) -> dict[int, float]:
    """The values at ``ranks`` (from 0, ascending) of ``n`` values."""
    if n <= collected:
        ordered = sorted(r["x"] for r in values.collect())
        return {r: ordered[r] for r in ranks}
    near = max(NEARNESS, 2 / n)
    ends = [s for r in ranks for s in (max(r / n - near, 0.0), min((r + 1) / n + near, 1.0))]
    estimated = values.agg(F.percentile_approx("x", F.array(*map(F.lit, ends)), 10_000).alias("e")).first()["e"]
    lows, highs = estimated[::2], estimated[1::2]
    x = F.col("x")
    counts = values.agg(*(F.count_if(x < lo).alias(f"b{k}") for k, lo in enumerate(lows)), *(F.count_if(x.between(lo, hi)).alias(f"i{k}") for k, (lo, hi) in enumerate(zip(lows, highs, strict=True)))).first()
    out = {}
    for k, (rank, lo, hi) in enumerate(zip(ranks, lows, highs, strict=True)):
        below, inside = counts[f"b{k}"], counts[f"i{k}"]
        if not below <= rank < below + inside or inside == n:  # an estimate that was off, or no way between equal values
            lo, hi = _halved(values, rank)
            below, inside = values.filter(x < lo).count(), values.filter(x.between(lo, hi)).count()
        out[rank] = lo if lo == hi else _ranked(values.filter(x.between(lo, hi)), inside, [rank - below], collected)[rank - below]
    return out


def _halved(values: DataFrame, rank: int) -> tuple[float, float]:
    """A value, or one side of it, that has the rank: the middle of the span, or a value that very many rows share."""
    x = F.col("x")
    row = values.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    while lo < hi:
        middle = lo / 2 + hi / 2
        if middle in (lo, hi):
            return (lo, lo) if rank < values.filter(x <= lo).count() else (hi, hi)
        sides = values.agg(F.count_if(x < middle).alias("b"), F.count_if(x == middle).alias("e")).first()
        if rank < sides["b"]:
            hi = values.filter(x < middle).agg(F.max(x)).first()[0]
            return lo, hi
        if rank < sides["b"] + sides["e"]:
            return middle, middle
        return values.filter(x > middle).agg(F.min(x)).first()[0], hi
    return lo, hi
