"""Shared pieces of the training-data operators: scratch tables and Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import drop_path, scratch_path

#: The characters that separate words everywhere in this subpackage (0x20, 0x09-0x0D).
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The same as a Java / RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


#: Paths of the tables that ``staged`` has written in this application, in order.
_STAGED: list[str] = []


def staged(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here, and values such as generated row ids can't change any more."""
    path = scratch_path(df.sparkSession, label)
    _STAGED.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> list[str]:
    return list(_STAGED)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        if path in _STAGED:
            drop_path(spark, path)
            _STAGED.remove(path)


def arrow_map(
    df: DataFrame,
    columns: list[str],
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` over only the named columns, in batches of bounded bytes.

    Batches are limited by bytes (4 MB, or one row), as texts are short or long;
    settings that the session has changed are left alone.
    """
    conf = df.sparkSession.conf
    for key, default, ours in (("maxRecordsPerBatch", "10000", "50000"), ("maxBytesPerBatch", "67108864b", "4194304b")):
        if conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            conf.set(f"spark.sql.execution.arrow.{key}", ours)
    return df.select(*columns).mapInArrow(_tidy(fn), schema)


def _tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn``, after which the worker gives memory that is free back to the system, as it lives on from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            trim()

    return run


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)


#: What this Python worker keeps between tasks: one encoder with its caches at most.
_HELD: dict = {}


def hold(name, make: Callable):
    """The worker's encoder ``name``; another one that it held is let go first."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
        trim()
    return _HELD[name]


def release() -> None:
    """Let go of encoders: called by tasks that use none, as workers live on from stage to stage."""
    if _HELD:
        _HELD.clear()
        trim()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Bytes of rows up to which a side is broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def sized_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (written rows) with a broadcast hint if its measured bytes allow it: 8 a column and row, and those of texts."""
    long = [F.octet_length(name) for name, kind in df.dtypes if kind in ("string", "binary")]
    row = sum((F.coalesce(x, F.lit(0)) for x in long), F.lit(16 + 8 * len(df.columns)).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


def null_safe(pairs: list[tuple[str, str]]):
    """A join condition in which nulls are equal."""
    condition = F.lit(True)
    for k, (left, right) in enumerate(pairs):
        equal = F.col(left).eqNullSafe(F.col(right))
        condition = equal if not k else condition & equal
    return condition


def prefix_beside(docs: DataFrame, word: str) -> str:
    """``word``, with underscores until no column of ``docs`` begins with it."""
    taken = [c.lower() for c in docs.columns]
    while any(c.startswith(word) for c in taken):
        word += "_"
    return word


def without(docs: DataFrame, dropped: DataFrame, keys: dict) -> DataFrame:
    """``docs`` less the rows whose keys are in ``dropped``.

    ``keys`` maps a column of ``dropped`` to the expression on ``docs`` that it equals.
    """
    own, other = prefix_beside(docs, "own"), prefix_beside(docs, "gone")
    gone = dropped.select(*(F.col(name).alias(f"{other}{name}") for name in keys))
    tagged = docs.withColumns({f"{own}{name}": value for name, value in keys.items()})
    kept = tagged.join(sized_broadcast(gone), null_safe([(f"{own}{n}", f"{other}{n}") for n in keys]), "left_anti")
    return kept.select(*docs.columns)


def first_of_repeats(docs: DataFrame, keys: dict, repeated: DataFrame) -> DataFrame:
    """One row of each set of rows that agree in ``keys``, where ``repeated`` lists the keys of several rows.

    ``repeated`` is empty as a rule; only rows in it are numbered.
    """
    if repeated.isEmpty():
        return docs
    names, own, other = list(keys), prefix_beside(docs, "own"), prefix_beside(docs, "rep")
    tagged = docs.withColumns({f"{own}{name}": value for name, value in keys.items()})
    some = repeated.select(*(F.col(n).alias(f"{other}{n}") for n in names)).distinct()
    match = null_safe([(f"{own}{n}", f"{other}{n}") for n in names])
    order = Window.partitionBy(*(f"{own}{n}" for n in names)).orderBy(F.xxhash64(*docs.columns))
    ours = tagged.join(some, match, "left_semi").withColumn(f"{own}place", F.row_number().over(order)).filter(F.col(f"{own}place") == 1)
    return tagged.join(some, match, "left_anti").select(*docs.columns).unionByName(ours.select(*docs.columns))
