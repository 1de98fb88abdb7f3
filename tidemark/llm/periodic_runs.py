"""Periodic runs of words in every text: passages that repeat themselves with a short period.

A run is a stretch of words that has a smallest period ``q`` (words ``q`` apart are
identical), is at least ``max(least_length, 3 * q)`` long, and keeps that period with no
neighbouring word added.  A word is dropped from the collapsed text if any run contains it
after the run's first ``q`` words.

Method: maximal-pair enumeration.  Two places ``i < j`` of a text are a maximal pair of
length ``n`` if the ``n`` words from them on agree, the words after those differ and the words before
them differ.  If ``j - i <= n / 2``, words ``i`` to ``j + n`` are a run and no
extension is needed.  Maximal pairs are found at the intervals of the LCP-interval tree, which is walked
bottom-up over a suffix order: an interval has the places of its children, and joins them
the smaller into the larger.  Places are kept in classes by their left word: children that are all
of one class have no maximal pair between them and are joined without a search.  Otherwise a
place is compared with its neighbours in the other child only: the words of an interval occur
nowhere inside their own smallest period, so the pair that shows a run's smallest period is a pair of
neighbours.  Other pairs of the same stretch have a multiple of the period; the smallest stays.

A run of ``least_length`` words agrees with itself for ``2 / 3`` of them at least, so only places whose
words of that number occur twice in the text are put in suffix order; all other words can't be in a run.
Texts of a batch are worked on together.

Everything is done inside one text, so rows are mapped where they lie and nothing is
shuffled.  Memory follows one Arrow batch or one longer text.

Defined cases: null, empty and blank texts have no words and no runs, their collapsed text is
empty; repeated rows are worked on alike; texts of any length are searched whole; extra columns
are ignored, whatever their names; an empty table gives an empty result.  Invalid
``least_length`` (below 4) is an error.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, arrow_map, release, text_or_empty

LEAST_LENGTH = 24
PERIODS = 3  # a run holds its period so many times at least
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _recurring(words: np.ndarray, text_of: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a stretch of ``width`` words that occurs twice in their text (or whose hash does)."""
    total = _spread(words.astype(np.uint64)) ^ _spread(text_of.astype(np.uint64) + np.uint64(1 << 40))
    done = 1
    while done < width:  # widths 1, 2, 4, ... and what is missing
        step = min(done, width - done)
        total = _spread(total[:-step] * np.uint64(0x9E3779B97F4A7C15) + total[step:])
        done += step
    order = np.sort(total)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    inside = np.zeros(len(words) + 1, np.int32)
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, total), len(twice) - 1)] == total)
        inside[at] += 1
        inside[at + width] -= 1
    return np.cumsum(inside[:-1]) > 0


def _suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order and the words that each shares with the one before it, by prefix doubling.

    ``symbols`` are dense ranks; each stretch ends with a symbol of its own, so no two suffixes are equal.
    """
    n = len(symbols)
    rank, levels = symbols.astype(np.int64) + 1, []
    while True:
        levels.append(rank)
        step = 1 << len(levels) - 1
        key = rank * (n + 2)
        key[:-step] += rank[step:]
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], np.diff(key[order]) != 0)))
        if rank[order[-1]] == n or step >= n:
            break
    before, after = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for k in reversed(range(len(levels))):
        # an end symbol is met before a place runs out of the array
        a, b = np.minimum(before + shared, n - 1), np.minimum(after + shared, n - 1)
        shared += (levels[k][a] == levels[k][b]).astype(np.int64) << k
    return order, shared


class _Places:
    """The places of an interval of the tree in ascending order; ``left`` is their left word if they are one class."""

    __slots__ = ("left", "at")

    def __init__(self, place: int, left: int):
        self.at, self.left = [place], left


def _joined(a: _Places, b: _Places, length: int, least: int, left: list[int], found: dict[tuple[int, int], int]) -> _Places:
    """Two children of an interval of ``length`` words as one; runs between neighbours of both go to ``found``."""
    if len(a.at) < len(b.at):
        a, b = b, a
    at = a.at
    if a.left is None or a.left != b.left:
        for x in b.at:
            k = bisect_left(at, x)
            for y in at[max(k - 1, 0) : k + 1]:  # the places before and after x
                i, period = min(x, y), abs(x - y)
                if (PERIODS - 1) * period <= length and period + length >= least and left[x] != left[y]:
                    key = (i, period + length)
                    found[key] = min(found.get(key, period), period)
        a.left = None
    if b.at[0] > at[-1]:
        at += b.at
    else:
        for x in b.at:
            at.insert(bisect_left(at, x), x)
    return a


def _pairs(order: list[int], shared: list[int], left: list[int], shortest: int, least: int) -> dict[tuple[int, int], int]:
    """``(place, length): period`` of all runs, from the LCP-interval tree over ``order``, walked bottom-up.

    Intervals of less than ``shortest`` words are not built.
    """
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, _Places]] = []
    last = _Places(order[0], left[order[0]])
    for place, length in zip([*order[1:], None], [*shared, 0], strict=True):
        while stack and stack[-1][0] > length:
            depth, inner = stack.pop()
            last = _joined(inner, last, depth, least, left, found)
        if length >= shortest:
            if stack and stack[-1][0] == length:
                depth, inner = stack.pop()
                last = _joined(inner, last, depth, least, left, found)
            stack.append((length, last))
        if place is not None:
            last = _Places(place, left[place])
    return found


def batch_runs(texts: list[list], least: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each text, a list of words, by start and then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    codes: dict = defaultdict(count().__next__)
    # every text is preceded by a symbol of its own; one more stands behind the last
    starts = np.cumsum(sizes + 1) - sizes
    words = np.full(int(sizes.sum()) + len(texts) + 1, -1, np.int64)
    for start, text in zip(starts.tolist(), texts, strict=True):
        words[start : start + len(text)] = np.fromiter(map(codes.__getitem__, text), np.int64, len(text))
    marks = np.flatnonzero(words < 0)
    words[marks] = len(codes) + np.arange(len(marks))
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    text_of = np.append(text_of, len(texts))
    shortest = -(-2 * least // PERIODS)
    inside = np.flatnonzero(_recurring(words, text_of, shortest)) if len(words) > shortest else np.zeros(0, np.int64)
    if not len(inside):
        return out
    # only recurring stretches, each with an end symbol of its own
    ends = np.flatnonzero(np.append(np.diff(inside) != 1, True))
    place = np.arange(len(inside)) + np.searchsorted(ends, np.arange(len(inside)))
    size = len(inside) + len(ends)
    symbols, origin = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    origin[place] = inside
    keys, dense = np.unique(text_of[inside] * (len(codes) + 1) + words[inside], return_inverse=True)
    symbols[place] = dense
    symbols[origin < 0] = len(keys) + np.arange(len(ends))
    order, shared = _suffix_order(symbols)
    left = np.where(origin >= 0, words[np.maximum(origin, 1) - 1], -1)
    found = _pairs(order.tolist(), shared.tolist(), left.tolist(), shortest, least)
    for at, period, length in sorted((at, period, length) for (at, length), period in found.items()):
        text = int(text_of[origin[at]])
        out[text].append((int(origin[at] - starts[text]), length, period))
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id``, its ``runs`` (start and length in words, period; ascending) and its ``collapsed`` text for every row."""
    if least < 4:
        raise ValueError("a run has four words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            runs = batch_runs(texts, least)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs]
            collapsed = pa.array([b" ".join(kept_words(t, own)) for t, own in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, RUN_TYPE), collapsed], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, ["doc_id", "text"], run, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_loops(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """``doc_id, text``: the text of about one document in ``one_in`` ends in a loop of its own words.

    Which ones, and where the loop starts and how long its period is, comes from the checksum of ``doc_id``; a row
    with a null doc_id stays as it is.  A looped text has its words joined by single spaces.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text_or_empty(), f"[{SPACE_CLASS}]+"), lambda w: w != "")
    g = F.floor(F.col("_h") / one_in)

    def loop(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        tail = F.transform(F.sequence(a, n - F.lit(1)), lambda i: F.get(w, (a + F.pmod(i - a, p)).cast("int")))
        return F.array_join(F.concat(F.slice(w, 1, a.cast("int")), tail), " ")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), h.alias("_h"))
    rows = rows.withColumn("_words", F.when(F.pmod("_h", F.lit(one_in)) == 0, words))
    return rows.select("doc_id", F.when(F.size("_words") > 0, loop(F.col("_words"))).otherwise(F.col("text")).alias("text"))


def runs_query(docs: DataFrame) -> DataFrame:
    """Number of runs, the one of the greatest exact exponent, and digests of all runs and of the collapsed text."""
    found = find_runs(with_loops(docs))
    none = "CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"
    # runs ascend by start and period, so a later one wins only by a greater exponent
    best = F.expr(f"aggregate(runs, {none}, (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
