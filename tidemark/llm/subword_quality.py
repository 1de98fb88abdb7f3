"""Quality classifier on supervised subword embeddings.

A text is the mean of learned vectors: one for each occurrence of a word, of a pair of words in a row, and of a
character n-gram (three and four code points inside a word and its boundary marks), hashed into
``BUCKETS`` rows.  A pair is hashed by the difference of its words' hashes, so a word that follows itself is one
and the same feature for all words.  A softmax layer turns the mean into the probabilities of the labels 0 and 1.
Vectors and layer are trained together by stochastic gradient descent in numpy, a
document a step, with a falling step size and a fixed seed.

It is fitted on a bounded sample of labelled documents: ``per_label`` of each label (a documented
parameter; both labels weigh alike in the loss, whatever their numbers).  The sample is drawn by a hash of doc_id.

Prediction reads whole texts.  The mean of vectors times the layer is the mean of the vectors' own products
with it, so every bucket has one number, the log-odds that it adds, and a text costs one vectorised lookup an
occurrence.  These numbers are fixed-point integers, so a score doesn't depend on how rows are batched.

Defined cases: null, empty and blank texts have no occurrence, and their score is that of the layer's
bias; without any labelled document all scores are 0.5; repeated rows are scored alike and a
doc_id with several labels counts with each of them; rows with a null doc_id or label are scored, never
learned from, and are not held out; texts of any length are read whole, in pieces of about ``BLOCK`` code points that are cut at
white space (a word that is longer than that counts as several words, and the words at a cut aren't a pair); extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, release, sized_broadcast

BITS = 16
BUCKETS = 1 << BITS
BLOCK = 1 << 18  # code points that are looked up at once
WIDTH = 16  # of the vectors
FIXED = 1 << 20  # units of the fixed-point log-odds
CUT = re.compile(r"[\x20\x09-\x0D]")
ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` modulo 2**64, and those of its inverse."""
    n = BLOCK * 2 + 8
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def occurrences(block: str, cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and buckets of the trigrams, four-grams, words and word pairs of ``block``.

    The block is one or more pieces, which begin and end with a space; ``cuts`` are their starts.
    """
    c = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    space = (c == 32) | (c - np.uint32(9) < 5)
    c[space] = 32
    inner = ~space
    shift = np.uint32(32 - BITS)
    three = c[:-2] * ODD[0] + c[1:-1] * ODD[1] + c[2:] * ODD[2]
    at = np.flatnonzero(inner[1:-1])
    found = [(at, ((three ^ three >> np.uint32(15)) * ODD[3] >> shift)[at])]
    four = three[:-1] + c[3:] * ODD[3]
    at = np.flatnonzero(inner[1:-2] & inner[2:-1])
    found.append((at, ((four ^ four >> np.uint32(13)) * ODD[0] >> shift)[at]))
    up, down = _powers()
    sums = np.cumsum(c * up[: len(c)])
    first, last = np.flatnonzero(space[:-1] & inner[1:]), np.flatnonzero(inner[:-1] & space[1:])
    word = (sums[last] - sums[first]) * down[first + 1]
    word = (word ^ word >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    found.append((first, (word >> np.uint64(64 - BITS)).astype(np.uint32)))
    follows = np.ones(len(first), bool)
    heads = np.searchsorted(first, cuts)
    follows[heads[heads < len(first)]] = False
    at = np.flatnonzero(follows)
    pair = word[at] - word[at - 1]
    pair = (pair ^ pair >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - BITS)
    found.append((first[at], pair.astype(np.uint32)))
    return found


def pieces(text: str) -> Iterator[str]:
    """The text between spaces, in parts of about ``BLOCK`` code points that end at white space where there is some."""
    start = 0
    while len(text) - start > BLOCK:
        cut = CUT.search(text, start + BLOCK, start + 2 * BLOCK)
        stop = cut.end() if cut else start + 2 * BLOCK
        yield f" {text[start:stop]} "
        start = stop
    yield f" {text[start:]} "


def _shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares of its occurrences."""
    counts = np.zeros(BUCKETS, np.int64)
    for piece in pieces(text or ""):
        for _, bucket in occurrences(piece, np.zeros(1, np.int64)):
            counts += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(counts.sum(), 1)


def _sample_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, shares = [], []
        for text in batch.column(3).to_pylist():
            own, share = _shares(text)
            at.append(own.astype(np.uint16).view(np.int16))
            shares.append(share.astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(at, pa.list_(pa.int16())), pa.array(shares, pa.list_(pa.float32()))], ["label", "dice", "doc_id", "at", "share"]
        )


class SubwordModel:
    """The log-odds that each bucket adds, in units of ``1 / FIXED``, and the bias."""

    def __init__(self, odds: np.ndarray, bias: float):
        self.odds, self.bias = odds, bias

    @classmethod
    def fit(cls, labels: list[int], columns: list[np.ndarray], shares: list[np.ndarray], rounds: int = 12, step: float = 0.3, seed: int = 7) -> SubwordModel:
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
        present = np.bincount(labels, minlength=2) if labels else np.ones(2)
        weight = len(labels) / 2 / np.maximum(present, 1)
        done, steps = 0, max(rounds * len(labels), 1)
        for _ in range(rounds):
            for k in rng.permutation(len(labels)):
                at, share, label = columns[k], shares[k], labels[k]
                pace = np.float32(step * (1 - done / steps) * weight[label])
                done += 1
                own = vectors[at]
                mean = share @ own
                z = mean @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = layer @ p
                # the mean is a small vector, so its layer takes larger steps
                layer -= pace * np.outer(mean, p)
                bias -= pace / 64 * p
                own -= np.outer(share * pace * WIDTH, back)
                vectors[at] = own
        odds = vectors.astype(np.float64) @ (layer[:, 1] - layer[:, 0]).astype(np.float64)
        return cls(np.round(odds * FIXED).astype(np.int64), float(bias[1] - bias[0]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each text."""
        total, seen = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0

        def look_up() -> None:
            cuts = np.concatenate(([0], np.cumsum([len(p) for p in held])))
            for at, bucket in occurrences("".join(held), cuts[:-1]):
                # n-grams over the border of two pieces have a space inside and aren't found
                sums = np.concatenate(([0], np.cumsum(self.odds[bucket])))
                ends = np.searchsorted(at, cuts)
                np.add.at(total, owner, np.diff(sums[ends]))
                np.add.at(seen, owner, np.diff(ends))

        for k, text in enumerate(texts):
            for piece in pieces(text or ""):
                if size + len(piece) > BLOCK and held:
                    look_up()
                    held, owner, size = [], [], 0
                held.append(piece)
                owner.append(k)
                size += len(piece)
        if held:
            look_up()
        z = total / (FIXED * np.maximum(seen, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = 1000) -> SubwordModel:
    """Fit on at most ``per_label`` labelled documents of each label that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).distinct()
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    dice = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000))
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col("label") == label, F.lit(min(1.0, (1.5 * per_label + 10) / n) * 1e6)).otherwise(chance)
    likely = known.withColumn("dice", dice).filter(F.col("dice") < chance)
    place = F.row_number().over(Window.partitionBy("label").orderBy("dice", "doc_id"))  # about 1.5 x per_label rows a label
    drawn = likely.withColumn("place", place).filter(F.col("place") <= per_label).drop("place")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(sized_broadcast(drawn), "doc_id").select("label", "dice", "doc_id", "text")
    # rows that share a doc_id are one draw, of the smallest text hash
    one = Window.partitionBy("label", "doc_id").orderBy(F.xxhash64("text"))
    sample = sample.withColumn("copy", F.row_number().over(one)).filter("copy = 1").drop("copy")
    rows = arrow_map(sample, ["label", "dice", "doc_id", "text"], _sample_shares, "label int, dice bigint, doc_id bigint, at array<smallint>, share array<float>").collect()
    rows.sort(key=lambda r: (r["dice"], r["doc_id"], r["label"]))
    columns = [np.array(r["at"], np.int16).view(np.uint16).astype(np.int64) for r in rows]
    return SubwordModel.fit([r["label"] for r in rows], columns, [np.array(r["share"], np.float32) for r in rows])


def score_quality(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            scores = shared.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(rows, ["doc_id", "held_out", "text"], run, "doc_id bigint, held_out boolean, score double")


def quality_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
