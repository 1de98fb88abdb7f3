"""Language identification in two steps: family first, then the language inside it.

Features are byte trigrams of the lower-cased text, other bytes than letters
blanked, hashed into ``BUCKETS`` columns and taken as shares of the text.  Linear
support vector machines are fitted on a bounded sample of labelled documents
(``per_language`` of each, ``most`` in all; a documented bound, as fitting needs no
more): one per family against the rest, and one for every pair of languages of
a family.  A text goes to the family of the largest margin, and inside it to the
language that wins most pairs.

Prediction reads whole texts only, at one vectorised lookup per byte for all
machines together, a block of bytes at a time however long a text is.

Defined cases: null texts and texts without a letter get ``und`` and score 0;
with one labelled language all other texts get it; without any, all get ``und``.
Rows with a null doc_id are predicted, never learned from.  Repeated rows are predicted
alike; equal margins go to the first name.  Languages beyond the ``most`` most frequent
are not learned.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_map, release

BITS = 15
BUCKETS = 1 << BITS
BLOCK = 1 << 18  # trigrams that are looked up at once
#: Languages by family; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "ur", "gu", "pa"),
}
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters become spaces.
BLANK = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def _buckets(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _bytes(text: str) -> bytes:
    # two spaces in front: the trigrams over the end of a text are then the same whatever text comes next
    return b"  " + text.lower().encode("utf-8", "replace").translate(BLANK) + b" "


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, columns, shares = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and LETTER.search(text):
                at, n = np.unique(_buckets(_bytes(text)), return_counts=True)
                langs.append(lang)
                columns.append(at.astype(np.int32))
                shares.append((n / n.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(columns, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["lang", "at", "share"]
        )


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _machine(gram: np.ndarray, y: np.ndarray, cost: float = 50.0, rounds: int = 30) -> np.ndarray:
    """Dual coordinate ascent of a linear support vector machine; y is -1 or 1. Returns y times alpha."""
    alpha, margin = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(3)
    diagonal = np.maximum(gram.diagonal(), 1e-12)
    # classes count alike however many examples they have
    limit = np.where(y > 0, cost / max((y > 0).sum(), 1), cost / max((y < 0).sum(), 1)) * len(y) / 2
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * margin[i]) / diagonal[i], 0.0), limit[i])
            if new != alpha[i]:
                margin += (new - alpha[i]) * y[i] * gram[i]
                moved += abs(new - alpha[i])
                alpha[i] = new
        if moved < 1e-6:
            break
    return alpha * y


class LanguageModel:
    """Weights of all machines in one matrix (a column each), their names and families."""

    def __init__(self, families: list[str], pairs: list[tuple[str, str]], languages: dict[str, list[str]], weights: np.ndarray, bias: np.ndarray, scale: np.ndarray):
        self.families, self.pairs, self.languages = families, pairs, languages
        self.weights, self.bias, self.scale = weights, bias, scale

    @classmethod
    def fit(cls, langs: list[str], columns: list[np.ndarray], shares: list[np.ndarray]) -> LanguageModel:
        names = sorted(set(langs))
        languages: dict[str, list[str]] = {}
        for name in names:
            languages.setdefault(family_of(name), []).append(name)
        families = sorted(languages)
        pairs = [p for f in families for p in combinations(languages[f], 2)]
        used = np.unique(np.concatenate(columns)) if columns else np.zeros(0, np.int64)
        x = np.zeros((len(langs), len(used)), np.float32)
        for row, (at, share) in enumerate(zip(columns, shares, strict=True)):
            x[row, np.searchsorted(used, at)] = share
        spread = 1 / np.sqrt(np.maximum(x.mean(axis=0), 1e-7)) if len(langs) else np.zeros(0)
        x *= spread.astype(np.float32)
        gram = (x @ x.T).astype(np.float64) + 1  # the constant is the bias
        labels = np.array(langs)
        kinds = np.array([family_of(v) for v in langs])
        count = (len(families) if len(families) > 1 else 0) + len(pairs)
        weights, bias, scale = np.zeros((BUCKETS, max(count, 1)), np.float32), np.zeros(max(count, 1)), np.ones(max(count, 1))
        tasks = [(np.ones(len(langs), bool), kinds == f) for f in families] if len(families) > 1 else []
        tasks += [((labels == a) | (labels == b), labels == a) for a, b in pairs]
        for k, (rows, positive) in enumerate(tasks):
            rows = np.flatnonzero(rows)
            beta = _machine(gram[np.ix_(rows, rows)], np.where(positive[rows], 1.0, -1.0))
            weights[used, k] = (beta @ x[rows]) * spread
            bias[k] = beta.sum()
        return cls(families, pairs, languages, weights, bias, scale)

    def _sums(self, raw: bytes, ends: np.ndarray) -> np.ndarray:
        """Weights summed over the trigrams of texts that lie one after the other in ``raw``, ``BLOCK`` trigrams at a time."""
        sums = np.zeros((len(ends), len(self.bias)))
        starts = np.concatenate(([0], ends[:-1]))
        for begin in range(0, len(raw), BLOCK):
            part = raw[begin : begin + BLOCK + 2]
            at = _buckets(part + b"  " if begin + BLOCK + 2 > len(raw) else part)  # trigrams across two texts are those of a text's end and two spaces
            first, last = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(starts, begin + BLOCK))
            cuts = np.maximum(starts[first:last] - begin, 0)
            sums[first:last] += np.add.reduceat(self.weights[at[:BLOCK]], cuts, axis=0, dtype=np.float64)
        return sums

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, score = ["und"] * len(texts), np.zeros(len(texts))
        good = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        if not good or not self.families:
            return out, score
        margins = np.zeros((len(good), len(self.bias)))
        start = 0
        while start < len(good):  # about a million bytes of texts at a time, or one longer text
            raws, total, stop = [], 0, start
            while stop < len(good) and (total < 1 << 20 or not raws):
                raws.append(_bytes(texts[good[stop]]))
                total += len(raws[-1])
                stop += 1
            lengths = np.array([len(r) for r in raws])
            margins[start:stop] = self._sums(b"".join(raws), np.cumsum(lengths)) / lengths[:, None] + self.bias
            start = stop
        n_families = len(self.families) if len(self.families) > 1 else 0
        if n_families:
            m = margins[:, :n_families]
            chosen = m.argmax(axis=1)
            top = m.max(axis=1)
            rest = np.where(np.arange(n_families) == chosen[:, None], -np.inf, m).max(axis=1)
            sure = 1 / (1 + np.exp(-np.clip(3 * (top - rest) / 2, -30, 30)))
        else:
            chosen, sure = np.zeros(len(good), int), np.ones(len(good))
        wins = {v: np.zeros(len(good)) for f in self.families for v in self.languages[f]}
        weight = {v: np.zeros(len(good)) for v in wins}
        for k, (a, b) in enumerate(self.pairs, n_families):
            m = margins[:, k]
            wins[a] += m > 0
            wins[b] += m <= 0
            weight[a] += m
            weight[b] -= m
        for row, k in enumerate(good):
            members = self.languages[self.families[chosen[row]]]
            ranked = sorted(members, key=lambda v: (-wins[v][row], -weight[v][row], v))
            best = ranked[0]
            inner = 1.0
            if len(ranked) > 1:
                gap = (weight[best][row] - weight[ranked[1]][row]) / max(len(members), 2)
                inner = 1 / (1 + np.exp(-min(max(3 * gap, -30), 30)))
            out[k], score[k] = best, sure[row] * inner
        return out, score


def fit_language(docs: DataFrame, per_language: int = 300, most: int = 2400) -> LanguageModel:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return LanguageModel.fit([], [], [])
    cap = max(1, min(per_language, most // len(counts)))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000))
    chance = F.create_map(*(v for lang, n in counts.items() for v in (F.lit(lang), F.lit(min(1.0, (1.5 * cap + 10) / n) * 1e6))))
    likely = labelled.withColumn("dice", dice).filter(F.col("dice") < F.coalesce(chance[F.col("lang")], F.lit(0.0)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("dice", "doc_id"))  # about 1.5 x cap rows a language
    sample = likely.select("lang", "text", "dice", "doc_id").withColumn("place", first).filter(F.col("place") <= cap)
    rows = arrow_map(sample, ["lang", "text"], _sample_features, "lang string, at array<int>, share array<float>").collect()
    rows.sort(key=lambda r: (r["lang"], len(r["at"]), r["at"], r["share"]))
    return LanguageModel.fit([r["lang"] for r in rows], [np.array(r["at"], np.int64) for r in rows], [np.array(r["share"], np.float32) for r in rows])


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, which take the place of columns of these names."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    place = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return arrow_map(docs, names, run, schema)


def _digest_predictions(model_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model_ref.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_query(docs: DataFrame) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit_language(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return arrow_map(rows, ["doc_id", "held_out", "text"], _digest_predictions(model), "doc_id bigint, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The documents whose language is recognised: not ``und``, and no weaker than ``least_score``."""
    names, place = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(fit_language(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least_score for lang, score in zip(langs, scores, strict=True)], pa.bool_()))

    return arrow_map(docs, names, run, docs.schema)
