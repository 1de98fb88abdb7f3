"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces inside a word, and
dynamic programming carries only the best score and its number of pieces to each
place.  Ties and unknown characters follow the tokenizers library's unigram
model: a path is replaced only by a strictly better one, pieces reach a place
in ascending order of their starts, a character that is no piece costs the
lowest score less ten, and neighbouring unknown characters are one piece.

Words are cut as the library's Metaspace pre-tokenizer cuts them (a mark for
every space, one in front, a word starts at each mark), and counts of distinct words are kept
in a bounded cache, so a text costs one lookup per word.

Scores are summed in double precision in the order of the path, as the library
does, inside one word.

Defined cases: null and empty texts have no tokens; repeated rows count alike; texts of
any length are counted whole, a word at a time; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hold

MARK = "▁"
UNKNOWN_COST = 10.0


def piece_scores(model_path: str) -> list[tuple[str, float]]:
    """Unknown piece first, then the normal pieces of a sentencepiece model with their scores.

    Runs of spaces have no useful score in that file: those of two and more are left out, and a single
    space's mark gets the lowest score of the others, as words need it before characters outside the vocabulary.
    """
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as file:
        proto.ParseFromString(file.read())
    normal = [(p.piece, p.score) for p in proto.pieces if p.type == 1]
    lowest = min((score for _, score in normal if score > -1e8), default=0.0)
    return [("<unk>", 0.0)] + [(p, max(score, lowest)) for p, score in normal if score > -1e8 or p == MARK]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 600_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_COST
        self.most, self.counts = most, {}

    def count(self, word: str) -> int:
        """Pieces of one word."""
        n = len(word)
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(word):
            starts[end - length + 1].append((length, score))
        best: list[float | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        ends_unknown = [False] * (n + 1)  # whether the best path here ends in an unknown character
        best[0] = 0.0
        for place in range(n):
            so_far = best[place]  # every place is reached: single characters are always tried
            single = False
            for length, score in starts[place]:
                single |= length == 1
                there = place + length
                if best[there] is None or so_far + score > best[there]:
                    best[there], pieces[there], ends_unknown[there] = so_far + score, pieces[place] + 1, False
            if not single:
                there = place + 1
                if best[there] is None or so_far + self.unknown > best[there]:
                    best[there] = so_far + self.unknown
                    pieces[there] = pieces[place] + (0 if ends_unknown[place] else 1)
                    ends_unknown[there] = True
        return pieces[n]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Words with their mark; every space is a mark of its own."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        return [MARK + w for w in marked[1:].split(MARK)]

    def totals(self, texts: list[str | None]) -> np.ndarray:
        cuts = [self.cut(t or "") for t in texts]
        counts = self.counts
        missing: set[str] = set()
        for words in cuts:
            missing.update(filterfalse(counts.__contains__, words))
        if len(counts) + len(missing) > self.most:
            counts.clear()
            missing = {w for words in cuts for w in words}
        for word in missing:
            counts[word] = self.count(word)
        return np.array([sum(map(counts.__getitem__, words)) for words in cuts], np.int64)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = hold(("unigram", model_path), lambda: UnigramCounter(piece_scores(model_path)))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counter.totals(piece.column(1).to_pylist()))], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, ["doc_id", "text"], run, "doc_id bigint, n_tokens bigint")
