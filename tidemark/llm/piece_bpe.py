"""Exact merge-type piece encoding by backtracking, and decoding.

A text becomes pieces without running the merges over it.  An Aho-Corasick
automaton gives the pieces that start at each place; the longest is tried first,
and it may stand after its left neighbour only if re-merging the two neighbours'
joint text gives exactly these two pieces again: the merges that made the two are
undone from the last one on, and no piece across their border may have been able to
merge before.  When no piece fits, the last piece is taken back, and a bitfield
remembers the places from which no way led on, so no place is tried twice.

All new stretches of a batch are scanned and searched at once, in lockstep; longer ones,
and those with rare characters, one by one.  Answers of compatibility checks are
remembered.

No piece crosses the start of a run of spaces or a line feed, and no merge joins two
characters that never stand side by side inside a piece.  The encoder checks
this on the vocabulary it loads, encodes the stretches between such places
one by one, and remembers the distinct ones in a cache of bounded entries and lengths.

Characters outside the vocabulary become byte pieces, ``<0xNN>``.

Defined cases: null and empty texts give no ids and decode to an empty text;
lone surrogates can't reach here, as Spark strings are UTF-8; repeated rows
are encoded alike; an empty table gives an empty result.  A very long text is cut into
stretches like any other; a very long stretch costs time and memory in proportion to
its length and isn't remembered.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hold

MARK = "▁"  # stands for a space in pieces
NORMAL = 1
LONG = 63  # characters up to which a stretch is searched with others and remembered


class Known(dict):
    """What is remembered of stretches; those too long to be remembered are in ``long`` for one batch of texts."""

    def __init__(self):
        super().__init__()
        self.long: dict[str, str] = {}

    def __missing__(self, stretch: str) -> str:
        return self.long[stretch]


class LongestMatches:
    """Aho-Corasick over reversed pieces, run over many short stretches in lockstep: at each place the longest piece that starts there.

    Transitions are a table of states by the ``WIDTH - 1`` most frequent characters of the pieces;
    ``codes`` is zero for all others.
    """

    WIDTH = 128

    def __init__(self, pieces: dict[str, int]):
        often = Counter(c for piece in pieces for c in piece)
        letters = sorted(often, key=lambda c: (-often[c], c))[: self.WIDTH - 1]
        self.codes = np.zeros(0x110000, np.uint8)
        self.codes[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        code = {c: k for k, c in enumerate(letters, 1)}
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for piece, number in pieces.items():
            if all(c in code for c in piece):
                node = 0
                for c in reversed(piece):
                    node = children[node].setdefault(code[c], len(children))
                    if node == len(children):
                        children.append({})
                        own.append(-1)
                own[node] = number
        self.table = np.zeros((len(children), self.WIDTH), np.uint16 if len(children) < 1 << 16 else np.int32)
        self.longest = np.array(own, np.int32)
        level, fallback = [0], np.zeros(len(children), np.int32)
        while level:
            below = []
            for node in level:
                if node:
                    self.table[node] = self.table[fallback[node]]
                    if own[node] < 0:
                        self.longest[node] = self.longest[fallback[node]]
                for c, child in children[node].items():
                    fallback[child] = self.table[node, c] if node else 0
                    below.append(child)
                if children[node]:
                    self.table[node, list(children[node])] = list(children[node].values())
            level = below
        self.flat = self.table.reshape(-1)

    def find(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The longest piece from each place of stretches that lie one after the other in ``codes``, or -1; one -1 more at the end."""
        out = np.full(len(codes) + 1, -1, np.int32)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = (starts + sizes - 1)[order], -sizes[order]
        state = np.zeros(len(order), np.int32)
        for k in range(-int(sizes[0]) if len(order) else 0):
            live = int(np.searchsorted(sizes, -k))
            at = ends[:live] - k
            state = self.flat.take(state[:live].astype(np.int64) * self.WIDTH + codes.take(at))
            out[at] = self.longest.take(state)
        return out


class PieceModel:
    """Pieces, scores and the two directions of text and ids, from a sentencepiece BPE model file."""

    def __init__(self, path: str, most: int = 120_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only merge-type models that keep the text as it is are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        if not proto.trainer_spec.byte_fallback or {NORMAL, 2, 3, 6} < set(self.kinds):
            raise ValueError("byte fallback and plain pieces are required")
        self.id_of = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] == NORMAL}
        self.score = {p: proto.pieces[k].score for p, k in self.id_of.items()}
        self.byte_id = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == 6}
        self.byte_of = {k: b for b, k in self.byte_id.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.id_of.items():
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.touching = {piece[k : k + 2] for piece in self.id_of for k in range(len(piece) - 1)}
        if any(b == MARK != a or "\n" in (a, b) for a, b in self.touching):
            raise ValueError("a piece crosses the start of a word or a line")
        self.sizes = [len(p) for p in self.pieces]
        self.lengths = np.array(self.sizes)
        self.digits = [str(k) for k in range(len(self.pieces))]
        # the next shorter piece from the same place
        self.shorter = np.array([next((self.id_of[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), -1) if kind == NORMAL else -1 for p, kind in zip(self.pieces, self.kinds, strict=True)], np.int32)
        self.matches = LongestMatches(self.id_of)
        self.most = most
        self.trees: dict[int, tuple[int, int] | None] = {}
        self.tied: set[int] = set()  # pieces that don't score below their parts
        self.fits: dict[int, bool] = {}
        self.parts: dict[str, list[int]] = {}
        self.ids_text, self.before = Known(), Known()
        self.decoded: dict[str, str] = {}  # of stretches whose ids give another text than theirs
        self.made = np.array([kind == NORMAL and self.tree(k) is not None for k, kind in enumerate(self.kinds)])

    # encoding -----------------------------------------------------------

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The pieces of a short text by the merges themselves, best score first, then leftmost, down to ``least`` parts."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def tree(self, piece: int) -> tuple[int, int] | None:
        """The two pieces of a piece's last merge; itself twice for a character, None for a piece that merging never gives."""
        found = self.trees.get(piece, 0)
        if found == 0:
            text = self.pieces[piece]
            parts = self.merge(text, 2)
            found = None
            if len(parts) == 1:
                found = (piece, piece)
            elif len(parts) == 2:
                ends = tuple(self.id_of[p] for p in parts)
                found = ends
                # merges can be undone from the last on where parts score better than the whole (runs of marks score all alike)
                if any(self.tree(e) is None or e in self.tied or (len(p) > 1 and self.score[p] <= self.score[text]) for e, p in zip(ends, parts, strict=True)):
                    self.tied.add(piece)
            self.trees[piece] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two pieces that merging gives ends in these two."""
        key = left * len(self.pieces) + right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= self.most:
                self.fits.clear()
            found = self.fits[key] = self._stand(left, right)
        return found

    def _stand(self, left: int, right: int) -> bool:
        pieces, score = self.pieces, self.score
        self.tree(left), self.tree(right)
        if left in self.tied or right in self.tied:
            return self.merge(pieces[left] + pieces[right]) == [pieces[left], pieces[right]]
        undone, first = -math.inf, False  # score of the merge undone last; whether a merge across is before it at the same score
        while True:
            a, b = pieces[left], pieces[right]
            across = score.get(a + b)
            if across is not None and (across > undone or (first and across == undone)):
                return False
            made_a = score[a] if len(a) > 1 else math.inf
            made_b = score[b] if len(b) > 1 else math.inf
            if made_a == made_b == math.inf:
                return True
            if made_a < made_b:  # made later; at the same score the left one is made first
                undone, first, left = made_a, False, self.tree(left)[1]
            else:
                undone, first, right = made_b, True, self.tree(right)[0]

    def _compatible(self, keys: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs, each as left id times the number of pieces plus right id."""
        found = list(map(self.fits.get, keys.tolist()))
        if None in found:
            size = len(self.pieces)
            found = [self.compatible(*divmod(k, size)) if x is None else x for k, x in zip(keys.tolist(), found, strict=True)]
        return np.array(found, bool)

    def search(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short stretches, searched in lockstep: ids one stretch after the other, and how many each has.

        None has zero: a character is in no piece, or not in the table of transitions.
        """
        n = len(stretches)
        sizes = np.fromiter(map(len, stretches), np.int64, n)
        starts = np.cumsum(sizes) - sizes
        codes = self.matches.codes.take(np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32))
        longest = self.matches.find(codes, starts, sizes)
        lengths, shorter, many = self.lengths, self.shorter, len(self.pieces)
        stack, depth = np.zeros((n, LONG), np.int32), np.zeros(n, np.int64)
        failed = np.zeros(n, np.uint64)  # a bit for each place from which no way leads on
        place = np.zeros(n, np.int64)
        candidate = longest[starts]
        known = np.add.reduceat(codes == 0, starts) == 0 if n else np.zeros(0, bool)
        live = np.flatnonzero(known)
        while len(live):
            piece = candidate[live]
            back = live[piece < 0]
            ahead, piece = live[piece >= 0], piece[piece >= 0]
            there = place[ahead] + lengths[piece]
            fit = (failed[ahead] >> there.view(np.uint64) & np.uint64(1)) == 0
            first = depth[ahead] == 0
            fit &= ~first | self.made[piece]
            pairs = np.flatnonzero(fit & ~first)
            at = ahead[pairs]
            fit[pairs] = self._compatible(stack[at, depth[at] - 1].astype(np.int64) * many + piece[pairs])
            on, no = ahead[fit], ahead[~fit]
            stack[on, depth[on]] = piece[fit]
            depth[on] += 1
            place[on] = there[fit]
            candidate[no] = shorter[piece[~fit]]
            on = on[place[on] < sizes[on]]
            candidate[on] = longest[starts[on] + place[on]]
            if len(back):
                back = back[depth[back] > 0]  # no way at all from the start: depth stays zero
                failed[back] |= np.uint64(1) << place[back].view(np.uint64)
                depth[back] -= 1
                last = stack[back, depth[back]]
                place[back] -= lengths[last]
                candidate[back] = shorter[last]
            live = np.concatenate([on, no, back])
        return stack[np.arange(LONG) < depth[:, None]], depth

    def backtrack(self, text: str) -> list[int]:
        """Ids of one stretch of any length whose characters are all in the vocabulary."""
        n = len(text)
        starts: list[list[int]] = [[] for _ in range(n)]  # pieces from each place
        lengths = self.sizes
        for end, piece in self.automaton.iter(text):
            starts[end - lengths[piece] + 1].append(piece)  # ascending lengths, as ends ascend
        failed = bytearray((n >> 3) + 1)
        taken: list[tuple[int, int]] = []  # place, index into starts
        place = 0
        index = len(starts[0]) - 1
        while place < n:
            while index >= 0:
                piece = starts[place][index]
                there = place + lengths[piece]
                if not failed[there >> 3] >> (there & 7) & 1 and (self.compatible(starts[taken[-1][0]][taken[-1][1]], piece) if taken else self.made[piece]):
                    break
                index -= 1
            if index >= 0:
                taken.append((place, index))
                place = there
                index = len(starts[place]) - 1 if place < n else 0
            else:
                if not taken:
                    raise ValueError("no encoding found")
                failed[place >> 3] |= 1 << (place & 7)
                place, index = taken.pop()
                index -= 1
        return [starts[p][k] for p, k in taken]

    def stretch(self, text: str) -> list[int]:
        """Ids of a text between two cuts: cut again where characters never touch inside a piece."""
        ids: list[int] = []
        start = 0
        touching, parts = self.touching, self.parts
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in touching:
                part = text[start:k]
                found = parts.get(part)
                if found is None:
                    if part in self.id_of or len(part) > 1:
                        found = self.backtrack(part)
                    else:
                        found = [self.byte_id[b] for b in part.encode("utf-8", "surrogatepass")]
                    if len(part) <= LONG:
                        if len(parts) >= self.most // 4:
                            parts.clear()
                        parts[part] = found
                ids += found
                start = k
        return ids

    @staticmethod
    def cut(text: str) -> list[str]:
        """Stretches of a text with its first space added; ``MARK`` for spaces."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            marked = MARK + text.replace(" ", MARK)
            return re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", marked)
        # a word that begins with a line feed has no space before it
        words = text.replace("\n", " \n").split(" ")
        return [w if w[:1] == "\n" else MARK + w for w in words]

    def learn(self, stretches: list[str]) -> None:
        """Remember the ids of new stretches, and of those whose ids decode to another text that text."""
        short = [s for s in stretches if len(s) <= LONG]
        ids, counts = self.search(short)
        digits = list(map(self.digits.__getitem__, ids.tolist()))
        pieces = list(map(self.pieces.__getitem__, ids.tolist()))
        stop = 0
        for stretch, count in zip(short, counts.tolist(), strict=True):
            start, stop = stop, stop + count
            if count:
                self.ids_text[stretch] = ",".join(digits[start:stop])
                if "".join(pieces[start:stop]) != stretch:
                    raise ValueError("pieces that don't make their stretch")
            else:
                self._learn_one(stretch, self.ids_text)
        for stretch in stretches:
            if len(stretch) > LONG:
                self._learn_one(stretch, self.ids_text.long)

    def _learn_one(self, stretch: str, known: dict[str, str]) -> None:
        ids = self.stretch(stretch)
        known[stretch] = ",".join(map(self.digits.__getitem__, ids))
        text = self.join(ids)
        if text != stretch.replace(MARK, " "):
            self.decoded[stretch] = text

    def id_texts(self, cuts: list[list[str]]) -> list[str]:
        """The ids of cut texts as decimal numbers with commas between them; their stretches are known afterwards."""
        for stretch in self.ids_text.long:
            self.decoded.pop(stretch, None)
        self.ids_text.long.clear()
        if len(self.ids_text) > self.most // 2:  # what was in use since the last turn stays for another one
            self.before, self.ids_text = self.ids_text, Known()
            self.decoded = {s: text for s, text in self.decoded.items() if s in self.before}
        missing = set(filterfalse(self.ids_text.__contains__, set(chain.from_iterable(cuts))))
        again = set(filter(self.before.__contains__, missing))
        for stretch in again:
            self.ids_text[stretch] = self.before[stretch]
        if len(missing) > len(again):
            self.learn(list(missing - again))
        return [",".join(map(self.ids_text.__getitem__, c)) for c in cuts]

    def text_of(self, stretches: list[str]) -> str:
        """The decoded text of known stretches, whose ids were decoded when they were learned."""
        if self.decoded and not self.decoded.keys().isdisjoint(stretches):
            text = "".join(self.decoded.get(s, s.replace(MARK, " ")) for s in stretches)
        else:
            text = "".join(stretches).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    def encode(self, text: str) -> list[int]:
        return [i for s in self.cut(text) for i in self.stretch(s)]

    # decoding -----------------------------------------------------------

    def join(self, ids: list[int]) -> str:
        """Text of ids inside a text: byte pieces form UTF-8, marks are spaces."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i].replace(MARK, " ") if self.kinds[i] == NORMAL else "")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As ``join``, without the space that encoding put in front."""
        text = self.join(ids)
        return text[1:] if text[:1] == " " else text


def _model(path: str) -> PieceModel:
    return hold(("pieces", path), lambda: PieceModel(path))


def _encoder(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                piece = batch.slice(k, 128)
                cuts = [model.cut(t or "") for t in piece.column(1).to_pylist()]
                lists = model.id_texts(cuts)
                texts = [model.text_of(c) for c in cuts]
                counts = pa.array([x.count(",") + 1 if x else 0 for x in lists], pa.int64())
                if digests:
                    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                    columns = [counts, pa.array(map(sha, lists), pa.string()), pa.array(map(sha, texts), pa.string())]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    ids = [list(map(int, x.split(","))) if x else [] for x in lists]
                    columns = [counts, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names = ["n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns], ["doc_id", *names])

    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, ["doc_id", "text"], _encoder(model_path, False), "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")


def piece_query(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the decoded text, made where the ids are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, ["doc_id", "text"], _encoder(model_path, True), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
