"""Token-id files: an adaptive context-mixing range coder over independent blocks.

Model.  Three predictors look at the ids so far: order 2 (where the last two ids
stood together before, and on from there while that place predicts right), order 1
(the id that followed the last id) and order 0 (adaptive counts of all ids).  Orders 2
and 1 name one id each, with a confidence: for order 2 how many ids agree up to its
place, for order 1 how often it was right.  A mixer keeps, for every pair of
confidences, how often each order was right, and turns that into the probability mass of each
prediction; the rest of the mass is spread by the order-0 counts.  One
arithmetic-coding step per id then codes it inside that mixture.

Lanes.  A block is cut into lanes of equal length that are coded in lockstep with
vector operations: all lanes share the block's model, and each has a range coder
of its own.  Model and coders start afresh with each block, and each block
carries the CRC-32 of its ids and of itself, so blocks decode in any order and
damage stays inside one block.

File.  One Parquet row per block (``part, block, part_start, n_ids, payload``);
Spark's commit protocol makes retried tasks write each part once.  ``payload`` is
self-contained (layout in ``encode_block``).  Blocks hold whole documents.

Defined cases: null text is an empty text, which gives the end id alone; a null
``doc_id`` sorts first and stays null; repeated rows are kept; extra columns are ignored, whatever their names; an empty table
gives files without blocks; a text longer than a block makes one long block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, arrow_map, hold, release, scratch_path, text_or_empty

MAGIC = b"TMRC"
TOTAL_BITS = 24  # of the mixture's interval
COUNT_BITS = 20  # of the order-0 part
TOTAL, BITS, LAST = np.int64(1 << TOTAL_BITS), np.uint64(TOTAL_BITS), np.uint64((1 << TOTAL_BITS) - 1)
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
WORD, TOP_SHIFT = np.uint64(16), np.uint64(48)
LEVELS = 8  # confidences 0..7
REFRESH = 32  # steps between updates of the order-0 intervals
HASH_BITS = 20
#: Class of how many ids before a lane's place agree with those before the place it follows.
AGREE = np.array([0, 0, 1, 2, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 7], np.int64)
CELL_BITS = 1
MOST_AGREE = len(AGREE) - 1
AGREE_KIND = AGREE << 4


class Mixer:
    """Predictions of orders 0 to 2 and their mixture; the same in coder and decoder.

    ``first`` (by last id) holds a predicted id times 8 plus a confidence of 0 to 7,
    ``second`` (by a hash of the last two) the place of the id that came after them.
    """

    def __init__(self, size: int, places: int):
        self.size = size
        self.first = np.zeros(size, np.int32)
        self.second = np.zeros(1 << HASH_BITS, np.int32 if places < 1 << 23 else np.int64)  # place times 256 plus mark
        self.right = np.zeros((LEVELS * LEVELS * 2, 3), np.int64)  # times order 2, order 1, neither was right
        self.right[:] = (1, 1, 6)
        self.counts = np.zeros(size, np.int64)
        self.waiting: list[np.ndarray] = []
        self.steps = 0
        self._spread()
        self._weigh()

    def _spread(self) -> None:
        room = (1 << COUNT_BITS) - self.size
        total = max(int(self.counts.sum()), 1)
        self.cum = np.zeros(self.size + 1, np.int64)
        share = (self.counts * room / total).astype(np.int64)  # below 2**53: the same on every machine
        np.cumsum(share + 1, out=self.cum[1:])
        self.cum[-1] = 1 << COUNT_BITS  # what rounding leaves goes to the last id
        self.cells = None

    def find(self, target: np.ndarray) -> np.ndarray:
        """The id whose order-0 interval holds each target: by the cell of a coarse table, then step by step."""
        if self.cells is None:
            edges = (self.cum + (1 << CELL_BITS) - 1) >> CELL_BITS  # first cell that begins inside or after an id's start
            self.cells = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(edges))
        x = self.cells.take(target >> CELL_BITS, mode="clip").astype(np.int64)
        at = np.flatnonzero(self.cum[1:].take(x) <= target)
        while len(at):
            step = x[at] + 1
            x[at] = step
            at = at[self.cum[1:].take(step) <= target[at]]
        return x

    def _weigh(self) -> None:
        seen = self.right.sum(axis=1)
        scale = TOTAL - (TOTAL >> 4)  # order 0 keeps a sixteenth at least
        self.mass2 = self.right[:, 0] * scale // seen
        self.mass1 = self.right[:, 1] * scale // seen
        self.mass1[1::2] = 0  # both orders name the same id
        self.masses = self.mass2 + self.mass1

    def predict(self, history: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray, agree: np.ndarray, follow: np.ndarray):
        """Slot of order 2 and its mark, the entry of order 1, the two guesses and the class of confidences.

        ``history`` holds the ids coded so far, step by step.  A lane whose last order-2 guess was wrong
        looks up where its last two ids stood together before; the mark tells whether
        the id before those was the same too.  ``follow`` and ``agree`` are changed in place.
        """
        slot = (two * 0x9E3779B1 + one * 0x85EBCA77) >> 7 & (1 << HASH_BITS) - 1
        mark = (three * 0x2C1B3C6D >> 5 & 0xFF).astype(self.second.dtype)
        lost = agree == 0
        entry = self.second.take(slot)
        np.copyto(follow, entry >> 8, where=lost)
        agree += lost * (((entry & 0xFF) == mark) + np.uint8(2))
        g2 = history.take(follow).astype(np.int32)
        e1 = self.first.take(one)
        g1 = e1 >> 3
        return slot, mark, e1, g1, g2, AGREE_KIND.take(agree) | ((e1 & 7) << 1 | (g1 == g2))

    def update(self, ids, narrow, places, one, slot, mark, e1, hit1, hit2, kind) -> None:
        """``narrow`` are the ids in 32 bits; ``places`` are those of the lanes times 256, in the type of ``second``."""
        lost = np.uint8(2) - hit1
        lost *= ~hit2
        self.right += np.bincount(kind * 3 + lost, minlength=self.right.size).reshape(self.right.shape) * 8
        if self.steps % 4 == 0 or self.steps < 16:
            over = self.right.sum(axis=1) > 1 << 18
            if over.any():
                self.right[over] = (self.right[over] >> 1) + 1
            self._weigh()
        self.second[slot] = places | mark
        trust = e1 & 7  # a hit adds one up to 7, a miss takes two, or one of one; a miss at 0 puts the new id in
        missed = np.where(trust == 0, narrow << np.int32(3), e1 - np.minimum(trust, 2))
        self.first[one] = np.where(hit1, e1 + (trust < 7), missed)
        self.waiting.append(ids)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps in (1, 2, 4, 8, 16):
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.size) * 32
            self.waiting.clear()
            self._spread()


def _lanes(n: int) -> int:
    return max(1, min(8192, n // 224))


def _id_type(size: int):
    return np.uint16 if size <= 1 << 16 else np.int32


def _shift_out(low, span):
    """Lanes whose top 16 bits are settled, or whose interval is too small and is cut to be settled."""
    settled = (low ^ (low + span)) < TOP
    small = span < BOTTOM
    small &= ~settled
    if small.any():
        tight = np.flatnonzero(small)
        span[tight] = (~low[tight] + np.uint64(1)) & (BOTTOM - np.uint64(1))
        settled |= small
    return settled


def _encode_ids(ids: np.ndarray, size: int) -> tuple[int, np.ndarray, bytes]:
    n, lanes = len(ids), _lanes(len(ids))
    steps = -(-n // lanes)
    # lane k codes ids[k * steps : (k + 1) * steps]; the last lanes may be short
    lengths = np.maximum(np.minimum(np.arange(1, lanes + 1) * steps, n) - np.arange(lanes) * steps, 0)
    padded = np.zeros(steps * lanes, _id_type(size))
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    history = np.zeros((steps + 2) * lanes, _id_type(size))  # a row of zeros, then one a step, filled as the decoder fills its own
    mixer = Mixer(size, len(history))
    lane = np.arange(lanes, dtype=mixer.second.dtype) << 8  # as places in ``second``
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    width = 2 * steps + 6
    out = np.zeros(lanes * width, np.uint16)  # a row for the first word of each lane, one for the second and so on
    place = np.arange(lanes)  # where the next word of a lane goes
    ends = np.zeros(lanes, np.int64)
    one, two, three, agree, follow = (np.zeros(lanes, np.int64) for _ in range(5))
    for step in range(steps):
        live = int(np.searchsorted(-lengths, -step, side="left"))  # lanes are full, then short, then empty
        if live < len(low):
            ends[live : len(low)] = _flush(low[live:], out, place[live:], lanes)
            low, span, one, two, three, agree, follow, place = (a[:live] for a in (low, span, one, two, three, agree, follow, place))
        x = grid[step, :live].astype(np.int64)
        narrow = x.astype(np.int32)
        here = slice((step + 1) * lanes, (step + 1) * lanes + live)
        slot, mark, e1, g1, g2, kind = mixer.predict(history, one, two, three, agree, follow)
        hit2, hit1 = g2 == narrow, g1 == narrow
        head = mixer.masses.take(kind)
        room = TOTAL - head
        start = (mixer.cum.take(x) * room >> COUNT_BITS) + head
        stop = (mixer.cum[1:].take(x) * room >> COUNT_BITS) + head
        at = np.flatnonzero(hit1)
        start[at], stop[at] = mixer.mass2.take(kind[at]), head[at]
        at = np.flatnonzero(hit2)
        start[at], stop[at] = 0, mixer.mass2.take(kind[at])
        unit = span >> BITS
        low = unit * start.view(np.uint64) + low
        span = unit * (stop - start).view(np.uint64)
        go = _shift_out(low, span)
        out[place] = (low >> TOP_SHIFT).astype(np.uint16)  # lanes that don't shift write over this later
        place = place + go * lanes
        move = go.astype(np.uint64) << np.uint64(4)
        low <<= move
        span <<= move
        at = np.flatnonzero(span < TOP)
        while len(at):
            l, s = low[at], span[at]
            go = np.flatnonzero(_shift_out(l, s))
            at, l, s = at[go], l[go], s[go]
            out[place[at]] = l >> TOP_SHIFT
            place[at] += lanes
            low[at], span[at] = l << WORD, s << WORD
        mixer.update(x, narrow, lane[:live] + (here.start << 8), one, slot, mark, e1, hit1, hit2, kind)
        history[here] = x
        three, two, one, agree, follow = two, one, x, np.minimum(agree + 1, MOST_AGREE) * hit2, follow + lanes
    ends[: len(low)] = _flush(low, out, place, lanes)
    used = ends // lanes
    width = int(used.max())
    rows = np.ascontiguousarray(out[: width * lanes].reshape(width, lanes).T)
    return lanes, used.astype(np.uint32), rows[np.arange(width) < used[:, None]].tobytes()


def _flush(low, out, place, lanes: int) -> np.ndarray:
    """Two words name a value inside the last interval; the decoder reads zeros after them."""
    value = low + (BOTTOM - np.uint64(1))
    out[place] = value >> TOP_SHIFT
    out[place + lanes] = value >> np.uint64(32) & np.uint64(0xFFFF)
    return place + 2 * lanes


def _decode_ids(n: int, size: int, lanes: int, used: np.ndarray, data: bytes) -> np.ndarray:
    steps = -(-n // lanes)
    lengths = np.maximum(np.minimum(np.arange(1, lanes + 1) * steps, n) - np.arange(lanes) * steps, 0)
    width = max(int(used.max(initial=0)), 4) + 4  # a lane shifts in two words fewer than it has, after the first four
    words = np.zeros((lanes, width), np.uint16)
    words[np.arange(width) < used[:, None]] = np.frombuffer(data, np.uint16)
    words = np.ascontiguousarray(words.T)
    history = np.zeros((steps + 2) * lanes, _id_type(size))
    mixer = Mixer(size, len(history))
    lane = np.arange(lanes, dtype=mixer.second.dtype) << 8  # as places in ``second``
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for k in range(4):
        code = code << WORD | words[k]
    words = words.reshape(-1)
    place = np.arange(lanes) + 4 * lanes
    one, two, three, agree, follow = (np.zeros(lanes, np.int64) for _ in range(5))
    for step in range(steps):
        live = int(np.searchsorted(-lengths, -step, side="left"))
        if live < len(low):
            low, span, code, one, two, three, agree, follow, place = (a[:live] for a in (low, span, code, one, two, three, agree, follow, place))
        here = slice((step + 1) * lanes, (step + 1) * lanes + live)
        slot, mark, e1, g1, g2, kind = mixer.predict(history, one, two, three, agree, follow)
        unit = span >> BITS
        value = np.minimum((code - low) // unit, LAST).view(np.int64)
        head = mixer.masses.take(kind)
        room = TOTAL - head
        target = ((((value - head + 1) << COUNT_BITS) - 1) / room).astype(np.int64)  # exact: below 2**44 by at most 2**24
        x = mixer.find(np.maximum(target, 0))
        start = (mixer.cum.take(x) * room >> COUNT_BITS) + head
        stop = (mixer.cum[1:].take(x) * room >> COUNT_BITS) + head
        at = np.flatnonzero(value < head)  # the guess of order 2 or 1 was right
        part = mixer.mass2.take(kind[at])
        by2 = value[at] < part
        x[at] = np.where(by2, g2[at], g1[at])
        start[at], stop[at] = np.where(by2, 0, part), np.where(by2, part, head[at])
        low = unit * start.view(np.uint64) + low
        span = unit * (stop - start).view(np.uint64)
        go = _shift_out(low, span)
        move = go.astype(np.uint64) << np.uint64(4)
        low <<= move
        span <<= move
        code <<= move
        code |= words.take(place) * go
        place = place + go * lanes
        at = np.flatnonzero(span < TOP)
        while len(at):
            l, s = low[at], span[at]
            go = np.flatnonzero(_shift_out(l, s))
            at, l, s = at[go], l[go], s[go]
            code[at] = code[at] << WORD | words[place[at]]
            place[at] += lanes
            low[at], span[at] = l << WORD, s << WORD
        narrow = x.astype(np.int32)
        hit2 = g2 == narrow
        mixer.update(x, narrow, lane[:live] + (here.start << 8), one, slot, mark, e1, g1 == narrow, hit2, kind)
        history[here] = x
        three, two, one, agree, follow = two, one, x, np.minimum(agree + 1, MOST_AGREE) * hit2, follow + lanes
    grid = history[lanes : (steps + 1) * lanes].reshape(steps, lanes)
    return grid.T.reshape(-1)[:n].astype(np.int64)


def encode_block(ids: np.ndarray, doc_ids: list, lengths: list, size: int) -> bytes:
    """Block layout, little-endian: magic, version u8, size u32, n_ids u64, n_docs u32, lanes u32,
    index bytes u32, CRC-32 of the ids (as u32) u32, index (zlib: doc_ids i64, nulls u8, lengths u64),
    words per lane u32, words u16, CRC-32 of all before u32."""
    raw = ids.astype("<u4").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    index = zlib.compress(
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + nulls.tobytes() + np.array(lengths, "<u8").tobytes(), 1
    )
    lanes, used, data = _encode_ids(ids, size) if len(ids) else (1, np.zeros(1, np.uint32), b"")
    head = MAGIC + struct.pack("<BIQIIII", 1, size, len(ids), len(doc_ids), lanes, len(index), zlib.crc32(raw))
    body = head + index + used.astype("<u4").tobytes() + data
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(payload: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """ids, doc_ids and lengths of a block; raises ValueError when a checksum differs."""
    body, (check,) = payload[:-4], struct.unpack("<I", payload[-4:])
    if body[:4] != MAGIC or zlib.crc32(body) != check:
        raise ValueError("token block is damaged")
    _, size, n, docs, lanes, index_bytes, ids_crc = struct.unpack_from("<BIQIIII", body, 4)
    at = 4 + struct.calcsize("<BIQIIII")
    index = zlib.decompress(body[at : at + index_bytes])
    at += index_bytes
    values = np.frombuffer(index, "<i8", docs)
    nulls = np.frombuffer(index, np.uint8, docs, 8 * docs)
    lengths = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
    used = np.frombuffer(body, "<u4", lanes, at).astype(np.int64)
    ids = _decode_ids(n, size, lanes, used, body[at + 4 * lanes :]) if n else np.zeros(0, np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("token block decodes to other ids")
    return ids, [None if z else int(v) for v, z in zip(values, nulls, strict=True)], lengths


class WordEncoder:
    """Ids of whole texts by the tokenizers library, one call per distinct unit.

    The tokenizer drops white space and never merges across it, so a text's ids
    are the ids of its words (cut at ASCII white space) in turn.  In a word of Latin letters
    (ASCII and U+00C0 to U+00FF), ASCII digits and ASCII signs the tokenizer lower-cases and cuts into
    runs of letters, runs of signs and single digits: these are the word's units.  A word with any other
    character, or with the beginning of an added token, is one unit as it stands.  Arrow
    numbers the distinct units of a batch.  Runs of letters go straight to the library's model
    (bytes mapped to its letters), all other units through the whole tokenizer.  Units of
    up to ``LONG`` characters are remembered; the memory is emptied before a batch when it is full.
    """

    LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII signs but the apostrophe, which the tokenizer may take with letters
    LONG = 64
    SPACE, LETTER, SIGN, DIGIT, OTHER = range(5)

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.most = most
        self.model = self.tokenizer.model
        self.mapped = {ord(c): "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in self.LETTERS}
        self.plain = frozenset(self.LETTERS)
        kinds = bytearray([self.OTHER]) * 256
        for kind, chars in ((self.SPACE, SPACE_CHARS), (self.LETTER, ASCII_LETTERS), (self.SIGN, self.SIGNS), (self.DIGIT, "0123456789")):
            for c in chars:
                kinds[ord(c)] = kind
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        heads = {t.encode()[:2] for t in added}
        for head in heads:
            if len(head) == 1:
                kinds[head[0]] = self.OTHER
        self.kinds = bytes(kinds)
        self.heads = [h for h in heads if len(h) == 2]
        if any(self.plain.issuperset(t) for t in added):  # such a token may be a whole run of letters
            self.plain = frozenset()
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}  # number of a unit that is remembered
        self.known, self.n_known = np.zeros(1 << 16, np.uint32), 0  # ids of all units one after the other
        self.begin, self.n_units = np.zeros(1 << 14, np.int64), 0  # where a unit's ids begin, by its number; one more at the end

    def _whole(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def learn(self, missing: list[str]) -> np.ndarray:
        """The numbers of new units, which are remembered too."""
        ids: list[int] = []
        sizes: list[int] = []
        order: list[int] = []
        whole: list[int] = []
        tokenize, plain = self.model.tokenize, self.plain
        for k, unit in enumerate(missing):
            if unit.isascii():
                direct = plain and unit.isalpha() and unit.islower()
                text = unit
            else:
                direct = plain.issuperset(unit)
                text = unit.translate(self.mapped) if direct else unit
            if direct:
                own = [t.id for t in tokenize(text)]
                ids += own
                sizes.append(len(own))
                order.append(k)
            else:
                whole.append(k)
        for own in self._whole([missing[k] for k in whole]):
            ids += own
            sizes.append(len(own))
        order += whole
        first, place = self.n_units, self.n_known
        self.n_units, self.n_known = first + len(missing), place + len(ids)
        self.known, self.begin = _room(self.known, self.n_known), _room(self.begin, self.n_units + 1)
        self.known[place : self.n_known] = ids
        self.begin[first + 1 : self.n_units + 1] = place + np.cumsum(sizes)
        numbers = np.empty(len(missing), np.int64)
        numbers[order] = np.arange(first, self.n_units)
        new = zip(missing, numbers.tolist(), strict=True)
        if max(map(len, missing), default=0) <= self.LONG:
            self.units.update(new)
        else:
            self.units.update((u, x) for u, x in new if len(u) <= self.LONG)
        return numbers

    def _cut(self, raw: bytes, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The units of texts that begin at ``starts`` in ``raw``, and where in ``raw`` each begins."""
        data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(bytearray(raw).translate(self.kinds), np.uint8)
        lead = np.flatnonzero(data[:-1] == 0xC3)  # of U+00C0 to U+00FF, of which two are no letters
        second = data[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kind[lead] = kind[lead + 1] = self.LETTER
        for head in self.heads:
            kind[np.flatnonzero((data[:-1] == head[0]) & (data[1:] == head[1]))] = self.OTHER
        new = np.empty(len(data), bool)
        new[0] = True
        odd = np.flatnonzero(kind == self.OTHER)
        if len(odd):  # their words become one unit each
            space = kind == self.SPACE
            new[1:] = space[1:] != space[:-1]
            new[starts] = True
            edges = np.append(np.flatnonzero(new), len(data))
            words = np.unique(np.searchsorted(edges, odd, side="right"))
            begin, size = edges[words - 1], edges[words] - edges[words - 1]
            kind[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())] = self.OTHER
        low = np.frombuffer(bytearray(raw).translate(LOWER), np.uint8)
        capital = lead[second < 0x9F] + 1
        low[capital] += 0x20
        if len(odd):
            np.copyto(low, data, where=kind == self.OTHER)
        new[1:] = kind[1:] != kind[:-1]
        new[starts] = True
        new |= kind == self.DIGIT
        keep = kind != self.SPACE
        offsets = np.flatnonzero(new[keep])
        packed = low[keep]
        new &= keep
        offsets = np.append(offsets, len(packed)).astype(np.int32)
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(packed)), np.flatnonzero(new)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        texts = texts.fill_null("") if texts.null_count else texts
        bounds = np.frombuffer(texts.buffers()[1] or b"", np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or bounds[0] == bounds[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = texts.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes()
        bounds -= bounds[0]
        units, places = self._cut(raw, bounds[bounds < len(raw)])
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.n_units > self.most or self.n_known > 8 * self.most:
            self._forget()
        lookup = self.units.get
        number = np.fromiter(map(lookup, distinct, repeat(-1)), np.int64, len(distinct))
        holes = np.flatnonzero(number < 0)
        if len(holes):
            number[holes] = self.learn([distinct[k] for k in holes.tolist()])
        begin = self.begin.take(number)
        sizes = self.begin.take(number + 1) - begin
        unit = coded.indices.to_numpy(zero_copy_only=False)
        sizes = sizes.take(unit)
        ends = np.cumsum(sizes)
        at = np.repeat(begin.take(unit) - ends + sizes, sizes)
        at += np.arange(len(at))
        edges = np.concatenate(([0], ends))[np.searchsorted(places, bounds)]
        return self.known.take(at), np.diff(edges)


ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` in an array of at least ``size``."""
    if size <= len(values):
        return values
    out = np.zeros(max(size, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


def _encoder(path: str) -> WordEncoder:
    return hold(("words", path), lambda: WordEncoder(path))


BLOCK_SCHEMA = "part int, block int, part_start bigint, n_ids bigint, n_docs bigint, payload binary"


def _block_writer(path: str, end_id: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(path)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held, docs, lengths, count = [], [], [], 0

        def pack():
            nonlocal block, start, count
            ids = np.concatenate(held)
            payload = encode_block(ids, docs, lengths, encoder.size)
            values = ((part, pa.int32()), (block, pa.int32()), (start, pa.int64()), (len(ids), pa.int64()), (len(docs), pa.int64()), (payload, pa.binary()))
            block, start, count = block + 1, start + len(ids), 0
            held.clear(), docs.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in values], ["part", "block", "part_start", "n_ids", "n_docs", "payload"])

        def hold(ids, own_docs, own_lengths):
            nonlocal count
            held.append(ids)
            docs.extend(own_docs)
            lengths.extend(own_lengths)
            count += len(ids)

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                piece = batch.slice(k, 1024)
                ids, counts = encoder.encode(piece.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                ends = np.cumsum(counts + 1)
                own_docs, own_lengths = piece.column(0).to_pylist(), (counts + 1).tolist()
                doc = place = 0
                while doc < len(ends):  # a block ends with the document that fills it
                    last = min(int(np.searchsorted(ends, place + block_ids - count)), len(ends) - 1)
                    hold(ids[place : ends[last]], own_docs[doc : last + 1], own_lengths[doc : last + 1])
                    doc, place = last + 1, int(ends[last])
                    if count >= block_ids:
                        yield pack()
        if docs:
            yield pack()

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` in ascending id order and write block files to ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    arrow_map(ordered, ["doc_id", "text"], _block_writer(tokenizer_path, end_id, block_ids), BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for part, start, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids, docs, lengths = decode_block(payload)
            ends = np.cumsum(lengths)
            raw = ids.astype("<u4").tobytes()
            crcs = [zlib.crc32(memoryview(raw)[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"],
            )


def read_token_index(spark, path: str) -> DataFrame:
    """Decode every block of ``path``: per document its place, length and the CRC-32 of its ids.

    The place needs the sizes of the parts before; that is one sum per written
    part, whose number is the writer's number of tasks whatever the input.
    """
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["part"], total))
        total += row["n"]
    base = spark.createDataFrame(offsets, "part int, before bigint")
    rows = files.select("part", "part_start", "payload").mapInArrow(_read_blocks, "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_file_query(spark, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path)
    return read_token_index(spark, path)
