"""Near-duplicate join on word shingles by parity sketches.

A document is the set of its distinct 5-word shingles, each a 64-bit hash.  Two
documents link when their Jaccard similarity is 0.8 or more, which bounds the
symmetric difference of sets of ``a`` and ``b`` shingles by ``(a + b) / 9``.

Sketch.  Every shingle flips one bit of a sketch, so the sketch is the parity of
the shingles at each place, equal shingles of two documents cancel in the XOR of
their sketches, and the number of differing bits (and of differing words of
bits) is at most the symmetric difference.  Sketches of three widths are used.  A short one
of 1,024 bits goes along with each document and rules pairs out by its Hamming
distance; a wider one (more bits than shingles) does so more sharply before texts are
read.  A long one finds the pairs: its words are so wide (2**64 places) that
only the set bits are kept, folded to one 64-bit key by XOR.

Pigeonhole.  Documents are put in size bands, each with a bound ``T`` for the
symmetric difference; the long sketch has ``T + 1 + slack`` words there, so linked
documents agree in ``slack + 1`` words at least.  A document with more than
``slack`` empty words also gives its empty ones; otherwise the agreement
shows in a word that is not empty.  Documents near the top of a band also sign
for the next band, so linked documents of any sizes meet in one.

Counting.  ``spare`` of a document is how many agreements it may lose and still
have one: ``slack`` less its empty words.  Keys that no other class has count for nothing, so a
document with no more than ``spare`` shared keys has no link and goes.  Of the
others each drops its ``spare`` keys of the largest groups, by one order of all keys:
the rarest key in which a linked pair agrees is dropped by neither.  That
takes keys of passages that many documents share, whatever the group's size is.  Groups
with the same members are one group.

Pairs.  Documents with the same set are one class, and only classes are
joined.  Of each group the first member is paired with the others (as many pairs as
members).  Pairs that pass the size and Hamming bounds are verified on the words
of both whole texts, and components are found on the links.  What a group may
still miss are links between its components: the members outside its largest
component meet those of other components, and of these meetings only pairs that pass the bounds
leave the join.  Members of one component never meet again, so a group of
near copies, which its first member links, costs as many rows as members.

Crowds.  A group with more than ``CROWD`` members outside its largest component, such as the documents
with one page template, would make as many meetings as its square.  Its members need a second witness
first: of a linked pair's shingles, put in one order from rare to frequent, each end has a common one among
the first ``n - ceil(0.8 n) + 1`` (counts are over all members of crowds).  Only members that share one of
these meet, so what a template brings to all of them makes no pair.

No group is collected into one task: groups are read as sorted streams, and
meetings and verification deal hot groups over salts.

Defined cases: null, empty and blank texts have no shingles and stay alone; with
fewer than five words the whole sequence is one shingle; repeated rows and
equal sets are one class; a null doc_id is never the name of a component unless
all are null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, first_of_repeats, release, sized_broadcast, staged, text_or_empty, without
from .components import components

WORDS = 5
SHORT_WORDS = 16  # 64-bit words of the short sketch
SHORT = [f"s{k}" for k in range(SHORT_WORDS)]
COUNTED = 32  # group sizes above this are one size in the order of keys
SALT_ROWS = 1024  # members of a group outside its largest component to a salt
SPLIT_ROWS = 16384  # members of a group to a part
CROWD = 256  # members of a group outside its largest component that meet all others
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ x >> U64(30)) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U64(27)) * U64(0x94D049BB133111EB)
    return x ^ x >> U64(31)


def shingle_set(text: str | None, seed: int = 0) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, n)
    width = min(n, WORDS)
    total = np.full(n - width + 1, (seed * 0x9E3779B97F4A7C15 + width) & 0xFFFFFFFFFFFFFFFF, U64)
    for k in range(width):
        total = (total ^ hashes[k : n - width + 1 + k]) * U64(0x9FB21C651E98DF25)
        total ^= total >> U64(29)
    return np.unique(_mix(total))


@lru_cache(maxsize=1)
def _bands() -> tuple[list[int], list[int]]:
    """Largest size of each band and its bound on the symmetric difference; sizes up to 4 must be equal."""
    tops, size = [], 4
    while size < 1 << 40:
        size = max(size + 1, int(size * 1.25))
        tops.append(size)
    return tops, [2 * t // 9 for t in tops]


@lru_cache(maxsize=4096)
def _layout(band: int) -> tuple[int, int]:
    """Words of the long sketch in a band, and how many of them may be empty."""
    tops, bounds = _bands()
    below = tops[band - 1] if band else 4
    smallest = max(1, math.floor(0.8 * (below + 1)))
    slack = 0
    while True:
        words = bounds[band] + 1 + slack
        load = smallest / words
        empty = words * math.exp(-load)
        spread = math.sqrt(empty * (1 - (1 + load) * math.exp(-load)))  # of the number of empty words
        if empty + 4 * spread + 0.5 <= slack or slack > 4 * bounds[band] + 8:
            return words, slack
        slack += 1


def _band(size: int) -> int:
    return int(np.searchsorted(_bands()[0], size))


def _signed_bands(n: int) -> list[int]:
    own, upper = _band(n), _band(n * 5 // 4)
    return ([own] if n > 4 else []) + ([upper] if n >= 4 and (upper != own or n == 4) else [])


def _places(shingles: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the long sketch that hold shingles, and where their shingles start (both ascend)."""
    place = ((shingles >> U64(32)) * U64(words) >> U64(32)).astype(np.int64)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    return place[starts], starts


def budget(shingles: np.ndarray) -> int:
    """Agreements that a document can spare in every band; below zero where empty words are signed too."""
    spare = []
    for band in _signed_bands(len(shingles)):
        words, slack = _layout(band)
        spare.append(slack - (words - len(_places(shingles, words)[0])))
    return min(spare, default=0)


def long_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the words of the long sketch, in all bands that the document signs for."""
    out = []
    hashes = _mix(shingles ^ U64(0x5851F42D4C957F2D))
    for band in _signed_bands(len(shingles)):
        words, slack = _layout(band)
        content = np.zeros(words, U64)
        at, starts = _places(shingles, words)
        content[at] = np.bitwise_xor.reduceat(hashes, starts)
        keys = _mix(content + _mix(np.arange(words, dtype=U64) + U64(band << 40)))
        out.append(keys[at] if words - len(at) <= slack else keys)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _node(shingles: np.ndarray) -> int:
    """128-bit digest of a set; its low 64 bits, as a signed long, name the class."""
    return xxhash.xxh3_128_intdigest(shingles.tobytes())


def _name(shingles: np.ndarray) -> int:
    low = _node(shingles) & 0xFFFFFFFFFFFFFFFF
    return low - (1 << 64) if low >> 63 else low


def short_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits as longs."""
    place = (shingles & U64(64 * SHORT_WORDS - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * SHORT_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def wide_sketch(shingles: np.ndarray) -> bytes:
    """Parity bits, one and a half to three times as many as shingles, as bytes."""
    bits = 1 << max(6, int(1.5 * len(shingles)).bit_length())
    odd = (np.bincount((shingles & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Differing bits; the longer sketch is folded by XOR, which keeps parities."""
    if len(a) < len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = x >> bits ^ x & (1 << bits) - 1
    return (x ^ y).bit_count()


def _near_enough(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _apart(a, b) * (100 + percent) <= (100 - percent) * (m + n)
                for m, n, a, b in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _describe(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows, spare, wide = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, seed)
                digest = _node(own)
                rows.append((len(own), digest & 0xFFFFFFFFFFFFFFFF, digest >> 64, *short_sketch(own).view(np.uint64).tolist()))
                spare.append(budget(own))
                wide.append(wide_sketch(own))
            table = np.array(rows, np.uint64).reshape(-1, 3 + SHORT_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(table[:, k]).view(np.int64)) for k in range(table.shape[1])), pa.array(spare, pa.int64()), pa.array(wide, pa.binary()), batch.column(2)],
                ["doc_id", "n", "node", "check", *SHORT, "spare", "wide", "same"],
            )

    return run


def _shingles(seed: int):
    """Each shingle of a class's text with the class's size; another text under the same doc_id is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingle_set(text, seed)
                if _name(own) == name:
                    full = lambda x, n=len(own): pa.array(np.full(n, x, np.int64))
                    yield pa.RecordBatch.from_arrays([full(name), pa.array(own.view(np.int64)), full(len(own))], ["node", "key", "n"])

    return run


def _sign(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        done: set[int] = set()  # classes this task has signed for, to spare copies
        for batch in batches:
            nodes, counts, keys = [], [], []
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, seed)
                node = _node(own) & 0xFFFFFFFFFFFFFFFF
                if node in done:
                    continue
                if len(done) < 200_000:
                    done.add(node)
                signed = long_keys(own)
                if len(signed):
                    nodes.append(node)
                    counts.append(len(signed))
                    keys.append(signed)
            for k in range(0, len(nodes), 512):
                column = np.repeat(np.array(nodes[k : k + 512], np.uint64).view(np.int64), counts[k : k + 512])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys[k : k + 512])), pa.array(column)], ["key", "node"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and node: those of keys with two nodes or more, with the group's size
    (``COUNTED + 1`` for all larger ones).

    Holds one batch and up to ``COUNTED`` rows before it, however large a group is.
    """
    held = np.zeros((2, 0), np.int64)
    going = None  # key and last node of a large group that is still being read
    for batch in chain(batches, [None]):
        new = held if batch is None else np.concatenate([held, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])], axis=1)
        held = new[:, :0]
        out = []
        if going is not None:
            more = int(np.searchsorted(new[0] != going[0], True))
            nodes = new[1, :more]
            nodes = nodes[np.diff(nodes, prepend=going[1]) != 0]
            out.append((np.full(len(nodes), going[0]), nodes, np.full(len(nodes), COUNTED + 1)))
            going = (going[0], int(nodes[-1]) if len(nodes) else going[1]) if more == new.shape[1] else None
            new = new[:, more:]
        if new.shape[1]:
            change = np.any(new[:, 1:] != new[:, :-1], axis=0)
            new = new[:, np.concatenate(([True], change))]  # repeated rows go
            starts = np.concatenate(([0], np.flatnonzero(new[0, 1:] != new[0, :-1]) + 1))
            sizes = np.diff(np.append(starts, new.shape[1]))
            if batch is not None:
                last = starts[-1]
                if sizes[-1] > COUNTED:
                    going = (int(new[0, -1]), int(new[1, -1]))
                else:
                    held, new, starts, sizes = new[:, last:], new[:, :last], starts[:-1], sizes[:-1]
            size = np.repeat(sizes, sizes)
            wanted = np.flatnonzero(size > 1)
            out.append((new[0, wanted], new[1, wanted], np.minimum(size[wanted], COUNTED + 1)))
        if out and sum(len(o[0]) for o in out):
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "node", "size"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(seed: int, percent: int):
    """From rows sorted by group, each group the pivot's text and then the others': the links.

    A text that isn't its class's (another row with the same doc_id) is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in batches:
            u, v = [], []
            for name, member, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                shingles = shingle_set(text, seed)
                if member is None:
                    if _name(shingles) == name:
                        pivot, own = name, shingles
                elif name == pivot and _name(shingles) == member and _similar(own, shingles, percent):
                    u.append(name)
                    v.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


class ParityJoin:
    """The join over ``doc_id`` and ``text`` of a DataFrame that can be read more than once."""

    def __init__(self, docs: DataFrame, percent: int = 80, seed: int = 0):
        if percent < 80:
            raise ValueError("the bands' bounds hold for 80 % and more")
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), F.xxhash64("text").alias("same"))
        self.percent, self.seed = percent, seed
        while True:
            columns = "doc_id bigint, n bigint, node bigint, check bigint, " + ", ".join(f"{s} bigint" for s in SHORT) + ", spare bigint, wide binary, same bigint"
            self.info = staged(arrow_map(self.rows, ["doc_id", "text", "same"], _describe(self.seed), columns), "near-info")
            first = {c: F.first(c).alias(c) for c in ("n", *SHORT, "spare", "wide")}  # the same in all rows of a class
            self.classes = staged(
                self.info.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("min_doc"), F.min("check").alias("low"), F.max("check").alias("high"), *first.values()),
                "near-classes",
            )
            if self.classes.filter("low <> high").isEmpty():
                break
            self.seed += 1  # two different sets met in 64 bits: hash anew

    def _pairs(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs ``u, v`` that the size and Hamming bounds leave."""
        ordered = staged(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "near-candidates")
        ends = staged(ordered.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-ends")
        side = staged(self.classes.select("node", "n", "wide", *SHORT).join(sized_broadcast(ends), "node", "left_semi"), "near-sides")
        a = sized_broadcast(side.select(*(F.col(c).alias(f"u_{c}") for c in side.columns)))
        b = sized_broadcast(side.select(*(F.col(c).alias(f"v_{c}") for c in side.columns)))
        joined = ordered.join(a, F.col("u") == F.col("u_node")).join(b, F.col("v") == F.col("v_node")).filter(self._bounds("u_", "v_"))
        return arrow_map(joined, ["u", "v", "u_n", "v_n", "u_wide", "v_wide"], _near_enough(self.percent), "u bigint, v bigint")

    def _bounds(self, u: str, v: str):
        """The size bound and the short sketch's Hamming bound between two prefixed sides."""
        p = self.percent
        apart = sum((F.bit_count(F.col(f"{u}{s}").bitwiseXOR(F.col(f"{v}{s}"))) for s in SHORT), F.lit(0))
        size = 100 * F.least(f"{u}n", f"{v}n") >= p * F.greatest(f"{u}n", f"{v}n")
        return size & (apart * (100 + p) <= (100 - p) * (F.col(f"{u}n") + F.col(f"{v}n")))

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """``node, text`` of one document of each class in ``nodes``."""
        wanted = staged(self.classes.select("node", "min_doc").join(sized_broadcast(nodes), "node").select("node", F.col("min_doc").alias("wanted_doc")), "near-wanted")
        found = self.rows.join(sized_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("wanted_doc")))
        return found.select("node", "text")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Verified links among candidate pairs."""
        left = staged(self._pairs(pairs), "near-pairs")
        # the end with more pairs is the pivot: its text goes along once
        degree = left.select(F.col("u").alias("node")).unionAll(left.select(F.col("v").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        degree = staged(degree, "near-degree")
        du, dv = (sized_broadcast(degree.select(F.col("node").alias(x), F.col("degree").alias(f"d{x}"))) for x in "uv")
        turned = left.join(du, "u").join(dv, "v").select(
            F.when(F.col("du") >= F.col("dv"), F.col("u")).otherwise(F.col("v")).alias("pivot"),
            F.when(F.col("du") >= F.col("dv"), F.col("v")).otherwise(F.col("u")).alias("member"),
        ).withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(64)).cast("int"))
        turned = staged(turned, "near-turned")
        texts = staged(self._texts(degree.select("node")), "near-texts", codec="zstd")
        starts = staged(turned.select("pivot", "salt").distinct(), "near-starts")
        members = texts.withColumnRenamed("node", "member").join(sized_broadcast(turned), "member").select("pivot", "salt", "member", "text")
        pivots = texts.withColumnRenamed("node", "pivot").join(sized_broadcast(starts), "pivot")
        pivots = pivots.select("pivot", "salt", F.lit(None).cast("long").alias("member"), "text")
        dealt = members.unionAll(pivots).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("member").asc_nulls_first())
        return staged(arrow_map(dealt, ["pivot", "salt", "member", "text"], _verify(self.seed, self.percent), "u bigint, v bigint"), "near-links")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """All links between classes needed for the components, and ``node, label``."""
        signed = arrow_map(self.rows, ["text"], _sign(self.seed), "key bigint, node bigint")
        dealt = signed.repartition("key").sortWithinPartitions("key", "node")
        found = staged(arrow_map(dealt, ["key", "node"], _groups, "key bigint, node bigint, size bigint"), "near-groups")
        groups = staged(self._witnesses(found), "near-witnesses")
        tested = staged(groups.filter("node <> pivot").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct(), "near-tested")
        links = self.links(tested)
        labels = components(links)
        fresh = staged(self._meetings(groups, labels).join(tested, ["u", "v"], "left_anti"), "near-fresh")
        if not fresh.isEmpty():
            more = self.links(fresh)
            if not more.isEmpty():
                links = links.unionAll(more)
                labels = components(links)
        return links, labels

    def _witnesses(self, found: DataFrame) -> DataFrame:
        """``key, node, pivot``: the keys that each class can't spare, in groups of different members; the pivot is a group's first."""
        spare = self.classes.select("node", F.greatest("spare", F.lit(0)).alias("spare"))
        largest_first = Window.partitionBy("node").orderBy(F.col("size").desc(), "key")
        needed = found.withColumn("place", F.row_number().over(largest_first)).join(spare, "node").filter("place > spare")
        needed = staged(needed.select("key", "node"), "near-needed")
        members = [F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
        shared = needed.groupBy("key").agg(*members).filter("members > 1")
        one = shared.groupBy("members", "pivot", "x", "y").agg(F.min("key").alias("key")).select("key", "pivot")
        return needed.join(sized_broadcast(staged(one, "near-keys")), "key").select("key", "node", "pivot")

    def _meetings(self, groups: DataFrame, labels: DataFrame) -> DataFrame:
        """Distinct pairs ``u, v`` from different components that pass the bounds: of small groups all, of crowds those with a second witness."""
        labelled = staged(groups.join(sized_broadcast(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "near-named")
        state = self._open(labelled)
        met = self._met(labelled, state.filter(F.col("outside") <= CROWD))
        crowds = state.filter(F.col("outside") > CROWD)
        if crowds.isEmpty():
            return met
        inside = labelled.join(sized_broadcast(crowds), "key").groupBy("node").agg(F.first("label").alias("label"))
        members = staged(inside, "near-crowd")
        rare = staged(self._rare(members.select("node")).join(sized_broadcast(members), "node").select("key", "node", "label"), "near-rare")
        return met.unionAll(self._met(rare, self._open(rare))).distinct()

    def _open(self, labelled: DataFrame) -> DataFrame:
        """The groups with several components: their largest one, and how many members they have in all and outside of it."""
        parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        state = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("major"))
        # with one component nothing is missing
        return staged(state.filter("parts > 1").select("key", "major", "members", (F.col("members") - F.col("most")).alias("outside")), "near-state")

    def _met(self, labelled: DataFrame, state: DataFrame) -> DataFrame:
        """Members outside the largest component meet those of other components; both sides of large groups are dealt over salts."""
        many = lambda c, most: F.ceil(F.col(c) / most).cast("int")
        dealt = state.select("key", "major", many("outside", SALT_ROWS).alias("salts"), many("members", SPLIT_ROWS).alias("splits"))
        inside = staged(labelled.join(sized_broadcast(dealt), "key"), "near-open")
        ends = staged(inside.select("node").distinct(), "near-ends")
        sketches = staged(self.classes.select("node", "n", *SHORT).join(sized_broadcast(ends), "node", "left_semi"), "near-sketches")
        side = inside.join(sized_broadcast(sketches), "node")
        own = ["node", "label", "n", *SHORT]
        hashed = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        u = side.filter("label <> major").select("key", hashed("salts").alias("salt"), every("splits").alias("split"), *(F.col(c).alias(f"u_{c}") for c in own))
        v = side.select("key", "major", every("salts").alias("salt"), hashed("splits").alias("split"), *(F.col(c).alias(f"v_{c}") for c in own))
        # two members outside the largest component would meet twice
        once = (F.col("v_label") == F.col("major")) | (F.col("u_node") < F.col("v_node"))
        met = u.join(v, ["key", "salt", "split"]).filter((F.col("u_label") != F.col("v_label")) & once & self._bounds("u_", "v_"))
        return met.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()

    def _rare(self, nodes: DataFrame) -> DataFrame:
        """``key, node``: the shared ones among the first shingles of each node, from rare to frequent in all of them, which a linked pair has in common.

        A shingle of one node only takes its place in that order, but makes no row.
        """
        texts = self._texts(nodes)
        all_rows = staged(arrow_map(texts, ["node", "text"], _shingles(self.seed), "node bigint, key bigint, n bigint").distinct(), "near-shingles")
        frequent = staged(all_rows.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "near-often")
        rows = all_rows.join(sized_broadcast(frequent), "key")
        shared = Window.partitionBy("node")  # a text's shingles at most
        needed = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1
        ranked = rows.withColumns({"place": F.row_number().over(shared.orderBy("often", "key")), "held": F.count(F.lit(1)).over(shared)})
        return ranked.filter(F.col("place") <= needed - (F.col("n") - F.col("held"))).select("key", "node")

    def _named(self) -> DataFrame:
        """``node, min_doc, label``: every class and its component."""
        _, labels = self.run()
        named = self.classes.select("node", "min_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return staged(named, "near-named")

    def membership(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` of every document."""
        named = self._named()
        least = named.groupBy("label").agg(F.min("min_doc").alias("component_id"))
        by_class = named.join(least, "label").select("node", "component_id")
        linked = self.info.filter("n > 0").join(by_class, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        alone = self.info.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return linked.unionAll(alone)

    def heads(self) -> DataFrame:
        """``doc_id, same, n, first``: the different rows with shingles, by doc_id and text hash, how often
        each comes, and whether it is its component's first (smallest doc_id, nulls last, then class and text hash).
        """
        rows = staged(self.info.filter("n > 0").groupBy("doc_id", "same", "node").agg(F.count(F.lit(1)).alias("n")), "near-counted")
        place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("class"), F.col("same").alias("hash"))
        own = rows.groupBy("node").agg(F.min(place).alias("own"))
        classes = staged(self._named().select("node", "label").join(own, "node"), "near-owners")
        heads = classes.groupBy("label").agg(F.min("own").alias("head"))
        by_class = classes.join(heads, "label").select("node", "head")
        is_head = (F.col("node") == F.col("head.class")) & (F.col("same") == F.col("head.hash")) & F.col("doc_id").eqNullSafe(F.col("head.id"))
        return rows.join(by_class, "node").select("doc_id", "same", "n", is_head.alias("first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, of each group of linked ones only that with the smallest doc_id.

    A row is known by its doc_id and text, so another text under the same doc_id stands for
    itself; a null doc_id comes after all others, and of a group without any other one row stays.
    """
    heads = staged(ParityJoin(docs).heads(), "near-heads")
    key = {"doc_id": F.col("doc_id").cast("long"), "same": F.xxhash64("text")}
    left = without(docs, heads.filter("NOT first"), key)
    return first_of_repeats(left, key, heads.filter("first AND n > 1"))


def near_query(docs: DataFrame) -> DataFrame:
    return ParityJoin(docs).membership()


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 80 * (x.n + y.n - m)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.root),
k AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
