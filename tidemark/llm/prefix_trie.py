"""The trie of conversation prefixes, with count-min screening of prefix digests.

A node is a distinct sequence of first turns (role and text); its members are the conversations
that begin with it.  A prefix is known by 128 bits: the XOR of a hash of every turn and its place, so digests of
all prefixes come from one running XOR (``running``), also where one conversation
has very many turns.

Screening.  Each task counts its prefix digests in a count-min sketch whose cells stop
at two; the sketches are added up and sent to all tasks (``CELLS`` cells a row at most).  A sketch
never counts too little, so an estimate of one proves that a prefix has one member, and so has everything after
it.  Nodes of such tails are finished where they lie.  Only prefixes with a larger estimate are
shuffled and grouped exactly, among them the few that a full cell has made look shared.
The decisions about a prefix and about the one before it are made from digests alone, so
they agree in every task.

Sums over subtrees come from members, not from pairs of nodes: a node is counted for its smallest member, so
the leaves and the spared bytes below a node are the sums, over its members, of what each
counts for from this depth on, which is one running sum along each conversation.

Nodes that very many conversations share are aggregated before the shuffle.  The ids that end
at a node are joined to strings of bounded length by ranges and then hashed in order as a stream, as
SHA-256 has no parts that could be combined.

Defined cases: null roles and texts are empty, null turns come first, turns that tie are ordered by
a hash of role and text; rows with a null conv_id belong to no conversation and are left out; repeated rows are turns of their own;
a conversation without turns is a member of the root only; texts of any length count whole; extra columns are
ignored, whatever their names; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import running

from .common import arrow_map, release, staged

CELLS = 1 << 25  # of a row of the sketch at most
ROWS = 3
BLOCK = 1 << 12  # cells that are sent together
IDS = 4096  # to a string
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), the turn's digest ``d1, d2`` and the UTF-8 ``bytes`` of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.xxhash64(role, text).alias("d1"),
        F.xxhash64(F.lit("turn"), text, role).alias("d2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")], "trie-turns")
    return placed.select("conv_id", (F.col("run_place") - 1).alias("pos"), "d1", "d2", "bytes")


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c with its first h turns replaced by those of conversation c - c % 5; h is a checksum of c.

    Returns the turns (with the ``length`` of their conversation) and ``conv_id, length`` of all conversations.
    """
    c = F.col("conv_id")
    sizes = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    heads = F.crc32(c.cast("string").cast("binary")) % 9
    convs = sizes.select("conv_id", "n", heads.alias("h"), (c - c % 5).alias("base"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(base, "base", "left").withColumn("taken", taken)
    convs = staged(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    first = turns.filter((c % 5 == 0) & (F.col("pos") < 9)).withColumnRenamed("conv_id", "base")
    front = first.join(convs.select("base", "conv_id", "taken", "length"), "base").filter("pos < taken")
    rest = turns.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").filter("pos >= h")
    rest = rest.withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    names = ["conv_id", "pos", "d1", "d2", "bytes", "length"]
    return front.select(names).unionAll(rest.select(names)), convs.select("conv_id", "length")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with the ``length`` of their conversation, and ``conv_id, length``."""
    convs = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), "trie-convs")
    return turns.join(convs, "conv_id"), convs


def _cells(k1: np.ndarray, k2: np.ndarray, width: int) -> list[np.ndarray]:
    shift = np.uint64(64 - width.bit_length() + 1)
    k1, k2 = k1.view(np.uint64), k2.view(np.uint64)
    return [((k1 ^ k2 >> np.uint64(7 * r + 3)) * np.uint64(FACTORS[r]) + k2 * np.uint64(FACTORS[-r])) >> shift for r in range(ROWS)]


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cells = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
            for r, at in enumerate(_cells(k1, k2, width)):
                own, n = np.unique(at.astype(np.int64) + r * width, return_counts=True)
                cells[own] = np.minimum(cells[own] + np.minimum(n, 2), 2)
        blocks = cells.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for k in range(0, len(used), 256):
            some = used[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[b].tobytes() for b in some], pa.binary())], ["block", "cells"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by block: each block once."""
    going, total = None, None
    for batch in batches:
        done = []
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(cells, np.uint8)
            if block == going:
                total = np.minimum(total + own, 2)
            else:
                if going is not None:
                    done.append((going, total.tobytes()))
                going, total = block, own
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int64()), pa.array([c for _, c in done], pa.binary())], ["block", "cells"])
    if going is not None:
        yield pa.RecordBatch.from_arrays([pa.array([going], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "cells"])


def sketch(prefixes: DataFrame, rows: int, most: int = CELLS) -> np.ndarray:
    """Count-min sketch of ``k1, k2``: ``ROWS`` rows of 4 to 8 cells a prefix, at most ``most``, that count to two.

    With more prefixes than that allows more of them look shared and go the exact way.
    """
    width = min(most, 1 << max(12, (4 * rows - 1).bit_length()))
    parts = arrow_map(prefixes, ["k1", "k2"], _count(width), "block bigint, cells binary")
    summed = arrow_map(parts.repartition("block").sortWithinPartitions("block"), ["block", "cells"], _add_up, "block bigint, cells binary")
    cells = np.zeros(ROWS * width, np.uint8)
    for row in summed.collect():  # ROWS * most bytes at most
        cells[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["cells"], np.uint8)
    return cells.reshape(ROWS, width)


def screened(prefixes: DataFrame, cells: np.ndarray) -> DataFrame:
    """``prefixes`` with ``alone`` (proved to have one member) and ``above`` (so has the prefix before it)."""
    names, shared = prefixes.columns, prefixes.sparkSession.sparkContext.broadcast(cells)
    place = {c: names.index(c) for c in ("k1", "k2", "x1", "x2", "depth")}

    def proved(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        table = shared.value
        return np.minimum.reduce([table[r][at] for r, at in enumerate(_cells(k1, k2, table.shape[1]))]) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            k1, k2, x1, x2, depth = (batch.column(place[c]).to_numpy() for c in place)
            alone, above = proved(k1, k2), proved(k1 ^ x1, k2 ^ x2) & (depth > 1)  # the root is every conversation's
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(above)], [*names, "alone", "above"])

    fields = ", ".join(f"{c} {kind}" for c, kind in prefixes.dtypes)
    return arrow_map(prefixes, names, run, f"{fields}, alone boolean, above boolean")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by node and conv_id: the ids as comma-joined strings of at most ``IDS``."""
    for batch in batches:
        node, depth, ids = (batch.column(k).to_numpy() for k in range(3))
        if not len(ids):
            continue
        cut = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
        starts = np.unique(np.concatenate(([0], cut, np.arange(0, len(ids), IDS))))
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(node[starts]), pa.array(depth[starts]), pa.array(ids[starts]), pa.array(text, pa.string())], ["node", "depth", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings sorted by node and first id: the SHA-256 of each node's ids, as a stream."""
    going, digest = None, None
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for node, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (node, depth) == going:
                digest.update(b",")
            else:
                if going is not None:
                    done.append((*going, digest.hexdigest()))
                going, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t.type) for k, t in enumerate(schema)], schema=schema)
    if going is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*going, digest.hexdigest()), schema, strict=True)], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256`` of ``node, depth, conv_id``: SHA-256 of the ascending, comma-joined ids."""
    by = ["node", "depth", "conv_id"]
    strings = arrow_map(ends.repartitionByRange(*by).sortWithinPartitions(*by), by, _strings, "node bigint, depth bigint, first bigint, ids string")
    dealt = strings.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return arrow_map(dealt, ["node", "depth", "first", "ids"], _hashes, "node bigint, depth bigint, ends_sha256 string")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prefix_trie(turns: DataFrame, convs: DataFrame, most_cells: int = CELLS) -> DataFrame:
    """One row a node, by its smallest member: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, pos, d1, d2, bytes, length``; ``convs`` has ``conv_id, length`` and may be read more than once.
    """
    hashed = turns.select("conv_id", "pos", F.xxhash64("pos", "d1", "d2").alias("x1"), F.xxhash64(F.lit("prefix"), "d2", "d1", "pos").alias("x2"), "bytes", "length")
    prefixes = running(hashed, "conv_id", [F.col("pos")], "trie-prefixes", {"x1": "xor", "x2": "xor"})
    prefixes = prefixes.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("run_x1").alias("k1"), F.col("run_x2").alias("k2"), "x1", "x2", "bytes", "length")
    cells = sketch(prefixes, prefixes.count(), most_cells)
    rows = staged(screened(prefixes, cells), "trie-screened")
    ended = F.col("depth") == F.col("length")
    tail = rows.filter("alone").select(
        "conv_id", "depth", "above", (F.col("k1").bitwiseXOR(F.col("x1"))).alias("up1"), (F.col("k2").bitwiseXOR(F.col("x2"))).alias("up2"),
        F.lit(1).cast("long").alias("n_convs"), (~ended).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        _sha(F.when(ended, F.col("conv_id").cast("string")).otherwise("")).alias("ends_sha256"),
    )
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tails = tail.filter("above").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *measures)
    heads = tail.filter("NOT above")  # the first of a tail: who its parent is shows in the exact part

    # possibly shared prefixes and the root, grouped exactly
    root = convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2", "x1", "x2", "bytes")), "length", F.lit(False).alias("above"))
    shared = rows.filter("NOT alone").drop("alone").unionByName(root)
    key = ["depth", "k1", "k2"]
    same = [F.first(c).alias(c) for c in ("x1", "x2", "above", "bytes")]  # the same in all members, but for those of proved parents, which have one
    nodes = staged(shared.groupBy(*key).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), *same), "trie-nodes")
    up = [(F.col("depth") - 1).alias("up_depth"), F.col("k1").bitwiseXOR(F.col("x1")).alias("up1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("up2")]
    inner = nodes.filter("depth > 0").select("node", "depth", "above", *up)
    links = inner.filter("NOT above").select("up_depth", "up1", "up2").unionAll(heads.select((F.col("depth") - 1).alias("up_depth"), "up1", "up2"))
    counts = links.groupBy("up_depth", "up1", "up2").agg(F.count(F.lit(1)).alias("children"))
    met = [F.col("depth") == F.col("up_depth"), F.col("k1") == F.col("up1"), F.col("k2") == F.col("up2")]
    nodes = nodes.join(counts, met, "left").select(*key, "node", "n_convs", F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), "bytes")
    nodes = staged(nodes, "trie-counted")

    # parents: the root is one row, deeper ones are looked up
    top = nodes.filter("depth = 0").select(F.col("node").alias("top"))
    parents = nodes.filter("depth > 0").select(F.col("depth").alias("p_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"))
    of = [F.col("up_depth") == F.col("p_depth"), F.col("up1") == F.col("p1"), F.col("up2") == F.col("p2")]
    own_heads = heads.withColumn("up_depth", F.col("depth") - 1)

    def with_parent(children: DataFrame, names: list[str]) -> DataFrame:
        deep = children.filter("up_depth > 0 AND NOT above").join(parents, of).select(*names, F.col("parent").alias("parent_conv_id"))
        first = children.filter("up_depth = 0").crossJoin(F.broadcast(top)).select(*names, F.col("top").alias("parent_conv_id"))  # one row
        return deep.unionAll(first)

    head_rows = with_parent(own_heads, ["conv_id", "depth", *measures]).select("conv_id", "depth", "parent_conv_id", *measures)
    known = inner.filter("above").select("node", "depth", F.col("node").alias("parent_conv_id"))
    parent_of = with_parent(inner, ["node", "depth"]).unionAll(known)

    # sums over subtrees, by members
    named = nodes.select(F.col("depth").alias("n_depth"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), "node", "n_children")
    at = [F.col("depth") == F.col("n_depth"), F.col("k1") == F.col("n1"), F.col("k2") == F.col("n2")]
    members = shared.join(named, at)
    first_member = F.col("conv_id") == F.col("node")
    members = staged(members.select(
        "conv_id", "depth", "node", F.when(first_member, F.lit(0)).otherwise(F.col("bytes")).cast("long").alias("spared"),
        (first_member & ended & (F.col("n_children") == 0)).cast("long").alias("leaf"), ended.alias("ended"),
    ), "trie-members")
    leaves = rows.filter(F.col("alone") & ended).select("conv_id", "depth", F.lit(None).cast("long").alias("node"), F.lit(0).cast("long").alias("spared"), F.lit(1).cast("long").alias("leaf"), F.lit(True).alias("ended"))
    summed = running(members.unionAll(leaves), "conv_id", [F.col("depth").desc()], "trie-sums", {"spared": "sum", "leaf": "sum"})
    below = summed.filter("node IS NOT NULL").groupBy("node", "depth").agg(F.sum("run_leaf").alias("n_leaves"), F.sum("run_spared").alias("saved_tokens"))
    digests = ends_digests(members.filter("ended").select("node", "depth", "conv_id"))
    exact = nodes.select("node", "depth", "n_convs", "n_children").join(below, ["node", "depth"]).join(parent_of, ["node", "depth"], "left").join(digests, ["node", "depth"], "left")
    exact = exact.withColumn("ends_sha256", F.coalesce("ends_sha256", _sha(F.lit("")))).withColumnRenamed("node", "conv_id")
    names = ["conv_id", "depth", "parent_conv_id", *measures]
    return exact.select(names).unionAll(head_rows.select(names)).unionAll(tails.select(names))


def trie_of(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return prefix_trie(*whole(numbered_turns(conversations)))


def trie_query(conversations: DataFrame) -> DataFrame:
    """The trie of the spliced conversations."""
    turns, convs = spliced(numbered_turns(conversations))
    return prefix_trie(turns, convs)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, ts, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 9 AS h
  FROM t),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts[1 : c.h], []), c.ts[c.h + 1 :]) AS ts
  FROM h c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM r),
m AS (SELECT conv_id, depth, ts[1 : depth] AS k, depth = len(ts) AS ended, CASE WHEN depth = 0 THEN 0 ELSE strlen(ts[depth].x) END AS bytes FROM p),
n AS (
  SELECT depth, k, min(conv_id) AS node, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM m GROUP BY depth, k),
c AS (SELECT depth - 1 AS depth, k[1 : depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
g AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, u.node AS parent_conv_id
  FROM n LEFT JOIN c ON c.depth = n.depth AND c.k = n.k
  LEFT JOIN n u ON u.depth = n.depth - 1 AND u.k = n.k[1 : n.depth - 1]),
s AS (
  SELECT m.depth, m.k, sum((g.n_convs - 1) * g.bytes) AS saved, count(*) FILTER (WHERE g.n_children = 0) AS leaves
  FROM g JOIN m ON m.conv_id = g.node AND m.depth <= g.depth GROUP BY m.depth, m.k)
SELECT g.node AS conv_id, g.depth, g.parent_conv_id, g.n_convs, g.n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN s ON s.depth = g.depth AND s.k = g.k
"""
