"""Boosted regression trees on histograms, for any number of groups at once.

Each group (a fold, a symbol, a whole frame) gets a model of its own: ``rounds`` trees of a fixed
depth on features binned into at most ``BINS`` bins, fitted on what the trees before
left over.  Groups of up to ``GROUP_ROWS`` rows are dealt to tasks and fitted there, many at a time.  Larger
ones are binned first, and rows that fall into the same bins are one row with a weight; where that leaves up to ``GROUP_ROWS`` of them,
the group is fitted in a task, too.  What is still larger grows together: one job a tree level sums gradients by (group, node, feature, bin)
over the packed rows, which the executors keep, and only these sums meet.  All ways make the same trees.

Targets and leaves are whole numbers of a fixed step, so a model doesn't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.session import drop_path, scratch_path

BINS = 255
SLOTS = BINS + 1
GROUP_ROWS = 200_000  # a larger group is not put into one task; also what bin edges are read from
LEAST_LEAF = 20
KEEP_STATE = 10  # rounds after which the rows of large groups are brought up to date
SHARE_ROWS = 250_000  # binned rows that are worth a task
MOST_SUMS = 16 << 20  # bytes of all tasks' sums that the driver adds up; beyond it tasks do


@dataclass(frozen=True)
class BoostConfig:
    """Depth, step and rounds of the trees."""

    depth: int = 3
    step: float = 0.05
    rounds: int = 250


@dataclass
class Boosted:
    """A model: its base value and, for each tree, features and thresholds of the inner nodes (-1: all go left) and values of the leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        cuts = [np.unique(self.threshold[self.feature == f]) for f in range(x.shape[1])]
        place = np.zeros(self.feature.shape, np.int64)
        for f, own in enumerate(cuts):
            place[self.feature == f] = np.searchsorted(own, self.threshold[self.feature == f])
        # how many thresholds lie below a value says on which side of each of them it is
        codes = [np.where(np.isnan(x[:, f]), 0, np.searchsorted(own, x[:, f], side="left")).astype(np.min_scalar_type(len(own))) for f, own in enumerate(cuts)]
        for feature, edge, value in zip(self.feature, place, self.value, strict=True):
            out += value[_leaf(feature, edge, codes, len(x))]
        return out


def _leaf(feature: np.ndarray, edge: np.ndarray, bins: list[np.ndarray], n: int) -> np.ndarray:
    """The leaf of each of ``n`` rows; inner nodes lie level by level in ``feature`` and ``edge``."""
    node, first = np.zeros(n, np.min_scalar_type(len(feature))), 0
    while first < len(feature):
        own = slice(first, 2 * first + 1)
        node, first = _children(node, feature[own], edge[own], bins), 2 * first + 1
    return node


def _children(node: np.ndarray, feature: np.ndarray, edge: np.ndarray, bins: list[np.ndarray]) -> np.ndarray:
    """Where rows go from the nodes of one level."""
    right = np.zeros(len(node), bool)
    for k, (f, e) in enumerate(zip(feature.tolist(), edge.tolist(), strict=True)):
        if f >= 0:
            right |= (bins[f] > e) & (node == k)
    return 2 * node + right


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Midpoints of the distinct values, or of percentiles where there are too many; a value up to an edge lies left of it."""
    distinct = np.unique(values)
    if len(distinct) <= BINS:
        return (distinct[:-1] + distinct[1:]) / 2
    return np.unique(np.percentile(values, np.linspace(0, 100, BINS + 1)[1:-1], method="midpoint"))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


class _Rows:
    """Binned rows of a group: ``rest`` is what the trees so far leave of their targets, ``weight`` how many rows each stands for."""

    def __init__(self, bins: np.ndarray, rest: np.ndarray, weight: np.ndarray | None = None):
        self.bins = [np.ascontiguousarray(bins[:, k]) for k in range(bins.shape[1])]
        self.rest, self.weight = rest, weight
        self.counts: np.ndarray | None = None  # of the root, the same for all trees

    def start(self, depth: int) -> np.ndarray:
        return np.zeros(len(self.rest), np.min_scalar_type(2**depth - 1))

    def sums(self, node: np.ndarray, level: int) -> np.ndarray:
        """Gradient sums and row counts by (node, feature, bin): of the root, or of the left children of a level."""
        nodes, rest, weight = 2 ** max(level - 1, 0), self.rest, self.weight
        at, bins = np.zeros(len(rest), np.int64), self.bins
        if level:
            kept = np.flatnonzero(node % 2 == 0)
            at, bins = (node[kept] >> 1).astype(np.int64) * SLOTS, [b[kept] for b in bins]
            rest, weight = rest[kept], None if weight is None else weight[kept]
        out = np.zeros((2, nodes, len(bins), SLOTS), np.int64)
        parts = _exact(rest)
        for k, own in enumerate(bins):
            place = at + own
            for part, shift in parts:
                out[0, :, k] += np.bincount(place, part, nodes * SLOTS).astype(np.int64).reshape(nodes, SLOTS) << shift
            if level or self.counts is None:
                out[1, :, k] = np.bincount(place, weight, nodes * SLOTS).reshape(nodes, SLOTS)
        if not level:
            if self.counts is None:
                self.counts = out[1].copy()
            out[1] = self.counts
        return out

    def take(self, value: np.ndarray) -> None:
        self.rest -= value if self.weight is None else value * self.weight


def _exact(rest: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """``rest`` as doubles whose sums are exact, and how far to shift them: sums of whole numbers below 2**53 are; else high and low halves apart."""
    if len(rest) * float(np.abs(rest).max(initial=0)) < 2.0**53:
        return [(rest.astype(float), 0)]
    return [((rest >> 24).astype(float), 24), ((rest & 0xFFFFFF).astype(float), 0)]


def _splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best feature and bin of each node, -1 where none gains; of equal gains the first feature and bin."""
    left = np.cumsum(sums, axis=3)
    whole = left[..., -1:]
    right = whole - left
    score = lambda s: s[0].astype(float) ** 2 / np.maximum(s[1], 1)
    gain = score(left) + score(right) - score(whole)
    gain[(left[1] < LEAST_LEAF) | (right[1] < LEAST_LEAF)] = -1.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    found = flat[np.arange(len(flat)), best] > 0
    return np.where(found, best // (BINS + 1), -1), np.where(found, best % (BINS + 1), 0)


def _scale(y: np.ndarray | float) -> float:
    most = float(np.max(np.abs(y))) if np.size(y) else 0.0
    return 2.0**30 / most if most > 0 else 1.0


def _scale(most: float) -> float:
    return 2.0**30 / most if most > 0 else 1.0


class _Growing:
    """A tree that grows a level at a time, by bins; leaves are whole numbers."""

    def __init__(self, depth: int):
        self.depth, self.level = depth, 0
        self.feature, self.bin = np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64)
        self.value = np.zeros(2**depth, np.int64)
        self.whole: np.ndarray | None = None  # sums of the last level's nodes

    def nodes_of(self, bins: list[np.ndarray], n: int) -> np.ndarray:
        end = 2**self.level - 1
        return _leaf(self.feature[:end], self.bin[:end], bins, n)

    def step(self, node: np.ndarray, bins: list[np.ndarray]) -> np.ndarray:
        """The nodes of rows after the last split."""
        own = slice(2 ** (self.level - 1) - 1, 2**self.level - 1)
        return _children(node, self.feature[own], self.bin[own], bins)

    def split(self, sums: np.ndarray) -> None:
        """By the sums of the root, or of a level's left children: the right ones have what is left of their parents."""
        if self.level:
            sums = np.stack([sums, self.whole - sums], axis=2).reshape(2, -1, *sums.shape[2:])
        own = slice(2**self.level - 1, 2 ** (self.level + 1) - 1)
        self.feature[own], self.bin[own] = _splits(sums)
        self.level, self.whole = self.level + 1, sums

    def finish(self, step: float) -> None:
        """Leaves from the sums on both sides of the last splits."""
        if not self.depth:
            return
        last = slice(2 ** (self.depth - 1) - 1, None)
        f, b, nodes = self.feature[last], self.bin[last], np.arange(2 ** (self.depth - 1))
        every = self.whole[:, :, 0].sum(axis=2)
        left = np.where(f >= 0, np.cumsum(self.whole[:, nodes, np.maximum(f, 0)], axis=2)[:, nodes, b], every)
        sums, counts = np.stack([left, every - left], axis=2).reshape(2, -1)
        self.value, self.whole = np.rint(step * sums / np.maximum(counts, 1)).astype(np.int64), None


def _grow(rows: _Rows, config: BoostConfig) -> list[_Growing]:
    """The trees of a group whose rows are all here."""
    trees: list[_Growing] = []
    for _ in range(config.rounds):
        tree, node = _Growing(config.depth), rows.start(config.depth)
        for level in range(config.depth):
            tree.split(rows.sums(node, level))
            node = tree.step(node, rows.bins)
        tree.finish(config.step)
        rows.take(tree.value[node])
        trees.append(tree)
    return trees


def _model(base: float, scale: float, feature: np.ndarray, bins: np.ndarray, value: np.ndarray, edges: list[np.ndarray]) -> Boosted:
    threshold = np.zeros(feature.shape)
    for f, own in enumerate(edges):
        threshold[feature == f] = own[bins[feature == f]]
    return Boosted(base, feature, threshold, value / scale)


def _arrays(trees: list[_Growing]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([t.feature for t in trees]), np.array([t.bin for t in trees]), np.array([t.value for t in trees])


def fit_arrays(x: np.ndarray, y: np.ndarray, config: BoostConfig = BoostConfig()) -> Boosted:
    """The model of one group."""
    edges = [bin_edges(x[:, k]) for k in range(x.shape[1])]
    base = float(np.mean(y))
    scale = _scale(float(np.max(np.abs(y - base), initial=0.0)))
    trees = _grow(_Rows(_binned(x, edges), np.rint((y - base) * scale).astype(np.int64)), config)
    return _model(base, scale, *_arrays(trees), edges)


def _matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(n).to_numpy(), float) for n in names], axis=1)


def _small_groups(rows: DataFrame, group: str, features: list[str], target: str, config: BoostConfig, least: int, name: str) -> DataFrame:
    names = rows.columns

    def run(table: pa.Table) -> pa.Table:
        own = np.array(table.column("part").to_pylist())
        train, test = table.filter(pa.array(own == "train")), table.filter(pa.array(own == "test"))
        if train.num_rows < least:
            test = test.slice(0, 0)
            return test.append_column(name, pa.array([], pa.float64()))
        model = fit_arrays(_matrix(train, features), _matrix(train, [target])[:, 0], config)
        return test.append_column(name, pa.array(model.predict(_matrix(test, features)), pa.float64()))

    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])
    return rows.groupBy(group).applyInArrow(run, schema).select(*names, name)


def _edges_of(train: DataFrame, group: str, features: list[str], sizes: dict) -> dict:
    """Bin edges of large groups from a sample of about ``GROUP_ROWS`` rows of each, drawn by a hash of the row."""
    chance = F.create_map(*(v for k, n in sizes.items() for v in (F.lit(k), F.lit(min(1.0, GROUP_ROWS / n)))))
    drawn = F.pmod(F.xxhash64(*train.columns), F.lit(1 << 30)) < chance[F.col(group)] * (1 << 30)

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table, features)
        edges = [bin_edges(x[:, k]).tolist() for k in range(len(features))]
        return pa.table({"key": table.column("key").slice(0, 1), "edges": pa.array([edges], pa.list_(pa.list_(pa.float64())))})

    sample = train.filter(drawn).select(F.col(group).alias("key"), *features)
    kind = train.schema[group].dataType.simpleString()
    rows = sample.groupBy("key").applyInArrow(run, f"key {kind}, edges array<array<double>>").collect()  # a row a large group
    return {r["key"]: [np.array(e) for e in r["edges"]] for r in rows}


@dataclass(frozen=True)
class _Scales:
    """Of each large group, by its number: bin edges, mean and scale of its targets."""

    edges: list
    base: list[float]
    scale: list[float]


def _binned_table(train: DataFrame, group: str, features: list[str], target: str, keys: list, scales: _Scales) -> DataFrame:
    """``g, bins, rest, weight``: rows of one group in the same bins are one row, with the sum of their targets."""
    number = F.create_map(*(v for i, k in enumerate(keys) for v in (F.lit(k), F.lit(i))))
    shared = train.sparkSession.sparkContext.broadcast(scales)

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            g, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch, features)
            bins, rest = np.zeros(x.shape, np.uint8), np.zeros(len(g), np.int64)
            for i in np.unique(g).tolist():
                at = np.flatnonzero(g == i)
                bins[at] = _binned(x[at], own.edges[i])
                rest[at] = np.rint((y[at] - own.base[i]) * own.scale[i])
            ends = np.arange(0, bins.size + 1, len(features), dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(rest)], ["g", "bins", "rest"])

    rows = train.select(number[F.col(group)].alias("g"), F.col(target).cast("double").alias("y"), *(F.col(f).cast("double").alias(f) for f in features))
    return rows.mapInArrow(bin_rows, "g int, bins binary, rest bigint").groupBy("g", "bins").agg(F.sum("rest").alias("rest"), F.count(F.lit(1)).alias("weight"))


STATE = "g int, bins binary, rest bigint, weight bigint"


def _unpacked(batch: pa.RecordBatch | pa.Table, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, features)
    return batch.column(0).to_numpy(), bins, batch.column(2).to_numpy(), batch.column(3).to_numpy()


def _grow_in_tasks(table: DataFrame, features: int, config: BoostConfig) -> dict[int, tuple]:
    """Feature, bin and leaves of the trees of each group, each grown in a task."""

    def run(rows: pa.Table) -> pa.Table:
        _, bins, rest, weight = _unpacked(rows, features)
        flat = [a.ravel() for a in _arrays(_grow(_Rows(bins, rest.copy(), weight), config))]
        return pa.table({"g": rows.column("g").slice(0, 1), **{name: pa.array([a], pa.list_(pa.int64())) for name, a in zip(("feature", "bin", "value"), flat, strict=True)}})

    found = table.groupBy("g").applyInArrow(run, "g int, feature array<bigint>, bin array<bigint>, value array<bigint>").collect()  # a row a large group
    return {r["g"]: tuple(np.array(r[name], np.int64).reshape(config.rounds, -1) for name in ("feature", "bin", "value")) for r in found}


def _packed(table: DataFrame, features: int, tasks: int) -> RDD:
    """``(group, rows)`` in blocks of about ``SHARE_ROWS`` rows at most, dealt over ``tasks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, bins, rest, weight = _unpacked(pa.Table.from_batches(got), features)
            own = [np.flatnonzero(g == i) for i in np.unique(g)]
            columns = [pa.array([np.ascontiguousarray(x[at]).tobytes() for at in own], pa.binary()) for x in (bins, rest, weight)]
            yield pa.RecordBatch.from_arrays([pa.array([g[at[0]] for at in own], pa.int32()), *columns], ["g", "bins", "rest", "weight"])

        got: list[pa.RecordBatch] = []
        for batch in batches:
            got.append(batch)
            if sum(b.num_rows for b in got) >= SHARE_ROWS:
                yield from blocks(got)
                got = []
        if sum(b.num_rows for b in got):
            yield from blocks(got)

    def rows_of(r) -> tuple[int, _Rows]:
        return r["g"], _Rows(np.frombuffer(r["bins"], np.uint8).reshape(-1, features), np.frombuffer(r["rest"], np.int64).copy(), np.frombuffer(r["weight"], np.int64))

    return table.repartition(tasks).mapInArrow(run, "g int, bins binary, rest binary, weight binary").rdd.map(rows_of)


def _grow_by_jobs(table: DataFrame, groups: list[int], features: int, tasks: int, config: BoostConfig) -> dict[int, tuple]:
    """As ``_grow_in_tasks``, for groups of any size together: a job a level over the packed rows.

    They are kept in the executors' memory, or on their disks where it is short; what is lost is made anew.
    """
    trees: dict[int, list[_Growing]] = {i: [] for i in groups}
    pending: dict[int, list[_Growing]] = {i: [] for i in groups}  # grown since the rows were brought up to date

    def walked(rows: _Rows, done: list[_Growing]) -> _Rows:
        for tree in done:
            rows.take(tree.value[tree.nodes_of(rows.bins, len(rows.rest))])
        return rows

    def summed(growing: dict[int, _Growing], level: int) -> dict[int, np.ndarray]:
        done, shapes = pending, {i: (t.level, t.feature, t.bin) for i, t in growing.items()}

        def run(blocks: Iterator[tuple[int, _Rows]]) -> Iterator[tuple[int, np.ndarray]]:
            total: dict[int, np.ndarray] = {}
            for i, rows in blocks:
                depth, feature, edge = shapes[i]
                walked(rows, done[i])
                more = rows.sums(_leaf(feature[: 2**depth - 1], edge[: 2**depth - 1], rows.bins, len(rows.rest)), level)
                total[i] = total[i] + more if i in total else more
            yield from total.items()

        found = state.mapPartitions(run)
        if tasks * len(groups) * 2 ** max(level - 1, 0) * features * SLOTS * 16 > MOST_SUMS:
            found = found.reduceByKey(np.add, min(tasks, len(groups)))
        sums: dict[int, np.ndarray] = {}
        for i, own in found.collect():  # groups x nodes x features x bins, of a task or of all
            sums[i] = sums[i] + own if i in sums else own
        return sums

    state = _packed(table, features, tasks).persist(StorageLevel.MEMORY_AND_DISK)
    last = None
    for done in range(1, config.rounds + 1):
        growing = {i: _Growing(config.depth) for i in groups}
        for level in range(config.depth):
            for i, own in summed(growing, level).items():
                growing[i].split(own)
            if last is not None:
                last.unpersist()
                last = None
        for i, tree in growing.items():
            tree.finish(config.step)
            trees[i].append(tree)
            pending[i].append(tree)
        if done % KEEP_STATE == 0 and done < config.rounds:
            last, grown = state, pending
            state = last.map(lambda b, grown=grown: (b[0], walked(b[1], grown[b[0]]))).persist(StorageLevel.MEMORY_AND_DISK)
            pending = {i: [] for i in groups}
    state.unpersist()
    return {i: _arrays(own) for i, own in trees.items()}


def fit_large(train: DataFrame, group: str, features: list[str], target: str, sizes: dict, config: BoostConfig = BoostConfig(), group_rows: int = GROUP_ROWS) -> dict:
    """Models of large groups (``sizes``: rows of each, as many as the data has room for), all grown together over the whole table."""
    spark, keys = train.sparkSession, list(sizes)
    edges = _edges_of(train, group, features, sizes)
    y = F.col(target).cast("double")
    found = {r["k"]: r for r in train.groupBy(F.col(group).alias("k")).agg(F.avg(y).alias("m"), F.min(y).alias("a"), F.max(y).alias("b")).collect()}
    base = [float(found[k]["m"]) for k in keys]
    scales = _Scales([edges[k] for k in keys], base, [_scale(max(found[k]["b"] - m, m - found[k]["a"])) for k, m in zip(keys, base, strict=True)])
    path = scratch_path(spark, "boosting")
    _binned_table(train, group, features, target, keys, scales).write.parquet(path)
    table = spark.read.schema(STATE).parquet(path)
    binned = {r["g"]: r["count"] for r in table.groupBy("g").count().collect()}
    large = sorted(i for i, n in binned.items() if n > group_rows)
    grown = {}
    if len(large) < len(keys):
        grown |= _grow_in_tasks(table.filter(~F.col("g").isin(large)) if large else table, len(features), config)
    if large:
        tasks = -(-sum(binned[i] for i in large) // SHARE_ROWS)
        grown |= _grow_by_jobs(table.filter(F.col("g").isin(large)), large, len(features), tasks, config)
    drop_path(spark, path)
    return {k: _model(base[i], scales.scale[i], *grown[i], edges[k]) for i, k in enumerate(keys)}


def predict_groups(rows: DataFrame, group: str, features: list[str], models: dict, name: str) -> DataFrame:
    """Predictions of the models (one a large group) where the rows lie."""
    names, shared = rows.columns, rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = _matrix(batch, features), np.zeros(batch.num_rows)
            keys = batch.column(names.index(group)).dictionary_encode()
            number = keys.indices.fill_null(len(keys.dictionary)).to_numpy()
            for k, key in enumerate(keys.dictionary.to_pylist()):
                own = np.flatnonzero(number == k)
                out[own] = shared.value[key].predict(x[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def boosted_predictions(rows: DataFrame, group: str, features: list[str], target: str, name: str, config: BoostConfig = BoostConfig(), least: int = 50, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The ``test`` rows (by their ``part``) with ``name`` predicted by a model of their group's ``train`` rows.

    Groups with fewer than ``least`` train rows are left out.  Features and target have no nulls.
    """
    train = F.count_if(F.col("part") == "train").alias("train")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), train).filter((F.col("n") > group_rows) & (F.col("train") >= least))
    large = {r[group]: r["train"] for r in sizes.collect()}  # as many as the rows allow
    small = rows.filter(~F.col(group).isin(list(large))) if large else rows
    out = _small_groups(small, group, features, target, config, least, name)
    if large:
        own = rows.filter(F.col(group).isin(list(large)))
        models = fit_large(own.filter("part = 'train'"), group, features, target, large, config, group_rows)
        out = out.unionByName(predict_groups(own.filter("part = 'test'"), group, features, models, name))
    return out


def fit_pooled(train: DataFrame, features: list[str], target: str, rows: int, config: BoostConfig = BoostConfig(), group_rows: int = GROUP_ROWS) -> Boosted:
    """One model of a whole frame without nulls, of ``rows`` rows."""
    keyed = train.select(F.lit(0).alias("_all"), F.col(target).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f) for f in features))
    if rows > group_rows:
        return fit_large(keyed, "_all", features, "_y", {0: rows}, config, group_rows)[0]

    def run(table: pa.Table) -> pa.Table:
        m = fit_arrays(_matrix(table, features), _matrix(table, ["_y"])[:, 0], config)
        lists = {"feature": m.feature.ravel().astype(np.int32), "threshold": m.threshold.ravel(), "value": m.value.ravel()}
        return pa.table({"base": pa.array([m.base]), **{k: pa.array([v]) for k, v in lists.items()}})

    r = keyed.groupBy("_all").applyInArrow(run, "base double, feature array<int>, threshold array<double>, value array<double>").first()  # group_rows rows at most
    shape = lambda v, n: np.array(v).reshape(config.rounds, n)
    inner = 2**config.depth - 1
    return Boosted(r["base"], shape(r["feature"], inner), shape(r["threshold"], inner), shape(r["value"], inner + 1))
