"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Sizes.  A document's size is its number of words; the sources, in code-point
order with null last, weigh 5, 2, 1, 5, ... and share 150 % of all sizes; no
target exceeds twice its source's size, and what is above is shared again by
weight (one water level, found by running sums over the sources).

Copies.  Every document of a source should be taken ``target / size of the
source`` times.  The whole part is taken as it is; the fractions are rounded by
the pivotal method: of two fractional documents one hands mass to the other, in
proportion to sizes, in a random direction chosen so that expectations stay,
until one of them is 0 or 1.  The words taken from the two stay the same, so a
source misses its target by less than one document.

Tree.  Groups of about ``FAN`` documents of one source, by a hash, are rounded
on their own; each leaves at most one fractional document, and these residuals
are grouped again until one per source is left, which is rounded by a single
draw.  No task sees more than a group, however large the source, and draws are
hashes of ids, so reruns agree.

Defined cases: null text has size 0 and is taken 0 times; a null source is a
source; repeated rows are rounded one by one; null doc_ids are allowed; texts of any length count whole; extra
columns are ignored, and kept by ``mixed_documents``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, null_safe, prefix_beside, sized_broadcast, staged

FAN = 64
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
EPS = 1e-9


def word_count(text):
    """Words of a text as a native expression (null: 0): each word and the space before it becomes one letter."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]*+[^{SPACE_CLASS}]++", "w")
    return F.char_length(F.rtrim(marks, F.lit(SPACE_CHARS))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source, source_size, source_docs, target`` (from ``source, size``)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    # one row per source from here on
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("rest"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("rest_weight"),
    )
    level = F.col("rest") / F.col("rest_weight")
    rows = rows.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") > level, level)).over(everything))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", "source_docs", target.alias("target"))


def _let(value, then):
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def _snap(x):
    return F.when(x < EPS, F.lit(0.0)).when(x > 1 - EPS, F.lit(1.0)).otherwise(x)


def _pair(held, new):
    """Hand mass between two weighted fractions; at least one comes out whole."""

    def move(m):
        up_first = new["draw"] * (m["a"] + m["b"]) < m["b"]
        gain = F.when(m["a"] + m["b"] <= 0, F.lit(0.0)).when(up_first, m["a"]).otherwise(-m["b"])
        return _let(
            gain,
            lambda g: F.struct(
                _snap(held["x"] - g * new["size"] / held["size"]).alias("held_x"), _snap(new["x"] + g).alias("new_x")
            ),
        )

    ratio = held["size"] / new["size"]
    limits = F.struct(
        F.least(1 - new["x"], held["x"] * ratio).alias("a"), F.least(new["x"], (1 - held["x"]) * ratio).alias("b")
    )
    return _let(limits, move)


ITEM = ("draw", "x", "size", "doc_id", "nth", "whole", "source_size", "target")


def _with_x(item, x):
    return F.struct(*(x.alias("x") if f == "x" else item[f].alias(f) for f in ITEM))


def _reduce(items):
    """Round a list of items one after the other: the item still held, and those decided."""

    def step(state, new):
        def settle(xs):
            held, fresh = _with_x(state["held"], xs["held_x"]), _with_x(new, xs["new_x"])
            first = (xs["held_x"] == 0) | (xs["held_x"] == 1)
            return F.struct(
                F.when(first, fresh).otherwise(held).alias("held"),
                F.concat(state["done"], F.array(F.when(first, held).otherwise(fresh))).alias("done"),
            )

        return _let(_pair(state["held"], new), settle)

    start = F.struct(items[0].alias("held"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _draw(*columns):
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def mix(sizes: DataFrame, seed: int = 7, **shares) -> DataFrame:
    """Times each row of ``doc_id, source, size`` is taken.

    Returns ``doc_id, source, size, source_size, target, copies`` for every row.
    """
    targets = staged(source_targets(sizes, **shares), "mix-targets").withColumnRenamed("source", "target_source")
    alike = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    items = alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    items = items.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source", "times")
    rate = F.least(F.greatest(F.coalesce(F.try_divide("target", F.col("source_size")), F.lit(0.0)), F.lit(0.0)), F.lit(MOST))
    items = items.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + EPS))
    items = items.withColumn("x", _snap(F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))).drop("rate")
    items = staged(items.withColumn("size", F.col("size").cast("double")), "mix-items")
    result = ["doc_id", "source", "size", "source_size", "target", "copies"]
    whole = (F.col("size") == 0) | (F.col("x") == 0) | (F.col("x") == 1)
    decided = [items.filter(whole).withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("x"))).select(*result)]
    left = items.filter(~whole).withColumn("groups", F.ceil(F.col("source_docs") / FAN))
    largest = items.agg(F.max("source_docs")).first()[0] or 1
    level = 0
    while True:
        last = largest <= FAN
        key = F.xxhash64("doc_id", "nth", F.lit(seed), F.lit(level))
        dealt = left.withColumn("bucket", F.pmod(key, F.col("groups"))).withColumn("draw", _draw("doc_id", "nth", F.lit(seed), F.lit(level), F.lit("draw")))
        grouped = dealt.groupBy("source", "groups", "bucket").agg(F.array_sort(F.collect_list(F.struct(*ITEM))).alias("items"))
        rounded = staged(grouped.select("source", "groups", _reduce(F.col("items")).alias("r")).select("source", "groups", "r.held", "r.done"), f"mix-level{level}")
        done = rounded.select("source", F.explode("done").alias("i"))
        decided.append(_outcome(done, result))
        held = rounded.select("source", "groups", F.col("held").alias("i"))
        if last:
            # the only residual of a source: one draw
            final = F.when(_draw("i.doc_id", "i.nth", F.lit(seed), F.lit("last")) < F.col("i.x"), 1.0).otherwise(0.0)
            decided.append(_outcome(held.withColumn("i", _with_x(F.col("i"), final)), result))
            break
        left = held.select("source", F.ceil(F.col("groups") / FAN).alias("groups"), "i.*").drop("draw")
        largest, level = -(-largest // FAN), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.withColumn("size", F.col("size").cast("long")).withColumn("copies", F.col("copies").cast("long"))


def _outcome(items: DataFrame, columns: list[str]) -> DataFrame:
    return items.select("source", "i.*").withColumn("copies", F.col("whole") + F.round("x")).select(*columns)


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Written, so the texts are read once."""
    return staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")


def mixing_query(docs: DataFrame) -> DataFrame:
    return mix(document_sizes(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents with their copies: rows taken twice come twice, rows not taken go.

    Rows that agree in doc_id, source and size share their copies in the order of
    a row number within that (small) set; without such rows none is numbered.
    """
    keys = ["doc_id", "source", "size"]
    ours, theirs = prefix_beside(docs, "own"), prefix_beside(docs, "mix")
    plan = staged(mix(document_sizes(docs)).select(*(F.col(k).alias(theirs + k) for k in keys), F.col("copies").alias(f"{theirs}copies")), "mix-plan")
    own = {f"{ours}doc_id": F.col("doc_id").cast("long"), f"{ours}source": F.col("source").cast("string"), f"{ours}size": word_count(F.col("text"))}
    sized, ends = docs.withColumns(own), list(keys)
    if not plan.groupBy(*(theirs + k for k in keys)).count().filter("count > 1").isEmpty():
        one = Window.partitionBy(*own).orderBy(F.xxhash64("text"))
        two = Window.partitionBy(*(theirs + k for k in keys)).orderBy(F.desc(f"{theirs}copies"))
        sized, plan = sized.withColumn(f"{ours}nth", F.row_number().over(one)), plan.withColumn(f"{theirs}nth", F.row_number().over(two))
        ends.append("nth")
    taken = sized.join(sized_broadcast(plan.filter(F.col(f"{theirs}copies") > 0)), null_safe([(ours + k, theirs + k) for k in ends]))
    return taken.withColumn(f"{theirs}copy", F.explode(F.sequence(F.lit(1), F.col(f"{theirs}copies").cast("int")))).select(*docs.columns)
