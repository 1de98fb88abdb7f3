"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, staged


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (smallest node reachable) for the links ``u, v`` (longs).

    Every round each node takes the smallest label among its neighbours' and its
    own, and then the label of that label, so stars end after one round and
    paths after a number of rounds like the logarithm of their length.  Links
    are replaced by links between labels, so a round works on what is left.
    """
    links = staged(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "links")
    labels = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"))
        least = staged(least, "least")
        # label of the label: one jump
        up = least.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = staged(least.join(sized_broadcast(up), F.col("label") == F.col("up")).select("node", F.least("label", "up_label").alias("label")), "jumped")
        if labels is None:
            labels = jumped
        else:
            old = labels.join(sized_broadcast(jumped.select(F.col("label").alias("next"), F.col("node").alias("at"))), F.col("label") == F.col("at"), "left")
            labels = staged(old.select("node", F.coalesce("next", "label").alias("label")), "labels")
        a = sized_broadcast(jumped.select(F.col("node").alias("u"), F.col("label").alias("lu")))
        b = sized_broadcast(jumped.select(F.col("node").alias("v"), F.col("label").alias("lv")))
        rest = links.join(a, "u").join(b, "v").filter("lu <> lv")
        links = staged(rest.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "links")
        if links.isEmpty():
            return labels
