"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    The component is the smallest node reachable. Edges may repeat, run either way
    and point at themselves; edges with a null end are ignored; no edges give an
    empty table. Each round hangs every node's larger neighbours on its smallest
    one (large star), then its smaller neighbours (small star); the number of
    rounds grows with the logarithm of the longest path. Minima are aggregated
    before the shuffle, and the joins' heavy side is keyed by node, which adaptive
    execution can split where one node has very many neighbours. Every round is
    written to the shared folder, so a lost executor costs one round.
    """
    c = F.col
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(c(a).isNotNull() & c(b).isNotNull() & (c("u") != c("v")))
        .distinct(),
        "edges",
    )
    while True:
        n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and e.join(e.select(c("v").alias("u")), "u", "left_semi").isEmpty():  # every node hangs on a root
            return e.select(c("u").alias("node"), c("v").alias("component")).union(
                e.select(c("v").alias("node"), c("v").alias("component")).distinct()
            )
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), c("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(c("v").alias("u"), c("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v != m").select(c("v").alias("u"), c("m").alias("v"))
            .union(low.select("u", c("m").alias("v")))
            .distinct()
        )
        after = materialize(small, "edges")
        discard(e)
        e = after
