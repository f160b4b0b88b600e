"""Connected components of an edge table, by alternating stars.

Each round links the larger neighbours of every node to its smallest one, and
then the smaller ones, until no edge changes. Rounds grow with the logarithm
of a component's size; a node with very many neighbours is a grouped minimum
and a join that the adaptive planner splits. Nothing but the counts that tell
the end goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Each node's larger (or smaller) neighbours are linked to its smallest neighbour or itself."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): each node that has an edge to another, with the smallest node of its component (node, comp).

    Edges from a node to itself and repeated edges change nothing."""
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sums = [F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))]
    mark = state.agg(*sums).first()
    while mark[0]:
        half = stored(_star(state, True), "large-star")
        after = stored(_star(half, False), "small-star")
        now = after.agg(*sums).first()
        drop_stored(half)
        drop_stored(state)
        state, mark, before = after, now, mark
        if now == before:
            break
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots)
