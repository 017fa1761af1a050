"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Large: every greater neighbour of a node is linked with the least of the node and its
    neighbours. Small: every node and its lesser neighbours are linked with the least of them.
    """
    if small:
        near = edges.select(F.col("u").alias("n"), F.col("v").alias("o"))
    else:
        near = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    least = near.groupBy("n").agg(F.least(F.first("n"), F.min("o")).alias("m"))
    if small:
        linked = near.join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    else:
        linked = near.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    return linked.where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in ``links``: root is the least node that can be reached.

    Large and small stars take turns until the edges no longer change; then every edge leads from a
    node to its root. A round is linear in the edges and never has more of them than the round
    before has edges and nodes; a hub is a minimum with map-side combine and a join that Spark can
    split. Links of a node with itself keep it as its own root; null ends are no links.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    edges = cut(both.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    while True:
        after = cut(_stars(_stars(edges, small=False), small=True))
        moved = after.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not moved:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    alone = both.where("x = y").select(F.col("x").alias("node")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
