"""Reads over the graph tables: overview, neighbours, search, degrees, vocabulary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.graph import NODE_VIEW, all_edges, all_nodes, node_key
from parley.schemas import NODE_LABELS
from parley.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge once per end: node, other, type, src, dst. A loop counts once."""
    out = F.struct(F.col("src").alias("node"), F.col("dst").alias("other"))
    back = F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))
    # in place, so that edges are derived once and not once per end
    ends = F.when(F.col("src") != F.col("dst"), F.array(out, back)).otherwise(F.array(out))
    return edges.select(F.explode(ends).alias("_e"), "type", "src", "dst").select("_e.node", "_e.other", "type", "src", "dst")


def graph_overview(
    graph: dict[str, DataFrame], channel_id: str | None = None, limit: int = 400
) -> tuple[DataFrame, DataFrame]:
    """Newest discussions with their surroundings: (nodes, edges).

    Discussions: ceil(limit / 6), at least 10. Edges considered: 4 * limit. The
    discussions stay, other ends fill up to ``limit`` nodes; an edge needs both ends.
    Order: newest discussion first, then edge type and other end.
    """
    limit = max(20, limit)
    d = graph["nodes_discussion"]
    if channel_id is not None:
        d = d.filter(F.col("channel_id") == channel_id)
    newest = cut(d.orderBy(F.col("started_at").desc(), "id").limit(max(10, math.ceil(limit / 6))).select(
        node_key("Discussion", F.col("id")).alias("node"), "started_at"))
    order = [F.col("started_at").desc(), "node", "type", "other", "src"]
    # at most 4 * limit rows are left here, and they are used several times
    near = cut(both_ways(all_edges(graph)).join(newest, "node").orderBy(*order).limit(limit * 4))
    hops = near.groupBy("other").agg(F.max("started_at").alias("_t"), F.min("node").alias("_n"))
    spare = hops.join(newest, F.col("other") == newest["node"], "left_anti")
    seen = newest.join(near.select("node").distinct(), "node", "left_semi").select("node", F.lit(0).alias("tier"), F.col("started_at").alias("_t"))
    pool = seen.unionByName(spare.select(F.col("other").alias("node"), F.lit(1).alias("tier"), "_t"))
    kept = pool.orderBy("tier", F.col("_t").desc(), "node").limit(limit).select("node")
    edges = near.select("type", "src", "dst").distinct()
    edges = edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi")
    edges = edges.join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return all_nodes(graph).join(kept, "node", "left_semi"), edges


def neighbors(graph: dict[str, DataFrame], nodes: DataFrame, limit: int = 40) -> DataFrame:
    """Up to ``limit`` (1..200) edges of each given node, by type and other end."""
    limit = max(1, min(limit, 200))
    # ends are moved and sorted once each: whether an edge leaves the node gives src and dst again,
    # and of two edges between the same ends the one from the smaller end has the smaller src
    hops = both_ways(all_edges(graph)).select("node", "other", "type", (F.col("src") == F.col("node")).alias("_out"))
    w = Window.partitionBy("node").orderBy("type", "other", F.col("_out") != (F.col("node") < F.col("other")))
    near = hops.join(nodes.select("node"), "node", "left_semi").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    return near.select("node", "other", "type", F.when(F.col("_out"), F.col("node")).otherwise(F.col("other")).alias("src"),
                       F.when(F.col("_out"), F.col("other")).otherwise(F.col("node")).alias("dst"), "rn")


def degrees(edges: DataFrame) -> DataFrame:
    """Total degree per node."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


# fixed values: searched property per node table (channels are not searched)
SEARCHED = {"nodes_topic": "name", "nodes_entity": "name", "nodes_discussion": "title",
            "nodes_user": "username", "nodes_guild": "name"}


def search_nodes(graph: dict[str, DataFrame], query: str, limit: int = 20) -> DataFrame:
    """Nodes whose name contains the text, ignoring case, by label and key; limit 1..50."""
    q = query.strip().lower()
    out = None
    for table, prop in SEARCHED.items():
        label, key, _, _ = NODE_VIEW[table]
        hit = F.lower(F.col(prop)).contains(q) if q else F.lit(False)
        df = graph[table].filter(hit).select(
            node_key(label, F.col(key)).alias("node"), F.lit(label).alias("label"), F.col(prop).alias("matched"))
        out = df if out is None else out.unionByName(df)
    return out.orderBy("label", "node").limit(max(1, min(limit, 50)))


def node_by_domain_id(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Node key for (label, domain_id) rows; unknown labels find nothing."""
    return nodes.filter(F.col("label").isin(NODE_LABELS)).join(
        wanted.select("label", "domain_id"), ["label", "domain_id"], "left_semi").select(
        "label", "domain_id", "node")


def label_vocab(graph: dict[str, DataFrame], n: int = 60) -> DataFrame:
    """Most used topic and entity names: kind, name, uses."""
    n = max(1, n)
    t = graph["nodes_topic"].select(F.lit("topic").alias("kind"), "name", F.col("discussion_count").alias("uses"))
    e = graph["nodes_entity"].select(F.lit("entity").alias("kind"), "name", F.col("mention_count").alias("uses"),)
    return t.orderBy(F.col("uses").desc(), "name").limit(n).unionByName(
        e.orderBy(F.col("uses").desc(), "name").limit(n))
