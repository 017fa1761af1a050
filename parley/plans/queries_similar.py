"""Labels made one by similarity, semantic continuations, users who mention users."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.text import iso
from parley.functions.vectors import letter_profile
from parley.operators import continuation as C
from parley.operators import graph as G
from parley.operators import similar as M
from parley.operators.linked import components
from parley.plans.fixture_sql import iso as sql_iso
from parley.plans.registry import query

#: Cosine from which vectors of the given table count as near, and letter profiles of labels do.
NEAR, NEAR_LABELS = 0.4, 0.8

_VECTORS = "v AS (SELECT 'k' || (label % 3) AS kind, 'L' || vec_id AS label, vec_id % 7 AS uses, embedding::DOUBLE[] AS vec FROM embeddings)"
_REACH = f"""
WITH RECURSIVE {_VECTORS},
links AS (SELECT a.label AS a, b.label AS b FROM v a JOIN v b ON a.kind = b.kind AND a.label <> b.label AND list_cosine_similarity(a.vec, b.vec) >= {NEAR}),
reach AS (SELECT label AS a, label AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS label, min(b) AS root FROM reach GROUP BY 1)"""


def _vectors(fx):
    return fx.table("embeddings").select(
        F.expr("concat('k', label % 3)").alias("kind"), F.expr("concat('L', vec_id)").alias("label"),
        F.expr("vec_id % 7").alias("uses"), F.col("embedding").cast("array<double>").alias("vec"))


@query("similar_components", f"{_REACH} SELECT label AS node, root FROM roots WHERE label IN (SELECT a FROM links)")
def similar_components(fx):
    """Components of all near pairs of vectors, by small cells and blocks."""
    v = _vectors(fx).select(F.col("kind").alias("grp"), F.col("label").alias("node"), "vec")
    return components(M.similar_links(v, NEAR, cell=64, block=32))


@query("similar_labels", f"""{_REACH}
SELECT kind, label, first_value(label) OVER (PARTITION BY root ORDER BY uses DESC, label) AS canonical, count(*) OVER (PARTITION BY root) AS members
FROM v JOIN roots USING (label)""")
def similar_labels(fx):
    """Labels with given vectors, made one within their kind."""
    return M.canonical_labels(_vectors(fx), NEAR)


def _canonical(fx):
    labels = M.label_uses(fx.facts).withColumn("vec", letter_profile(F.col("label")))
    return M.canonical_labels(labels, NEAR_LABELS)


def _graph(fx):
    return G.build_graph(M.rekeyed_facts(fx.facts, _canonical(fx)), fx.channels, fx.guilds)


@query("canonical_labels", "SELECT kind, label, canonical, members FROM fx_canon")
def canonical_labels(fx):
    """Topics and entities of the graph, entities within their type."""
    return _canonical(fx)


@query("nodes_topic_canonical", f"""
SELECT topic AS name, count(*) AS discussion_count, {sql_iso('min(started_at)')} AS created_at FROM fx_ctopics JOIN fx_times USING (discussion_id) GROUP BY 1""")
def nodes_topic_canonical(fx):
    """Topic nodes of the graph keyed by canonical labels."""
    return _graph(fx)["nodes_topic"].select("name", "discussion_count", iso(F.col("created_at")).alias("created_at"))


@query("edges_discusses_canonical", "SELECT discussion_id AS src, topic AS dst FROM fx_ctopics")
def edges_discusses_canonical(fx):
    return _graph(fx)["edges_discusses"]


@query("edges_mentions_canonical", "SELECT discussion_id AS src, key AS dst, 1 AS count FROM fx_centities")
def edges_mentions_canonical(fx):
    return _graph(fx)["edges_mentions"]


@query("edges_topic_cooccurs_canonical", f"""
SELECT a.topic AS src, b.topic AS dst, count(*) AS count, {sql_iso('max(t.started_at)')} AS last_seen_at
FROM fx_ctopics a JOIN fx_ctopics b ON a.discussion_id = b.discussion_id AND a.topic < b.topic JOIN fx_times t ON t.discussion_id = a.discussion_id GROUP BY 1, 2""")
def edges_topic_cooccurs_canonical(fx):
    return _graph(fx)["edges_topic_cooccurs"].withColumn("last_seen_at", iso(F.col("last_seen_at")))


_SEMANTIC = """
SELECT src, dst, score FROM (
 SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.embedding, b.embedding) AS score, b.started_at
 FROM fx_nodes a JOIN fx_discussions ad ON ad.id = a.id JOIN fx_nodes b ON a.channel_id = b.channel_id JOIN fx_discussions bd ON bd.id = b.id
 WHERE (b.started_at, b.id) < (a.started_at, a.id) AND b.started_at >= a.started_at - INTERVAL 14 DAY
  AND ad.continuation_of_discussion_id IS DISTINCT FROM b.id AND bd.continuation_of_discussion_id IS DISTINCT FROM a.id
  AND list_cosine_similarity(a.embedding, b.embedding) >= 0.25)
QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, started_at DESC, dst) <= 3"""


def _semantic(fx):
    links = fx.discussions.select("id", "continuation_of_discussion_id")
    return C.semantic_continuations(fx.nodes.join(links, "id"), theta=0.25, lookback_days=14, top_k=3, block=32)


@query("semantic_continuations", f"SELECT src, dst, 'semantic_similarity' AS reason, round(score, 6) AS similarity_score FROM ({_SEMANTIC})")
def semantic_continuations(fx):
    """Up to three similar earlier discussions of the channel, within 14 days, not linked yet."""
    return _semantic(fx).withColumn("similarity_score", F.round("similarity_score", 6))


@query("edges_continuation_all", f"""
SELECT src, dst, 'explicit_reply' AS reason, NULL::DOUBLE AS similarity_score, stub FROM fx_cont
UNION ALL SELECT src, dst, 'semantic_similarity', round(score, 6), false FROM ({_SEMANTIC})""")
def edges_continuation_all(fx):
    """Explicit and semantic continuation edges of the graph."""
    edges = C.with_semantic(fx.graph["edges_continuation_of"], _semantic(fx), fx.nodes)
    return edges.select("src", "dst", "reason", F.round("similarity_score", 6).alias("similarity_score"), "stub")


_NAMED = "SELECT DISTINCT id, author_id AS src, unnest(mentions) AS dst, created_at FROM fx_slim"


@query("edges_mentions_user", f"""
SELECT src, dst, count(*) AS count, {sql_iso('min(created_at)')} AS first_mentioned_at, {sql_iso('max(created_at)')} AS last_mentioned_at
FROM ({_NAMED}) WHERE dst IS NOT NULL AND dst <> src GROUP BY 1, 2""")
def edges_mentions_user(fx):
    """Users who mention users, merged from the messages of two halves of the time."""
    half = F.expr("timestamp '2024-01-15'")
    old, new = (C.edges_mentions_user(fx.slim_messages.where(c)) for c in (F.col("created_at") < half, F.col("created_at") >= half))
    return C.merge_mentions_user(old, new).select(
        "src", "dst", "count", iso(F.col("first_mentioned_at")).alias("first_mentioned_at"), iso(F.col("last_mentioned_at")).alias("last_mentioned_at"))
