"""Graph construction and graph read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.scores import node_size
from parley.functions.text import iso
from parley.operators import graph as G
from parley.operators import graph_reads as R
from parley.plans.fixture_sql import iso as sql_iso
from parley.plans.fixtures import DIM, Stored
from parley.plans.registry import query


@query("writable", """
SELECT id, channel_id, has_enrichment FROM (
 SELECT d.id, d.channel_id, e.discussion_id IS NOT NULL AS has_enrichment, row_number() OVER (PARTITION BY d.channel_id ORDER BY d.block_start_at, d.id) AS rn
 FROM fx_discussions d LEFT JOIN (SELECT * FROM fx_enrichment WHERE resolved IS NOT NULL) e ON e.discussion_id = d.id WHERE d.status = 'enriched') WHERE rn <= 25""")
def writable(fx):
    return G.writable(fx.discussions, fx.enrichment.filter("resolved is not null"), 25).select("id", "channel_id", "has_enrichment")


@query("canonical_topics", "SELECT discussion_id, pos::BIGINT AS pos, topic FROM fx_topics")
def canonical_topics(fx):
    return G.canonical_topics(fx.enrichment).select("discussion_id", F.col("pos").cast("bigint").alias("pos"), "topic")


@query("canonical_entities", "SELECT discussion_id, key, name, type FROM fx_entities")
def canonical_entities(fx):
    return G.canonical_entities(fx.enrichment).select("discussion_id", "key", "name", "type")


@query("label_pairs", "SELECT * FROM fx_tpairs UNION ALL SELECT * FROM fx_epairs")
def label_pairs(fx):
    t = G.label_pairs(G.canonical_topics(fx.enrichment), "topic")
    return t.unionByName(G.label_pairs(G.canonical_entities(fx.enrichment), "key"))


@query("participants", f"""
SELECT discussion_id, author_id, username, display_name, user_message_count, message_count, {sql_iso('first_message_at')} AS first_message_at,
 {sql_iso('last_message_at')} AS last_message_at FROM fx_parts""")
def participants(fx):
    return fx.facts["participants"].select(
        "discussion_id", "author_id", "username", "display_name", "user_message_count", "message_count",
        iso(F.col("first_message_at")).alias("first_message_at"), iso(F.col("last_message_at")).alias("last_message_at"))


@query("nodes_discussion", f"""
SELECT id, channel_id, {sql_iso('started_at')} AS started_at, {sql_iso('ended_at')} AS ended_at, message_count, participant_count, title, summary,
 array_to_string(topics, '|') AS topics, sentiment, sentiment_score, language, discussion_type, resolved, len(embedding) AS dim FROM fx_nodes""")
def nodes_discussion(fx):
    return fx.nodes.select(
        "id", "channel_id", iso(F.col("started_at")).alias("started_at"), iso(F.col("ended_at")).alias("ended_at"),
        "message_count", "participant_count", "title", "summary", F.array_join("topics", "|").alias("topics"), "sentiment",
        "sentiment_score", "language", "discussion_type", "resolved", F.size("embedding").cast("bigint").alias("dim"))


@query("nodes_discussion_other_dim", "SELECT id, true AS no_vector FROM fx_nodes")
def nodes_discussion_other_dim(fx):
    n = G.nodes_discussion(fx.ready, fx.enrichment, fx.facts["participants"], DIM * 6)
    return n.select("id", F.col("embedding").isNull().alias("no_vector"))


@query("nodes_channel", """
SELECT id, coalesce(name, CASE WHEN id <> 'view' THEN 'old ' || id END) AS name, guild_id FROM fx_channels""")
def nodes_channel(fx):
    old = fx.channels.filter("id <> 'view'").select("id", F.concat(F.lit("old "), "id").alias("name"), F.lit(None).cast("string").alias("guild_id"))
    return G.nodes_channel(old, fx.channels.select("id", "name", "guild_id"))


@query("nodes_guild", "SELECT DISTINCT guild_id AS id, 'Guild 0' AS name FROM fx_channels")
def nodes_guild(fx):
    return G.nodes_guild(fx.guilds.select("id", "name"), fx.guilds.select("id", F.lit(None).cast("string").alias("name")))


@query("nodes_user", f"""
SELECT DISTINCT author_id AS id, coalesce(username, 'was ' || author_id) AS username, display_name, {sql_iso('first_seen_at')} AS first_seen_at, user_message_count AS message_count FROM fx_parts""")
def nodes_user(fx):
    old = fx.users.select("id", F.concat(F.lit("was "), "id").alias("username"), F.lit(None).cast("string").alias("display_name"),
                          "last_seen_at", "first_seen_at", "message_count")
    return G.nodes_user(old, fx.facts["participants"]).select(
        "id", "username", "display_name", iso(F.col("first_seen_at")).alias("first_seen_at"), "message_count")


@query("nodes_topic", f"SELECT name, discussion_count, {sql_iso('created_at')} AS created_at FROM fx_tnodes")
def nodes_topic(fx):
    return fx.graph["nodes_topic"].withColumn("created_at", iso(F.col("created_at")))


@query("nodes_entity", f"SELECT key, name, type, mention_count, {sql_iso('created_at')} AS created_at FROM fx_enodes")
def nodes_entity(fx):
    return fx.graph["nodes_entity"].withColumn("created_at", iso(F.col("created_at")))


@query("edges_occurred_in", "SELECT id AS src, channel_id AS dst FROM fx_nodes")
def edges_occurred_in(fx):
    return fx.graph["edges_occurred_in"]


@query("edges_in_guild", "SELECT id AS src, guild_id AS dst FROM fx_channels WHERE id IN (SELECT channel_id FROM fx_nodes)")
def edges_in_guild(fx):
    return fx.graph["edges_in_guild"]


@query("edges_participated_in", f"""
SELECT author_id AS src, discussion_id AS dst, message_count, {sql_iso('first_message_at')} AS first_message_at, {sql_iso('last_message_at')} AS last_message_at FROM fx_parts""")
def edges_participated_in(fx):
    return fx.graph["edges_participated_in"].withColumn("first_message_at", iso(F.col("first_message_at"))).withColumn(
        "last_message_at", iso(F.col("last_message_at")))


@query("edges_discusses", "SELECT discussion_id AS src, topic AS dst FROM fx_topics")
def edges_discusses(fx):
    return fx.graph["edges_discusses"]


@query("edges_mentions", "SELECT discussion_id AS src, key AS dst, count(*) AS count FROM fx_entities GROUP BY 1, 2")
def edges_mentions(fx):
    return fx.graph["edges_mentions"]


@query("edges_topic_cooccurs", f"SELECT a AS src, b AS dst, count(*) AS count, {sql_iso('max(started_at)')} AS last_seen_at FROM fx_tpairs JOIN fx_times USING (discussion_id) GROUP BY 1, 2")
def edges_topic_cooccurs(fx):
    return fx.graph["edges_topic_cooccurs"].withColumn("last_seen_at", iso(F.col("last_seen_at")))


@query("edges_entity_cooccurs", f"SELECT a AS src, b AS dst, count(*) AS count, {sql_iso('max(started_at)')} AS last_seen_at FROM fx_epairs JOIN fx_times USING (discussion_id) GROUP BY 1, 2")
def edges_entity_cooccurs(fx):
    return fx.graph["edges_entity_cooccurs"].withColumn("last_seen_at", iso(F.col("last_seen_at")))


@query("edges_interested_in", f"""
SELECT p.author_id AS src, t.topic AS dst, sum(p.message_count)::BIGINT AS weight, count(*) AS discussion_count, {sql_iso('max(x.ended_at)')} AS last_interaction_at
FROM fx_parts p JOIN fx_topics t USING (discussion_id) JOIN fx_times x USING (discussion_id) GROUP BY 1, 2""")
def edges_interested_in(fx):
    return fx.graph["edges_interested_in"].withColumn("last_interaction_at", iso(F.col("last_interaction_at")))


@query("edges_continuation_of", "SELECT src, dst, 'explicit_reply' AS reason, NULL::DOUBLE AS similarity_score, stub FROM fx_cont")
def edges_continuation_of(fx):
    return fx.graph["edges_continuation_of"]


@query("merge_graph", """
SELECT topic AS name, count(DISTINCT discussion_id) AS discussion_count FROM (
 SELECT t.discussion_id, CASE WHEN d.status = 'written' THEN 'new ' || t.topic ELSE t.topic END AS topic FROM fx_topics t JOIN fx_discussions d ON d.id = t.discussion_id) GROUP BY 1""")
def merge_graph(fx):
    """Rewriting the written discussions with other topics replaces their old counts."""
    _, graph = G.merge_graph(fx.facts, _again(fx), fx.channels, fx.guilds)
    return graph["nodes_topic"].select("name", "discussion_count")


def _again(fx):
    """Facts of the written discussions, with other topics."""
    again = fx.enrichment.join(fx.ready.filter("status = 'written'").select(F.col("id").alias("discussion_id")), "discussion_id", "left_semi")
    again = again.withColumn("topics", F.expr("transform(filter(topics, t -> t <> ''), t -> concat('new ', t))"))
    return G.discussion_facts(fx.ready.filter("status = 'written'"), again, fx.members, fx.users, DIM)


_RETOLD = """
WITH t AS (SELECT t.discussion_id, CASE WHEN d.status = 'written' THEN 'new ' || t.topic ELSE t.topic END AS topic
 FROM fx_topics t JOIN fx_discussions d ON d.id = t.discussion_id)"""


def _touched(fx, table):
    new = fx.key_facts(_again(fx), fx.ready.filter("status = 'written'"))
    return G.merge_touched(fx.stored_facts, Stored(fx.key_graph), new, fx.channels, fx.guilds, [table])[1][table]


@query("merge_touched", f"{_RETOLD} SELECT topic AS name, count(DISTINCT discussion_id) AS discussion_count FROM t GROUP BY 1")
def merge_touched(fx):
    """The same by touched keys: topic nodes of a graph that is not built again."""
    return _touched(fx, "nodes_topic").select("name", "discussion_count")


@query("merge_touched_interests", f"""{_RETOLD}
SELECT p.author_id AS src, t.topic AS dst, sum(p.message_count)::BIGINT AS weight, count(*) AS discussion_count
FROM fx_parts p JOIN t ON t.discussion_id = p.discussion_id GROUP BY 1, 2""")
def merge_touched_interests(fx):
    """Interests after the merge by touched keys."""
    return _touched(fx, "edges_interested_in").select("src", "dst", "weight", "discussion_count")


@query("merge_touched_cooccurs", f"""{_RETOLD}
SELECT a.topic AS src, b.topic AS dst, count(*) AS count FROM t a JOIN t b ON a.discussion_id = b.discussion_id AND a.topic < b.topic GROUP BY 1, 2""")
def merge_touched_cooccurs(fx):
    """Topic pairs after the merge by touched keys."""
    return _touched(fx, "edges_topic_cooccurs").select("src", "dst", "count")


@query("mark_written", """
SELECT m.id, CASE WHEN y.discussion_id IS NOT NULL THEN 3 ELSE m.processed END AS processed FROM fx_slim m LEFT JOIN fx_members y ON y.id = m.id""")
def mark_written(fx):
    linked = fx.slim_messages.drop("discussion_id").join(fx.members.select("id", "discussion_id"), "id", "left")
    return G.mark_written({"discussions": fx.discussions, "messages": linked}, fx.ready.select("id"))["messages"].select("id", "processed")


@query("mark_written_discussions", "SELECT id, CASE WHEN status = 'enriched' THEN 'written' ELSE status END AS status FROM fx_discussions")
def mark_written_discussions(fx):
    state = {"discussions": fx.discussions, "messages": fx.slim_messages}
    return G.mark_written(state, fx.ready.select("id"))["discussions"].select("id", "status")


@query("graph_summary", """
SELECT count(*) FILTER (WHERE e.discussion_id IS NOT NULL) AS written, count(*) FILTER (WHERE e.discussion_id IS NULL) AS skipped_no_enrichment
FROM fx_discussions d LEFT JOIN (SELECT * FROM fx_enrichment WHERE resolved IS NOT NULL) e ON e.discussion_id = d.id WHERE d.status = 'enriched'""")
def graph_summary(fx):
    return G.graph_summary(G.writable(fx.discussions, fx.enrichment.filter("resolved is not null")))


# --- reads -------------------------------------------------------------------------

_OVERVIEW = """
WITH newest AS (SELECT 'Discussion:' || id AS node, started_at FROM fx_nodes ORDER BY started_at DESC, id LIMIT 67),
near AS (SELECT h.*, n.started_at FROM fx_hops h JOIN newest n USING (node) ORDER BY n.started_at DESC, h.node, h.type, h.other, h.src LIMIT 1600),
pool AS (SELECT node, 0 AS tier, started_at AS t FROM newest WHERE node IN (SELECT node FROM near)
 UNION ALL SELECT other, 1, max(started_at) FROM near WHERE other NOT IN (SELECT node FROM newest) GROUP BY 1),
kept AS (SELECT node FROM pool ORDER BY tier, t DESC, node LIMIT 400)
"""


@query("graph_overview", _OVERVIEW + "SELECT DISTINCT type, src, dst FROM near WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)")
def graph_overview(fx):
    return R.graph_overview(fx.stored_graph)[1]


@query("graph_overview_nodes", _OVERVIEW + "SELECT node, label, caption FROM fx_allnodes WHERE node IN (SELECT node FROM kept)")
def graph_overview_nodes(fx):
    return R.graph_overview(fx.stored_graph)[0].select("node", "label", "caption")


@query("neighbors", "SELECT node, other, type, src, dst FROM fx_hops QUALIFY row_number() OVER (PARTITION BY node ORDER BY type, other, src) <= 40")
def neighbors(fx):
    """Neighbours of every node."""
    return R.neighbors(fx.key_graph, G.node_keys(fx.key_graph)).drop("rn")


@query("search_nodes", """
SELECT node, label, matched FROM (
 SELECT 'Topic:' || name AS node, 'Topic' AS label, name AS matched FROM fx_tnodes UNION ALL SELECT 'Entity:' || key, 'Entity', name FROM fx_enodes
 UNION ALL SELECT 'Discussion:' || id, 'Discussion', title FROM fx_nodes UNION ALL SELECT DISTINCT 'User:' || author_id, 'User', username FROM fx_parts
 UNION ALL SELECT DISTINCT 'Guild:' || guild_id, 'Guild', 'Guild 0' FROM fx_channels)
WHERE contains(lower(matched), 'l') ORDER BY label, node LIMIT 50""")
def search_nodes(fx):
    return R.search_nodes(fx.stored_graph, " L ", 50)


@query("node_by_domain_id", "SELECT label, domain_id, node FROM fx_allnodes WHERE label IN ('Topic', 'Channel')")
def node_by_domain_id(fx):
    nodes = G.all_nodes(fx.stored_graph)
    wanted = nodes.filter("label in ('Topic', 'Channel')").select("label", "domain_id").unionByName(
        nodes.select(F.lit("Robot").alias("label"), "domain_id"))
    return R.node_by_domain_id(nodes, wanted)


@query("degrees", "SELECT node, count(*) AS degree FROM fx_hops GROUP BY 1")
def degrees(fx):
    return R.degrees(G.all_edges(fx.key_graph))


@query("captions", "SELECT node, label, caption FROM fx_allnodes")
def captions(fx):
    return G.all_nodes(fx.stored_graph).select("node", "label", "caption")


@query("label_vocab", """
SELECT * FROM (SELECT 'topic' AS kind, name, discussion_count AS uses FROM fx_tnodes ORDER BY uses DESC, name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'entity', name, mention_count AS uses FROM fx_enodes ORDER BY uses DESC, name LIMIT 10)""")
def label_vocab(fx):
    return R.label_vocab(fx.stored_graph, 10)


@query("node_size", "SELECT node, round(4 + 2 * sqrt(count(*)), 6) AS size FROM fx_hops GROUP BY 1")
def node_sizes(fx):
    return R.degrees(G.all_edges(fx.key_graph)).select("node", F.round(node_size(F.col("degree")), 6).alias("size"))
