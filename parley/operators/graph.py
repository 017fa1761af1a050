"""Graph construction: one table per node label and edge type, counters by groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import normalize_label
from parley.operators.ingest import as_ts, upsert
from parley.operators.ordered import row_index
from parley.session import cut

NODE_TABLES = ["nodes_discussion", "nodes_channel", "nodes_guild", "nodes_user", "nodes_topic", "nodes_entity"]
EDGE_TABLES = [
    "edges_occurred_in", "edges_in_guild", "edges_participated_in", "edges_discusses",
    "edges_mentions", "edges_topic_cooccurs", "edges_entity_cooccurs", "edges_interested_in",
    "edges_continuation_of",
]


def writable(
    discussions: DataFrame, enrichment: DataFrame, max_discussions: int | None = None,
    statuses: tuple[str, ...] = ("enriched",),
) -> DataFrame:
    """Discussions to write, by block start, at most N per channel.

    ``has_enrichment`` is false for rows the writer skips and counts.
    """
    ready = discussions.filter(F.col("status").isin(*statuses))
    if max_discussions is not None:
        ready = row_index(ready, ["channel_id"], ["block_start_at", "id"], "_rn").filter(
            F.col("_rn") <= max_discussions).drop("_rn")
    e = enrichment.select(F.col("discussion_id").alias("id"), F.lit(True).alias("_e"))
    return ready.join(e, "id", "left").withColumn(
        "has_enrichment", F.coalesce("_e", F.lit(False))).drop("_e")


def canonical_topics(enrichment: DataFrame) -> DataFrame:
    """Distinct topics per discussion, ignoring case; the first spelling stays.

    Returns discussion_id, pos, topic.
    """
    items = enrichment.select("discussion_id", F.posexplode("topics").alias("pos", "raw")).withColumn(
        "topic", normalize_label(F.col("raw"))).filter("topic <> ''")
    return items.groupBy("discussion_id", F.lower("topic").alias("_k")).agg(
        F.min("pos").alias("pos"), F.min_by("topic", "pos").alias("topic")).drop("_k")


def canonical_entities(enrichment: DataFrame) -> DataFrame:
    """Distinct entities per discussion, keyed ``type:lower(name)``.

    Returns discussion_id, pos, key, name, type.
    """
    items = enrichment.select("discussion_id", F.posexplode("entities").alias("pos", "raw"))
    kind = F.lower(normalize_label(F.coalesce("raw.type", F.lit(""))))
    named = items.select(
        "discussion_id", "pos", normalize_label(F.col("raw.name")).alias("name"),
        F.when(kind == "", F.lit("other")).otherwise(kind).alias("type")).filter("name <> ''")
    keyed = named.withColumn("key", F.concat_ws(":", "type", F.lower("name")))
    return keyed.groupBy("discussion_id", "key").agg(
        F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), F.min("type").alias("type"))


def label_pairs(labels: DataFrame, col: str, max_terms: int | None = None) -> DataFrame:
    """Unordered label pairs a < b of every discussion.

    ``max_terms`` leaves out discussions with more labels, before they are gathered. The
    labels of one discussion are what one model reply holds, so their pairs are made in place.
    """
    if max_terms is not None:
        few = labels.groupBy("discussion_id").count().filter(F.col("count") <= max_terms)
        labels = labels.join(few, "discussion_id", "left_semi")
    small = labels.groupBy("discussion_id").agg(
        F.sort_array(F.collect_set(col)).alias("ls"))
    firsts = small.select("discussion_id", "ls", F.posexplode("ls").alias("i", "a"))
    rest = F.slice("ls", F.col("i") + 2, F.greatest(F.lit(0), F.size("ls") - F.col("i") - 1))
    return firsts.select("discussion_id", "a", F.explode(rest).alias("b"))


def participants(members: DataFrame, users: DataFrame) -> DataFrame:
    """Message count and span per (discussion, author), with the author's user row."""
    agg = members.groupBy("discussion_id", "author_id").agg(
        F.count("*").alias("message_count"), F.min("created_at").alias("first_message_at"),
        F.max("created_at").alias("last_message_at"))
    u = users.select(
        F.col("id").alias("author_id"), "username", "display_name", "first_seen_at", "last_seen_at",
        F.col("message_count").alias("_uc"))
    return agg.join(u, "author_id", "left").withColumn(
        "user_message_count", F.coalesce("_uc", "message_count")).drop("_uc")


def nodes_discussion(ready: DataFrame, enrichment: DataFrame, parts: DataFrame, dim: int) -> DataFrame:
    """Discussion nodes. A vector of another dimension than the index is left out."""
    totals = parts.groupBy(F.col("discussion_id").alias("id")).agg(
        F.sum("message_count").alias("message_count"), F.count("*").alias("participant_count"))
    topics = canonical_topics(enrichment).groupBy(F.col("discussion_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "topic"))), lambda x: x["topic"]).alias("topics"))
    e = enrichment.withColumnRenamed("discussion_id", "id").drop("topics")
    return (
        ready.select("id", "channel_id", F.col("block_start_at").alias("started_at"),
                     F.col("block_end_at").alias("ended_at"))
        .join(e, "id").join(totals, "id", "left").join(topics, "id", "left")
        .select(
            "id", "channel_id", "started_at", "ended_at",
            F.coalesce("message_count", F.lit(0)).alias("message_count"),
            F.coalesce("participant_count", F.lit(0)).alias("participant_count"),
            "title", "summary", F.coalesce("topics", F.expr("cast(array() as array<string>)")).alias("topics"),
            "sentiment", "sentiment_score", "language", "discussion_type", "resolved",
            F.when(F.size("embedding") == dim, F.col("embedding")).alias("embedding"))
    )


def nodes_channel(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Channel nodes (id, name, guild_id); a known name or guild never turns null."""
    return upsert(existing, incoming, "id", {
        "name": F.coalesce("n.name", "e.name"), "guild_id": F.coalesce("n.guild_id", "e.guild_id")})


def nodes_guild(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Guild nodes (id, name); a known name never turns null."""
    return upsert(existing, incoming, "id", {"name": F.coalesce("n.name", "e.name")})


def nodes_user(existing: DataFrame, parts: DataFrame) -> DataFrame:
    """User nodes; known names and seen times stay where the new row has none."""
    cols = ["username", "display_name", "first_seen_at", "last_seen_at"]
    incoming = parts.groupBy(F.col("author_id").alias("id")).agg(
        *[F.max(c).alias(c) for c in cols], F.max("user_message_count").alias("message_count"))
    return upsert(existing, incoming, "id", {
        **{c: F.coalesce(f"n.{c}", f"e.{c}") for c in cols},
        "message_count": F.coalesce("n.message_count", "e.message_count")})


def nodes_topic(topics: DataFrame, times: DataFrame) -> DataFrame:
    """Topic nodes: how many discussions name it, and when it first came up."""
    return topics.join(times, "discussion_id").groupBy(F.col("topic").alias("name")).agg(
        F.count_distinct("discussion_id").alias("discussion_count"), F.min("started_at").alias("created_at"))


def nodes_entity(entities: DataFrame, times: DataFrame) -> DataFrame:
    """Entity nodes: how often mentioned; name and type from the earliest mention."""
    first = F.struct("started_at", "discussion_id")
    return entities.join(times, "discussion_id").groupBy("key").agg(
        F.min_by("name", first).alias("name"), F.min_by("type", first).alias("type"),
        F.count("*").alias("mention_count"), F.min("started_at").alias("created_at"))


def edges_occurred_in(discussions: DataFrame) -> DataFrame:
    return discussions.select(F.col("id").alias("src"), F.col("channel_id").alias("dst"))


def edges_in_guild(channels: DataFrame) -> DataFrame:
    return channels.filter("guild_id is not null").select(
        F.col("id").alias("src"), F.col("guild_id").alias("dst")).distinct()


def edges_participated_in(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("author_id").alias("src"), F.col("discussion_id").alias("dst"),
                        "message_count", "first_message_at", "last_message_at")


def edges_discusses(topics: DataFrame) -> DataFrame:
    return topics.select(F.col("discussion_id").alias("src"), F.col("topic").alias("dst")).distinct()


def edges_mentions(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.col("discussion_id").alias("src"), F.col("key").alias("dst")).agg(
        F.count("*").alias("count"))


def edges_cooccurs(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """Label pairs: in how many discussions, and when last."""
    return pairs.join(times, "discussion_id").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(
        F.count("*").alias("count"), F.max("started_at").alias("last_seen_at"))


def edges_interested_in(parts: DataFrame, topics: DataFrame, times: DataFrame) -> DataFrame:
    """User to topic: messages in its discussions, how many of them, and the last one."""
    t = topics.select("discussion_id", "topic").join(times, "discussion_id")
    return parts.select("discussion_id", "author_id", "message_count").join(t, "discussion_id").groupBy(
        F.col("author_id").alias("src"), F.col("topic").alias("dst")).agg(
        F.sum("message_count").alias("weight"), F.count("*").alias("discussion_count"),
        F.max("ended_at").alias("last_interaction_at"))


def edges_continuation_of(ready: DataFrame, known: DataFrame) -> DataFrame:
    """Continuation edges; ``stub`` marks a target that is not written yet."""
    k = known.select(F.col("id").alias("dst"), F.lit(True).alias("_k"))
    nul = F.lit(None).cast("double")
    e = ready.filter("continuation_of_discussion_id is not null").select(
        F.col("id").alias("src"), F.col("continuation_of_discussion_id").alias("dst"),
        F.coalesce("continuation_reason", F.lit("explicit_reply")).alias("reason"),
        nul.alias("similarity_score"))
    return e.join(k, "dst", "left").withColumn("stub", F.col("_k").isNull()).drop("_k")


def discussion_facts(
    ready: DataFrame, enrichment: DataFrame, members: DataFrame, users: DataFrame, dim: int
) -> dict[str, DataFrame]:
    """Per-discussion facts from which every graph table is an aggregate."""
    ready = ready.filter("has_enrichment")
    e = enrichment.join(ready.select(F.col("id").alias("discussion_id")), "discussion_id", "left_semi")
    m = members.join(ready.select(F.col("id").alias("discussion_id")), "discussion_id", "left_semi")
    parts = participants(m, users)
    return {
        "discussions": nodes_discussion(ready, e, parts, dim),
        "participants": parts,
        "topics": canonical_topics(e),
        "entities": canonical_entities(e),
        "links": ready.select("id", "continuation_of_discussion_id", "continuation_reason"),
    }


FACT_KEY = {"discussions": "id", "links": "id", "participants": "discussion_id",
            "topics": "discussion_id", "entities": "discussion_id"}


def merge_facts(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Facts after an incremental write: a rewritten discussion replaces its old facts."""
    ids = new["discussions"].select("id")
    out = {}
    for name, key in FACT_KEY.items():
        gone = ids.select(F.col("id").alias(key))
        out[name] = old[name].join(gone, key, "left_anti").unionByName(new[name])
    return out


def build_graph(
    facts: dict[str, DataFrame], channels: DataFrame, guilds: DataFrame,
    max_terms: int | None = None,
) -> dict[str, DataFrame]:
    """All node and edge tables from the current facts; counters cannot drift.

    Labels pair in any number; ``max_terms`` leaves out discussions with more (``label_pairs``).
    """
    d, parts, topics, entities = (facts[k] for k in ("discussions", "participants", "topics", "entities"))
    times = d.select(F.col("id").alias("discussion_id"), "started_at", "ended_at")
    used = d.select(F.col("channel_id").alias("id")).distinct().join(
        channels.select("id", "name", "guild_id"), "id", "left")
    seen = used.filter("guild_id is not null").select(F.col("guild_id").alias("id")).distinct().join(
        guilds.select("id", "name"), "id", "left")
    no_user = parts.sparkSession.createDataFrame([], (
        "id string, username string, display_name string, first_seen_at timestamp, "
        "last_seen_at timestamp, message_count bigint"))
    return {
        "nodes_discussion": d, "nodes_channel": used, "nodes_guild": seen,
        "nodes_user": nodes_user(no_user, parts), "nodes_topic": nodes_topic(topics, times),
        "nodes_entity": nodes_entity(entities, times),
        "edges_occurred_in": edges_occurred_in(d), "edges_in_guild": edges_in_guild(used),
        "edges_participated_in": edges_participated_in(parts),
        "edges_discusses": edges_discusses(topics), "edges_mentions": edges_mentions(entities),
        "edges_topic_cooccurs": edges_cooccurs(label_pairs(topics, "topic", max_terms), times),
        "edges_entity_cooccurs": edges_cooccurs(label_pairs(entities, "key", max_terms), times),
        "edges_interested_in": edges_interested_in(parts, topics, times),
        "edges_continuation_of": edges_continuation_of(facts["links"], d),
    }


def merge_graph(
    old: dict[str, DataFrame], new: dict[str, DataFrame], channels: DataFrame, guilds: DataFrame
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Merge new facts and rebuild the tables: (facts, graph)."""
    facts = merge_facts(old, new)
    return facts, build_graph(facts, channels, guilds)


#: Key columns of each graph table; tables of discussions are keyed by the discussion alone.
GRAPH_KEY = {
    "nodes_discussion": ["id"], "nodes_channel": ["id"], "nodes_guild": ["id"], "nodes_user": ["id"], "nodes_topic": ["name"],
    "nodes_entity": ["key"], "edges_occurred_in": ["src"], "edges_in_guild": ["src", "dst"], "edges_participated_in": ["dst"],
    "edges_discusses": ["src"], "edges_mentions": ["src"], "edges_topic_cooccurs": ["src", "dst"],
    "edges_entity_cooccurs": ["src", "dst"], "edges_interested_in": ["src", "dst"], "edges_continuation_of": ["src"],
}


#: Node tables whose touched keys tell which facts a table of several discussions is derived from.
GRAPH_HOLDERS = {"edges_topic_cooccurs": ["nodes_topic"], "edges_entity_cooccurs": ["nodes_entity"],
                 "edges_interested_in": ["nodes_topic", "nodes_user"]}


def touched_keys(
    old: dict[str, DataFrame], new: dict[str, DataFrame], channels: DataFrame, guilds: DataFrame
) -> dict[str, DataFrame]:
    """Per graph table the keys that the discussions in ``new`` have now or had in ``old``.

    The graph of the changed discussions alone, before and after, has exactly these keys. A
    continuation edge is also touched when its target is written for the first time.
    """
    ids = new["discussions"].select("id").unionByName(new["links"].select("id")).distinct()
    had = {n: old[n].join(ids.select(F.col("id").alias(k)), k, "left_semi") for n, k in FACT_KEY.items()}
    before, after = build_graph(had, channels, guilds), build_graph(new, channels, guilds)
    out = {t: before[t].select(*k).unionByName(after[t].select(*k)).distinct() for t, k in GRAPH_KEY.items()}
    waiting = old["links"].join(ids.select(F.col("id").alias("continuation_of_discussion_id")), "continuation_of_discussion_id", "left_semi")
    changed = {t: ids.select(F.col("id").alias(k[0])) for t, k in GRAPH_KEY.items() if t in (
        "nodes_discussion", "edges_occurred_in", "edges_participated_in", "edges_discusses", "edges_mentions")}
    links = ids.select(F.col("id").alias("src")).unionByName(waiting.select(F.col("id").alias("src"))).distinct()
    return {**out, **changed, "edges_continuation_of": links}


def merge_touched(
    old: dict[str, DataFrame], graph: dict[str, DataFrame], new: dict[str, DataFrame], channels: DataFrame, guilds: DataFrame,
    tables: list[str] | None = None,
) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """Merge new facts into an existing graph by touched keys: (facts, graph, rewritten rows per table).

    ``tables`` names the tables to merge, all by default.

    Only rows of touched keys are taken out of a table and put back, derived anew from all
    discussions that hold them; every other row passes as it is. Facts are cut to touched labels,
    users and discussions before anything is joined or paired, so the work follows the delta and
    the discussions that share a key with it. The result equals a rebuild.
    """
    chosen = {t: k for t, k in GRAPH_KEY.items() if tables is None or t in tables}
    needed = {t for table in chosen for t in (table, *GRAPH_HOLDERS.get(table, ()))}
    touched = {t: cut(k) for t, k in touched_keys(old, new, channels, guilds).items() if t in needed}
    facts = merge_facts(old, new)

    def holding(name: str, column: str, table: str, key: str) -> DataFrame:
        if table not in touched:
            return facts[name]  # no table to merge is made of it
        return facts[name].join(touched[table].select(F.col(key).alias(column)), column, "left_semi").select(*facts[name].columns)

    near = {
        "discussions": facts["discussions"], "topics": holding("topics", "topic", "nodes_topic", "name"),
        "entities": holding("entities", "key", "nodes_entity", "key"), "participants": holding("participants", "author_id", "nodes_user", "id"),
        "links": holding("links", "id", "edges_continuation_of", "src"),
    }
    by_label = build_graph(near, channels, guilds)
    by_id = build_graph({**near, **{n: new[n] for n in ("topics", "entities", "participants")}}, channels, guilds)
    own = {"edges_participated_in", "edges_discusses", "edges_mentions"}  # rows of the changed discussions alone
    rewritten = {}
    for table, key in chosen.items():
        source = by_id if table in own else by_label
        rewritten[table] = cut(source[table].join(touched[table], key, "left_semi").select(*graph[table].columns))
    merged = {t: graph[t].join(touched[t], k, "left_anti").select(*graph[t].columns).unionByName(rewritten[t]) for t, k in chosen.items()}
    return facts, merged, rewritten


def mark_written(state: dict[str, DataFrame], written: DataFrame) -> dict[str, DataFrame]:
    """Discussions in ``written`` (column id) become written, their messages state 3."""
    d, m = state["discussions"], state["messages"]
    ids = written.select("id", F.lit(True).alias("_w"))
    status = F.when(F.col("_w"), F.lit("written")).otherwise(F.col("status"))
    of = written.select(F.col("id").alias("discussion_id"), F.lit(True).alias("_w"))
    done = F.when(F.col("_w"), F.lit(3)).otherwise(F.col("processed"))
    return {
        **state,
        "discussions": d.join(ids, "id", "left").withColumn("status", status).select(*d.columns),
        "messages": m.join(of, "discussion_id", "left").withColumn("processed", done).select(*m.columns),
    }


def graph_summary(ready: DataFrame) -> DataFrame:
    return ready.agg(F.count_if("has_enrichment").alias("written"),
                     F.count_if(~F.col("has_enrichment")).alias("skipped_no_enrichment"))


# --- generic views -------------------------------------------------------------------

# fixed values: node label, key column, and where captions come from
NODE_VIEW = {
    "nodes_discussion": ("Discussion", "id", ["title", "summary"], "(diskuze bez názvu)"),
    "nodes_topic": ("Topic", "name", ["name"], "(bez názvu)"),
    "nodes_entity": ("Entity", "key", ["name"], "(bez názvu)"),
    "nodes_user": ("User", "id", ["display_name", "username"], "(uživatel)"),
    "nodes_channel": ("Channel", "id", ["name"], "(kanál)"),
    "nodes_guild": ("Guild", "id", ["name"], "(server)"),
}
# fixed values: edge type with the labels of its ends
EDGE_VIEW = {
    "edges_occurred_in": ("OCCURRED_IN", "Discussion", "Channel"),
    "edges_in_guild": ("IN_GUILD", "Channel", "Guild"),
    "edges_participated_in": ("PARTICIPATED_IN", "User", "Discussion"),
    "edges_discusses": ("DISCUSSES", "Discussion", "Topic"),
    "edges_mentions": ("MENTIONS", "Discussion", "Entity"),
    "edges_topic_cooccurs": ("COOCCURS_WITH", "Topic", "Topic"),
    "edges_entity_cooccurs": ("COOCCURS_WITH", "Entity", "Entity"),
    "edges_interested_in": ("INTERESTED_IN", "User", "Topic"),
    "edges_continuation_of": ("CONTINUATION_OF", "Discussion", "Discussion"),
}


def node_key(label: str, col: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), col)


def all_nodes(graph: dict[str, DataFrame]) -> DataFrame:
    """One table of all nodes: node, label, domain_id, caption. Continuation stubs are included."""
    out = None
    for table, (label, key, caption, blank) in NODE_VIEW.items():
        shown = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in caption]
        df = graph[table].select(
            node_key(label, F.col(key)).alias("node"), F.lit(label).alias("label"),
            F.col(key).alias("domain_id"), F.coalesce(*shown, F.lit(blank)).alias("caption"))
        out = df if out is None else out.unionByName(df)
    stubs = graph["edges_continuation_of"].filter("stub").select("dst").distinct().select(
        node_key("Discussion", F.col("dst")).alias("node"), F.lit("Discussion").alias("label"),
        F.col("dst").alias("domain_id"), F.lit(NODE_VIEW["nodes_discussion"][3]).alias("caption"))
    return out.unionByName(stubs)


def node_keys(graph: dict[str, DataFrame]) -> DataFrame:
    """The keys of all nodes, from the key columns alone."""
    out = graph["edges_continuation_of"].filter("stub").select(node_key("Discussion", F.col("dst")).alias("node")).distinct()
    for table, (label, key, _, _) in NODE_VIEW.items():
        out = out.unionByName(graph[table].select(node_key(label, F.col(key)).alias("node")))
    return out


def all_edges(graph: dict[str, DataFrame]) -> DataFrame:
    """One table of all edges: type, src, dst as node keys."""
    out = None
    for table, (kind, a, b) in EDGE_VIEW.items():
        df = graph[table].select(F.lit(kind).alias("type"), node_key(a, F.col("src")).alias("src"),
                                 node_key(b, F.col("dst")).alias("dst"))
        out = df if out is None else out.unionByName(df)
    return out
