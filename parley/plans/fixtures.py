"""Fixture views over the driver tables, as DataFrames.

Every view covers whole tables and whole texts. ``fixture_sql`` defines the same
views for the SQL side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import word_count
from parley.session import cut, stored

NOW = "2024-02-01 00:00:00"
WORD_LIMIT = 6
TAU = 0.15
DIM = 64
MIN_SCORE = 0.15

_CHANNELS = "array('click', 'error', 'purchase', 'signup', 'view')"
_TYPES = "array('question', 'help-request', 'discussion', 'announcement', 'off-topic', 'banter', 'other')"
_INTENTS = "array('opinion', 'troubleshooting', 'factual', 'summary', 'person-activity', 'timeline', 'other')"
_SENTIMENTS = "array('positive', 'neutral', 'negative', 'mixed')"


class Stored(dict):
    """Tables that are written out when first read, and then read from there."""

    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__(tables)
        self._written: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._written:
            self._written[name] = stored(super().__getitem__(name))
        return self._written[name]


class Fx:
    """Fixture views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def nd(self) -> int:
        return self.table("documents").count()

    @cached_property
    def ne(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def gap(self) -> int:
        """Silence that ends a block, in minutes: shorter where events are denser, so that most blocks close."""
        return min(30, max(1, 300_000 // max(1, self.table("events").count())))

    @property
    def idle(self) -> float:
        return self.gap / 2

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.date_trunc("millisecond", F.col("ts").cast("timestamp")))

    # --- messages -------------------------------------------------------------

    def _message_columns(self, df: DataFrame, *extra) -> DataFrame:
        return df.select(
            F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("channel_id"),
            F.lit("g0").alias("guild_id"), F.col("user_id").cast("string").alias("author_id"), *extra,
            F.col("ts").alias("created_at"),
            F.expr("case when event_id % 3 = 1 and event_id >= 5 * (1 + event_id % 12) "
                   "then cast(event_id - 5 * (1 + event_id % 12) as string) end").alias("reply_to_message_id"),
            F.expr("case when event_id % 17 = 0 then concat('t-', event_type, '-', user_id % 7) end").alias("thread_id"),
            F.expr("case when event_id % 5 = 0 then array(cast(user_id + 1 as string)) end").alias("mentions"),
            F.expr("cast(event_id % 3 as int)").alias("attachments_count"),
            F.expr("case event_id % 20 when 7 then 1 when 13 then 3 else 0 end").alias("processed"),
            F.expr(f"case when event_id % 20 in (7, 13) then concat('d', event_id % {self.ne}) end").alias("discussion_id"),
            F.expr("ts + interval 1 second").alias("ingested_at"),
        )

    @cached_property
    def slim_messages(self) -> DataFrame:
        """Messages without their text."""
        return self._message_columns(self.events)

    def _with_text(self, events: DataFrame, *keep: str) -> DataFrame:
        """Messages of some events with ``content`` and ``word_count``, and the columns ``keep``.

        Events that take a document, a turn or their own properties are joined apart: a key that
        most of them have not, and that would be one key of nulls, is never joined on.
        """
        conv = self.table("conversations")
        nconv = conv.agg(F.count_distinct("conv_id")).first()[0]
        turns = conv.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("_turns"))
        # words are counted per text, before texts are spread over messages
        docs = self.table("documents").select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"),
                                              word_count(F.col("text")).alias("_words"))
        said = conv.select(F.col("conv_id").alias("_c2"), F.col("turn").alias("_turn"), F.col("text").alias("_text"),
                           word_count(F.col("text")).alias("_words"))
        # running numbers of the events that take a document and of those that take a turn, so
        # that every document and every turn is met
        said_no = "(event_id div 4 * 2 + event_id % 4 - 2)"
        by_doc = events.filter("event_id % 4 = 1").withColumn("_doc", F.expr(f"(event_id div 4) % {self.nd}")).join(docs, "_doc", "left")
        by_turn = events.filter("event_id % 4 > 1").withColumn("_conv", F.expr(f"{said_no} % {nconv}")).join(turns, "_conv", "left")
        by_turn = by_turn.withColumn("_turn", F.expr(f"({said_no} div {nconv}) % _turns"))
        by_turn = by_turn.join(said, (F.col("_conv") == F.col("_c2")) & (by_turn["_turn"] == said["_turn"]), "left")
        own = events.filter("coalesce(event_id % 4, 0) < 1").withColumn("_text", F.lit(None).cast("string")).withColumn(
            "_words", F.lit(None).cast("int"))
        parts = [self._message_columns(
            ev, F.coalesce("_text", "props").alias("content"),
            F.coalesce("_words", word_count(F.col("props"))).alias("word_count"), *keep) for ev in (by_doc, by_turn, own)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @cached_property
    def messages(self) -> DataFrame:
        return self._with_text(self.events)

    @cached_property
    def vectors(self) -> DataFrame:
        """Message id and vector."""
        e = self.table("embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vec"))
        ev = self.table("events").select(
            F.col("event_id").cast("string").alias("id"), F.expr(f"event_id % {self.ne}").alias("_v"))
        return ev.join(e, "_v").drop("_v")

    @cached_property
    def users(self) -> DataFrame:
        u = self.events.groupBy("user_id").agg(
            F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("message_count"))
        return u.select(
            F.col("user_id").cast("string").alias("id"),
            F.expr("case when user_id % 4 <> 0 then concat('user', user_id) end").alias("username"),
            F.expr("case when user_id % 3 <> 0 then concat('User ', user_id) end").alias("display_name"),
            "first_seen_at", "last_seen_at", "message_count",
            F.lit(None).cast("timestamp").alias("names_synced_at"))

    @cached_property
    def channels(self) -> DataFrame:
        t = F.expr("timestamp '2024-01-01'")
        return self.table("events").select("event_type").distinct().select(
            F.col("event_type").alias("id"), F.lit("g0").alias("guild_id"),
            F.expr("case when event_type <> 'error' then concat('ch-', event_type) end").alias("name"),
            F.lit("text").alias("type"), t.alias("created_at"), t.alias("updated_at"),
            F.lit(None).cast("timestamp").alias("names_synced_at"))

    @cached_property
    def guilds(self) -> DataFrame:
        return self.channels.select(F.col("guild_id").alias("id")).distinct().select(
            "id", F.lit("Guild 0").alias("name"), F.expr("timestamp '2024-01-01'").alias("created_at"),
            F.lit(None).cast("timestamp").alias("names_synced_at"))

    # --- discussions ----------------------------------------------------------

    @cached_property
    def discussions(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", "label")
        return e.select(
            F.expr("concat('d', vec_id)").alias("id"),
            F.expr(f"element_at({_CHANNELS}, cast(label % 5 as int) + 1)").alias("channel_id"),
            F.lit(None).cast("string").alias("thread_id"),
            F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(vec_id as int))").alias("block_start_at"),
            F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(vec_id as int), 30)").alias("block_end_at"),
            F.expr("case when vec_id % 10 = 0 then 'split' when vec_id % 10 = 1 then 'clustering' "
                   "when vec_id % 10 = 2 then 'needs_reenrichment' when vec_id % 10 <= 6 then 'enriched' "
                   "else 'written' end").alias("status"),
            F.expr("vec_id % 41").alias("message_count"),
            F.lit(None).cast("array<float>").alias("centroid"),
            F.expr("case when vec_id % 6 = 5 and vec_id >= 7 then concat('d', vec_id - 7) end")
            .alias("continuation_of_discussion_id"),
            F.lit(None).cast("string").alias("continuation_reason"),
            F.expr("case when vec_id % 10 in (3, 4) then concat('d', vec_id - vec_id % 10) end")
            .alias("parent_discussion_id"))

    @cached_property
    def enrichment(self) -> DataFrame:
        # every document is part of a summary: those of one rest are joined, the first gives the labels
        rank = "((vec_id div 10) * 7 + vec_id % 10 - 3)"
        talks = min(self.nd, (self.ne // 10) * 7 + max(0, self.ne % 10 - 3))
        docs = self.table("documents").groupBy(F.expr(f"doc_id % {talks}").alias("_talk")).agg(
            F.min_by("lang", "doc_id").alias("lang"), F.min_by("source", "doc_id").alias("source"),
            F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("_texts")).withColumn(
            "text", F.array_join(F.col("_texts.text"), " "))
        e = self.table("embeddings").filter("vec_id % 10 >= 3").withColumn("_talk", F.expr(f"{rank} % {talks}"))
        return e.join(docs, "_talk").select(
            F.expr("concat('d', vec_id)").alias("discussion_id"),
            F.expr("concat('Talk ', vec_id, ' ', source)").alias("title"), F.col("text").alias("summary"),
            F.expr("array(concat('topic ', label), concat(' Topic  ', label, ' '), concat('lang ', lang), '')").alias("topics"),
            F.expr("array(named_struct('name', source, 'type', 'product'), "
                   "named_struct('name', upper(source), 'type', ' Product '), "
                   "named_struct('name', lang, 'type', ''))").alias("entities"),
            F.expr("case when vec_id % 8 <> 0 then array(concat('kp ', vec_id % 3)) end").alias("key_points"),
            F.expr(f"element_at({_SENTIMENTS}, cast(vec_id % 4 as int) + 1)").alias("sentiment"),
            F.expr("(cast(vec_id % 21 as double) - 10) / 10").alias("sentiment_score"),
            F.col("lang").alias("language"),
            F.expr(f"element_at({_TYPES}, cast(vec_id % 7 as int) + 1)").alias("discussion_type"),
            F.expr("case vec_id % 3 when 0 then true when 1 then false end").alias("resolved"),
            "embedding", F.lit("{}").alias("raw_response"), F.expr("timestamp '2024-01-15'").alias("enriched_at"))

    @cached_property
    def members(self) -> DataFrame:
        """Messages of enriched and written discussions: discussion_id, id, author_id, created_at."""
        return self.events.filter(f"(event_id % {self.ne}) % 10 >= 3").select(
            F.expr(f"concat('d', event_id % {self.ne})").alias("discussion_id"),
            F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("author_id"),
            F.col("ts").alias("created_at"))

    @cached_property
    def member_rows(self) -> DataFrame:
        """Messages linked to enriched and written discussions, without text but with what ``said`` needs to find it."""
        # linked while rows are narrow: a text is moved once, to its message
        of = self.members.select(F.col("discussion_id").alias("_member_of"), F.col("id").alias("_id"))
        linked = self.events.join(of, F.col("event_id").cast("string") == F.col("_id")).drop("_id")
        return linked.select(
            "*", F.col("_member_of").alias("discussion_id"), F.col("event_id").cast("string").alias("id"),
            F.col("user_id").cast("string").alias("author_id"), F.col("ts").alias("created_at"))

    def said(self, rows: DataFrame) -> DataFrame:
        """Some of ``member_rows``, with their author labels, as messages with text."""
        return self._with_text(rows, "_member_of", "author_label").drop("discussion_id").withColumnRenamed("_member_of", "discussion_id")

    @cached_property
    def member_messages(self) -> DataFrame:
        """Messages with text, linked to enriched and written discussions."""
        return self._with_text(self.member_rows, "_member_of").drop("discussion_id").withColumnRenamed("_member_of", "discussion_id")

    # --- graph ----------------------------------------------------------------

    @cached_property
    def ready(self) -> DataFrame:
        from parley.operators.graph import writable

        return writable(self.discussions, self.enrichment, statuses=("enriched", "written"))

    @cached_property
    def facts(self) -> dict[str, DataFrame]:
        from parley.operators.graph import discussion_facts

        return discussion_facts(self.ready, self.enrichment, self.members, self.users, DIM)

    @cached_property
    def graph(self) -> dict[str, DataFrame]:
        from parley.operators.graph import build_graph

        return build_graph(self.facts, self.channels, self.guilds)

    @cached_property
    def stored_graph(self) -> Stored:
        """Graph tables as a writer leaves them, for the read queries."""
        return Stored(self.graph)

    def key_facts(self, facts: dict[str, DataFrame], ready: DataFrame) -> Stored:
        """Facts as a writer leaves them, each derived once, for graph tables without texts.

        Of discussions they hold what edges, labels and users are made of; title, summary and vector are
        neither joined nor written.
        """
        slim = ready.filter("has_enrichment").select(
            "id", "channel_id", F.col("block_start_at").alias("started_at"), F.col("block_end_at").alias("ended_at"))
        return Stored({**facts, "discussions": slim})

    @cached_property
    def stored_facts(self) -> Stored:
        return self.key_facts(self.facts, self.ready)

    @cached_property
    def key_graph(self) -> dict[str, DataFrame]:
        """Graph tables over the stored facts; discussions without their texts."""
        from parley.operators.graph import build_graph

        return build_graph(self.stored_facts, self.channels, self.guilds)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.graph["nodes_discussion"]

    # --- questions --------------------------------------------------------------

    @cached_property
    def questions(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "source")
        e = self.table("embeddings").withColumn("doc_id", F.expr(f"vec_id % {self.nd}")).join(docs, "doc_id")
        return cut(e.select(
            F.col("vec_id").alias("question_id"),
            F.expr("concat('What about topic ', label, ' in case ', vec_id, '?')").alias("question"),
            F.expr("array(concat(' what about TOPIC ', label, ' in case ', vec_id, '? '), concat('topic ', label), "
                   "concat('Topic ', label), '', source, 'latest news', 'more')").alias("search_queries"),
            F.col("embedding").alias("vec"), F.expr("array(concat('topic ', label))").alias("topics"),
            F.expr("array(source)").alias("entities"),
            F.expr(f"element_at({_INTENTS}, cast(vec_id % 7 as int) + 1)").alias("intent"),
            F.expr(f"array(element_at({_TYPES}, cast(vec_id % 7 as int) + 1))").alias("preferred_types"),
            F.expr(f"case when vec_id % 4 = 1 then array(element_at({_CHANNELS}, cast(label % 5 as int) + 1)) end")
            .alias("channel_ids"),
            F.expr("case when vec_id % 4 = 2 then array('announcement') end").alias("discussion_types"),
            F.expr("case when vec_id % 10 = 3 then timestamp '2030-01-01' end").alias("since"),
            F.expr("case when vec_id % 2 = 0 then 'cs' else 'en' end").alias("answer_language")))

    @cached_property
    def variants(self) -> DataFrame:
        """Two vectors per question: its own and another one."""
        e = self.table("embeddings").select("vec_id", "embedding")
        own = e.select(F.col("vec_id").alias("question_id"), F.lit(1).alias("variant_no"), F.col("embedding").alias("vec"))
        other = e.select(F.expr(f"(vec_id + {self.ne} - 20) % {self.ne}").alias("question_id"),
                         F.lit(2).alias("variant_no"), F.col("embedding").alias("vec"))
        return own.unionByName(other)

    @cached_property
    def asked(self) -> DataFrame:
        return self.variants.join(
            self.questions.select("question_id", "channel_ids", "discussion_types", "since"), "question_id")

    # --- logs and threads --------------------------------------------------------

    def with_prompts(self, calls: DataFrame) -> DataFrame:
        """Log rows, told by their ``doc_id``, with the prompt that was sent."""
        docs = self.table("documents").select("doc_id", F.col("text").alias("user_prompt"))
        return calls.join(docs, "doc_id", "left").drop("doc_id")

    @cached_property
    def slim_calls(self) -> DataFrame:
        """The inference log without its prompts."""
        return self.events.select(
            F.expr(f"event_id % {self.nd}").alias("doc_id"),
            F.col("event_id").cast("string").alias("id"), F.expr("concat('p', event_id % 2)").alias("provider"),
            F.col("event_type").alias("model"), F.col("props").alias("context"), F.col("event_type").alias("channel_id"),
            F.expr("concat('j', event_id % 50)").alias("job_id"), F.col("ts").alias("started_at"),
            F.expr("cast(floor(value * 100) as bigint)").alias("duration_ms"),
            F.expr("case when event_id % 13 = 0 then 'error' else 'ok' end").alias("status"),
            F.expr("case when event_id % 10 <> 0 then event_id % 1000 end").alias("prompt_tokens"),
            F.lit(None).cast("bigint").alias("completion_tokens"), F.lit(None).cast("string").alias("error"),
            F.lit("system").alias("system_prompt"), F.col("props").alias("response"))

    @cached_property
    def calls(self) -> DataFrame:
        return self.with_prompts(self.slim_calls)

    @cached_property
    def thread_discussions(self) -> DataFrame:
        c = self.table("conversations").groupBy("conv_id").agg(F.count("*").alias("messages"))
        return c.select(
            F.expr("concat('v', conv_id)").alias("id"), F.expr("concat('c', conv_id % 5)").alias("channel_id"),
            F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(conv_id as int))").alias("block_start_at"),
            "messages")

    @cached_property
    def threads(self) -> DataFrame:
        """Conversation turns as messages: discussion_id, id, author_label, created_at, content, turn."""
        at = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(conv_id as int), cast(turn as int))"
        return self.table("conversations").select(
            F.expr("concat('v', conv_id)").alias("discussion_id"), F.expr("concat('v', conv_id, '-', turn)").alias("id"),
            F.col("role").alias("author_label"), F.expr(at).alias("created_at"), F.col("text").alias("content"), "turn")

    @cached_property
    def segments(self) -> DataFrame:
        """Returned segments: one call per ten conversations, named by turn parity.

        Turns divisible by 5 are not named; the odd segment of every third conversation
        names nothing and relies on its label; every seventh call names no label at all.
        The model skipped every eleventh conversation.
        """
        t = self.table("conversations").filter("conv_id % 11 <> 5").withColumn("seg", F.expr("turn % 2"))
        by = t.groupBy("conv_id", "seg").agg(
            F.sort_array(F.collect_list(F.expr(
                "case when turn % 5 <> 0 and not (seg = 1 and conv_id % 3 = 0) "
                "then concat('v', conv_id, '-', turn) end"))).alias("message_ids"))
        return by.select(
            F.expr("concat('k', conv_id div 10)").alias("call_id"), F.expr("conv_id * 2 + seg").alias("seg_no"),
            "message_ids",
            F.expr("case when (conv_id div 10) % 7 <> 0 then concat('c', conv_id % 10 + 1) end").alias("source_cluster"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("conversations").select("conv_id").distinct().select(
            F.expr("concat('k', conv_id div 10)").alias("call_id"), F.expr("concat('c', conv_id % 10 + 1)").alias("label"),
            F.expr("concat('v', conv_id)").alias("discussion_id"))

    @cached_property
    def mapped(self) -> DataFrame:
        from parley.operators.enrich import map_segments

        owners = self.threads.select("discussion_id", F.col("id").alias("message_id"))
        return map_segments(self.segments, owners, self.labels)

    # --- dumps and payloads --------------------------------------------------------

    @cached_property
    def dump(self) -> DataFrame:
        return self.events.withColumn("copy", F.explode(F.expr("case when event_id % 31 = 0 then array(0, 1) else array(0) end"))).select(
            F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("channel_id"),
            F.col("user_id").cast("string").alias("author_id"),
            F.expr("case when event_id % 29 = 0 then '' when event_id % 58 = 1 then ' \\t ' else props end").alias("content"),
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00")).alias("created_at"),
            F.expr("case when event_id % 23 = 0 then '2024-03-01T00:00:00Z' end").alias("deleted_at"),
            F.expr("event_id * 2 + copy").alias("pos"))

    @cached_property
    def guild_map(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("channel_id")).distinct().filter(
            "channel_id in ('click', 'view')").withColumn("guild_id", F.lit(" g1 "))

    @cached_property
    def payload_json(self) -> DataFrame:
        """Dictionary entries for all users: renamed, cleared, bare, new, unchanged."""
        return self.table("events").select("user_id").distinct().select(F.expr(
            "case user_id % 5 "
            "when 0 then concat('{\"id\":\"', user_id, '\",\"username\":\"new', user_id, '\"}') "
            "when 1 then concat('{\"id\":\"', user_id, '\",\"display_name\":null}') "
            "when 2 then concat('{\"id\":\"', user_id, '\"}') "
            "when 3 then concat('{\"id\":\"x', user_id, '\",\"username\":\"n\",\"display_name\":\"\"}') "
            "else concat('{\"id\":\"', user_id, '\",\"display_name\":\"User ', user_id, '\"}') end").alias("json"))

    @cached_property
    def batch(self) -> DataFrame:
        """A batch of raw rows with repeats, for ingest: ten batches by author."""
        return self.dump.select(
            "id", "channel_id", F.lit("g0").alias("guild_id"),
            F.expr("case when channel_id = 'view' then 'forum' end").alias("channel_type"), "author_id", "content",
            F.to_timestamp("created_at").alias("created_at"), F.lit(None).cast("string").alias("reply_to_message_id"),
            F.lit(None).cast("string").alias("thread_id"), F.lit(None).cast("array<string>").alias("mentions"),
            F.lit(None).cast("int").alias("attachments_count"), "pos",
            F.expr("concat('b', cast(author_id as bigint) % 10)").alias("batch_id"))

    @cached_property
    def stored(self) -> DataFrame:
        """Messages stored before the batch: those of the first two weeks."""
        return self.slim_messages.filter("created_at < timestamp '2024-01-15'").withColumn("content", F.lit(""))

    # --- clustering ------------------------------------------------------------------

    @cached_property
    def blocks(self) -> DataFrame:
        from parley.operators.segment import channel_max, closed_blocks, scan_unprocessed, split_threads, time_blocks

        main, _ = split_threads(scan_unprocessed(self.messages.drop("content")))
        return closed_blocks(time_blocks(main, self.gap), channel_max(self.slim_messages), self.gap)

    @cached_property
    def slim_blocks(self) -> DataFrame:
        from parley.operators.segment import channel_max, closed_blocks, scan_unprocessed, split_threads, time_blocks

        main, _ = split_threads(scan_unprocessed(self.slim_messages))
        return closed_blocks(time_blocks(main, self.gap), channel_max(self.slim_messages), self.gap)

    @cached_property
    def sub(self) -> DataFrame:
        """Stand-in sub-clusters, by author modulo 4 inside each block."""
        longs = self.blocks.filter(f"closed and word_count >= {WORD_LIMIT}").withColumn(
            "_s", F.expr("cast(author_id as bigint) % 4"))
        roots = longs.groupBy("channel_id", "block_no", "_s").agg(
            F.min_by("id", F.struct("created_at", "id")).alias("root_id"))
        return longs.join(roots, ["channel_id", "block_no", "_s"]).select(
            "id", "channel_id", "block_no", "created_at", "root_id")

    @cached_property
    def replies(self) -> DataFrame:
        from parley.operators.cluster import resolve_replies

        return resolve_replies(self.slim_blocks, self.slim_messages)
