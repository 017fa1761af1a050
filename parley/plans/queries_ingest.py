"""Sources, ingest and dictionary queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions.text import iso, normalize_ts
from parley.operators import dictionary as D
from parley.operators import ingest as I
from parley.plans.fixture_sql import iso as sql_iso
from parley.plans.fixture_sql import words
from parley.plans.fixtures import NOW
from parley.plans.registry import query
from parley.session import shared_dir
from parley.sources import batches as B
from parley.sources import dump as S
from parley.sources import state as ST


def work_dir(spark, name: str) -> str:
    """A fresh folder for files a query writes."""
    return f"{shared_dir(spark)}/parley-{name}-{uuid.uuid4().hex}"


def _dump_json(fx):
    """The dump as NDJSON files with an extra column and numeric author ids."""
    path = work_dir(fx.spark, "dump")
    fx.dump.withColumn("author_id", F.col("author_id").cast("bigint")).withColumn("extra", F.lit(1)).write.json(path)
    return path


@query("read_dump", "SELECT id, channel_id, author_id, content, created_at, deleted_at FROM fx_dump")
def read_dump(fx):
    return S.read_dump(fx.spark, _dump_json(fx))


def _documents_json(fx):
    """Batch documents, one per author, channel and day; some break the rules."""
    d = fx.dump.withColumn("day", F.substring("created_at", 1, 10))
    msg = F.struct("id", F.struct(F.col("author_id").alias("id")).alias("author"), "content", "created_at")
    docs = d.groupBy("channel_id", "author_id", "day").agg(
        F.array_sort(F.collect_list(msg)).alias("messages"))
    broken = F.expr("cast(author_id as bigint) % 7 = 0")
    body = F.struct(
        F.struct(F.lit("g0").alias("id"), F.when(broken, F.lit("named")).alias("name")).alias("guild"),
        F.struct(F.col("channel_id").alias("id"), F.lit("text").alias("type")).alias("channel"), "messages")
    return docs.select(F.concat_ws("/", "channel_id", "author_id", "day").alias("doc"), F.to_json(body).alias("value"))


@query("read_batches", f"""
SELECT id, channel_id, author_id, content, {sql_iso('at_ts')} AS created_at, 'text' AS channel_type FROM fx_dump
WHERE author_id::BIGINT % 7 <> 0""")
def read_batches(fx):
    good, _ = B.validate_batches(_documents_json(fx))
    return good.select("id", "channel_id", "author_id", "content", iso(F.col("created_at")).alias("created_at"), "channel_type")


@query("quarantine_batches", """
SELECT 'unknown guild key' AS reason, count(DISTINCT (channel_id, author_id, at_ts::DATE)) AS documents FROM fx_dump WHERE author_id::BIGINT % 7 = 0
UNION ALL SELECT 'unreadable time', count(DISTINCT channel_id) FROM fx_dump UNION ALL SELECT 'value of a wrong type', 2 * count(DISTINCT channel_id) FROM fx_dump""")
def quarantine_batches(fx):
    """Also one document per channel with a time that is none, with a number for a text, and with a text for a count."""
    form = ('{"guild":{"id":"g0"},"channel":{"id":"%c"},"messages":[{"id":"x","author":{"id":"1"},"content":%t,'
            '"created_at":"%w","attachments_count":%n}]}')
    bad = F.array(*[F.replace(F.lit(form.replace("%t", t).replace("%w", w).replace("%n", n)), F.lit("%c"), F.col("channel_id")) for t, w, n in (
        ('"a"', "yesterday", "0"), ("5", "2024-01-01T00:00:00Z", "0"), ('"a"', "2024-01-01T00:00:00Z", '"two"'))])
    more = fx.dump.select("channel_id").distinct().select("channel_id", F.posexplode(bad).alias("k", "value"))
    _, out = B.validate_batches(_documents_json(fx).unionByName(
        more.select(F.concat_ws("/", F.lit("bad"), "channel_id", "k").alias("doc"), "value")))
    return out.groupBy("reason").agg(F.count("*").alias("documents"))


def _assigned(fx):
    return S.assign_guild(fx.dump, fx.guild_map, "g0")


@query("assign_guild", "SELECT id, pos, channel_id, guild_id FROM fx_assigned")
def assign_guild(fx):
    return _assigned(fx).select("id", "pos", "channel_id", "guild_id")


@query("unmapped_channels", "SELECT DISTINCT channel_id FROM fx_dump WHERE channel_id NOT IN ('click', 'view')")
def unmapped_channels(fx):
    return S.unmapped_channels(S.assign_guild(fx.dump, fx.guild_map))


@query("clean_dump", "SELECT guild_id, channel_id, id, pos, content FROM fx_clean")
def clean_dump(fx):
    return S.clean_dump(_assigned(fx)).select("guild_id", "channel_id", "id", "pos", "content")


@query("clean_dump_unmapped", """
SELECT 'kept' AS part, 'g1' AS guild_id, channel_id, id, pos FROM fx_clean WHERE channel_id IN ('click', 'view')
UNION ALL SELECT 'channel without a guild', NULL, channel_id, id, pos FROM fx_dump WHERE channel_id NOT IN ('click', 'view')""")
def clean_dump_unmapped(fx):
    """Without a fallback: cleaned rows of mapped channels, and every other row with its reason."""
    mapped, rest = S.quarantine_unmapped(S.assign_guild(fx.dump, fx.guild_map))
    cols = ["part", "guild_id", "channel_id", "id", "pos"]
    return S.clean_dump(mapped).withColumn("part", F.lit("kept")).select(*cols).unionByName(
        rest.withColumnRenamed("reason", "part").select(*cols))


@query("unmapped_fails", """
SELECT 'channels without a guild: ' || string_agg(channel_id, ', ' ORDER BY channel_id) AS error
FROM (SELECT DISTINCT channel_id FROM fx_dump WHERE channel_id NOT IN ('click', 'view'))""")
def unmapped_fails(fx):
    """What a conversion without a fallback stops with."""
    try:
        S.clean_dump(S.assign_guild(fx.dump, fx.guild_map))
        message = None
    except ValueError as e:
        message = str(e)
    return fx.spark.createDataFrame([(message,)], "error string")


@query("normalize_ts", f"SELECT id, pos, {sql_iso('at_ts')} AS created_at FROM fx_dump")
def normalize_timestamps(fx):
    return fx.dump.select("id", "pos", iso(normalize_ts(F.col("created_at"))).alias("created_at"))


@query("write_daily_batches", """
SELECT guild_id AS guild, channel_id AS channel, at_ts::DATE::VARCHAR AS day, count(*) AS messages, min(created) AS first_at
FROM (SELECT *, strftime(at_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS created FROM fx_clean) GROUP BY 1, 2, 3""")
def write_daily_batches(fx):
    path = work_dir(fx.spark, "daily")
    S.write_daily_batches(S.clean_dump(_assigned(fx)), path)
    schema = "id string, author struct<id: string>, content string, created_at string, guild string, channel string, day string"
    return fx.spark.read.schema(schema).json(path).groupBy("guild", "channel", "day").agg(
        F.count("*").alias("messages"), F.min("created_at").alias("first_at"))


@query("dir_segments", """
SELECT id, CASE WHEN id = 'error' THEN 'error' ELSE '_ch_' || id || '_x' END AS segment, false AS collides FROM fx_channels""")
def dir_segments(fx):
    names = fx.channels.withColumn("name", F.when(F.col("name").isNotNull(), F.concat(F.lit("..ch/"), F.col("id"), F.lit(" \t x."))))
    return S.assert_no_collision(S.dir_segments(fx.channels, names, "name"))


@query("dump_stats", """
SELECT (SELECT count(*) FROM fx_dump) AS input_count, count(*) AS output_count, count(DISTINCT guild_id) AS guild_count,
 count(DISTINCT (guild_id, channel_id)) AS channel_count, count(DISTINCT (guild_id, channel_id, at_ts::DATE)) AS day_count,
 count(DISTINCT (guild_id, channel_id, at_ts::DATE)) AS file_count,
 (SELECT count(*) FROM fx_dump WHERE deleted_at IS NOT NULL) AS skipped_deleted,
 (SELECT count(*) FROM fx_dump WHERE deleted_at IS NULL AND trim(replace(content, chr(9), ' ')) = '') AS skipped_empty,
 (SELECT count(*) - count(DISTINCT id) FROM fx_dump WHERE deleted_at IS NULL AND trim(replace(content, chr(9), ' ')) <> '') AS skipped_duplicate
FROM fx_clean""")
def dump_stats(fx):
    return S.dump_stats(_assigned(fx))


@query("state_snapshot", "SELECT 'users' AS table_name, count(*) AS n FROM fx_users UNION ALL SELECT 'messages', count(*) FROM fx_slim UNION ALL SELECT 'processed', count(*) FROM fx_slim WHERE processed > 0")
def state_snapshot(fx):
    """Save, change only message states, save again, load."""
    folder = work_dir(fx.spark, "state")
    msgs = fx.stored.select("*").limit(0).unionByName(fx.slim_messages.withColumn("content", F.lit("")))
    msgs = msgs.withColumn("word_count", F.lit(0)).withColumn("batch_id", F.lit("b"))
    ST.save_state({"messages": msgs.withColumn("processed", F.lit(0)), "users": fx.users}, folder, "first")
    ST.save_state({"messages": msgs}, folder, "second")
    s = ST.load_state(fx.spark, folder)
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
    return one(s["users"], "users").unionByName(one(s["messages"], "messages")).unionByName(
        one(s["messages"].filter("processed > 0"), "processed"))


# --- ingest ----------------------------------------------------------------------


@query("word_count", f"SELECT id, {words('content')}::BIGINT AS words FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents)")
def word_counts(fx):
    from parley.functions.text import word_count

    return fx.table("documents").select(F.col("doc_id").cast("string").alias("id"),
                                        word_count(F.col("text")).cast("bigint").alias("words"))


@query("ingest_messages", f"SELECT id, channel_id, author_id, content, {sql_iso('at_ts')} AS created_at, {words('content')}::BIGINT AS words FROM fx_new")
def ingest_messages(fx):
    new, _ = I.ingest_messages(fx.stored, fx.batch, "b", NOW)
    return new.select("id", "channel_id", "author_id", "content", iso(F.col("created_at")).alias("created_at"),
                      F.col("word_count").cast("bigint").alias("words"))


@query("ingest_counts", """
SELECT count(*) AS message_count, (SELECT count(*) FROM fx_new) AS inserted_count,
 count(*) - (SELECT count(*) FROM fx_new) AS duplicate_count FROM fx_batch""")
def ingest_counts(fx):
    return I.ingest_messages(fx.stored, fx.batch, "b", NOW)[1]


@query("upsert_guilds", "SELECT 'g0' AS id, 'Guild 0' AS name, '2024-01-01T00:00:00.000Z' AS created_at UNION ALL SELECT DISTINCT 'g1', NULL, '2024-02-01T00:00:00.000Z' FROM fx_assigned")
def upsert_guilds(fx):
    return I.upsert_guilds(fx.guilds, _assigned(fx).withColumn("guild_id", F.trim("guild_id")), NOW).select(
        "id", "name", iso(F.col("created_at")).alias("created_at"))


@query("upsert_channels", """
SELECT coalesce(c.id, b.id) AS id, 'g0' AS guild_id, c.name, CASE WHEN b.id = 'view' THEN 'forum' ELSE c.type END AS type,
 CASE WHEN c.id IS NULL THEN '2024-02-01T00:00:00.000Z' ELSE '2024-01-01T00:00:00.000Z' END AS created_at,
 CASE WHEN b.id IS NULL THEN '2024-01-01T00:00:00.000Z' ELSE '2024-02-01T00:00:00.000Z' END AS updated_at
FROM (SELECT * FROM fx_channels WHERE id <> 'click') c FULL JOIN (SELECT DISTINCT channel_id AS id FROM fx_batch WHERE channel_id <> 'signup') b ON b.id = c.id""")
def upsert_channels(fx):
    out = I.upsert_channels(fx.channels.filter("id <> 'click'"), fx.batch.filter("channel_id <> 'signup'"), NOW)
    return out.select("id", "guild_id", "name", "type", iso(F.col("created_at")).alias("created_at"),
                      iso(F.col("updated_at")).alias("updated_at"))


def _old_users(fx):
    """Users known before: those with a user name, some without a seen-window."""
    seeded = F.expr("cast(id as bigint) % 5 = 1")
    return fx.users.filter("username is not null").withColumn(
        "first_seen_at", F.when(~seeded, F.col("first_seen_at"))).withColumn(
        "last_seen_at", F.when(~seeded, F.col("last_seen_at")))


@query("upsert_users", f"""
SELECT coalesce(u.id, b.id) AS id, u.username, coalesce(u.message_count, 0) AS message_count,
 {sql_iso("least(u.f, TIMESTAMP '2024-02-01')")} AS first_seen_at, '2024-02-01T00:00:00.000Z' AS last_seen_at
FROM (SELECT *, CASE WHEN id::BIGINT % 5 <> 1 THEN first_seen_at END AS f FROM fx_users WHERE username IS NOT NULL) u
FULL JOIN (SELECT DISTINCT author_id AS id FROM fx_batch) b ON b.id = u.id""")
def upsert_users(fx):
    return I.upsert_users(_old_users(fx), fx.batch, NOW).select(
        "id", "username", "message_count", iso(F.col("first_seen_at")).alias("first_seen_at"),
        iso(F.col("last_seen_at")).alias("last_seen_at"))


@query("bump_user_counts", """
SELECT coalesce(u.id, b.id) AS id, coalesce(u.message_count, 0) + coalesce(n.c, 0) AS message_count
FROM (SELECT * FROM fx_users WHERE username IS NOT NULL) u
FULL JOIN (SELECT DISTINCT author_id AS id FROM fx_batch) b ON b.id = u.id
LEFT JOIN (SELECT author_id, count(*) AS c FROM fx_new GROUP BY 1) n ON n.author_id = coalesce(u.id, b.id)""")
def bump_user_counts(fx):
    new, _ = I.ingest_messages(fx.stored, fx.batch, "b", NOW)
    return I.bump_user_counts(I.upsert_users(_old_users(fx), fx.batch, NOW), new).select("id", "message_count")


@query("batch_ledger", """
SELECT b.batch_id AS id, b.channel_id, count(*) AS message_count, coalesce(any_value(n.c), 0) AS inserted_count,
 count(*) - coalesce(any_value(n.c), 0) AS duplicate_count
FROM fx_batch b LEFT JOIN (SELECT batch_id, channel_id, count(*) AS c FROM fx_new GROUP BY 1, 2) n USING (batch_id, channel_id)
GROUP BY 1, 2""")
def batch_ledger(fx):
    return I.ledger(fx.stored, fx.batch, NOW).drop("received_at")


@query("reset_channels", f"""
SELECT 'messages' AS table_name, (SELECT count(*) FROM fx_slim WHERE channel_id = 'click') AS deleted
UNION ALL SELECT 'discussions', count(*) FROM fx_discussions WHERE channel_id = 'click'
UNION ALL SELECT 'discussion_enrichment', count(*) FROM fx_enrichment e JOIN fx_discussions d ON d.id = e.discussion_id WHERE d.channel_id = 'click'
UNION ALL SELECT 'channel_checkpoints', 1""")
def reset_channels(fx):
    return I.reset_channels(_cascade_state(fx), ["click"])[1]


def _cascade_state(fx):
    points = fx.channels.select(F.col("id").alias("channel_id"), F.col("created_at").alias("last_closed_block_end_at"),
                                F.col("updated_at"))
    return {"messages": fx.slim_messages, "discussions": fx.discussions,
            "discussion_enrichment": fx.enrichment, "channel_checkpoints": points}


@query("reset_channels_rest", """
SELECT 'messages' AS table_name, (SELECT count(*) FROM fx_slim WHERE channel_id <> 'click') AS kept
UNION ALL SELECT 'discussion_enrichment', count(*) FROM fx_enrichment e JOIN fx_discussions d ON d.id = e.discussion_id WHERE d.channel_id <> 'click'""")
def reset_channels_rest(fx):
    out = I.reset_channels(_cascade_state(fx), ["click"])[0]
    one = lambda n: out[n].agg(F.count("*").alias("kept")).select(F.lit(n).alias("table_name"), "kept")
    return one("messages").unionByName(one("discussion_enrichment"))


# --- dictionary ------------------------------------------------------------------

NAMES = ["username", "display_name"]


def _payload(fx):
    return D.payload_rows(fx.payload_json, NAMES)


def _synced(fx):
    return D.sync_dictionary(fx.users, _payload(fx), NAMES, NOW, {"message_count": F.lit(0).cast("bigint")})


@query("sync_dictionary", """
SELECT id, CASE WHEN (created OR updated) AND has_username THEN username ELSE old_username END AS username,
 CASE WHEN (created OR updated) AND has_display_name THEN display_name ELSE old_display_name END AS display_name,
 coalesce(message_count, 0) AS message_count,
 CASE WHEN created OR updated THEN '2024-02-01T00:00:00.000Z' END AS names_synced_at FROM fx_sync""")
def sync_dictionary(fx):
    return _synced(fx).select("id", *NAMES, "message_count", iso(F.col("names_synced_at")).alias("names_synced_at"))


@query("sync_counts", """
SELECT count(*) AS received, count(*) FILTER (WHERE created) AS created, count(*) FILTER (WHERE updated) AS updated,
 count(*) FILTER (WHERE NOT created AND NOT updated) AS unchanged FROM fx_sync WHERE received""")
def sync_counts(fx):
    return D.sync_counts(fx.users, _payload(fx), NAMES)


def _channel_entries(fx):
    """Channel entries with repeated ids, and some that break the rules."""
    e = fx.table("events").select(F.col("event_type").alias("ch")).distinct()
    forms = ('{"id":"%s","name":"first"}', '{"id":"%s","name":"n-%s"}', '{"id":"%s","type":"voice"}', '{"id":null,"name":"x"}',
             '{"name":"y"}', '{"id":"%s","topic":"z"}', "{", '{"id":"%s","name":5}')
    texts = F.array(*[F.replace(F.lit(form), F.lit("%s"), F.col("ch")) for form in forms])
    rows = e.select("ch", F.posexplode(texts).alias("pos", "json"))
    last = e.filter("ch = 'click'").select("ch", F.lit(9).alias("pos"), F.lit('{"id":"click","name":null}').alias("json"))
    return rows.unionByName(last).select("json", "pos")


def _guild_entries(fx):
    """One entry per channel for the same guild, and a new guild per channel."""
    c = fx.channels.select("id", F.row_number().over(Window.orderBy("id")).alias("pos"))
    return c.select(F.concat(F.lit('{"id":"g0","name":"Guild '), "id", F.lit('"}')).alias("json"), "pos").unionByName(
        c.select(F.concat(F.lit('{"id":"g-'), "id", F.lit('","name":null}')).alias("json"), "pos"))


@query("sync_channels", """
SELECT id, CASE WHEN id <> 'click' THEN 'n-' || id END AS name, 'voice' AS type FROM fx_channels""")
def sync_channels(fx):
    return D.sync_dictionary(fx.channels, D.payload_rows(_channel_entries(fx), D.SECTIONS["channels"]), D.SECTIONS["channels"], NOW).select(
        "id", "name", "type")


@query("quarantine_payload", """
SELECT reason, count(*) * n AS entries FROM fx_channels, (VALUES ('entry without an id', 2), ('unknown key', 1), ('not a JSON object', 1), ('value is not a string', 1)) v(reason, n)
GROUP BY reason, n""")
def quarantine_payload(fx):
    _, bad = D.validate_payload(_channel_entries(fx), D.SECTIONS["channels"])
    return bad.groupBy("reason").agg(F.count("*").alias("entries"))


@query("changed_channels", "SELECT id FROM fx_channels")
def changed_channels(fx):
    return D.dictionary_changed_ids(fx.channels, D.payload_rows(_channel_entries(fx), D.SECTIONS["channels"]), D.SECTIONS["channels"], "channels")


@query("sync_guilds", """
SELECT 'g0' AS id, 'Guild ' || max(id) AS name, 'updated' AS outcome FROM fx_channels UNION ALL SELECT 'g-' || id, NULL, 'created' FROM fx_channels""")
def sync_guilds(fx):
    rows = D.payload_rows(_guild_entries(fx), D.SECTIONS["guilds"])
    after = D.sync_dictionary(fx.guilds, rows, D.SECTIONS["guilds"], NOW)
    changed = D.dictionary_changed_ids(fx.guilds, rows, D.SECTIONS["guilds"], "guilds")
    known = fx.guilds.select("id", F.lit("updated").alias("outcome"))
    return after.join(changed, "id", "left_semi").join(known, "id", "left").select("id", "name", F.coalesce("outcome", F.lit("created")).alias("outcome"))


@query("dictionary_changed_ids", "SELECT id FROM fx_sync WHERE updated OR (created AND (has_username OR has_display_name))")
def dictionary_changed_ids(fx):
    return D.dictionary_changed_ids(fx.users, _payload(fx), NAMES, "users")


@query("names_for", """
SELECT id, CASE WHEN has_username THEN username ELSE old_username END AS username,
 CASE WHEN has_display_name THEN display_name ELSE old_display_name END AS display_name
FROM fx_sync WHERE updated OR (created AND (has_username OR has_display_name))""")
def names_for(fx):
    return D.names_for(D.dictionary_changed_ids(fx.users, _payload(fx), NAMES, "users"), _synced(fx), NAMES)


@query("all_named", "SELECT id, username, display_name FROM fx_users WHERE username IS NOT NULL OR display_name IS NOT NULL")
def all_named(fx):
    return D.all_named(fx.users, NAMES)


@query("propagate_names", """
SELECT u.id, CASE WHEN s.id IS NOT NULL THEN CASE WHEN s.has_username THEN s.username ELSE s.old_username END ELSE u.username END AS username,
 CASE WHEN s.id IS NOT NULL THEN CASE WHEN s.has_display_name THEN s.display_name ELSE s.old_display_name END ELSE u.display_name END AS display_name,
 s.id IS NOT NULL AS touched
FROM (SELECT DISTINCT author_id AS id, username, display_name FROM fx_parts) u
LEFT JOIN (SELECT * FROM fx_sync WHERE updated OR (created AND (has_username OR has_display_name))) s ON s.id = u.id""")
def propagate_names(fx):
    names = D.names_for(D.dictionary_changed_ids(fx.users, _payload(fx), NAMES, "users"), _synced(fx), NAMES)
    return D.propagate_names(fx.graph["nodes_user"].select("id", *NAMES), names, NAMES)
