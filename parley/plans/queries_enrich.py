"""Enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.models import rule_based
from parley.functions.text import iso, normalize_label
from parley.functions.vectors import embed, hashing_embedder
from parley.operators import enrich as E
from parley.plans.fixture_sql import iso as sql_iso
from parley.plans.fixture_sql import one_line as sql_one_line
from parley.plans.fixture_sql import trim as sql_trim
from parley.plans.fixtures import DIM, NOW
from parley.plans.registry import query
from parley.session import cut


@query("enrich_queue", f"""
SELECT q.*, coalesce(m.n, 0) AS messages FROM (
 SELECT id, channel_id, status, {sql_iso('block_start_at')} AS block_start_at, row_number() OVER (PARTITION BY channel_id ORDER BY block_start_at, id) AS pos
 FROM fx_discussions WHERE status IN ('clustering', 'needs_reenrichment')) q
LEFT JOIN (SELECT discussion_id, count(*) AS n FROM fx_slim WHERE discussion_id IS NOT NULL GROUP BY 1) m ON m.discussion_id = q.id WHERE q.pos <= 15""")
def enrich_queue(fx):
    return E.enrich_queue(fx.discussions, fx.slim_messages, 15).select(
        "id", "channel_id", "status", iso(F.col("block_start_at")).alias("block_start_at"), "pos", "messages")


@query("discussion_messages", f"""
SELECT m.discussion_id, m.id, coalesce(u.display_name, u.username, m.author_id) AS author_label, {sql_iso('m.created_at')} AS created_at, x.content
FROM fx_members m JOIN fx_messages x ON x.id = m.id LEFT JOIN fx_users u ON u.id = m.author_id""")
def discussion_messages(fx):
    return E.discussion_messages(fx.member_messages, fx.users).select(
        "discussion_id", "id", "author_label", iso(F.col("created_at")).alias("created_at"), "content")


@query("render_line", "SELECT id, line FROM fx_lines")
def render_line(fx):
    return E.render_line(fx.threads).select("id", "line")


@query("render_prompts", """
SELECT discussion_id, part, messages,
 CASE WHEN messages > 5 THEN 'Part ' || part || ' of ' || ceil(messages / 5)::BIGINT || ' of one discussion (' || messages || ' messages).' || chr(10) || chr(10) ELSE '' END || body AS prompt
FROM (SELECT discussion_id, (rn - 1) // 5 + 1 AS part, any_value(n) AS messages, string_agg(line, chr(10) || chr(10) ORDER BY rn) AS body
 FROM (SELECT *, count(*) OVER (PARTITION BY discussion_id) AS n FROM fx_lines) GROUP BY 1, 2)""")
def render_prompts(fx):
    return E.render_prompts(fx.threads, 5)


_WORD = "CASE WHEN {0} = 1 THEN 'message' ELSE 'messages' END"


@query("render_batch_prompts", f"""
WITH b AS (
 SELECT call_id AS batch_id, substr(label, 2)::BIGINT AS label_no, discussion_id, s.messages AS total FROM fx_labels l JOIN fx_sized s ON s.id = l.discussion_id),
c AS (SELECT *, least(total, greatest(0, 30 - coalesce(sum(total) OVER (PARTITION BY batch_id ORDER BY label_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS shown FROM b),
d AS (SELECT batch_id, label_no, any_value(total) AS total,
 '=== CLUSTER c' || label_no || ' · ' || any_value(total) || ' ' || {_WORD.format('any_value(total)')} || ' ===' || chr(10) ||
 CASE WHEN any_value(shown) = 0 THEN '(' || any_value(total) || ' ' || {_WORD.format('any_value(total)')} || ' not shown, the call is full)'
 ELSE string_agg(line, chr(10) || chr(10) ORDER BY rn) FILTER (WHERE rn <= shown) ||
  CASE WHEN any_value(shown) < any_value(total) THEN chr(10) || '(another ' || (any_value(total) - any_value(shown))::BIGINT || ' ' ||
   {_WORD.format('(any_value(total) - any_value(shown))')} || ' not shown, the call is full)' ELSE '' END END AS block
 FROM c JOIN fx_lines USING (discussion_id) GROUP BY 1, 2)
SELECT batch_id, count(*) AS discussions, sum(total)::BIGINT AS messages, 'This call holds ' || count(*) ||
 ' separate clusters. Judge each by itself, and give its mark as "source_cluster" with every segment.' || chr(10) || chr(10) ||
 string_agg(block, chr(10) || chr(10) ORDER BY label_no) AS prompt FROM d GROUP BY 1""")
def render_batch_prompts(fx):
    batches = fx.labels.select(F.col("call_id").alias("batch_id"), F.expr("cast(substring(label, 2) as bigint)").alias("label_no"),
                               "discussion_id")
    return E.render_batch_prompts(batches, fx.threads, 30)


@query("estimate_tokens", "SELECT id AS discussion_id, tokens, messages FROM fx_sized")
def estimate_tokens(fx):
    return E.estimate_tokens(fx.threads)


_PACK = """
WITH q AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY block_start_at, id) - 1 AS pos FROM fx_sized),
f AS (
 SELECT channel_id, pos, id, tokens, messages, 1::BIGINT AS batch_no, 1::BIGINT AS label_no, tokens AS t, messages AS m FROM q WHERE pos = 0
 UNION ALL
 SELECT q.channel_id, q.pos, q.id, q.tokens, q.messages,
  CASE WHEN o.over THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN o.over THEN 1 ELSE f.label_no + 1 END,
  CASE WHEN o.over THEN q.tokens ELSE f.t + q.tokens END, CASE WHEN o.over THEN q.messages ELSE f.m + q.messages END
 FROM f JOIN q ON q.channel_id = f.channel_id AND q.pos = f.pos + 1,
 LATERAL (SELECT f.t + q.tokens > 6000 OR f.label_no + 1 > 4 OR f.m + q.messages > 18 AS over) o)
SELECT channel_id, pos, id, tokens, messages, batch_no, label_no FROM f"""


def _queue(fx):
    return fx.thread_discussions.drop("messages").join(
        E.estimate_tokens(fx.threads).withColumnRenamed("discussion_id", "id"), "id")


@query("pack_batches", _PACK)
def pack_batches(fx):
    return E.pack_batches(_queue(fx), 6000, 4, 18).select(
        "channel_id", "pos", "id", "tokens", "messages", "batch_no", "label_no")


@query("pack_batches_off", """
SELECT channel_id, id, row_number() OVER (PARTITION BY channel_id ORDER BY block_start_at, id) AS batch_no, 1::BIGINT AS label_no FROM fx_sized""")
def pack_batches_off(fx):
    return E.pack_batches(_queue(fx), 0).select("channel_id", "id", "batch_no", "label_no")


def _flaky(system, user, schema_name):
    """Fails on batches whose first label block has an odd number of messages."""
    if user.startswith("This call holds") and "c1 · 5 " in user:
        raise RuntimeError("overloaded")
    return rule_based(system, user, schema_name)


def _calls(fx):
    batches = fx.labels.select(F.col("call_id").alias("batch_id"), F.expr("cast(substring(label, 2) as bigint)").alias("label_no"),
                               "discussion_id")
    prompts = E.render_batch_prompts(batches, fx.threads).select("batch_id", "discussions", "prompt")
    return E.infer_with_retry(prompts, batches, fx.threads, _flaky)


@query("infer", "SELECT DISTINCT call_id AS batch_id, 'ok' AS status FROM fx_labels")
def infer(fx):
    batches = fx.labels.select(F.col("call_id").alias("batch_id"), F.expr("cast(substring(label, 2) as bigint)").alias("label_no"),
                               "discussion_id")
    prompts = E.render_batch_prompts(batches, fx.threads).select("batch_id", "prompt")
    return E.infer_segments(prompts, rule_based).select("batch_id", "status")


@query("infer_with_retry", """
WITH f AS (SELECT call_id AS batch_id, bool_or(label = 'c1' AND messages = 5) AS bad FROM fx_labels JOIN fx_sized ON id = discussion_id GROUP BY 1)
SELECT batch_id AS call_id, 'batch' AS attempt, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN bad THEN 'overloaded' END AS error FROM f
UNION ALL SELECT batch_id || '/' || discussion_id, 'solo', 'ok', NULL FROM f JOIN fx_labels ON call_id = batch_id WHERE bad""")
def infer_with_retry(fx):
    return _calls(fx).select("call_id", "attempt", "status", "error")


@query("map_segments", "SELECT call_id, seg_no, discussion_id, message_id FROM fx_mapped")
def map_segments(fx):
    return fx.mapped


@query("omitted", "SELECT l.call_id, l.label, l.discussion_id FROM fx_labels l WHERE (l.call_id, l.discussion_id) NOT IN (SELECT call_id, discussion_id FROM fx_mapped)")
def omitted(fx):
    return E.omitted(fx.labels, fx.mapped)


@query("partition_messages", "SELECT discussion_id, id, seg_no FROM fx_partitioned")
def partition_messages(fx):
    return E.partition_messages(fx.threads, fx.mapped).select("discussion_id", "id", "seg_no")


_OUTCOMES = """
WITH live AS (SELECT s.discussion_id, s.seg_no, count(p.id) AS messages FROM (SELECT DISTINCT discussion_id, seg_no FROM fx_mapped) s
 LEFT JOIN fx_partitioned p ON p.discussion_id = s.discussion_id AND p.seg_no = s.seg_no GROUP BY 1, 2),
 k AS (SELECT *, count(*) FILTER (WHERE messages > 0) OVER (PARTITION BY discussion_id) AS n,
  row_number() OVER (PARTITION BY discussion_id ORDER BY messages = 0, seg_no) AS r FROM live),
 outcome AS (SELECT discussion_id, CASE WHEN n > 1 THEN 'split' ELSE 'single' END AS kind, seg_no, messages FROM k
  WHERE (n > 1 AND messages > 0) OR (n <= 1 AND r = 1))
"""


@query("resolve_outcomes", _OUTCOMES + "SELECT * FROM outcome")
def resolve_outcomes(fx):
    mapped = cut(fx.mapped)
    return E.resolve_outcomes(E.partition_messages(fx.threads, mapped), mapped).select(
        "discussion_id", "kind", "seg_no", "messages")


@query("embedding_text", f"""
SELECT discussion_id, array_to_string(list_filter([{sql_trim('title')}, {sql_trim('summary')}, {sql_trim("array_to_string(topics, ', ')")}], lambda x: x <> ''), '. ') AS text
FROM fx_enrichment""")
def embedding_text(fx):
    return fx.enrichment.select("discussion_id", E.embedding_text(F.col("title"), F.col("summary"), F.col("topics")).alias("text"))


@query("embed_discussions")
def embed_discussions(fx):
    """Vector of the embedding text of every enriched discussion."""
    t = fx.enrichment.select("discussion_id", E.embedding_text(F.col("title"), F.col("summary"), F.col("topics")).alias("text"))
    return embed(t, "text", hashing_embedder(DIM)).select("discussion_id", "embedding", F.size("embedding").alias("dim"))


def _linked(fx):
    """State whose messages belong to enriched discussions and whose children have parents."""
    linked = fx.slim_messages.drop("discussion_id").join(fx.members.select("id", "discussion_id"), "id", "left")
    return {"discussions": fx.discussions, "messages": linked, "discussion_enrichment": fx.enrichment}


@query("reset_enrichment", """
SELECT m.id, coalesce(k.parent_discussion_id, y.discussion_id) AS discussion_id FROM fx_slim m LEFT JOIN fx_members y ON y.id = m.id
LEFT JOIN fx_discussions k ON k.id = y.discussion_id AND k.parent_discussion_id IS NOT NULL""")
def reset_enrichment(fx):
    ids = fx.discussions.filter("status = 'split'").select("id")
    return E.reset_enrichment(_linked(fx), ids)["messages"].select("id", "discussion_id")


@query("reset_enrichment_rows", """
SELECT d.id, e.discussion_id IS NOT NULL AS enriched FROM fx_discussions d LEFT JOIN fx_enrichment e ON e.discussion_id = d.id
WHERE d.parent_discussion_id IS NULL""")
def reset_enrichment_rows(fx):
    out = E.reset_enrichment(_linked(fx), fx.discussions.filter("status = 'split'").select("id"))
    e = out["discussion_enrichment"].select(F.col("discussion_id").alias("id"), F.lit(True).alias("_e"))
    return out["discussions"].join(e, "id", "full_outer").select("id", F.coalesce("_e", F.lit(False)).alias("enriched"))


@query("apply_single", f"""
SELECT d.id, CASE WHEN d.status IN ('clustering', 'needs_reenrichment') THEN 'enriched' ELSE d.status END AS status,
 CASE WHEN d.status IN ('clustering', 'needs_reenrichment') THEN 'again ' || d.id ELSE e.title END AS title
FROM fx_discussions d LEFT JOIN fx_enrichment e ON e.discussion_id = d.id""")
def apply_single(fx):
    """Queued discussions get a row of their own; two inputs meet rows stored before."""
    new = fx.discussions.filter("status in ('clustering', 'needs_reenrichment')").select(F.col("id").alias("discussion_id"))
    cols = {f.name: F.lit(None).cast(f.dataType) for f in fx.enrichment.schema if f.name not in ("discussion_id", "title")}
    rows = new.select("discussion_id", F.concat(F.lit("again "), F.col("discussion_id")).alias("title"),
                      *[c.alias(n) for n, c in cols.items()])
    s = E.apply_single({**_linked(fx), "discussion_enrichment": fx.enrichment.unionByName(rows)}, rows)
    e = s["discussion_enrichment"].select(F.col("discussion_id").alias("id"), "title")
    return s["discussions"].select("id", "status").join(e, "id", "left")


def _split(fx):
    mapped = cut(fx.mapped)
    placed = cut(E.partition_messages(fx.threads, mapped))
    outs = E.resolve_outcomes(placed, mapped).filter("kind = 'split'")
    nul = {f.name: F.lit(None).cast(f.dataType) for f in fx.enrichment.schema if f.name not in ("discussion_id", "title")}
    segs = outs.select(F.col("discussion_id").alias("parent_id"), "seg_no", "messages", "start_at", "end_at",
                       F.concat(F.lit("part "), F.col("seg_no")).alias("title"), *[c.alias(n) for n, c in nul.items()])
    d = fx.thread_discussions.select(
        "id", "channel_id", F.lit(None).cast("string").alias("thread_id"), "block_start_at",
        F.col("block_start_at").alias("block_end_at"), F.lit("clustering").alias("status"),
        F.col("messages").alias("message_count"), F.lit(None).cast("array<float>").alias("centroid"),
        *[F.lit(None).cast("string").alias(c) for c in ("continuation_of_discussion_id", "continuation_reason", "parent_discussion_id")])
    state = {"discussions": d, "messages": fx.threads.select("id", "discussion_id"), "discussion_enrichment": fx.enrichment.filter(F.lit(False))}
    moved = placed.join(outs.select("discussion_id").distinct(), "discussion_id", "left_semi")
    return E.apply_split(state, segs, moved)


@query("apply_split", _OUTCOMES + """
SELECT s.id, CASE WHEN o.discussion_id IS NULL THEN 'clustering' ELSE 'split' END AS status, CASE WHEN o.discussion_id IS NULL THEN s.messages ELSE 0 END AS message_count,
 NULL::VARCHAR AS parent_discussion_id FROM fx_sized s LEFT JOIN (SELECT DISTINCT discussion_id FROM outcome WHERE kind = 'split') o ON o.discussion_id = s.id
UNION ALL SELECT md5(discussion_id || '|' || seg_no), 'enriched', messages, discussion_id FROM outcome WHERE kind = 'split'""")
def apply_split(fx):
    return _split(fx)["discussions"].select("id", "status", "message_count", "parent_discussion_id")


@query("apply_split_messages", _OUTCOMES + """
SELECT t.id, CASE WHEN o.discussion_id IS NULL THEN t.discussion_id ELSE md5(t.discussion_id || '|' || p.seg_no) END AS discussion_id
FROM fx_threads t LEFT JOIN (SELECT DISTINCT discussion_id FROM outcome WHERE kind = 'split') o USING (discussion_id) LEFT JOIN fx_partitioned p ON p.id = t.id""")
def apply_split_messages(fx):
    return _split(fx)["messages"].select("id", "discussion_id")


@query("enrichment_view", """
WITH v AS (
 SELECT d.id, d.status, NULL::VARCHAR AS parent_discussion_id, true AS split, k.id AS segment_id, row_number() OVER (PARTITION BY d.id ORDER BY k.block_start_at, k.id) AS segment_no
 FROM fx_discussions d JOIN fx_discussions k ON k.parent_discussion_id = d.id WHERE d.status = 'split'
 UNION ALL SELECT d.id, d.status, d.parent_discussion_id, false, d.id, 1 FROM fx_discussions d JOIN fx_enrichment e ON e.discussion_id = d.id WHERE d.status <> 'split')
SELECT v.*, e.title, e.sentiment, e.sentiment_score, e.resolved, coalesce(c.n, 0) AS messages FROM v LEFT JOIN fx_enrichment e ON e.discussion_id = v.segment_id
LEFT JOIN (SELECT discussion_id, count(*) AS n FROM fx_members GROUP BY 1) c ON c.discussion_id = v.segment_id""")
def enrichment_view(fx):
    return E.enrichment_view(fx.discussions, fx.enrichment, fx.members).select(
        "id", "status", "parent_discussion_id", "split", "segment_id", F.col("segment_no").cast("bigint").alias("segment_no"),
        "title", "sentiment", "sentiment_score", "resolved", "messages")


@query("enrich_summary", _OUTCOMES + """,
 f AS (SELECT call_id, bool_or(label = 'c1' AND messages = 5) AS bad FROM fx_labels JOIN fx_sized ON id = discussion_id GROUP BY 1),
 per AS (SELECT discussion_id, max(kind) AS kind, count(*) AS n FROM outcome GROUP BY 1)
SELECT (SELECT count(*) FROM fx_sized) AS queued, 0 AS skipped_empty, (SELECT count(*) FROM f) AS batches,
 (SELECT count(*) FROM f JOIN fx_labels USING (call_id) WHERE bad) AS individual_retries, 0 AS failed,
 count(*) FILTER (WHERE kind = 'single') AS enriched, count(*) FILTER (WHERE kind = 'split') AS split,
 coalesce(sum(n) FILTER (WHERE kind = 'split'), 0)::BIGINT AS segments FROM per""")
def enrich_summary(fx):
    mapped = cut(fx.mapped)
    outs = E.resolve_outcomes(E.partition_messages(fx.threads, mapped), mapped)
    return E.enrich_summary(fx.thread_discussions, _calls(fx), outs)


@query("inference_log", """
SELECT id AS call_id, 'p' AS provider, 'm' AS model, channel_id, job_id, '2024-02-01T00:00:00.000Z' AS started_at, duration_ms, status, prompt_tokens,
 CASE WHEN length(user_prompt) > 1000 THEN substr(user_prompt, 1, 1000) || chr(10) || '… [cut, ' || length(user_prompt) || ' characters in all]' ELSE user_prompt END AS user_prompt,
 CASE WHEN status = 'ok' THEN response END AS response FROM fx_calls""")
def inference_log(fx):
    calls = fx.calls.select(F.col("id").alias("call_id"), "context", "channel_id", "job_id", "duration_ms", "status",
                            "prompt_tokens", "completion_tokens", "error", "system_prompt",
                            F.col("user_prompt").alias("prompt"), F.col("response").alias("raw"))
    log = E.inference_log(calls, "p", "m", NOW, 1000)
    back = calls.select("call_id", F.md5(F.concat_ws("|", "call_id", "context")).alias("id"))
    return log.join(back, "id").select("call_id", "provider", "model", "channel_id", "job_id",
                                       iso(F.col("started_at")).alias("started_at"), "duration_ms", "status",
                                       "prompt_tokens", "user_prompt", "response")


@query("enrich_channels", "SELECT count(*) AS queued, 0 AS skipped_empty, 0 AS failed, count(*) AS enriched FROM fx_sized")
def enrich_channels(fx):
    """The whole enrichment stage over all conversations with the rule-based model."""
    nul = F.lit(None).cast("string")
    d = fx.thread_discussions.select(
        "id", "channel_id", nul.alias("thread_id"), "block_start_at", F.col("block_start_at").alias("block_end_at"),
        F.when(F.expr("cast(substring(id, 2) as bigint) % 2 = 0"), F.lit("clustering")).otherwise(
            F.lit("needs_reenrichment")).alias("status"),
        F.col("messages").alias("message_count"), F.lit(None).cast("array<float>").alias("centroid"),
        nul.alias("continuation_of_discussion_id"), nul.alias("continuation_reason"), nul.alias("parent_discussion_id"))
    m = fx.threads.select("id", "discussion_id", F.col("author_label").alias("author_id"), "content", "created_at")
    state = {"discussions": d, "messages": m, "users": fx.users,
             "discussion_enrichment": fx.enrichment.filter(F.lit(False))}
    _, summary = E.enrich_channels(state, rule_based, hashing_embedder(DIM), NOW)
    return summary.select("queued", "skipped_empty", "failed", "enriched")


@query("normalize_label", f"SELECT doc_id, {sql_one_line('text')} AS label FROM documents")
def normalize_labels(fx):
    return fx.table("documents").select("doc_id", normalize_label(F.col("text")).alias("label"))
