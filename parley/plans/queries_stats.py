"""Listings, retention and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.text import iso
from parley.operators import listing as L
from parley.operators import segment as S
from parley.operators import stats as T
from parley.plans.fixture_sql import iso as sql_iso
from parley.plans.fixtures import NOW
from parley.plans.registry import query

_PAGE = f"""
SELECT id, model, {sql_iso('started_at')} AS started_at, rn, CASE WHEN rn = 50 AND n > 50 THEN {sql_iso('started_at')} || '__' || id END AS next_cursor
FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS rn, count(*) OVER () AS n FROM fx_calls WHERE {{}}) WHERE rn <= 50"""


def _page(df):
    return df.select("id", "model", iso(F.col("started_at")).alias("started_at"), F.col("rn").cast("bigint").alias("rn"), "next_cursor")


@query("keyset_page", _PAGE.format("(started_at, id) < (TIMESTAMP '2024-01-20 12:00:00', '5')"))
def keyset_page(fx):
    return _page(L.keyset_page(fx.calls, "started_at", "id", "2024-01-20T12:00:00.000Z__5", 50))


@query("call_page", _PAGE.format("status = 'error' AND model = 'click'"))
def call_page(fx):
    return _page(L.call_page(fx.calls, limit=50, status="error", model="click", job_id=None))


@query("filter_eq", "SELECT id FROM fx_calls WHERE status = 'ok' AND job_id = 'j7'")
def filter_eq(fx):
    return L.filter_eq(fx.calls, status="ok", job_id="j7", model=None).select("id")


@query("retain", """
WITH y AS (SELECT id, started_at FROM fx_calls WHERE started_at >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY)
SELECT id FROM y WHERE started_at >= (SELECT min(started_at) FROM (SELECT started_at FROM y ORDER BY started_at DESC LIMIT 3000))""")
def retain(fx):
    return L.retain(fx.calls.select("id", "started_at"), "started_at", NOW, 14, 3000).select("id")


@query("call_detail", f"SELECT id, {sql_iso('started_at')} AS started_at, system_prompt, user_prompt, response FROM fx_calls WHERE status = 'error'")
def call_detail(fx):
    ids = fx.slim_calls.filter("status = 'error'").select("id")
    return fx.with_prompts(L.call_detail(fx.slim_calls, ids)).select("id", iso(F.col("started_at")).alias("started_at"), "system_prompt", "user_prompt", "response")


@query("clear", "SELECT count(*) AS deleted, 0 AS kept FROM fx_calls")
def clear(fx):
    empty, count = L.clear(fx.calls.select("id"))
    kept = empty.agg(F.count("*").alias("kept"))
    return count.withColumn("_k", F.lit(1)).join(kept.withColumn("_k", F.lit(1)), "_k").drop("_k")


_FUNNEL = """SELECT count(*) AS raw, count(m.discussion_id) AS clustered, count(d.id) AS enriched, count(*) FILTER (WHERE m.processed = 3) AS written
FROM fx_slim m LEFT JOIN fx_discussions d ON d.id = m.discussion_id AND d.status IN ('enriched', 'written')"""


@query("funnel", _FUNNEL)
def funnel(fx):
    return T.funnel(fx.slim_messages, fx.discussions)


@query("funnel_pct", f"""
SELECT round(100 * raw / greatest(raw, 1), 1) AS raw_pct, round(100 * clustered / greatest(raw, 1), 1) AS clustered_pct,
 round(100 * enriched / greatest(raw, 1), 1) AS enriched_pct, round(100 * written / greatest(raw, 1), 1) AS written_pct FROM ({_FUNNEL})""")
def funnel_pct(fx):
    return T.funnel_pct(T.funnel(fx.slim_messages, fx.discussions))


@query("totals", f"""
SELECT 'channels' AS metric, (SELECT count(*) FROM fx_channels)::VARCHAR AS value
UNION ALL SELECT 'messages', (SELECT count(*) FROM fx_slim)::VARCHAR UNION ALL SELECT 'users', (SELECT count(*) FROM fx_users)::VARCHAR
UNION ALL SELECT 'discussions', (SELECT count(*) FROM fx_discussions WHERE status <> 'split')::VARCHAR
UNION ALL SELECT 'topics', (SELECT count(DISTINCT t) FROM (SELECT unnest(topics) AS t FROM fx_enrichment))::VARCHAR
UNION ALL SELECT 'entities', (SELECT count(DISTINCT e.type || ':' || e.name) FROM (SELECT unnest(entities) AS e FROM fx_enrichment))::VARCHAR
UNION ALL SELECT 'last_ingested_at', (SELECT {sql_iso('max(ingested_at)')} FROM fx_slim)""")
def totals(fx):
    return T.totals(fx.channels, fx.slim_messages, fx.users, fx.discussions, fx.enrichment)


@query("messages_per_channel", "SELECT m.channel_id, c.name, count(*) AS count FROM fx_slim m LEFT JOIN fx_channels c ON c.id = m.channel_id GROUP BY 1, 2")
def messages_per_channel(fx):
    return T.messages_per_channel(fx.slim_messages, fx.channels)


@query("clusters_per_channel", """
SELECT d.channel_id, c.name, count(DISTINCT d.id) AS discussions, coalesce(sum(d.message_count), 0)::BIGINT AS messages,
 round(sum(d.message_count)::DOUBLE / count(DISTINCT d.id), 1) AS avg_messages
FROM fx_discussions d LEFT JOIN fx_channels c ON c.id = d.channel_id WHERE d.status <> 'split' GROUP BY 1, 2""")
def clusters_per_channel(fx):
    return T.clusters_per_channel(fx.discussions, fx.channels)


_BUCKETS = "(VALUES (0, '1', 1, 1), (1, '2–3', 2, 3), (2, '4–7', 4, 7), (3, '8–15', 8, 15), (4, '16–31', 16, 31), (5, '32+', 32, 2147483647)) b(ord, bucket, lo, hi)"


@query("size_histogram", f"""
SELECT b.ord, b.bucket, count(d.id) AS count FROM {_BUCKETS} LEFT JOIN fx_discussions d ON d.status <> 'split' AND d.message_count BETWEEN b.lo AND b.hi GROUP BY 1, 2""")
def size_histogram(fx):
    return T.size_histogram(fx.discussions.filter("status <> 'split'"))


def block_histogram_of(fx):
    """Silence-gap blocks of the main stream, by size."""
    return T.size_histogram(S.block_sizes(fx.slim_blocks), "messages")


@query("block_histogram", f"""
SELECT b.ord, b.bucket, count(s.n) AS count FROM {_BUCKETS} LEFT JOIN (SELECT count(*) AS n FROM fx_blocks GROUP BY channel_id, block_no) s ON s.n BETWEEN b.lo AND b.hi GROUP BY 1, 2""")
def block_histogram(fx):
    return block_histogram_of(fx)


@query("type_counts", "SELECT discussion_type AS label, count(*) AS count FROM fx_enrichment WHERE discussion_type IS NOT NULL GROUP BY 1")
def type_counts(fx):
    return T.type_counts(fx.enrichment)


@query("sentiment_counts", "SELECT sentiment AS label, count(*) AS count FROM fx_enrichment WHERE sentiment IS NOT NULL GROUP BY 1")
def sentiment_counts(fx):
    return T.sentiment_counts(fx.enrichment)


@query("top_topics", "SELECT name, count(*) AS count FROM (SELECT unnest(topics) AS name FROM fx_enrichment) GROUP BY 1 ORDER BY count DESC, name LIMIT 15")
def top_topics(fx):
    return T.top_topics(fx.enrichment)


@query("top_entities", """
SELECT e.type || ':' || e.name AS key, min(e.name) AS name, min(e.type) AS type, count(*) AS count FROM (SELECT unnest(entities) AS e FROM fx_enrichment)
GROUP BY 1 ORDER BY count DESC, key LIMIT 15""")
def top_entities(fx):
    return T.top_entities(fx.enrichment)


@query("inference_stats", """
SELECT count(*) AS total_calls, round(count(*) FILTER (WHERE status = 'error') / count(*), 3) AS error_rate, round(avg(duration_ms))::BIGINT AS avg_ms,
 quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms FROM fx_calls""")
def inference_stats(fx):
    return T.inference_stats(fx.calls)


@query("inference_by_model", "SELECT model, count(*) AS calls, round(avg(duration_ms))::BIGINT AS avg_ms, quantile_disc(duration_ms, 0.95) AS p95_ms FROM fx_calls GROUP BY 1")
def inference_by_model(fx):
    return T.inference_by_model(fx.calls)


_LATEST = "TIMESTAMP '2024-01-30 23:00:00'"
_SERIES = f"""
SELECT strftime(started_at, '%Y-%m-%dT%H:%M') AS ts_bucket, count(*) AS calls, round(avg(duration_ms))::BIGINT AS avg_ms
FROM fx_calls WHERE started_at >= {_LATEST} - INTERVAL 600 MINUTE GROUP BY 1"""


@query("inference_timeseries", _SERIES)
def inference_timeseries(fx):
    return T.inference_timeseries(fx.calls, "2024-01-30 23:00:00", 600)


@query("calls_per_minute", f"SELECT coalesce(arg_max(calls, ts_bucket), 0) AS calls_per_minute FROM ({_SERIES})")
def calls_per_minute(fx):
    return T.calls_per_minute(T.inference_timeseries(fx.calls, "2024-01-30 23:00:00", 600))
