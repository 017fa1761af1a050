"""Canonical schemas, enumerations and defaults of the engine."""

from __future__ import annotations

# fixed values: enumerations of the data model
DISCUSSION_STATUSES = ["clustering", "needs_reenrichment", "enriched", "split", "written"]
DISCUSSION_TYPES = ["question", "help-request", "discussion", "announcement", "off-topic", "banter", "other"]
SENTIMENTS = ["positive", "neutral", "negative", "mixed"]
ENTITY_TYPES = ["person", "product", "technology", "organization", "place", "event", "other"]
QUERY_INTENTS = ["opinion", "troubleshooting", "factual", "summary", "person-activity", "timeline", "other"]
CONFIDENCES = ["high", "medium", "low"]
NODE_LABELS = ["Discussion", "Topic", "Entity", "User", "Channel", "Guild"]

# fixed values: default parameters
DEFAULTS = {
    "gap_minutes": 30,
    "word_limit": 6,
    "tau": 0.85,
    "idle_minutes": 15,
    "dim": 384,
    "author_bonus": 0.03,
    "mention_bonus": 0.05,
    "max_messages_per_call": 400,
    "batch_target_tokens": 6000,
    "batch_max_discussions": 25,
    "vector_top_k": 40,
    "anchor_limit": 30,
    "search_query_variants": 3,
    "expansion_seeds": 8,
    "expansion_fanout": 5,
    "evidence": 10,
    "raw_discussions": 4,
    "raw_messages": 40,
    "context_tokens": 12000,
    "min_score": 0.35,
    "weight_vector": 1.0,
    "weight_anchor": 0.6,
    "weight_expansion": 0.4,
    "weight_recency": 0.15,
    "weight_type": 0.15,
    "resolved_bonus": 0.05,
    "half_life_days": 120,
}


# Schemas are DDL strings, so that importing them needs no session.


def columns(ddl: str) -> list[str]:
    """Top-level column names of a DDL schema."""
    names, depth, field = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            names.append(field.split()[0])
            field = ""
        else:
            field += ch
    return names


DUMP = (
    "id STRING, channel_id STRING, author_id STRING, content STRING, "
    "created_at STRING, deleted_at STRING"
)

BATCH_MESSAGE = (
    "id: STRING, author: STRUCT<id: STRING>, content: STRING, created_at: STRING, "
    "reply_to_message_id: STRING, thread_id: STRING, mentions: ARRAY<STRING>, "
    "attachments_count: INT"
)
BATCH = (
    "guild STRUCT<id: STRING>, channel STRUCT<id: STRING, type: STRING>, "
    f"messages ARRAY<STRUCT<{BATCH_MESSAGE}>>"
)

STATE = {
    "guilds": ("id STRING, name STRING, created_at TIMESTAMP, names_synced_at TIMESTAMP"),
    "channels": (
        "id STRING, guild_id STRING, name STRING, type STRING, created_at TIMESTAMP, "
        "updated_at TIMESTAMP, names_synced_at TIMESTAMP"
    ),
    "users": (
        "id STRING, username STRING, display_name STRING, first_seen_at TIMESTAMP, "
        "last_seen_at TIMESTAMP, message_count BIGINT, names_synced_at TIMESTAMP"
    ),
    "ingestion_batches": (
        "id STRING, channel_id STRING, received_at TIMESTAMP, message_count BIGINT, "
        "inserted_count BIGINT, duplicate_count BIGINT"
    ),
    "messages": (
        "id STRING, channel_id STRING, guild_id STRING, author_id STRING, content STRING, "
        "created_at TIMESTAMP, reply_to_message_id STRING, thread_id STRING, "
        "mentions ARRAY<STRING>, attachments_count INT, word_count INT, batch_id STRING, "
        "ingested_at TIMESTAMP, processed INT, discussion_id STRING"
    ),
    "channel_checkpoints": (
        "channel_id STRING, last_closed_block_end_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "discussions": (
        "id STRING, channel_id STRING, thread_id STRING, block_start_at TIMESTAMP, "
        "block_end_at TIMESTAMP, status STRING, message_count BIGINT, centroid ARRAY<FLOAT>, "
        "continuation_of_discussion_id STRING, continuation_reason STRING, "
        "parent_discussion_id STRING"
    ),
    "discussion_enrichment": (
        "discussion_id STRING, title STRING, summary STRING, topics ARRAY<STRING>, "
        "entities ARRAY<STRUCT<name: STRING, type: STRING>>, key_points ARRAY<STRING>, "
        "sentiment STRING, sentiment_score DOUBLE, language STRING, discussion_type STRING, "
        "resolved BOOLEAN, embedding ARRAY<FLOAT>, raw_response STRING, enriched_at TIMESTAMP"
    ),
    "inference_log": (
        "id STRING, provider STRING, model STRING, context STRING, channel_id STRING, "
        "job_id STRING, started_at TIMESTAMP, duration_ms BIGINT, status STRING, "
        "prompt_tokens BIGINT, completion_tokens BIGINT, error STRING, system_prompt STRING, "
        "user_prompt STRING, response STRING"
    ),
    "query_history": (
        "id STRING, question STRING, "
        "filters STRUCT<channel_ids: ARRAY<STRING>, discussion_types: ARRAY<STRING>, since: TIMESTAMP>, "
        "answer STRING, confidence STRING, used_discussion_count BIGINT, created_at TIMESTAMP"
    ),
}

SEGMENT = (
    "message_ids: ARRAY<STRING>, title: STRING, summary: STRING, topics: ARRAY<STRING>, "
    "entities: ARRAY<STRUCT<name: STRING, type: STRING>>, key_points: ARRAY<STRING>, "
    "sentiment: STRING, sentiment_score: DOUBLE, language: STRING, discussion_type: STRING, "
    "resolved: BOOLEAN, source_cluster: STRING"
)
SEGMENTS_RESPONSE = f"STRUCT<segments: ARRAY<STRUCT<{SEGMENT}>>>"
PLAN_RESPONSE = (
    "STRUCT<search_queries: ARRAY<STRING>, topics: ARRAY<STRING>, entities: ARRAY<STRING>, "
    "intent: STRING, preferred_discussion_types: ARRAY<STRING>, answer_language: STRING>"
)
ANSWER_RESPONSE = (
    "STRUCT<answer: STRING, used_citations: ARRAY<STRING>, confidence: STRING, caveats: STRING>"
)
