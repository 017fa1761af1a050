"""Idempotent ingest and upserts of the guild, channel and user dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import word_count
from parley.operators.ordered import keep_first


def as_ts(value) -> Column:
    return F.lit(value).cast("timestamp")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Full outer join on ``key``; ``columns`` are built from the sides ``e`` and ``n``.

    ``e._has`` and ``n._has`` tell whether a side has the row.
    """
    e = existing.withColumn("_has", F.lit(True)).alias("e")
    n = incoming.withColumn("_has", F.lit(True)).alias("n")
    joined = e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(
        F.coalesce(f"e.{key}", f"n.{key}").alias(key),
        *[expr.alias(name) for name, expr in columns.items()],
    )


def ingest_messages(
    existing: DataFrame, batch: DataFrame, batch_id: str, now
) -> tuple[DataFrame, DataFrame]:
    """New message rows of a batch, and its received / inserted / duplicate counts.

    ``batch`` carries ``pos``, its input order; the first of several equal ids wins.
    """
    fresh = keep_first(batch, ["id"], "pos").join(existing.select("id"), "id", "left_anti")
    rows = fresh.select(
        "id", "channel_id", "guild_id", "author_id", "content", "created_at",
        "reply_to_message_id", "thread_id", "mentions",
        F.coalesce("attachments_count", F.lit(0)).cast("int").alias("attachments_count"),
        word_count(F.col("content")).cast("int").alias("word_count"),
        F.lit(batch_id).alias("batch_id"),
        as_ts(now).alias("ingested_at"),
        F.lit(0).alias("processed"),
        F.lit(None).cast("string").alias("discussion_id"),
    )
    flagged = batch.select(F.lit(0).alias("_new")).unionByName(fresh.select(F.lit(1).alias("_new")))
    counts = flagged.agg(
        F.count_if(F.col("_new") == 0).alias("message_count"),
        F.count_if(F.col("_new") == 1).alias("inserted_count"),
        (F.count_if(F.col("_new") == 0) - F.count_if(F.col("_new") == 1)).alias("duplicate_count"),
    )
    return rows, counts


def upsert_guilds(existing: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Insert unseen guild ids; known rows stay as they are."""
    seen = batch.select(F.col("guild_id").alias("id")).filter("id is not null").distinct()
    return upsert(existing, seen, "id", {
        "name": F.col("e.name"),
        "created_at": F.coalesce("e.created_at", as_ts(now)),
        "names_synced_at": F.col("e.names_synced_at"),
    })


def upsert_channels(existing: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Insert unseen channels, touch known ones.

    ``type`` is overwritten only where the batch carries one; the guild of a known
    channel never changes.
    """
    seen = batch.groupBy(F.col("channel_id").alias("id")).agg(
        F.min("guild_id").alias("guild_id"), F.max("channel_type").alias("type")
    )
    is_new = F.col("e._has").isNull()
    return upsert(existing, seen, "id", {
        "guild_id": F.when(is_new, F.col("n.guild_id")).otherwise(F.col("e.guild_id")),
        "name": F.col("e.name"),
        "type": F.coalesce("n.type", "e.type"),
        "created_at": F.coalesce("e.created_at", as_ts(now)),
        "updated_at": F.when(F.col("n._has"), as_ts(now)).otherwise(F.col("e.updated_at")),
        "names_synced_at": F.col("e.names_synced_at"),
    })


def upsert_users(existing: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Insert unseen authors and widen the seen-window of known ones to ``now``.

    Duplicates widen it too; the window follows arrival, not message time.
    """
    seen = batch.select(F.col("author_id").alias("id")).distinct()
    hit = F.col("n._has")
    return upsert(existing, seen, "id", {
        "username": F.col("e.username"),
        "display_name": F.col("e.display_name"),
        "first_seen_at": F.when(hit, F.least(F.col("e.first_seen_at"), as_ts(now))).otherwise(
            F.col("e.first_seen_at")),
        "last_seen_at": F.when(hit, F.greatest(F.col("e.last_seen_at"), as_ts(now))).otherwise(
            F.col("e.last_seen_at")),
        "message_count": F.coalesce("e.message_count", F.lit(0)).cast("bigint"),
        "names_synced_at": F.col("e.names_synced_at"),
    })


def bump_user_counts(users: DataFrame, inserted: DataFrame) -> DataFrame:
    """Add the number of newly inserted messages to each author."""
    added = inserted.groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("_added"))
    total = F.col("message_count") + F.coalesce("_added", F.lit(0))
    return users.join(added, "id", "left").withColumn("message_count", total).drop("_added")


def batch_ledger(counts: DataFrame, batch_id: str, channel_id: str, now) -> DataFrame:
    """Ledger row of one batch from the counts of ``ingest_messages``."""
    return counts.select(
        F.lit(batch_id).alias("id"), F.lit(channel_id).alias("channel_id"),
        as_ts(now).alias("received_at"), "message_count", "inserted_count", "duplicate_count",
    )


def ledger(existing: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Ledger rows of many batches at once, from rows tagged with batch id and channel."""
    firsts = keep_first(batch, ["id"], "pos").join(existing.select("id"), "id", "left_anti")
    received = batch.groupBy("batch_id", "channel_id").agg(F.count("*").alias("message_count"))
    inserted = firsts.groupBy("batch_id", "channel_id").agg(F.count("*").alias("inserted_count"))
    counted = received.join(inserted, ["batch_id", "channel_id"], "left").fillna(0, ["inserted_count"])
    return counted.select(
        F.col("batch_id").alias("id"), "channel_id", as_ts(now).alias("received_at"),
        "message_count", "inserted_count",
        (F.col("message_count") - F.col("inserted_count")).alias("duplicate_count"),
    )


def ingest(state: dict[str, DataFrame], batch: DataFrame, batch_id: str, now) -> dict[str, DataFrame]:
    """Apply one batch to the staging tables and return the changed ones."""
    new_rows, counts = ingest_messages(state["messages"], batch, batch_id, now)
    ledger_rows = ledger(state["messages"], batch.withColumn("batch_id", F.lit(batch_id)), now)
    users = bump_user_counts(upsert_users(state["users"], batch, now), new_rows)
    return {
        **state,
        "guilds": upsert_guilds(state["guilds"], batch, now),
        "channels": upsert_channels(state["channels"], batch, now),
        "users": users,
        "messages": state["messages"].unionByName(new_rows),
        "ingestion_batches": state["ingestion_batches"].unionByName(ledger_rows),
    }


def reset_channels(
    state: dict[str, DataFrame], channel_ids: list[str]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete everything staged for some channels; also how much was deleted."""
    dead = F.col("channel_id").isin(channel_ids)
    gone = state["discussions"].filter(dead).select(F.col("id").alias("discussion_id"))
    out = dict(state)
    for name in ("messages", "discussions", "channel_checkpoints"):
        out[name] = state[name].filter(~dead)
    enrichment = state["discussion_enrichment"]
    out["discussion_enrichment"] = enrichment.join(gone, "discussion_id", "left_anti")

    def tagged(df: DataFrame, table: str) -> DataFrame:
        return df.agg(F.count("*").alias("deleted")).select(F.lit(table).alias("table_name"), "deleted")

    counts = tagged(state["messages"].filter(dead), "messages")
    counts = counts.unionByName(tagged(state["discussions"].filter(dead), "discussions"))
    counts = counts.unionByName(
        tagged(enrichment.join(gone, "discussion_id", "left_semi"), "discussion_enrichment"))
    return out, counts.unionByName(
        tagged(state["channel_checkpoints"].filter(dead), "channel_checkpoints"))
