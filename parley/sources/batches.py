"""Batch documents ``{guild, channel, messages[]}`` with strict validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import normalize_ts
from parley.schemas import BATCH

# fixed values: keys allowed at each level
ALLOWED = {
    "$": ["guild", "channel", "messages"],
    "$.guild": ["id"],
    "$.channel": ["id", "type"],
    "message": [
        "id", "author", "content", "created_at", "reply_to_message_id", "thread_id",
        "mentions", "attachments_count",
    ],
}


def _unknown(keys: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(F.coalesce(keys, F.array()), F.array(*map(F.lit, allowed)))) > 0


def validate_batches(raw: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split raw JSON documents (columns ``doc``, ``value``) into message rows and rejects.

    ``doc`` names a document and orders it among the others; ``pos`` orders all
    messages by document, then by place inside it.

    A document is rejected whole: for broken JSON, an unknown key at any level, a
    missing id or text, a value of the wrong type, an unreadable time, or an empty
    message list. So one bad document stops neither a read nor a stream. ``keep`` stores message
    rows and rejects in one table from which both are read, so that documents are parsed once.
    """
    docs = raw.select("doc", "value", F.from_json("value", BATCH).alias("b"))
    # each message again as its own text, so its keys can be checked
    msgs_json = F.from_json(F.get_json_object("value", "$.messages"), "array<string>")
    bad_message = F.exists(
        msgs_json,
        lambda m: _unknown(F.json_object_keys(m), ALLOWED["message"])
        | _unknown(F.json_object_keys(F.get_json_object(m, "$.author")), ["id"]),
    )
    missing = F.exists(
        "b.messages",
        lambda m: (F.coalesce(m["id"], F.lit("")) == "")
        | (F.coalesce(m["author"]["id"], F.lit("")) == "")
        | m["content"].isNull()
        | (F.coalesce(m["created_at"], F.lit("")) == "")
        | F.coalesce(m["attachments_count"] < 0, F.lit(False)),
    )

    def kind(m: Column, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(m), path, "variant")), F.lit("VOID"))

    texts = ["$.id", "$.author.id", "$.content", "$.created_at"]
    optional = ["$.reply_to_message_id", "$.thread_id"]
    mistyped = F.exists(msgs_json, lambda m: F.array_contains(F.array(
        *[kind(m, p) != "STRING" for p in texts], *[~kind(m, p).isin("STRING", "VOID") for p in optional],
        ~kind(m, "$.attachments_count").isin("BIGINT", "VOID"), ~kind(m, "$.mentions").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")), F.lit(True)))
    bad_time = F.exists("b.messages", lambda m: normalize_ts(m["created_at"], strict=False).isNull())
    reason = (
        F.when(F.json_object_keys("value").isNull(), F.lit("not a JSON object"))
        .when(_unknown(F.json_object_keys("value"), ALLOWED["$"]), F.lit("unknown key"))
        .when(_unknown(F.json_object_keys(F.get_json_object("value", "$.guild")), ALLOWED["$.guild"]),
              F.lit("unknown guild key"))
        .when(_unknown(F.json_object_keys(F.get_json_object("value", "$.channel")), ALLOWED["$.channel"]),
              F.lit("unknown channel key"))
        .when((F.coalesce("b.guild.id", F.lit("")) == "") | (F.coalesce("b.channel.id", F.lit("")) == ""),
              F.lit("missing guild or channel id"))
        .when(F.coalesce(F.size("b.messages"), F.lit(0)) <= 0, F.lit("no messages"))
        .when(F.coalesce(bad_message, F.lit(True)), F.lit("unknown message key"))
        .when(missing, F.lit("incomplete message"))
        .when(mistyped, F.lit("value of a wrong type"))
        .when(bad_time, F.lit("unreadable time"))
    )
    judged = docs.withColumn("reason", reason)
    rows = judged.select(
        "doc", F.when(F.col("reason").isNotNull(), F.col("value")).alias("value"), "reason", "b.guild", "b.channel",
        F.when(F.col("reason").isNull(), F.col("b.messages")).alias("messages"),
    ).select("doc", "value", "reason", "guild", "channel", F.posexplode_outer("messages").alias("n", "m"))
    if keep is not None:
        rows = keep(rows)
    good = rows.filter("reason is null")
    pos = F.concat("doc", F.lit("#"), F.lpad(F.col("n").cast("string"), 12, "0"))
    messages = good.select(
        F.col("m.id").alias("id"), F.col("channel.id").alias("channel_id"), F.col("channel.type").alias("channel_type"),
        F.col("guild.id").alias("guild_id"),
        F.col("m.author.id").alias("author_id"), F.col("m.content").alias("content"),
        normalize_ts(F.col("m.created_at")).alias("created_at"),
        "m.reply_to_message_id", "m.thread_id", "m.mentions", "m.attachments_count", pos.alias("pos"),
    )
    return messages, rows.filter("reason is not null").select("doc", "value", "reason")


def read_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read batch documents, one JSON document per file, and validate them."""
    raw = spark.read.text(path, wholetext=True)
    return validate_batches(raw.select(F.input_file_name().alias("doc"), "value"))
