"""Scan windows, threads, silence-gap blocks and their open or closed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordered import row_index

ORDER = ["created_at", "id"]


def scan_unprocessed(messages: DataFrame, max_messages: int | None = None) -> DataFrame:
    """Unprocessed messages, at most the first ``max_messages`` of each channel.

    Positions come from an ordered scan, so one busy channel is no single task.
    """
    raw = messages.filter(F.col("processed") == 0)
    if max_messages is None:
        return raw
    numbered = row_index(raw, ["channel_id"], ORDER, "_rn")
    return numbered.filter(F.col("_rn") <= max_messages).drop("_rn")


def split_threads(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main-stream messages and thread messages."""
    in_thread = F.coalesce(F.col("thread_id"), F.lit("")) != ""
    return scanned.filter(~in_thread), scanned.filter(in_thread)


def gap_runs(
    df: DataFrame, keys: list[str], gap_ms: int, run: str, time_col: str = "created_at"
) -> DataFrame:
    """Number the runs of rows that no silence longer than ``gap_ms`` interrupts.

    Time is cut into slots one gap wide. Two rows of a slot are always closer
    than the gap, so a run can only end between slots: one min and max per
    (key, slot) decides every boundary. Rows are pre-aggregated with map-side
    combine, the window sees slots instead of rows, and the number is joined back
    on (key, slot). Also returns the start and end of each run.
    """
    slot = F.floor(F.unix_millis(time_col) / F.lit(gap_ms)).alias("_slot")
    rows = df.select("*", slot)
    slots = rows.groupBy(*keys, "_slot").agg(
        F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi")
    )
    by_time = Window.partitionBy(*keys).orderBy("_slot")
    silence = F.unix_millis("_lo") - F.unix_millis(F.lag("_hi").over(by_time))
    flagged = slots.withColumn("_new", F.when(silence > gap_ms, 1).otherwise(0))
    numbered = flagged.withColumn(run, F.sum("_new").over(by_time).cast("bigint"))
    whole = Window.partitionBy(*keys, run)
    spans = numbered.select(
        *keys, "_slot", run,
        F.min("_lo").over(whole).alias(f"{run}_start"), F.max("_hi").over(whole).alias(f"{run}_end"),
    )
    return rows.join(spans, [*keys, "_slot"]).drop("_slot")


def time_blocks(main: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Add block_no (from 0 per channel), block_start_at and block_end_at."""
    runs = gap_runs(main, ["channel_id"], int(gap_minutes * 60_000), "block_no")
    return runs.withColumnRenamed("block_no_start", "block_start_at").withColumnRenamed(
        "block_no_end", "block_end_at")


def channel_max(messages: DataFrame) -> DataFrame:
    """Newest message time per channel, over all messages in any state."""
    return messages.groupBy("channel_id").agg(F.max("created_at").alias("max_ts"))


def closed_blocks(blocks: DataFrame, maxima: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Add ``closed``: false where the channel may still extend the block.

    A block with a later block after it always closes, since that block starts
    more than one gap after it and lies before the channel's newest message.
    """
    rest = F.unix_millis("max_ts") - F.unix_millis("block_end_at")
    joined = blocks.join(maxima, "channel_id", "left")
    return joined.withColumn("closed", rest > int(gap_minutes * 60_000)).drop("max_ts")


def open_block_backlog(blocks: DataFrame) -> DataFrame:
    """Messages per channel waiting in an open block."""
    return blocks.groupBy("channel_id").agg(
        F.count_if(~F.col("closed")).alias("skipped_open_messages"))


def long_messages(df: DataFrame, word_limit: int = 6) -> DataFrame:
    return df.filter(F.col("word_count") >= word_limit)


def block_sizes(blocks: DataFrame) -> DataFrame:
    """One row per block: size and span."""
    return blocks.groupBy("channel_id", "block_no").agg(
        F.count("*").alias("messages"), F.min("created_at").alias("start_at"),
        F.max("created_at").alias("end_at"),
    )
