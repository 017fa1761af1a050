"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.cluster import ActiveClusters, thread_discussions
from parley.operators.ingest import bump_user_counts, ingest_messages, ledger, upsert_channels, upsert_guilds, upsert_users
from parley.operators.segment import channel_max, closed_blocks, time_blocks
from parley.schemas import DEFAULTS, STATE
from parley.session import cut
from parley.sources.batches import validate_batches


def stream_batches(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Batch documents as they arrive in a folder: doc, value."""
    return (
        spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger)
        .format("text").load(folder).select(F.input_file_name().alias("doc"), "value")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _read(spark: SparkSession, folder: str, table: str, but: str) -> DataFrame:
    """Rows of an append-only table, without those that micro-batch ``but`` has written."""
    path = f"{folder}/{table}"
    if not _exists(spark, path):
        return spark.createDataFrame([], STATE[table])
    return spark.read.schema(f"{STATE[table]}, batch STRING").parquet(path).filter(F.col("batch") != but).drop("batch")


def _states(spark: SparkSession, folder: str, table: str, but: str) -> list[str]:
    """The numbered states of a table that other micro-batches have left, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in names if n.startswith("state=") and not n.endswith(f"-{but}"))


def _latest(spark: SparkSession, folder: str, table: str, but: str) -> tuple[int, DataFrame]:
    """The newest state of a table that another micro-batch has left, and its number."""
    states = _states(spark, folder, table, but)
    if not states:
        return 0, spark.createDataFrame([], STATE[table])
    return int(states[-1][6:18]), spark.read.schema(STATE[table]).parquet(f"{folder}/{table}/{states[-1]}")


def ingest_epoch(spark: SparkSession, folder: str, batch: DataFrame, name: str, now) -> None:
    """Ingest one micro-batch into the folder's tables, exactly once per message id.

    ``name`` tells micro-batches apart, also those of different checkpoints over one folder.
    Each owns one partition of the append-only tables (messages, ledger) and one numbered state
    of the dimensions (users, channels, guilds), and overwrites them, so a repeated one changes
    nothing and a new checkpoint goes on from what there is. Known ids are checked over all
    earlier micro-batches, however old; the check reads the id column only.
    """
    old = _read(spark, folder, "messages", name)
    rows, _ = ingest_messages(old, batch, name, now)
    target = f"{folder}/messages/batch={name}"
    rows.write.mode("overwrite").parquet(target)
    written = spark.read.schema(STATE["messages"]).parquet(target)
    ledger(old, batch.withColumn("batch_id", F.lit(name)), now).write.mode("overwrite").parquet(f"{folder}/ingestion_batches/batch={name}")

    def state(table: str, step: Callable[[DataFrame], DataFrame]) -> None:
        number, before = _latest(spark, folder, table, name)
        step(before).write.mode("overwrite").parquet(f"{folder}/{table}/state={number + 1:012d}-{name}")

    state("users", lambda t: bump_user_counts(upsert_users(t, batch, now), written))
    state("channels", lambda t: upsert_channels(t, batch, now))
    state("guilds", lambda t: upsert_guilds(t, batch, now))


def table_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table as the stream has left it so far."""
    if table in ("messages", "ingestion_batches"):
        return _read(spark, folder, table, "")
    return _latest(spark, folder, table, "")[1]


def stream_ingest(
    documents: DataFrame, folder: str, checkpoint: str, now: Callable[[], object],
):
    """Start ingesting a stream of batch documents; rejected ones go to ``quarantine``."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def each(df: DataFrame, epoch: int) -> None:
        name = f"{run}_{epoch:09d}"
        # documents are parsed once: messages are used for every table, rejects for the quarantine
        messages, bad = validate_batches(df, cut)
        ingest_epoch(df.sparkSession, folder, messages, name, now())
        bad.write.mode("overwrite").parquet(f"{folder}/quarantine/batch={name}")

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def dedupe_within(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Bounded form of idempotent arrival: repeats within the delay are dropped."""
    return messages.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def closed_sessions(messages: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Silence-gap blocks of a message stream, each emitted once when it has closed.

    The watermark covers all channels together: a quiet channel's block closes when
    the others have moved on. Rows later than the delay are dropped.
    """
    return (
        messages.withWatermark("created_at", delay)
        .groupBy("channel_id", F.session_window("created_at", gap).alias("w"))
        .agg(F.count("*").alias("messages"), F.min("created_at").alias("start_at"),
             F.max("created_at").alias("end_at"))
        .select("channel_id", "start_at", "end_at", "messages")
    )


def stream_sessions(messages: DataFrame, folder: str, checkpoint: str, gap_minutes: float = 30):
    """Start keeping the silence-gap blocks of a message stream; nothing is late.

    Input: id, channel_id, created_at. Every micro-batch is appended to the folder's messages. The
    blocks of the channels that it touches are derived anew from all their messages, so a row of
    any age still counts. A block is closed by its own channel's newest message. ``read_sessions``
    gives the blocks in force. Micro-batches are named as in ``ingest_epoch``: a repeated one
    overwrites its own rows, a new checkpoint goes on from what is there, and a message that it
    reads again counts once (by its id and earliest time; messages without an id count each).
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def each(df: DataFrame, epoch: int) -> None:
        spark, name = df.sparkSession, f"{run}_{epoch:09d}"
        target = f"{folder}/rows/batch={name}"
        df.select("id", "channel_id", "created_at").write.mode("overwrite").parquet(target)
        rows = df.select("id", "channel_id", "created_at").schema
        stored = spark.read.schema(rows).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
        touched = stored.join(spark.read.schema(rows).parquet(target).select("channel_id").distinct(), "channel_id", "left_semi")
        touched = touched.filter("id is not null").groupBy("channel_id", "id").agg(F.min("created_at").alias("created_at")).unionByName(
            touched.filter("id is null"))
        states = _states(spark, folder, "sessions", name)
        number = int(states[-1][6:18]) + 1 if states else 1
        blocks = closed_blocks(time_blocks(touched, gap_minutes), channel_max(touched), gap_minutes)
        blocks.groupBy("channel_id", "block_no").agg(
            F.min("block_start_at").alias("start_at"), F.max("block_end_at").alias("end_at"), F.count("*").alias("messages"),
            F.bool_and("closed").alias("closed")).write.mode("overwrite").parquet(f"{folder}/sessions/state={number:012d}-{name}")

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of each channel as its last micro-batch left them."""
    every = spark.read.parquet(f"{folder}/sessions")
    last = every.groupBy("channel_id").agg(F.max("state").alias("state"))
    return every.join(last, ["channel_id", "state"], "left_semi").drop("state")


def funnel_stream(messages: DataFrame) -> DataFrame:
    """Running message counts per channel and state, for a periodic tick."""
    return messages.groupBy("channel_id", "processed").agg(F.count("*").alias("messages"))


def stream_subclusters(
    messages: DataFrame, tau: float = DEFAULTS["tau"], idle_minutes: float = DEFAULTS["idle_minutes"], keep_hours: float | None = None,
) -> DataFrame:
    """Online clustering of a stream of long messages, state kept per channel.

    Input: channel_id, id, author_id, mentions, created_at, vec, in time order within a
    channel over micro-batches. A silence longer than ``idle_minutes`` retires all clusters,
    so blocks need no marker. Every row gets a cluster, however far its channel is behind
    others: there is no watermark. State holds a channel's active clusters only. With
    ``keep_hours`` a channel that sent nothing for so long, by processing time, leaves the state;
    should it go on within ``idle_minutes`` of its own time after that, its next message opens a
    new cluster, and only then does the result differ from the batch form. With such a timer Spark
    runs micro-batches without end, so it is for triggers by time, not for ``availableNow``. The
    size of a micro-batch, set at the source, bounds what one task sees.
    """
    settings = (tau, int(idle_minutes * 60_000), DEFAULTS["author_bonus"], DEFAULTS["mention_bonus"])

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active = ActiveClusters(*settings)
        for root, vec, members, last_ms, authors in json.loads(state.get[0]) if state.exists else []:
            active.add(root, np.asarray(vec, dtype=np.float32), members, last_ms, authors)
        # the rows of a channel come in any order: tuples are sorted, frames are let go one by one
        batch: list[tuple] = []
        for frame in frames:
            batch += frame[["ms", "id", "author_id", "mentions", "vec"]].itertuples(index=False, name=None)
        batch.sort(key=lambda r: r[:2])
        for at in range(0, len(batch), 1000):
            some = batch[at: at + 1000]
            roots = [active.place(mid, ms, author, mentions, vec) for ms, mid, author, mentions, vec in some]
            yield pd.DataFrame({"channel_id": key[0], "id": [r[1] for r in some], "root_id": roots})
        state.update((json.dumps(active.rows()),))
        if keep_hours is not None:
            state.setTimeoutDuration(max(1, int(keep_hours * 3_600_000)))

    # no event-time timer: with one, Spark takes away rows behind the watermark of all channels
    rows = messages.select("channel_id", "id", "author_id", "mentions", F.unix_millis("created_at").alias("ms"), "vec")
    return rows.groupBy("channel_id").applyInPandasWithState(
        run, "channel_id string, id string, root_id string", "clusters string", "append", "NoTimeout" if keep_hours is None else "ProcessingTimeTimeout")


def extend_threads(threads: DataFrame, known: DataFrame) -> DataFrame:
    """Thread discussions after one more batch: totals and spans over old and new.

    ``known``: id, channel_id, thread_id, block_start_at, block_end_at, message_count,
    parent_discussion_id.
    """
    step = thread_discussions(threads, known)
    old = known.select(F.col("id").alias("discussion_id"), "channel_id", "thread_id", "block_start_at",
                       "block_end_at", "message_count", "parent_discussion_id")
    both = old.unionByName(step.drop("is_extension").withColumn("parent_discussion_id", F.lit(None).cast("string")))
    return both.groupBy("discussion_id", "channel_id", "thread_id").agg(
        F.min("block_start_at").alias("block_start_at"), F.max("block_end_at").alias("block_end_at"),
        F.sum("message_count").alias("message_count"), F.max("parent_discussion_id").alias("parent_discussion_id"),
    ).withColumnRenamed("discussion_id", "id")
