"""State of the streamed clustering: kept between micro-batches, left by dead channels, no row lost."""

import datetime as dt
import time

from pyspark.sql import functions as F

from parley.streaming.incremental import stream_subclusters

COLS = "channel_id string, id string, author_id string, mentions array<string>, created_at timestamp, vec array<float>"
T0 = dt.datetime(2024, 1, 1)


def message(channel, i, minute):
    return channel, f"{channel}{i}", "u", None, T0 + dt.timedelta(minutes=minute), [1.0, 0.0]


def run(spark, tmp_path, batches, keep_hours, wait):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "channel_id string, id string, root_id string"
    spark.createDataFrame([], COLS).write.parquet(source)
    stream = stream_subclusters(spark.readStream.schema(COLS).parquet(source), 0.5, 15, keep_hours).writeStream.option(
        "checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", out).trigger(processingTime="1 second").start()
    try:
        n = 0
        for rows in batches:
            spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(source)
            n, end = n + len(rows), time.time() + 60
            while time.time() < end and (not (tmp_path / "out" / "_spark_metadata").exists() or spark.read.schema(schema).parquet(out).count() < n):
                time.sleep(0.5)
            time.sleep(wait)
    finally:
        stream.stop()
    got = spark.read.schema(schema).parquet(out)
    assert got.count() == got.select("id").distinct().count() == n
    return {r["id"]: r["root_id"] for r in got.where(F.col("channel_id") == "a").collect()}


BATCHES = [[message("a", 1, 0), message("a", 0, 1), message("b", 0, 60)], [message("b", 1, 500)], [message("a", 2, 5), message("b", 2, 900)]]


def test_a_channel_far_behind_goes_on(spark, tmp_path):
    assert run(spark, tmp_path, BATCHES, 1, 3) == {"a1": "a1", "a0": "a1", "a2": "a1"}


def test_a_dead_channel_leaves_the_state(spark, tmp_path):
    assert run(spark, tmp_path, BATCHES, 1 / 3600, 5) == {"a1": "a1", "a0": "a1", "a2": "a2"}
