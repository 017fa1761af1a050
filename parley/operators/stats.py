"""Dashboard statistics. Each one pre-aggregates map-side and shuffles groups only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import iso
from parley.operators.ingest import as_ts

# fixed values: discussion size buckets (label, from, to)
SIZE_BUCKETS = [("1", 1, 1), ("2–3", 2, 3), ("4–7", 4, 7), ("8–15", 8, 15), ("16–31", 16, 31), ("32+", 32, None)]


def funnel(messages: DataFrame, discussions: DataFrame) -> DataFrame:
    """Messages raw, clustered, enriched (or further) and written."""
    done = discussions.filter(F.col("status").isin("enriched", "written")).select(
        F.col("id").alias("discussion_id"), F.lit(1).alias("_e"))
    m = messages.select("processed", "discussion_id").join(done, "discussion_id", "left")
    return m.agg(
        F.count("*").alias("raw"), F.count("discussion_id").alias("clustered"),
        F.count_if(F.col("_e") == 1).alias("enriched"), F.count_if(F.col("processed") == 3).alias("written"))


def funnel_pct(funnel_row: DataFrame) -> DataFrame:
    """Each step of the funnel in percent of raw."""
    raw = F.greatest("raw", F.lit(1))
    return funnel_row.select(*[
        F.round(100 * F.col(c) / raw, 1).alias(f"{c}_pct") for c in ("raw", "clustered", "enriched", "written")])


def totals(
    channels: DataFrame, messages: DataFrame, users: DataFrame, discussions: DataFrame,
    enrichment: DataFrame,
) -> DataFrame:
    """Headline counts as (metric, value), value as text."""
    def one(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("string").alias("value")).select(F.lit(name).alias("metric"), "value")

    n = F.count("*")
    topics = enrichment.select(F.explode("topics").alias("t")).distinct()
    ents = enrichment.select(F.explode("entities").alias("e")).select(
        F.concat_ws(":", "e.type", "e.name").alias("k")).distinct()
    parts = [
        one(channels, "channels", n), one(messages, "messages", n), one(users, "users", n),
        one(discussions.filter("status <> 'split'"), "discussions", n),
        one(topics, "topics", n), one(ents, "entities", n),
        one(messages, "last_ingested_at", iso(F.max("ingested_at"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def messages_per_channel(messages: DataFrame, channels: DataFrame) -> DataFrame:
    counts = messages.groupBy("channel_id").agg(F.count("*").alias("count"))
    names = channels.select(F.col("id").alias("channel_id"), "name")
    return counts.join(names, "channel_id", "left").select("channel_id", "name", "count")


def clusters_per_channel(discussions: DataFrame, channels: DataFrame) -> DataFrame:
    counts = discussions.filter("status <> 'split'").groupBy("channel_id").agg(
        F.count_distinct("id").alias("discussions"),
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"))
    names = channels.select(F.col("id").alias("channel_id"), "name")
    return counts.join(names, "channel_id", "left").withColumn(
        "avg_messages", F.round(F.col("messages") / F.col("discussions"), 1))


def size_histogram(sizes: DataFrame, col: str = "message_count") -> DataFrame:
    """Discussions per size bucket; empty buckets are listed with 0."""
    bucket = F.lit(None).cast("string")
    for label, lo, hi in reversed(SIZE_BUCKETS):
        inside = (F.col(col) >= lo) if hi is None else F.col(col).between(lo, hi)
        bucket = F.when(inside, F.lit(label)).otherwise(bucket)
    # one conditional count per bucket, then one row per bucket
    counts = sizes.select(bucket.alias("b")).agg(
        *[F.count_if(F.col("b") == label).alias(label) for label, _, _ in SIZE_BUCKETS])
    pairs = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("bucket"), F.col(f"`{label}`").alias("count"))
        for i, (label, _, _) in enumerate(SIZE_BUCKETS)])
    return counts.select(F.explode(pairs).alias("x")).select("x.ord", "x.bucket", "x.count")


def label_counts(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count("*").alias("count"))


def type_counts(enrichment: DataFrame) -> DataFrame:
    return label_counts(enrichment, "discussion_type")


def sentiment_counts(enrichment: DataFrame) -> DataFrame:
    return label_counts(enrichment, "sentiment")


def top_topics(enrichment: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent raw topic spellings."""
    return enrichment.select(F.explode("topics").alias("name")).groupBy("name").agg(
        F.count("*").alias("count")).orderBy(F.col("count").desc(), "name").limit(n)


def top_entities(enrichment: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent raw ``type:name`` entities."""
    e = enrichment.select(F.explode("entities").alias("e")).select(
        F.concat(F.col("e.type"), F.lit(":"), F.col("e.name")).alias("key"),
        F.col("e.name").alias("name"), F.col("e.type").alias("type"))
    return e.groupBy("key").agg(
        F.min("name").alias("name"), F.min("type").alias("type"), F.count("*").alias("count")
    ).orderBy(F.col("count").desc(), "key").limit(n)


def nearest_rank(df: DataFrame, keys: list[str], col: str, percents: list[int]) -> DataFrame:
    """Exact nearest-rank percentiles per key.

    Equal values are counted first, so the window runs over distinct values only.
    """
    freq = df.groupBy(*keys, col).agg(F.count("*").alias("c"))
    part = keys or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(col)
    ranked = freq.withColumn("upto", F.sum("c").over(w)).withColumn(
        "n", F.sum("c").over(Window.partitionBy(*part)))
    return ranked.groupBy(*keys).agg(*[
        F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("n") * p / F.lit(100.0))), F.col(col)))
        .alias(f"p{p}_ms") for p in percents])


def inference_stats(calls: DataFrame) -> DataFrame:
    """Totals of the inference log: calls, error rate, mean, p50, p95."""
    one = F.lit(1).alias("_one")
    base = calls.agg(
        F.count("*").alias("total_calls"),
        F.round(F.count_if(F.col("status") == "error") / F.greatest(F.count("*"), F.lit(1)), 3).alias("error_rate"),
        F.coalesce(F.round(F.avg("duration_ms")), F.lit(0)).cast("bigint").alias("avg_ms"))
    pct = nearest_rank(calls, [], "duration_ms", [50, 95]).select(
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("p50_ms", "p95_ms")])
    return base.select("*", one).join(pct.select("*", one), "_one").drop("_one")


def inference_by_model(calls: DataFrame) -> DataFrame:
    base = calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.round(F.avg("duration_ms")).cast("bigint").alias("avg_ms"))
    return base.join(nearest_rank(calls, ["model"], "duration_ms", [95]), "model").withColumn(
        "p95_ms", F.col("p95_ms").cast("bigint"))


def inference_timeseries(calls: DataFrame, now, minutes: int = 30) -> DataFrame:
    """Calls and mean latency per minute, over the last ``minutes``."""
    since = as_ts(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return calls.filter(F.col("started_at") >= since).groupBy(
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm").alias("ts_bucket")).agg(
        F.count("*").alias("calls"), F.round(F.avg("duration_ms")).cast("bigint").alias("avg_ms"))


def calls_per_minute(series: DataFrame) -> DataFrame:
    """Calls in the latest minute of a series, 0 without any."""
    return series.agg(F.coalesce(F.max_by("calls", "ts_bucket"), F.lit(0)).alias("calls_per_minute"))
