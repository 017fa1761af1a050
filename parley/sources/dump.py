"""Raw message dumps: reading, cleaning and conversion to daily batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import dir_segment, iso, normalize_ts, trim_ws
from parley.operators.ordered import keep_first
from parley.schemas import DUMP


def read_dump(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Read an NDJSON dump, or a JSON array / single object with ``multiline``.

    Ids may be numbers, unknown columns are ignored, and a malformed row fails
    the read. NDJSON splits over tasks; one big array is one task's work, so
    large dumps belong in NDJSON.
    """
    return spark.read.schema(DUMP).option("multiLine", multiline).json(path, mode="FAILFAST")


def assign_guild(dump: DataFrame, guild_map: DataFrame, fallback: str | None = None) -> DataFrame:
    """Add guild_id from (channel_id, guild_id) rows, else the fallback, else null."""
    m = guild_map.select("channel_id", trim_ws(F.col("guild_id")).alias("_g"))
    picked = F.coalesce("_g", F.lit((fallback or "").strip() or None).cast("string"))
    return dump.join(m, "channel_id", "left").withColumn("guild_id", picked).drop("_g")


def unmapped_channels(assigned: DataFrame) -> DataFrame:
    """Channels left without a guild; a conversion must stop on any."""
    return assigned.filter("guild_id is null").select("channel_id").distinct()


def require_guilds(assigned: DataFrame, named: int = 20) -> DataFrame:
    """``assigned`` as it is; an error that names channels where any has no guild."""
    missing = [r[0] for r in unmapped_channels(assigned).orderBy("channel_id").limit(named + 1).collect()]
    if missing:
        more = " and more" if len(missing) > named else ""
        raise ValueError("channels without a guild: " + ", ".join(str(c) for c in missing[:named]) + more)
    return assigned


def quarantine_unmapped(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a guild, and the others with a reason; together all rows."""
    return assigned.filter("guild_id is not null"), assigned.filter("guild_id is null").withColumn(
        "reason", F.lit("channel without a guild"))


def _flags(assigned: DataFrame, include_deleted: bool, include_empty: bool) -> DataFrame:
    deleted = F.col("deleted_at").isNotNull() & F.lit(not include_deleted)
    empty = (trim_ws(F.coalesce("content", F.lit(""))) == "") & F.lit(not include_empty)
    return assigned.withColumn(
        "_skip", F.when(deleted, F.lit("deleted")).when(empty, F.lit("empty"))
    )


def clean_dump(
    assigned: DataFrame, include_deleted: bool = False, include_empty: bool = False
) -> DataFrame:
    """Drop deleted and empty rows, then keep the first of equal (guild, channel, id).

    A channel without a guild is an error; ``quarantine_unmapped`` takes its rows out before.
    """
    assigned = require_guilds(assigned)
    kept = _flags(assigned, include_deleted, include_empty).filter("_skip is null").drop("_skip")
    return keep_first(kept, ["guild_id", "channel_id", "id"], "pos")


def dump_stats(
    assigned: DataFrame, include_deleted: bool = False, include_empty: bool = False
) -> DataFrame:
    """Input, output and skipped counts, and how many guilds, channels, days and files."""
    flagged = _flags(assigned, include_deleted, include_empty)
    day = F.to_date(normalize_ts(F.col("created_at")))
    # one row per message key carries all counts, so copies collapse before the shuffle
    keyed = flagged.groupBy("guild_id", "channel_id", "id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_skip") == "deleted").alias("n_del"),
        F.count_if(F.col("_skip") == "empty").alias("n_empty"),
        F.min_by(day, F.when(F.col("_skip").isNull(), F.col("pos"))).alias("day"),
    )
    kept = F.col("n") > F.col("n_del") + F.col("n_empty")
    files = keyed.groupBy("guild_id", "channel_id", "day").agg(
        F.sum("n").alias("n"), F.sum("n_del").alias("n_del"), F.sum("n_empty").alias("n_empty"),
        F.count_if(kept).alias("n_out"),
    )
    live = F.col("n_out") > 0
    return files.agg(
        F.sum("n").alias("input_count"),
        F.sum("n_out").alias("output_count"),
        F.count_distinct(F.when(live, F.col("guild_id"))).alias("guild_count"),
        F.count_distinct(F.when(live, F.struct("guild_id", "channel_id"))).alias("channel_count"),
        F.count_if(live).alias("day_count"),
        F.count_if(live).alias("file_count"),
        F.sum("n_del").alias("skipped_deleted"),
        F.sum("n_empty").alias("skipped_empty"),
        (F.sum("n") - F.sum("n_del") - F.sum("n_empty") - F.sum("n_out")).alias("skipped_duplicate"),
    )


def daily_batches(clean: DataFrame) -> DataFrame:
    """Batch rows: normalised time and the UTC day each message belongs to."""
    ts = normalize_ts(F.col("created_at"))
    return clean.select(
        "guild_id", "channel_id", F.to_date(ts).alias("day"), "id", "author_id",
        F.coalesce("content", F.lit("")).alias("content"), iso(ts).alias("created_at"),
    )


def write_daily_batches(clean: DataFrame, out: str, rows_per_file: int = 1_000_000) -> None:
    """Write NDJSON under guild=/channel=/day= folders, chronological inside each file.

    Rows are range-partitioned by time and id too, so a busy channel day becomes
    several files in order instead of one task's work.
    """
    rows = daily_batches(clean)
    order = ["guild_id", "channel_id", "day", "created_at", "id"]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            F.col("guild_id").alias("guild"), F.col("channel_id").alias("channel"), "day",
            "id", F.struct(F.col("author_id").alias("id")).alias("author"), "content", "created_at",
        )
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy("guild", "channel", "day").mode("errorifexists").json(out)
    )


def dir_segments(ids: DataFrame, names: DataFrame, mode: str = "name") -> DataFrame:
    """Folder name per id, and whether another id would share it."""
    named = ids.select("id").distinct().join(names.select("id", "name"), "id", "left")
    seg = named.select("id", dir_segment(F.col("id"), F.col("name"), mode).alias("segment"))
    shared = seg.groupBy("segment").agg((F.count("*") > 1).alias("collides"))
    return seg.join(shared, "segment").select("id", "segment", "collides")


def assert_no_collision(segments: DataFrame) -> DataFrame:
    """Fail when two ids would share a folder; otherwise pass the segments through."""
    message = F.concat(F.lit("folder shared by several ids: "), F.col("segment"))
    return segments.withColumn(
        "segment",
        F.when(F.col("collides"), F.raise_error(message).cast("string")).otherwise(F.col("segment")),
    )
