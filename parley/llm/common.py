"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import configure, shared_dir


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, so that long texts fit in a task's memory."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


#: How the operator that last filled tables in this Python worker lets go of them.
_FORGET: dict[str, Callable[[], None]] = {}


def hold_alone(operator: str, forget: Callable[[], None]) -> None:
    """Tell that ``operator`` fills tables in this Python worker, which stay from task to task.

    Workers go on from job to job, so the tables of other operators are let go: a row of
    operators needs the memory of the largest, not of all together.
    """
    others = [name for name in _FORGET if name != operator]
    for name in others:
        _FORGET.pop(name)()
    if others:
        pa.default_memory_pool().release_unused()
    _FORGET[operator] = forget


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columns are read as needed, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the split into learning and held-out rows."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def key_bitmap(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """A one-hash membership filter of a long column, at most ``bits / 8`` bytes for any input.

    Rows (_bucket, _bitmap). A key that is in it is always found; another one may be found too,
    the more often the fuller it is, so a hit may only decide about work, not about results.
    """
    at = F.pmod(F.col(column), F.lit(bits))
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bitmap"))


def in_bitmap(df: DataFrame, column: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``_hit``: whether the filter may hold the key. The filter's size is bounded, so it is broadcast."""
    at = F.pmod(F.col(column), F.lit(bits))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, _shift) & 1") == 1, F.lit(False))
    return (df.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmap), "_bucket", "left")
            .withColumns({"_byte": byte, "_shift": (bit % 8).cast("int")})
            .withColumn("_hit", hit).drop("_bucket", "_bitmap", "_byte", "_shift"))


def without(docs: DataFrame, keys: dict[str, Column], dropped: DataFrame, repeated: DataFrame | None = None,
            bits: int = 1 << 25, probe: list[str] | None = None) -> DataFrame:
    """``docs`` less the rows whose keys are in ``dropped``; of keys in ``repeated`` one row stays.

    ``keys`` names expressions over ``docs``; the other two hold columns of those names. A bitmap
    of bounded size lets rows that are certainly not concerned pass where they lie. Only rows
    that may be are shuffled and compared. ``probe`` names the keys that the bitmap is made of, all
    by default; the others are made of the rows alone that may be concerned.
    """
    names = list(keys)
    probe = probe or names
    concerned = dropped.select(*names) if repeated is None else dropped.select(*names).unionByName(repeated.select(*names))
    bitmap = key_bitmap(concerned.select(F.xxhash64(*probe).alias("_key")), "_key", bits)
    # the row travels as one struct, so that its columns may have any names
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    marked = in_bitmap(docs.select(row, F.xxhash64(*(keys[n] for n in probe)).alias("_key")), "_key", bitmap, bits)
    hit = marked.where("_hit").select("_row.*").select(row, *(c.alias(f"_k_{n}") for n, c in keys.items()))
    same = [F.col(f"_k_{n}").eqNullSafe(F.col(f"_d_{n}")) for n in names]
    doubtful = hit.join(
        dropped.select(*(F.col(n).alias(f"_d_{n}") for n in names)).distinct(), same, "left_anti")
    if repeated is not None:
        doubtful = doubtful.dropDuplicates([f"_k_{n}" for n in names])
    return marked.where("not _hit").select("_row.*").unionByName(doubtful.select("_row.*"))
