"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import in_bitmap, key_bitmap, text_of, without
from parley.llm.registry import query, table
from parley.session import cut

#: Characters that do not count when texts are compared.
IGNORED = r"[\x20\x09-\x0D]+"


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), IGNORED, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64,
                filter_bits: int = 1 << 25, carry: dict[str, Column] | None = None, sha_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and the ``carry`` expressions.

    ``sha_col`` names one more column, if given: the full hash, null where step 2 made none.

    Texts are equal when they agree after white space is deleted. Of equal texts the row with
    the most characters stays, then the smallest id.

    1. A narrow pass groups rows by (normalised length, hash of a prefix). Groups of one row
       are unique.
    2. Keys of larger groups go into a bitmap of ``filter_bits`` bits (4 MB by default, whatever
       the input), the only thing that is broadcast. It lets the second pass hash the full
       content of surviving rows alone, where they lie: no text is shuffled. A false hit of the
       bitmap costs one hash and no result.
    3. Survivors are grouped by (length, full hash). Groups are aggregated before the shuffle and
       joined back to their narrow rows, a join that Spark can split at a hot group.

    Nulls: a null text is empty; all blank texts are equal to each other. A null id is smaller
    than any other. Rows that repeat id and length of the row that stays are all marked kept.
    Other columns are ignored, whatever their names. No rows give no rows.
    """
    carry = carry or {}
    norm = normalised(text_col)
    scan = docs.select(
        F.col(id_col).alias("_id"), F.length(text_of(text_col)).cast("long").alias("_chars"),
        F.length(norm).alias("_len"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("_prefix"),
        norm.alias("_norm"), *(c.alias(f"_c_{n}") for n, c in carry.items()))
    key = F.xxhash64("_len", "_prefix")
    repeated = scan.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1").select(key.alias("_key"))
    probable = in_bitmap(scan.withColumn("_key", key), "_key", key_bitmap(repeated, "_key", filter_bits), filter_bits)
    rows = cut(probable.select(
        "_id", "_chars", "_len", F.when(F.col("_hit"), F.sha2("_norm", 256)).alias("_full"),
        *(f"_c_{n}" for n in carry)))
    survivors = rows.where("_full is not null")
    groups = survivors.groupBy("_len", "_full").agg(
        F.count("*").alias("group_size"), F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").alias("i"))).alias("_best"))
    joined = survivors.join(groups, ["_len", "_full"]).select(
        "_id", F.col("_best.i").alias("keep_id"), "group_size",
        (F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_chars") == -F.col("_best.c"))).alias("kept"), "_full",
        *(f"_c_{n}" for n in carry))
    alone = rows.where("_full is null").select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_full",
        *(f"_c_{n}" for n in carry))
    return joined.unionByName(alone).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept", *(F.col(f"_c_{n}").alias(n) for n in carry),
        *([F.col("_full").alias(sha_col)] if sha_col else []))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text one stays.

    Whole texts are normalised and hashed again only in rows whose id and length are those of a copy.
    """
    keys = {"id": F.col(id_col), "sha": F.sha2(normalised(text_col), 256), "n": F.length(text_of(text_col))}
    decided = cut(exact_dedup(docs, id_col, text_col, carry={"n": keys["n"]}, sha_col="sha").where("group_size > 1")
                  .select(F.col(id_col).alias("id"), "sha", "n", "kept"))
    repeated = decided.where("kept").groupBy("id", "sha", "n").count().where("count > 1")
    return without(docs, keys, decided.where("not kept"), repeated, probe=["id", "n"])


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


@query("op7_exact_dedup", SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays in its place."""
    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(normalised("text"), 256)})
