"""Document fingerprints by one-permutation MinHash with optimal densification and packed low bits."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import text_of
from parley.llm.jaccard_join import shingles
from parley.llm.registry import query, table

#: Words of a shingle; bins; low-order bits kept of each (4 bits: two bins a byte).
WORDS, BINS, LOW_BITS = 5, 512, 4
#: Rows of a range of ids, and ranges at most.
ROWS_PER_RANGE, RANGES = 4096, 20_000


@lru_cache(maxsize=1)
def donors() -> np.ndarray:
    """For each bin a fixed random order of all bins: an empty bin copies the first filled one."""
    rng = np.random.default_rng(20240607)
    return np.argsort(rng.random((BINS, BINS)), axis=1)


def signature(hashes: np.ndarray) -> np.ndarray | None:
    """Low bits of the smallest hash of each bin; None for an empty set. ``hashes`` are sorted and distinct."""
    if not len(hashes):
        return None
    bins = (hashes >> np.uint64(64 - 9)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    # the hash's own order is uniform, and its lowest bits are independent of the bin
    value = np.zeros(BINS, np.uint8)
    value[bins[first]] = (hashes[first] & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    empty, order, turn = np.flatnonzero(~filled), donors(), 0
    if len(first) < 16:  # few donors: find each one's place in the order at once
        place = np.argsort(order[empty], axis=1)[:, bins[first]]
        value[empty] = value[bins[first]][place.argmin(axis=1)]
        return value
    while len(empty):
        donor = order[empty, turn]
        hit = filled[donor]
        value[empty[hit]] = value[donor[hit]]
        empty, turn = empty[~hit], turn + 1
    return value


def pack(value: np.ndarray | None) -> str:
    """Two bins a byte, in base64; an empty set has the empty fingerprint."""
    return "" if value is None else base64.b64encode(((value[0::2] << 4) | value[1::2]).astype(np.uint8).tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    data = np.frombuffer(base64.b64decode(fingerprint), np.uint8)
    return np.stack([data >> 4, data & 15], axis=1).reshape(-1)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal bins, less what equal low bits of different hashes add; empty sets are like empty ones alone."""
    if a is None or b is None:
        return float(a is b)
    chance = 2.0 ** -LOW_BITS
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def fingerprint(text: str) -> str:
    return pack(signature(shingles(text, WORDS)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text. A null text is empty; ids may be null or repeated; no rows give no rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(fingerprint, b.column(1).to_pylist()), pa.string())], [id_col, "fingerprint"])

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def in_descending_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (_range, _extra, _id, _text), sorted by range and descending id, one shuffle of the texts.

    A range holds neighbouring ids, so the next document of a row is the next row. The last row
    of a range finds its next one in a marked copy of the head of the range below; the lowest
    range gets the very first document. Only bounds and heads, at most ``RANGES`` of them, pass
    through the driver. Ties of id are in order of the text, null ids come last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    n = rows.count()
    ranges = max(1, min(RANGES, -(-n // ROWS_PER_RANGE)))
    at = F.coalesce(F.col("_id").cast("double"), F.lit(-1.7e308))
    cuts = rows.agg(F.percentile_approx(at, [k / ranges for k in range(1, ranges)] or [0.5], F.lit(10 * ranges + 100))).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts if c > -1e308} or {0.0}), float("inf")]
    buckets = Bucketizer(splits=splits, inputCol="_at", outputCol="_b")
    ranged = buckets.transform(rows.withColumn("_at", at)).withColumn("_range", (F.lit(len(splits)) - F.col("_b")).cast("int")).drop("_at", "_b")
    heads = [(r[0], r[1]) for r in ranged.groupBy("_range").agg(F.max("_id")).orderBy("_range").collect()]
    extra = [(r, head, heads[k - 1][0]) for k, (r, head) in enumerate(heads)]  # the first one's copy goes to the last range
    copies = docs.sparkSession.createDataFrame(extra, "_r int, _head long, _to int")
    sent = ranged.join(F.broadcast(copies), (F.col("_range") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_head")), "left")
    places = F.array(F.struct(F.col("_range").alias("to"), F.lit(False).alias("extra")), F.when(
        F.col("_to").isNotNull(), F.struct(F.col("_to").alias("to"), F.lit(True).alias("extra"))))
    return (sent.select("_id", "_text", F.explode(F.array_compact(places)).alias("_p"))
            .select(F.col("_p.to").alias("_range"), F.col("_p.extra").alias("_extra"), "_id", "_text")
            .repartition(len(splits) - 1, "_range")
            .sortWithinPartitions("_range", "_extra", F.col("_id").desc_nulls_last(), "_text"))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint beside that of its edited text, and how like it is to that and to the next document.

    The edited text has its last third (in code points, rounded down) replaced by as many first
    code points of the next document in descending id order; after the last comes the first.
    """
    schema = (f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting = None  # range, id, text and signature of the row whose next one is to come

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [
                id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for part, more, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sig = signature(shingles(text, WORDS))
                if waiting is not None and waiting[0] == part:
                    _, before, old, old_sig = waiting
                    k = len(old) // 3
                    edited = old[: len(old) - k] + text[:k]
                    new_sig = signature(shingles(edited, WORDS))
                    out.append((before, len(old), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), pack(old_sig),
                                pack(new_sig), likeness(old_sig, new_sig), likeness(old_sig, sig)))
                waiting = None if more else (part, doc, text, sig)
            yield batch()
            out.clear()

    return in_descending_ranges(docs, id_col, text_col).mapInArrow(run, schema)


@query("op8_minhash")
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_neighbours(table(spark, sf_dir, "documents"))
