"""Semantic continuations: the most similar earlier discussions of a channel, inside a lookback."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.vectors import unit
from parley.operators.ordered import row_index
from parley.session import cut

#: Candidates of a block.
BLOCK = 512


def _top(rows: Iterator[tuple], theta: float, k: int, lookback_us: int) -> Iterator[tuple]:
    """(src, dst, at, score): per visitor the ``k`` best candidates of one block that reach ``theta``.

    ``rows`` are (block key, is candidate, at, id, linked, vec), candidates first; only they are held.
    """
    for _, block in groupby(rows, lambda r: r[0]):
        held: list[tuple] = []
        matrix, when = None, None
        for _, candidate, at, node, linked, vec in block:
            if candidate:
                held.append((at, node, linked, vec))
                continue
            if matrix is None:
                matrix, when = np.array([h[3] for h in held]), np.array([h[0] for h in held])
            score = matrix @ vec
            found = []
            for j in np.flatnonzero((score >= theta) & (when <= at) & (when >= at - lookback_us)).tolist():
                then, other, others_link, _ = held[j]
                if (then, other) < (at, node) and linked != other and others_link != node:
                    found.append((float(score[j]), then, other))
            # of equal scores the later one, then the smaller id
            for s, then, other in heapq.nsmallest(k, found, key=lambda f: (-f[0], -f[1], f[2])):
                yield node, other, then, s


def semantic_continuations(discussions: DataFrame, theta: float = 0.8, lookback_days: float = 14, top_k: int = 3, block: int = BLOCK) -> DataFrame:
    """(src, dst, reason, similarity_score): up to ``top_k`` earlier discussions that each one continues.

    ``discussions`` holds id, channel_id, started_at, continuation_of_discussion_id and embedding.
    A candidate lies in the same channel, started earlier (by time, then id) and not before the
    lookback, has a cosine of at least ``theta``, and is not linked with the discussion already,
    whichever way. Of equal scores the later one comes first, then the smaller id.

    Rows are bucketed by channel and lookback-long slot, so candidates lie in the own slot or the
    one before. A slot is cut into blocks of ``block`` candidates by time, and a row visits only
    blocks whose span its lookback meets: what is compared is what a lookback holds, and a hot
    channel is many blocks. A task holds one block and streams visitors past it; a row sends on
    ``top_k`` rows per block, whose best are taken after the shuffle. No pair is ever a row.

    Rows without a vector, a time or a direction have no continuation and are none. A null channel
    is a channel of its own.
    """
    span = int(lookback_days * 86_400_000_000)
    known = discussions.select(
        F.col("id").alias("node"), F.coalesce("channel_id", F.lit("")).alias("channel"), F.col("channel_id").isNull().alias("nameless"),
        F.unix_micros("started_at").alias("at"), F.col("continuation_of_discussion_id").alias("linked"), unit(F.col("embedding")).alias("vec")).where(
        "at is not null and vec is not null and exists(vec, x -> x != 0)").withColumn("slot", F.floor(F.col("at") / span))
    key = ["channel", "nameless", "slot"]
    placed = cut(row_index(known, key, ["at", "node"], "pos").withColumn("blk", F.floor((F.col("pos") - 1) / block)))
    blocks = cut(placed.groupBy(*key, "blk").agg(F.min("at").alias("lo"), F.max("at").alias("hi")))
    visits = placed.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") - 1))).drop("blk", "pos").join(blocks, key).where(
        (F.col("lo") <= F.col("at")) & (F.col("hi") >= F.col("at") - span))
    columns = [*key, "blk", "candidate", "at", "node", "linked", "vec"]
    rows = placed.withColumn("candidate", F.lit(True)).select(columns).unionByName(visits.withColumn("candidate", F.lit(False)).select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for b in batches:
                c = [x.to_pylist() for x in b.columns[:8]]
                vec = b.column(8).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else []
                yield from zip(zip(*c[:4], strict=True), *c[4:], vec, strict=True)

        out: list[tuple] = []
        for row in _top(read(), theta, top_k, span):
            out.append(row)
            if len(out) == 5_000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)],
                                          ["src", "dst", "at", "score"])

    ordered = rows.repartition(*key, "blk").sortWithinPartitions(*key, "blk", F.desc("candidate"), "at", "node")
    best = ordered.mapInArrow(run, "src string, dst string, at long, score double")
    order = F.struct((-F.col("score")).alias("s"), (-F.col("at")).alias("t"), F.col("dst").alias("d"))
    kept = best.groupBy("src").agg(F.slice(F.sort_array(F.collect_list(order)), 1, top_k).alias("best"))
    return kept.select("src", F.explode("best").alias("b")).select(
        "src", F.col("b.d").alias("dst"), F.lit("semantic_similarity").alias("reason"), (-F.col("b.s")).alias("similarity_score"))


def with_semantic(edges: DataFrame, semantic: DataFrame, known: DataFrame) -> DataFrame:
    """Continuation edges with the semantic ones added; an explicit edge of the same pair stays alone."""
    k = known.select(F.col("id").alias("dst"), F.lit(True).alias("_k"))
    more = semantic.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").join(k, "dst", "left").withColumn(
        "stub", F.col("_k").isNull()).drop("_k")
    return edges.unionByName(more.select(*edges.columns))


def edges_mentions_user(messages: DataFrame) -> DataFrame:
    """User to user: how often one mentions the other, first and last time; a message counts a name once.

    Mentions of oneself and null names are left out. Counts are combined where the rows lie.
    """
    named = messages.where("mentions is not null").select(
        "author_id", "created_at", F.explode(F.array_distinct("mentions")).alias("dst")).where("dst is not null and dst != author_id")
    return named.groupBy(F.col("author_id").alias("src"), "dst").agg(
        F.count("*").alias("count"), F.min("created_at").alias("first_mentioned_at"), F.max("created_at").alias("last_mentioned_at"))


def merge_mentions_user(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after more messages: counts add up, the first and last time move outwards. Only keys in ``new`` meet a row."""
    n = new.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), *(F.col(c).alias(f"_{c}") for c in ("count", "first_mentioned_at", "last_mentioned_at")))
    joined = old.join(n, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "full_outer")
    return joined.select(
        F.coalesce("src", "_s").alias("src"), F.coalesce("dst", "_d").alias("dst"),
        (F.coalesce("count", F.lit(0)) + F.coalesce("_count", F.lit(0))).alias("count"),
        F.least("first_mentioned_at", "_first_mentioned_at").alias("first_mentioned_at"),
        F.greatest("last_mentioned_at", "_last_mentioned_at").alias("last_mentioned_at"))
