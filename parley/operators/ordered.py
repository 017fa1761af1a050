"""Ordered scans, pointer chains and first-wins dedupe that survive hot keys.

A plain ``Window.partitionBy(channel)`` puts a whole channel into one task. The
scans here cut every key into range partitions of similar size, work inside each
part, and carry only one summary row per (key, part) across parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut

PART = "_part"


def ordered_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by (keys, order) and remember each row's part.

    ``order`` must be total inside a key; then even one key, or one timestamp,
    holding most of the rows is split over many parts. The result is
    materialised, so a part number never changes when a task is rerun.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return cut(ranged.withColumn(PART, F.spark_partition_id()))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running values over (keys ordered by order), exact across parts.

    sums:      running sum up to and including the row
    prev:      last non-null value strictly before the row
    following: first non-null value strictly after the row
    """
    sums, prev, following = dict(sums or {}), dict(prev or {}), dict(following or {})
    keys, order = list(keys), list(order)
    for name, expr in {**sums, **prev, **following}.items():
        df = df.withColumn(f"_in_{name}", expr)
    parts = ordered_parts(df, keys, order)

    rank = F.struct(*order)
    summary_aggs = [F.sum(f"_in_{n}").alias(f"_p_{n}") for n in sums]
    summary_aggs += [
        F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), rank)).alias(f"_p_{n}")
        for n in prev
    ]
    summary_aggs += [
        F.min_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), rank)).alias(f"_p_{n}")
        for n in following
    ]
    across = Window.partitionBy(*keys).orderBy(PART)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    carried = parts.groupBy(*keys, PART).agg(*summary_aggs).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(PART).alias("_k_part"),
        *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_p_{n}", True).over(before).alias(f"_c_{n}") for n in prev],
        *[F.first(f"_p_{n}", True).over(after).alias(f"_c_{n}") for n in following],
    )

    inside = Window.partitionBy(*keys, PART).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    later = inside.rowsBetween(1, Window.unboundedFollowing)
    local = parts.select(
        *parts.columns,
        *[F.sum(f"_in_{n}").over(upto).alias(f"_l_{n}") for n in sums],
        *[F.last(f"_in_{n}", True).over(earlier).alias(f"_l_{n}") for n in prev],
        *[F.first(f"_in_{n}", True).over(later).alias(f"_l_{n}") for n in following],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(PART) == F.col("_k_part")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = local.join(carried, cond, "left")
    out = [F.col(c) for c in parts.columns if c != PART and not c.startswith("_in_")]
    out += [(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    out += [F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in [*prev, *following]]
    return joined.select(*out)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 1-based position of each row inside its key."""
    return scan(df, keys, order, sums={name: F.lit(1).cast("bigint")})


def keep_first(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Keep the row with the smallest unique ``pos`` per key.

    Only (keys, pos) is aggregated, with map-side combine, so a key with very
    many copies costs one row per task. The rows themselves are matched on
    (keys, pos), which spreads the copies instead of gathering them.
    """
    first = df.groupBy(*keys).agg(F.min(pos).alias(pos))
    return df.join(first, [*keys, pos], "left_semi")


def chase(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Follow ``node -> next`` links to the end of every chain by pointer doubling.

    ``links`` holds one row per node with a next hop and no cycles. Returns
    (node, root) where root has no link. A chain of depth d needs log2(d) joins.
    """
    current = cut(links.select("node", F.col("next").alias("root")))
    table, done = current, None
    for _ in range(max_rounds):
        hop = table.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        stepped = cut(
            current.join(hop, F.col("root") == F.col("_n"), "left").select(
                "node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")
            )
        )
        # a node that did not move has reached its root and leaves the work
        still = stepped.filter(~F.col("_moved")).select("node", "root")
        done = still if done is None else done.unionByName(still)
        current = stepped.filter("_moved").select("node", "root")
        if current.isEmpty():
            return done
        table = done.unionByName(current)
    raise RuntimeError("links contain a cycle")


def mark_reachable(jumps: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All positions reached from ``starts`` by repeated ``pos -> nxt`` jumps.

    Positions double per round: with the 2^k-step jump table, the positions
    reached so far are joined once and the table is squared once.
    """
    keys = list(keys)
    reached = cut(starts.select(*keys, "pos"))
    table = cut(jumps.select(*keys, "pos", "nxt"))
    while True:
        more = reached.join(table, [*keys, "pos"]).select(*keys, F.col("nxt").alias("pos"))
        reached = cut(reached.unionByName(more))
        second = table.select(*keys, F.col("pos").alias("nxt"), F.col("nxt").alias("_nn"))
        table = cut(
            table.join(second, [*keys, "nxt"]).select(*keys, "pos", F.col("_nn").alias("nxt"))
        )
        if table.isEmpty():
            return reached
