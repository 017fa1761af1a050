"""Ordered scans, pointer chains and dedupe against plain Python."""

import random

from pyspark.sql import functions as F

from parley.operators.ordered import chase, keep_first, mark_reachable, row_index, scan


def test_scan_equals_plain_loop_with_one_hot_key(spark):
    rng = random.Random(3)
    # two thirds of the rows share one key, many share one time
    rows = [("hot" if rng.random() < 0.66 else f"k{rng.randrange(5)}", rng.randrange(40), i,
             rng.randrange(9) if rng.random() < 0.3 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(7)
    got = scan(df, ["k"], ["t", "id"], sums={"n": F.lit(1)}, prev={"p": F.col("v")}, following={"f": F.col("v")})
    out = {r["id"]: (r["n"], r["p"], r["f"]) for r in got.collect()}
    assert len(out) == len(rows)
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(group):
            before = [x[3] for x in group[:i] if x[3] is not None]
            after = [x[3] for x in group[i + 1:] if x[3] is not None]
            assert out[r[2]] == (i + 1, before[-1] if before else None, after[0] if after else None)


def test_row_index_is_dense(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = row_index(df, ["k"], ["id"], "i").groupBy("k").agg(F.max("i").alias("m"), F.count_distinct("i").alias("c")).collect()
    assert all(r["m"] == r["c"] for r in got)


def test_chase_follows_a_long_chain_and_a_star(spark):
    links = [(f"n{i}", f"n{i - 1}") for i in range(1, 200)] + [(f"s{i}", "n57") for i in range(300)]
    got = {r["node"]: r["root"] for r in chase(spark.createDataFrame(links, "node string, next string")).collect()}
    assert len(got) == 499 and set(got.values()) == {"n0"}


def test_mark_reachable(spark):
    jumps = spark.createDataFrame([("a", i, i + 1 + i % 3) for i in range(100)], "c string, pos long, nxt long")
    starts = spark.createDataFrame([("a", 0)], "c string, pos long")
    got = sorted({r["pos"] for r in mark_reachable(jumps, starts, ["c"]).collect()})
    want, p = [], 0
    while True:
        want.append(p)
        if p >= 100:
            break
        p = p + 1 + p % 3
    assert got == want


def test_keep_first_of_many_copies(spark):
    df = spark.range(5000).select(F.when(F.col("id") > 10, F.lit("same")).otherwise(F.col("id").cast("string")).alias("id"),
                                  F.col("id").alias("pos"))
    got = {r["id"]: r["pos"] for r in keep_first(df, ["id"], "pos").collect()}
    assert got["same"] == 11 and len(got) == 12
