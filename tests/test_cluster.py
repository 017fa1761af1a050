"""The clusterer against a slow independent one, and invariants of whole runs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators.cluster import cluster_channels, subcluster
from parley.sources.state import empty_state

T0 = dt.datetime(2024, 1, 1)
COLS = "channel_id string, block_no long, id string, author_id string, mentions array<string>, created_at timestamp, vec array<float>"


def make(n, seed, step=240):
    rng = random.Random(seed)
    centers = np.random.default_rng(seed).normal(size=(4, 8))
    rows, t = [], T0
    for i in range(n):
        t += dt.timedelta(seconds=rng.randrange(step * 2))
        v = centers[rng.randrange(4)] + 0.5 * np.random.default_rng(seed * 1000 + i).normal(size=8)
        v = (v / np.linalg.norm(v)).astype(np.float32)
        rows.append((f"c{i % 2}", 0, f"m{i:05d}", f"u{rng.randrange(5)}",
                     [f"u{rng.randrange(5)}"] if rng.random() < 0.3 else None, t, [float(x) for x in v]))
    return rows


def slow(rows, tau, idle_min):
    """Plain re-statement of the rules, cluster by cluster, vector by vector."""
    out = {}
    for ch in {r[0] for r in rows}:
        clusters = []
        for r in sorted((r for r in rows if r[0] == ch), key=lambda r: (r[5], r[2])):
            clusters = [c for c in clusters if (r[5] - c["last"]).total_seconds() <= idle_min * 60]
            best, top = None, None
            for c in clusters:
                s = sum(a * b for a, b in zip(r[6], c["cen"], strict=True))
                s += 0.03 * (r[3] in c["who"]) + 0.05 * any(m in c["who"] for m in r[4] or [])
                if top is None or s > top:
                    best, top = c, s
            if best and top >= tau:
                k = best["n"]
                best["cen"] = [float(np.float32((a * k + b) / (k + 1))) for a, b in zip(best["cen"], r[6], strict=True)]
                best["n"], best["last"] = k + 1, r[5]
                best["who"].add(r[3])
            else:
                best = {"root": r[2], "cen": list(r[6]), "n": 1, "last": r[5], "who": {r[3]}}
                clusters.append(best)
            out[r[2]] = best["root"]
    return out


@pytest.mark.parametrize(("seed", "slice_rows"), [(1, 200_000), (2, 200_000), (3, 200_000), (1, 7), (2, 40), (3, 1)])
def test_subcluster_equals_slow_one(spark, seed, slice_rows):
    """Also when an epoch is folded in slices, whose active clusters are carried on."""
    rows = make(300 if slice_rows > 1 else 60, seed)
    got = subcluster(spark.createDataFrame(rows, COLS), 0.6, 15, slice_rows=slice_rows).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["root_id"] for r in got} == slow(rows, 0.6, 15)


def test_a_longer_epoch_needs_no_larger_task(spark, monkeypatch):
    """Rows of the largest group that one task folds, for an epoch and for one of ten times its rows."""
    from parley.operators import cluster as C

    def largest(n):
        seen = []

        def watched(df, real=C.cut):
            out = real(df)
            seen.append(out)
            return out

        monkeypatch.setattr(C, "cut", watched)
        subcluster(spark.createDataFrame(make(n, 5, step=20), COLS), 0.6, 15, slice_rows=25).count()
        monkeypatch.undo()
        folded = [x for x in seen if "last_ms" in x.columns]
        return max(x.groupBy("channel_id", "block_no", "epoch").agg(F.count("id").alias("n")).agg(F.max("n")).first()[0] for x in folded), len(folded)

    (small, few), (large, many) = largest(40), largest(200)
    assert small <= 25 and large <= 25 and many > few


def test_no_messages_no_clusters(spark):
    assert subcluster(spark.createDataFrame([], COLS)).count() == 0


def messages(n, seed, replies=True):
    rng = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += dt.timedelta(minutes=45 if rng.random() < 0.15 else rng.randrange(6))
        rows.append((f"m{i:04d}", f"c{i % 2}", "g", f"u{rng.randrange(4)}", "word " * rng.choice([2, 9]), t,
                     f"m{rng.randrange(i):04d}" if replies and i and rng.random() < 0.3 else None,
                     f"t{rng.randrange(2)}-c{i % 2}" if rng.random() < 0.1 and not replies else None, None, 0,
                     0, "b", t, 0, None))
    return rows


def run(spark, state):
    msgs = state["messages"].withColumn("word_count", F.size(F.split(F.trim("content"), " ")))
    vec = msgs.select("id", F.expr(
        "transform(sequence(0, 7), i -> cast(if(pmod(xxhash64(author_id), 8) = i, 1.0, 0.0) as float))").alias("vec"))
    return cluster_channels({**state, "messages": msgs}, vec, "2024-02-01", tau=0.5, dim=8)


def test_run_invariants_and_second_run_changes_nothing(spark):
    from parley.session import cut

    state = empty_state(spark)
    state["messages"] = spark.createDataFrame(messages(150, 5), state["messages"].schema)
    out, summary = run(spark, state)
    out = {k: (cut(v) if k in ("messages", "discussions") else v) for k, v in out.items()}
    placed = out["messages"].filter("processed = 1")
    sizes = placed.groupBy("discussion_id").count()
    joined = out["discussions"].join(sizes, F.col("id") == F.col("discussion_id"), "full_outer")
    assert joined.filter("not (message_count <=> count)").count() == 0
    s = summary.agg(F.sum("processed"), F.sum("skipped_open"), F.sum("new_discussions")).first()
    assert s[0] == placed.count() and s[0] + s[1] == 150 and s[2] == out["discussions"].count()
    again, _ = run(spark, out)
    assert again["discussions"].count() == out["discussions"].count()
    assert again["messages"].exceptAll(out["messages"]).count() == 0


def test_two_batches_equal_one_run(spark):
    """Messages in time order without replies to threads: same partition either way."""
    from parley.session import cut

    rows = messages(120, 8, replies=False)
    state = empty_state(spark)
    schema = state["messages"].schema
    whole, _ = run(spark, {**state, "messages": spark.createDataFrame(rows, schema)})
    first, _ = run(spark, {**state, "messages": spark.createDataFrame(rows[:60], schema)})
    first = {k: (cut(v) if k in ("messages", "discussions") else v) for k, v in first.items()}
    rest = spark.createDataFrame(rows[60:], schema)
    second, _ = run(spark, {**first, "messages": first["messages"].unionByName(rest)})
    pick = lambda s: {r["id"]: r["discussion_id"] for r in s["messages"].collect()}
    assert pick(whole) == pick(second)
