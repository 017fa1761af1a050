"""Packing, mapping and retry cases as exact tables."""

import datetime as dt
import json

from pyspark.sql import functions as F

from parley.functions.vectors import hashing_embedder
from parley.operators import enrich as E
from parley.sources.state import empty_state

T0 = dt.datetime(2024, 1, 1)
QUEUE = "channel_id string, block_start_at timestamp, id string, tokens long, messages long"


def queue(spark, sizes):
    return spark.createDataFrame(
        [("c", T0 + dt.timedelta(minutes=i), f"d{i:03d}", t, m) for i, (t, m) in enumerate(sizes)], QUEUE)


def shape(packed):
    rows = packed.groupBy("batch_no").agg(F.count("*").alias("n"), F.max("label_no").alias("l")).orderBy("batch_no").collect()
    assert [r["batch_no"] for r in rows] == list(range(1, len(rows) + 1)) and all(r["n"] == r["l"] for r in rows)
    return [r["n"] for r in rows]


def test_packing_caps(spark):
    small = [(50, 1)] * 12
    assert shape(E.pack_batches(queue(spark, small), 0)) == [1] * 12
    assert shape(E.pack_batches(queue(spark, small), 6000, 5)) == [5, 5, 2]
    assert shape(E.pack_batches(queue(spark, [(50, 1), (9000, 50), (50, 1), (50, 1)]), 200)) == [1, 1, 2]
    assert shape(E.pack_batches(queue(spark, [(50, 1)] * 40), 6000, 25)) == [25, 15]


def test_packing_equals_plain_loop_over_stripes(spark):
    import random

    rng = random.Random(4)
    sizes = [(rng.randrange(40, 900), rng.randrange(1, 60)) for _ in range(500)]
    want, t, m, n = [], 0, 0, 0
    for a, b in sizes:
        if n and (t + a > 2000 or n + 1 > 7 or m + b > 120):
            want.append(n)
            t = m = n = 0
        t, m, n = t + a, m + b, n + 1
    assert shape(E.pack_batches(queue(spark, sizes), 2000, 7, 120, stripe=32)) == [*want, n]


def mapped(spark, segments, members, labels):
    s = spark.createDataFrame(segments, "call_id string, seg_no long, message_ids array<string>, source_cluster string")
    m = spark.createDataFrame(members, "discussion_id string, message_id string")
    lb = spark.createDataFrame(labels, "call_id string, label string, discussion_id string")
    return E.map_segments(s, m, lb)


def test_segment_over_two_discussions_is_cut(spark):
    got = mapped(spark, [("k", 0, ["a", "b", "x", "y", "alien"], None)],
                 [("A", "a"), ("A", "b"), ("B", "x"), ("B", "y")], [("k", "c1", "A"), ("k", "c2", "B")])
    assert {(r["discussion_id"], r["message_id"]) for r in got.collect()} == {("A", "a"), ("A", "b"), ("B", "x"), ("B", "y")}


def test_segment_without_ids_falls_back(spark):
    labels = [("k", "c1", "A"), ("k", "c2", "B"), ("s", "c1", "C")]
    got = mapped(spark, [("k", 0, [], "c2"), ("k", 1, [], None), ("s", 0, [], None)], [("A", "a")], labels).collect()
    assert {(r["call_id"], r["discussion_id"]) for r in got} == {("k", "B"), ("s", "C")}


def test_forgotten_message_goes_to_nearest_and_earlier_on_tie(spark):
    msgs = spark.createDataFrame([("A", x, T0 + dt.timedelta(seconds=s)) for x, s in
                                  [("a", 0), ("b", 2), ("c", 4), ("d", 9), ("e", 10)]], "discussion_id string, id string, created_at timestamp")
    m = spark.createDataFrame([("A", 0, "a"), ("A", 1, "c"), ("A", 1, "a"), ("A", 2, "e")], "discussion_id string, seg_no long, message_id string")
    got = {r["id"]: r["seg_no"] for r in E.partition_messages(msgs, m).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 2}


def test_no_ids_at_all_gives_runs(spark):
    msgs = spark.createDataFrame([("A", f"m{i}", T0 + dt.timedelta(seconds=i)) for i in range(5)], "discussion_id string, id string, created_at timestamp")
    m = spark.createDataFrame([("A", 3, None), ("A", 7, None)], "discussion_id string, seg_no long, message_id string")
    got = E.partition_messages(msgs, m).orderBy("id").collect()
    assert [r["seg_no"] for r in got] == [3, 3, 3, 7, 7]


def channel(spark, n, status="clustering"):
    st = empty_state(spark)
    st["discussions"] = spark.createDataFrame(
        [(f"d{i:02d}", "c", None, T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i), status, 2, None, None, None, None)
         for i in range(n)], st["discussions"].schema)
    st["messages"] = spark.createDataFrame(
        [(f"d{i:02d}-{j}", "c", None, "u0", "krátká zpráva", T0 + dt.timedelta(minutes=i, seconds=j), None, None, None, 0, 2, "b", T0, 1, f"d{i:02d}")
         for i in range(n) for j in range(2)], st["messages"].schema)
    return st


def segment(ids=(), label=None, title="t"):
    s = {"message_ids": list(ids), "title": title, "summary": "s", "topics": ["x"], "entities": [], "key_points": [],
         "sentiment": "neutral", "sentiment_score": 0, "language": "cs", "discussion_type": "discussion", "resolved": None}
    return {**s, "source_cluster": label} if label else s


def answer_all(system, user, schema):
    import re

    heads = re.findall(r"=== CLUSTER (\S+) ", user)
    return json.dumps({"segments": [segment(label=h) for h in heads] or [segment()]})


def summary(spark, n, fn):
    st, s = E.enrich_channels(channel(spark, n), fn, hashing_embedder(8), "2024-02-01")
    return st, s.first().asDict()


def test_forty_discussions_take_two_calls(spark):
    st, s = summary(spark, 40, answer_all)
    assert (s["batches"], s["individual_retries"], s["enriched"], s["failed"]) == (2, 0, 40, 0)
    assert st["discussions"].filter("status = 'enriched'").count() == 40


def test_failed_batch_is_retried_one_by_one(spark):
    def fails_on_batches(system, user, schema):
        if user.startswith("This call holds"):
            raise RuntimeError("overloaded")
        return answer_all(system, user, schema)

    _, s = summary(spark, 6, fails_on_batches)
    assert (s["batches"], s["individual_retries"], s["enriched"], s["failed"]) == (1, 6, 6, 0)


def test_skipped_cluster_gets_its_own_call(spark):
    def skips_one(system, user, schema):
        reply = json.loads(answer_all(system, user, schema))
        return json.dumps({"segments": [s for s in reply["segments"] if s.get("source_cluster") != "c2"]})

    _, s = summary(spark, 5, skips_one)
    assert (s["enriched"], s["failed"]) == (5, 0)


def test_split_keeps_every_message(spark):
    def splits(system, user, schema):
        return json.dumps({"segments": [segment(["d00-0"], title="one"), segment(["d00-1"], title="two")]})

    st, s = summary(spark, 1, splits)
    assert (s["split"], s["segments"]) == (1, 2)
    kids = {r["id"] for r in st["discussions"].filter("parent_discussion_id = 'd00'").collect()}
    assert {r["discussion_id"] for r in st["messages"].collect()} == kids and len(kids) == 2
    assert st["discussions"].filter("id = 'd00'").first()["status"] == "split"


def test_invalid_reply_is_a_failed_call(spark):
    bad = json.dumps({"segments": [{**segment(), "sentiment": "furious"}]})
    _, s = summary(spark, 1, lambda *_: bad)
    assert (s["failed"], s["enriched"]) == (1, 0)
