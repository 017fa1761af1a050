"""Nothing is lost on the way: caps, unmapped channels, long discussions, bad documents, late rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from parley.operators import dictionary as D
from parley.operators.cluster import cluster_channels, subcluster
from parley.operators.enrich import pack_batches, render_prompts
from parley.operators.graph import build_graph, label_pairs
from parley.operators.retrieve import vector_topk
from parley.schemas import STATE
from parley.session import cut
from parley.sources.batches import validate_batches
from parley.sources.dump import clean_dump, quarantine_unmapped
from parley.streaming import incremental as K

T0 = dt.datetime(2024, 1, 1)


def state_of(spark, n, channel="c"):
    rows = [(f"m{i:03d}", channel, "g", f"u{i % 3}", "one two three four five six seven", T0 + dt.timedelta(minutes=i + 600 * (i == n - 1)),
             None, None, None, 0, 7, "b", T0, 0, None) for i in range(n)]
    state = {t: spark.createDataFrame([], ddl) for t, ddl in STATE.items()}
    return {**state, "messages": spark.createDataFrame(rows, STATE["messages"])}


@pytest.mark.parametrize("cap", [5, None])
def test_a_capped_run_empties_the_channel(spark, cap):
    state = state_of(spark, 11)
    vectors = state["messages"].select("id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vec"))
    left = 11
    for _ in range(1 if cap is None else -(-10 // cap)):
        state, summary = cluster_channels(state, vectors, T0, 30, 6, max_messages=cap, dim=2)
        state = {t: cut(df) for t, df in state.items()}
        now = state["messages"].filter("processed = 0").count()
        assert now < left
        left = now
    assert left == 1  # the last message is in an open block


def test_unmapped_channels_stop_a_conversion_or_are_set_aside(spark):
    rows = spark.createDataFrame([(1, "1", "a", "x", "2024-01-01T00:00:00Z", None, "g"), (2, "2", "b", "y", "2024-01-01T00:00:00Z", None, None)],
                                 "pos long, id string, channel_id string, content string, created_at string, deleted_at string, guild_id string")
    with pytest.raises(ValueError, match="b"):
        clean_dump(rows)
    mapped, rest = quarantine_unmapped(rows)
    assert clean_dump(mapped).count() == 1 and [r.id for r in rest.collect()] == ["2"]


def test_every_message_of_a_long_discussion_is_in_a_prompt(spark):
    msgs = spark.createDataFrame([("d", f"m{i:04d}", "a", T0 + dt.timedelta(seconds=i), f"text {i}") for i in range(95)],
                                 "discussion_id string, id string, author_label string, created_at timestamp, content string")
    parts = {r.part: r.prompt for r in render_prompts(msgs, 40).collect()}
    assert sorted(parts) == [1, 2, 3]
    assert sum(f"[id=m{i:04d}]" in "".join(parts.values()) for i in range(95)) == 95


def test_pairs_of_any_number_of_labels(spark):
    labels = spark.createDataFrame([("d", f"t{i:02d}") for i in range(30)], "discussion_id string, topic string")
    assert label_pairs(labels, "topic").count() == 30 * 29 // 2


def test_a_built_graph_pairs_any_number_of_labels(spark):
    none = "username string, display_name string, first_seen_at timestamp, last_seen_at timestamp, user_message_count long"
    facts = {
        "discussions": spark.createDataFrame([("d", "c", T0, T0)], "id string, channel_id string, started_at timestamp, ended_at timestamp"),
        "participants": spark.createDataFrame([("d", "u", 1, T0, T0, None, None, None, None, 1)], (
            f"discussion_id string, author_id string, message_count long, first_message_at timestamp, last_message_at timestamp, {none}")),
        "topics": spark.createDataFrame([("d", i, f"t{i:02d}") for i in range(30)], "discussion_id string, pos int, topic string"),
        "entities": spark.createDataFrame([("d", i, f"other:e{i:02d}", f"e{i:02d}", "other") for i in range(30)],
                                          "discussion_id string, pos int, key string, name string, type string"),
        "links": spark.createDataFrame([("d", None, None)], "id string, continuation_of_discussion_id string, continuation_reason string"),
    }
    graph = build_graph(facts, spark.createDataFrame([("c", "n", "g")], "id string, name string, guild_id string"),
                        spark.createDataFrame([("g", "n")], "id string, name string"))
    assert graph["edges_topic_cooccurs"].count() == graph["edges_entity_cooccurs"].count() == 30 * 29 // 2


def test_caps_below_one_are_refused(spark):
    queue = spark.createDataFrame([("c", T0, "d", 5, 1)], "channel_id string, block_start_at timestamp, id string, tokens long, messages long")
    with pytest.raises(ValueError, match="positive"):
        pack_batches(queue, max_discussions=0)


def test_bad_documents_are_set_aside(spark):
    def doc(**change):
        message = {"id": "1", "author": {"id": "a"}, "content": "x", "created_at": "2024-01-01T00:00:00Z", **change}
        return json.dumps({"guild": {"id": "g"}, "channel": {"id": "c"}, "messages": [message]})

    docs = [doc(), doc(created_at="soon"), doc(content=5), doc(mentions=["b"]), doc(mentions="b"), doc(attachments_count="2"), "{"]
    good, bad = validate_batches(spark.createDataFrame([(str(i), v) for i, v in enumerate(docs)], "doc string, value string"))
    assert good.count() == 2
    assert {r.doc: r.reason for r in bad.collect()} == {
        "1": "unreadable time", "2": "value of a wrong type", "4": "value of a wrong type", "5": "value of a wrong type", "6": "not a JSON object"}


def test_dictionary_payloads(spark):
    entries = ['{"id":"u1","username":"a"}', '{"id":"u1","display_name":"D"}', '{"id":"u1","username":"b"}', '{"id":null}', '{"username":"x"}', "nope",
               '{"id":"u2","age":"5"}', '{"id":"u2","username":7}', '{"id":"u3"}']
    payload = spark.createDataFrame(list(enumerate(entries)), "pos long, json string")
    good = {r.id: r for r in D.payload_rows(payload, D.SECTIONS["users"]).collect()}
    assert set(good) == {"u1", "u3"} and (good["u1"].username, good["u1"].display_name, good["u1"].entries) == ("b", "D", 3)
    _, bad = D.validate_payload(payload, D.SECTIONS["users"])
    assert sorted(r.reason for r in bad.collect()) == ["entry without an id", "entry without an id", "not a JSON object", "unknown key", "value is not a string"]
    dim = spark.createDataFrame([("u1", "old", None)], "id string, username string, display_name string")
    after = D.sync_dictionary(dim, D.payload_rows(payload, D.SECTIONS["users"]), D.SECTIONS["users"], T0)
    assert sorted((r.id, r.username, r.display_name) for r in after.collect()) == [("u1", "b", "D"), ("u3", None, None)]
    names = spark.createDataFrame([("u1", "n", "m"), ("u1", "n", "m")], "id string, username string, display_name string")
    assert D.propagate_names(dim, names, D.SECTIONS["users"]).count() == 1


def test_vector_search_over_many_parts(spark):
    import numpy as np

    r = np.random.default_rng(3)
    d = [(f"d{i:03d}", f"c{i % 3}", "t", T0, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    q = [(i, 1, [float(x) for x in r.normal(size=8)], ["c1"] if i % 2 else None, None, None) for i in range(25)]
    nodes = spark.createDataFrame(d, "id string, channel_id string, discussion_type string, started_at timestamp, embedding array<float>")
    asked = spark.createDataFrame(q, "question_id long, variant_no int, vec array<float>, channel_ids array<string>, discussion_types array<string>, since timestamp")
    got: dict = {}
    for row in vector_topk(asked, nodes, 5, part_rows=40).orderBy("question_id", "rank").collect():
        got.setdefault(row.question_id, []).append(row.id)
    for i, _, v, channels, _, _ in q:
        cos = {x[0]: np.dot(v, x[4]) / np.linalg.norm(v) / np.linalg.norm(x[4]) for x in d if channels is None or x[1] in channels}
        assert got[i] == sorted(cos, key=lambda k: -cos[k])[:5]


def test_streamed_clusters_equal_the_batch_form(spark, tmp_path):
    rows = [(f"m{i:03d}", f"c{i % 2}", "b", f"u{i % 5}", None, T0 + dt.timedelta(minutes=3 * i + 200 * (i // 40)),
             [float((i * 7) % 5), float((i * 3) % 4), 1.0]) for i in range(160)]
    df = spark.createDataFrame(rows, "id string, channel_id string, block string, author_id string, mentions array<string>, created_at timestamp, vec array<float>")
    df = df.withColumn("vec", F.expr("transform(vec, x -> cast(x / sqrt(aggregate(vec, 0D, (a, y) -> a + y * y)) as float))"))
    for k in range(4):
        df.filter(F.substring("id", 2, 3).cast("int").between(40 * k, 40 * k + 39)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = K.stream_subclusters(stream, 0.9, 15).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = {r.id: r.root_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = subcluster(df.withColumn("block_no", F.lit(0).cast("bigint")), 0.9, 15)
    assert streamed == {r.id: r.root_id for r in batch.collect()}


def test_sessions_go_on_under_a_new_checkpoint(spark, tmp_path):
    def rows(part, *of):
        df = spark.createDataFrame([(f"{c}{m}", c, T0 + dt.timedelta(minutes=m)) for c, m in of], "id string, channel_id string, created_at timestamp")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        return df.schema

    def drain(schema, source, checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{source}")
        K.stream_sessions(stream, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    schema = rows("1", ("a", 0), ("a", 10), ("a", 100), ("b", 0))
    rows("2", ("a", 20))
    rows("3", ("a", 5), ("a", 101), ("c", 0))
    drain(schema, "{1,2}", "cp")
    drain(schema, "{1,3}", "cp-new")  # reads part 1 again
    got = sorted((r.channel_id, r.start_at, r.end_at, r.messages, r.closed) for r in K.read_sessions(spark, f"{tmp_path}/out").collect())

    def at(m):
        return T0 + dt.timedelta(minutes=m)

    assert got == [("a", at(0), at(20), 4, True), ("a", at(100), at(101), 2, False), ("b", at(0), at(0), 1, False), ("c", at(0), at(0), 1, False)]


def test_streamed_clusters_of_a_channel_far_behind(spark, tmp_path):
    rows = [(f"{c}{i:02d}", c, f"u{i % 2}", None, T0 + dt.timedelta(days=9 * (c == "a"), minutes=4 * i), [1.0, 0.0] if i % 3 else [0.0, 1.0])
            for c in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "id string, channel_id string, author_id string, mentions array<string>, created_at timestamp, vec array<float>")
    for k in range(3):
        df.filter(F.substring("id", 2, 2).cast("int").between(10 * k, 10 * k + 9)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    K.stream_subclusters(stream, 0.9, 15).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    streamed = {r.id: r.root_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = subcluster(df.withColumn("block_no", F.lit(0).cast("bigint")), 0.9, 15)
    assert len(streamed) == 60 and streamed == {r.id: r.root_id for r in batch.collect()}
