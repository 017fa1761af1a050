"""Ingest, dictionary, snapshots, batch validation and staged runs."""

import json

import pytest
from pyspark.sql import functions as F

from parley.operators import dictionary as D
from parley.operators.ingest import ingest
from parley.plans.run import StageError, staged_run
from parley.sources.batches import read_batches
from parley.sources.dump import assert_no_collision, dir_segments, read_dump
from parley.sources.state import empty_state, load_state, save_state, state_tag
from parley.streaming.incremental import stream_batches, stream_ingest, table_of

ROW = ("id string, channel_id string, guild_id string, channel_type string, author_id string, content string, created_at timestamp, "
       "reply_to_message_id string, thread_id string, mentions array<string>, attachments_count int, pos long")


def batch(spark, ids):
    import datetime as dt

    return spark.createDataFrame(
        [(i, "c", "g", None, f"u{n % 2}", "hello there", dt.datetime(2024, 1, 1), None, None, None, None, n) for n, i in enumerate(ids)], ROW)


def test_ingesting_twice_changes_nothing_but_the_ledger(spark):
    s1 = ingest(empty_state(spark), batch(spark, ["a", "b", "a", "c"]), "b1", "2024-02-01")
    s2 = ingest(s1, batch(spark, ["a", "b", "a", "c"]), "b2", "2024-02-02")
    assert s2["messages"].count() == 3
    assert {r["id"]: r["message_count"] for r in s2["users"].collect()} == {"u0": 1, "u1": 2}
    ledger = {r["id"]: (r["message_count"], r["inserted_count"], r["duplicate_count"]) for r in s2["ingestion_batches"].collect()}
    assert ledger == {"b1": (4, 3, 1), "b2": (4, 0, 4)}
    assert s2["messages"].first()["word_count"] == 2


def test_dictionary_absent_keeps_null_clears(spark):
    dim = spark.createDataFrame([("u1", "old", "Old", None)], "id string, username string, display_name string, names_synced_at timestamp")
    rows = [{"id": "u1", "username": None}, {"id": "u2"}]
    p = D.payload_rows(spark.createDataFrame([(json.dumps(r),) for r in rows], "json string"), ["username", "display_name"])
    out = {r["id"]: (r["username"], r["display_name"]) for r in D.sync_dictionary(dim, p, ["username", "display_name"], "2024-02-01").collect()}
    assert out == {"u1": (None, "Old"), "u2": (None, None)}
    assert [r["id"] for r in D.dictionary_changed_ids(dim, p, ["username", "display_name"], "users").collect()] == ["u1"]
    assert D.sync_counts(dim, p, ["username", "display_name"]).first().asDict() == {"received": 2, "created": 1, "updated": 1, "unchanged": 0}


def test_dump_formats(spark, tmp_path):
    row = {"id": 1, "channel_id": "c", "author_id": 5, "created_at": "2024-01-01T00:00:00Z", "extra": [1]}
    (tmp_path / "a.json").write_text(json.dumps([row, {**row, "id": "2"}], indent=1))
    (tmp_path / "b.ndjson").write_text(json.dumps(row) + "\n" + json.dumps({**row, "id": "9"}))
    assert {r["id"] for r in read_dump(spark, str(tmp_path / "a.json"), True).collect()} == {"1", "2"}
    assert {r["id"] for r in read_dump(spark, str(tmp_path / "b.ndjson")).collect()} == {"1", "9"}
    (tmp_path / "bad.ndjson").write_text("{not json")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_dump(spark, str(tmp_path / "bad.ndjson")).collect()


def document(ids, **more):
    m = [{"id": i, "author": {"id": "u"}, "content": "x", "created_at": "2024-01-01T00:00:00Z", **more} for i in ids]
    return {"guild": {"id": "g"}, "channel": {"id": "c"}, "messages": m}


def test_bad_documents_are_rejected_whole(spark, tmp_path):
    docs = [document(["a", "b"]), document([]), {**document(["c"]), "extra": 1}, document(["d"], nick="n"),
            {**document(["e"]), "guild": {"id": "g", "name": "G"}}, document(["f"], mentions=["u"], attachments_count=1)]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    (tmp_path / "z.json").write_text("{broken")
    good, bad = read_batches(spark, str(tmp_path))
    assert {r["id"] for r in good.collect()} == {"a", "b", "f"} and bad.count() == 5


def test_folder_collision_fails(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    names = spark.createDataFrame([("1", "a b"), ("2", "a_b")], "id string, name string")
    with pytest.raises(Exception, match="shared"):
        assert_no_collision(dir_segments(ids, names, "name")).collect()
    assert {r["segment"] for r in dir_segments(ids, names, "name-id").collect()} == {"a_b-1", "a_b-2"}


def test_stream_of_documents_ingests_each_message_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, ids in enumerate([["a", "b"], ["b", "c"], ["c", "d"]]):
        (src / f"{i}.json").write_text(json.dumps(document(ids)))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    docs = stream_batches(spark, str(src), files_per_trigger=1)
    stream_ingest(docs, out, cp, lambda: "2024-02-01").trigger(availableNow=True).start().awaitTermination()
    got = [r["id"] for r in spark.read.parquet(f"{out}/messages").collect()]
    assert sorted(got) == ["a", "b", "c", "d"]
    assert table_of(spark, out, "users").first()["message_count"] == 4
    # a new checkpoint over the same folder repeats nothing and goes on counting
    (src / "3.json").write_text(json.dumps(document(["d", "e"])))
    stream_ingest(docs, out, f"{cp}-new", lambda: "2024-02-02").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in table_of(spark, out, "messages").collect()) == ["a", "b", "c", "d", "e"]
    assert table_of(spark, out, "users").first()["message_count"] == 5


def test_stages_save_as_they_go_and_name_the_failing_one(spark, tmp_path):
    folder = str(tmp_path / "state")
    s = ingest(empty_state(spark), batch(spark, ["a", "b"]), "b1", "2024-02-01")
    save_state({k: s[k] for k in ("messages", "users")}, folder, "ingest")

    def clusters(state):
        m = state["messages"].withColumn("processed", F.lit(1))
        return {**state, "messages": m}, m.agg(F.count("*").alias("n"))

    def broken(state):
        raise ValueError("model down")

    with pytest.raises(StageError, match="enrich: model down"):
        staged_run(spark, folder, [("cluster", clusters), ("enrich", broken)])
    assert state_tag(spark, folder) == "cluster"
    state = load_state(spark, folder)
    assert state["messages"].filter("processed = 1 and content = 'hello there'").count() == 2
    done = staged_run(spark, folder, [("cluster", clusters), ("graph_write", broken)], skip_graph=True)
    assert list(done) == ["cluster"]


def test_a_micro_batch_parses_its_documents_once(spark, tmp_path):
    """Every table of a micro-batch and the quarantine come from one reading of the documents."""
    from pyspark.sql import functions as F

    doc = '{"guild":{"id":"g"},"channel":{"id":"c"},"messages":[{"id":"%s","author":{"id":"1"},"content":"a","created_at":"2024-01-01T00:00:00Z"}]}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "docs.txt").write_text("\n".join([doc % "m1", doc % "m2", doc % "m1" + " ", "broken"]))
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: (read.add(1), v)[1]).asNondeterministic()
    stream = spark.readStream.format("text").load(str(tmp_path / "in")).select(F.md5("value").alias("doc"), counted("value").alias("value"))
    out = str(tmp_path / "out")
    stream_ingest(stream, out, f"{out}-cp", lambda: "2024-02-01").trigger(availableNow=True).start().awaitTermination()
    assert table_of(spark, out, "messages").count() == 2
    assert spark.read.parquet(f"{out}/quarantine").count() == 1
    assert read.value == 4
