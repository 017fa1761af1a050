"""Queries that give all of what they work out: vectors themselves, and pairs of every type."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parley.functions.vectors import hashing_embedder, length, scaled_dot, unit
from parley.operators import retrieve as R
from parley.plans import QUERIES
from parley.plans.fixtures import DIM

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Thirty vectors, seven documents."""
    at, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(3)
    pq.write_table(pa.table({"vec_id": list(range(30)), "embedding": pa.array(rng.normal(size=(30, 4)).astype(np.float32).tolist(), pa.list_(pa.float32())),
                             "label": [i % 3 for i in range(30)]}), at / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": list(range(7)), "text": [f"words of number {i} " * (i + 1) for i in range(7)],
                             "lang": ["en"] * 7, "source": ["web"] * 7, "n_chars": [20] * 7}), at / "documents.parquet")
    return str(at)


def test_discussions_come_with_their_vectors(spark, folder):
    rows = QUERIES["embed_discussions"](spark, folder).collect()
    texts = {r["discussion_id"]: r["text"] for r in QUERIES["embedding_text"](spark, folder).collect()}
    assert len(rows) == len(texts) == 21 and all(r["dim"] == DIM for r in rows)
    for r in rows:
        assert np.allclose(r["embedding"], hashing_embedder(DIM)(["query: " + texts[r["discussion_id"]]])[0])


def test_hard_filters_meet_discussions_of_every_type(spark):
    """The type that a question prefers is no filter: pairs are those of a plain cross join."""
    nodes = spark.createDataFrame([(f"d{i}", f"c{i % 3}", ["question", "other", None][i % 4 % 3], T0 + dt.timedelta(hours=i)) for i in range(70)],
                                  "id string, channel_id string, discussion_type string, started_at timestamp")
    q = spark.createDataFrame([(i % 40, ["c1", "c2"] if i % 2 else None, ["question"] if i % 7 == 3 else None, T0 + dt.timedelta(hours=60) if i % 3 == 0 else None)
                               for i in range(45)], "question_id long, channel_ids array<string>, discussion_types array<string>, since timestamp")
    got = R.admitted_pairs(q, nodes, most=100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.hard_filter(q.crossJoin(nodes)).select("question_id", "id").collect()))
    per_task = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(per_task) > 20 and max(per_task) <= 400
    assert R.admitted_pairs(q.limit(0), nodes).count() == 0 and R.admitted_pairs(q, nodes.limit(0)).count() == 0


def test_keys_are_dealt_to_one_partition_each(spark):
    for n in (1, 8, 40):
        keys = R.spread_keys(spark, n)
        rows = spark.createDataFrame([(k,) for k in keys for _ in range(3)], "block int").repartition(n, "block")
        assert [len(p) for p in rows.rdd.glom().collect()] == [3] * n


def test_lengths_are_found_once_per_vector(spark):
    """A vector's length is no part of what is worked out per coordinate; cosines are those of unit vectors."""
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(unit(F.col("a")).alias("u"), scaled_dot(F.col("a"), length(F.col("a")), F.col("b"), length(F.col("b"))).alias("s")).collect()
    assert [r["u"] for r in got] == [[0.6, 0.8], [0.0, 0.0], None] and [r["s"] for r in got] == [pytest.approx(0.6), 0.0, None]
    plan = df.select(unit(F.col("a")).alias("u"))._jdf.queryExecution().optimizedPlan().toString().lower()
    inner = plan[plan.rindex("transform("):]
    assert "sqrt" in plan and "sqrt" not in inner
