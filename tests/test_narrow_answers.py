"""What candidates and sampled messages carry while they are chosen: numbers and keys, no lists and no texts."""

import datetime as dt

from parley.operators import answers as A
from parley.operators import retrieve as R

T0 = dt.datetime(2024, 1, 1)


def nodes_and_questions(spark):
    nodes = spark.createDataFrame([(f"d{i}", [1.0, float(i)]) for i in range(6)], "id string, embedding array<float>")
    return nodes, spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "question_id long, vec array<float>")


def test_candidates_are_folded_by_numbers(spark):
    """Sources and paths come out by name, and no list or text is gathered on the way."""
    nodes, q = nodes_and_questions(spark)
    hits = spark.createDataFrame([(1, "d0", 1.0), (1, "d0", 0.5), (1, "d1", 0.7), (2, "d5", 0.9)], "question_id long, id string, similarity double")
    merged = R.merge_candidates(hits, spark.createDataFrame([(1, "d0"), (2, "d2")], "question_id long, id string"), q, nodes)
    got = {(r["question_id"], r["id"]): (r["anchor_hit"], r["sources"]) for r in merged.collect()}
    assert got == {(1, "d0"): (True, ["anchor", "vector"]), (1, "d1"): (False, ["vector"]), (2, "d5"): (False, ["vector"]), (2, "d2"): (True, ["anchor"])}
    hops = spark.createDataFrame([(1, "d0", "shared_topic", 0.6), (1, "d0", "shared_entity", 0.8), (1, "d3", "continuation", 1.0), (2, "d2", "cooccurring_topic", 0.4)],
                                 "question_id long, id string, via string, weight double")
    scored = R.score_expansion(merged, hops, q, nodes)
    got = {(r["question_id"], r["id"]): (r["via"], r["expansion_score"], r["anchor_hit"], r["sources"]) for r in scored.collect()}
    assert got == {(1, "d0"): ("shared_entity", 0.8, True, ["anchor", "expansion", "vector"]), (1, "d1"): (None, 0.0, False, ["vector"]),
                   (1, "d3"): ("continuation", 1.0, False, ["expansion"]), (2, "d5"): (None, 0.0, False, ["vector"]),
                   (2, "d2"): ("cooccurring_topic", 0.4, True, ["anchor", "expansion"])}
    for df in (merged, scored):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_vectors_are_not_made_wider_to_be_compared(spark):
    """Unit vectors of double precision took twice the shuffle of the stored ones."""
    nodes, q = nodes_and_questions(spark)
    rows = R._similarity(spark.createDataFrame([(2, "d3")], "question_id long, id string"), q, nodes)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(" not in plan and abs(rows.first()["similarity"] - 3 / 10**0.5) < 1e-8


def test_texts_join_the_messages_that_are_sampled(spark):
    """Texts are looked up for what a sample can hold alone; samples are those of messages that have their texts."""
    evid = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 9), (2, "b", 1)], "question_id long, id string, evidence_rank int")
    said = [(d, f"{d}{i:02d}", f"u{i % 3}", T0 + dt.timedelta(minutes=i), f"text {i}") for d in "abcd" for i in range(12)]
    whole = spark.createDataFrame([*said, said[0], said[13]], "discussion_id string, id string, author_id string, created_at timestamp, content string")
    users = spark.createDataFrame([("u0", "zero", None), ("u1", None, "One")], "id string, username string, display_name string")
    slim, asked = whole.drop("content").distinct(), []

    def texts(rows):
        asked.extend(rows.collect())
        return rows.join(whole.select("discussion_id", "id", "content"), ["discussion_id", "id"])

    cols = ["discussion_id", "id", "author_label", "created_at", "content", "rn"]
    got = A.sampled_messages(evid, slim, users, 4, 5, texts).select(*cols)
    want = A.sampled_messages(evid, whole, users, 4, 5).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 10
    assert len(asked) == 10 and "content" not in asked[0].asDict() and {r["discussion_id"] for r in asked} == {"a", "b"}


def test_evidence_sorts_no_more_than_it_can_pick(spark):
    """Behind the first n only negative and positive rows of opinion questions can get a seat."""
    ranked = spark.createDataFrame([(k, f"d{i}", ["neutral", "negative", None][i % 3 if i > 30 else 0], i) for k in (1, 2) for i in range(1, 60)],
                                   "question_id long, id string, sentiment string, rank int")
    q = spark.createDataFrame([(1, "opinion"), (2, "factual")], "question_id long, intent string")
    got = R.diversify(ranked, q, 4)
    assert sorted((r["question_id"], r["rank"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 31), (2, 1), (2, 2), (2, 3), (2, 4)]
    assert "(rank#" in got._jdf.queryExecution().optimizedPlan().toString()
