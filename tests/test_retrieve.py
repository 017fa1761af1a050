"""Exact search, relaxation, diversity and confidence on small tables."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from parley.operators import answers as A
from parley.operators import retrieve as R

T0 = dt.datetime(2024, 1, 1)


def test_topk_equals_brute_force_over_parts(spark):
    rng = np.random.default_rng(0)
    q, d = rng.normal(size=(23, 6)).astype(np.float32), rng.normal(size=(200, 6)).astype(np.float32)
    d[50] = d[51]
    kinds = ["question", "other"]
    nodes = spark.createDataFrame(
        [(f"d{i:03d}", f"c{i % 3}", kinds[i % 2], T0 + dt.timedelta(hours=i), [float(x) for x in v]) for i, v in enumerate(d)],
        "id string, channel_id string, discussion_type string, started_at timestamp, embedding array<float>").repartition(5)
    variants = spark.createDataFrame(
        [(i, 1, [float(x) for x in v], ["c1"] if i % 3 == 0 else None, ["other"] if i % 4 == 0 else None,
          T0 + dt.timedelta(hours=90) if i % 5 == 0 else None) for i, v in enumerate(q)],
        "question_id long, variant_no int, vec array<float>, channel_ids array<string>, discussion_types array<string>, since timestamp")
    got = {}
    for r in R.vector_topk(variants, nodes, k=7, part_rows=30).collect():
        got.setdefault(r["question_id"], {})[r["rank"]] = r["id"]
    sim = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(float) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(float).T
    for i in range(len(q)):
        ok = [j for j in range(200) if (i % 3 or j % 3 == 1) and (i % 4 or j % 2 == 1) and (i % 5 or j >= 90)]
        want = sorted(ok, key=lambda j: (-round(sim[i, j], 6), j))[:7]
        assert [got[i][k] for k in sorted(got[i])] == [f"d{j:03d}" for j in want]


def ranked(spark, sentiments, intent="opinion"):
    rows = [(1, f"d{i:02d}", s, i + 1) for i, s in enumerate(sentiments)]
    q = spark.createDataFrame([(1, intent)], "question_id long, intent string")
    return spark.createDataFrame(rows, "question_id long, id string, sentiment string, rank int"), q


def picks(spark, sentiments, n, intent="opinion"):
    r, q = ranked(spark, sentiments, intent)
    return [x["rank"] for x in R.diversify(r, q, n).orderBy("evidence_rank").collect()]


def test_diversity_seats_both_missing_sentiments(spark):
    many = ["neutral"] * 5 + ["negative", "positive", "negative"]
    assert picks(spark, many, 4) == [1, 2, 6, 7]
    assert picks(spark, many, 4, "factual") == [1, 2, 3, 4]
    assert picks(spark, ["positive", "neutral", "neutral", "negative"], 3) == [1, 2, 4]
    # the only positive pick keeps its seat when a negative one comes in
    assert picks(spark, ["neutral", "neutral", "positive", "negative"], 3) == [1, 3, 4]


def test_confidence_notes_and_used_counts(spark):
    q = spark.createDataFrame([(i, f"q{i}", "other", "en" if i == 3 else "cs") for i in range(1, 6)],
                              "question_id long, question string, intent string, answer_language string")
    drafts = spark.createDataFrame(
        [(1, "a", "high", None, "ok", None), (2, "b", "high", "thin", "ok", None), (4, "c", "high", None, "ok", None),
         (5, None, None, None, "error", "model down")],
        "question_id long, answer string, confidence string, caveats string, status string, error string")
    cited = spark.createDataFrame([(1, True), (1, False), (2, True), (4, False), (4, False)], "question_id long, used boolean")
    relaxed = spark.createDataFrame([(4,)], "question_id long")
    out = {r["question_id"]: r for r in A.finalize_answers(q, drafts, cited, relaxed).collect()}
    assert [out[i]["confidence"] for i in (1, 2, 3, 4)] == ["high", "medium", "low", "medium"]
    assert [out[i]["used_discussion_count"] for i in (1, 2, 3, 4)] == [1, 1, 0, 2]
    assert out[2]["answer"] == "b\n\n_Poznámka: thin_" and A.RELAXED_NOTE in out[4]["answer"]
    assert out[3]["answer"] == A.NO_EVIDENCE["en"]
    assert [out[i]["status"] for i in (1, 3, 5)] == ["ok", "no evidence", "error"]
    assert out[5]["answer"] is None and out[5]["error"] == "model down"


def test_first_block_always_stays_and_overflow_stops(spark):
    rows = [(1, 1, "F1", "L1", 90, 80), (1, 2, "F2", "L2", 30, 5), (1, 3, "F3", "L3", 30, 30), (1, 4, "F4", "L4", 1, 1),
            (2, 1, "F", "L", 999, 500)]
    blocks = spark.createDataFrame(rows, "question_id long, evidence_rank int, full string, lean string, full_tokens long, lean_tokens long")
    got = sorted((r["question_id"], r["text"]) for r in A.pack_context(blocks, 100).collect())
    assert got == [(1, "F1"), (1, "L2"), (2, "L")]


def test_pruned_lists_hold_every_admitted_row(spark):
    """A label on all discussions: the pruned list still gives the exact newest ones per filter."""
    n = 400
    nodes = spark.createDataFrame(
        [(f"d{i:03d}", f"c{i % 4}", f"t{i % 5}", T0 + dt.timedelta(hours=(i * 7) % n)) for i in range(n)],
        "id string, channel_id string, discussion_type string, started_at timestamp")
    edges = nodes.select(F.lit("hot").alias("topic"), "id")
    lists = R.best_lists(edges, nodes, ["topic"], 6, [0, 2, 3])
    assert lists.count() == 6 + 6 * 4 + 6 * 20
    want = [r["id"] for r in nodes.filter("channel_id = 'c1'").orderBy(F.col("started_at").desc(), "id").limit(6).collect()]
    got = [r["id"] for r in lists.filter("mode = 2 and channel_id = 'c1'").orderBy(F.col("started_at").desc(), "id").collect()]
    assert got == want


def test_a_search_gives_k_rows_per_variant_and_no_second_cut(spark):
    """What leaves the search is its result: no row per part, and no window over such rows."""
    t = dt.datetime(2024, 1, 1, 10, 0, 0, 300)
    nodes = spark.createDataFrame([(f"d{i}", "c", "t", t, [1.0, float(i % 4)]) for i in range(50)],
                                  "id string, channel_id string, discussion_type string, started_at timestamp, embedding array<float>")
    schema = "question_id long, variant_no int, vec array<float>, channel_ids array<string>, discussion_types array<string>, since timestamp"
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0], None, None, t.replace(microsecond=500)), (2, 1, [1.0, 0.0], None, None, t)], schema)
    found = R.vector_topk(asked, nodes, k=3, part_rows=1)
    assert "Window" not in found._jdf.queryExecution().toString()
    # a date is compared whole, ties go by id
    assert sorted((r["question_id"], r["rank"], r["id"]) for r in found.collect()) == [(2, 1, "d0"), (2, 2, "d12"), (2, 3, "d16")]


def test_expansion_equals_all_paths_in_order(spark):
    """Hot labels, filters by channel and date, seeds that meet themselves: as when every path is listed."""
    n, kinds = 60, ["question", "other"]
    disc = [(f"d{i:02d}", f"c{i % 3}", kinds[i % 2], T0 + dt.timedelta(hours=(i * 7) % 20)) for i in range(n)]
    topic = [(f"d{i:02d}", f"t{i % 7 if i % 5 else 9}") for i in range(n)]
    entity = [(f"d{i:02d}", f"e{i}" if i % 4 else "hot") for i in range(n)]
    cont = [("d05", "d04"), ("d09", "d05")]
    pairs = [("t1", "t2"), ("t2", "t9")]
    two = "src string, dst string"
    graph = {"nodes_discussion": spark.createDataFrame(disc, "id string, channel_id string, discussion_type string, started_at timestamp"),
             "edges_discusses": spark.createDataFrame(topic, two), "edges_mentions": spark.createDataFrame(entity, two),
             "edges_continuation_of": spark.createDataFrame(cont, two), "edges_topic_cooccurs": spark.createDataFrame(pairs, two)}
    asks = [(1, None, None, None), (2, ["c1", "c2"], None, None), (3, None, ["other"], T0 + dt.timedelta(hours=9)), (4, [], None, None), (5, ["c0"], ["question"], None)]
    q = spark.createDataFrame(asks, "question_id long, channel_ids array<string>, discussion_types array<string>, since timestamp")
    seeds = [(k, f"d{s:02d}") for k, *_ in asks for s in (0, 4, 5, 16, 11 + k)]
    got = sorted(tuple(r) for r in R.expand(spark.createDataFrame(seeds, "question_id long, seed_id string"), graph, q, 6).select(
        "question_id", "rank", "seed_id", "via", "id").collect())
    labels = {"shared_topic": dict(topic), "shared_entity": dict(entity)}
    near = {a: {b for p in pairs for b in p if a in p and b != a} for a in {t for p in pairs for t in p}}
    paths = {(s, 1.0, "continuation", i) for a, b in cont for s, i in ((a, b), (b, a))}
    for s, *_ in disc:
        for i, *_ in disc:
            paths |= {(s, w, via, i) for via, w in (("shared_topic", 0.6), ("shared_entity", 0.8)) if labels[via][s] == labels[via][i]}
            if labels["shared_topic"][i] in near.get(labels["shared_topic"][s], ()):
                paths.add((s, 0.4, "cooccurring_topic", i))
    info, want = {d[0]: d[1:] for d in disc}, []
    for k, channels, types, since in asks:
        own = {s for x, s in seeds if x == k}
        rows = sorted((-w, -info[i][2].timestamp(), i, s, via) for s, w, via, i in paths if s in own and i != s
                      and (channels is None or info[i][0] in channels) and (types is None or info[i][1] in types)
                      and (since is None or info[i][2] >= since))[:6]
        want += [(k, r + 1, s, via, i) for r, (_, _, i, s, via) in enumerate(rows)]
    assert got == sorted(want) and len({g[0] for g in got}) == 4
    lists = R.best_lists(graph["edges_mentions"].select(F.col("dst").alias("entity"), F.col("src").alias("id")), graph["nodes_discussion"], ["entity"], 3, [2])
    assert {"place", *R.CELL} <= set(lists.columns)  # questions meet only the lists of their own channels and types


def test_blocks_are_packed_by_their_lengths(spark):
    """A discussion's text is held once, not in the ranked rows of every question that finds it."""
    nodes = spark.createDataFrame([("d1", "T", "c", "question", "neutral", True, T0)],
                                  "id string, title string, channel_id string, discussion_type string, sentiment string, resolved boolean, started_at timestamp")
    cands = spark.createDataFrame([(1, "d1", 0.9, False, 0.0)], "question_id long, id string, vec_sim double, anchor_hit boolean, expansion_score double")
    q = spark.createDataFrame([(1, "factual", None)], "question_id long, intent string, preferred_types array<string>")
    assert "summary" not in R.rank_candidates(cands, q, nodes, "2024-02-01 00:00:00").columns
    evid = spark.createDataFrame([(k, f"d{i}", i, f"t{i}", "question", None, i % 2 == 0, T0) for k in (1, 2) for i in range(1, 7)],
                                 "question_id long, id string, evidence_rank int, title string, discussion_type string, sentiment string, resolved boolean, started_at timestamp")
    cores = spark.createDataFrame([(f"d{i}", "ch", ["a"], None, [], "s" * 40 * i) for i in range(1, 6)],
                                  "id string, channel_name string, topics array<string>, entities array<string>, participants array<struct<rn:int,name:string,message_count:long>>, summary string")
    bits = spark.createDataFrame([("d2", ["k"], "x")], "id string, key_points array<string>, summary string")
    said = spark.createDataFrame([("d1", "m1", "u", T0, "hello é", 1), ("d5", "m2", "u", T0, "x", 1)],
                                 "discussion_id string, id string, author_label string, created_at timestamp, content string, rn int")
    texts = A.block_texts(cores, bits, said)
    for budget in (60, 150, 1000):
        packed = A.packed_texts(A.pack_evidence(evid, texts, 4, budget), texts, 4)
        got = sorted((r["question_id"], r["evidence_rank"], r["with_raw"], r["text"]) for r in packed.collect())
        whole = A.pack_context(A.render_blocks(evid, cores, bits, said, 4), budget)
        assert got == sorted((r["question_id"], r["evidence_rank"], r["with_raw"], r["text"]) for r in whole.collect()) and got
    for r in A.render_blocks(evid, cores, bits, said, 4).collect():
        assert r["lean_tokens"] == -(-len(r["lean"]) * 10 // 34) and r["full_tokens"] == -(-len(r["full"]) * 10 // 34)


def test_pairs_of_a_hot_type_are_dealt_to_tasks(spark):
    """However few types there are, no cut holds more than so many pairs; the pairs are those of a plain join."""
    nodes = spark.createDataFrame([(f"d{i}", f"c{i % 3}", "hot" if i % 5 else "rare", T0 + dt.timedelta(hours=i)) for i in range(90)],
                                  "id string, channel_id string, discussion_type string, started_at timestamp")
    q = spark.createDataFrame([(i, "hot", ["c1"] if i % 2 else None, ["rare"] if i % 7 == 3 else None, T0 + dt.timedelta(hours=60) if i % 3 == 0 else None)
                               for i in range(40)], "question_id long, discussion_type string, channel_ids array<string>, discussion_types array<string>, since timestamp")
    got = R.admitted_pairs(q, nodes, "discussion_type", most=200)
    joined = q.join(nodes, "discussion_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.hard_filter(joined).select("question_id", "id").collect()))
    per_task = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(per_task) > 4 and max(per_task) < sum(per_task) / 2
    assert R.admitted_pairs(q.limit(0), nodes, "discussion_type").count() == 0
