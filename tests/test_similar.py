"""The similarity join against all pairs, components against union-find, labels made one, re-keyed facts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import similar
from parley.operators.graph import build_graph
from parley.operators.linked import components
from parley.operators.similar import canonical_labels, rekeyed_facts, similar_links


def roots(links, nodes=()):
    up = {n: n for n in nodes}

    def root(n):
        up.setdefault(n, n)
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_union_find(spark, seed):
    r = random.Random(seed)
    links = [(i, i + 1) for i in range(200, 260)] + [(1000, r.randrange(1001, 1400)) for _ in range(300)]  # a chain and a hub
    links += [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7000, 7000)]
    r.shuffle(links)
    frame = spark.createDataFrame([*links, (None, 5), (6, None)], "a long, b long")
    got = components(frame).collect()
    assert len(got) == len({g["node"] for g in got})
    assert {g["node"]: g["root"] for g in got} == roots(links)
    assert components(frame.limit(0)).count() == 0


def vectors(seed, n=400, dim=6):
    """Dense bundles of directions, one of them with a third of all rows, copies, and rows without direction."""
    g = np.random.default_rng(seed)
    centers = g.normal(size=(25, dim))
    rows = []
    for i in range(n):
        c = 0 if i % 3 == 0 else int(g.integers(25))
        v = centers[c] + g.normal(size=dim) * 0.25
        rows.append([("a", "b", None)[i % 3 if i % 7 else 1], f"n{i:04d}", v.tolist()])
    for i in range(0, 60, 2):
        rows[i][2] = rows[60][2]
        rows[i][0] = rows[60][0]
    return [*map(tuple, rows), ("a", "zero", [0.0] * dim), ("a", "none", None)]


@pytest.mark.parametrize(("cell", "block", "theta"), [(20, 8, 0.95), (50, 1000, 0.9), (2000, 16, 0.8), (10, 3, -1.0)])
def test_links_connect_what_all_pairs_do(spark, cell, block, theta):
    rows = vectors(4)
    got = similar_links(spark.createDataFrame(rows, "grp string, node string, vec array<double>"), theta, cell, block).collect()
    unit = {n: np.array(v) / np.linalg.norm(v) for _, n, v in rows if v is not None and any(v)}
    grp = {n: g or "" for g, n, _ in rows}
    near = [(a, b) for a in unit for b in unit if a < b and grp[a] == grp[b] and unit[a] @ unit[b] >= theta]
    assert all(grp[g["a"]] == grp[g["b"]] and unit[g["a"]] @ unit[g["b"]] >= theta - 1e-12 for g in got)
    assert roots((g["a"], g["b"]) for g in got) == roots(near)
    assert len(got) <= len(near) and len(got) <= len(rows) * (1 + len(rows) / block)


def test_cells_save_comparisons(spark, monkeypatch):
    """Bundled vectors visit few blocks: the rows that reach blocks are counted."""
    seen = []
    monkeypatch.setattr(similar, "cut", lambda df, real=similar.cut: seen.append(real(df)) or seen[-1])
    rows = [("g", n, v) for _, n, v in vectors(8, n=600, dim=3) if v and any(v)]
    similar_links(spark.createDataFrame(rows, "grp string, node string, vec array<double>"), 0.999, cell=12, block=12).count()
    blocks = next(x for x in seen if "lo" in x.columns)
    homes = next(x for x in seen if "blk" in x.columns and "node" in x.columns)
    alpha = float(np.arccos(0.999))
    own = homes.select("cell", "angle", "blk").alias("x").join(blocks.alias("b"), (F.col("x.cell") == F.col("b.cell")) & (F.col("x.blk") >= F.col("b.blk")) & (
        F.col("angle").between(F.col("lo") - alpha, F.col("hi") + alpha))).count()
    assert own < homes.count() * blocks.count() / 8


def test_labels_of_one_kind_become_one(spark):
    rows = [("topic", "Docker", 5, [1.0, 0.0, 0.0]), ("topic", "docker", 9, [1.0, 0.01, 0.0]), ("topic", "dockers", 9, [1.0, 0.02, 0.0]),
            ("entity:product", "product:docker", 3, [1.0, 0.0, 0.0]), ("topic", "Spark", 1, [0.0, 1.0, 0.0]), ("topic", "blank", 2, None), (None, "x", 1, [1.0, 0.0, 0.0])]
    got = canonical_labels(spark.createDataFrame(rows, "kind string, label string, uses long, vec array<double>"), 0.99).collect()
    assert {(g["kind"], g["label"]): (g["canonical"], g["members"]) for g in got} == {
        ("topic", "Docker"): ("docker", 3), ("topic", "docker"): ("docker", 3), ("topic", "dockers"): ("docker", 3),
        ("entity:product", "product:docker"): ("product:docker", 1), ("topic", "Spark"): ("Spark", 1), ("topic", "blank"): ("blank", 1), (None, "x"): ("x", 1)}


def test_facts_are_keyed_anew(spark):
    facts = {
        "discussions": spark.sql("select id, 'c' as channel_id, timestamp '2024-01-01' as started_at, timestamp '2024-01-02' as ended_at, array('A', 'b', 'a1') as topics "
                                 "from values ('d1'), ('d2') as t(id)"),
        "participants": spark.createDataFrame(
            [("d1", "u", None, None, None, None, 3, 2, None, None)],
            "discussion_id string, author_id string, username string, display_name string, first_seen_at timestamp, last_seen_at timestamp, "
            "user_message_count long, message_count long, first_message_at timestamp, last_message_at timestamp"),
        "topics": spark.createDataFrame([("d1", 0, "A"), ("d1", 1, "b"), ("d1", 2, "a1"), ("d2", 0, "a1")], "discussion_id string, pos int, topic string"),
        "entities": spark.createDataFrame([("d1", 0, "p:x", "X", "p"), ("d2", 0, "p:xx", "XX", "p")], "discussion_id string, pos int, key string, name string, type string"),
        "links": spark.createDataFrame([], "id string, continuation_of_discussion_id string, continuation_reason string"),
    }
    names = spark.createDataFrame([("topic", "a1", "A", 2), ("topic", "A", "A", 2), ("topic", "b", "b", 1), ("entity:p", "p:xx", "p:x", 2)],
                                  "kind string, label string, canonical string, members long")
    new = rekeyed_facts(facts, names)
    assert sorted(map(tuple, new["topics"].select("discussion_id", "pos", "topic").collect())) == [("d1", 0, "A"), ("d1", 1, "b"), ("d2", 0, "A")]
    assert sorted(map(tuple, new["entities"].select("discussion_id", "key", "name").collect())) == [("d1", "p:x", "X"), ("d2", "p:x", "X")]
    assert {r["id"]: r["topics"] for r in new["discussions"].collect()} == {"d1": ["A", "b"], "d2": ["A"]}
    graph = build_graph(new, spark.createDataFrame([("c", "C", None)], "id string, name string, guild_id string"),
                        spark.createDataFrame([], "id string, name string"))
    assert {r["name"]: r["discussion_count"] for r in graph["nodes_topic"].collect()} == {"A": 2, "b": 1}
    assert [tuple(r) for r in graph["edges_interested_in"].select("src", "dst", "weight").orderBy("dst").collect()] == [("u", "A", 2), ("u", "b", 2)]


@pytest.mark.parametrize(("hubs", "theta"), [(40, 0.95), (40, 0.8), (120, 0.9), (25, 0.99), (12, -1.0)])
def test_links_around_hubs_connect_what_all_pairs_do(spark, monkeypatch, hubs, theta):
    """More nodes than hubs: a large component is gathered first, the rest meets every node."""
    rows = vectors(7)
    monkeypatch.setattr(similar, "HUBS", hubs)
    got = similar_links(spark.createDataFrame(rows, "grp string, node string, vec array<double>"), theta, 20, 8).collect()
    unit = {n: np.array(v) / np.linalg.norm(v) for _, n, v in rows if v and any(v)}
    group = {n: g or "" for g, n, v in rows if n in unit}
    assert all(group[x.a] == group[x.b] and float(unit[x.a] @ unit[x.b]) >= theta - 1e-9 for x in got)
    want = [(a, b) for a in unit for b in unit if a < b and group[a] == group[b] and float(unit[a] @ unit[b]) >= theta]
    assert roots([(x.a, x.b) for x in got], unit) == roots(want, unit)


def test_one_large_component_is_not_compared_in_blocks(spark, monkeypatch):
    """Once hubs have gathered nearly all nodes, what is sent to blocks must not grow with their square."""
    monkeypatch.setattr(similar, "HUBS", 64)
    g = np.random.default_rng(3)
    v = [("a", f"n{i}", (g.normal(size=6) * 0.2 + 1).tolist()) for i in range(900)] + [("a", "far", [-1.0] * 6)]

    def blocks(*_, **__):
        raise AssertionError("the large component was cut into cells")

    monkeypatch.setattr(similar, "_with_cells", blocks)
    got = similar_links(spark.createDataFrame(v, "grp string, node string, vec array<double>"), 0.9, 20, 8).collect()
    assert len(set(roots([(x.a, x.b) for x in got], [n for _, n, _ in v]).values())) == 2
