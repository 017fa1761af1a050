"""Reads and merges over graph keys: no texts are written, edges are derived once."""

import pytest

import parley.plans.fixtures as X
from parley.operators import graph as G
from parley.operators import graph_reads as R
from parley.plans import queries_graph as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """Columns of every fixture table that is written."""
    seen = []

    def watched(df, real=X.stored):
        seen.append(df.columns)
        return real(df)

    monkeypatch.setattr(X, "stored", watched)
    return seen


def test_neighbors_write_no_texts(spark, written):
    fx = X.Fx(spark, SF)
    got = sorted(map(tuple, Q.neighbors(fx).collect()))
    assert written and not any({"summary", "embedding"} & set(columns) for columns in written)
    hops = {}
    for kind, src, dst in G.all_edges(fx.graph).collect():
        for node, other in {(src, dst), (dst, src)}:
            hops.setdefault(node, []).append((kind, other, src, dst))
    nodes = {r["node"] for r in G.all_nodes(fx.graph).select("node").collect()}
    wanted = [(n, other, kind, src, dst) for n, h in hops.items() if n in nodes for kind, other, src, dst in sorted(h)[:40]]
    assert got == sorted(wanted)


def test_edges_both_ways_between_the_same_ends(spark, monkeypatch):
    monkeypatch.setattr(R, "all_edges", lambda graph: graph)
    pairs = [("b", "a"), ("a", "b"), ("c", "c"), ("c", "a"), ("c", "b"), ("b", "c")]
    edges = spark.createDataFrame([("T", *p) for p in pairs], "type string, src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    for limit in (1, 2, 3, 9):
        wanted = []
        for n in "abc":
            hops = sorted((d if s == n else s, s, d) for s, d in pairs if n in (s, d))
            wanted += [(n, other, "T", s, d, i + 1) for i, (other, s, d) in enumerate(hops[:limit])]
        assert sorted(map(tuple, R.neighbors(edges, nodes, limit).collect())) == sorted(wanted), limit


def test_merge_of_interests_derives_what_they_are_made_of(spark, written, monkeypatch):
    cuts = []

    def watched(df, real=G.cut):
        cuts.append(df.columns)
        return real(df)

    monkeypatch.setattr(G, "cut", watched)
    assert Q._touched(X.Fx(spark, SF), "edges_interested_in").count()
    assert not any({"summary", "embedding"} & set(columns) for columns in written)
    # touched topics, users and interests, and the rows that are put back
    assert len(cuts) == 4
