"""A graph merged by touched keys equals a rebuild, and only touched rows are written."""

import pytest
from pyspark.sql import functions as F

from parley.operators import graph as G
from parley.plans.fixtures import DIM, Fx, Stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fx(spark, SF)


def facts_of(fx, ids, topics=None):
    ready = fx.ready.where(F.col("id").isin(*ids))
    enrichment = fx.enrichment if topics is None else fx.enrichment.withColumn("topics", F.array(*map(F.lit, topics)))
    return Stored(G.discussion_facts(ready, enrichment, fx.members, fx.users, DIM))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("case", ["retold", "first written"])
def test_merge_equals_rebuild(fx, case):
    """Discussions told again with other topics, and discussions that are new to the graph (one of them a stub before)."""
    every = sorted(r["id"] for r in fx.ready.where("has_enrichment").select("id").collect())
    if case == "retold":
        old, delta = Stored(fx.facts), facts_of(fx, every[:4], ["topic 1", "quite new"])
    else:
        target = fx.ready.where("continuation_of_discussion_id is not null").join(
            fx.ready.select(F.col("id").alias("continuation_of_discussion_id")), "continuation_of_discussion_id").first()["continuation_of_discussion_id"]
        ids = sorted({target, *every[5:8]})
        old, delta = facts_of(fx, [i for i in every if i not in ids]), facts_of(fx, ids)
    graph = Stored(G.build_graph(old, fx.channels, fx.guilds))
    some = ["nodes_discussion", "nodes_topic", "nodes_user", "edges_occurred_in", "edges_participated_in", "edges_interested_in", "edges_topic_cooccurs"]
    tables = some if case == "retold" else list(G.GRAPH_KEY)
    _, merged, rewritten = G.merge_touched(old, graph, delta, fx.channels, fx.guilds, tables)
    wanted = G.build_graph(G.merge_facts(old, delta), fx.channels, fx.guilds)
    for table in tables:
        assert rows(merged[table]) == rows(wanted[table]), table
    ids = delta["discussions"].count()
    assert rewritten["nodes_discussion"].count() == ids
    assert rewritten["edges_occurred_in"].count() == ids
    # what is written is what the changed discussions concern
    assert rewritten["edges_participated_in"].count() == delta["participants"].count()
    assert rewritten["nodes_user"].count() < wanted["nodes_user"].count()
    assert rewritten["edges_interested_in"].count() < wanted["edges_interested_in"].count() / 4
