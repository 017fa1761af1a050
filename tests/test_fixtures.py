"""The fixture views reach every text, and most messages lie in closed blocks."""

import pytest
from pyspark.sql import functions as F

from parley.plans.fixtures import Fx


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_text_is_met(spark, sf):
    fx = Fx(spark, f"/root/testdata/{sf}")
    met = fx.messages.select(F.xxhash64("content").alias("h")).distinct()
    for name in ("documents", "conversations"):
        texts = fx.table(name).select(F.xxhash64("text").alias("h")).distinct()
        if sf == "sf0.001" and name == "conversations":
            continue  # fewer events than turns could need is no fault of the rule
        assert texts.join(met, "h", "left_anti").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_document_is_in_a_summary(spark, sf):
    fx = Fx(spark, f"/root/testdata/{sf}")
    wanted = fx.table("documents").select("text").distinct().agg(F.sum(F.length("text"))).first()[0]
    talks = fx.enrichment.select("summary").distinct().agg(F.sum(F.length("summary"))).first()[0]
    assert talks >= wanted  # equal texts may share a summary of their own


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_most_messages_are_in_closed_blocks(spark, sf):
    closed, n = Fx(spark, f"/root/testdata/{sf}").slim_blocks.agg(F.count_if("closed"), F.count("*")).first()
    assert closed > 0.9 * n


def test_no_event_is_joined_by_a_key_it_has_not(spark):
    """Three of four events take no document: as null keys they would all be dealt to one task."""
    fx = Fx(spark, "/root/testdata/sf0.001")
    plan = fx.messages.select("content")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "CASE WHEN" not in plan
    assert fx.messages.count() == fx.events.count()


def test_prompts_are_not_moved_to_find_the_wanted_calls(spark):
    fx = Fx(spark, "/root/testdata/sf0.001")
    assert "user_prompt" not in fx.slim_calls.columns and "user_prompt" in fx.with_prompts(fx.slim_calls).columns


def test_arrow_batches_are_bounded_by_bytes(spark):
    """A batch of long texts stays small in a worker, however many rows a partition has."""
    long = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) as t")

    def run(frames):
        for f in frames:
            yield f.assign(t=f["t"].str.len().astype(str)).head(1).assign(t=str(len(f)))

    assert max(int(r["t"]) for r in long.mapInPandas(run, "t string").collect()) < 400
