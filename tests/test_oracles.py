"""Registered queries against their SQL on the smallest data; ``compare.py`` runs all of them."""

import os
import re

import duckdb
import pytest

from parley.plans import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = [
    "read_batches", "clean_dump", "dump_stats", "ingest_messages", "upsert_users", "batch_ledger", "sync_dictionary",
    "dictionary_changed_ids", "propagate_names", "time_blocks", "closed_blocks", "scan_unprocessed", "resolve_replies",
    "attach_short", "build_discussions", "apply_clusters", "render_batch_prompts", "pack_batches", "map_segments",
    "partition_messages", "resolve_outcomes", "enrichment_view", "label_pairs", "nodes_entity", "edges_interested_in",
    "merge_graph", "graph_overview", "neighbors", "vector_topk", "anchor_hits", "expand", "diversify", "pack_context",
    "finalize_answers", "keyset_page", "retain", "totals", "size_histogram", "inference_stats", "closed_sessions",
    "subcluster", "similar_components", "similar_labels", "canonical_labels", "semantic_continuations", "edges_mentions_user",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLES[name]) in ("", "equal but empty")


def test_registry_is_whole():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", ["advance_checkpoints", "cluster_summary"])
def test_a_channel_without_closed_blocks(spark, tmp_path, name):
    """Events of one channel stand so dense that its only block is open; the query still equals its SQL."""
    for f in os.listdir(SF):
        if f != "events.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    duckdb.connect().execute(
        f"COPY (SELECT * REPLACE (CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-01-01' + to_seconds(event_id) ELSE ts END AS ts) "
        f"FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), name, QUERIES[name], ORACLES[name]) == ""
