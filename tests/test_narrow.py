"""What wide texts do not pass: blocks and clusters, and copies of a reply per segment."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import parley.session as S
from parley.functions.vectors import hashing_embedder
from parley.operators import cluster as C
from parley.operators import enrich as E
from parley.sources.state import empty_state
from tests.test_enrich import answer_all, channel

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def kept(monkeypatch):
    """Columns of every table that is materialised, by what materialises it."""
    seen = []
    for module, name in ((C, "cut"), (S, "stored")):
        def watched(df, real=getattr(module, name), by=name):
            seen.append((by, df.columns))
            return real(df)

        monkeypatch.setattr(module, name, watched)
    return seen


def test_clustering_keeps_no_texts(spark, kept):
    st = empty_state(spark)
    st["messages"] = spark.createDataFrame(
        [(f"m{i:02d}", "c", None, "u0", "text " * 9, T0 + dt.timedelta(minutes=i * (1 if i < 6 else 9)), None, None, None, 0, 9, "b", T0, 0, None)
         for i in range(12)], st["messages"].schema)
    vectors = st["messages"].select("id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("vec"))
    out, _ = C.cluster_channels(st, vectors, "2024-02-01", gap_minutes=5, dim=2)
    assert out["messages"].filter("processed = 1 and content is not null").count() == 11
    assert kept and not any("content" in columns for _, columns in kept)


def test_a_reply_is_kept_once_and_reaches_every_segment(spark, kept):
    st, _ = E.enrich_channels(channel(spark, 30), answer_all, hashing_embedder(8), "2024-02-01")
    segments = [columns for by, columns in kept if by == "stored" and "kind" in columns]
    assert len(segments) == 1 and not {"raw", "raw_response", "_text"} & set(segments[0])
    rows = st["discussion_enrichment"].select("raw_response", "embedding").collect()
    assert len(rows) == 30 and all(len(json.loads(r["raw_response"])["segments"]) > 1 and len(r["embedding"]) == 8 for r in rows)


def test_words_are_hashed_once_per_text(monkeypatch):
    import xxhash

    seen, real = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda t: seen.append(t) or real(t))
    a, b = hashing_embedder(64)(["Big big small", "small big BIG"])
    assert a == b and sorted(seen) == ["big", "big", "small", "small"]
