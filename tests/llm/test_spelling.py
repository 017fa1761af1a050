"""Spelling variants against brute force over all pairs, with filters in one pass and in many, and edge rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.llm import spelling
from parley.llm.spelling import near_words, plan_passes, spelling_groups


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def reference(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n}


def documents(seed=7, size=260):
    """Words around a few stems, in counts that rise along chains, with null, empty and very long texts."""
    r = random.Random(seed)
    stems = ["élection", "strasse", "aabbccdd", "zzzzzzz", "naïveté", "q" * 64, "q" * 65, "q" * 66, "r" * 64 + "ÿ" * 3, "Ärztin×÷"]
    words = []
    for s in stems:
        for count in (700, 120, 21, 5, 5):
            words += [s] * count
            i = r.randrange(len(s))
            s = r.choice([s[:i] + s[i + 1:], s[:i] + r.choice("aeqzéÿ") + s[i + 1:], s[:i] + r.choice("aqéÿ") + s[i:]])
    r.shuffle(words)
    texts = [" ".join(r.choice([w, w.upper() if w.isascii() else w]) for w in words[i: i + 40]) for i in range(0, len(words), 40)]
    return [(i % size, t) for i, t in enumerate(texts)] + [(None, "strasse, Strasse-STRASSE"), (None, None), (3, ""), (4, "1strasse2"), (5, "y" * 30_000)] + [
        (6, "w" * 9000 + " " + "w" * 9001)] * 6


@pytest.mark.parametrize("limit", [spelling.PASS_BYTES, 64])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, limit):
    """Also with filters so small that every length needs several passes and parts."""
    monkeypatch.setattr("parley.llm.spelling.plan_passes", lambda counts: plan_passes(counts, limit))
    rows = documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    want = reference(rows)
    assert {tuple(g) for g in spelling_groups(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert any(w[1] and w[2] != w[1] for w in want)  # some chain has two steps


def test_near_words_of_a_dense_vocabulary(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randrange(6, 9))) for _ in range(700)})
    frame = spark.createDataFrame([(w, 5 + len(w)) for w in words], "word string, n long")
    got = [(g["word"], g["near"]) for g in near_words(frame).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_tasks_pass_counts_on(spark, monkeypatch):
    rows = documents(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("parley.llm.spelling.COUNTED", 3)
    assert {tuple(g)[:1] for g in spelling_groups(frame).collect()} == {w[:1] for w in reference(rows)}


def test_passes_are_bounded():
    for limit in (32, 64, 1000, 1 << 20):
        passes = plan_passes({6: 1, 7: 50_000, 8: 300, 65: 9}, limit)
        assert all(sum(s.blocks for s in shards) * 32 <= max(limit, 32) for shards in passes)
        parts = Counter((s.length, s.parts) for shards in passes for s in shards)
        assert {length: count for (length, _), count in parts.items()} == {length: parts for length, parts in parts}


def test_nothing_frequent(spark):
    frame = spark.createDataFrame([(1, "once upon"), (2, None)], "doc_id long, text string")
    assert spelling_groups(frame).count() == 0
    assert spelling_groups(frame.limit(0)).count() == 0
