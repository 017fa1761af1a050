"""Semantic continuations against all pairs; mentions of users, merged."""

import datetime as dt
import random

import numpy as np
import pytest

from parley.operators.continuation import edges_mentions_user, merge_mentions_user, semantic_continuations

T0 = dt.datetime(2024, 1, 1)
COLS = "id string, channel_id string, started_at timestamp, continuation_of_discussion_id string, embedding array<double>"


def discussions(seed, n=260):
    """A hot channel, equal times and vectors, rows without a vector, time, direction or channel, explicit links."""
    r, g = random.Random(seed), np.random.default_rng(seed)
    base = g.normal(size=(6, 5))
    rows = []
    for i in range(n):
        v = (base[r.randrange(6)] + 0.4 * g.normal(size=5)).tolist() if i % 9 else [1.0, 0.0, 0.0, 0.0, 0.0]
        rows.append((f"d{i:03d}", r.choice(["hot", "hot", "hot", "b", None]), None if i % 53 == 5 else T0 + dt.timedelta(hours=r.randrange(60) * 3),
                     f"d{r.randrange(n):03d}" if i % 2 else None, None if i % 41 == 7 else [0.0] * 5 if i % 43 == 1 else v))
    return rows


def slow(rows, theta, days, k):
    out = set()
    known = {i: (c, t, link, np.array(v) / np.linalg.norm(v)) for i, c, t, link, v in rows if t and v and any(v)}
    for a, (c, t, link, v) in known.items():
        found = []
        for b, (c2, t2, link2, v2) in known.items():
            s = float(np.round(v @ v2, 9))
            if c == c2 and (t2, b) < (t, a) and t2 >= t - dt.timedelta(days=days) and s >= theta and link != b and link2 != a:
                found.append((-s, -t2.timestamp(), b))
        out |= {(a, b, -s) for s, _, b in sorted(found)[:k]}
    return out


@pytest.mark.parametrize(("days", "k", "block"), [(2, 2, 4), (30, 3, 512), (1, 100, 7)])
def test_continuations_are_those_of_all_pairs(spark, days, k, block):
    rows = discussions(days)
    got = semantic_continuations(spark.createDataFrame(rows, COLS), 0.7, days, k, block).collect()
    assert len(got) == len({(g["src"], g["dst"]) for g in got})
    assert {(g["src"], g["dst"]): g["similarity_score"] for g in got} == pytest.approx({(a, b): s for a, b, s in slow(rows, 0.7, days, k)})


def test_nothing_to_continue(spark):
    assert semantic_continuations(spark.createDataFrame([], COLS)).count() == 0


def test_mentions_add_up(spark):
    cols = "author_id string, created_at timestamp, mentions array<string>"
    day = [T0 + dt.timedelta(days=i) for i in range(4)]
    old = spark.createDataFrame([("a", day[1], ["b", "b", "a", None]), ("a", day[2], ["b"]), ("b", day[1], None)], cols)
    new = spark.createDataFrame([("a", day[0], ["b", "c"]), ("c", day[3], ["a"])], cols)
    whole = edges_mentions_user(old.unionByName(new))
    merged = merge_mentions_user(edges_mentions_user(old), edges_mentions_user(new))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect())) == [
        ("a", "b", 3, day[0], day[2]), ("a", "c", 1, day[0], day[0]), ("c", "a", 1, day[3], day[3])]
