"""Exact and near duplicates against brute force."""

import random

from parley.llm.components import components
from parley.llm.exact_dedup import drop_copies, exact_dedup
from parley.llm.jaccard_join import Rule, drop_near_copies, near_duplicates, shingles, sketch


def sets_of(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, rule):
    sets = {i: sets_of(t, rule.words) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= rule.percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, copies=12, groups=14):
    """Chains of edits, copies of copies, a passage and a line that many share, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice((3, 8, 40, 120, 300)))]
        if r.random() < 0.6:
            base += passage
        for _ in range(r.randint(1, copies)):
            texts.append(" ".join(base))
            for _ in range(r.randint(0, 1 + len(base) // 60)):
                base[r.randrange(len(base))] = word()
    texts += ["", None, "one", "one two", "ONE  two", "the same line", "the same line"]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_equal_brute_force(spark):
    for seed, rule in ((1, Rule(3, 90)), (2, Rule(5, 80)), (3, Rule(3, 90))):
        rows = corpus(seed)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, rule)


def test_large_groups_of_near_copies(spark):
    rows = corpus(4, copies=150, groups=4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, Rule(3, 90))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, Rule(3, 90)).collect()} == want
    assert {r.doc_id for r in drop_near_copies(docs, Rule(3, 90)).collect()} == {c for _, c in want.values()}


def test_sketches_bound_the_difference():
    a, b = shingles(" ".join(map(str, range(500))), 3), shingles(" ".join(map(str, range(30, 540))), 3)
    apart = sum(int(x).bit_count() for x in (sketch(a) ^ sketch(b)).view("uint64"))
    assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_exact_dedup(spark):
    rows = [(5, "a b"), (3, "a  b"), (2, "ab"), (9, "a\tb "), (1, "x" * 70 + "1"), (4, "x" * 70 + "2"), (6, None), (7, " "), (8, "A B")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), filter_bits=1 << 16).collect()}
    assert got == {5: (3, 4, False), 3: (3, 4, True), 2: (3, 4, False), 9: (3, 4, False), 1: (1, 1, True), 4: (4, 1, True),
                   6: (7, 2, False), 7: (7, 2, True), 8: (8, 1, True)}


def test_components_do_not_depend_on_the_frequent_shingles(spark, monkeypatch):
    """The sample chooses an order of shingles alone: without it the components are the same."""
    import numpy as np

    from parley.llm import jaccard_join as J

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[k % 5:40 + k % 5] + ["the same words at the end"] * (k % 3)) + f" x{k % 4}") for k in range(60)], "doc_id long, text string")
    rule = J.Rule(3, 80)

    def found():
        return sorted(map(tuple, J.near_duplicates(docs, rule).collect()))

    usual = found()
    monkeypatch.setattr(J, "frequent_shingles", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    assert found() == usual and len({r[2] for r in usual}) < 60


def test_rows_that_are_no_copies_are_not_hashed_again(spark):
    """Rows pass by id and length; a row of a copy's id and length stays by its own text."""
    rows = [(1, "a b  c"), (2, "a b c"), (2, "x y z"), (2, "x y z"), (3, "abc"), (3, "zzz"), (4, "y  z"), (None, "a b c"), (None, "q r s"), (5, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = drop_copies(docs)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "a b  c"), (2, "x y z"), (3, "zzz"), (4, "y  z"), (None, "q r s"), (6, " ")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan()
    passed, looked_at = (plan.children().apply(i).toString() for i in range(2))
    assert "regexp_replace" not in passed and "sha2" not in passed
    assert looked_at.index("regexp_replace") < looked_at.index("Filter")  # above the filter: of its rows alone
