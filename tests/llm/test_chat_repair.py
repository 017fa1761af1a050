"""Repair of conversations against enumeration of all edits, and edge rows."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from parley.llm.chat_repair import damage, plan_repairs, repair, repaired_turns, solved

GRAMMAR = re.compile(r"(s?(ua)+)?")


def best_by_force(signature):
    """Least cost and ASCII-least audit over all edits, the grammar asked of whole role strings."""
    ways = []

    def go(at, roles, audit, cost, inserts):
        if cost > 5 * len(signature) + 10:
            return
        if at == len(signature):
            if GRAMMAR.fullmatch(roles):
                ways.append((cost, audit))
        else:
            x = signature[at]
            go(at + 1, roles, audit + "D", cost + 2, inserts)
            if x != "x":
                more = 5 * x.isupper()
                go(at + 1, roles + x.lower(), audit + "K", cost + more, inserts)
                for r in "ua":
                    go(at + 1, roles + r, audit + "R", cost + 1 + more, inserts)
        if inserts:
            for r in "ua":
                go(at, roles + r, audit + "I", cost + 5, inserts - 1)

    go(0, "", "", 0, 2)
    return min(ways)


def test_least_edits_are_those_of_enumeration():
    r = random.Random(11)
    words = {"", "s", "u", "a", "x", "o"} | {"".join(r.choice("sssuuuaaaoSUAOx") for _ in range(r.randrange(1, 6))) for _ in range(220)}
    got = {w: (cost, audit) for w, cost, audit in solved(iter(sorted(w[::-1] for w in words)))}
    assert got == {w: best_by_force(w) for w in words}


def reference(turns):
    """The contract, row by row in plain Python; turns as (turn, role, text) in order."""
    seen, rows = set(), []
    for turn, role, text in turns:
        tail = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((turn, role, text, fault))

    def allowed(state, new):
        return (state, new) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    # inserts, one relaxation at a time until nothing gets better
    best = {}

    def value(at, s):
        return best.get((at, s), (10**9, "", ()))

    for at in range(len(rows), -1, -1):
        for _ in range(4):
            for s in ("", "s", "u", "a"):
                ways = [(0, "", ())] if at == len(rows) and s in ("", "a") else []
                if at < len(rows):
                    _, role, text, fault = rows[at]
                    c, a, t = value(at + 1, s)
                    ways.append((c + 2, "D" + a, t))
                    if fault not in ("blank", "duplicate"):
                        for new, edit, price in [(role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)]:
                            if allowed(s, new[:1]):
                                c, a, t = value(at + 1, new[:1])
                                ways.append((c + price + 5 * (fault == "truncated"), edit + a, (f"{new}:{text}", *t)))
                for new in ("user", "assistant"):
                    if allowed(s, new[0]):
                        c, a, t = value(at, new[0])
                        ways.append((c + 5, "I" + a, (f"{new}:", *t)))
                best[at, s] = min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())
    cost, audit, repaired = best[0, ""]
    numbers = [t for t, *_ in rows if t is not None]
    pairs = zip(rows, rows[1:], strict=False)
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")),
            sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in pairs),
            cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def damaged(rows):
    """The fault rule in plain Python: (conv, turn, role, text) -> rows by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        mine = out.setdefault(conv, [])
        if f:
            mine += [(turn, "user" if f == 4 else role, text)] * (1 + (f == 3))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {conv: sorted(mine, key=key) for conv, mine in out.items()}


def test_query_of_random_and_edge_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, odd and empty roles, long texts, gaps, clashing columns."""
    r = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None]
    said = ["Yes.", "No", "", " \n", "Why?  ", None, "So, it ends! ", "x" * 50_000 + "."]
    rows = [(r.choice([None, *range(60)]), r.choice([None, 0, 1, 2, 3, 4, 5, 9]), r.choices(roles, [6, 6, 2, 1, 1, 1])[0], r.choice(said)) for _ in range(420)]
    rows += [(77, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)] + [(78, 0, "user", "Same.")] * 5
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("conv", F.lit("c")).withColumn("pos", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("audit", F.lit("A"))
    got = {g[0]: tuple(g[1:]) for g in repair(damage(frame), frame.select(F.col("conv_id").alias("conv"))).collect()}
    assert got == {conv: reference(mine) for conv, mine in damaged(rows).items()}


def test_chunks_and_ranges_do_not_show(spark, monkeypatch):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "A."), ("assistant", "B"), ("user", "A."), ("assistant", "C.")] * 12)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = repair(frame).collect()
    monkeypatch.setattr("parley.llm.chat_repair.CHUNK", 5)
    assert repair(frame).collect() == whole


def test_repaired_rows(spark):
    frame = spark.createDataFrame([("a", 1, "assistant", "Hi."), ("a", 2, "user", "Oh."), ("a", 3, "assistant", "Ah."), ("b", 1, "user", "")],
                                  "conv_id string, turn int, role string, text string")
    plans = plan_repairs(frame)
    assert {r["conv"]: (r["cost"], r["audit"]) for r in plans.collect()} == {"a": (2, "DKK"), "b": (2, "D")}
    got = repaired_turns(frame, plans).orderBy("conv", "position").collect()
    assert [tuple(g) for g in got] == [("a", 0, "K", "user", "Oh."), ("a", 1, "K", "assistant", "Ah.")]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damage(frame), frame.select(F.col("conv_id").alias("conv"))).count() == 0
