"""Repair of conversations: least edits by a suffix-shared automaton of role and fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parley.llm.registry import query, table
from parley.operators.ordered import scan
from parley.session import cut

#: White space that makes no text, and marks that end one.
SPACE, ENDS = r"\x20\x09-\x0D", ".!?"
#: What an edit costs; an undeleted truncated row adds CUT.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Distinct rows of one conversation whose symbols are gathered at a time.
CHUNK = 8192
#: Grammar states of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. By state: the role that
#: must follow, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE, NEXT_STATE = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60


class Node(NamedTuple):
    """A suffix of signatures: by grammar state the least cost to go and the first edit of the ASCII-least way."""

    cost: tuple[int, ...]
    edit: str
    symbol: str = ""
    after: Node | None = None


def _node(cost: list[int], edit: list[str], symbol: str = "", after: Node | None = None) -> Node:
    """Adds the inserts, which stay at the node and move the state on. Two in a row never pay against the way without."""
    best, letter = list(cost), list(edit)
    best[USER], best[ASSISTANT] = (min(cost[s], INSERT + cost[NEXT_STATE[s]]) for s in (USER, ASSISTANT))
    best[START], best[SYSTEM] = (min(cost[s], INSERT + best[USER]) for s in (START, SYSTEM))
    for s in range(4):
        if best[s] < cost[s] or (best[s] == INSERT + best[NEXT_STATE[s]] and edit[s] > "I"):
            letter[s] = "I"
    return Node(tuple(best), "".join(letter), symbol, after)


#: The empty suffix: the grammar accepts before any row and after an assistant.
END = _node([0, NEVER, NEVER, 0], [" "] * 4)


def grown(symbol: str, after: Node) -> Node:
    """The node of ``symbol`` before the suffix ``after``.

    Symbols: x must go; s, u, a and o (any other role) are whole rows, S, U, A and O truncated ones.
    The edits of a state have different letters, so the least letter of least cost begins the ASCII-least way.
    """
    cost, edit = [], []
    for s in range(4):
        ways = [(DELETE + after.cost[s], "D")]
        if symbol != "x":
            more, role = CUT * symbol.isupper(), symbol.lower()
            ways.append((REROLE + more + after.cost[NEXT_STATE[s]], "R"))
            if s == START and role == "s":
                ways.append((more + after.cost[SYSTEM], "K"))
            elif role == NEXT_ROLE[s][0]:
                ways.append((more + after.cost[NEXT_STATE[s]], "K"))
        best = min(ways)
        cost.append(best[0])
        edit.append(best[1])
    return _node(cost, edit, symbol, after)


def moved(state: int, edit: str, initial: str) -> int:
    """The grammar state after an edit of a row of this initial."""
    if edit == "D":
        return state
    return SYSTEM if edit == "K" and state == START and initial == "s" else NEXT_STATE[state]


def edits(node: Node) -> str:
    """The cheapest edits of a whole signature, by following its nodes from the start."""
    out, state = [], START
    while node.after is not None or node.edit[state] == "I":
        out.append(node.edit[state])
        state = moved(state, out[-1], node.symbol.lower())
        if out[-1] != "I":
            node = node.after
    return "".join(out)


def solved(backward: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) for reversed signatures in sorted order.

    Sorted, the reversed signatures are a depth-first walk of the automaton that shares suffixes:
    a node is made once, when its suffix is first met, and only the path to it is held.
    """
    path, last = [END], ""
    for word in backward:
        shared = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        del path[shared + 1:]
        for symbol in word[shared:]:
            path.append(grown(symbol, path[-1]))
        last = word
        yield word[::-1], path[-1].cost[START], edits(path[-1])


def solve(signatures: DataFrame, column: str = "signature") -> DataFrame:
    """(signature, cost, audit) of every distinct signature; equal endings lie in one range of a sort."""
    backward = signatures.select(F.reverse(column).alias("w")).distinct().repartitionByRange("w").sortWithinPartitions("w")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in solved(w for b in batches for w in b.column(0).to_pylist()):
            rows.append(row)
            if len(rows) == 500:
                yield _batch(rows, ["signature", "cost", "audit"], [pa.string(), pa.int64(), pa.string()])
                rows = []
        yield _batch(rows, ["signature", "cost", "audit"], [pa.string(), pa.int64(), pa.string()])

    return backward.mapInArrow(walk, "signature string, cost long, audit string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    return turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with one fault planted in about a quarter of them, by crc32 of ``id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its ends of sentences out, 3 repeats it, 4 makes
    it the user's. Null ids and turns count as one space in the hash; null roles and texts become one.
    """
    rows = _turns(turns, id_col, turn_col, role_col, text_col)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.where(fault != 0).select(
        F.col("conv").alias(id_col), F.col("turn").alias(turn_col), F.when(fault == 4, "user").otherwise(F.col("role")).alias(role_col),
        text.alias(text_col), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def digest(column: str) -> Column:
    return F.unhex(F.sha2(column, 256))


def signatures(turns: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """One row per conversation: conv, signature (a symbol per row), gaps, blank, duplicate, truncated, illegal.

    Texts are hashed where they lie; narrow rows go on. Equal rows of one turn are counted before
    the first shuffle, and a row's first occurrence is a minimum with map-side combine. Order and
    neighbours come from range partitions with carried values, so a conversation of any share of
    the table is split; its symbols meet in chunks, as one letter per row. ``ids`` (conv) are
    conversations to return although they have no row.
    """
    tail = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    kind = F.when(tail == "", "b").when(F.substring(tail, -1, 1).isin(*ENDS), "w").otherwise("t")
    rows = (_turns(turns, id_col, turn_col, role_col, text_col)
            .select("conv", "turn", "role", digest("text").alias("digest"), kind.alias("kind"))
            .groupBy("conv", "turn", "role", "digest", "kind").agg(F.count("*").alias("c")))
    first = rows.groupBy(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(
        F.min(F.struct("turn")).alias("_first"))
    known = rows.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))).select(
        "conv", "turn", "role", "digest", "kind", "c", F.col("turn").eqNullSafe(F.col("_first.turn")).alias("new"))
    placed = scan(known, ["conv"], ["turn", "role", "digest"], sums={"pos": F.lit(1).cast("long")},
                  prev={"before": F.substring("role", 1, 1), "turn_before": F.col("turn")})
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when((F.col("kind") == "b") | ~F.col("new"), "x").when(F.col("kind") == "t", F.upper(role)).otherwise(role)
    more = F.col("c") - 1
    long = F.lit(0).cast("long")
    facts = placed.select(
        "conv", "pos", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"), F.concat(symbol, F.repeat(F.lit("x"), more.cast("int"))).alias("symbols"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")), 1).otherwise(long).alias("turns"),
        F.when(F.col("kind") == "b", F.col("c")).otherwise(long).alias("blank"),
        F.when(F.col("kind") == "b", long).when(F.col("new"), more).otherwise(F.col("c")).alias("duplicate"),
        F.when((F.col("kind") == "t") & F.col("new"), 1).otherwise(long).alias("truncated"),
        (more + F.when(F.concat("before", initial).isin("su", "ua", "au") | F.col("before").isNull(), 0).otherwise(1)).alias("illegal"))
    counts = ["turns", "blank", "duplicate", "truncated", "illegal"]
    chunks = facts.groupBy("conv", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbols"))), lambda x: x["symbols"]), "").alias("symbols"),
        F.min("turn").alias("lo"), F.max("turn").alias("hi"), *(F.sum(c).alias(c) for c in counts))
    if ids is not None:
        chunks = chunks.unionByName(ids.select("conv").distinct().select(
            "conv", F.lit(-1).cast("long").alias("chunk"), F.lit("").alias("symbols"), *(F.lit(None).cast("long").alias(c) for c in ("lo", "hi")),
            *(long.alias(c) for c in counts)))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "symbols"))), lambda x: x["symbols"]), "")
    return chunks.groupBy("conv").agg(
        whole.alias("signature"), F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("turns"), long).alias("gaps"),
        *(F.sum(c).alias(c) for c in counts[1:]))


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, position, edit, role, text) of repaired rows, and (conv, None, ...) at the end of a conversation.

    ``rows`` are (conv, audit, role, text), a conversation's audit before its rows in order.
    """
    for conv, group in groupby(rows, lambda r: r[0]):
        audit, at, state, n = next(group)[1] or "", 0, START, 0

        def inserted(conv=conv) -> Iterator[tuple]:
            nonlocal at, state, n
            while audit[at: at + 1] == "I":
                yield conv, n, "I", NEXT_ROLE[state], ""
                at, state, n = at + 1, NEXT_STATE[state], n + 1

        for _, _, role, text in group:
            yield from inserted()
            if audit[at] != "D":
                yield conv, n, audit[at], NEXT_ROLE[state] if audit[at] == "R" else role, text
                n += 1
            state, at = moved(state, audit[at], role[:1]), at + 1
        yield from inserted()
        yield conv, None, None, None, None


def _streamed(turns: DataFrame, plans: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, audit, role, text): conversations whole and in order inside partitions, each led by its audit."""
    rows = _turns(turns, id_col, turn_col, role_col, text_col).select(
        "conv", F.lit(1).alias("_row"), "turn", "role", digest("text").alias("_digest"), F.lit(None).cast("string").alias("audit"), "text")
    heads = plans.select("conv", F.lit(0).alias("_row"), "audit")
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "_row", "turn", "role", "_digest").select("conv", "audit", "role", "text")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def plan_repairs(turns: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """The ``signatures`` with the cost and the audit of their cheapest repair; each distinct signature is solved once."""
    found = cut(signatures(turns, ids, id_col, turn_col, role_col, text_col))
    ways = solve(found).withColumnRenamed("signature", "_s")
    return found.join(ways, F.col("signature") == F.col("_s")).drop("_s")


def repaired_turns(turns: DataFrame, plans: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv, position, edit, role, text): the rows of every repaired conversation."""
    kind, arrow = turns.schema[id_col].dataType.simpleString(), to_arrow_type(turns.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv", "position", "edit", "role", "text"], [arrow, pa.int64(), pa.string(), pa.string(), pa.string()]
        some: list[tuple] = []
        for row in _edited(_read(batches)):
            if row[1] is not None:
                some.append(row)
            if len(some) == 500:
                yield _batch(some, names, kinds)
                some = []
        yield _batch(some, names, kinds)

    return _streamed(turns, plans, id_col, turn_col, role_col, text_col).mapInArrow(
        run, f"conv {kind}, position long, edit string, role string, text string")


def repaired_digests(turns: DataFrame, plans: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text") -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` of the repaired rows, joined by line feeds.

    The hash of a whole conversation is sequential; texts stream past it, so a task holds one batch of them.
    """
    kind, arrow = turns.schema[id_col].dataType.simpleString(), to_arrow_type(turns.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, h = [], hashlib.sha256()
        for conv, position, _, role, text in _edited(_read(batches)):
            if position is not None:
                h.update(("\n" * (position > 0) + role + ":" + text).encode("utf-8", "replace"))
                continue
            done.append((conv, h.hexdigest()))
            h = hashlib.sha256()
            if len(done) == 500:
                yield _batch(done, ["conv", "repaired_sha256"], [arrow, pa.string()])
                done = []
        yield _batch(done, ["conv", "repaired_sha256"], [arrow, pa.string()])

    return _streamed(turns, plans, id_col, turn_col, role_col, text_col).mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair(turns: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation: its faults, the cost and audit of the cheapest repair, the hash of what is repaired.

    Rows are ordered by turn, nulls first, then role, then the SHA-256 of the text, so ties and
    repeated rows have one order. Null roles and texts count as one space: such a text is blank,
    such a role is another one than system, user or assistant. A null id is a conversation like
    any other. Other columns are ignored, whatever their names. No rows give no rows.
    """
    plans = cut(plan_repairs(turns, ids, id_col, turn_col, role_col, text_col))
    hashes = repaired_digests(turns, plans, id_col, turn_col, role_col, text_col).withColumnRenamed("conv", "_c")
    return plans.join(hashes, F.col("conv").eqNullSafe(F.col("_c"))).select(
        F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i))),
keyed AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM keyed, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hashed, range(2) c(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
ordered AS (SELECT *, row_number() OVER w AS p, lag(role[1]) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_replace(text, '[ 	-
]+$', '') AS tail, count(*) OVER (PARTITION BY conv_id) AS n
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
marked AS (SELECT *, tail = '' AS blank, tail <> '' AND again AS duplicate, tail <> '' AND NOT again AND NOT regexp_matches(tail, '[.!?]$') AS truncated,
    role[1] AS i, 1000000000::BIGINT AS never FROM ordered),
-- cost and audit to go and repaired text, by grammar state: 0 nothing yet, 1 after s, 2 after u, 3 after a
go AS (
  SELECT conv_id, max(n) + 1 AS p, 0::BIGINT AS c0, 10::BIGINT AS c1, 5::BIGINT AS c2, 0::BIGINT AS c3, '' AS a0, 'II' AS a1, 'I' AS a2, '' AS a3,
    '' AS r0, 'user:' || chr(10) || 'assistant:' || chr(10) AS r1, 'assistant:' || chr(10) AS r2, '' AS r3
  FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, s0.c, s1.c, s2.c, s3.c, s0.a, s1.a, s2.a, s3.a, s0.r, s1.r, s2.r, s3.r FROM (
    SELECT conv_id, p, s2, s3,
      least(b0, {'c': s2.c + 5, 'a': 'I' || s2.a, 'r': 'user:' || chr(10) || s2.r}) AS s0,
      least(b1, {'c': s2.c + 5, 'a': 'I' || s2.a, 'r': 'user:' || chr(10) || s2.r}) AS s1
    FROM (SELECT *, least(b2, {'c': b3.c + 5, 'a': 'I' || b3.a, 'r': 'assistant:' || chr(10) || b3.r}) AS s2,
                    least(b3, {'c': b2.c + 5, 'a': 'I' || b2.a, 'r': 'user:' || chr(10) || b2.r}) AS s3
      FROM (SELECT m.conv_id, m.p,
        least({'c': g.c0 + 2, 'a': 'D' || g.a0, 'r': g.r0},
          {'c': CASE WHEN must THEN never ELSE g.c2 + cut + 1 END, 'a': 'R' || g.a2, 'r': 'user:' || line || g.r2},
          {'c': CASE WHEN must OR i NOT IN ('s', 'u') THEN never WHEN i = 's' THEN g.c1 + cut ELSE g.c2 + cut END,
           'a': 'K' || CASE WHEN i = 's' THEN g.a1 ELSE g.a2 END, 'r': own || CASE WHEN i = 's' THEN g.r1 ELSE g.r2 END}) AS b0,
        least({'c': g.c1 + 2, 'a': 'D' || g.a1, 'r': g.r1},
          {'c': CASE WHEN must THEN never ELSE g.c2 + cut + 1 END, 'a': 'R' || g.a2, 'r': 'user:' || line || g.r2},
          {'c': CASE WHEN must OR i <> 'u' THEN never ELSE g.c2 + cut END, 'a': 'K' || g.a2, 'r': own || g.r2}) AS b1,
        least({'c': g.c2 + 2, 'a': 'D' || g.a2, 'r': g.r2},
          {'c': CASE WHEN must THEN never ELSE g.c3 + cut + 1 END, 'a': 'R' || g.a3, 'r': 'assistant:' || line || g.r3},
          {'c': CASE WHEN must OR i <> 'a' THEN never ELSE g.c3 + cut END, 'a': 'K' || g.a3, 'r': own || g.r3}) AS b2,
        least({'c': g.c3 + 2, 'a': 'D' || g.a3, 'r': g.r3},
          {'c': CASE WHEN must THEN never ELSE g.c2 + cut + 1 END, 'a': 'R' || g.a2, 'r': 'user:' || line || g.r2},
          {'c': CASE WHEN must OR i <> 'u' THEN never ELSE g.c2 + cut END, 'a': 'K' || g.a2, 'r': own || g.r2}) AS b3
      FROM go g JOIN (SELECT *, blank OR duplicate AS must, CASE WHEN truncated THEN 5 ELSE 0 END AS cut, text || chr(10) AS line,
                             role || ':' || text || chr(10) AS own FROM marked) m
        ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND m.p = g.p - 1)))),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(c0, 0) AS cost, coalesce(a0, '') AS audit,
  sha256(coalesce(CASE WHEN r0 = '' THEN '' ELSE left(r0, length(r0) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN go g ON g.conv_id IS NOT DISTINCT FROM o.conv_id AND g.p = 1
"""


@query("op12_chat_repair", SQL)
def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule and repaired."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damage(turns), turns.select(F.col("conv_id").alias("conv")))
