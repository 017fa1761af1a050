"""N-gram Jaccard self-join: prefix filters under several global token orders, intersected before verification."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import in_bitmap, key_bitmap, stored, text_of, without
from parley.llm.components import components
from parley.llm.registry import query, table
from parley.session import cut

#: Multipliers of the hash orders (fixed odd numbers; any would do).
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Frequent shingles that are moved to the end of every order: how many at most, in how many
#: documents of the sample at least, and one document in how many is sampled. They only choose
#: the order; results are the same for any.
FREQUENT, SEEN, SAMPLE = 1 << 18, 3, 16
#: 64-bit words of the parity sketch.
SKETCH = 16
#: So many times every node of a token meets one hub before all that are left meet each other.
HUBS = 2
BITS = 1 << 25


class Rule(NamedTuple):
    """Shingles of ``words`` words; linked when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        """So many first tokens of a set of n meet those of any set it links with."""
        return n - -(-self.percent * n // 100) + 1


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = h * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, none without words.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    """
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    out = h[:n]
    for k in range(1, words):
        out = _mixed(out, ORDERS[k % 3]) + h[k: k + n]
    return np.unique(_mixed(out, ORDERS[0]))


def node_of(s: np.ndarray) -> int:
    """A set's own id; rows of equal sets share it."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of how many members fall on each bit: two sketches differ in at most |A xor B| bits."""
    odd = np.bincount((_mixed(s, ORDERS[2]) >> np.uint64(40)) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def frequent_shingles(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, sorted, with a rank by frequency (1..255)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, rule.words) for t in b.column(0).to_pylist()]
            token, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    part = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(31)), F.lit(SAMPLE)) == 0).select(text_of(text_col).alias("t"))
    top = (part.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
           .orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas())
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    rank = np.minimum(255, 1 + 8 * np.log2(np.maximum(1, top["n"].to_numpy(np.float64)))).astype(np.uint64)
    order = np.argsort(token)
    return token[order], rank[order]


def profiles(docs: DataFrame, rule: Rule, id_col: str, text_col: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """One narrow row per document: id, node (hash of its set), n, a prefix per order, sketch, and the ``carry`` expressions."""
    more = {f"c_{n}": c for n, c in (carry or {}).items()}
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, rule, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = frequent.value
        for b in batches:
            out: list[tuple] = []
            for text in b.column(1).to_pylist():
                s = shingles(text, rule.words)
                p = rule.prefix(len(s)) if len(s) else 0
                late = np.zeros(len(s), np.uint64)
                if len(tokens) and p:
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    late = np.where(tokens[at] == s, ranks[at], np.uint64(0)) << np.uint64(56)
                first = [s[np.argpartition(late | (_mixed(s, m) >> np.uint64(8)), p - 1)[:p]] if p else s for m in ORDERS]
                out.append((node_of(s), len(s), first[0].view(np.int64), *(f.astype(np.uint32).view(np.int32) for f in first[1:]), sketch(s)))
            node, n, *arrays = zip(*out, strict=True) if out else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(arrays[0], pa.list_(pa.int64())),
                 *(pa.array(x, pa.list_(pa.int32())) for x in arrays[1:3]), pa.array(arrays[3], pa.list_(pa.int64())), *b.columns[2:]],
                ["id", "node", "n", "p1", "p2", "p3", "sketch", *names])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *(c.alias(n) for n, c in more.items()))
    names, kinds = list(more), "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"id {kind}, node long, n long, p1 array<long>, p2 array<int>, p3 array<int>, sketch array<long>{kinds}")


def sized(a: Column, b: Column, rule: Rule) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * rule.percent)


def furthest(rule: Rule) -> Column:
    """In so many members the sets of a linked pair differ at most, and one for rounding.

    100 i >= percent (total - i), and they differ in total - 2 i.
    """
    total = F.col("n_a") + F.col("n_b")
    return total - 2 * F.ceil(total * rule.percent / (100 + rule.percent)) + 1


def _of_pairs(pairs: DataFrame, rows: DataFrame, *names: str) -> DataFrame:
    """``pairs`` with columns of both nodes, as <name>_a and <name>_b; only rows of nodes in pairs are shuffled."""
    ends = pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key")))
    side = in_bitmap(rows.select("node", *names), "node", key_bitmap(ends, "_key", BITS), BITS).where("_hit").drop("_hit")
    side = side.dropDuplicates(["node"])
    a, b = (side.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in names)) for end in "ab")
    return pairs.join(a, "a").join(b, "b")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, rule: Rule, id_col: str, text_col: str, sketched: bool = False) -> DataFrame:
    """The linked ones of candidate ``pairs`` (a, b, n_a, n_b) from the first order.

    Sketches of a linked pair differ in few bits (``sketched``: that was seen to). What they let
    through must also share prefix tokens under the other orders. What is left is compared in
    full: texts of the nodes concerned are read again and their sets met.
    """
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    close = pairs if sketched else cut(_of_pairs(pairs, rows, "sketch").where(apart <= furthest(rule)).select("a", "b"))
    near = cut(_of_pairs(close, rows, "p2", "p3").where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b"))
    ends = near.select(F.col("a").alias("_key")).unionByName(near.select(F.col("b").alias("_key")))
    concerned = in_bitmap(rows.select("node", "id"), "node", key_bitmap(ends, "_key", BITS), BITS).where("_hit").groupBy("node").agg(
        F.min("id").alias("id"))
    bitmap = key_bitmap(concerned.select(F.xxhash64("id").alias("_key")), "_key", BITS)
    texts = in_bitmap(docs.select(F.xxhash64(F.col(id_col)).alias("_key"), text_of(text_col).alias("_text")), "_key", bitmap, BITS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [shingles(t, rule.words) for t in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "s"])

    sets = texts.where("_hit").select("_text").mapInArrow(read, "node long, s binary").dropDuplicates(["node"])
    met = (near.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
           .join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for sa, sb in zip(x.column(2), x.column(3), strict=True):
                sa, sb = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * common >= rule.percent * (len(sa) + len(sb) - common))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(meet, "a long, b long")


def _labelled(index: DataFrame, found: DataFrame | None) -> DataFrame:
    """``index`` with the component of each node, so far: its own where nothing is ``found``."""
    if found is None:
        return index.withColumn("label", F.col("node"))
    return index.join(found, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text",
                    key: Column | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links).

    With ``key``, an expression that tells rows of one id apart, also key, group_size (rows of the
    component) and kept: whether id and key are the smallest of the component.

    1. Every text becomes a set of shingle hashes. Rows of equal sets are one node, so groups of
       copies are aggregated before anything is joined.
    2. A node is indexed under the prefix of its set in the first order. Tokens of one node alone
       are left out by counting. Orders put shingles that are frequent in a sample last, the rest
       by a hash of their own per order.
    3. First every node of a token meets the token's hub alone, a number of pairs linear in the
       index; the hub, which has met all, leaves the token. This is done again with new hubs over
       tokens that still hold several components. Then all nodes of different components that are
       left under a token meet, where their whole sketches are close enough. A link inside a
       component cannot change it, so none is missed.
    4. Candidates must pass the sketches and share prefix tokens under every other order too; then
       whole sets decide.

    Nulls: a null text has no words. Without words a row has an empty set, is linked with nothing
    and is its own component, also when its id is null. Rows that repeat an id are documents of
    their own; equal sets always share a component. Other columns are ignored, whatever their
    names. Shingles and sets are known by 64-bit hashes. No rows give no rows.
    """
    rows = stored(profiles(docs, rule, id_col, text_col, {} if key is None else {"key": key}))
    full = rows.where("n > 0")
    index = full.select(F.explode("p1").alias("token"), "node", "n")
    shared = index.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("token")
    index = stored(in_bitmap(index, "token", key_bitmap(shared, "token", BITS), BITS).where("_hit").drop("_hit").distinct())

    open_, found = index, None
    for turn in range(HUBS):
        labelled = _labelled(open_, found)
        hubs = labelled.groupBy("token").agg(
            F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"))).alias("m"),
            F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token", "m.*", "c")
        met = labelled.join(hubs, "token").where("node != hub")
        swap = F.col("node") > F.col("hub")
        pairs = stored(met.where((F.col("label") != F.col("hub_label")) & sized(F.col("n"), F.col("hub_n"), rule)).select(
            F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"),
            F.when(swap, F.col("hub_n")).otherwise(F.col("n")).alias("n_a"),
            F.when(swap, F.col("n")).otherwise(F.col("hub_n")).alias("n_b")).distinct())
        links = cut(verified(pairs, full, docs, rule, id_col, text_col))
        # a hub has met all it could link with, so it leaves the token
        open_ = stored(met.where("c > 2").select("token", "node", "n"))
        if turn and links.isEmpty():
            break
        found = components(links, found)

    labelled = _labelled(open_, found)
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token")
    open_ = stored(labelled.join(mixed, "token", "left_semi"))
    words = [f"w{i}" for i in range(SKETCH)]
    side = in_bitmap(full.select("node", *(F.col("sketch")[i].alias(c) for i, c in enumerate(words))), "node", key_bitmap(
        open_.select("node"), "node", BITS), BITS).where("_hit").drop("_hit").dropDuplicates(["node"])
    open_ = open_.join(side, "node")
    x, y = (open_.select("token", F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("label").alias(f"l_{end}"),
                         *(F.col(c).alias(f"{c}_{end}") for c in words)) for end in "ab")
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in words), F.lit(0))
    rest = x.join(y, (x["token"] == y["token"]) & (F.col("a") < F.col("b")) & (F.col("l_a") != F.col("l_b"))
                  & sized(F.col("n_a"), F.col("n_b"), rule) & (apart <= furthest(rule))).select("a", "b").distinct()
    found = components(cut(verified(stored(rest), full, docs, rule, id_col, text_col, sketched=True)), found)

    label = F.coalesce("label", "node").alias("label")
    if key is None:
        own = full.groupBy("node").agg(F.min("id").alias("doc")).join(found, "node", "left").select("node", "doc", label)
        smallest = own.groupBy("label").agg(F.min("doc").alias("component_id"))
        of_node = own.join(smallest, "label").select("node", "component_id")
        linked = full.select("id", "n", "node").join(of_node, "node").select("id", "n", "component_id")
        empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
        return linked.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    # a null id comes last, so that the smallest id is that of component_id above
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("i"), F.col("c_key").alias("k"))
    own = full.groupBy("node").agg(F.min(first).alias("best"), F.count("*").alias("size")).join(found, "node", "left").select(
        "node", "best", "size", label)
    smallest = own.groupBy("label").agg(F.min("best").alias("best"), F.sum("size").alias("group_size"))
    of_node = own.select("node", "label").join(smallest, "label").select("node", "best", "group_size")
    linked = full.select("id", "n", "node", "c_key").join(of_node, "node").select(
        "id", "n", F.col("best.i").alias("component_id"), "c_key", "group_size",
        (F.col("id").eqNullSafe(F.col("best.i")) & F.col("c_key").eqNullSafe(F.col("best.k"))).alias("kept"))
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "c_key",
                                       F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return linked.unionByName(empty).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("c_key").alias("key"), "group_size", "kept")


def drop_near_copies(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """One document of every component, that of the smallest id, with all its columns.

    Rows are told apart by id and text, so a row goes or stays by its own text, whatever other
    rows have its id. A null id comes after all others. Of rows that repeat both id and text of
    the one that stays, all stay, and with ``once`` one.
    """
    keys = {"id": F.col(id_col), "key": F.xxhash64(text_of(text_col))}
    decided = cut(near_duplicates(docs, rule, id_col, text_col, keys["key"]).where("group_size > 1").select(
        F.col(id_col).alias("id"), "key", "kept"))
    repeated = decided.where("kept").groupBy("id", "key").count().where("count > 1") if once else None
    return without(docs, keys, decided.where("not kept"), repeated)


SQL = r"""
WITH RECURSIVE w AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
 SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
 SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
 JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM w JOIN reach r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""


@query("op4_jaccard_join", SQL)
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies of all documents: three-word shingles, a Jaccard similarity of 0.9 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), Rule(3, 90))
