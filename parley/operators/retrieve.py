"""Retrieval and ranking of discussions for a whole table of questions.

Questions carry question_id, question, vec, topics, entities, intent,
preferred_types and the hard filters channel_ids, discussion_types, since (null:
any). Variants carry question_id, variant_no and vec.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.scores import VIA_WEIGHTS, recency, via_weight
from parley.functions.text import trim_ws
from parley.functions.vectors import length, scaled_dot
from parley.operators.ingest import as_ts
from parley.schemas import DEFAULTS
from parley.session import cut, stored

FILTERS = ["channel_ids", "discussion_types", "since"]
#: similarities and scores that differ by less than this are ties, broken by id
DIGITS = 9


def _newest() -> list[Column]:
    return [F.col("started_at").desc_nulls_last(), F.col("id")]


def query_variants(plans: DataFrame, cap: int = DEFAULTS["search_query_variants"]) -> DataFrame:
    """Question first, then its rephrasings: trimmed, distinct ignoring case, cap + 1 at most.

    Returns question_id, variant_no, variant.
    """
    texts = F.concat(F.array("question"), F.coalesce("search_queries", F.expr("cast(array() as array<string>)")))
    rows = plans.select("question_id", F.posexplode(texts).alias("pos", "raw")).withColumn(
        "variant", trim_ws(F.col("raw"))).filter("variant <> ''")
    # the lists come from one question, so a window holds a handful of rows
    seen = Window.partitionBy("question_id", F.lower("variant")).orderBy("pos")
    first = rows.withColumn("_d", F.row_number().over(seen)).filter("_d = 1")
    no = F.row_number().over(Window.partitionBy("question_id").orderBy("pos"))
    return first.withColumn("variant_no", no).filter(F.col("variant_no") <= cap + 1).select(
        "question_id", "variant_no", "variant")


def passes(channel: Column, kind: Column, started: Column) -> Column:
    """The hard filters of a question against a discussion's columns."""
    def member(allowed: str, value: Column) -> Column:
        return F.col(allowed).isNull() | F.coalesce(F.array_contains(allowed, value), F.lit(False))

    since = F.col("since").isNull() | F.coalesce(started >= F.col("since"), F.lit(False))
    return member("channel_ids", channel) & member("discussion_types", kind) & since


def hard_filter(pairs: DataFrame) -> DataFrame:
    """Rows of (question, discussion) that the question's own filters let through."""
    return pairs.filter(passes(F.col("channel_id"), F.col("discussion_type"), F.col("started_at")))


def spread_keys(spark, n: int) -> list[int]:
    """``n`` whole numbers that ``repartition(n, column)`` deals to as many partitions, one each."""
    wide = max(1, n)
    while True:
        wide *= 16
        found = spark.range(wide).select(F.col("id").cast("int").alias("key")).groupBy(
            F.pmod(F.hash("key"), F.lit(n)).alias("at")).agg(F.min("key").alias("key")).collect()
        if len(found) == n:
            return sorted(r["key"] for r in found)


def admitted_pairs(questions: DataFrame, nodes: DataFrame, on: str | None = None, most: int = 50_000_000) -> DataFrame:
    """All pairs of question and discussion that pass the question's filters: question_id, id.

    With ``on`` those of them that agree in that column. Pairs grow with the square of the input, so they
    are dealt to tasks by count, not by size: questions and discussions are cut by hashes of their ids, and
    every cut of questions meets every cut of discussions, until two cuts have ``most`` pairs at most.
    """
    spark, key = questions.sparkSession, on or "_all"
    q, d = questions.select("question_id", *([on] if on else []), *FILTERS), nodes.select(
        "id", "channel_id", "discussion_type", "started_at", *([on] if on and on not in ("channel_id", "discussion_type") else []))
    if on is None:
        q, d = q.withColumn(key, F.lit(0)), d.withColumn(key, F.lit(0))
    # a filter on the joined column itself is decided before anything is sent
    elif on in ("channel_id", "discussion_type"):
        allowed = f"{on}s"
        q = q.filter(F.col(allowed).isNull() | F.coalesce(F.array_contains(allowed, F.col(on)), F.lit(False)))
    counts = q.groupBy(key).agg(F.count("*").alias("_q")).join(d.groupBy(key).agg(F.count("*").alias("_d")), key)
    largest, total, asked, met = counts.agg(
        F.max(F.col("_q") * F.col("_d")), F.sum(F.col("_q") * F.col("_d")), F.max("_q"), F.max("_d")).first()
    parts, tasks = max(1, -(-(largest or 0) // most)), max(1, -(-(total or 0) // most))
    tasks = max(tasks, spark.sparkContext.defaultParallelism)
    parts = max(parts, -(-(largest or 0) * tasks // max(1, total or 0)))
    # a question is sent to every cut of discussions, and a discussion to every cut of questions
    rows = min(parts, max(1, round((parts * (asked or 1) / (met or 1)) ** 0.5)))
    cols = -(-parts // rows)
    block = F.col("_row") * cols + F.col("_col")
    if on is None:
        tasks = rows * cols
        block = F.element_at(F.array(*[F.lit(x) for x in spread_keys(spark, tasks)]), block + 1)

    def dealt(df: DataFrame, own: str, name: str, n: int, other: str, m: int) -> DataFrame:
        cut_of = df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(n)).cast("int"))
        each = cut_of.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return each.withColumn("_block", block).drop("_row", "_col").repartition(tasks, *([on] if on else []), "_block")

    sent, there = dealt(q, "_row", "question_id", rows, "_col", cols), dealt(d, "_col", "id", cols, "_row", rows)
    return hard_filter(sent.join(there, [key, "_block"])).select("question_id", "id")


def _unit_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _lists(col: pa.Array) -> list:
    return [None if v is None else tuple(v) for v in col.to_pylist()]


class _Best:
    """The k best discussions so far of a block's variants of one dimension and one filter."""

    def __init__(self, rows: pa.Table, dim: int, k: int):
        first = rows.slice(0, 1).to_pylist()[0]
        self.channels, self.kinds, self.since = first["channel_ids"], first["discussion_types"], first["since"]
        self.rows, self.k = rows.select(["question_id", "variant_no"]), k
        self.vec = _unit_rows(rows["vec"].combine_chunks(), dim)
        self.rough = self.vec.astype(np.float32)
        self.sim = np.full((len(rows), k), -np.inf)
        self.id = np.full((len(rows), k), None, dtype=object)
        # a product of two unit vectors in single precision is off by less
        self.slack = SLACK + (dim + 8) * 2.0**-23

    def meet(self, vec: np.ndarray, rough: np.ndarray, ids: np.ndarray, batch: pa.Table) -> None:
        """Fold in discussions that follow, in the order of ids, all that were met before.

        ``rough`` is ``vec`` in single precision: it tells which pairs may be among the best, and those
        alone are compared in double precision.
        """
        ok = np.ones(len(ids), dtype=bool)
        for allowed, name in ((self.channels, "channel_id"), (self.kinds, "discussion_type")):
            if allowed is not None:
                known = pa.array([v for v in allowed if v is not None], pa.string())
                ok &= pc.is_in(batch[name].combine_chunks(), known).to_numpy(zero_copy_only=False)
        if self.since is not None:
            ok &= pc.fill_null(pc.greater_equal(batch["started"], self.since), False).to_numpy()
        if not ok.all():
            vec, rough, ids = vec[ok], rough[ok], ids[ok]
        if not len(ids):
            return
        for lo in range(0, len(self.vec), TILE):
            floor = self.sim[lo:lo + TILE, -1]
            if np.isfinite(floor).all():
                a, b = self._near(lo, floor, rough)
                raw = np.einsum("ij,ij->i", self.vec[lo + a], vec[b])
            else:
                whole = self.vec[lo:lo + TILE] @ vec.T
                least = floor - SLACK
                if len(ids) > self.k:
                    # a row that is not full takes no more than the k best; equal ones are cut after the sort
                    least = np.maximum(least, -np.partition(-whole, self.k - 1, axis=1)[:, self.k - 1] - SLACK)
                a, b = np.nonzero(whole >= least[:, None])
                raw = whole[a, b]
            sim = np.round(raw, DIGITS)
            better = sim > floor[a]  # an equal one has a larger id
            a, b, sim = a[better], b[better], sim[better]
            if not len(a):
                continue
            old = np.unique(a)
            row = np.concatenate([np.repeat(old, self.k), a])
            value = np.concatenate([self.sim[lo + old].ravel(), sim])
            name = np.concatenate([self.id[lo + old].ravel(), ids[b]])
            order = np.lexsort((-value, row))  # stable, so ties stay in the order of ids
            row, value, name = row[order], value[order], name[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = rank < self.k
            self.sim[lo + row[kept], rank[kept]] = value[kept]
            self.id[lo + row[kept], rank[kept]] = name[kept]

    def _near(self, lo: int, floor: np.ndarray, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a tile's variants and discussions that may reach the variant's floor, in the order of ids."""
        mine = self.rough[lo:lo + TILE]
        least = (floor - self.slack).astype(np.float32)[:, None]
        rows, cols = [], []
        for at in range(0, len(rough), STRIP):
            hit = mine @ rough[at:at + STRIP].T >= least
            if pad := -hit.shape[1] % 8:
                hit = np.pad(hit, ((0, 0), (0, pad)))
            # eight pairs are looked at together, as most have no hit
            words = np.flatnonzero(hit.reshape(-1).view(np.uint64))
            flat = (words[:, None] * 8 + np.arange(8)).ravel()
            flat = flat[hit.reshape(-1)[flat]]
            rows.append(flat // hit.shape[1])
            cols.append(flat % hit.shape[1] + at)
        return np.concatenate(rows), np.concatenate(cols)

    def found(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.vec), TILE):
            sim = self.sim[lo:lo + TILE]
            a, b = np.nonzero(sim > -np.inf)
            of = self.rows.slice(lo, TILE).take(pa.array(a)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() for c in of.columns), pa.array(self.id[lo:lo + TILE][a, b], pa.string()),
                 pa.array(sim[a, b], pa.float64()), pa.array((b + 1).astype(np.int32))], names)


#: Variants that are compared with a batch of discussions at a time.
TILE = 512
#: Discussions that are compared with a tile at a time: the products stay in the processor's cache.
STRIP = 2048
#: More than rounding to DIGITS moves a similarity.
SLACK = 2 * 10.0**-DIGITS


def _block_topk(k: int):
    """Task kernel: each block's variants first, then a stream of all discussions, in the order of ids."""
    names = ["question_id", "variant_no", "id", "similarity", "rank"]

    def of_block(held: list[pa.RecordBatch]) -> dict[int, list[_Best]]:
        rows = pa.Table.from_batches(held)
        groups: dict = {}
        for i, key in enumerate(zip(pc.list_value_length(rows["vec"]).to_pylist(), _lists(rows["channel_ids"]),
                                    _lists(rows["discussion_types"]), rows["since"].to_pylist(), strict=True)):
            groups.setdefault(key, []).append(i)
        by_dim: dict[int, list[_Best]] = {}
        for key, members in groups.items():
            by_dim.setdefault(key[0], []).append(_Best(rows.take(pa.array(members)), key[0], k))
        return by_dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, by_dim = None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            for some in (by_dim or {}).values():
                for best in some:
                    yield from best.found(names)

        for b in batches:
            at_rows = b["block"].to_numpy() * 2 + b["kind"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at_rows)) + 1), len(at_rows)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                rows, block, kind = b.slice(lo, hi - lo), at_rows[lo] // 2, at_rows[lo] % 2
                if block != at:
                    yield from ended()
                    at, held, by_dim = block, [], None
                if not kind:
                    held.append(rows)
                    continue
                if not held:
                    continue
                by_dim = of_block(held) if by_dim is None else by_dim
                table = pa.Table.from_batches([rows])
                dims = pc.list_value_length(rows["vec"]).to_numpy()
                for dim in np.unique(dims):
                    if dim in by_dim:
                        some = table.take(pa.array(np.flatnonzero(dims == dim)))
                        vec, ids = _unit_rows(some["vec"].combine_chunks(), dim), some["id"].to_numpy()
                        rough = vec.astype(np.float32)
                        for best in by_dim[dim]:
                            best.meet(vec, rough, ids, some)
        yield from ended()

    return run


def vector_topk(
    variants: DataFrame, discussions: DataFrame, k: int = DEFAULTS["vector_top_k"], part_rows: int = 32768
) -> DataFrame:
    """Exact k best discussions by cosine per variant, after the hard filters.

    Variants are dealt to blocks of about ``part_rows`` by a hash of their key. Discussions are
    sent to every block and stream past its variants in the order of ids; a task holds its variants
    and their k best so far, and gives k rows per variant. No other pair is a row, and nothing
    goes through the driver but a count. Each block is a partition of its own, and vectors travel
    as they are stored.
    Returns question_id, variant_no, id, similarity, rank.
    """
    k = max(1, k)
    named = variants.filter("vec is not null")
    n = named.count()
    # small question tables are spread over the cores as well, and no core waits for the last few blocks
    cores = named.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // part_rows))
    blocks = -(-blocks // cores) * cores if blocks > cores else max(blocks, min(n // TILE, cores))
    keys = F.array(*[F.lit(x) for x in spread_keys(named.sparkSession, blocks)])
    nul = F.lit(None)
    kinds = {c: named.schema[c].dataType for c in ("question_id", "variant_no")}
    # what both sides hold in single precision travels so
    single = all(df.schema[c].dataType.simpleString() == "array<float>" for df, c in ((named, "vec"), (discussions, "embedding")))
    vectors = "array<float>" if single else "array<double>"
    asked = named.select(
        F.element_at(keys, F.pmod(F.xxhash64("question_id", "variant_no"), F.lit(blocks)).cast("int") + 1).alias("block"),
        F.lit(0).alias("kind"),
        nul.cast("string").alias("id"), nul.cast("string").alias("channel_id"), nul.cast("string").alias("discussion_type"),
        nul.cast("bigint").alias("started"), F.col("vec").cast(vectors).alias("vec"), "question_id", "variant_no",
        "channel_ids", "discussion_types", F.unix_micros("since").alias("since"))
    met = discussions.filter("embedding is not null").select(
        F.explode(keys).alias("block"), F.lit(1).alias("kind"), "id", "channel_id",
        "discussion_type", F.unix_micros("started_at").alias("started"), F.col("embedding").cast(vectors).alias("vec"),
        *(nul.cast(t).alias(c) for c, t in kinds.items()),
        nul.cast("array<string>").alias("channel_ids"), nul.cast("array<string>").alias("discussion_types"),
        nul.cast("bigint").alias("since"))
    rows = asked.unionByName(met).repartition(blocks, "block").sortWithinPartitions("block", "kind", "id")
    fields = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())
    return rows.mapInArrow(_block_topk(k), f"{fields}, id string, similarity double, rank int")


# --- labels ------------------------------------------------------------------------

# fixed values: separators between label tokens
TOKEN_SEP = r"[^\p{L}\p{N}]+"


def phrase_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TOKEN_SEP), lambda t: t != "")


def label_edges(graph: dict[str, DataFrame]) -> DataFrame:
    """Discussion to label edges of both kinds: kind, label, id."""
    t = graph["edges_discusses"].select(F.lit("topic").alias("kind"), F.col("dst").alias("label"), F.col("src").alias("id"))
    e = graph["edges_mentions"].select(F.lit("entity").alias("kind"), F.col("dst").alias("label"), F.col("src").alias("id"))
    return t.unionByName(e)


def filter_mode(questions: DataFrame) -> DataFrame:
    """Add ``mode``: which of the channel (2) and type (1) filters a question sets."""
    mode = F.when(F.col("channel_ids").isNotNull(), 2).otherwise(0) + F.when(
        F.col("discussion_types").isNotNull(), 1).otherwise(0)
    return questions.withColumn("mode", mode)


CELL = ["channel_cell", "type_cell"]


def filter_cells(questions: DataFrame) -> DataFrame:
    """One row per question and cell that its channel and type filters admit; null where it sets none."""
    def cells(allowed: str) -> Column:
        named = F.filter(F.array_distinct(allowed), lambda x: x.isNotNull())
        return F.explode(F.when(F.col(allowed).isNull(), F.expr("array(cast(null as string))")).otherwise(named))

    asked = filter_mode(questions.select("question_id", *FILTERS))
    return asked.withColumn(CELL[0], cells("channel_ids")).withColumn(CELL[1], cells("discussion_types"))


def _in_cell(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides that agree in the keys and lie in the same cell, which ``b`` names."""
    other = b.select(*[F.col(c).alias(f"_{c}") if c in [*keys, *CELL] else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    for c in CELL:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, cond).drop(*[f"_{c}" for c in [*keys, *CELL]])


def best_lists(edges: DataFrame, nodes: DataFrame, keys: list[str], m: int, modes: list[int]) -> DataFrame:
    """The m newest discussions per key, for each mode of filtering in use.

    Without filters that is m per key; with a channel or type filter m per key and
    channel or type. A filter admits whole channels and types and a newest-first
    suffix of time, so the m newest admitted discussions of a key are always among
    these. A label used by most discussions thus costs m rows, not its full list,
    and the cut by row number starts before the shuffle. ``place`` is a row's place in
    its list, and the cells name the channel and type of the list (null: any).
    """
    attrs = nodes.select("id", "channel_id", "discussion_type", "started_at")
    rows = edges.join(attrs, "id").withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    rows = rows.withColumn(CELL[0], F.when(F.col("mode") >= 2, F.col("channel_id"))).withColumn(
        CELL[1], F.when(F.col("mode") % 2 == 1, F.col("discussion_type")))
    w = Window.partitionBy(*keys, "mode", *CELL).orderBy(*_newest())
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= m)


def _modes(questions: DataFrame) -> list[int]:
    """The filter modes in use: at most four values."""
    return sorted(r["mode"] for r in filter_mode(questions).select("mode").distinct().collect()) or [0]


def anchor_labels(questions: DataFrame, graph: dict[str, DataFrame], limit: int) -> DataFrame:
    """Labels holding one of a question's phrases, 2 * limit best per question.

    A phrase matches where its tokens stand together in the label; the score is the
    matched share of the label's tokens. Every token run of a label up to the
    longest phrase is joined with the phrases by equality.
    """
    terms = F.concat(F.coalesce("topics", F.expr("cast(array() as array<string>)")),
                     F.coalesce("entities", F.expr("cast(array() as array<string>)")))
    asked = questions.select("question_id", F.explode(terms).alias("_t")).withColumn(
        "_toks", phrase_tokens(F.col("_t"))).filter(F.size("_toks") > 0).select(
        "question_id", F.array_join("_toks", " ").alias("phrase"), F.size("_toks").alias("n")).distinct()
    phrases = asked.select("phrase", "n").distinct()
    longest = phrases.agg(F.max("n")).first()[0] or 0
    labels = graph["nodes_topic"].select(F.lit("topic").alias("kind"), F.col("name").alias("label"), "name").unionByName(
        graph["nodes_entity"].select(F.lit("entity").alias("kind"), F.col("key").alias("label"), "name"))
    toks = labels.withColumn("_toks", phrase_tokens(F.col("name"))).filter(F.size("_toks") > 0)
    runs = F.expr(
        f"array_distinct(flatten(transform(sequence(1, least({max(1, longest)}, size(_toks))), "
        "n -> transform(sequence(0, size(_toks) - n), i -> array_join(slice(_toks, i + 1, n), ' ')))))")
    grams = toks.select("kind", "label", F.size("_toks").alias("size"), F.explode(runs).alias("phrase"))
    hits = grams.join(phrases, "phrase").withColumn("score", F.col("n") / F.col("size"))
    rank = [F.col("score").desc(), "kind", "label"]
    w = Window.partitionBy("phrase").orderBy(*rank)
    short = hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * limit)
    per_q = asked.join(short.select("phrase", "kind", "label", "score"), "phrase").groupBy(
        "question_id", "kind", "label").agg(F.max("score").alias("score"))
    wq = Window.partitionBy("question_id").orderBy(*rank)
    return per_q.withColumn("_r", F.row_number().over(wq)).filter(F.col("_r") <= 2 * limit).drop("_r")


def anchor_hits(
    questions: DataFrame, graph: dict[str, DataFrame], limit: int = DEFAULTS["anchor_limit"]
) -> DataFrame:
    """Discussions tagged with a matching label, best label then newest first, ``limit`` per question."""
    limit = max(1, limit)
    labels = anchor_labels(questions, graph, limit)
    used = labels.select("kind", "label").distinct()
    lists = best_lists(label_edges(graph).join(used, ["kind", "label"], "left_semi"),
                       graph["nodes_discussion"], ["kind", "label"], limit, _modes(questions))
    rows = hard_filter(_in_cell(labels.join(filter_cells(questions), "question_id"), lists, ["kind", "label", "mode"]))
    best = rows.groupBy("question_id", "id").agg(
        F.max("score").alias("label_score"), F.max("started_at").alias("started_at"))
    w = Window.partitionBy("question_id").orderBy(F.col("label_score").desc(), *_newest())
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


# --- candidates ----------------------------------------------------------------------


def _similarity(rows: DataFrame, questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add the cosine between question and discussion to (question_id, id) rows.

    Lengths are found once, before the sides meet; the vectors travel as they are stored.
    """
    q = questions.select("question_id", F.col("vec").alias("_qv"), length(F.col("vec")).alias("_qn"))
    d = nodes.select("id", F.col("embedding").alias("_dv"), length(F.col("embedding")).alias("_dn"))
    sim = F.round(scaled_dot(F.col("_qv"), F.col("_qn"), F.col("_dv"), F.col("_dn")), DIGITS)
    return rows.join(q, "question_id").join(d, "id").withColumn(
        "similarity", F.coalesce(sim, F.lit(0.0))).drop("_qv", "_qn", "_dv", "_dn")


def merge_candidates(
    vector_hits: DataFrame, anchors: DataFrame, questions: DataFrame, nodes: DataFrame
) -> DataFrame:
    """One row per (question, discussion): best similarity, anchor flag, sources."""
    return _named(_merged(vector_hits, anchors, questions, nodes))


#: Where a candidate comes from, in order of name; a set of them is a number, one bit each.
SOURCES = ["anchor", "expansion", "vector"]
#: Paths of expansion, in order of name; a path is its place, from 1.
VIAS = sorted(VIA_WEIGHTS)


def _bit(source: str) -> int:
    return 1 << SOURCES.index(source)


def _named(rows: DataFrame) -> DataFrame:
    """Candidates with their sources and path by name, where numbers stand for them."""
    sets = F.array(*[F.array(*[F.lit(x) for x in SOURCES if n & _bit(x)]).cast("array<string>") for n in range(1 << len(SOURCES))])
    rows = rows.withColumn("sources", F.element_at(sets, F.col("_sources") + 1)).drop("_sources")
    if "_via" in rows.columns:
        # no lookup in an array: element_at takes a null place for the last one
        via = F.coalesce(*[F.when(F.col("_via") == n, F.lit(x)) for n, x in enumerate(VIAS, 1)])
        rows = rows.withColumn("via", via).drop("_via")
    return rows


def _merged(vector_hits: DataFrame, anchors: DataFrame, questions: DataFrame, nodes: DataFrame) -> DataFrame:
    a = _similarity(anchors.select("question_id", "id"), questions, nodes)
    both = vector_hits.select("question_id", "id", "similarity", F.lit(_bit("vector")).alias("_s")).unionByName(
        a.select("question_id", "id", "similarity", F.lit(_bit("anchor")).alias("_s")))
    # numbers of fixed width alone, which are added up in place and need no sort
    return both.groupBy("question_id", "id").agg(
        F.max("similarity").alias("vec_sim"), F.bit_or("_s").alias("_sources")).withColumn(
        "anchor_hit", F.col("_sources").bitwiseAND(_bit("anchor")) > 0)


def expansion_seeds(
    candidates: DataFrame, n: int = DEFAULTS["expansion_seeds"],
    w_vec: float = DEFAULTS["weight_vector"], w_anchor: float = DEFAULTS["weight_anchor"],
) -> DataFrame:
    """The n best candidates per question before expansion."""
    prelim = F.round(F.lit(w_vec) * F.col("vec_sim") + F.lit(w_anchor) * F.col("anchor_hit").cast("int"), DIGITS)
    w = Window.partitionBy("question_id").orderBy(F.col("prelim").desc(), "id")
    return candidates.withColumn("prelim", prelim).withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= n).select("question_id", F.col("id").alias("seed_id"), "prelim", "rank")


def expand(
    seeds: DataFrame, graph: dict[str, DataFrame], questions: DataFrame,
    total: int = DEFAULTS["expansion_seeds"] * DEFAULTS["expansion_fanout"], filter_expansion: bool = True,
) -> DataFrame:
    """One hop from the seeds over continuations, shared labels and related topics.

    Returns distinct (question_id, seed_id, via, id) rows, ``total`` per question:
    strongest path first, then newest discussion, its id and the seed. The
    question's hard filters hold here as well, unless ``filter_expansion`` is off.
    """
    m = total + 1  # a seed may meet itself once in each list
    modes = _modes(questions) if filter_expansion else [0]
    nodes = graph["nodes_discussion"]
    wanted = seeds.select(F.col("seed_id").alias("id")).distinct()
    topics = graph["edges_discusses"].select(F.col("dst").alias("topic"), F.col("src").alias("id"))
    entities = graph["edges_mentions"].select(F.col("dst").alias("entity"), F.col("src").alias("id"))
    of_topic = topics.join(wanted, "id", "left_semi").select(F.col("id").alias("seed_id"), "topic")
    of_entity = entities.join(wanted, "id", "left_semi").select(F.col("id").alias("seed_id"), "entity")

    c = graph["edges_continuation_of"].select("src", "dst")
    links = c.select(F.col("src").alias("seed_id"), F.col("dst").alias("id")).unionByName(
        c.select(F.col("dst").alias("seed_id"), F.col("src").alias("id"))).distinct()
    links = links.join(wanted.withColumnRenamed("id", "seed_id"), "seed_id", "left_semi")
    cont = best_lists(links, nodes, ["seed_id"], m, modes)

    topic_lists = best_lists(topics, nodes, ["topic"], m, modes)
    used = of_entity.select("entity").distinct()
    entity_lists = best_lists(entities.join(used, "entity", "left_semi"), nodes, ["entity"], m, modes)

    co = graph["edges_topic_cooccurs"].select("src", "dst")
    near = co.select(F.col("src").alias("from_topic"), F.col("dst").alias("topic")).unionByName(
        co.select(F.col("dst").alias("from_topic"), F.col("src").alias("topic"))).join(
        of_topic.select(F.col("topic").alias("from_topic")).distinct(), "from_topic", "left_semi")
    reach = near.join(topic_lists.select("topic", "id").distinct(), "topic").select("from_topic", "id").distinct()
    related = best_lists(reach, nodes, ["from_topic"], m, modes)

    # the lists of all paths, by the label that leads there, and the seeds that have the label
    cols = ["id", "channel_id", "discussion_type", "started_at", "mode", *CELL, "place"]
    lists = tags = None
    for via, rows, key, named in (
        ("continuation", cont, "seed_id", links.select("seed_id", F.col("seed_id").alias("label")).distinct()),
        ("shared_topic", topic_lists, "topic", of_topic.withColumnRenamed("topic", "label")),
        ("shared_entity", entity_lists, "entity", of_entity.withColumnRenamed("entity", "label")),
        ("cooccurring_topic", related, "from_topic", of_topic.withColumnRenamed("topic", "label")),
    ):
        one = rows.select(F.lit(via).alias("via"), F.col(key).alias("label"), *cols)
        tag = named.select("seed_id", F.lit(via).alias("via"), "label")
        lists = one if lists is None else lists.unionByName(one)
        tags = tag if tags is None else tags.unionByName(tag)
    lists = cut(lists.withColumn("weight", via_weight(F.col("via"))))
    asked = filter_cells(questions) if filter_expansion else questions.select(
        "question_id", F.lit(None).cast("timestamp").alias("since"), F.lit(0).alias("mode"),
        *[F.lit(None).cast("string").alias(n) for n in CELL])
    asked = asked.select("question_id", "since", "mode", *CELL)
    tagged = seeds.select("question_id", "seed_id").join(tags, "seed_id")
    # a label that only one seed has does not lead to that seed
    labels = tagged.groupBy("question_id", "via", "label").agg(
        F.when(F.min("seed_id") == F.max("seed_id"), F.min("seed_id")).alias("only")).join(asked, "question_id")

    # a full list gives enough rows: what is weaker or older than its last row is not needed
    key = ["via", "label", "mode"]
    full = lists.filter((F.col("place") == m) & F.col("started_at").isNotNull()).select(
        *key, *CELL, F.struct("weight", "started_at").alias("last"))
    late = F.col("since").isNull() | (F.col("last")["started_at"] >= F.col("since"))
    floor = _in_cell(labels, full, key).filter(late).groupBy("question_id").agg(F.max("last").alias("floor"))
    # a path that is weaker than the floor is left out before its list is met
    strong_enough = labels.join(floor, "question_id", "left").filter(
        F.col("floor").isNull() | (via_weight(F.col("via")) >= F.col("floor")["weight"]))
    hops = _in_cell(strong_enough, lists, key).filter(
        (F.col("since").isNull() | F.coalesce(F.col("started_at") >= F.col("since"), F.lit(False)))
        & (F.col("only").isNull() | (F.col("only") != F.col("id")))
        & (F.col("floor").isNull() | (F.struct("weight", "started_at") >= F.col("floor"))))
    # each (path, discussion) is reached from some other seed, so ``total`` of them give enough rows
    strong = Window.partitionBy("question_id").orderBy(F.col("weight").desc(), *_newest())
    near_rows = hops.select("question_id", "via", "label", "id", "weight", "started_at").withColumn(
        "_d", F.dense_rank().over(strong)).filter(F.col("_d") <= total).drop("_d")
    pairs = near_rows.join(tagged, ["question_id", "via", "label"]).filter("id <> seed_id").drop("label").distinct()
    w = Window.partitionBy("question_id").orderBy(F.col("weight").desc(), *_newest(), "seed_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= total).select(
        "question_id", "seed_id", "via", "id", "weight", "rank")


def score_expansion(
    candidates: DataFrame, hops: DataFrame, questions: DataFrame, nodes: DataFrame
) -> DataFrame:
    """Candidates with the expansion folded in: best path, rescored similarity, sources."""
    bits = F.lit(0)
    for x in SOURCES:
        bits = bits.bitwiseOR(F.when(F.array_contains("sources", x), F.lit(_bit(x))).otherwise(F.lit(0)))
    return _named(_scored(candidates.withColumn("_sources", bits), hops, questions, nodes))


def _scored(candidates: DataFrame, hops: DataFrame, questions: DataFrame, nodes: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, VIAS)), F.col("via")).cast("int")
    best = hops.select("question_id", "id", "weight", place.alias("_via")).groupBy("question_id", "id").agg(
        F.max("weight").alias("expansion_score"), F.max_by("_via", "weight").alias("_via"))
    scored = _similarity(best, questions, nodes).select(
        "question_id", "id", F.col("similarity").alias("vec_sim"), F.lit(False).alias("anchor_hit"),
        F.lit(_bit("expansion")).alias("_sources"), "expansion_score", "_via")
    base = candidates.select(
        "question_id", "id", "vec_sim", "anchor_hit", "_sources", F.lit(0.0).alias("expansion_score"),
        F.lit(None).cast("int").alias("_via"))
    # at most one row from each side per (question, discussion)
    return base.unionByName(scored).groupBy("question_id", "id").agg(
        F.max("vec_sim").alias("vec_sim"), F.bool_or("anchor_hit").alias("anchor_hit"),
        F.max("expansion_score").alias("expansion_score"), F.max("_via").alias("_via"), F.bit_or("_sources").alias("_sources"))


def preference_boost(w_type: float, resolved_bonus: float) -> Column:
    """Soft nudges: a preferred discussion type, and a solved case for troubleshooting."""
    typed = F.coalesce(F.array_contains("preferred_types", F.col("discussion_type")), F.lit(False))
    solved = F.coalesce((F.col("intent") == "troubleshooting") & F.col("resolved"), F.lit(False))
    return F.when(typed, F.lit(w_type)).otherwise(F.lit(0.0)) + F.when(
        solved, F.lit(resolved_bonus)).otherwise(F.lit(0.0))


def rank_candidates(
    candidates: DataFrame, questions: DataFrame, nodes: DataFrame, now, weights: dict | None = None
) -> DataFrame:
    """Fused score above the floor and rank per question; texts of a discussion stay in its node."""
    p = {**DEFAULTS, **(weights or {})}
    attrs = nodes.select("id", "title", "channel_id", "discussion_type", "sentiment", "resolved",
                         "started_at")
    q = questions.select("question_id", "intent", "preferred_types")
    full = candidates.join(attrs, "id").join(q, "question_id")
    full = full.withColumn("recency", recency(F.col("started_at"), as_ts(now), p["half_life_days"]))
    full = full.withColumn("preference", preference_boost(p["weight_type"], p["resolved_bonus"]))
    score = (
        F.lit(p["weight_vector"]) * F.col("vec_sim")
        + F.lit(p["weight_anchor"]) * F.col("anchor_hit").cast("int")
        + F.lit(p["weight_expansion"]) * F.col("expansion_score")
        + F.lit(p["weight_recency"]) * F.col("recency")
        + F.col("preference")
    )
    kept = full.withColumn("score", F.round(score, DIGITS)).filter(F.col("score") >= p["min_score"])
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "id")
    return kept.withColumn("rank", F.row_number().over(w)).drop("intent", "preferred_types")


def evidence(ranked: DataFrame, n: int = DEFAULTS["evidence"]) -> DataFrame:
    return ranked.filter(F.col("rank") <= n)


def diversify(ranked: DataFrame, questions: DataFrame, n: int = DEFAULTS["evidence"]) -> DataFrame:
    """Evidence per question; for opinions the best negative and the best positive get a seat.

    A sentiment that is crowded out replaces the weakest pick, so at most two seats
    change and the top stays. Returns the ranked columns with ``evidence_rank``.
    """
    champions = Window.partitionBy("question_id", "sentiment").orderBy("rank")
    opinion = questions.select("question_id", (F.col("intent") == "opinion").alias("_op"))
    # rank is a row number, so what lies behind the first n can only be a champion
    moody = F.coalesce(F.col("sentiment").isin("negative", "positive"), F.lit(False))
    near = ranked.filter((F.col("rank") <= n) | moody).join(opinion, "question_id").filter(
        (F.col("rank") <= n) | F.coalesce("_op", F.lit(False)))
    flagged = near.withColumn(
        "_seat", F.when(F.col("_op") & F.col("sentiment").isin("negative", "positive")
                        & (F.row_number().over(champions) == 1), 0).otherwise(1))
    chosen = flagged.withColumn("_o", F.row_number().over(
        Window.partitionBy("question_id").orderBy("_seat", "rank"))).filter(F.col("_o") <= n)
    by_rank = Window.partitionBy("question_id").orderBy("rank")
    return chosen.withColumn("evidence_rank", F.row_number().over(by_rank)).drop("_seat", "_o", "_op")


def retrieve(
    questions: DataFrame, variants: DataFrame, graph: dict[str, DataFrame], now, params: dict | None = None
) -> DataFrame:
    """Vector search, anchors, expansion and ranking for all questions: ranked candidates."""
    p = {**DEFAULTS, **(params or {})}
    nodes = graph["nodes_discussion"]
    asked = variants.join(questions.select("question_id", *FILTERS), "question_id")
    hits = vector_topk(asked, nodes, p["vector_top_k"])
    anchors = anchor_hits(questions, graph, p["anchor_limit"])
    merged = cut(_merged(hits, anchors, questions, nodes))
    seeds = expansion_seeds(merged, p["expansion_seeds"], p["weight_vector"], p["weight_anchor"])
    hops = expand(seeds, graph, questions, p["expansion_seeds"] * p["expansion_fanout"])
    return _named(rank_candidates(_scored(merged, hops, questions, nodes), questions, nodes, now, p))


def with_relaxation(
    questions: DataFrame, variants: DataFrame, graph: dict[str, DataFrame], now, params: dict | None = None
) -> DataFrame:
    """Ranked candidates; a question whose type or date filter left nothing is retried once.

    The retry keeps the channels and drops the other filters. ``relaxed`` marks it. Both passes are
    written out once, by column, and read from there.
    """
    # a table of few files is dealt out anew, so that what is worked out per question is shared by all tasks
    questions, variants = cut(questions.repartition("question_id")), cut(variants.repartition("question_id"))
    ranked = stored(retrieve(questions, variants, graph, now, params))
    tight = questions.filter("discussion_types is not null or since is not null")
    again = tight.join(ranked.select("question_id").distinct(), "question_id", "left_anti")
    loose = cut(again.withColumn("discussion_types", F.lit(None).cast("array<string>")).withColumn(
        "since", F.lit(None).cast("timestamp")))
    first = ranked.withColumn("relaxed", F.lit(False))
    if loose.isEmpty():
        return first
    retry = stored(retrieve(loose, variants.join(loose.select("question_id"), "question_id", "left_semi"), graph, now, params))
    return first.unionByName(retry.withColumn("relaxed", F.lit(True)))
