"""Similarity join of vectors in pivot cells, and labels that are made one by it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parley.functions.vectors import unit
from parley.operators.linked import components
from parley.operators.ordered import row_index
from parley.session import cut

#: Vectors of a cell, members of a block, and pivots of all groups at most: with 384 dimensions 12 MB are broadcast.
CELL, BLOCK, PIVOTS = 2_000, 512, 4_096
#: Angles are compared with this much room for rounding; products decide in the end.
ROOM = 1e-6
#: Hubs of all groups that are broadcast at a time, and numbers that their vectors hold at most, 12 MB.
HUBS, HUB_NUMBERS = 8_192, 1_572_864


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _angles(products: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(products, -1.0, 1.0))


def _with_cells(nodes: DataFrame, pivots: dict[str, np.ndarray], first: dict[str, int], spread: DataFrame | None, alpha: float,
                any_cell: bool = False) -> DataFrame:
    """Rows of ``nodes`` (grp, node, vec) with their nearest pivot, or with every cell that they may reach.

    Without ``spread``: (grp, node, vec, home, angle). With it, the cells (cell, lo, hi) that have
    members: a row per cell whose members may lie within ``alpha``, by the triangle bound, no later
    than the row's own cell unless it may be ``any_cell``.
    """
    spark = nodes.sparkSession
    reach = None
    if spread is not None:
        total = sum(len(p) for p in pivots.values())
        reach = np.full((2, total), np.nan)
        for r in spread.collect():  # a row per pivot
            reach[:, r["cell"]] = r["lo"] - alpha - ROOM, r["hi"] + alpha + ROOM
    shared = spark.sparkContext.broadcast((pivots, first, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, first, reach = shared.value
        for b in batches:
            groups = np.array(b.column(0).to_pylist(), object)
            vectors = _matrix(b.column(2))
            for g in sorted(set(groups.tolist())):
                mine = np.flatnonzero(groups == g)
                angle = _angles(vectors[mine] @ pivots[g].T)
                home = angle.argmin(axis=1)
                if reach is None:
                    rows, cells = np.arange(len(mine)), home
                else:
                    lo, hi = reach[:, first[g]: first[g] + len(pivots[g])]
                    may = (angle >= lo) & (angle <= hi)
                    if not any_cell:
                        may &= np.arange(len(pivots[g])) <= home[:, None]
                    rows, cells = np.nonzero(may)
                part = b.take(pa.array(mine[rows]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cells + first[g], pa.int64()), pa.array(angle[rows, cells])], ["grp", "node", "vec", "cell", "angle"])

    node = nodes.schema["node"].dataType.simpleString()
    return nodes.select("grp", "node", "vec").mapInArrow(run, f"grp string, node {node}, vec array<double>, cell long, angle double")


class _Forest:
    """Union-find over the members of a block."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _linked(rows: Iterator[tuple], theta: float) -> Iterator[tuple]:
    """Links (a, b, score) that connect what lies within a block, and its members with later rows.

    ``rows`` are (block key, is member, node, vec), a block's members first. Only members
    are held. A row that is near several members gets one link, and the members that it connects
    one each; so links are fewer than rows, whatever the number of near pairs.
    """
    for _, block in groupby(rows, lambda r: r[0]):
        nodes: list = []
        vectors: list = []
        held, forest = None, None
        for _, member, node, vec in block:
            if member:
                nodes.append(node)
                vectors.append(vec)
                continue
            if held is None:
                held, forest = np.array(vectors), _Forest(len(nodes))
                yield from _inside(held, nodes, forest, theta)
            score = held @ vec
            near = np.flatnonzero(score >= theta).tolist()
            if near:
                yield nodes[near[0]], node, float(score[near[0]])
                for j in near[1:]:
                    if forest.join(near[0], j):
                        yield nodes[j], node, float(score[j])
        if held is None:
            yield from _inside(np.array(vectors), nodes, _Forest(len(nodes)), theta)


def _inside(held: np.ndarray, nodes: list, forest: _Forest, theta: float) -> Iterator[tuple]:
    for i in range(1, len(nodes)):
        score = held[:i] @ held[i]
        for j in np.flatnonzero(score >= theta).tolist():
            if forest.join(i, j):
                yield nodes[j], nodes[i], float(score[j])


def _near_hubs(nodes: DataFrame, hubs: dict[str, tuple[list, np.ndarray]], theta: float) -> DataFrame:
    """``nodes`` with ``hub``, the nearest hub of the group if it is within ``theta``, and its ``score``."""
    shared = nodes.sparkSession.sparkContext.broadcast(hubs)
    kind = to_arrow_type(nodes.schema["node"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            found, best = [None] * b.num_rows, np.zeros(b.num_rows)
            for names, mine, score in _scores(b, shared.value):
                at = score.argmax(axis=1)
                best[mine] = score[np.arange(len(mine)), at]
                for i, k in zip(mine.tolist(), at.tolist(), strict=True):
                    if best[i] >= theta:
                        found[i] = names[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind), pa.array(best)], ["grp", "node", "vec", "hub", "score"])

    node = nodes.schema["node"].dataType.simpleString()
    return nodes.select("grp", "node", "vec").mapInArrow(run, f"grp string, node {node}, vec array<double>, hub {node}, score double")


def _near_rest(inside: DataFrame, rest: dict[str, tuple[list, np.ndarray]], theta: float) -> DataFrame:
    """A link (a, b, score) of each of the few ``rest`` with a node near it, for every batch of ``inside`` that has one."""
    shared = inside.sparkSession.sparkContext.broadcast(rest)
    kind = to_arrow_type(inside.schema["node"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            own, out = b.column(1).to_pylist(), []
            for names, mine, score in _scores(b, shared.value):
                at = score.argmax(axis=0)
                out += [(own[mine[i]], names[k], float(score[i, k])) for k, i in enumerate(at.tolist()) if score[i, k] >= theta]
            a, c, scores = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(c, kind), pa.array(scores, pa.float64())], ["a", "b", "score"])

    node = inside.schema["node"].dataType.simpleString()
    return inside.select("grp", "node", "vec").mapInArrow(run, f"a {node}, b {node}, score double")


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield pa.RecordBatch.from_arrays([c.take(pa.array(range(at, min(at + rows, b.num_rows)))) for c in b.columns], b.schema.names)


def _scores(b: pa.RecordBatch, hubs: dict[str, tuple[list, np.ndarray]]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Per group of a batch that has hubs: their names, the group's rows, and the products of both."""
    groups = np.array(b.column(0).to_pylist(), object)
    vectors = _matrix(b.column(2))
    for g in sorted(set(groups.tolist()) & set(hubs)):
        mine = np.flatnonzero(groups == g)
        yield hubs[g][0], mine, vectors[mine] @ hubs[g][1].T


def _gathered(nodes: DataFrame, most: int) -> dict[str, tuple[list, np.ndarray]]:
    """At most ``most`` nodes as (names, vectors) of each group."""
    rows = sorted(nodes.select("grp", "node", "vec").limit(most).collect(), key=lambda r: (r["grp"], r["node"]))
    some = {g: list(x) for g, x in groupby(rows, lambda r: r["grp"])}
    return {g: ([r["node"] for r in x], np.array([r["vec"] for r in x])) for g, x in some.items()}


def _drawn(nodes: DataFrame, seed: int, n: int, most: int) -> dict[str, tuple[list, np.ndarray]]:
    """About ``most`` of ``n`` nodes by hash."""
    at = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30))
    return _gathered(nodes.where(at * F.lit(n) < F.lit(most << 30)), most + most // 8)


def _forest(hubs: dict[str, tuple[list, np.ndarray]], theta: float) -> Iterator[tuple[str, list, np.ndarray, list[tuple], np.ndarray]]:
    """Per group of a few nodes: names, vectors, links (by place) that connect them, and roots."""
    for g, (names, held) in hubs.items():
        forest = _Forest(len(names))
        links = list(_inside(held, range(len(names)), forest, theta))
        yield g, names, held, links, np.array([forest.root(i) for i in range(len(names))])


def _joined(nodes: DataFrame, n: int, theta: float, hubs: int) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """One large component of each group: links that connect it, its nodes, all other nodes and their number.

    The largest component among some hubs is the start. Whatever is near one of its members is in
    it too, by one link. Every round draws hubs from what has joined and shows them to the
    rest alone, while that takes a quarter of the rest away or doubles what has joined. Drawing decides
    about work, not about links: the rest meets all nodes afterwards, and nodes of one component need not meet.
    """
    links, shown = [], {}
    for g, names, held, near, roots in _forest(_drawn(nodes, 11, n, hubs), theta):
        size = np.bincount(roots)
        top = np.flatnonzero(roots == size.argmax())
        if len(top) > 1:
            shown[g] = [names[i] for i in top.tolist()], held[top]
            links += [(names[a], names[b], score) for a, b, score in near if roots[a] == size.argmax()]
    if not shown:
        return None
    node = nodes.schema["node"].dataType.simpleString()
    found = nodes.sparkSession.createDataFrame(links, f"a {node}, b {node}, score double")
    rest, left, inside, turn = nodes, n, nodes.limit(0), 0
    while True:
        met = cut(_near_hubs(rest, shown, theta))
        near = met.where("hub is not null")
        found = found.unionByName(near.where("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b"), "score"))
        inside = inside.unionByName(near.select("grp", "node", "vec"))
        rest = met.where("hub is null").select("grp", "node", "vec")
        before, left, turn = left, rest.count(), turn + 1
        if not left or ((before - left) * 4 < before and n - left < 2 * (n - before)):
            return found, inside, rest, left
        shown = _drawn(inside, 11 + turn, n - left, hubs)


def similar_links(vectors: DataFrame, theta: float, cell: int = CELL, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b, score) inside groups that connect exactly the nodes whose cosine reaches ``theta``.

    ``vectors`` holds (grp, node, vec) with one row per node. The links are a part of all near
    pairs with the same connected components; their number is linear in what is compared.

    1. Equal vectors of a group become one: their nodes are linked with the least of them.
       Of many nodes one large component of each group is gathered around hubs (``_joined``). From
       here on only the others, the rest, are members of cells; nodes of the component just
       visit. A rest of no more than the hubs is broadcast to them instead.
    2. Pivots are drawn by hash, one for about ``cell`` vectors and ``pivots`` at most, and
       broadcast. Every vector lives in the cell of its nearest pivot.
    3. A cell is cut into blocks of ``block`` members by the angle to its pivot, however full it is.
    4. A vector visits a block when its angle to the pivot is within acos(theta) of the block's
       range: by the triangle inequality it has no near member elsewhere. Each pair of cells meets
       once. A task holds the members of one block and streams the visitors past them.

    A vector without direction, or null, is near nothing. A null group counts as ''.
    Groups are few, as kinds of labels are: at most as many as pivots.
    """
    alpha = float(np.arccos(max(-1.0, min(1.0, theta))))
    directed = vectors.select(F.coalesce("grp", F.lit("")).alias("grp"), "node", unit(F.col("vec")).alias("vec")).where(
        "vec is not null and exists(vec, x -> x != 0)")
    same = cut(directed.groupBy("grp", "vec").agg(F.min("node").alias("node"), F.count("*").alias("c")))
    copies = directed.join(same.where("c > 1").select("grp", "vec", F.col("node").alias("a")), ["grp", "vec"]).where("node != a").select(
        "a", F.col("node").alias("b"), F.lit(1.0).alias("score"))
    nodes = same.select("grp", "node", "vec")
    n, groups = nodes.agg(F.count("*"), F.count_distinct("grp")).first()
    if not n:
        return copies
    if groups > pivots:
        raise ValueError(f"{groups} groups are more than the {pivots} pivots that are broadcast")
    hubs = min(HUBS, HUB_NUMBERS // max(1, nodes.select(F.max(F.size("vec"))).first()[0]))
    around = _joined(nodes, n, theta, hubs) if n > hubs else None
    if around is not None:
        found, inside, nodes, n = around
        copies = copies.unionByName(found)
        if n <= hubs:
            few = _gathered(nodes, hubs)
            among = [(names[a], names[b], score) for _, names, _, near, _ in _forest(few, theta) for a, b, score in near]
            return copies.unionByName(nodes.sparkSession.createDataFrame(among, found.schema)).unionByName(_near_rest(inside, few, theta))
        inside = inside.join(nodes.select("grp").distinct(), "grp", "left_semi")
    every = max(cell, -(-n // max(1, pivots - groups)))
    # one pivot of each group for certain, the others by hash
    order = F.xxhash64("node", F.lit(7))
    sure = nodes.groupBy("grp").agg(F.min_by("node", F.struct(order.alias("h"), F.col("node").alias("i"))).alias("node"))
    chosen = nodes.where(F.pmod(order, F.lit(every)) == 0).select("grp", "node", F.lit(1).alias("rank")).unionByName(
        sure.withColumn("rank", F.lit(0))).groupBy("grp", "node").agg(F.min("rank").alias("rank"))
    drawn = nodes.join(chosen, ["grp", "node"]).orderBy("rank", "grp", "node").limit(2 * pivots).collect()
    drawn.sort(key=lambda r: (r["grp"], r["node"]))
    by_group = {g: np.array([r["vec"] for r in rows]) for g, rows in groupby(drawn, lambda r: r["grp"])}
    first, at = {}, 0
    for g, m in by_group.items():
        first[g], at = at, at + len(m)

    homes = row_index(_with_cells(nodes, by_group, first, None, alpha), ["cell"], ["angle", "node"], "pos")
    homes = cut(homes.withColumn("blk", F.floor((F.col("pos") - 1) / block)))
    blocks = cut(homes.groupBy("cell", "blk").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi")))
    cells = blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    visits = _with_cells(nodes, by_group, first, cells, alpha).join(
        homes.select("node", F.col("cell").alias("home"), F.col("blk").alias("own")), "node")
    # to blocks of other cells, and to earlier blocks of the own cell
    meets = visits.join(blocks, "cell").where(
        ((F.col("cell") != F.col("home")) | (F.col("blk") < F.col("own")))
        & F.col("angle").between(F.col("lo") - alpha - ROOM, F.col("hi") + alpha + ROOM))
    if around is not None:
        # nodes of the large component are in no cell: they visit every block that they may reach
        guests = _with_cells(inside, by_group, first, cells, alpha, any_cell=True).join(blocks, "cell").where(
            F.col("angle").between(F.col("lo") - alpha - ROOM, F.col("hi") + alpha + ROOM))
        meets = meets.select("cell", "blk", "node", "vec").unionByName(guests.select("cell", "blk", "node", "vec"))
    rows = homes.select("cell", "blk", F.lit(True).alias("member"), "node", "vec").unionByName(
        meets.select("cell", "blk", F.lit(False).alias("member"), "node", "vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for b in batches:
                m = _matrix(b.column(4))
                keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                yield from zip(keys, b.column(2).to_pylist(), b.column(3).to_pylist(), m, strict=True)

        out: list[tuple] = []
        for link in _linked(read(), theta):
            out.append(link)
            if len(out) == 5_000:
                yield _links(out)
                out = []
        yield _links(out)

    def _links(out: list[tuple]) -> pa.RecordBatch:
        a, b, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(score, pa.float64())], ["a", "b", "score"])

    kind = to_arrow_type(nodes.schema["node"].dataType)
    name = nodes.schema["node"].dataType.simpleString()
    ordered = rows.repartition("cell", "blk").sortWithinPartitions("cell", "blk", F.desc("member"), "node")
    return copies.unionByName(ordered.mapInArrow(run, f"a {name}, b {name}, score double"))


def canonical_labels(labels: DataFrame, theta: float = 0.9, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(kind, label, canonical, members): labels of one kind that a chain of near labels connects share a name.

    ``labels`` holds (kind, label, uses, vec). The canonical label is the most used of its
    component, of equal ones the first by code points. Entities are only compared within their
    kind. Every label comes back; one without a vector stands for itself.
    """
    node = F.concat_ws("\x1f", F.coalesce("kind", F.lit("")), "label")
    known = cut(labels.select("kind", "label", "uses", "vec", node.alias("node")))
    links = similar_links(known.select(F.col("kind").alias("grp"), "node", "vec"), theta, cell, block)
    roots = components(links).select("node", "root")
    grouped = known.drop("vec").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = grouped.groupBy("root").agg(
        F.min(F.struct((-F.col("uses")).alias("u"), F.col("label").alias("l"))).alias("best"), F.count("*").alias("members"))
    return grouped.join(best, "root").select("kind", "label", F.col("best.l").alias("canonical"), "members")


def label_uses(facts: dict[str, DataFrame]) -> DataFrame:
    """(kind, label, uses) of all topics (kind 'topic') and entities (kind 'entity:<type>') of the graph's facts."""
    topics = facts["topics"].groupBy(F.lit("topic").alias("kind"), F.col("topic").alias("label")).agg(F.count("*").alias("uses"))
    kind = F.concat(F.lit("entity:"), "type")
    return topics.unionByName(facts["entities"].groupBy(kind.alias("kind"), F.col("key").alias("label")).agg(F.count("*").alias("uses")))


def rekeyed_facts(facts: dict[str, DataFrame], canonical: DataFrame) -> dict[str, DataFrame]:
    """Facts whose topics and entities carry their canonical labels, one row per discussion and label.

    Of labels that become one, the first position stays. An entity keeps its type; its name is
    that of the canonical key where some discussion gives it, so node and edge tables built from
    these facts are keyed anew.
    """
    topics = canonical.where("kind = 'topic'").select(F.col("label").alias("topic"), F.col("canonical").alias("_to"))
    moved = facts["topics"].join(topics, "topic", "left").withColumn("topic", F.coalesce("_to", "topic"))
    keys = canonical.where("kind like 'entity:%'").select(F.col("label").alias("key"), F.col("canonical").alias("_to"))
    names = facts["entities"].groupBy(F.col("key").alias("_to")).agg(F.min_by("name", F.struct("discussion_id", "pos")).alias("_name"))
    entities = facts["entities"].join(keys, "key", "left").join(names, "_to", "left").select(
        "discussion_id", "pos", F.coalesce("_to", "key").alias("key"), F.when(F.col("_to") != F.col("key"), F.col("_name")).otherwise(
            F.col("name")).alias("name"), "type")
    return {
        **facts,
        "topics": moved.groupBy("discussion_id", "topic").agg(F.min("pos").alias("pos")).select(*facts["topics"].columns),
        "entities": entities.groupBy("discussion_id", "key").agg(
            F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), F.min("type").alias("type")).select(*facts["entities"].columns),
        **_topic_lists(facts, moved),
    }


def _topic_lists(facts: dict[str, DataFrame], moved: DataFrame) -> dict[str, DataFrame]:
    """Discussion nodes with their topic lists in canonical labels."""
    lists = moved.groupBy(F.col("discussion_id").alias("id"), "topic").agg(F.min("pos").alias("pos")).groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "topic"))), lambda x: x["topic"]).alias("_topics"))
    nodes = facts["discussions"]
    renamed: Column = F.coalesce("_topics", "topics").alias("topics")
    return {"discussions": nodes.join(lists, "id", "left").select(*[renamed if c == "topics" else F.col(c) for c in nodes.columns])}
