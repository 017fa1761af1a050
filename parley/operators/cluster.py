"""Online topic clustering inside blocks, reply resolution and discussion rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.ordered import chase, row_index, scan
from parley.operators.segment import ORDER, gap_runs
from parley.schemas import DEFAULTS
from parley.session import cut

CHAIN = ["channel_id", "block_no", "epoch"]
_FOLD_INPUT = [*CHAIN, "ordinal", "ms", "id", "author_id", "mentions", "vec", "members", "authors"]
_FOLD_SCHEMA = ("channel_id string, block_no bigint, epoch bigint, id string, root_id string, ordinal int, centroid array<float>, "
                "members bigint, last_ms bigint, authors array<string>")


class ActiveClusters:
    """Active clusters of one chain; messages are placed in time order."""

    def __init__(self, tau: float, idle_ms: int, author_bonus: float, mention_bonus: float):
        self.tau, self.idle_ms = tau, idle_ms
        self.author_bonus, self.mention_bonus = author_bonus, mention_bonus
        self.roots: list[str] = []
        self.members: list[int] = []
        self.people: list[set] = []
        self.by_author: dict[str, set[int]] = {}
        self.cent = np.zeros((0, 0))
        self.last = np.zeros(0, dtype=np.int64)

    def add(self, root: str, centroid: np.ndarray, members: int, last_ms: int, authors) -> int:
        n = len(self.roots)
        if n == len(self.last):
            grown = np.zeros((max(16, 2 * n), len(centroid)))
            grown[:n] = self.cent[:n] if n else 0
            self.cent = grown
            self.last = np.concatenate([self.last, np.zeros(len(grown) - n, dtype=np.int64)])
        self.cent[n], self.last[n] = centroid, last_ms
        self.roots.append(root)
        self.members.append(int(members))
        self.people.append(set(authors))
        for a in authors:
            self.by_author.setdefault(a, set()).add(n)
        return n

    def _retire(self, now_ms: int) -> None:
        n = len(self.roots)
        if not n or now_ms - self.last[:n].min() <= self.idle_ms:
            return
        alive = np.flatnonzero(now_ms - self.last[:n] <= self.idle_ms)
        self.cent[: len(alive)] = self.cent[alive]
        self.last[: len(alive)] = self.last[alive]
        self.roots = [self.roots[i] for i in alive]
        self.members = [self.members[i] for i in alive]
        self.people = [self.people[i] for i in alive]
        self.by_author = {}
        for i, names in enumerate(self.people):
            for a in names:
                self.by_author.setdefault(a, set()).add(i)

    def place(self, mid: str, ms: int, author: str, mentions, vec) -> str:
        """Join the best cluster, the oldest of equal ones, or open a new one."""
        self._retire(ms)
        v = np.asarray(vec, dtype=np.float32).astype(np.float64)
        n = len(self.roots)
        if n:
            score = self.cent[:n] @ v
            for i in self.by_author.get(author, ()):
                score[i] += self.author_bonus
            if mentions is not None and len(mentions):
                for i in set().union(*(self.by_author.get(m, ()) for m in mentions)):
                    score[i] += self.mention_bonus
            best = int(np.argmax(score))
            if score[best] >= self.tau:
                k = self.members[best]
                self.cent[best] = ((self.cent[best] * k + v) / (k + 1)).astype(np.float32)
                self.members[best] = k + 1
                self.last[best] = ms
                self.people[best].add(author)
                self.by_author.setdefault(author, set()).add(best)
                return self.roots[best]
        self.add(mid, v, 1, ms, [author])
        return mid

    def rows(self) -> list[tuple]:
        """(root, centroid, members, last_ms, authors) of each, oldest first."""
        return [(r, self.cent[i].astype(np.float32).tolist(), self.members[i], int(self.last[i]),
                 sorted(self.people[i])) for i, r in enumerate(self.roots)]


def _fold(slice_rows: int, *settings):
    """Task kernel: a sorted stream of slices of chains, each led by the clusters active before it.

    Only the active clusters of the current chain are held. A full slice passes its active
    clusters on as rows without an id.
    """

    def state_rows(key: tuple, active: ActiveClusters) -> list[tuple]:
        return [(*key, None, root, i, vec, members, last_ms, authors)
                for i, (root, vec, members, last_ms, authors) in enumerate(active.rows())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, active, seen = None, None, 0
        names = [c.split()[0] for c in _FOLD_SCHEMA.split(", ")]
        for pdf in frames:
            out = []
            for *at, ordinal, ms, mid, author, mentions, vec, members, authors in pdf[_FOLD_INPUT].itertuples(index=False, name=None):
                if tuple(at) != key:
                    if seen == slice_rows:
                        out += state_rows(key, active)
                    key, active, seen = tuple(at), ActiveClusters(*settings), 0
                if ordinal >= 0:
                    active.add(mid, np.asarray(vec, dtype=np.float32), members, ms, authors)
                    continue
                seen += 1
                out.append((*key, mid, active.place(mid, ms, author, mentions, vec), None, None, None, None, None))
            yield pd.DataFrame(out, columns=names)
        if seen == slice_rows:
            yield pd.DataFrame(state_rows(key, active), columns=names)

    return run


def subcluster(
    blocks_with_vec: DataFrame,
    tau: float = DEFAULTS["tau"],
    idle_minutes: float = DEFAULTS["idle_minutes"],
    author_bonus: float = DEFAULTS["author_bonus"],
    mention_bonus: float = DEFAULTS["mention_bonus"],
    slice_rows: int = 200_000,
) -> DataFrame:
    """Assign each long message to an online sub-cluster of its block.

    Input: channel_id, block_no, id, author_id, mentions, created_at, vec. A
    message joins the best active cluster by dot product with its centroid, plus
    bonuses for a known author and for a mention of one, if that reaches ``tau``;
    else it opens a cluster. Clusters silent longer than ``idle_minutes`` retire.

    The fold is sequential by definition, but a silence longer than
    ``idle_minutes`` retires every cluster, so a block falls into independent
    epochs, which run in parallel. An epoch is cut into slices of ``slice_rows``
    messages. All first slices are folded at once, then all second ones, and so
    on; between them the active clusters of unfinished epochs lie in a
    checkpointed table. So a task never sees more of one epoch than a slice and
    its active clusters, and a lost executor repeats slices, not epochs. A run
    takes as many rounds as the longest epoch has slices.

    Returns channel_id, block_no, id, root_id (first message of the cluster).
    """
    idle_ms = int(idle_minutes * 60_000)
    kernel = _fold(slice_rows, tau, idle_ms, author_bonus, mention_bonus)
    keyed = gap_runs(blocks_with_vec, ["channel_id", "block_no"], idle_ms, "epoch").select(
        *CHAIN, F.unix_millis("created_at").alias("ms"), "id", "author_id", "mentions", "vec")
    longest = keyed.groupBy(*CHAIN).count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, -(-longest // slice_rows))
    if rounds > 1:
        # positions are found on narrow rows; what a message carries is read again in its round
        place = row_index(keyed.select(*CHAIN, "ms", "id"), CHAIN, ["ms", "id"], "_pos").select(
            "id", F.floor((F.col("_pos") - 1) / slice_rows).alias("_slice"))
        keyed = cut(keyed.join(place, "id"))
    found: DataFrame | None = None
    state: DataFrame | None = None
    for k in range(rounds):
        rows = keyed if rounds == 1 else keyed.filter(F.col("_slice") == k)
        rows = rows.select(*CHAIN, F.lit(-1).alias("ordinal"), "ms", "id", "author_id", "mentions", F.col("vec").cast("array<float>").alias("vec"),
                           F.lit(0).cast("bigint").alias("members"), F.lit(None).cast("array<string>").alias("authors"))
        if state is not None:
            going = rows.select(*CHAIN).distinct()
            rows = rows.unionByName(state.join(going, CHAIN, "left_semi"))
        before = F.when(F.col("ordinal") >= 0, 0).otherwise(1)
        streamed = rows.repartition(*[F.col(c) for c in CHAIN]).sortWithinPartitions(*CHAIN, before, "ordinal", "ms", "id")
        folded = streamed.mapInPandas(kernel, _FOLD_SCHEMA)
        # what was folded is kept also where one round does, so that no reader folds it again
        folded = cut(folded)
        if rounds > 1:
            state = folded.filter("id is null").select(
                *CHAIN, "ordinal", F.col("last_ms").alias("ms"), F.col("root_id").alias("id"), F.lit(None).cast("string").alias("author_id"),
                F.lit(None).cast("array<string>").alias("mentions"), F.col("centroid").alias("vec"), "members", "authors")
        placed = folded.filter("id is not null").select("channel_id", "block_no", "id", "root_id")
        found = placed if found is None else found.unionByName(placed)
    return found


def centroids(members: DataFrame, dim: int, key: str = "root_id") -> DataFrame:
    """Mean vector per cluster, from one row per member with its ``vec``.

    The running mean of the fold equals this up to rounding. Sums are combined
    map-side, so a huge cluster shuffles one row per task.
    """
    sums = [F.avg(F.element_at("vec", i + 1)).alias(f"_d{i}") for i in range(dim)]
    means = members.groupBy(key).agg(F.count("*").alias("members"), *sums)
    return means.select(key, "members", F.array(*[f"_d{i}" for i in range(dim)]).alias("centroid"))


def subcluster_spans(members: DataFrame) -> DataFrame:
    """Size and span per sub-cluster, with its only message when it has just one."""
    return members.groupBy("channel_id", "block_no", "root_id").agg(
        F.count("*").alias("members"), F.min("created_at").alias("start_at"),
        F.max("created_at").alias("end_at"),
    )


def resolve_replies(blocks: DataFrame, messages: DataFrame, resolve_written: bool = False) -> DataFrame:
    """Replies of this run that resolve, and to what.

    A target counts if it was clustered before the run (then its discussion is
    known), or if it sits in an earlier closed block of the same channel.
    Returns id, target_id, target_discussion_id (null for a target of this run).
    """
    states = [1, 3] if resolve_written else [1]
    replies = blocks.filter("closed and reply_to_message_id is not null").select(
        "id", "channel_id", "block_no", F.col("reply_to_message_id").alias("target_id"))
    old = messages.filter(F.col("processed").isin(states)).select(
        F.col("id").alias("target_id"), F.col("discussion_id").alias("target_discussion_id"))
    now = blocks.filter("closed").select(
        F.col("id").alias("target_id"), F.col("channel_id").alias("_ch"), F.col("block_no").alias("_b"))
    known = old.select("target_id", "target_discussion_id", F.lit(None).cast("string").alias("_ch"),
                       F.lit(None).cast("bigint").alias("_b")).unionByName(
        now.select("target_id", F.lit(None).cast("string").alias("target_discussion_id"), "_ch", "_b"))
    earlier = (F.col("_ch") == F.col("channel_id")) & (F.col("_b") < F.col("block_no"))
    return replies.join(known, "target_id").filter(
        F.col("target_discussion_id").isNotNull() | F.coalesce(earlier, F.lit(False))
    ).select("id", "target_id", "target_discussion_id")


def _cluster_nodes(members: DataFrame, replies: DataFrame) -> DataFrame:
    """One row per sub-cluster: size, first reply in time and its target."""
    m = members.join(replies, "id", "left")
    has = F.col("target_id").isNotNull()
    when = F.when(has, F.struct("created_at", "id"))
    return m.groupBy("channel_id", "block_no", "root_id").agg(
        F.count("*").alias("members"),
        F.min_by("target_id", when).alias("target_id"),
        F.min_by("target_discussion_id", when).alias("target_discussion_id"),
    )


def absorb_lone_replies(members: DataFrame, replies: DataFrame) -> DataFrame:
    """Lone long replies, which join the discussion of their target: root_id and target."""
    lone = (F.col("members") == 1) & F.col("target_id").isNotNull()
    return _cluster_nodes(members, replies).filter(lone).select(
        F.col("root_id").alias("id"), "target_id", "target_discussion_id")


def continuations(members: DataFrame, replies: DataFrame) -> DataFrame:
    """Sub-clusters of two or more that continue the target of their first reply."""
    linked = (F.col("members") >= 2) & F.col("target_id").isNotNull()
    return _cluster_nodes(members, replies).filter(linked).select(
        "channel_id", "block_no", "root_id", "target_id", "target_discussion_id")


def place_messages(blocks: DataFrame, members: DataFrame, replies: DataFrame) -> DataFrame:
    """Node of every message of a closed block before reply targets are followed.

    long            -> its sub-cluster
    short reply     -> itself, linked to the target
    other short     -> node of the last placed message of the block; the first
                       short message with nothing placed before it opens one
    Returns the block columns with node, is_long, target columns and ``placed``.
    """
    rows = (
        blocks.filter("closed")
        .join(members.select("id", "root_id"), "id", "left")
        .join(replies, "id", "left")
    )
    is_long = F.col("root_id").isNotNull()
    plain = ~is_long & F.col("target_id").isNull()
    # the first plain short message of a block opens a node if no long one came before
    cand = scan(
        rows.withColumn("is_long", is_long).withColumn("plain", plain),
        ["channel_id", "block_no"], ORDER,
        sums={"_n_plain": F.when(plain, 1).otherwise(0)},
        prev={"_prev_long": F.col("root_id")},
    )
    # the opener is the block's first plain message; without a long one before it, it stands alone
    opens = F.col("plain") & F.col("_prev_long").isNull() & (F.col("_n_plain") == 1)
    opener = cand.filter(opens).select(
        "channel_id", "block_no", F.col("id").alias("_opener"))
    joined = cand.join(opener, ["channel_id", "block_no"], "left")
    node = (
        F.when(F.col("is_long"), F.col("root_id"))
        .when(~F.col("plain"), F.col("id"))
        .otherwise(F.coalesce("_prev_long", "_opener"))
    )
    return joined.select(*rows.columns, "is_long", "plain", node.alias("node"))


def follow_targets(placed: DataFrame, members: DataFrame, replies: DataFrame) -> DataFrame:
    """Final root per message: an existing discussion or the message that starts a new one.

    Only reply nodes carry links, so the pointer table has one row per lone reply
    cluster or short reply. Chains are closed by pointer doubling.
    Returns id, root (``d:<discussion>`` or ``m:<message>``), home.
    """
    lone = absorb_lone_replies(members, replies).select(F.col("id").alias("node"), "target_id",
                                                        "target_discussion_id")
    short = placed.filter(~F.col("is_long") & F.col("target_id").isNotNull()).select(
        "node", "target_id", "target_discussion_id")
    links = lone.unionByName(short)
    # many replies share a target: look each target up once
    targets = links.filter("target_discussion_id is null").select("target_id").distinct()
    target_node = targets.join(
        placed.select(F.col("id").alias("target_id"), F.col("node").alias("_tn")), "target_id")
    next_node = F.when(F.col("target_discussion_id").isNotNull(),
                       F.concat(F.lit("d:"), "target_discussion_id")).otherwise(
        F.concat(F.lit("m:"), "_tn"))
    table = links.join(target_node, "target_id", "left").select(
        F.concat(F.lit("m:"), "node").alias("node"), next_node.alias("next"))
    roots = chase(table)
    keyed = placed.withColumn("_k", F.concat(F.lit("m:"), "node"))
    return keyed.join(roots, F.col("_k") == roots["node"], "left").select(
        placed["id"], "channel_id", "block_no", "created_at", "is_long", "plain", placed["node"],
        F.coalesce("root", "_k").alias("root"))


def discussion_key(channel: Column, root: Column) -> Column:
    """Id of a discussion: known id for ``d:``, else a hash of channel and first message."""
    return F.when(root.startswith("d:"), F.substring(root, 3, 1_000_000)).otherwise(
        F.md5(F.concat_ws("|", channel, F.substring(root, 3, 1_000_000))))


def attach_short(blocks: DataFrame, members: DataFrame, replies: DataFrame) -> DataFrame:
    """Discussion of every message in a closed block: id, channel_id, block_no, discussion_id.

    The channel of a new discussion is that of its first message, so a reply into
    another channel's discussion keeps that id.
    """
    placed = cut(place_messages(blocks, members, replies))
    roots = follow_targets(placed, members, replies)
    return roots.withColumn("discussion_id", discussion_key(F.col("channel_id"), F.col("root")))


def build_discussions(
    assigned: DataFrame, members: DataFrame, replies: DataFrame, vectors: DataFrame | None = None,
    dim: int = 64,
) -> DataFrame:
    """Rows of the discussions opened by this run: span, size, centroid, continuation.

    The span covers the members of the discussion's own block. Messages that joined
    by a reply count later, as a bump (``discussion_bumps``).
    """
    own = assigned.filter(F.col("root").startswith("m:") & (F.concat(F.lit("m:"), "node") == F.col("root")))
    rows = own.groupBy("discussion_id", "channel_id", F.col("node").alias("root_id")).agg(
        F.min("created_at").alias("block_start_at"), F.max("created_at").alias("block_end_at"),
        F.count("*").alias("message_count"),
    )
    cont = continuations(members, replies).select("root_id", "target_id", "target_discussion_id")
    in_run = assigned.select(F.col("id").alias("target_id"), F.col("discussion_id").alias("_td"))
    cont = cont.join(in_run, "target_id", "left").select(
        "root_id", F.coalesce("target_discussion_id", "_td").alias("continuation_of_discussion_id"))
    out = rows.join(cont, "root_id", "left").withColumn(
        "continuation_reason",
        F.when(F.col("continuation_of_discussion_id").isNotNull(), F.lit("explicit_reply")))
    if vectors is None:
        return out
    means = centroids(members.join(vectors, "id"), dim).select("root_id", "centroid")
    return out.join(means, "root_id", "left")


def discussion_bumps(assigned: DataFrame) -> DataFrame:
    """Messages that joined a discussion from elsewhere by a reply: id and how many."""
    own = F.concat(F.lit("m:"), "node") == F.col("root")
    return assigned.filter(~own).groupBy("discussion_id").agg(F.count("*").alias("bump"))


def thread_discussions(threads: DataFrame, discussions: DataFrame) -> DataFrame:
    """One discussion per thread; a thread already known extends its parent row."""
    known = discussions.filter("thread_id is not null and parent_discussion_id is null").groupBy(
        "thread_id").agg(F.min("id").alias("_known"))
    grouped = threads.groupBy("channel_id", "thread_id").agg(
        F.count("*").alias("message_count"), F.min("created_at").alias("block_start_at"),
        F.max("created_at").alias("block_end_at"),
        F.min_by("id", F.struct("created_at", "id")).alias("first_id"),
    )
    fresh = F.md5(F.concat_ws("|", "channel_id", "first_id"))
    return grouped.join(known, "thread_id", "left").select(
        F.coalesce("_known", fresh).alias("discussion_id"), "channel_id", "thread_id",
        "block_start_at", "block_end_at", "message_count", F.col("_known").isNotNull().alias("is_extension"),
    )


def apply_clusters(
    state: dict[str, DataFrame], opened: DataFrame, bumps: DataFrame, threads: DataFrame,
    assigned: DataFrame, thread_members: DataFrame,
) -> dict[str, DataFrame]:
    """Write one clustering run into the discussion and message tables.

    New rows start as ``clustering``; rows that grew turn to ``needs_reenrichment``
    and add the new messages to their count. Messages become processed.
    """
    d = state["discussions"]
    bumped = opened.join(bumps, "discussion_id", "left")
    new_main = bumped.select(
        F.col("discussion_id").alias("id"), "channel_id", F.lit(None).cast("string").alias("thread_id"),
        "block_start_at", "block_end_at",
        F.when(F.col("bump").isNotNull(), F.lit("needs_reenrichment")).otherwise(
            F.lit("clustering")).alias("status"),
        (F.col("message_count") + F.coalesce("bump", F.lit(0))).alias("message_count"),
        (F.col("centroid").cast("array<float>") if "centroid" in bumped.columns
         else F.lit(None).cast("array<float>")).alias("centroid"),
        "continuation_of_discussion_id", "continuation_reason",
        F.lit(None).cast("string").alias("parent_discussion_id"),
    )
    nul = F.lit(None).cast("string")
    new_thread = threads.filter(~F.col("is_extension")).select(
        F.col("discussion_id").alias("id"), "channel_id", "thread_id", "block_start_at", "block_end_at",
        F.lit("clustering").alias("status"), "message_count",
        F.lit(None).cast("array<float>").alias("centroid"),
        nul.alias("continuation_of_discussion_id"), nul.alias("continuation_reason"),
        nul.alias("parent_discussion_id"),
    )
    grown = threads.filter("is_extension").select(
        "discussion_id", F.col("message_count").alias("add"), F.col("block_end_at").alias("new_end")
    ).unionByName(bumps.select("discussion_id", F.col("bump").alias("add"),
                               F.lit(None).cast("timestamp").alias("new_end")))
    grown = grown.groupBy(F.col("discussion_id").alias("id")).agg(
        F.sum("add").alias("_add"), F.max("new_end").alias("_end"))
    old = d.join(grown, "id", "left").withColumn(
        "status", F.when(F.col("_add").isNotNull(), F.lit("needs_reenrichment")).otherwise(F.col("status"))
    ).withColumn("message_count", F.col("message_count") + F.coalesce("_add", F.lit(0))).withColumn(
        "block_end_at", F.coalesce("_end", "block_end_at")).select(*d.columns)
    placed = assigned.select("id", F.col("discussion_id").alias("_d")).unionByName(
        thread_members.select("id", F.col("discussion_id").alias("_d")))
    m = state["messages"]
    messages = m.join(placed, "id", "left").withColumn(
        "processed", F.when(F.col("_d").isNotNull(), F.lit(1)).otherwise(F.col("processed"))
    ).withColumn("discussion_id", F.coalesce("_d", "discussion_id")).select(*m.columns)
    return {
        **state,
        "discussions": old.unionByName(new_main.select(*d.columns)).unionByName(
            new_thread.select(*d.columns)),
        "messages": messages,
    }


def advance_checkpoints(checkpoints: DataFrame, blocks: DataFrame, now) -> DataFrame:
    """Last closed block end per channel, over the checkpoints known so far."""
    from parley.operators.ingest import as_ts, upsert

    ends = blocks.filter("closed").groupBy(F.col("channel_id")).agg(F.max("block_end_at").alias("end_at"))
    hit = F.col("n._has")
    return upsert(checkpoints, ends, "channel_id", {
        "last_closed_block_end_at": F.coalesce("n.end_at", "e.last_closed_block_end_at"),
        "updated_at": F.when(hit, as_ts(now)).otherwise(F.col("e.updated_at")),
    })


def cluster_summary(
    blocks: DataFrame, opened: DataFrame, threads: DataFrame
) -> DataFrame:
    """Per channel: messages processed, discussions new and extended, messages still open."""
    n = F.lit(0).cast("bigint")
    cols = ["processed", "new_discussions", "extended_discussions", "skipped_open"]

    def tag(df, **values):
        return df.select("channel_id", *[values.get(c, n).cast("bigint").alias(c) for c in cols])

    closed = F.col("closed").cast("bigint")
    ext = F.col("is_extension").cast("bigint")
    parts = (
        tag(blocks, processed=closed, skipped_open=1 - closed)
        .unionByName(tag(opened, new_discussions=F.lit(1)))
        .unionByName(tag(threads, processed=F.col("message_count"), new_discussions=1 - ext,
                         extended_discussions=ext))
    )
    return parts.groupBy("channel_id").agg(*[F.sum(c).alias(c) for c in cols])


def cluster_channels(
    state: dict[str, DataFrame], vectors: DataFrame, now, gap_minutes: float = 30, word_limit: int = 6,
    tau: float = DEFAULTS["tau"], idle_minutes: float = 15, max_messages: int | None = None,
    dim: int = DEFAULTS["dim"],
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run segmentation and clustering over all channels and write the state.

    ``vectors`` holds (id, vec) of the long messages. ``max_messages`` bounds what one
    run takes of a channel. A block that it cuts is processed as far as taken, and the
    rest in later runs: closed or open is judged by the newest message of the channel,
    taken or not, so a channel is always emptied in a bounded number of runs.
    """
    from parley.operators.segment import (
        channel_max, closed_blocks, long_messages, scan_unprocessed, split_threads, time_blocks,
    )

    # texts play no part here: they would pass every scan and join of the blocks
    messages = state["messages"].drop("content")
    scanned = scan_unprocessed(messages, max_messages)
    main, threads = split_threads(scanned)
    blocks = cut(closed_blocks(time_blocks(main, gap_minutes), channel_max(messages), gap_minutes))
    replies = cut(resolve_replies(blocks, messages))
    longs = long_messages(blocks.filter("closed"), word_limit)
    found = subcluster(longs.join(vectors, "id"), tau, idle_minutes)
    members = cut(longs.select("id", "created_at").join(found, "id"))
    assigned = cut(attach_short(blocks, members, replies))
    opened = cut(build_discussions(assigned, members, replies, vectors, dim))
    bumps = discussion_bumps(assigned)
    per_thread = cut(thread_discussions(threads, state["discussions"]))
    in_threads = threads.join(
        per_thread.select("channel_id", "thread_id", F.col("discussion_id").alias("_td")),
        ["channel_id", "thread_id"]).select("id", F.col("_td").alias("discussion_id"))
    out = apply_clusters(state, opened, bumps, per_thread, assigned, in_threads)
    out["channel_checkpoints"] = advance_checkpoints(state["channel_checkpoints"], blocks, now)
    return out, cluster_summary(blocks, opened, per_thread)
