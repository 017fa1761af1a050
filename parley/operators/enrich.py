"""Batch inference over discussions: queue, prompts, packing, mapping, persistence."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import schemas
from parley.functions.text import author_label, ceil_div, clip, message_line, trim_ws
from parley.operators.ingest import as_ts
from parley.operators.ordered import mark_reachable, row_index, scan
from parley.schemas import DEFAULTS

# fixed values: system prompt of the enrichment call
SYSTEM_PROMPT = (
    "You read clusters of chat messages and describe each coherent discussion in them. "
    "Return JSON with a non-empty list 'segments'; give message_ids only when a cluster "
    "holds several unrelated discussions, and set source_cluster on batched input."
)
# fixed values: token estimate
CHARS_PER_TOKEN = 3.5
TOKENS_PER_DISCUSSION = 40


def with_author_label(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with the best known label of their author."""
    u = users.select(F.col("id").alias("author_id"), "username", "display_name")
    return messages.join(u, "author_id", "left").withColumn(
        "author_label", author_label(F.col("display_name"), F.col("username"), F.col("author_id"))).drop("username", "display_name")


def discussion_messages(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages of discussions with the best known author label."""
    return with_author_label(messages.filter("discussion_id is not null"), users).select(
        "discussion_id", "id", "author_id", "author_label", "created_at", "content")


def enrich_queue(
    discussions: DataFrame, messages: DataFrame, max_discussions: int | None = None
) -> DataFrame:
    """Discussions awaiting enrichment, oldest block first, at most N per channel.

    ``messages`` is the message count, 0 where the discussion is empty and will be
    skipped; ``pos`` is the place in the channel's queue.
    """
    waiting = discussions.filter(F.col("status").isin("clustering", "needs_reenrichment")).select(
        "id", "channel_id", "thread_id", "status", "block_start_at")
    queued = row_index(waiting, ["channel_id"], ["block_start_at", "id"], "pos")
    if max_discussions is not None:
        queued = queued.filter(F.col("pos") <= max_discussions)
    counts = messages.groupBy(F.col("discussion_id").alias("id")).agg(F.count("*").alias("messages"))
    return queued.join(counts, "id", "left").fillna(0, ["messages"])


def render_line(msgs: DataFrame) -> DataFrame:
    """Add the prompt line of each message."""
    return msgs.withColumn("line", message_line(
        F.col("id"), F.col("author_label"), F.col("created_at"), F.col("content")))


def _first_lines(msgs: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` messages per discussion; the cut happens before the shuffle."""
    w = Window.partitionBy("discussion_id").orderBy("created_at", "id")
    return msgs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def _joined_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of at most one prompt's messages in order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("rn", "line")))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("body"))


def render_prompts(msgs: DataFrame, max_messages: int = DEFAULTS["max_messages_per_call"]) -> DataFrame:
    """Prompts of one discussion: parts of at most ``max_messages`` messages, every message in one.

    Returns discussion_id, part (from 1), messages (of the whole discussion), prompt. A header
    tells which part it is where there are several. Positions come from an ordered scan, so a
    long discussion is no single task's work.
    """
    lines = scan(render_line(msgs).select("discussion_id", "created_at", "id", "line"), ["discussion_id"],
                 ["created_at", "id"], sums={"rn": F.lit(1).cast("bigint")}).withColumn(
        "part", F.floor((F.col("rn") - 1) / F.lit(max_messages)) + 1)
    bodies = _joined_lines(lines, ["discussion_id", "part"])
    totals = msgs.groupBy("discussion_id").agg(F.count("*").alias("messages"))
    parts = F.ceil(F.col("messages") / F.lit(max_messages)).cast("string")
    header = F.when(F.col("messages") > max_messages, F.concat(
        F.lit("Part "), F.col("part").cast("string"), F.lit(" of "), parts, F.lit(" of one discussion ("),
        F.col("messages").cast("string"), F.lit(" "), messages_word(F.col("messages")), F.lit(").\n\n"))).otherwise(F.lit(""))
    return bodies.join(totals, "discussion_id").select(
        "discussion_id", "part", "messages", F.concat(header, "body").alias("prompt"))


def messages_word(n: Column) -> Column:
    """The word for a number of messages."""
    return F.when(n == 1, F.lit("message")).otherwise(F.lit("messages"))


def render_batch_prompts(
    batches: DataFrame, msgs: DataFrame, max_messages: int = DEFAULTS["max_messages_per_call"]
) -> DataFrame:
    """Prompt of each batch: one delimited block per discussion under a shared budget.

    ``batches``: batch_id, label_no (from 1), discussion_id. A block past the budget
    is cut with a note, or shown as its header only.
    """
    totals = msgs.groupBy("discussion_id").agg(F.count("*").alias("total"))
    spent = Window.partitionBy("batch_id").orderBy("label_no").rowsBetween(Window.unboundedPreceding, -1)
    sized = batches.join(totals, "discussion_id", "left").fillna(0, ["total"])
    # the budget left never drops below 0, so it is what the earlier totals leave of it
    left = F.greatest(F.lit(0), F.lit(max_messages) - F.coalesce(F.sum("total").over(spent), F.lit(0)))
    shown = sized.withColumn("shown", F.least("total", left))
    lines = render_line(_first_lines(msgs, max_messages)).select("discussion_id", "rn", "line")
    kept = shown.join(lines, "discussion_id").filter("rn <= shown")
    bodies = _joined_lines(kept, ["batch_id", "label_no"])
    hidden = F.col("total") - F.col("shown")
    n = F.col("total").cast("string")
    head = F.concat(F.lit("=== CLUSTER c"), F.col("label_no").cast("string"), F.lit(" · "), n,
                    F.lit(" "), messages_word(F.col("total")), F.lit(" ==="))
    over = F.lit(" not shown, the call is full)")
    none = F.concat(head, F.lit("\n("), n, F.lit(" "), messages_word(F.col("total")), over)
    note = F.when(hidden > 0, F.concat(F.lit("\n(another "), hidden.cast("string"), F.lit(" "),
                                       messages_word(hidden), over)).otherwise(F.lit(""))
    block = F.when(F.col("shown") == 0, none).otherwise(F.concat(head, F.lit("\n"), "body", note))
    blocks = shown.join(bodies, ["batch_id", "label_no"], "left").withColumn("block", block)
    ordered = F.array_sort(F.collect_list(F.struct("label_no", "block")))
    text = F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n")
    intro = F.concat(F.lit("This call holds "), F.count("*").cast("string"), F.lit(
        ' separate clusters. Judge each by itself, and give its mark as "source_cluster" with every segment.\n\n'))
    return blocks.groupBy("batch_id").agg(
        F.count("*").alias("discussions"), F.sum("total").alias("messages"),
        F.concat(intro, text).alias("prompt"))


def estimate_tokens(msgs: DataFrame) -> DataFrame:
    """Estimated prompt tokens and message count per discussion."""
    chars = F.sum(F.length("line") + 2)
    return render_line(msgs).groupBy("discussion_id").agg(
        (ceil_div(chars, CHARS_PER_TOKEN) + TOKENS_PER_DISCUSSION).alias("tokens"),
        F.count("*").alias("messages"))


def pack_batches(
    queue: DataFrame,
    target_tokens: int = DEFAULTS["batch_target_tokens"],
    max_discussions: int = DEFAULTS["batch_max_discussions"],
    max_messages: int = DEFAULTS["max_messages_per_call"],
    stripe: int = 4096,
) -> DataFrame:
    """Next-fit packing of each channel's queue (channel_id, block_start_at, id, tokens, messages).

    A batch starting at a position ends where a cap is first exceeded, which running
    totals tell for every position at once; batches are then the positions reached
    from the first one by these jumps. So a queue of any length packs in parallel.
    Returns the queue with pos (from 0), batch_no (from 1) and label_no (from 1).
    """
    if max_discussions < 1 or max_messages < 1:
        raise ValueError("max_discussions and max_messages must be positive")
    order = ["block_start_at", "id"]
    tot = scan(queue, ["channel_id"], order, sums={
        "_i": F.lit(1).cast("bigint"), "_t": F.col("tokens").cast("bigint"),
        "_m": F.col("messages").cast("bigint")})
    rows = tot.withColumn("pos", F.col("_i") - 1).drop("_i")
    if target_tokens <= 0:
        return rows.drop("_t", "_m").withColumn("batch_no", F.col("pos") + 1).withColumn(
            "label_no", F.lit(1).cast("bigint"))
    ahead = max_discussions - 1
    # stripes of positions, each followed by copies of the rows a jump may look at
    slim = rows.select("channel_id", "pos", "_t", "_m", "tokens", "messages").withColumn(
        "_s", F.explode(F.expr(
            f"array_distinct(array(pos div {stripe}, greatest(0, pos - {ahead}) div {stripe}))")))
    view = Window.partitionBy("channel_id", "_s").orderBy("pos").rowsBetween(1, max(1, ahead))
    seen = slim.withColumn("_next", F.collect_list(F.struct("_t", "_m")).over(view))
    own = seen.filter(F.expr(f"_s = pos div {stripe}"))
    start_t, start_m = F.col("_t") - F.col("tokens"), F.col("_m") - F.col("messages")
    fits = F.filter("_next", lambda x: (x["_t"] - start_t <= target_tokens) & (
        x["_m"] - start_m <= max_messages))
    step = F.least(F.lit(max_discussions), F.size(fits) + 1)
    jumps = own.select("channel_id", "pos", (F.col("pos") + step).alias("nxt"))
    last = rows.groupBy("channel_id").agg(F.max("pos").alias("_last"))
    jumps = jumps.join(last, "channel_id").filter("nxt <= _last").drop("_last")
    starts = rows.groupBy("channel_id").agg(F.min("pos").alias("pos"))
    heads = mark_reachable(jumps, starts, ["channel_id"]).distinct().withColumn("_head", F.lit(1))
    flagged = rows.join(heads, ["channel_id", "pos"], "left").drop("_t", "_m")
    out = scan(flagged, ["channel_id"], ["pos"],
               sums={"batch_no": F.coalesce("_head", F.lit(0)).cast("bigint")},
               prev={"_prev_start": F.when(F.col("_head") == 1, F.col("pos"))})
    start = F.when(F.col("_head") == 1, F.col("pos")).otherwise(F.col("_prev_start"))
    return out.withColumn("label_no", F.col("pos") - start + 1).drop("_head", "_prev_start")


# --- model calls -----------------------------------------------------------------


def infer(
    calls: DataFrame, infer_fn: Callable[[str, str, str], str], system: str, schema_name: str,
    response_ddl: str, valid: Callable[[Column], Column], parallel: int | None = None,
) -> DataFrame:
    """One structured call per row of ``calls`` (column ``prompt``).

    ``infer_fn(system, user, schema_name)`` returns JSON text, or (text, prompt
    tokens, completion tokens); an exception or a reply that does not validate
    marks the call as failed. ``parallel`` bounds the number of concurrent calls.
    Adds raw, value, status, error, duration_ms, prompt_tokens, completion_tokens.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema]
    schema = ", ".join([*fields, "raw string", "error string", "duration_ms bigint",
                        "prompt_tokens bigint", "completion_tokens bigint"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raws, errors, times, p_tok, c_tok = [], [], [], [], []
            for prompt in pdf["prompt"]:
                began = time.perf_counter()
                raw, err, pt, ct = None, None, None, None
                try:
                    reply = infer_fn(system, prompt, schema_name)
                    raw, pt, ct = reply if isinstance(reply, tuple) else (reply, None, None)
                except Exception as e:  # noqa: BLE001 - any failure of the model is a failed call
                    err = str(e) or type(e).__name__
                raws.append(raw)
                errors.append(err)
                p_tok.append(pt)
                c_tok.append(ct)
                times.append(round((time.perf_counter() - began) * 1000))
            yield pdf.assign(
                raw=raws, error=errors, duration_ms=times,
                prompt_tokens=pd.array(p_tok, dtype="Int64"),
                completion_tokens=pd.array(c_tok, dtype="Int64"))

    work = calls.repartition(parallel) if parallel else calls
    called = work.mapInPandas(run, schema)
    parsed = called.withColumn("value", F.from_json("raw", response_ddl))
    ok = F.col("error").isNull() & F.coalesce(valid(F.col("value")), F.lit(False))
    return parsed.withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("error"))).withColumn(
        "error", F.when(ok, F.lit(None).cast("string")).otherwise(
            F.coalesce("error", F.lit("reply does not match the schema"))))


def valid_segments(v: Column) -> Column:
    """Constraint check of an enrichment reply: at least one segment, all well formed."""
    def good(s: Column) -> Column:
        return (
            s["title"].isNotNull() & s["summary"].isNotNull() & s["topics"].isNotNull()
            & s["entities"].isNotNull() & s["key_points"].isNotNull() & s["message_ids"].isNotNull()
            & s["language"].isNotNull() & s["sentiment"].isin(schemas.SENTIMENTS)
            & s["sentiment_score"].between(-1, 1) & s["discussion_type"].isin(schemas.DISCUSSION_TYPES)
        )
    segments = v["segments"]
    return (F.size(segments) >= 1) & F.forall(segments, lambda s: F.coalesce(good(s), F.lit(False)))


def infer_segments(calls: DataFrame, infer_fn, parallel: int | None = None) -> DataFrame:
    return infer(calls, infer_fn, SYSTEM_PROMPT, "discussion_enrichment",
                 schemas.SEGMENTS_RESPONSE, valid_segments, parallel)


def infer_with_retry(
    batches: DataFrame, members: DataFrame, msgs: DataFrame, infer_fn,
    max_messages: int = DEFAULTS["max_messages_per_call"],
) -> DataFrame:
    """Call every batch; a failed batch of several discussions is retried one by one.

    ``batches``: batch_id, discussions, prompt, and part where a batch has several prompts.
    ``members``: batch_id, label_no, discussion_id. Every call is made once and stored: prompts and
    replies are wide, and most readers take neither. Returns calls with call_id, batch_id, part,
    attempt (batch or solo) and discussion_id (set on solo calls).
    """
    from parley.session import stored

    part = F.col("part") if "part" in batches.columns else F.lit(1)
    first = stored(infer_segments(batches.select("batch_id", part.cast("bigint").alias("part"), "discussions", "prompt"), infer_fn))
    failed = first.filter("status = 'error' and discussions > 1").select("batch_id")
    solo_of = members.join(failed, "batch_id", "left_semi").select("batch_id", "discussion_id")
    prompts = render_prompts(msgs.join(solo_of.select("discussion_id"), "discussion_id", "left_semi"),
                             max_messages)
    solo = stored(infer_segments(
        solo_of.join(prompts, "discussion_id").select(
            "batch_id", "discussion_id", "part", F.lit(1).cast("bigint").alias("discussions"), "prompt"),
        infer_fn))
    return first.withColumn("discussion_id", F.lit(None).cast("string")).withColumn(
        "attempt", F.lit("batch")).withColumn("call_id", call_of(F.col("batch_id"))).unionByName(
        solo.withColumn("attempt", F.lit("solo")).withColumn(
            "call_id", call_of(F.concat_ws("/", "batch_id", "discussion_id"))))


def call_of(name: Column) -> Column:
    """Id of a call: its batch or discussion, and its part after the first."""
    return F.when(F.col("part") > 1, F.concat_ws("@", name, "part")).otherwise(name)


# --- mapping replies to messages ---------------------------------------------------


def map_segments(segments: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Give every returned segment to the discussions that own its messages.

    segments: call_id, seg_no, message_ids, source_cluster
    members:  discussion_id, message_id
    labels:   call_id, label, discussion_id
    A segment over several discussions is cut along ownership. One without usable
    ids falls to its labelled discussion, or to the only one of its call. Ids from
    outside the call are unusable.
    Returns call_id, seg_no, discussion_id, message_id (null for a whole-discussion segment).
    """
    ids = segments.select("call_id", "seg_no", F.explode("message_ids").alias("message_id"))
    owned = ids.distinct().join(members, "message_id").join(
        labels.select("call_id", "discussion_id"), ["call_id", "discussion_id"], "left_semi"
    ).select("call_id", "seg_no", "discussion_id", "message_id")
    lone = labels.groupBy("call_id").agg(
        F.count("*").alias("_n"), F.min("discussion_id").alias("_only")).filter("_n = 1")
    rest = segments.select("call_id", "seg_no", F.col("source_cluster").alias("label")).join(
        owned.select("call_id", "seg_no").distinct(), ["call_id", "seg_no"], "left_anti")
    back = rest.join(labels, ["call_id", "label"], "left").join(lone, "call_id", "left").select(
        "call_id", "seg_no", F.coalesce("discussion_id", "_only").alias("discussion_id"),
        F.lit(None).cast("string").alias("message_id")).filter("discussion_id is not null")
    return owned.unionByName(back)


def omitted(labels: DataFrame, mapped: DataFrame) -> DataFrame:
    """Discussions of a call that no segment reached; they get a call of their own."""
    return labels.join(mapped.select("call_id", "discussion_id").distinct(),
                       ["call_id", "discussion_id"], "left_anti")


def partition_messages(msgs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Give every message of a discussion to exactly one of its segments.

    msgs: discussion_id, id, created_at; mapped: discussion_id, seg_no, message_id.
    The first segment naming a message owns it. A message nobody named goes with
    the named message nearest in time, the earlier one on a tie. Where no segment
    names any message, the messages are cut into equal consecutive runs.
    Returns discussion_id, id, created_at, seg_no.
    """
    segs = mapped.groupBy("discussion_id", "seg_no").agg(F.count("message_id").alias("_named"))
    by_no = Window.partitionBy("discussion_id").orderBy("seg_no")
    numbered = segs.withColumn("seg_idx", F.row_number().over(by_no) - 1)
    per = numbered.groupBy("discussion_id").agg(F.count("*").alias("_k"), F.sum("_named").alias("_any"))
    named = mapped.filter("message_id is not null").groupBy(
        "discussion_id", F.col("message_id").alias("id")).agg(F.min("seg_no").alias("_seg"))
    totals = msgs.groupBy("discussion_id").agg(F.count("*").alias("_n"))
    base = msgs.select("discussion_id", "id", "created_at").join(per, "discussion_id").join(
        totals, "discussion_id").join(named, ["discussion_id", "id"], "left")
    # of named messages at one instant the first in order speaks for all of them
    instant = base.filter("_seg is not null").groupBy("discussion_id", "created_at").agg(
        F.min_by("_seg", "id").alias("_at_seg"))
    base = base.join(instant, ["discussion_id", "created_at"], "left")
    mark = F.when(F.col("_seg").isNotNull(), F.struct("created_at", F.col("_at_seg").alias("seg")))
    rows = scan(base, ["discussion_id"], ["created_at", "id"],
                sums={"_i": F.lit(1).cast("bigint")}, prev={"_p": mark}, following={"_f": mark})
    ms = F.unix_millis("created_at")
    back, ahead = ms - F.unix_millis("_p.created_at"), F.unix_millis("_f.created_at") - ms
    near = F.when(F.col("_f").isNull() | (back <= ahead), F.col("_p.seg")).otherwise(F.col("_f.seg"))
    chunk = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.col("_k")))
    run = F.least(F.col("_k") - 1, F.floor((F.col("_i") - 1) / chunk)).cast("int")
    chosen = F.when(F.col("_any") > 0, F.coalesce("_seg", near))
    placed = rows.select("discussion_id", "id", "created_at", chosen.alias("_s"), run.alias("seg_idx"))
    return placed.join(numbered.select("discussion_id", "seg_idx", "seg_no"),
                       ["discussion_id", "seg_idx"], "left").select(
        "discussion_id", "id", "created_at", F.coalesce("_s", "seg_no").alias("seg_no"))


def resolve_outcomes(partitioned: DataFrame, mapped: DataFrame) -> DataFrame:
    """Single or split per discussion, after empty segments are dropped.

    Returns one row per kept segment: discussion_id, kind, seg_no, messages, span.
    A single outcome keeps one segment, and all messages with it.
    """
    segs = mapped.select("discussion_id", "seg_no").distinct()
    filled = partitioned.groupBy("discussion_id", "seg_no").agg(
        F.count("*").alias("messages"), F.min("created_at").alias("start_at"),
        F.max("created_at").alias("end_at"))
    w = Window.partitionBy("discussion_id")
    live = segs.join(filled, ["discussion_id", "seg_no"], "left")
    n_live = F.count("messages").over(w)
    first = F.row_number().over(w.orderBy(F.col("messages").isNull(), "seg_no"))
    return live.withColumn("_n", n_live).withColumn("_r", first).withColumn(
        "kind", F.when(F.col("_n") > 1, F.lit("split")).otherwise(F.lit("single"))
    ).filter("(kind = 'split' and messages is not null) or (kind = 'single' and _r = 1)").select(
        "discussion_id", "kind", "seg_no", F.coalesce("messages", F.lit(0)).alias("messages"),
        "start_at", "end_at")


def embedding_text(title: Column, summary: Column, topics: Column) -> Column:
    """Text whose vector stands for a discussion; blank parts are dropped."""
    parts = F.array(title, summary, F.array_join(topics, ", "))
    trimmed = F.transform(parts, lambda x: trim_ws(F.coalesce(x, F.lit(""))))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), ". ")


# --- persistence -------------------------------------------------------------------


def child_id(parent: Column, seg_no: Column) -> Column:
    return F.md5(F.concat_ws("|", parent, seg_no.cast("string")))


def reset_enrichment(state: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Undo earlier enrichment of some discussions (column id).

    Messages of their children return to the parent; the children and all
    enrichment rows of parent and children go.
    """
    d, m, e = state["discussions"], state["messages"], state["discussion_enrichment"]
    kids = d.join(ids.select(F.col("id").alias("parent_discussion_id")), "parent_discussion_id",
                  "left_semi").select(F.col("id").alias("_kid"), F.col("parent_discussion_id").alias("_parent"))
    back = m.join(kids, F.col("discussion_id") == F.col("_kid"), "left")
    messages = back.withColumn("discussion_id", F.coalesce("_parent", "discussion_id")).select(*m.columns)
    gone = ids.select(F.col("id").alias("discussion_id")).unionByName(
        kids.select(F.col("_kid").alias("discussion_id")))
    return {
        **state,
        "messages": messages,
        "discussions": d.join(kids, d["id"] == F.col("_kid"), "left_anti"),
        "discussion_enrichment": e.join(gone, "discussion_id", "left_anti"),
    }


def apply_single(state: dict[str, DataFrame], enriched: DataFrame) -> dict[str, DataFrame]:
    """Store enrichment rows (schema of the enrichment table) of whole discussions."""
    e, d = state["discussion_enrichment"], state["discussions"]
    kept = e.join(enriched.select("discussion_id"), "discussion_id", "left_anti")
    done = enriched.select(F.col("discussion_id").alias("id"), F.lit(True).alias("_done"))
    status = F.when(F.col("_done"), F.lit("enriched")).otherwise(F.col("status"))
    return {
        **state,
        "discussion_enrichment": kept.unionByName(enriched.select(*e.columns)),
        "discussions": d.join(done, "id", "left").withColumn("status", status).select(*d.columns),
    }


def apply_split(
    state: dict[str, DataFrame], segments: DataFrame, assignments: DataFrame
) -> dict[str, DataFrame]:
    """Store split discussions.

    segments: parent_id, seg_no, messages, start_at, end_at and the enrichment
    columns; assignments: discussion_id (parent), id (message), seg_no.
    """
    e, d, m = state["discussion_enrichment"], state["discussions"], state["messages"]
    kid = child_id(F.col("parent_id"), F.col("seg_no"))
    parents = d.select(F.col("id").alias("parent_id"), "channel_id", "thread_id")
    nul = F.lit(None).cast("string")
    rows = segments.select("parent_id", "seg_no", "messages", "start_at", "end_at").join(
        parents, "parent_id").select(
        kid.alias("id"), "channel_id", "thread_id", F.col("start_at").alias("block_start_at"),
        F.col("end_at").alias("block_end_at"), F.lit("enriched").alias("status"),
        F.col("messages").cast("bigint").alias("message_count"),
        F.lit(None).cast("array<float>").alias("centroid"),
        nul.alias("continuation_of_discussion_id"), nul.alias("continuation_reason"),
        F.col("parent_id").alias("parent_discussion_id"))
    split = segments.select(F.col("parent_id").alias("id")).distinct().withColumn("_split", F.lit(True))
    old = d.join(split, "id", "left").withColumn(
        "status", F.when(F.col("_split"), F.lit("split")).otherwise(F.col("status"))).withColumn(
        "message_count", F.when(F.col("_split"), F.lit(0).cast("bigint")).otherwise(F.col("message_count"))
    ).select(*d.columns)
    moved = assignments.select(
        "id", child_id(F.col("discussion_id"), F.col("seg_no")).alias("_kid"))
    messages = m.join(moved, "id", "left").withColumn(
        "discussion_id", F.coalesce("_kid", "discussion_id")).select(*m.columns)
    enriched = segments.withColumn("discussion_id", kid).select(*e.columns)
    return {
        **state,
        "discussions": old.unionByName(rows.select(*d.columns)),
        "messages": messages,
        "discussion_enrichment": e.unionByName(enriched),
    }


def enrichment_view(discussions: DataFrame, enrichment: DataFrame, messages: DataFrame) -> DataFrame:
    """What enrichment produced, one row per segment.

    A split discussion lists its children in block order, another one lists itself
    if it is enriched; not yet enriched ones give no row.
    """
    d = discussions.select("id", "status", "parent_discussion_id", "block_start_at")
    kids = d.filter("parent_discussion_id is not null").select(
        F.col("id").alias("segment_id"), F.col("parent_discussion_id").alias("id"),
        F.col("block_start_at").alias("_at"))
    w = Window.partitionBy("id").orderBy("_at", "segment_id")
    split = d.filter("status = 'split'").select("id", "status").join(kids, "id").select(
        "id", "status", F.lit(None).cast("string").alias("parent_discussion_id"),
        F.lit(True).alias("split"), "segment_id", F.row_number().over(w).alias("segment_no"))
    e = enrichment.withColumnRenamed("discussion_id", "segment_id")
    whole = d.filter("status <> 'split'").select(
        "id", "status", "parent_discussion_id", F.lit(False).alias("split"),
        F.col("id").alias("segment_id"), F.lit(1).alias("segment_no")).join(e.select("segment_id"), "segment_id", "left_semi")
    counts = messages.groupBy(F.col("discussion_id").alias("segment_id")).agg(F.count("*").alias("messages"))
    return split.unionByName(whole).join(e, "segment_id", "left").join(
        counts, "segment_id", "left").fillna(0, ["messages"])


def enrich_summary(queue: DataFrame, calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Totals of one enrichment run."""
    q = queue.agg(F.count("*").alias("queued"), F.count_if(F.col("messages") == 0).alias("skipped_empty"))
    batch, solo = F.col("attempt") == "batch", F.col("attempt") == "solo"
    bad = F.col("status") == "error"
    c = calls.agg(
        F.count_if(batch).alias("batches"), F.count_if(solo).alias("individual_retries"),
        F.count_if(bad & (solo | (F.col("discussions") == 1))).alias("failed"))
    per = outcomes.groupBy("discussion_id").agg(F.max("kind").alias("kind"), F.count("*").alias("segs"))
    is_split = F.col("kind") == "split"
    o = per.agg(
        F.count_if(F.col("kind") == "single").alias("enriched"), F.count_if(is_split).alias("split"),
        F.coalesce(F.sum(F.when(is_split, F.col("segs"))), F.lit(0)).alias("segments"))
    one = F.lit(1).alias("_one")
    return q.select("*", one).join(c.select("*", one), "_one").join(o.select("*", one), "_one").drop("_one")


def inference_log(calls: DataFrame, provider: str, model: str, started_at, limit: int | None = None) -> DataFrame:
    """Log row per model call, with whole texts; ``limit`` clips them."""
    return calls.select(
        F.md5(F.concat_ws("|", "call_id", "context")).alias("id"),
        F.lit(provider).alias("provider"), F.lit(model).alias("model"), "context", "channel_id", "job_id",
        as_ts(started_at).alias("started_at"), "duration_ms", "status", "prompt_tokens",
        "completion_tokens", "error", clip(F.col("system_prompt"), limit).alias("system_prompt"),
        clip(F.col("prompt"), limit).alias("user_prompt"),
        F.when(F.col("status") == "ok", clip(F.col("raw"), limit)).alias("response"))


#: Segments that one reply holds at most, by far.
PART_SEGMENTS = 1 << 20


def enrich_channels(
    state: dict[str, DataFrame], infer_fn, embed_fn, now, max_discussions: int | None = None,
    target_tokens: int = DEFAULTS["batch_target_tokens"],
    max_per_batch: int = DEFAULTS["batch_max_discussions"],
    max_messages: int = DEFAULTS["max_messages_per_call"], provider: str = "local", model: str = "default",
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run enrichment over all channels: queue, pack, call, map, split, store, and log every call."""
    from parley.functions.vectors import embed
    from parley.session import cut, stored

    waiting = cut(enrich_queue(state["discussions"], state["messages"], max_discussions))
    redo = waiting.filter("status = 'needs_reenrichment'").select("id")
    state = reset_enrichment(state, redo)
    ids = waiting.select(F.col("id").alias("discussion_id"))
    msgs = stored(discussion_messages(state["messages"].join(ids, "discussion_id", "left_semi"), state["users"]))
    sizes = estimate_tokens(msgs).withColumnRenamed("discussion_id", "id")
    # counts after the reset, which may have brought messages back
    queue = cut(waiting.drop("messages", "pos").join(sizes, "id", "left").fillna(0, ["messages"]))
    packed = cut(pack_batches(queue.filter("messages > 0"), target_tokens, max_per_batch, max_messages))
    members = packed.select(
        F.concat_ws("#", "channel_id", F.col("batch_no").cast("string")).alias("batch_id"), "label_no",
        F.col("id").alias("discussion_id"))
    sized = members.withColumn("_n", F.count("*").over(Window.partitionBy("batch_id")))
    many = render_batch_prompts(sized.filter("_n > 1").drop("_n"), msgs, max_messages).select(
        "batch_id", "discussions", "prompt")
    alone = sized.filter("_n = 1").select("batch_id", "discussion_id")
    one = alone.join(render_prompts(
        msgs.join(alone.select("discussion_id"), "discussion_id", "left_semi"), max_messages),
        "discussion_id").select("batch_id", "part", F.lit(1).cast("bigint").alias("discussions"), "prompt")
    many = many.withColumn("part", F.lit(1).cast("bigint"))
    calls = infer_with_retry(many.unionByName(one), members, msgs, infer_fn, max_messages)

    def labels_of(c: DataFrame) -> DataFrame:
        batch = c.filter("attempt = 'batch'").select("call_id", "batch_id").join(members, "batch_id").select(
            "call_id", F.concat(F.lit("c"), F.col("label_no").cast("string")).alias("label"), "discussion_id")
        return batch.unionByName(c.filter("attempt <> 'batch'").select(
            "call_id", F.lit("c1").alias("label"), "discussion_id"))

    owners = msgs.select("discussion_id", F.col("id").alias("message_id"))

    def segments_of(c: DataFrame) -> DataFrame:
        # segments are numbered through all parts of a discussion
        return c.filter("status = 'ok'").select("call_id", "part", F.posexplode("value.segments").alias(
            "_no", "s")).select("call_id", ((F.col("part") - 1) * PART_SEGMENTS + F.col("_no")).alias("seg_no"), "s.*")

    good = calls.filter("status = 'ok'")
    mapped = cut(map_segments(segments_of(calls), owners, labels_of(good)))
    left_out = omitted(labels_of(good), mapped).select("call_id", "discussion_id")
    extra = infer_segments(
        left_out.join(render_prompts(msgs.join(left_out.select("discussion_id"), "discussion_id", "left_semi"),
                                     max_messages), "discussion_id").select(
            call_of(F.concat_ws("/", "call_id", "discussion_id", F.lit("solo"))).alias("call_id"), "discussion_id", "part",
            F.lit(1).cast("bigint").alias("discussions"), "prompt"), infer_fn)
    extra = stored(extra.withColumn("attempt", F.lit("omitted")).withColumn("batch_id", F.lit(None).cast("string")))
    all_calls = calls.unionByName(extra)
    mapped = cut(mapped.unionByName(map_segments(
        segments_of(extra), owners, labels_of(extra.filter("status = 'ok'")))))
    placed = cut(partition_messages(msgs, mapped.select("discussion_id", "seg_no", "message_id")))
    outcomes = cut(resolve_outcomes(placed, mapped))
    source = mapped.select("call_id", "discussion_id", "seg_no").distinct().withColumnRenamed(
        "discussion_id", "parent_id")
    # narrow rows meet first, so a segment's text is moved once
    full = source.join(outcomes.withColumnRenamed("discussion_id", "parent_id"), ["parent_id", "seg_no"]).join(
        segments_of(all_calls).drop("message_ids", "source_cluster"), ["call_id", "seg_no"])
    text = embedding_text(F.col("title"), F.col("summary"), F.col("topics"))
    kept = stored(embed(full.withColumn("_text", text), "_text", embed_fn).drop("_text"))
    # a reply goes to each of its segments where it is written: it is moved once per call, not per segment
    replies = all_calls.filter("status = 'ok'").select("call_id", F.col("raw").alias("raw_response"))
    ready = kept.join(replies, "call_id").withColumn("enriched_at", as_ts(now))
    singles = ready.filter("kind = 'single'").withColumnRenamed("parent_id", "discussion_id")
    state = apply_single(state, singles)
    splits = ready.filter("kind = 'split'")
    moved = placed.join(kept.filter("kind = 'split'").select(F.col("parent_id").alias("discussion_id")).distinct(),
                        "discussion_id", "left_semi")
    state = apply_split(state, splits, moved)
    channel = F.substring_index(F.col("call_id"), "#", 1)
    log = inference_log(all_calls.select(
        "call_id", F.concat(F.lit("enrich "), "call_id").alias("context"), channel.alias("channel_id"), F.lit("enrich").alias("job_id"),
        "duration_ms", "status", "prompt_tokens", "completion_tokens", "error", F.lit(SYSTEM_PROMPT).alias("system_prompt"),
        "prompt", "raw"), provider, model, now)
    state["inference_log"] = state["inference_log"].unionByName(log) if "inference_log" in state else log
    return state, enrich_summary(queue, all_calls, outcomes)
