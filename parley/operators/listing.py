"""Listings, keyset pages and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import author_label, iso
from parley.operators.ingest import as_ts


def filter_eq(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters, all must hold; None means any. They reach the parquet scan."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def parse_cursor(cursor: str | None) -> tuple[str, str] | None:
    """Cursor ``<time>__<id>``, cut at the last double underscore."""
    cut_at = cursor.rfind("__") if cursor else -1
    return (cursor[:cut_at], cursor[cut_at + 2:]) if cut_at > 0 else None


def keyset_page(
    df: DataFrame, ts: str, id_col: str, cursor: str | None = None, limit: int = 50, max_limit: int = 200
) -> DataFrame:
    """Newest-first page after a cursor, with the next cursor on its last row.

    One row more than the page is probed to learn whether another page follows.
    """
    limit = max(1, min(limit, max_limit))
    at = parse_cursor(cursor)
    if at:
        t = as_ts(at[0])
        df = df.filter((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(id_col) < at[1])))
    probe = df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(limit + 1)
    # at most limit + 1 rows from here on
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(ts).desc(), F.col(id_col).desc())
    numbered = probe.withColumn("rn", F.row_number().over(w)).withColumn(
        "_total", F.count("*").over(Window.partitionBy(F.lit(0))))
    more = (F.col("rn") == limit) & (F.col("_total") > limit)
    token = F.concat(iso(F.col(ts)), F.lit("__"), F.col(id_col))
    return numbered.filter(F.col("rn") <= limit).withColumn(
        "next_cursor", F.when(more, token)).drop("_total")


def call_page(calls: DataFrame, cursor: str | None = None, limit: int = 50, **wanted) -> DataFrame:
    """Page of the inference log without its long texts."""
    return keyset_page(filter_eq(calls, **wanted).drop("system_prompt", "user_prompt", "response"),
                       "started_at", "id", cursor, limit, 200)


def call_detail(calls: DataFrame, ids: DataFrame) -> DataFrame:
    """Full log rows, long texts included, for some ids."""
    return calls.join(ids.select("id"), "id", "left_semi")


def nth_newest(df: DataFrame, ts: str, n: int, slot: str = "hour"):
    """The n-th newest timestamp, or None with fewer rows.

    Counts per slot tell which slot holds it; only that slot is then looked into.
    Neither step sorts the rows.
    """
    per_ts = df.groupBy(F.col(ts).alias("t")).agg(F.count("*").alias("c"))
    slots = per_ts.groupBy(F.date_trunc(slot, "t").alias("s")).agg(F.sum("c").alias("c"))
    newest = Window.partitionBy(F.lit(0)).orderBy(F.col("s").desc())
    hit = slots.withColumn("upto", F.sum("c").over(newest)).filter(
        (F.col("upto") >= n) & (F.col("upto") - F.col("c") < n)).first()
    if hit is None:
        return None
    above = hit["upto"] - hit["c"]
    inside = per_ts.filter(F.date_trunc(slot, "t") == F.lit(hit["s"]))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("t").desc())
    return inside.withColumn("upto", F.sum("c").over(w) + above).filter(
        F.col("upto") >= n).agg(F.max("t")).first()[0]


def retain(df: DataFrame, ts: str, now, days: int, max_rows: int) -> DataFrame:
    """Rows kept by retention: not older than ``days``, then the newest ``max_rows``.

    Rows tied with the last kept timestamp stay.
    """
    young = df.filter(F.col(ts) >= as_ts(now) - F.expr(f"INTERVAL {int(days)} DAYS"))
    oldest = nth_newest(young, ts, max_rows)
    return young if oldest is None else young.filter(F.col(ts) >= F.lit(oldest))


def clear(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty table of the same schema, and how many rows were there."""
    return df.filter(F.lit(False)), df.agg(F.count("*").alias("deleted"))


def append_history(history: DataFrame, answers: DataFrame) -> DataFrame:
    """Query history with new answers appended."""
    return history.unionByName(answers.select(*history.columns))


def discussion_listing(
    discussions: DataFrame, enrichment: DataFrame, messages: DataFrame,
    channel_ids: list[str] | None = None, status: str | None = None,
) -> DataFrame:
    """Discussions with enrichment and messages, one row per message.

    Flat on purpose: a discussion of any size spreads over tasks. ``created_at``
    and ``message_id`` give the order; a discussion without messages has one row
    with nulls.
    """
    d = filter_eq(discussions, status=status)
    if channel_ids is not None:
        d = d.filter(F.col("channel_id").isin(channel_ids))
    e = enrichment.select(F.col("discussion_id").alias("id"), "title", "sentiment", "discussion_type")
    m = messages.select(F.col("discussion_id").alias("id"), F.col("id").alias("message_id"), "author_id",
                        "content", "created_at")
    return d.join(e, "id", "left").join(m, "id", "left")


def discussion_bundle(
    discussions: DataFrame, enrichment: DataFrame, messages: DataFrame, users: DataFrame, ids: DataFrame
) -> DataFrame:
    """The listing of some discussions with author labels."""
    u = users.select(F.col("id").alias("author_id"), "username", "display_name")
    wanted = discussions.join(ids.select("id"), "id", "left_semi")
    return discussion_listing(wanted, enrichment, messages).join(u, "author_id", "left").withColumn(
        "author_label", author_label(F.col("display_name"), F.col("username"), F.col("author_id")))
