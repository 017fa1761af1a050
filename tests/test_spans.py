"""Micro-batches of a stream of time spans: bounded in rows, in time order, nothing lost."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from parley.plans import queries_streaming as Q

T0 = dt.datetime(2024, 1, 1)


def test_more_rows_are_more_spans_and_not_larger_ones(spark, tmp_path):
    # most messages fall into one busy hour; the rest is spread over a month
    rows = [(f"b{i:03d}", T0 + dt.timedelta(days=9, seconds=i * 10)) for i in range(300)]
    rows += [(f"m{i:03d}", T0 + dt.timedelta(hours=i * 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp").repartition(3)
    seen = []

    def each(part, epoch):
        seen.append((part.count(), *part.agg(F.min("created_at"), F.max("created_at")).first(), {r["id"] for r in part.select("id").collect()}))

    stream = Q._stream_of_spans(SimpleNamespace(spark=spark), df, df, "spans", rows=40)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 9 and max(n for n, *_ in seen) <= 40 + 360 / 9
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:], strict=False))
    assert set().union(*(ids for *_, ids in seen)) == {r[0] for r in rows} and sum(n for n, *_ in seen) == len(rows)


def test_rows_of_one_instant_are_one_span(spark):
    df = spark.createDataFrame([(f"m{i}", T0) for i in range(50)], "id string, created_at timestamp")
    assert len(Q.time_spans(df, 10)) <= 1
    assert Q.time_spans(df.limit(0), 10) == []
