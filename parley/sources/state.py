"""Snapshots of the staging tables: parquet folders listed by a manifest.

Message texts are written once. What a run changes about a message (``processed``
and ``discussion_id``) is a narrow table of its own, so a stage never rewrites the
texts. A snapshot writes only the tables that changed; the manifest points to the
folder in force for each table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.schemas import STATE, columns

_MANIFEST = "seq bigint, tag string, paths string"
MUTABLE = ["processed", "discussion_id"]


def _manifest(spark: SparkSession, folder: str):
    """Newest manifest row, or None before the first snapshot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return None
    return spark.read.schema(_MANIFEST).json(f"{folder}/_manifest").orderBy(F.col("seq").desc()).first()


def save_state(tables: dict[str, DataFrame], folder: str, tag: str = "", new_messages: bool = False) -> None:
    """Write the given tables to a fresh folder, then add the manifest row.

    The manifest row comes last, so a run that dies half-way leaves the previous
    snapshot in force. Message texts are written only with ``new_messages``, or the
    first time.
    """
    spark = next(iter(tables.values())).sparkSession
    last = _manifest(spark, folder)
    paths = json.loads(last["paths"]) if last else {}
    fresh = f"{folder}/{uuid.uuid4().hex}"
    for name, df in tables.items():
        if name == "messages":
            df.select("id", *MUTABLE).write.parquet(f"{fresh}/message_state")
            paths["message_state"] = f"{fresh}/message_state"
            if "messages" in paths and not new_messages:
                continue
            df = df.drop(*MUTABLE)
        df.write.parquet(f"{fresh}/{name}")
        paths[name] = f"{fresh}/{name}"
    seq = (last["seq"] if last else 0) + 1
    spark.createDataFrame([(seq, tag, json.dumps(paths))], _MANIFEST).coalesce(1).write.mode("append").json(
        f"{folder}/_manifest")


def state_tag(spark: SparkSession, folder: str) -> str | None:
    """Tag of the newest snapshot."""
    last = _manifest(spark, folder)
    return last["tag"] if last else None


def load_state(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of the newest snapshot; staging tables it lacks come empty."""
    last = _manifest(spark, folder)
    paths = json.loads(last["paths"]) if last else {}
    out = empty_state(spark)
    for name, path in paths.items():
        if name in STATE and name != "messages":
            out[name] = spark.read.schema(STATE[name]).parquet(path)
        elif name not in ("messages", "message_state"):
            out[name] = spark.read.parquet(path)
    if "messages" in paths:
        facts = spark.read.parquet(paths["messages"])
        marks = spark.read.parquet(paths["message_state"])
        out["messages"] = facts.join(marks, "id", "left").select(*columns(STATE["messages"]))
    return out


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    """All staging tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}
