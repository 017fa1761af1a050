"""Name dictionary: presence-aware upserts and propagation onto graph nodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.ingest import as_ts


# fixed values: the fields that a section of a payload may carry beside its id
SECTIONS = {"guilds": ["name"], "channels": ["name", "type"], "users": ["username", "display_name"]}


def validate_payload(payload: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entries of a payload (json, optionally pos), and the rejected ones with a reason.

    Rejected: what is no JSON object, has no id, has a key that is neither the id nor one of
    ``fields``, or a value that is neither a string nor null.
    """
    order = F.col("pos") if "pos" in payload.columns else F.monotonically_increasing_id()
    v = F.try_parse_json("json")
    wrong: Column = F.lit(False)
    for f in ("id", *fields):
        kind = F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant"))
        wrong = wrong | (F.try_variant_get("_v", f"$.{f}", "variant").isNotNull() & ~kind.isin("STRING", "VOID"))
    keys = F.map_keys(F.from_json("json", "map<string,string>"))
    rows = payload.withColumns({"_pos": order, "_v": v, "_keys": keys}).withColumn("reason", F.when(
        F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), F.lit("not a JSON object")).when(
        F.coalesce(F.try_variant_get("_v", "$.id", "string"), F.lit("")) == "", F.lit("entry without an id")).when(
        F.size(F.array_except("_keys", F.array(*[F.lit(f) for f in ("id", *fields)]))) > 0, F.lit("unknown key")).when(
        wrong, F.lit("value is not a string")))
    m = F.from_json("json", "map<string,string>")
    good = rows.filter("reason is null").select("_pos", m.alias("m")).select(
        F.col("m")["id"].alias("id"), "_pos",
        *[F.col("m")[f].alias(f) for f in fields],
        *[F.coalesce(F.map_contains_key("m", f), F.lit(False)).alias(f"has_{f}") for f in fields])
    return good, rows.filter("reason is not null").select("json", "reason")


def payload_rows(payload: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per id of the valid entries, keeping which keys it carries.

    Returns id, the field values, ``has_<field>`` (an absent key means keep, a null clears, a
    value sets) and ``entries``. Of repeated ids the last carried value of each field counts.
    """
    good, _ = validate_payload(payload, fields)
    return good.groupBy("id").agg(
        *[F.max_by(f, F.when(F.col(f"has_{f}"), F.col("_pos"))).alias(f) for f in fields],
        *[F.bool_or(f"has_{f}").alias(f"has_{f}") for f in fields], F.count("*").alias("entries"))


def _joined(dim: DataFrame, payload: DataFrame, fields: Sequence[str]) -> DataFrame:
    n = payload.select(
        F.col("id").alias("_id"),
        *[F.col(f).alias(f"_n_{f}") for f in fields],
        *[F.col(f"has_{f}").alias(f"_has_{f}") for f in fields],
        (F.col("entries") if "entries" in payload.columns else F.lit(1)).alias("_entries"),
    )
    joined = dim.join(n, F.col("id") == F.col("_id"), "full_outer")
    differs: Column = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f"_has_{f}") & ~F.col(f"_n_{f}").eqNullSafe(F.col(f)))
    outcome = (
        F.when(F.col("_id").isNull(), F.lit("untouched"))
        .when(F.col("id").isNull(), F.lit("created"))
        .when(differs, F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    return joined.withColumn("_outcome", outcome)


def sync_dictionary(
    dim: DataFrame, payload: DataFrame, fields: Sequence[str], now,
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Dimension after the sync. ``defaults`` fill the other columns of created rows."""
    defaults = dict(defaults or {})
    j = _joined(dim, payload, fields)
    created, changed = F.col("_outcome") == "created", F.col("_outcome").isin("created", "updated")
    out = []
    for c in dim.columns:
        if c == "id":
            out.append(F.coalesce("id", "_id").alias("id"))
        elif c in fields:
            take = changed & (created | F.col(f"_has_{c}"))
            out.append(F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "names_synced_at":
            out.append(F.when(changed, as_ts(now)).otherwise(F.col(c)).alias(c))
        elif c in defaults:
            out.append(F.when(created, defaults[c]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def sync_counts(dim: DataFrame, payload: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Received entries, and created, updated and unchanged rows of a sync."""
    o = F.col("_outcome")
    return _joined(dim, payload, fields).agg(
        F.coalesce(F.sum("_entries"), F.lit(0)).cast("bigint").alias("received"),
        F.count_if(o == "created").alias("created"),
        F.count_if(o == "updated").alias("updated"),
        F.count_if(o == "unchanged").alias("unchanged"),
    )


# fixed values: which carried keys put a created / an updated row on the changed list
CHANGED_RULES = {
    "guilds": {"created": None, "updated": None},
    "channels": {"created": ["name", "type"], "updated": ["name"]},
    "users": {"created": ["username", "display_name"], "updated": None},
}


def dictionary_changed_ids(
    dim: DataFrame, payload: DataFrame, fields: Sequence[str], kind: str
) -> DataFrame:
    """Ids whose names must be pushed to the graph after a sync."""
    j = _joined(dim, payload, fields)
    keep: Column = F.lit(False)
    for outcome, needs in CHANGED_RULES[kind].items():
        carried: Column = F.lit(True) if needs is None else F.lit(False)
        for f in needs or []:
            carried = carried | F.col(f"_has_{f}")
        keep = keep | ((F.col("_outcome") == outcome) & carried)
    return j.filter(keep).select(F.col("_id").alias("id"))


def names_for(changed: DataFrame, dim: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Current names of the changed ids."""
    return dim.join(changed.select("id"), "id", "left_semi").select("id", *fields)


def all_named(dim: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every row with at least one name: the input of a full resync."""
    return dim.filter(F.coalesce(*[F.col(f) for f in fields]).isNotNull()).select("id", *fields)


def propagate_names(nodes: DataFrame, names: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Overwrite names on existing nodes; ids without a node create nothing.

    ``touched`` marks the nodes that matched.
    """
    n = names.filter("id is not null").groupBy(F.col("id").alias("_id")).agg(*[F.max(f).alias(f"_n_{f}") for f in fields])
    hit = F.col("_id").isNotNull()
    j = nodes.join(n, F.col("id") == F.col("_id"), "left")
    return j.select(
        *[
            F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in nodes.columns
        ],
        hit.alias("touched"),
    )
