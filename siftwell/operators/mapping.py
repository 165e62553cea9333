"""Suggested field mappings between sources and a destination, as one ranked join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions import cells

# The execution plan of a new transformation contract.
DEFAULT_EXECUTION_PLAN = {"batch_size": 100, "error_threshold": 0.1, "validation_enabled": True}


def new_transformation(id: str, source_ref: str, destination_ref: str) -> dict:
    """A transformation contract without mappings."""
    return {"contract_type": "transformation", "transformation_id": id, "source_refs": [source_ref], "destination_refs": [destination_ref], "mapping_groups": [], "execution_plan": dict(DEFAULT_EXECUTION_PLAN)}


def source_scores(sources: DataFrame, destination: DataFrame, destination_ref: str) -> DataFrame:
    """(ref, src_idx, score): fields that the destination has too; the source of the destination's own name leads."""
    wanted = destination.select(F.lower("name").alias("k")).distinct()
    shared = sources.join(wanted, F.lower("name") == F.col("k"), "left").groupBy("ref", "src_idx").agg(F.count("k").alias("score"))
    lead = destination.agg((F.count("*") + 1).alias("lead")).scalar()
    own = F.col("ref") == F.lit(destination_ref)
    return shared.select("ref", "src_idx", F.when(own, lead).otherwise(F.col("score")).alias("score"))


def suggest(sources: DataFrame, destination: DataFrame, destination_ref: str) -> DataFrame:
    """One row for each field of `destination` (idx, name, data_type, nullable) from `sources` (ref, src_idx, fld_idx,
    name, data_type).

    Names that are equal but for case win over names that are equal without case, dashes, underscores and blanks; within
    either the better source and then the earlier field wins. A source field may serve several destinations.
    """
    d = destination.select("idx", F.col("name").alias("d_name"), F.col("data_type").alias("d_type"), "nullable")
    s = sources.join(source_scores(sources, destination, destination_ref), ["ref", "src_idx"])
    s = s.select("ref", "src_idx", "fld_idx", "score", F.col("name").alias("s_name"), F.col("data_type").alias("s_type"))
    pairs = d.join(s, cells.normalize_name(F.col("d_name")) == cells.normalize_name(F.col("s_name")))
    exact = F.lower("d_name") == F.lower("s_name")
    order = W.partitionBy("idx").orderBy(F.desc(exact), F.desc("score"), "src_idx", "fld_idx")
    best = pairs.withColumn("exact", exact).withColumn("k", F.row_number().over(order)).filter("k = 1").select("idx", "ref", "s_name", "s_type", "exact")
    out = d.join(best, "idx", "left")
    found, cast = F.col("s_name").isNotNull(), cells.needs_cast(F.col("s_type"), F.col("d_type"))
    confidence = F.when(~found, 0.0).when(F.col("exact"), F.when(cast, 0.9).otherwise(1.0)).otherwise(F.when(cast, 0.7).otherwise(0.8))
    return out.select(
        "idx",
        F.col("d_name").alias("destination_field"),
        F.when(found, "field").when(F.col("nullable"), "null").otherwise("unmapped").alias("source_type"),
        F.col("ref").alias("source_ref"),
        F.col("s_name").alias("source_field"),
        F.when(found & ~F.col("exact"), "rename").when(found & cast, "cast").alias("transformation"),
        F.when(found & ~F.col("exact"), F.col("s_name")).alias("rename_from"),
        F.when(found & ~F.col("exact"), F.col("d_name")).alias("rename_to"),
        F.when(found & cast, F.col("d_type")).alias("target_type"),
        confidence.alias("confidence"),
    )


def mapping_group(rows: list, destination_ref: str) -> dict:
    """A mapping group of a contract from the collected rows of suggest()."""
    out = []
    for r in sorted(rows, key=lambda r: r["idx"]):
        m = {"destination_field": r["destination_field"], "source_type": r["source_type"], "confidence": r["confidence"]}
        if r["source_type"] == "field":
            m |= {"source_ref": r["source_ref"], "source_field": r["source_field"]}
        if r["transformation"]:
            named = {"from": r["rename_from"], "to": r["rename_to"], "target_type": r["target_type"]}
            m["transformation"] = {"type": r["transformation"], "parameters": {k: v for k, v in named.items() if v is not None}}
        out.append(m)
    return {"destination_ref": destination_ref, "field_mappings": out}


def apply_mappings(df: DataFrame, group: dict, columns: dict[str, str] | None = None) -> DataFrame:
    """The select that a mapping group describes, for rows of one source; casts give null where they fail.

    columns: Spark type names for the casts' target types, by default those of the contract's vocabulary.
    """
    # Spark types of the contract types.
    known = {"integer": "int", "bigint": "bigint", "smallint": "smallint", "text": "string", "varchar": "string", "char": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "numeric": "decimal(38,18)", "real": "float", "double": "double", "uuid": "string", "bytea": "binary"}
    known |= columns or {}

    def one(m: dict):
        kind = m.get("source_type")
        if kind == "field":
            c = F.col(f"`{m['source_field']}`")
            target = (m.get("transformation") or {}).get("parameters", {}).get("target_type")
            c = c.try_cast(known.get(target, "string")) if target else c
        else:
            c = F.lit(m.get("source_constant") if kind == "constant" else None)
        return c.alias(m["destination_field"])

    return df.select(*map(one, group["field_mappings"]))
