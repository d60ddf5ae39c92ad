"""The reference-edge table and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.session import checkpointed

EXTERNAL = r"^(https?:|urn:|#)"


def edges(resources: DataFrame) -> DataFrame:
    """(src_ref, src_owner, field, n, dst_ref): every reference with the top-level field it is under."""
    e = resources.select(
        F.col("ref").alias("src_ref"), F.col("patient_ref").alias("src_owner"), F.explode(F.map_entries(D.fields(F.col("v")))).alias("e")
    )
    found = D.references(F.to_json("e.value"))
    # A top-level field named "reference" holding a string is itself a reference.
    own = F.when(F.col("e.key") == "reference", F.col("e.value").try_cast("string"))
    every = F.when(own.isNotNull(), F.array(own)).otherwise(found)
    return e.select("src_ref", "src_owner", F.col("e.key").alias("field"), F.posexplode(every).alias("n", "dst_ref"))


def is_local(dst: Column) -> Column:
    return ~dst.rlike(EXTERNAL)


def broken_refs(edge_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Local edges whose target is absent; ``refs`` has one ``ref`` column."""
    local = edge_rows.where(is_local(F.col("dst_ref")))
    # Merged whatever the planner guesses from the size of compressed files: it would send all refs to every task.
    return local.join(refs.select(F.col("ref").alias("dst_ref")).hint("merge"), "dst_ref", "left_anti")


def cross_patient_refs(edge_rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges with two different owners; ``owners`` has (ref, patient_ref)."""
    o = owners.where("patient_ref is not null").select(F.col("ref").alias("dst_ref"), F.col("patient_ref").alias("dst_owner"))
    owned = edge_rows.where("src_owner is not null")
    return owned.join(o.hint("merge"), "dst_ref").where("src_owner <> dst_owner")


def referenced_by(candidates: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Candidates some other resource points at."""
    used = edge_rows.where("src_ref <> dst_ref").select(F.col("dst_ref").alias("ref"))
    return candidates.join(used, "ref", "left_semi")


def unreferenced(candidates: DataFrame, edge_rows: DataFrame) -> DataFrame:
    used = edge_rows.where("src_ref <> dst_ref").select(F.col("dst_ref").alias("ref"))
    return candidates.join(used, "ref", "left_anti")


def edge_counts(edge_rows: DataFrame) -> DataFrame:
    """``TypeA->TypeB`` counts of local references."""
    local = edge_rows.where(is_local(F.col("dst_ref")) & F.col("dst_ref").contains("/"))
    name = F.concat(F.substring_index("src_ref", "/", 1), F.lit("->"), F.substring_index("dst_ref", "/", 1))
    return local.groupBy(name.alias("edge")).agg(F.count(F.lit(1)).alias("n"))


def closure(seeds: DataFrame, edge_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(patient_ref, ref): the patients' documents and all present documents reachable from them.

    ``seeds`` has (patient_ref, ref). Each round joins only the newest frontier and drops what is known, so cycles end,
    and goes on until nothing new is reached; every frontier is checkpointed once and never written again. Documents
    without an owner that many patients share are carried once per patient, as the result asks.
    """
    step = edge_rows.select(F.col("src_ref").alias("ref"), F.col("dst_ref")).distinct()
    step = checkpointed(step.join(refs.select(F.col("ref").alias("dst_ref")), "dst_ref", "left_semi"))
    known = frontier = checkpointed(seeds.select("patient_ref", "ref").distinct())
    while not frontier.isEmpty():
        reached = frontier.join(step, "ref").select("patient_ref", F.col("dst_ref").alias("ref")).distinct()
        frontier = checkpointed(reached.join(known, ["patient_ref", "ref"], "left_anti"))
        known = known.unionByName(frontier)
    return known
