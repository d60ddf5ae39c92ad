"""Source patients from three relational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_conflicts(ground_truth: DataFrame) -> DataFrame:
    """Patients with several split labels."""
    g = ground_truth.where("patient_id is not null")
    return g.groupBy("patient_id").agg(F.countDistinct("split").alias("splits")).where("splits <> 1")


def unassigned(patients: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Patients without any split label."""
    return patients.join(ground_truth.select("patient_id"), "patient_id", "left_anti")


def patient_source(ground_truth: DataFrame, patients: DataFrame, encounters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patients with their one split and visit span, and the encounters of those patients.

    Encounters stay rows (patient_id, encounter_date, encounter_id order them), so a patient with very
    many visits is never one value. Conflicting or missing splits are an error.
    """
    if not split_conflicts(ground_truth).isEmpty():
        raise ValueError("source patient has conflicting split labels")
    if not unassigned(patients, ground_truth).isEmpty():
        raise ValueError("source patient lacks a split")
    splits = ground_truth.where("patient_id is not null").select("patient_id", "split").distinct()
    spans = encounters.groupBy("patient_id").agg(
        F.min("encounter_date").alias("first_date"), F.max("encounter_date").alias("last_date"), F.count(F.lit(1)).alias("encounters")
    )
    out = patients.join(splits, "patient_id").join(spans, "patient_id", "left").na.fill(0, ["encounters"])
    return out, encounters.join(patients.select("patient_id"), "patient_id", "left_semi")


#: Tables of the source: split labels, patients, encounters.
TABLES = ("benchmark_ground_truth", "longitudinal_patients", "longitudinal_encounters")


def key_predicates(key: str, cuts: Sequence[str]) -> list[str]:
    """WHERE clauses that cut a table by a text key, one for each partition of a read: every row satisfies exactly one."""
    quoted = ["'" + c.replace("'", "''") + "'" for c in sorted(set(cuts))]
    if not quoted:
        return ["1 = 1"]
    between = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(quoted, quoted[1:])]
    return [f"{key} < {quoted[0]} OR {key} IS NULL", *between, f"{key} >= {quoted[-1]}"]


def read_patient_source(spark, url: str, properties: dict | None = None, tables: Sequence[str] = TABLES, key: str = "patient_id", parts: int = 16):
    """The three tables over JDBC, each read in ``parts`` partitions by ranges of the key.

    The cuts are keys of the patients table, spread by their hashes, so partitions follow the keys; only the key
    column is read for them. They are compared as the database orders texts.
    """
    labels, patients, encounters = tables
    keys = spark.read.jdbc(url, f"(SELECT DISTINCT {key} FROM {patients}) k", properties=properties or {})
    least = keys.select(F.col(key).cast("string").alias("k")).where("k is not null").orderBy(F.xxhash64("k")).limit(max(0, parts - 1))
    cuts = key_predicates(key, [r.k for r in least.collect()])
    t = lambda name: spark.read.jdbc(url, name, predicates=cuts, properties=properties or {})
    return patient_source(t(labels), t(patients), t(encounters))
