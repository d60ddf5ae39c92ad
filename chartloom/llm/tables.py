"""Helpers shared by the training-data operators: reading a table, and staging one in the folder all executors share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.session import new_folder, staged  # noqa: F401


def ready(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it; on a cluster it is installed or
    shipped with --py-files, and the path does no harm."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_of(df: DataFrame, *reserved: str) -> None:
    """Refuse input whose kept columns would clash with the columns that an operator adds."""
    clash = sorted(set(reserved) & set(df.columns))
    if clash:
        raise ValueError(f"columns that this operator adds: {clash}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the input has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_row_each(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows with equal keys the one whose columns hash lowest; each task keeps one row a key before they meet."""
    rest = [c for c in rows.columns if c not in keys]
    least = F.min(F.struct(F.xxhash64(*rest).alias("_hash"), *rest))
    return rows.groupBy(*keys).agg(least.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def smallest_hashes(ids: DataFrame, group: str, limits: dict) -> DataFrame:
    """Of each value of `group`, the rows whose doc_id hashes lowest, as many as its limit says (None: of all other values).

    Groups are counted first, and each row meets its group's count, so that a task keeps only rows that can be among them:
    what meets in a window is a little over the limit, however large the group is and however many groups there are.
    """
    limit = F.lit(limits.get(None, 0))
    for value, n in limits.items():
        if value is not None:
            limit = F.when(F.col(group).eqNullSafe(F.lit(value)), n).otherwise(limit)
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # Well over what is needed: ten standard deviations and more.
    room = (F.col("_limit") + 10 * F.sqrt(F.col("_limit")) + 100) / F.col("_n")
    crowded = ids.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    rows = ids.withColumn("_unit", unit).withColumn("_limit", limit)
    near = rows.join(crowded, F.col(group).eqNullSafe(F.col("_group"))).where(F.col("_unit") <= room)
    order = Window.partitionBy(group).orderBy("_unit", "doc_id")
    ranked = near.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= F.col("_limit")).select(*ids.columns)
