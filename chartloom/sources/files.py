"""Run folders, validator reports and file digests."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Plan and receipts of every run folder under a root, one row per run, in the form ``traces.run_status`` takes.

    Each metadata file is one small JSON object.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    run = F.regexp_extract(path, r"([^/]+)/(?:receipts/)?[^/]+\.json$", 1)
    files = raw.select(run.alias("run"), name.alias("name"), F.try_parse_json("value").alias("v"))
    get = lambda n, p, t="string": F.max(F.when(F.col("name") == n, F.try_variant_get("v", "$." + p, t)))
    has = lambda n: F.max((F.col("name") == n).cast("int")) == 1
    return files.groupBy("run").agg(
        get("finished", "status").alias("finished_status"), get("finished", "episodes", "bigint").alias("receipt_episodes"), has("prepare-failed").alias("prepare_failed"), has("gpu").alias("gpu"),
        get("gpu", "status").alias("gpu_status"), get("gpu", "error").alias("gpu_error"), get("gpu", "elapsed_seconds", "double").alias("gpu_elapsed"),
        get("prepared", "status").alias("prepared_status"), get("plan", "num_examples", "bigint").alias("num_examples"),
        get("plan", "rollouts_per_example", "bigint").alias("rollouts_per_example"),
        F.coalesce(get("plan", "profile.model"), get("plan", "preset")).alias("plan_model"), F.lit(None).cast("string").alias("call_model"),
    )


def validation_issues(reports: DataFrame) -> DataFrame:
    """Validator bundles (side, doc JSON) -> one row per issue with file, resource, severity, message and expression."""
    v = F.parse_json("doc")
    entries = reports.select("side", F.explode(F.try_variant_get(v, "$.entry", "array<variant>")).alias("e"))
    e = entries.select(
        "side", F.try_variant_get("e", "$.resource.extension[0].valueString", "string").alias("file"),
        F.explode(F.try_variant_get("e", "$.resource.issue", "array<variant>")).alias("i"),
    )
    g = lambda p: F.try_variant_get("i", "$." + p, "string")
    expression = g("expression[0]")
    named = F.regexp_extract(expression, r"/\*([A-Za-z]+/[^*]+)\*/", 1)
    return e.select(
        "side", "file", g("severity").alias("severity"), F.coalesce(g("details.text"), g("diagnostics")).alias("message"), expression.alias("expression"),
        F.when(named != "", named).alias("resource"),
    )


def read_validation_outcomes(spark: SparkSession, sides: dict[str, str]) -> DataFrame:
    out = None
    for side, path in sides.items():
        part = spark.read.option("wholetext", True).text(path).select(F.lit(side).alias("side"), F.col("value").alias("doc"))
        out = part if out is None else out.unionByName(part)
    return validation_issues(out)


# Files above this size are read in pieces: a Spark value cannot hold 2 GB.
VALUE_BYTES = 256 * 1024 * 1024
PIECE_BYTES = 8 * 1024 * 1024


def _digest_in_pieces(batches):
    """(uri) -> (uri, sha256), one piece of a file in memory at a time."""
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            # Spark writes local paths with one slash after the scheme.
            fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
            digest = hashlib.sha256()
            with fs.open_input_stream(path) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "sha256": [digest.hexdigest()]})


def file_digests(spark: SparkSession, root: str, value_bytes: int = VALUE_BYTES) -> DataFrame:
    """(path below the root, sha256) of every file.

    Files up to ``value_bytes`` are digested by Spark's own reader; the reader skips larger ones by their length, and tasks
    read those as streams, each file by itself, so no size is too large for a value. The streams need a file system that
    Arrow knows (local, HDFS, S3, GCS).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("/")[-1]
    rel = F.regexp_extract("uri", f"/{re.escape(base)}/(.*)$", 1)
    small = files.where(F.col("length") <= value_bytes).select(F.col("path").alias("uri"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > value_bytes).select(F.col("path").alias("uri"))
    streamed = large.mapInArrow(_digest_in_pieces, "uri string, sha256 string")
    return small.unionByName(streamed).select(rel.alias("path"), "sha256")


def verify_manifest(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, not listed or changed; both sides have (path, sha256)."""
    m = manifest.withColumnRenamed("sha256", "listed")
    j = digests.join(m, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "not listed").when(F.col("sha256") != F.col("listed"), "changed")
    return j.select("path", problem.alias("problem")).where("problem is not null")
