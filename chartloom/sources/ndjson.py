"""Reading line-delimited JSON: resources, tasks, rollouts and stored episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import documents as D

STEP = "struct<method:string,path:string,body:string,headers:map<string,string>>"
GOLD = (
    "struct<answer:string,evidence:array<string>,target_evidence:array<string>,"
    "evidence_fields:map<string,array<string>>,updates:array<struct<ref:string,field:string,value:string>>,"
    "creates:array<string>,deletes:array<string>>"
)
TASK = (
    "id string, base_task_id string, patient_id string, split string, upstream_split string, shard string, family string, "
    "domain string, role string, scenario_variant string, age_band string, information_regime string, snapshot_date string, "
    "prompt string, dependency_depth int, workflow_depth int, reference_calls int, requires_transaction boolean, "
    "requires_read_before_write boolean, writable_types array<string>, writable_refs array<string>, delete_refs array<string>, "
    "omit array<string>, dependency_edges array<array<string>>, "
    "absence_scope struct<resourceType:string,patient:string,code:string,tag:string>, "
    f"reference_steps array<{STEP}>, gold {GOLD}"
)
EVENT = (
    "episode_id string, seq int, ts timestamp, route string, via_tool string, method string, query string, status int, "
    "round int, refs array<string>, backend_refs array<string>, exposed array<struct<ref:string,fields:array<string>>>, "
    "bytes bigint, primitive_operations int, total int, filter_terms_not_previously_observed array<string>"
)
USAGE = "struct<prompt_tokens:double,completion_tokens:double>"
ROLLOUT = (
    "training_step int, model string, tool_profile string, query_mode string, seed int, benchmark_manifest_sha256 string, "
    "rollout_id int, evaluation_config map<string,string>, "
    "info struct<task_id:string,patient_id:string,family:string,split:string,crud:string,retrieval_hops:int>, "
    f"metrics map<string,double>, trajectory array<struct<response:struct<usage:{USAGE}>>>, "
    "fhir_trace array<struct<route:string,method:string,query:string,status:int,round:int>>"
)
NODE = (
    "struct<parent:int,sampled:boolean,message:struct<role:string,content:string,reasoning_content:string,name:string,"
    "tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"
)
TRACE = (
    f"struct<version:int,ok:boolean,errors:array<string>,agent:struct<name:string>,nodes:array<{NODE}>,"
    f"calls:array<struct<model:string,usage:{USAGE}>>,rewards:map<string,struct<score:double,weight:double>>,"
    "metrics:map<string,double>>"
)
EPISODE = (
    "id string, ok boolean, errors array<string>, "
    "task struct<key:string,data:struct<prompt:string,info:struct<family:string>,family:string>>, "
    f"traces array<{TRACE}>"
)


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Non-blank lines with their place: file, start of the split, running number inside the split.

    The three together sort in stored order however a file is split, so no file has to be read whole.
    """
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return raw.select(
        F.col("value"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("pos"),
    ).where(F.trim("value") != "")


def parsed_once(df: DataFrame, v, out: str = "v") -> DataFrame:
    """Add a parsed document that is made once per row.

    A plain projection would be copied into every filter and column that looks at the document, and with it the parsing and
    what makes its text; the rows of a generator are not. It is made below the generator, as only a projection makes what
    its expressions share once.
    """
    names = [c for c in df.columns if c != out]
    made = df.select(*names, v.alias("__made"))
    return made.select(*names, F.explode(F.array("__made")).alias(out)).select(*(df.columns if out in df.columns else [*names, out]))


def with_core_columns(parsed: DataFrame) -> DataFrame:
    """Add the columns everything filters and joins on to (doc, v, pos) rows."""
    v = F.col("v")
    return parsed.select(
        D.ref(D.text(v, "resourceType"), D.text(v, "id")).alias("ref"),
        (F.col("resource_type") if "resource_type" in parsed.columns else D.text(v, "resourceType").alias("resource_type")),
        D.text(v, "id").alias("id"),
        D.get(v, "meta.versionId", "int").alias("version"),
        D.patient_ref(v).alias("patient_ref"),
        D.resource_date(v).alias("resource_date"),
        *[c for c in parsed.columns if c not in ("doc", "v", "resource_type")],
        "doc",
        "v",
    )


def split_good(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed resource lines, and the lines that are no JSON object with a type and an id."""
    parsed = parsed_once(df, F.try_parse_json("value")).withColumnRenamed("value", "doc")
    ok = D.text(F.col("v"), "resourceType").isNotNull() & D.text(F.col("v"), "id").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return with_core_columns(parsed.where(ok)), parsed.where(~ok).select("doc", "pos")


def read_resources(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Resources of NDJSON files and, apart, the lines that could not be read."""
    return split_good(lines(spark, paths))


def from_documents(docs: DataFrame) -> DataFrame:
    """Resources from a ``doc`` column; stored order is the order of refs.

    A ``resource_type`` column beside it (as in a table partitioned by type) is taken over, so that type
    filters prune before any document is parsed.
    """
    parsed = parsed_once(docs, F.parse_json("doc"))
    pos = F.struct(
        D.ref(D.text(F.col("v"), "resourceType"), D.text(F.col("v"), "id")).alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(0).cast("bigint").alias("line"),
    )
    return with_core_columns(parsed.withColumn("pos", pos))


def read_shards(spark: SparkSession, root: str, split: str, shards: Sequence[str] | None = None, omit: DataFrame | None = None) -> DataFrame:
    """Resources of a split written by ``write_sharded``; partition pruned, hidden refs left out.

    ``omit`` holds one ref per row.
    """
    raw = spark.read.option("basePath", root).text(root).where(F.col("split") == split)
    if shards is not None:
        raw = raw.where(F.col("shard").isin(list(shards)))
    raw = raw.select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("pos"),
        "split",
        "shard",
    ).where(F.trim("value") != "")
    good, _ = split_good(raw)
    return good if omit is None else good.join(omit.select("ref"), "ref", "left_anti")


def read_tasks(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema(TASK).json(paths)


def read_events(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema(EVENT).json(paths)


def read_rollouts(spark: SparkSession, paths) -> DataFrame:
    """Rollouts of many files; no row at all is an error."""
    df = spark.read.schema(ROLLOUT).json(paths)
    if df.isEmpty():
        raise ValueError("no rollouts found")
    return df


def read_episodes(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Stored episodes and numbered warnings for records that are malformed or of another version."""
    rows = lines(spark, paths).withColumn("v", F.try_parse_json("value"))
    v = F.col("v")
    kind = lambda p: F.coalesce(F.schema_of_variant(D.node(v, p)), F.lit(""))
    versions = F.transform(D.values_at(v, "traces"), lambda t: D.get(t, "version", "int"))
    problem = (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not a JSON object")
        .when(kind("task") == "", "task is missing")
        .when(~kind("traces").startswith("ARRAY"), "traces is not a list")
        .when(F.exists(versions, lambda x: x.isNull() | (x != 1)), "unsupported trace version")
    )
    checked = rows.withColumn("problem", problem)
    bad = checked.where("problem is not null").select(
        F.col("pos.file").alias("file"), F.col("pos.line").alias("line"), F.col("problem").alias("message")
    )
    good = checked.where("problem is null").select("pos", F.from_json("value", EPISODE).alias("e")).select("pos", "e.*")
    return good, bad
