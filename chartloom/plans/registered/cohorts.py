"""Rollout cohorts: statistics, intervals, checks and series."""

from pyspark.sql import functions as F

from chartloom.functions.ranks import join_groups
from chartloom.operators import experiments as E
from chartloom.plans import charts
from chartloom.plans.registry import query
from chartloom.plans.sqltext import sql

_METRICS = ["strict_success", "unsafe_attempts", "response_bytes", "model_total_tokens", "never_recorded"]

_LONG = """metric_rows as (select tool_profile, training_step, bin, crud, family, patient_id, strict_success as ok, 'strict_success' as metric, strict_success as value from rollout
  union all select tool_profile, training_step, bin, crud, family, patient_id, strict_success, 'unsafe_attempts', unsafe_attempts from rollout
  union all select tool_profile, training_step, bin, crud, family, patient_id, strict_success, 'response_bytes', response_bytes from rollout
  union all select tool_profile, training_step, bin, crud, family, patient_id, strict_success, 'model_total_tokens', model_total_tokens from rollout
  union all select tool_profile, training_step, bin, crud, family, patient_id, strict_success, 'never_recorded', null from rollout),
spread as (select tool_profile, training_step, 'difficulty' as stratum, bin as category, patient_id, ok, metric, value from metric_rows
  union all select tool_profile, training_step, 'difficulty_crud', bin||':'||crud, patient_id, ok, metric, value from metric_rows
  union all select tool_profile, training_step, 'family', family, patient_id, ok, metric, value from metric_rows),
scoped as (select *, 'all_rollouts' as scope from spread union all select *, 'successful_rollouts_only' from spread where ok=1),
seen as (select * from scoped where value>=0)"""
_G = "tool_profile, training_step, stratum, category, scope, metric"
_BOOT = f"""clusters as (select {_G}, patient_id, sum(value) as total, count(*) as n from seen group by {_G}, patient_id),
numbered as (select *, row_number() over (partition by {_G} order by substr(md5(patient_id),1,3), patient_id) - 1 as i, count(*) over (partition by {_G}) as p from clusters),
drawn as (select {_G}, b, cast('0x'||substr(md5('17|'||b||'|'||i),1,15) as bigint) % p as j from numbered, range(400) r(b) where p>=2),
means as (select d.*, x.total, x.n from drawn d join numbered x on x.tool_profile=d.tool_profile and x.training_step=d.training_step and x.stratum=d.stratum and x.category=d.category and x.scope=d.scope and x.metric=d.metric and x.i=d.j),
resampled as (select {_G}, b, sum(total)/sum(n) as m from means group by {_G}, b),
ci as (select {_G}, list_extract(list_sort(list(m)), 10) as ci_low, list_extract(list_sort(list(m)), 390) as ci_high from resampled group by {_G})"""
_STATS = f"""stats as (select {_G}, count(*) filter (value>=0) as observed, count(*) filter (value is null or value<0) as missing,
  avg(value) filter (value>=0) as mean, median(value) filter (value>=0) as median from scoped group by {_G})"""


def _rollouts(spark, sf):
    return charts.rollouts(spark, sf)


@query("a09_metric_stat", sql(f"with {_LONG}, {_STATS} select * from stats", "rollout"))
def metric_stat(spark, sf):
    out = E.stratified_summary(_rollouts(spark, sf), _METRICS, 0)
    return out.drop("model", "query_mode", "seed", "digest")


@query(
    "a10_cluster_bootstrap_ci",
    sql("""with clusters as (select family, patient_id, sum(strict_success) as total, count(*) as n from rollout group by 1,2),
        numbered as (select *, row_number() over (partition by family order by substr(md5(patient_id),1,3), patient_id)-1 as i, count(*) over (partition by family) as p from clusters),
        drawn as (select family, b, cast('0x'||substr(md5('17|'||b||'|'||i),1,15) as bigint) % p as j from numbered, range(400) r(b) where p>=2),
        m as (select d.family, b, sum(total)/sum(n) as m from drawn d join numbered x on x.family=d.family and x.i=d.j group by 1,2)
        select family, list_extract(list_sort(list(m)), 10) as ci_low, list_extract(list_sort(list(m)), 390) as ci_high from m group by 1""", "rollout"),
)
def bootstrap(spark, sf):
    r = _rollouts(spark, sf)
    clusters = r.groupBy("family", F.col("patient_id").alias("cluster")).agg(F.sum(F.col("metrics")["strict_success"]).alias("total"), F.count(F.lit(1)).alias("n"))
    return E.cluster_bootstrap_ci(clusters, ["family"])


@query(
    "a11_stratified_summary",
    sql(f"""with {_LONG}, {_STATS}, {_BOOT} select s.*, ci_low, ci_high from stats s left join ci on ci.tool_profile=s.tool_profile and ci.training_step=s.training_step
        and ci.stratum=s.stratum and ci.category=s.category and ci.scope=s.scope and ci.metric=s.metric""", "rollout"),
)
def stratified(spark, sf):
    return E.stratified_summary(_rollouts(spark, sf), _METRICS).drop("model", "query_mode", "seed", "digest")


@query(
    "a11_stratum_counts",
    sql("""with s as (select tool_profile, training_step, 'difficulty' as stratum, bin as category, patient_id, strict_success from rollout union all
          select tool_profile, training_step, 'difficulty_crud', bin||':'||crud, patient_id, strict_success from rollout union all select tool_profile, training_step, 'family', family, patient_id, strict_success from rollout)
        select tool_profile, training_step, stratum, category, count(*) as rollouts, count(distinct patient_id) as patients, count(*) filter (strict_success=1) as successful_rollouts from s group by 1,2,3,4""", "rollout"),
)
def stratum_counts(spark, sf):
    return E.stratum_counts(_rollouts(spark, sf)).drop("model", "query_mode", "seed", "digest")


@query(
    "r01_checkpoint_series",
    sql("""with p as (select tool_profile, training_step, bin, crud, strict_success as value from rollout),
        c as (select distinct tool_profile, training_step, 'all' as crud from p union select distinct tool_profile, training_step, crud from p),
        grid as (select c.*, b.difficulty from c, (values ('easy'),('medium'),('hard'),('very_hard')) b(difficulty)),
        pt as (select tool_profile, training_step, 'all' as crud, bin as difficulty, avg(value) as mean from p group by 1,2,4 union all select tool_profile, training_step, crud, bin, avg(value) from p group by 1,2,3,4)
        select g.tool_profile, g.training_step, g.crud, g.difficulty, mean from grid g left join pt on pt.tool_profile=g.tool_profile and pt.training_step=g.training_step and pt.crud=g.crud and pt.difficulty=g.difficulty""", "rollout"),
)
def series(spark, sf):
    summary = E.stratified_summary(_rollouts(spark, sf), ["strict_success"], 0)
    summary = summary.withColumn("ci_low", F.lit(None).cast("double")).withColumn("ci_high", F.lit(None).cast("double"))
    out = E.checkpoint_series(summary, [("all_rollouts", "strict_success")])
    return out.select("tool_profile", "training_step", "crud", "difficulty", "mean")


@query(
    "l05_r02_same_task",
    sql("""with r as (select *, case bin when 'easy' then 1 when 'medium' then 2 when 'hard' then 3 else 4 end as h from rollout),
        c as (select * from (select h, crud, task_id, dense_rank() over (partition by h, crud order by task_id) as k from r) z where k<=3)
        select r.task_id, r.training_step, r.tool_profile, r.strict_success, r.doc_id%4<>0 as trace_available, case when r.doc_id%4=0 then 0 else 1 end as reads
        from r join (select distinct task_id from c) c on c.task_id=r.task_id""", "rollout"),
)
def same_task(spark, sf):
    event = F.struct(*[F.lit(x).alias(n) for n, x in (("route", "rest"), ("method", "GET"), ("query", "Task?status=draft"))], F.lit(200).alias("status"), F.lit(1).alias("round"))
    write = F.struct(*[F.lit(x).alias(n) for n, x in (("route", "rest"), ("method", "POST"), ("query", "Task"))], F.lit(201).alias("status"), F.lit(1).alias("round"))
    r = _rollouts(spark, sf).withColumn("fhir_trace", F.when(F.col("doc_id") % 4 != 0, F.array(event, write)))
    out = E.same_task_queries(r)
    return out.select("task_id", "training_step", "tool_profile", "strict_success", "trace_available", F.size("retrieval_queries").alias("reads"))


@query(
    "i17_cohort_violations",
    sql("""select 'changed_cohort' as rule, 'm1|'||tool_profile||'|rest|17|'||sha256('corpus') as key, cast(2 as bigint) as n from rollout group by tool_profile
        union all select 'unpaired_profiles', 'm1|17', 2 from rollout where doc_id=(select min(doc_id) from rollout)
        union all select 'duplicate_rollout', training_step||'|'||task_id||'|0', 2 from rollout where doc_id%10=1
        union all select 'training_split', task_id, 1 from rollout where doc_id%9=2 and doc_id%10<>1
        union all select 'training_split', task_id, 2 from rollout where doc_id%9=2 and doc_id%10=1""", "rollout"),
)
def cohort(spark, sf):
    r = _rollouts(spark, sf).withColumn("split", F.when(F.col("doc_id") % 9 == 2, "train").otherwise(F.col("split")))
    return E.cohort_violations(r.unionByName(r.where("doc_id % 10 = 1")))
