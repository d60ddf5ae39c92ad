"""The streaming operators over the event log read as a stream; results restate the batch rules."""

from pyspark.sql import functions as F

from chartloom.plans import charts
from chartloom.plans.registry import query
from chartloom.plans.registered import writes
from chartloom.plans.sqltext import sql
from chartloom.streaming import episodes as Z

#: Time without an event after which an episode is ended.
IDLE = "30 days"
_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _stream(spark, sf):
    """The call log as a stream; the place in the log is the event number."""
    e = spark.readStream.schema(_SCHEMA).parquet(f"{sf}/events*.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    s = lambda c: c.cast("string")
    kind, u = F.col("event_type"), F.col("user_id")
    who, order = F.concat(F.lit("Patient/c"), s(u)), F.concat(F.lit("ServiceRequest/o"), s(k))
    refs = F.when(kind == "view", F.array(who, order)).when(kind == "click", F.array(order)).when(kind == "signup", F.array(who)).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.concat(F.lit("ep"), s(u)).alias("episode_id"), F.col("event_id").alias("seq"), "ts", F.lit("rest").alias("route"),
        F.when(kind == "purchase", "POST").otherwise("GET").alias("method"), F.concat(F.lit("Observation?code=k"), s(k)).alias("query"),
        F.when(kind == "error", 400).otherwise(200).alias("status"), F.floor(k / 10).cast("int").alias("round"), refs.alias("refs"),
        F.transform(refs, lambda r: F.struct(r.alias("ref"), F.array(F.lit("code"), F.lit("status")).alias("fields"))).alias("exposed"),
        F.col("value").alias("bytes"), F.when(kind == "click", F.concat(F.lit("code k"), s(k))).alias("shown_text"),
    )


@query("z01_stream_budget", "select 'ep'||user_id as episode_id, event_id as seq, call, call>40 as refused from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as call from events) z")
def budget(spark, sf):
    return Z.stream_budget(spark, idle=IDLE).run_available(_stream(spark, sf))


@query(
    "z02_stream_novelty",
    sql("""select distinct episode_id, event_id as seq, 'k'||k as term from (select 'ep'||user_id as episode_id, * from ev0) u where event_type<>'purchase' and k<>u.user_id%100
        and not exists (select 1 from ev0 s where s.user_id=u.user_id and s.k=u.k and s.event_type='click' and s.event_id<u.event_id)""", "ev0"),
)
def novelty(spark, sf):
    return Z.stream_novelty(spark, charts.episode_tasks(spark, sf), idle=IDLE).run_available(_stream(spark, sf))


@query(
    "z03_stream_exposure",
    sql("""with h as (select user_id, event_id, k, event_type in ('view','signup') as p, event_type in ('view','click') and k=user_id%100 as o from ev0),
        a as (select user_id, min(case when p then event_id end) as p, min(case when o then event_id end) as o from h group by 1)
        select 'ep'||user_id as episode_id, o as first_evidence_call, case when p is not null and o is not null then greatest(p,o) end as all_evidence_call from a where p is not null or o is not null""", "ev0"),
)
def exposure(spark, sf):
    rows = Z.stream_exposure(spark, charts.episode_tasks(spark, sf), idle=IDLE).run_available(_stream(spark, sf))
    return rows.select("episode_id", "first_evidence_call", "all_evidence_call")


@query(
    "z04_stream_changes",
    """select 'e'||o_orderkey as episode_id, 1 as seq, 'DELETE' as method, case when o_orderkey%4=1 then 'Task/t' when o_orderkey%4=2 then 'ServiceRequest/o' else 'Task/d' end||o_orderkey as ref,
       case o_orderkey%4 when 0 then 204 when 1 then 403 when 2 then 409 else 412 end as status from orders""",
)
def changes(spark, sf):
    _, _, _, _, current, policy = writes._world(spark, sf)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    o = spark.readStream.schema(schema).parquet(f"{sf}/orders*.parquet")
    k = F.col("o_orderkey").cast("string")
    rows = writes._deletes(F.col("o_orderkey"), k, F.lit(""))
    log = o.select(F.concat(F.lit("e"), k).alias("episode_id"), F.explode(rows).alias("c")).select("episode_id", "c.*")
    return Z.stream_changes(current, policy).run_available(log).select("episode_id", "seq", "method", "ref", "status")


@query(
    "z05_stream_rounds",
    sql("""with e as (select 'ep'||user_id as episode_id, cast(floor(k/10) as integer) as round, ts, event_type='error' as bad from ev0),
        g as (select *, case when ts - lag(ts) over (partition by episode_id, round order by ts) < interval 30 minutes then 0 else 1 end as fresh from e),
        s as (select *, sum(fresh) over (partition by episode_id, round order by ts) as n from g)
        select episode_id, round, count(*) as calls, count(*) filter (bad) as errors from s group by episode_id, round, n""", "ev0"),
)
def rounds(spark, sf):
    return Z.stream_rounds(spark).run_available(_stream(spark, sf)).select("episode_id", "round", "calls", "errors")
