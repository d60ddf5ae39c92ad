"""Event logs and episodes: order rules, evidence, behaviour, scores and traces."""

from pyspark.sql import functions as F

from chartloom.functions import text as X
from chartloom.functions.ranks import ranked
from chartloom.operators import behavior as B
from chartloom.operators import scoring as S
from chartloom.operators import traces as R
from chartloom.operators import windows as W
from chartloom.plans import charts
from chartloom.plans.charts import table
from chartloom.plans.registry import query
from chartloom.plans.sqltext import sql

_HIT = "(ref like 'Patient/%' or (ref='ServiceRequest/o'||(user_id%100) and fields_shown))"
_TARGET = "ref='ServiceRequest/o'||(user_id%100)"


def _ev(spark, sf):
    return charts.tool_events(spark, sf)


def _tasks(spark, sf):
    return charts.episode_tasks(spark, sf)


@query(
    "w01_sql_windows",
    sql("""select resource_ref, row_number() over w as rn, rank() over (partition by patient_ref order by date) as rk, dense_rank() over (partition by patient_ref order by date) as dr,
        sum(value) over (partition by patient_ref order by date, resource_ref rows between 2 preceding and current row) as s3, count(*) over (partition by patient_ref) as n
        from obs where status='final' window w as (partition by patient_ref order by date, resource_ref)""", "obs"),
)
def sql_windows(spark, sf):
    charts.observation(spark, sf).createOrReplaceTempView("Observation")
    return spark.sql(
        """SELECT resource_ref, row_number() OVER w AS rn, rank() OVER (PARTITION BY patient_ref ORDER BY date) AS rk,
        dense_rank() OVER (PARTITION BY patient_ref ORDER BY date) AS dr,
        sum(value) OVER (PARTITION BY patient_ref ORDER BY date, resource_ref ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3,
        count(*) OVER (PARTITION BY patient_ref) AS n
        FROM Observation WHERE status = 'final' WINDOW w AS (PARTITION BY patient_ref ORDER BY date, resource_ref)"""
    )


@query("event_log", sql("select episode_id, seq, route, via_tool, method, query, status, round, bytes from ev", "ev"))
def event_log(spark, sf):
    return _ev(spark, sf).select("episode_id", "seq", "route", "via_tool", "method", "query", "status", "round", "bytes")


_LATENCY = f"""hit as (select episode_id, ref, min(seq) as s from evref where status<300 and {_HIT} and (ref='Patient/c'||user_id or {_TARGET}) group by 1,2),
g as (select e.episode_id, min(case when ref like 'Service%' then s end) as first_seq, case when count(s)=2 then max(s) end as all_seq
  from (select distinct episode_id from ev) e left join hit h on h.episode_id=e.episode_id group by 1)"""


@query(
    "w02_w03_evidence_latency",
    sql(f"""with {_LATENCY} select g.episode_id, first_seq as first_evidence_call, a.round as first_evidence_round, all_seq as all_evidence_call, b.round as all_evidence_round,
        1 as first_evidence_applicable, case when first_seq is null then 1 else 0 end as first_evidence_censored, case when all_seq is null then 1 else 0 end as all_evidence_censored
        from g left join ev a on a.episode_id=g.episode_id and a.seq=first_seq left join ev b on b.episode_id=g.episode_id and b.seq=all_seq""", "ev", "evref"),
)
def evidence_latency(spark, sf):
    return S.evidence_latency(_ev(spark, sf), _tasks(spark, sf))


@query(
    "w04_read_before_write",
    sql(f"""with h as (select episode_id, ref, min(seq) as s from evref where status<300 and method in ('GET','SELECT') and {_HIT} and (ref='Patient/c'||user_id or {_TARGET}) group by 1,2),
        w as (select episode_id, min(seq) as fw from ev where method in ('POST','PUT') and status<300 group by 1)
        select e.episode_id, fw is null or (count(s)=2 and max(s)<fw) as ok from (select distinct episode_id from ev) e left join w on w.episode_id=e.episode_id left join h on h.episode_id=e.episode_id group by e.episode_id, fw""", "ev", "evref"),
)
def read_before_write(spark, sf):
    return S.read_before_write(_ev(spark, sf), _tasks(spark, sf))


@query(
    "w05_term_novelty",
    sql("""with used as (select episode_id, seq, user_id, unnest(case when route='sql' then ['k'||k,'final'] when event_type='view' then ['c'||user_id,'k'||k,'2024-01-'||lpad(cast(k%28+1 as varchar),2,'0')] else ['k'||k] end) as term
          from ev where event_type in ('view','error')),
        shown as (select episode_id, seq, unnest(['order','k'||k,'round',cast(round as varchar)]) as term from ev where status<300)
        select episode_id, seq, term from used u where term not in ('find','order','of','the','caller') and term<>'k'||(user_id%100)
        and not exists (select 1 from shown s where s.episode_id=u.episode_id and s.term=u.term and s.seq<u.seq)""", "ev"),
)
def term_novelty(spark, sf):
    e = _ev(spark, sf)
    text = F.concat(F.lit("Order k"), F.col("k").cast("string"), F.lit(", round "), F.col("round").cast("string"))
    shown = e.where("status < 300").select("episode_id", "seq", text.alias("text"))
    return B.term_novelty(e, shown, _tasks(spark, sf))


@query(
    "w06_b08_search_counts",
    sql("""with s as (select *, event_type in ('view','error') as search, event_type in ('view','click','error') as read from ev),
        t as (select episode_id, count(distinct term) as n from (select episode_id, unnest(case when route='sql' then ['k'||k,'final'] when event_type='view' then ['c'||user_id,'k'||k,'2024-01-'||lpad(cast(k%28+1 as varchar),2,'0')] else ['k'||k] end) as term
          from ev where event_type in ('view','error')) z group by 1)
        select s.episode_id, count(*) filter (search) as search_calls, count(distinct case when search then round end) as search_rounds,
        count(*) filter (read) - count(distinct case when read then route||method||query end) as repeated_queries, coalesce(max(t.n),0) as distinct_filter_terms
        from s left join t on t.episode_id=s.episode_id group by s.episode_id""", "ev"),
)
def search_counts(spark, sf):
    return B.search_counts(_ev(spark, sf))


@query(
    "w07_attempts",
    """with e as (select *, row_number() over (partition by source order by doc_id) as pos from (select d.doc_id, source, n_chars%5 as task, quality from documents d join labels l on l.doc_id=d.doc_id) z),
       g as (select source, task, min(doc_id) as first_doc, count(*) as attempts, count(*) filter (quality=1) as correct from e group by 1,2),
       x as (select *, row_number() over (partition by source order by first_doc) as example from g)
       select e.doc_id, x.example, row_number() over (partition by e.source, e.task order by e.doc_id) as attempt, x.attempts, x.correct from e join x on x.source=e.source and x.task=e.task""",
)
def attempts(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", (F.col("n_chars") % 5).alias("task"), "quality")
    return W.attempts(d, "source", "task", "doc_id", F.col("quality") == 1).select("doc_id", "example", "attempt", "attempts", "correct")


@query("w08_budget", sql("select episode_id, seq, case when seq>40 then 429 else status end as status, seq>40 as refused from ev", "ev"))
def budget(spark, sf):
    return W.budget(_ev(spark, sf)).select("episode_id", "seq", "status", "refused")


@query(
    "w09_version_chain",
    """select 'Order/'||l_orderkey as ref, cast(v as integer) as version, previous_version, md5(p) as previous_md5 from (
       select l_orderkey, v, lag(v) over w as previous_version, lag(body) over w as p from (
         select l_orderkey, row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax) as v, l_partkey||':'||l_suppkey as body from lineitem) z
       window w as (partition by l_orderkey order by v)) y""",
)
def version_chain(spark, sf):
    li = table(spark, sf, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")]
    v = ranked(li, ["l_orderkey"], F.year("l_shipdate"), order, "version")
    v = v.select(charts.key("Order/", "l_orderkey").alias("ref"), F.col("version").cast("int").alias("version"), F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("body"))
    return W.version_chain(v).select("ref", "version", "previous_version", F.md5("previous_body").alias("previous_md5"))


@query(
    "w10_balanced_assignment",
    """select c_custkey, ['final','pending','rejected','corrected'][(i + i//4)%4 + 1] as lab_branch, ['members','components','individual'][(i//4)%3 + 1] as panel_encoding, (i + i//4)%2=1 as medication_reference
       from (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer) z""",
)
def balanced_assignment(spark, sf):
    c = ranked(table(spark, sf, "customer").select("c_custkey"), [], F.floor(F.col("c_custkey") / W.BLOCK), [F.col("c_custkey")], "i")
    return c.select("c_custkey", W.balanced_assignment(F.col("i") - 1).alias("a")).select("c_custkey", "a.*")


@query(
    "w11_interleave_strata",
    sql("""select id, band, cast((rn-1)*3 + case band when 'adult18_39' then 1 when 'adult40_64' then 2 else 3 end as integer) as cohort_pos from (
        select id, band, row_number() over (partition by band order by id) as rn from (select id, case when a<40 then 'adult18_39' when a<65 then 'adult40_64' else 'older65plus' end as band
          from (select id, 2030-cast(substr(birth_date,1,4) as integer) as a from patient) x) y) z where rn<=6""", "patient"),
)
def interleave(spark, sf):
    age = F.lit(2030) - F.substring("birth_date", 1, 4).cast("int")
    p = charts.patient(spark, sf).select("id", X.age_band(age).alias("band"))
    return W.interleave_strata(p, "band", ["adult18_39", "adult40_64", "older65plus"], "id")


@query(
    "w12_discovery_audit",
    sql("""select 'o'||o_orderkey as task_id, cast(2 as bigint) as step, substr(sha256('Task|'||o_orderkey),1,24) as used from orders where o_orderkey%3=0
        union all select 'o'||o_orderkey, 1, 'ORD-'||o_orderkey from orders where o_orderkey%2=0""" ),
)
def discovery_audit(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    task = F.concat(F.lit("o"), k.cast("string"))
    ident = F.concat(F.lit("ORD-"), k.cast("string"))
    hex_id = X.stable_id(F.lit("Task"), k)
    step = lambda n, method, path: F.struct(F.lit(n).cast("bigint").alias("step"), F.lit(method).alias("method"), path.alias("path"))
    steps = o.select(task.alias("task_id"), F.explode(F.array(
        step(1, "GET", F.concat(F.lit("ServiceRequest?identifier=urn:x%7C"), ident)), step(2, "GET", F.concat(F.lit("Task/"), hex_id)),
        step(3, "PUT", F.concat(F.lit("Task/"), hex_id)), step(4, "GET", F.concat(F.lit("Task/"), X.stable_id(F.lit("never"), k))),
    )).alias("s")).select("task_id", "s.*")
    prompts = o.select(task.alias("task_id"), F.concat(F.lit("for "), F.when(k % 2 == 1, ident).otherwise("someone")).alias("prompt"))
    responses = o.select(task.alias("task_id"), F.lit(1).cast("bigint").alias("step"), F.concat(F.lit("found "), F.when(k % 3 != 0, hex_id).otherwise("none")).alias("text"))
    return W.discovery_audit(steps, prompts, responses)


# -- behaviour ---------------------------------------------------------------------------

@query(
    "b01_filter_terms",
    sql("""select episode_id, seq, list_aggregate(list_sort(case when route='sql' then ['k'||k,'final'] when event_type='view' then ['c'||user_id,'k'||k,'2024-01-'||lpad(cast(k%28+1 as varchar),2,'0')] when event_type='error' then ['k'||k] else [] end), 'string_agg', ' ') as terms from ev where event_type in ('view','error')""", "ev"),
)
def filter_terms(spark, sf):
    e = _ev(spark, sf).where(B.is_search())
    return e.select("episode_id", "seq", F.array_join(F.array_sort(B.filter_terms(F.col("route"), F.col("query"))), " ").alias("terms"))


@query(
    "b02_query_features",
    sql("""select episode_id, seq, length(query) as characters, strlen(query) as utf8_bytes, route,
        case when route='sql' then null when event_type='view' then 4 when event_type='error' then 2 else 0 end as parameter_count,
        case when route='sql' then 2 when event_type='view' then 3 when event_type='error' then 1 else 0 end as predicate_count,
        case when route='rest' then 0 end as chain_depth, case when route='sql' then null when event_type='view' then 1 else 0 end as temporal_filters,
        case when route='sql' then 0 end as joins, case when route='sql' then 2 end as selected_columns from ev""", "ev"),
)
def query_features(spark, sf):
    f = B.query_features(_ev(spark, sf))
    return f.drop("distinct_parameters", "includes", "reverse_chains", "subqueries", "group_by")


@query(
    "b03_opening_action",
    sql("""with f as (select * from ev where seq=1), t as (select episode_id, max(case when event_type in ('view','error') and round=1 then 1 else 0 end) as x from ev group by 1)
        select f.episode_id, case when event_type in ('view','error') then 1 else 0 end as first_action_targeted_search, 0 as first_action_broad_search,
        case when event_type='click' then 1 else 0 end as first_action_document_read, t.x as first_turn_targeted_search from f join t on t.episode_id=f.episode_id""", "ev"),
)
def opening_action(spark, sf):
    return B.opening_action(_ev(spark, sf))


@query(
    "b04_hit_flags",
    sql(f"""with h as (select episode_id, seq, 1 as r, max(case when fields_shown then 1 else 0 end) as f from evref where {_TARGET} group by 1,2),
        e as (select ev.*, coalesce(r,0) as r, coalesce(f,0) as f, event_type in ('view','error') as search, event_type in ('view','click','error') as read from ev left join h on h.episode_id=ev.episode_id and h.seq=ev.seq),
        a as (select episode_id, min(case when search then seq end) as s from e group by 1)
        select e.episode_id, coalesce(max(case when e.seq=a.s then r end),0) as first_search_gold_resource_hit, coalesce(max(case when e.seq=a.s then f end),0) as first_search_required_fields_hit,
        coalesce(max(case when read and round=1 then r end),0) as first_turn_gold_resource_hit, coalesce(max(case when read and round=1 then f end),0) as first_turn_required_fields_hit,
        coalesce(avg(case when search then r end),0) as gold_resource_search_hit_rate from e join a on a.episode_id=e.episode_id group by 1""", "ev", "evref"),
)
def hit_flags(spark, sf):
    return B.hit_flags(_ev(spark, sf), _tasks(spark, sf))


@query(
    "b05_result_volume",
    sql("""select episode_id, coalesce(avg(case when event_type='view' then case when route='sql' then 1 else 2 end when event_type='error' then 0 end),0) as unique_resources_per_search_mean,
        coalesce(avg(case when event_type='view' then case when route='sql' then 1 else 2 end when event_type='error' then 0 end),0) as backend_resources_per_search_mean from ev group by 1""", "ev"),
)
def result_volume(spark, sf):
    return B.result_volume(_ev(spark, sf))


@query(
    "b06_novelty",
    sql("""with s as (select *, case when k%10=9 then null else 'k'||k end as t from ev where event_type in ('view','error')),
        a as (select episode_id, count(*)=count(t) as ok from s group by 1)
        select e.episode_id, case when coalesce(ok,false) then (select count(distinct t) from s where s.episode_id=e.episode_id and t<>'k'||(user_id%100)) else -1 end as novel_filter_terms,
        case when coalesce(ok,false) then 1 else 0 end as filter_novelty_observed from (select distinct episode_id from ev) e left join a on a.episode_id=e.episode_id""", "ev"),
)
def novelty(spark, sf):
    e = _ev(spark, sf).withColumn(
        "filter_terms_not_previously_observed", F.when(F.col("k") % 10 != 9, F.array(F.concat(F.lit("k"), F.col("k").cast("string"))))
    )
    return B.novelty_counts(e, _tasks(spark, sf))


@query(
    "b07_token_usage",
    """select doc_id, 2 as model_turns, case when doc_id%5=0 then 0 else 1 end as token_usage_complete, case when doc_id%5=0 then 0.5e0 else 1.0e0 end as token_usage_call_coverage,
       case when doc_id%5=0 then -1.0e0 else n_chars+7 end as model_input_tokens, case when doc_id%5=0 then -1.0e0 else n_chars%97+3 end as model_output_tokens,
       case when doc_id%5=0 then -1.0e0 else n_chars+7+n_chars%97+3 end as model_total_tokens, cast(n_chars + case when doc_id%5=0 then 0 else 7 end as double) as observed_model_input_tokens,
       cast(n_chars%97 + case when doc_id%5=0 then 0 else 3 end as double) as observed_model_output_tokens from documents""",
)
def token_usage(spark, sf):
    d = table(spark, sf, "documents").drop("text")
    step = lambda p, c: F.struct(F.struct(F.struct(p.cast("double").alias("prompt_tokens"), c.cast("double").alias("completion_tokens")).alias("usage")).alias("response"))
    second = F.when(F.col("doc_id") % 5 == 0, step(F.lit(-1), F.lit(3))).otherwise(step(F.lit(7), F.lit(3)))
    t = d.select("doc_id", F.array(step(F.col("n_chars"), F.col("n_chars") % 97), second).alias("trajectory"))
    return B.token_usage(t, "doc_id")


# -- scores ------------------------------------------------------------------------------

@query(
    "j12_x03_evidence",
    sql(f"""with h as (select distinct episode_id, ref from evref where status<300 and {_HIT} and (ref='Patient/c'||user_id or {_TARGET})),
        c as (select distinct episode_id, user_id from ev), s as (select episode_id, user_id, user_id%3 as m from c)
        select s.episode_id, (case when m in (0,2) and exists(select 1 from h where h.episode_id=s.episode_id and ref like 'Pat%') then 1 else 0 end + case when m in (0,1) and exists(select 1 from h where h.episode_id=s.episode_id and ref like 'Ser%') then 1 else 0 end)/2.0 as evidence_recall,
        (case when m in (0,2) and exists(select 1 from h where h.episode_id=s.episode_id and ref like 'Pat%') then 1 else 0 end + case when m in (0,1) and exists(select 1 from h where h.episode_id=s.episode_id and ref like 'Ser%') then 1 else 0 end)/(case m when 1 then 1.0 else 2.0 end) as evidence_precision from s""", "ev", "evref"),
)
def evidence(spark, sf):
    e, t = _ev(spark, sf), _tasks(spark, sf)
    m = F.col("user_id") % 3
    cited = F.when(m == 0, F.col("evidence")).when(m == 1, F.slice("evidence", 2, 1)).otherwise(F.array(F.element_at("evidence", 1), F.lit("Task/none")))
    return S.evidence_pr(t.select("episode_id", cited.alias("submitted")), t, S.evidence_access(e, t))


def _finals(t):
    """A final text per episode: right, wrong value, boolean for a number, fenced, or no JSON."""
    u = F.col("user_id").cast("string")
    cited = F.concat(F.lit('"evidence":["'), F.array_join("evidence", '","'), F.lit('"]}'))
    m = F.col("user_id") % 5
    good = F.concat(F.lit('{"answer":{"id":'), u, F.lit(',"ok":true},'), cited)
    text = (
        F.when(m == 0, good).when(m == 1, F.concat(F.lit('{"answer":{"id":'), u, F.lit(',"ok":1},'), cited))
        .when(m == 2, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(m == 3, F.lit("I do not know"))
        .otherwise(F.concat(F.lit('{"answer":{"ok":true,"id":'), u, F.lit(".0},"), cited))
    )
    return t.select("episode_id", text.alias("final"))


def _with_gold(t):
    return t.withColumn("gold_answer", F.concat(F.lit('{"id":'), F.col("user_id").cast("string"), F.lit(',"ok":true}')))


@query(
    "x01_x02_answer_ok",
    "select 'ep'||user_id as episode_id, user_id%5 in (0,4) as strict_ok, user_id%5 in (0,2,4) as fenced_ok from (select distinct user_id from events) z",
)
def answer_ok(spark, sf):
    t = _with_gold(_tasks(spark, sf))
    strict = S.answer_ok(S.parse_finals(_finals(t)), t).withColumnRenamed("answer_ok", "strict_ok")
    return strict.join(S.answer_ok(S.parse_finals(_finals(t), True), t).withColumnRenamed("answer_ok", "fenced_ok"), "episode_id")


_BODY = ('{"resourceType":"Task","id":"', '","meta":{"versionId":"', '"},"status":"', '"}')


def _body(k, version, status):
    a, b, c, d = _BODY
    return F.concat(F.lit(a), k.cast("string"), F.lit(b), F.lit(str(version)), F.lit(c), status, F.lit(d))


def _writes(spark, sf):
    """Audit and gold changes per order: some right, some spoilt and restored, some of another field or record."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 6
    ep = F.concat(F.lit("e"), k.cast("string"))
    ref = F.concat(F.lit("Task/"), k.cast("string"))
    row = lambda seq, method, r, before, after: F.struct(F.lit(seq).alias("seq"), F.lit(method).alias("method"), r.alias("ref"), before.alias("before"), after.alias("after"))
    null = F.lit(None).cast("string")
    done, draft = F.lit("completed"), F.lit("draft")
    right = row(1, "PUT", ref, _body(k, 1, draft), _body(k, 2, done))
    spoil = row(1, "PUT", ref, _body(k, 1, draft), _body(k, 2, F.lit("failed")))
    restore = row(2, "PUT", ref, _body(k, 2, F.lit("failed")), _body(k, 3, done))
    create = row(2, "POST", F.concat(F.lit("Task/created-"), k.cast("string")), null, F.concat(F.lit('{"id":"new","meta":{"versionId":"1"},"resourceType":"Task","description":"d'), k.cast("string"), F.lit('"}')))
    delete = row(3, "DELETE", F.concat(F.lit("Task/old-"), k.cast("string")), _body(k, 1, draft), null)
    stray = row(3, "DELETE", F.concat(F.lit("Task/other-"), k.cast("string")), _body(k, 1, draft), null)
    rows = (
        F.when(m == 0, F.array(right, create, delete)).when(m == 1, F.array(spoil, restore)).when(m == 2, F.array(right, stray))
        .when(m == 3, F.array(right, create)).otherwise(F.array(right))
    )
    audit = o.select(ep.alias("episode_id"), F.explode(rows).alias("r")).select("episode_id", "r.*")
    updates = o.select(ep.alias("episode_id"), ref.alias("ref"), F.lit("status").alias("field"), F.lit('"completed"').alias("value"))
    creates = o.where("o_orderkey % 6 <> 3").select(ep.alias("episode_id"), F.concat(F.lit('{"resourceType":"Task","description":"d'), k.cast("string"), F.lit('"}')).alias("body"))
    deletes = o.select(ep.alias("episode_id"), F.concat(F.lit("Task/old-"), k.cast("string")).alias("ref"))
    return audit, updates, creates, deletes


@query(
    "x04_x05_audit_allowed",
    """select 'e'||o_orderkey as episode_id, case when m in (1,2) then 2 when m=0 then 3 when m=3 then 2 else 1 end as writes,
       case m when 0 then 3 when 1 then 1 when 2 then 1 when 3 then 1 else 1 end as allowed from (select o_orderkey, o_orderkey%6 as m from orders) z""",
)
def audit_allowed(spark, sf):
    a = S.audit_allowed(*_writes(spark, sf))
    return a.groupBy("episode_id").agg(F.count(F.lit(1)).alias("writes"), F.count_if("ok").alias("allowed")).withColumn(
        "allowed", F.col("allowed")
    )


@query(
    "x05_mutation_integrity",
    sql(f"""with h as (select episode_id, ref, min(seq) as s from evref where status<300 and method in ('GET','SELECT') and {_HIT} and (ref='Patient/c'||user_id or {_TARGET}) group by 1,2),
        w as (select episode_id, min(seq) as fw, count(*) as n from ev where method in ('POST','PUT') and status<300 group by 1),
        u as (select distinct episode_id, user_id from ev)
        select u.episode_id, (user_id%4<>1) and (w.n is null or user_id%2=1 or (count(s)=2 and max(s)<fw)) and user_id%7<>0 and user_id%11<>0 as integrity
        from u left join w on w.episode_id=u.episode_id left join h on h.episode_id=u.episode_id group by u.episode_id, user_id, w.n, fw""", "ev", "evref"),
)
def mutation_integrity(spark, sf):
    e, t = _ev(spark, sf), _tasks(spark, sf)
    u = F.col("user_id")
    t = t.withColumn("requires_read_before_write", u % 2 == 0).withColumn("requires_transaction", F.lit(False))
    wrote = e.where("method in ('POST','PUT') and status < 300").select("episode_id", "user_id").distinct()
    every = wrote.unionByName(t.where("user_id % 4 = 1").select("episode_id", "user_id")).distinct()
    writes = every.select("episode_id", (u % 4 != 1).alias("ok"))
    order = S.read_before_write(e, t)
    single = S.one_transaction(e, t.select("episode_id", F.lit(1).alias("entries")))
    return S.mutation_integrity(t, writes, order, single, t.where("user_id % 7 = 0"), t.where("user_id % 11 = 0"))


@query(
    "x05_one_transaction",
    sql("""select e.episode_id, coalesce(count(*) filter (method in ('POST','PUT') and status<300)=1 and min(query) filter (method in ('POST','PUT') and status<300)='', false) as ok
        from (select episode_id, method, status, case when query='Task' then '' else query end as query from ev) e group by 1""", "ev"),
)
def one_transaction(spark, sf):
    e = _ev(spark, sf).withColumn("query", F.when(F.col("query") == "Task", "").otherwise(F.col("query")))
    return S.one_transaction(e, e.select("episode_id", F.lit(1).alias("entries")).distinct())


@query(
    "x06_u05_state_delta",
    """select 'e'||o_orderkey as episode_id, case m when 1 then 'changed' when 2 then 'undeleted' when 3 then 'extra_create' when 4 then 'missing_create' when 5 then 'missing' end as kind
       from (select o_orderkey, o_orderkey%6 as m from orders) z where m>0""",
)
def state_delta(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 6
    ep = F.concat(F.lit("e"), k.cast("string"))
    ref = lambda p: F.concat(F.lit(p), k.cast("string"))
    doc = lambda r, body: F.struct(r.alias("ref"), body.alias("body"))
    made = F.concat(F.lit('{"id":"n1","meta":{"versionId":"1"},"resourceType":"Task","description":"new"}'))
    a, b, c = doc(ref("Task/a"), _body(k, 1, F.lit("draft"))), doc(ref("Task/b"), _body(k, 1, F.lit("draft"))), doc(ref("Task/c"), _body(k, 1, F.lit("draft")))
    a2 = doc(ref("Task/a"), _body(k, 2, F.when(m == 1, "failed").otherwise("completed")))
    new, extra = doc(ref("Task/new"), made), doc(ref("Task/extra"), F.lit('{"id":"n2","resourceType":"Task","description":"other"}'))
    after = (
        F.when(m == 2, F.array(a2, b, c, new)).when(m == 3, F.array(a2, b, new, extra)).when(m == 4, F.array(a2, b)).when(m == 5, F.array(a2, new))
        .otherwise(F.array(a2, b, new))
    )
    rows = lambda arr: o.select(ep.alias("episode_id"), F.explode(arr).alias("d")).select("episode_id", "d.ref", F.parse_json("d.body").alias("v"))
    updates = o.select(ep.alias("episode_id"), ref("Task/a").alias("ref"), F.lit("status").alias("field"), F.lit('"completed"').alias("value"))
    creates = o.select(ep.alias("episode_id"), F.lit('{"resourceType":"Task","description":"new"}').alias("body"))
    deletes = o.select(ep.alias("episode_id"), ref("Task/c").alias("ref"))
    return S.state_delta(rows(F.array(a, b, c)), rows(after), updates, creates, deletes).select("episode_id", "kind")


@query(
    "x07_absence_checked",
    sql("""select u.episode_id, case when u.user_id%2=0 then cast(min(seq) as integer) else 0 end as absent_at from (select distinct episode_id, user_id from ev) u
        left join ev on ev.episode_id=u.episode_id and event_type='view' and route='rest' and k%3=0 group by u.episode_id, u.user_id having u.user_id%2=1 or min(seq) is not null""", "ev"),
)
def absence(spark, sf):
    e = _ev(spark, sf)
    rest_view = (F.col("route") == "rest") & F.col("query").startswith("Observation?patient")
    plain = F.concat(F.lit("DocumentReference?patient=c"), F.col("user_id").cast("string"), F.lit("&type=external&_count=5"))
    e = e.withColumn("query", F.when(rest_view, plain).otherwise(F.col("query")))
    scope = F.struct(F.lit("DocumentReference").alias("resourceType"), F.col("patient_ref").alias("patient"), F.lit("external").alias("code"), F.lit(None).cast("string").alias("tag"))
    t = _tasks(spark, sf).withColumn("absence_scope", F.when(F.col("user_id") % 2 == 0, scope))
    return S.absence_call(e, t)


def _parts(spark, sf, fence=False):
    e, t = _ev(spark, sf), _with_gold(_tasks(spark, sf))
    parsed = S.parse_finals(_finals(t), fence)
    access = S.evidence_access(e, t)
    calls = e.groupBy("episode_id").agg(F.count(F.lit(1)).alias("tool_calls"))
    parts = (
        S.answer_ok(parsed, t).join(S.evidence_pr(parsed, t, access), "episode_id")
        .join(t.select("episode_id", "reference_calls", (F.col("user_id") % 10 != 9).alias("state_ok"), F.lit(True).alias("absence_ok")), "episode_id")
        .join(calls, "episode_id")
    )
    return e, t, access, parts


_SCORE = f"""h as (select episode_id, count(distinct ref) as n from evref where status<300 and {_HIT} and (ref='Patient/c'||user_id or {_TARGET}) group by 1),
p as (select u.episode_id, u.user_id, u.calls, coalesce(n,0)/2.0 as r, user_id%10<>9 as st from (select episode_id, user_id, count(*) as calls from ev group by 1,2) u left join h on h.episode_id=u.episode_id)"""


@query(
    "x08_score",
    sql(f"""with {_SCORE} select episode_id, case when user_id%5 in (0,4) and r=1 and st then 1.0e0 else 0.0e0 end as strict_success, case when user_id%5 in (0,4) then 1.0e0 else 0.0e0 end as answer_success,
        case when st then 1.0e0 else 0.0e0 end as state_success, case when user_id%5 in (2,3) then 0 else r end as evidence_recall, case when user_id%5 in (2,3) then 0 else r end as evidence_precision,
        case when user_id%5 in (0,4) and r=1 and st then 1 - 0.1e0*least(1.0e0, greatest(0, calls-3)/40.0e0) else 0.0e0 end as reward from p""", "ev", "evref"),
)
def score(spark, sf):
    return S.score(_parts(spark, sf)[3], 0.1)


@query(
    "x10_score_training",
    sql(f"""with {_SCORE} select episode_id, case when user_id%5 in (0,4) and r=1 and st then 1.0e0 else 0.0e0 end as strict_success, case when user_id%5 in (0,2,4) and r=1 and st then 1.0e0 else 0.0e0 end as canonical_success,
        case when user_id%5=3 then 0 else 1 end as json_format_valid, case when user_id%5 in (0,2,4) and r=1 and st then 1.0e0 else 0.0e0 end as workflow_success, r as retrieval_progress,
        case when st then 1 else 0 end as mutation_integrity, case when not (user_id%5 in (0,2,4) and r=1 and st) and st then 0.2e0*r else 0.0e0 end as retrieval_shaping,
        case when user_id%5 in (0,2,4) and r=1 and st then 1.0e0 when st then 0.2e0*r else 0.0e0 end as reward from p""", "ev", "evref"),
)
def score_training(spark, sf):
    _, t, access, strict = _parts(spark, sf)
    fenced = _parts(spark, sf, True)[3]
    got = access.groupBy("episode_id").agg(F.count_if("eligible").alias("eligible"), F.count(F.lit(1)).alias("required"))
    extra = S.parse_finals(_finals(t), True).select("episode_id", F.col("keys_ok").alias("json_format_valid")).join(got, "episode_id").join(
        t.select("episode_id", F.lit(True).alias("attempted"), (F.col("user_id") % 10 != 9).alias("integrity")), "episode_id"
    )
    return S.score_training(S.score(strict), S.score(fenced), extra, "json_or_fence", 0.2)


@query(
    "x09_cost_metrics",
    sql("""with r as (select distinct episode_id, user_id, ref from evref where method in ('GET','SELECT')),
        o as (select r.*, s.patient_ref as owner from r left join sr s on s.resource_ref=r.ref),
        c as (select episode_id, count(*) as u, count(*) filter (ref<>'Patient/c'||user_id and ref<>'ServiceRequest/o'||(user_id%100)) as g, count(*) filter (owner is not null and owner<>'Patient/c'||user_id) as x from o group by 1)
        select ev.episode_id, count(*) as tool_calls, count(*) as primitive_operations, round(sum(bytes),2) as response_bytes, 0.0e0 as context_bytes, count(*) filter (status>=400) as tool_errors,
        count(*) filter (method in ('GET','SELECT')) as read_calls, count(*) filter (method in ('POST','PUT')) as write_calls, coalesce(max(u),0) as unique_read_resources, coalesce(max(g),0) as non_gold_read_resources, coalesce(max(x),0) as cross_patient_read_resources
        from ev left join c on c.episode_id=ev.episode_id group by 1""", "ev", "evref", "sr"),
)
def cost_metrics(spark, sf):
    owners = charts.servicerequest(spark, sf).select(F.col("resource_ref").alias("ref"), "patient_ref")
    c = S.cost_metrics(_ev(spark, sf), _tasks(spark, sf), owners)
    return c.withColumn("response_bytes", F.round("response_bytes", 2)).withColumn("context_bytes", F.col("context_bytes").cast("double"))


@query(
    "x11_query_feature_stats",
    sql("""with f as (select episode_id, length(query) as ch, case when route='sql' then 0 when event_type='view' then 4 when event_type='error' then 2 else 0 end as pc,
          case when route='sql' then 2 when event_type='view' then 3 when event_type='error' then 1 else 0 end as pr from ev where event_type in ('view','click','error'))
        select e.episode_id, coalesce(avg(ch),0) as query_characters_mean, coalesce(max(ch),0) as query_characters_max, coalesce(avg(pc),0) as query_parameter_count_mean, coalesce(max(pr),0) as query_predicate_count_max
        from (select distinct episode_id from ev) e left join f on f.episode_id=e.episode_id group by 1""", "ev"),
)
def feature_stats(spark, sf):
    return B.query_feature_stats(_ev(spark, sf)).select("episode_id", "query_characters_mean", "query_characters_max", "query_parameter_count_mean", "query_predicate_count_max")


@query(
    "x12_sql_field_exposure",
    sql("""select 'q'||o_orderkey as query_id, 'ServiceRequest/o'||o_orderkey as ref, case when o_orderkey%3=0 then 'authoredOn,code,id,resource_ref,status,subject' when o_orderkey%3=1 then 'code,resource_ref' end as fields from orders where o_orderkey%3<2"""),
)
def sql_exposure(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 3
    q = F.concat(F.lit("q"), k.cast("string"))
    cols = F.when(m == 0, F.array(F.lit("resource_ref"), F.lit("resource_json"))).when(m == 1, F.array(F.lit("resource_ref"), F.lit("code"), F.lit("unit"))).otherwise(F.array(F.lit("code")))
    lineage = o.select(q.alias("query_id"), F.lit("s").alias("alias"), F.lit("ServiceRequest").alias("view"), F.explode(cols).alias("column"))
    ref = F.concat(F.lit("ServiceRequest/o"), k.cast("string"))
    results = o.select(q.alias("query_id"), F.lit("s").alias("alias"), ref.alias("ref"))
    docs = o.select(ref.alias("ref"), F.lit("ServiceRequest").alias("resource_type"), F.array(*[F.lit(x) for x in ("id", "status", "code", "subject", "authoredOn")]).alias("keys"))
    return S.sql_field_exposure(lineage, results, docs).withColumn("fields", F.array_join("fields", ","))


# -- traces ------------------------------------------------------------------------------

def _nodes(spark, sf):
    """Conversations as message rows; odd assistant turns call a tool answered in the next row."""
    c = table(spark, sf, "conversations")
    call = F.array(F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("fhir_request").alias("name"), F.lit("{}").alias("arguments")))
    base = c.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("episode_id"), F.lit(0).alias("trace"), (F.col("turn") * 2).alias("pos"),
        (F.col("turn") > 1).alias("sampled"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_call_id"),
        F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), call).alias("tool_calls"),
    )
    tool = base.where("tool_calls is not null").select(
        "episode_id", "trace", (F.col("pos") + 1).alias("pos"), F.lit(False).alias("sampled"), F.lit("tool").alias("role"), F.lit("result").alias("content"),
        F.col("tool_calls")[0]["id"].alias("tool_call_id"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls"),
    )
    return base.unionByName(tool)


_NODES = """nodes as (select 'conv'||conv_id as episode_id, turn*2 as pos, turn>1 as sampled, role, text as content, conv_id||'-'||turn as cid, role='assistant' and turn%4=3 as calls from conversations),
allnodes as (select episode_id, pos, sampled, role, content from nodes union all select episode_id, pos+1, false, 'tool', 'result' from nodes where calls)"""


@query(
    "r06_turn_table",
    f"""with {_NODES}, t as (select *, sum(case when role='assistant' and sampled then 1 else 0 end) over (partition by episode_id order by pos) as turn from allnodes)
        select episode_id, pos, role, cast(turn as bigint) as turn, md5(content) as content_md5 from t where turn>0 and ((role='assistant' and sampled) or role in ('tool','user'))""",
)
def turn_table(spark, sf):
    return R.turn_table(_nodes(spark, sf)).select("episode_id", "pos", "role", "turn", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


@query("j17_call_result_pairs", f"with {_NODES} select episode_id, pos as call_pos, cid as tool_call_id, 'fhir_request' as tool, pos+1 as result_pos from nodes where calls")
def call_pairs(spark, sf):
    return R.call_result_pairs(_nodes(spark, sf)).select("episode_id", "call_pos", "tool_call_id", "tool", "result_pos")


@query("r07_final_answer", f"with {_NODES} select episode_id, md5(max_by(content, pos)) as final_md5 from nodes where sampled and role='assistant' group by 1")
def final_answer(spark, sf):
    return R.final_answers(_nodes(spark, sf)).select("episode_id", F.md5(F.encode("final", "UTF-8")).alias("final_md5"))


def _episodes(spark, sf):
    """One stored episode per document."""
    d = table(spark, sf, "documents").drop("text").join(table(spark, sf, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    metrics = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("strict_success"), F.col("quality").cast("double"), F.lit("calls"), (k % 7 - 1).cast("double"))).otherwise(
        F.create_map(F.lit("calls"), (k % 7 - 1).cast("double"))
    )
    call = F.struct(F.lit("m1").alias("model"), F.struct(F.lit(1.0).alias("prompt_tokens"), F.when(k % 5 > 0, F.col("n_chars").cast("double")).alias("completion_tokens")).alias("usage"))
    node = F.lit(None).cast("array<struct<parent:int,sampled:boolean,message:struct<role:string,content:string>>>")
    rewards = F.when(k % 4 > 0, F.create_map(F.lit("r"), F.struct((k % 3).cast("double").alias("score"), F.lit(0.5).alias("weight"))))
    trace = F.struct(
        F.lit(1).alias("version"), F.lit(True).alias("ok"), F.when(k % 11 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        node.alias("nodes"), F.array(call, call).alias("calls"), rewards.alias("rewards"), metrics.alias("metrics"),
    )
    return d.select(
        F.concat(F.lit("ep"), k.cast("string")).alias("id"), F.col("source").alias("run"), F.lit(True).alias("ok"), F.array().cast("array<string>").alias("errors"),
        F.struct(F.concat(F.lit("t"), (F.col("n_chars") % 9).cast("string")).alias("key")).alias("task"), F.array(trace).alias("traces"), "lang", "doc_id",
    )


_EP = """ep as (select d.doc_id, 'ep'||d.doc_id as id, source as run, 't'||(n_chars%9) as task, n_chars, lang, quality,
 case when d.doc_id%11=0 then 'Error' when quality is null then 'Unscored' when quality=1 then 'Correct' else 'Incorrect' end as outcome from documents d left join labels l on l.doc_id=d.doc_id)"""


@query(
    "r03_r04_r05_outcome_metric_usage",
    f"with {_EP} select id, outcome, cast(quality as double) as strict_success, 2 as calls, case when doc_id%5>0 then 2.0e0*n_chars end as output_tokens from ep",
)
def outcomes(spark, sf):
    e = _episodes(spark, sf)
    return e.select("id", R.outcome().alias("outcome"), R.episode_metric("strict_success").alias("strict_success"), R.usage().alias("u")).select("id", "outcome", "strict_success", "u.*")


def _outcomes(spark, sf):
    return _episodes(spark, sf).select("run", R.task_key().alias("task"), R.outcome().alias("outcome"))


@query("a13_outcome_counts", f"with {_EP} select run, count(*) filter (outcome='Correct') as Correct, count(*) filter (outcome='Incorrect') as Incorrect, count(*) filter (outcome='Error') as Error, count(*) filter (outcome='Unscored') as Unscored from ep group by 1")
def outcome_counts(spark, sf):
    return R.outcome_counts(_outcomes(spark, sf), "run")


@query("a14_solved_examples", f"with {_EP} select run, count(*) as examples, cast(sum(s) as bigint) as solved from (select run, task, max(case when outcome='Correct' then 1 else 0 end) as s from ep group by 1,2) z group by 1")
def solved(spark, sf):
    return R.solved_examples(_outcomes(spark, sf), "run", "task")


@query(
    "a12_run_means",
    f"""with {_EP} select run, 'strict_success' as metric, avg(quality) as mean, 0 as missing from ep where quality is not null group by 1 union all
        select run, 'calls', avg(case when doc_id%7>0 then doc_id%7-1 end), count(*) filter (doc_id%7=0) from ep group by 1""",
)
def run_means(spark, sf):
    t = _episodes(spark, sf).select("run", F.explode("traces").alias("t")).select("run", "t.metrics")
    return R.run_means(t, "run")


@query("a12_mean_reward", f"with {_EP} select run, avg(case when doc_id%4>0 then (doc_id%3)*0.5 end) as mean_reward, count(*) filter (doc_id%11=0) as episodes_with_errors from ep group by 1")
def mean_reward(spark, sf):
    t = _episodes(spark, sf).select("run", F.explode("traces").alias("t"))
    return t.groupBy("run").agg(F.avg(R.weighted_reward(F.col("t.rewards"))).alias("mean_reward"), F.count_if(F.size("t.errors") > 0).alias("episodes_with_errors"))


@query("r08_prompt_text", "select conv_id, turn, '['||role||']'||chr(10)||text||chr(10)||chr(10)||'[unknown]'||chr(10)||'a'||chr(10)||'[image attachment]' as prompt from conversations")
def prompts(spark, sf):
    c = table(spark, sf, "conversations")
    msgs = F.concat(
        F.lit("["), F.to_json(F.struct("role", F.col("text").alias("content"))), F.lit(',{"content":[{"text":"a"},{"type":"image"}]}]')
    )
    return c.select("conv_id", "turn", R.prompt_text(F.parse_json(msgs)).alias("prompt"))


_STATES = ["Completed", "Failed", "Failed", "Evaluation completed; reporting pending", "GPU stage failed", "GPU stage started; final outcome not recorded", "Prepared; no GPU outcome recorded", "Submitted; no preparation outcome recorded"]


@query(
    "r09_run_status",
    "select 'run-20260101-000000Z-'||s_suppkey as run, " + "[" + ",".join(f"'{s}'" for s in _STATES) + "][s_suppkey%8+1] as state, nullif(s_suppkey%4*3,0) as requested, case when s_suppkey%3=0 then 'plan' when s_suppkey%3=1 then 'call' else 'Unknown' end as model, '20260101-000000Z' as submitted from supplier",
)
def run_status(spark, sf):
    k = F.col("s_suppkey")
    m = k % 8
    r = table(spark, sf, "supplier").select(
        F.concat(F.lit("run-20260101-000000Z-"), k.cast("string")).alias("run"), F.when(m == 0, "completed").when(m == 1, "failed").alias("finished_status"),
        (m == 2).alias("prepare_failed"), m.isin(3, 4, 5).alias("gpu"), F.when(m == 3, "completed").when(m == 4, "failed").alias("gpu_status"), F.lit(None).cast("string").alias("gpu_error"),
        F.when(m == 4, 3.0).alias("gpu_elapsed"), F.when(m == 6, "prepared").alias("prepared_status"), (k % 4).alias("num_examples"), F.lit(3).alias("rollouts_per_example"),
        F.when(k % 3 == 0, "plan").alias("plan_model"), F.when(k % 3 == 1, "call").alias("call_model"),
    )
    return R.run_status(r)


@query("r10_family_label", "select doc_id, case when doc_id%3=0 then replace('fam_'||source,'_',' ') when doc_id%3=1 then lang else 'Task' end as family from documents")
def family(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", R.family_label(F.when(k % 3 == 0, F.concat(F.lit("fam_"), "source")), F.when(k % 3 == 1, F.col("lang")).otherwise("")).alias("family"))


@query(
    "k12_complete_runs",
    "select source as run, count(*) as found, min(doc_id)%2=0 as complete from documents group by 1",
)
def complete_runs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("run"), "doc_id")
    plans = d.groupBy("run").agg(
        F.lit("completed").alias("status"), F.count(F.lit(1)).alias("num_examples"), F.lit(1).alias("rollouts_per_example"),
        (F.count(F.lit(1)) + F.min("doc_id") % 2).alias("receipt_episodes"),
    )
    return R.complete_runs(plans, d)


@query(
    "a15_severity_counts",
    """select case when l_orderkey%2=0 then 'old' else 'new' end as side, 0 as fatal, count(*) filter (l_returnflag='R') as error, count(*) filter (l_returnflag='A') as warning,
       count(*) filter (l_returnflag='N') as information, count(distinct case when l_returnflag='R' then l_orderkey end) as resources_with_errors from lineitem group by 1""",
)
def severity(spark, sf):
    li = table(spark, sf, "lineitem")
    f = F.col("l_returnflag")
    issues = li.select(
        F.when(F.col("l_orderkey") % 2 == 0, "old").otherwise("new").alias("side"), F.when(f == "R", "error").when(f == "A", "warning").otherwise("information").alias("severity"),
        F.col("l_orderkey").alias("resource"),
    )
    return R.severity_counts(issues)
