"""Search predicates, joins, paging and the chart tools, each over whole tables."""

from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.operators import catalogue, search
from chartloom.plans import charts
from chartloom.plans.charts import table
from chartloom.plans.registry import query
from chartloom.plans.sqltext import sql
from chartloom.session import checkpointed


def _found(url, *kinds):
    def run(spark, sf):
        return search.matches(charts.resources(spark, sf, *kinds), url).select("ref")

    return run


_SINGLE = {
    "f1_token": ("Observation?code=urn:chart:codes|ECONOMY,PROMO&status=final", ["Observation"], sql("select resource_ref as ref from obs where code in ('ECONOMY','PROMO') and status='final'", "obs")),
    "f2_identifier": ("ServiceRequest?identifier=ORD-77,https://fhir-workflows.example/mrn|ORD-78,other|ORD-79", ["ServiceRequest"], sql("select resource_ref as ref from sr where identifier in ('ORD-77','ORD-78')", "sr")),
    "f3_name": ("Patient?name=CUSTOMER%23000000", ["Patient"], sql("select resource_ref as ref from patient where contains(lower(name), 'customer#000000')", "patient")),
    "f4_birthdate": ("Patient?birthdate=lt1980-01-01&gender=female", ["Patient"], sql("select resource_ref as ref from patient where birth_date<'1980-01-01' and gender='female'", "patient")),
    "f4_date_ne": ("Observation?date=ne1999-01-01&date=ge1998-06-01", ["Observation"], sql("select resource_ref as ref from obs where date<>'1999-01-01' and date>='1998-06-01'", "obs")),
    "f5_reference": ("Task?focus=ServiceRequest/o34,o12,o7,o40&status:missing=false", ["Task"], sql("select resource_ref as ref from task where focus_ref in ('ServiceRequest/o34','ServiceRequest/o12','ServiceRequest/o7','ServiceRequest/o40')", "task")),
    "f6_patient": ("Observation?patient=c7,Patient/c8", ["Observation"], sql("select resource_ref as ref from obs where patient_ref in ('Patient/c7','Patient/c8')", "obs")),
    "f6_appointment_patient": ("Appointment?patient=c7&status=booked", ["Appointment"], sql("select resource_ref as ref from appt where patient_ref='Patient/c7' and status='booked'", "appt")),
    "f7_missing": ("DocumentReference?type:missing=false&status=current", ["DocumentReference"], sql("select resource_ref as ref from docref", "docref")),
    "f8_id": ("ServiceRequest?_id=o5", ["ServiceRequest"], sql("select resource_ref as ref from sr where id='o5'", "sr")),
    "f9_tag": ("DocumentReference?_tag=https://fhir-workflows.example/origin|source-preserved", ["DocumentReference"], sql("select resource_ref as ref from docref where tag='source-preserved'", "docref")),
    "j2_chain": ("Observation?patient.identifier=https://fhir-workflows.example/mrn|MRN-12&status=final,preliminary", ["Observation", "Patient"], sql("select resource_ref as ref from obs where patient_ref='Patient/c12' and status in ('final','preliminary')", "obs")),
    "j3_medication_code": ("MedicationRequest?code=LARGE,STANDARD&status=active", ["MedicationRequest", "Medication"], sql("select q.resource_ref as ref from medreq q join medication m on m.resource_ref=q.medication_ref where m.code in ('LARGE','STANDARD') and q.status='active'", "medreq", "medication")),
}
for _name, (_url, _kinds, _sql) in _SINGLE.items():
    query(_name, _sql)(_found(_url, *_kinds))


@query(
    "f10_read_by_id",
    sql("""select 'ServiceRequest/o'||l_orderkey as ref, case when o_orderkey is null then 404 when o_orderstatus='P' then 410 else 200 end as status
        from (select distinct l_orderkey+7 as l_orderkey from lineitem) z left join orders on o_orderkey=l_orderkey"""),
)
def read_by_id(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") + 7).alias("k")).distinct()
    requests = li.select(charts.key("ServiceRequest/o", "k").alias("ref"))
    orders = charts.servicerequest(spark, sf).select(F.col("resource_ref").alias("ref"), "status")
    return search.read_by_id(requests, orders.where("status <> 'draft'"), orders.where("status = 'draft'"))


@query("f11_omit", sql("select resource_ref as ref from sr where resource_ref not in (select focus_ref from task)", "sr", "task"))
def omit(spark, sf):
    omitted = charts.task(spark, sf).select(F.col("focus_ref").alias("ref"))
    return search.hide(charts.servicerequest(spark, sf).select(F.col("resource_ref").alias("ref")), omitted)


@query(
    "f13_sql_where",
    sql("""select code, count(*) as n, sum(value) as total from obs where status in ('final','preliminary') and (value>=40 or date like '1999%')
        and unit is not null and regexp_matches(code, '^[A-M]') group by code having count(*)>5""", "obs"),
)
def sql_where(spark, sf):
    charts.observation(spark, sf).createOrReplaceTempView("Observation")
    return spark.sql(
        """SELECT code, count(*) AS n, sum(value) AS total FROM Observation
        WHERE status IN ('final', 'preliminary') AND (value >= 40 OR date LIKE '1999%') AND unit IS NOT NULL AND code RLIKE '^[A-M]'
        GROUP BY code HAVING count(*) > 5"""
    )


@query(
    "j4_sql_joins",
    sql("""select s.resource_ref, p.name, c.subscriber_id, count(o.resource_ref) as results, max(o.value) as top_value
        from sr s join patient p on p.resource_ref=s.patient_ref left join cov c on c.patient_ref=p.resource_ref and c.status='active'
        left join obs o on o.based_on_ref=s.resource_ref and o.status='final' and o.date>=s.date
        group by s.resource_ref, p.name, c.subscriber_id""", "sr", "patient", "cov", "obs"),
)
def sql_joins(spark, sf):
    for view, df in (("ServiceRequest", charts.servicerequest), ("Patient", charts.patient), ("Coverage", charts.coverage), ("Observation", charts.observation)):
        df(spark, sf).createOrReplaceTempView(view)
    return spark.sql(
        """SELECT s.resource_ref, p.name, c.subscriber_id, count(o.resource_ref) AS results, max(o.value) AS top_value
        FROM ServiceRequest s JOIN Patient p ON p.resource_ref = s.patient_ref
        LEFT JOIN Coverage c ON c.patient_ref = p.resource_ref AND c.status = 'active'
        LEFT JOIN Observation o ON o.based_on_ref = s.resource_ref AND o.status = 'final' AND o.date >= s.date
        GROUP BY s.resource_ref, p.name, c.subscriber_id"""
    )


# -- many queries at once, one per patient -----------------------------------------------

def _per_patient(spark, sf, pattern):
    """One query per patient; ``{}`` stands for the patient's number."""
    before, after = pattern.split("{}")
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    return c.select(charts.key("q", "c_custkey").alias("query_id"), F.concat(F.lit(before), k, F.lit(after)).alias("url"))


_LATEST = "Observation?patient=c{}&status=final&date=le2000-06-30&_sort=-date&_count=3"


@query(
    "l1_l2_batch_latest_page",
    sql("""select 'q'||substr(patient_ref, 10) as query_id, total, cast(rn as integer) as page_pos, resource_ref as ref, total>3 as more from (
        select *, row_number() over (partition by patient_ref order by date desc, resource_ref) as rn, count(*) over (partition by patient_ref) as total
        from obs where status='final' and date<='2000-06-30') z where rn<=3""", "obs"),
)
def batch_latest(spark, sf):
    found = search.batch_search(_per_patient(spark, sf, _LATEST), charts.resources(spark, sf, "Observation"))
    return found.drop("mode")


@query(
    "l2_second_page",
    sql("""select 'q'||substr(patient_ref, 10) as query_id, total, cast(rn-4 as integer) as page_pos, resource_ref as ref, total>8 as more from (
        select *, row_number() over (partition by patient_ref order by id desc) as rn, count(*) over (partition by patient_ref) as total
        from sr where status in ('active','draft')) z where rn>4 and rn<=8""", "sr"),
)
def batch_second_page(spark, sf):
    urls = _per_patient(spark, sf, "ServiceRequest?patient.identifier=MRN-{}&status=active,draft&_sort=-_id&_count=4&_page=1")
    return search.batch_search(urls, charts.resources(spark, sf, "ServiceRequest", "Patient")).drop("mode")


@query(
    "a1_search_total",
    sql("""select 'q'||substr(patient_ref, 10) as query_id, count(*) as total from sr where code='1-URGENT' and date>='1996-01-01' group by 1""", "sr"),
)
def search_total(spark, sf):
    urls = _per_patient(spark, sf, "ServiceRequest?patient=Patient/c{}&code=urn:chart:codes|1-URGENT&authored-on:missing=true")
    bad = _per_patient(spark, sf, "ServiceRequest?patient=Patient/c{}&code=1-URGENT")
    index = checkpointed(search.search_index(charts.resources(spark, sf, "ServiceRequest")))
    # The first form uses an unknown parameter, is refused and gives no rows.
    both = urls.withColumn("query_id", F.concat(F.lit("bad"), "query_id")).unionByName(bad)
    found = search.batch_matches(both, index).where("resource_date >= '1996-01-01'")
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))


@query(
    "j1_include",
    sql("""with page as (select * from (select *, row_number() over (partition by patient_ref order by id) as rn from
          (select distinct resource_ref, id, patient_ref from report) r) z where rn<=5)
        select 'q'||substr(patient_ref, 10) as query_id, resource_ref as ref, 'match' as mode from page
        union all select distinct 'q'||substr(p.patient_ref, 10), r.result_ref, 'include' from page p join report r on r.resource_ref=p.resource_ref where r.result_ref is not null
        union all select distinct 'q'||substr(p.patient_ref, 10), r.based_on_ref, 'include' from page p join report r on r.resource_ref=p.resource_ref""", "report"),
)
def include(spark, sf):
    urls = _per_patient(spark, sf, "DiagnosticReport?patient=c{}&_count=5&_include=DiagnosticReport:result&_include=DiagnosticReport:based-on")
    resources = charts.resources(spark, sf, "DiagnosticReport", "Observation", "ServiceRequest")
    queries = checkpointed(search.read_queries(urls))
    index = checkpointed(search.search_index(resources.where("resource_type = 'DiagnosticReport'"), asked=search.fields_asked(queries)))
    return search.batch_search(queries, resources, index).select("query_id", "ref", "mode")


@query(
    "batch_errors",
    sql("""select 'q'||c_custkey as query_id, case c_custkey%6 when 0 then 'unsupported resource' when 1 then 'unsupported parameter'
        when 2 then 'unsupported date predicate' when 3 then 'invalid page' when 4 then 'unsupported include' end as error from customer"""),
)
def batch_errors(spark, sf):
    c = table(spark, sf, "customer")
    forms = ["Nothing?code=x", "Task?colour=red", "Observation?date=2024-01", "Task?_count=51", "Task?_include=Coverage:payor", "Task?status=draft&_page=2"]
    url = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return search.read_queries(c.select(charts.key("q", "c_custkey").alias("query_id"), url.alias("url"))).select("query_id", "error")


@query(
    "j14_identity_candidates",
    sql("""with req as (select conv_id, turn, 'MRN-'||(conv_id*3) as mrn, 'er#00000000'||(turn%10) as nm from conversations)
        select 'r'||conv_id||'-'||turn as request_id, n as candidates, case when n=0 then 'not_found' when n=1 then 'unique' else 'ambiguous' end as resolution
        from (select conv_id, turn, (select count(*) from patient p where case turn%3 when 0 then p.identifier=r.mrn when 1 then contains(lower(p.name), r.nm)
          else p.birth_date='1950-01-0'||(r.turn%10) and contains(lower(p.name), 'custom') end) as n from req r) z""", "patient"),
)
def identity_candidates(spark, sf):
    v = table(spark, sf, "conversations")
    form = F.col("turn") % 3
    s = lambda c: c.cast("string")
    requests = v.select(
        charts.key("r", "conv_id", "turn").alias("request_id"),
        F.when(form == 0, F.concat(F.lit("https://fhir-workflows.example/mrn|MRN-"), s(F.col("conv_id") * 3))).alias("identifier"),
        F.when(form == 1, F.concat(F.lit("ER#00000000"), s(F.col("turn") % 10))).when(form == 2, "Custom").alias("name"),
        F.when(form == 2, F.concat(F.lit("1950-01-0"), s(F.col("turn") % 10))).alias("birthdate"),
    )
    return search.find_patient(requests, charts.patient(spark, sf))


@query(
    "l6_timeline",
    sql("""with r as (select patient_ref, 'Observation' as resource_type, resource_ref as ref, date, id from obs union all
          select patient_ref, 'ServiceRequest', resource_ref, date, id from sr union all select patient_ref, 'Task', resource_ref, '', id from task union all
          select patient_ref, 'Communication', resource_ref, date, id from comm),
        z as (select *, row_number() over (partition by patient_ref, resource_type order by id) as rn, count(*) over (partition by patient_ref, resource_type) as n from r)
        select patient_ref, resource_type, ref, nullif(date,'') as date, cast(ceil(rn/50) as bigint) as page, n>50*ceil(rn/50) as continued from z where (date='' or (date>='1997-01-01' and date<='1999-12-31'))""",
        "obs", "sr", "task", "comm"),
)
def timeline(spark, sf):
    rows = None
    for kind in ("Observation", "ServiceRequest", "Task", "Communication"):
        df = charts.VIEWS[kind](spark, sf)
        date = F.col("date") if "date" in df.columns else F.lit("")
        part = df.select("patient_ref", F.lit(kind).alias("resource_type"), F.col("resource_ref").alias("ref"), "id", date.alias("resource_date"))
        rows = part if rows is None else rows.unionByName(part)
    return search.chart_timeline(rows, ["Observation", "ServiceRequest", "Task", "Communication"], "1997-01-01", "1999-12-31")


@query(
    "l6_timeline_entries",
    sql("""with r as (select patient_ref, 'ServiceRequest' as resource_type, resource_ref as ref, date, id, status, '{"coding":[{"code":"'||code||'","system":"urn:chart:codes"}]}' as label, '[]' as origin from sr union all
          select patient_ref, 'Task', resource_ref, '', id, status, '"'||description||'"', '[]' from task union all
          select patient_ref, 'Procedure', resource_ref, date, id, status, '{"coding":[{"code":"'||code||'","system":"urn:chart:codes"}]}', '[]' from proc),
        z as (select *, row_number() over (partition by patient_ref, resource_type order by id) as rn, count(*) over (partition by patient_ref, resource_type) as n from r),
        p as (select patient_ref, resource_type, ref, nullif(date,'') as date, cast(ceil(rn/5) as bigint) as page, n>5*ceil(rn/5) as continued, status, label, origin from z where (date='' or (date>='1997-01-01' and date<='1999-12-31')))
        select *, cast(row_number() over (partition by patient_ref, page order by coalesce(date,''), ref) as integer) as position from p""", "sr", "task", "proc"),
)
def entries(spark, sf):
    kinds = ["ServiceRequest", "Task", "Procedure"]
    r = charts.resources(spark, sf, *kinds)
    pages = search.chart_timeline(r, kinds, "1997-01-01", "1999-12-31", per_type=5)
    return search.timeline_entries(pages, r)


@query(
    "p32_supported_search",
    sql("""select 'Observation' as resource_type, 'code' as param, 'token' as param_type, count(distinct code) as values_seen from obs
        union all select 'Observation', 'status', 'token', count(distinct status) from obs
        union all select 'ServiceRequest', 'code', 'token', count(distinct code) from sr
        union all select 'ServiceRequest', 'status', 'token', count(distinct status) from sr
        union all select 'ServiceRequest', 'identifier', 'token', count(distinct identifier) from sr""", "obs", "sr"),
)
def supported_search(spark, sf):
    index = search.search_index(charts.resources(spark, sf, "Observation", "ServiceRequest"))
    used = index.select("resource_type", F.explode("tokens").alias("t")).groupBy("resource_type", F.col("t.field").alias("param")).agg(
        F.countDistinct("t.code").alias("values_seen")
    )
    return catalogue.supported_search(spark).join(used, ["resource_type", "param"]).drop("writable")
