"""Corpus reports, set rules, ETL, tasks and sinks over the driver's tables."""

from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions import text as X
from chartloom.operators import tasks as T
from chartloom.plans import charts, etl
from chartloom.plans import reports as P
from chartloom.plans.charts import table
from chartloom.plans.registry import query
from chartloom.plans.sqltext import sql
from chartloom.sources import contracts, files, relational, sinks

C = F.col


@query(
    "a02_corpus_counts",
    """select 'status' as dimension, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2
       union all select 'year', cast(year(o_orderdate) as varchar), count(*) from orders group by 2""",
)
def corpus_counts(spark, sf):
    return P.corpus_counts(table(spark, sf, "orders"), {"status": C("o_orderstatus"), "priority": C("o_orderpriority"), "year": F.year("o_orderdate")})


@query(
    "a03_distribution",
    """with r as (select o_custkey%7 as g, l_extendedprice as x, row_number() over (partition by o_custkey%7 order by l_extendedprice)-1 as i, count(*) over (partition by o_custkey%7) as n from lineitem join orders on o_orderkey=l_orderkey)
       select g, count(*) as count, min(x) as min, max(x) as max, round(avg(x),3) as mean, max(case when i=round_even((n-1)*0.25,0) then x end) as p25, max(case when i=round_even((n-1)*0.75,0) then x end) as p75, median(x) as median from r group by g""",
)
def distribution(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey")).select((C("o_custkey") % 7).alias("g"), C("l_extendedprice").alias("x"))
    return P.distribution(j, ["g"], "x")


@query("a04_histogram", "select n as value, count(*) as frequency from (select o_custkey, count(distinct o_orderpriority) as n from orders group by 1) z group by 1")
def histogram(spark, sf):
    return P.histogram(table(spark, sf, "orders"), "o_custkey", C("o_orderpriority"))


@query(
    "a05_per_family_profile",
    """select o_orderpriority as family, 'status' as dimension, o_orderstatus as value, count(*) as n from orders group by 1,3 union all
       select o_orderpriority, 'year', cast(year(o_orderdate) as varchar), count(*) from orders group by 1,3""",
)
def per_family(spark, sf):
    o = table(spark, sf, "orders")
    p = P.per_family_profile(o, "o_orderpriority", {"status": C("o_orderstatus"), "year": F.year("o_orderdate")})
    # The sums agree with the tasks, so this adds nothing.
    wrong = P.profile_mismatches(p, o, "o_orderpriority").select("family", "dimension", F.lit("mismatch").alias("value"), C("total").alias("n"))
    return p.unionByName(wrong)


@query(
    "a07_shape_counts",
    sql("""select 'ServiceRequest' as resource_type, count(*) as resources, 1 as shapes, 'active,completed,draft' as statuses from sr union all select 'Task', count(*), 1, 'draft,requested' from task union all
        select 'DocumentReference', count(*), 1, 'current' from docref""", "sr", "task", "docref"),
)
def shape_counts(spark, sf):
    return P.shape_counts(charts.resources(spark, sf, "ServiceRequest", "Task", "DocumentReference"))


@query("a07_observation_structures", sql("select 'valueQuantity' as structure, count(*) as n from obs", "obs"))
def structures(spark, sf):
    return P.observation_structures(charts.resources(spark, sf, "Observation"))


@query(
    "a08_describe_types",
    sql("""select 'MedicationRequest' as resource_type, count(*) as resources, 1 as distinct_shapes, 1 as distinct_features, count(*) as nonpatient_reference_edges from medreq union all
        select 'Task', count(*), 1, 0, count(*) from task union all select 'Specimen', count(*), 1, 0, count(*) from specimen""", "medreq", "task", "specimen"),
)
def describe(spark, sf):
    return P.describe(P.sample_facts(charts.resources(spark, sf, "MedicationRequest", "Task", "Specimen")), ["resource_type"])


@query(
    "a16_balanced_resample",
    sql("""with f as (select resource_ref as ref, case when substr(id,2)::bigint%3=0 then 'old' else 'new' end as side, 'Task' as t, 1 as e from task union all select resource_ref, case when substr(id,2)::bigint%3=0 then 'old' else 'new' end, 'Coverage', 1 from cov),
        b as (select t, min(n) as budget from (select t, side, count(*) as n from f group by 1,2) z group by 1),
        d as (select f.*, r.b, row_number() over (partition by r.b, f.t, side order by md5('17|'||r.b||'|'||ref)) as k from f, range(100) r(b)),
        s as (select d.side, d.b, count(distinct d.t) as shapes, sum(e) as edges from d join b on b.t=d.t where k<=budget group by 1,2)
        select side, avg(shapes) as distinct_shapes_mean, cast(min(edges) as bigint) as edges_min, cast(max(edges) as bigint) as edges_max from s group by 1""", "task", "cov"),
)
def balanced(spark, sf):
    side = F.when(F.substring("id", 2, 20).cast("bigint") % 3 == 0, "old").otherwise("new")
    r = charts.resources(spark, sf, "Task", "Coverage").withColumn("side", side)
    facts = P.sample_facts(r).join(r.select("ref", "side"), "ref")
    out = P.balanced_resample(facts, "side")
    return out.select("side", "distinct_shapes_mean", C("nonpatient_reference_edges_min").alias("edges_min"), C("nonpatient_reference_edges_max").alias("edges_max"))


@query("a17_sql_aggregates", sql("select code, status, count(*) as n, count(distinct patient_ref) as patients, sum(value) as total, avg(value) as mean, min(date) as first_date, max(date) as last_date from obs group by code, status having count(*)>1", "obs"))
def sql_aggregates(spark, sf):
    charts.observation(spark, sf).createOrReplaceTempView("Observation")
    return spark.sql("SELECT code, status, count(*) AS n, count(DISTINCT patient_ref) AS patients, sum(value) AS total, avg(value) AS mean, min(date) AS first_date, max(date) AS last_date FROM Observation GROUP BY code, status HAVING count(*) > 1")


def _ledger(spark, sf):
    """Lineage rows of orders and coverages."""
    s = charts.servicerequest(spark, sf).select("resource_ref", F.when(C("status") == "draft", "generated-workflow").otherwise("source-profile").alias("origin"), C("patient_ref").alias("source_patient_id"))
    return s.unionByName(charts.coverage(spark, sf).select("resource_ref", F.lit("source-preserved").alias("origin"), C("patient_ref").alias("source_patient_id")))


_LEDGER = """ledger as (select resource_ref, case when status='draft' then 'generated-workflow' else 'source-profile' end as origin, patient_ref as source_patient_id from sr union all select resource_ref, 'source-preserved', patient_ref from cov)"""


@query(
    "c01_coverage_report",
    sql(f"""with {_LEDGER} select 'task.status' as section, o_orderstatus as key, cast(count(*) as double) as value from orders group by 2 union all select 'ledger.origin', origin, count(*) from ledger group by 2
        union all select 'ledger.type', split_part(resource_ref,'/',1), count(*) from ledger group by 2 union all select 'patient.resources', cast(n as varchar), count(*) from (select source_patient_id, count(*) as n from ledger group by 1) z group by 2""", "sr", "cov"),
)
def coverage_report(spark, sf):
    return P.coverage_report(table(spark, sf, "orders"), _ledger(spark, sf), {"status": C("o_orderstatus")})


@query("c02_review_examples", "select o_orderpriority as family, min_by(o_orderkey, (case when o_orderstatus='F' and o_orderkey%50=3 then 0 else 1 end)*1000000000+o_orderkey) as o_orderkey from orders group by 1")
def review_examples(spark, sf):
    o = table(spark, sf, "orders").select(C("o_orderpriority").alias("family"), "o_orderkey", "o_orderstatus")
    out = P.review_examples(o, "family", (C("o_orderstatus") == "F") & (C("o_orderkey") % 50 == 3), "o_orderkey")
    return out.select("family", "o_orderkey")


@query(
    "c03_review_pack_rows",
    sql("""select 'x'||patient_ref as task_id, resource_ref as ref, coalesce(tag,'not present in ledger') as origin, md5(case when length(text)>1600 then substr(text,1,1600)||' [excerpt]' else text end) as excerpt_md5 from docref""", "docref"),
)
def review_pack(spark, sf):
    d = charts.documentreference(spark, sf)
    e = d.select(F.concat(F.lit("x"), "patient_ref").alias("task_id"), C("resource_ref").alias("ref"))
    l = d.where("tag is not null").select("resource_ref", C("tag").alias("origin"))
    out = P.review_pack_rows(e, l, d.select(C("resource_ref").alias("ref"), "text"))
    return out.select("task_id", "ref", "origin", F.md5(F.encode("excerpt", "UTF-8")).alias("excerpt_md5"))


@query("c04_probe_queries", sql("select 'p'||c_custkey as query_id, 'Coverage/k'||c_custkey as expected, case when c_acctbal>=0 then 1 else 0 end as n from customer where c_custkey%4=0 or c_acctbal<0"))
def probes(spark, sf):
    c = table(spark, sf, "customer")
    k = C("c_custkey").cast("string")
    expected = F.concat(F.lit("Coverage/k"), k)
    p = c.select(F.concat(F.lit("p"), k).alias("query_id"), F.concat(F.lit("Coverage?patient=c"), k, F.lit("&status=active")).alias("url"), F.when(C("c_custkey") % 4 == 0, F.concat(expected, F.lit("-other"))).otherwise(expected).alias("expected"))
    out = P.probe_queries(p, charts.resources(spark, sf, "Coverage"))
    return out.withColumn("expected", F.replace("expected", F.lit("-other"), F.lit("")))


@query("c05_branch_examples", "select o_orderstatus, o_orderpriority, min(o_orderkey) as o_orderkey, count(*) as cases from orders group by 1,2")
def branch_examples(spark, sf):
    return P.branch_examples(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("c06_type_delta", "select coalesce(a.k,b.k) as resource_type, coalesce(a.n,0) as old_n, coalesce(b.n,0) as new_n, coalesce(b.n,0)-coalesce(a.n,0) as delta from (select o_orderpriority as k, count(*) as n from orders where o_orderstatus='F' group by 1) a full join (select o_orderpriority as k, count(*) as n from orders where o_orderstatus<>'F' group by 1) b on a.k=b.k")
def type_delta(spark, sf):
    o = table(spark, sf, "orders").withColumn("resource_type", C("o_orderpriority"))
    return P.type_delta(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"))


@query("u01_split_disjoint", "select o_custkey, count(distinct o_orderstatus) as splits from orders group by 1 having count(distinct o_orderstatus)>1")
def split_overlaps(spark, sf):
    return P.split_overlaps(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@query("u02_coverage_retained", "select distinct l_orderkey from lineitem where l_returnflag='R' and l_orderkey not in (select l_orderkey from lineitem where l_returnflag='A')")
def lost(spark, sf):
    li = table(spark, sf, "lineitem")
    return P.lost_coverage(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "l_orderkey")


@query(
    "u03_merge_additions",
    sql("""select ref, case when k%10=0 then 'original' else 'differs' end as clash from (select 'Task/n'||o_orderkey as ref, o_orderkey as k from task) z where k%10=0 or k%10=5""", "task"),
)
def merge(spark, sf):
    t = charts.task(spark, sf)
    k = F.substring("id", 2, 20)
    n = k.cast("bigint")
    ref = F.concat(F.lit("Task/n"), k)
    body = lambda s: F.concat(F.lit('{"resourceType":"Task","id":"n'), k, F.lit('","status":"'), F.lit(s), F.lit('"}'))
    originals = t.where(n % 10 == 0).select(ref.alias("ref"), body("draft").alias("doc"))
    twice = t.select(ref.alias("ref"), body("draft").alias("doc")).unionByName(t.select(ref.alias("ref"), F.when(n % 10 == 5, body("requested")).otherwise(body("draft")).alias("doc")))
    return P.merge_additions(originals, twice)[1]


@query(
    "u04_evidence_sets",
    """select o_orderkey, case when o_orderkey%2=0 then 1 else 2 end as hit, 2 as required from orders""",
)
def evidence_sets(spark, sf):
    k = C("o_orderkey")
    req = F.array(F.lit("a"), F.lit("b"))
    sub = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    return table(spark, sf, "orders").select("o_orderkey", F.size(F.array_intersect(sub, req)).alias("hit"), F.size(req).alias("required"))


@query(
    "e13_j15_source_preservation",
    sql("""select resource_ref as ref, case when doc_id%5=0 then 'missing' else 'changed' end as problem from docref where doc_id%5=0 or (doc_id%5=1 and tag='source-preserved')""", "docref"),
)
def preservation(spark, sf):
    old = charts.resources(spark, sf, "DocumentReference")
    n = F.substring("id", 2, 20).cast("bigint")
    changed = F.regexp_replace("doc", '"status":"current"', '"status":"superseded"')
    new = old.where(n % 5 != 0).withColumn("v", F.parse_json(F.when(n % 5 == 1, changed).otherwise(C("doc"))))
    return P.source_preservation(old, new)


@query(
    "j16_ledger_join",
    sql("select resource_ref as ref, 'no document' as problem from sr where status='draft' union all select resource_ref, 'no ledger row' from task", "sr", "task"),
)
def ledger_join(spark, sf):
    s, t = charts.servicerequest(spark, sf), charts.task(spark, sf)
    refs = s.where("status <> 'draft'").select(C("resource_ref").alias("ref")).unionByName(t.select(C("resource_ref").alias("ref")))
    return P.ledger_join(s.select("resource_ref", F.lit("x").alias("origin")), refs)


@query(
    "e14_corpus_comparison",
    sql("""select 'ServiceRequest' as resource_type, count(*) filter (status='draft') as old_resources, 1 as old_shapes, count(*) as new_resources, 2 as new_shapes from sr""", "sr"),
)
def comparison(spark, sf):
    r = charts.resources(spark, sf, "ServiceRequest")
    draft = C("doc").contains('"status":"draft"')
    richer = F.regexp_replace("doc", r"\}$", ',"priority":"routine"}')
    new = r.withColumn("v", F.parse_json(F.when(draft, C("doc")).otherwise(richer)))
    return P.corpus_comparison(r.where(draft), new)


# -- import and repair -------------------------------------------------------------------

@query(
    "s04_patient_source",
    """select o_custkey as patient_id, min(case when o_custkey%10=0 then 'heldout' else 'train' end) as split, strftime(min(o_orderdate),'%Y-%m-%d') as first_date, strftime(max(o_orderdate),'%Y-%m-%d') as last_date, count(*) as encounters from orders group by 1
       union all select c_custkey, case when c_custkey%10=0 then 'heldout' else 'train' end, null, null, 0 from customer where c_custkey not in (select o_custkey from orders)""",
)
def patient_source(spark, sf):
    p = table(spark, sf, "customer").select(C("c_custkey").alias("patient_id"))
    g = p.select("patient_id", F.when(C("patient_id") % 10 == 0, "heldout").otherwise("train").alias("split"))
    e = table(spark, sf, "orders").select(C("o_custkey").alias("patient_id"), charts.day("o_orderdate").alias("encounter_date"), C("o_orderkey").alias("encounter_id"))
    return relational.patient_source(g, p, e)[0]


@query(
    "e01_assign_dev_split",
    """with t as (select c_custkey, case when c_custkey%5=0 then 'public' else 'train' end as s from customer), h as (select c_custkey, row_number() over (order by substr(sha256('development|'||c_custkey),1,24)) as k, count(*) over () as n from t where s='train')
       select t.c_custkey, case when h.k<=greatest(1, n//10) then 'dev' else s end as split, s as upstream_split from t left join h on h.c_custkey=t.c_custkey""",
)
def dev_split(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", F.when(C("c_custkey") % 5 == 0, "public").otherwise("train").alias("split"))
    return etl.assign_dev_split(t, "c_custkey")


@query(
    "e02_import_patients",
    sql("""select c_custkey as source_id, 'SYN-'||substr(substr(sha256('mrn|'||c_custkey),1,24),1,10) as mrn, case when c_custkey%3=0 then 'female' when c_custkey%3=1 then 'male' else 'unknown' end as gender,
        strftime(date '1995-01-01' - cast((c_custkey%80)*365 + cast('0x'||substr(md5(cast(c_custkey as varchar)),1,15) as bigint)%300+1 as integer), '%Y-%m-%d') as birth from customer"""),
)
def import_patients(spark, sf):
    k = C("c_custkey")
    p = table(spark, sf, "customer").select(
        k.cast("string").alias("source_id"), C("c_name").alias("name"), F.when(k % 3 == 0, "F").when(k % 3 == 1, "M").alias("sex"), (k % 80).alias("age"), F.lit("1995-01-01").alias("first_date")
    )
    d = etl.import_patients(p).withColumn("v", F.parse_json("doc"))
    return d.select(C("source_id").cast("bigint").alias("source_id"), D.text(F.col("v"), "identifier[0].value").alias("mrn"), D.text(F.col("v"), "gender").alias("gender"), D.text(F.col("v"), "birthDate").alias("birth"))


@query(
    "e03_import_encounters",
    """select doc_id, 'Encounter' as kind, case when doc_id%4=0 then 'IMP' when doc_id%4=1 then 'EMER' else 'AMB' end as detail from documents union all select doc_id, 'DocumentReference', md5(text) from documents""",
)
def import_encounters(spark, sf):
    k = C("doc_id")
    e = table(spark, sf, "documents").select(
        k.cast("string").alias("source_id"), k.cast("string").alias("encounter_id"), F.lit("2001-02-03").alias("encounter_date"),
        F.when(k % 4 == 0, "icu").when(k % 4 == 1, "ed").otherwise("clinic").alias("encounter_type"), C("text").alias("note_text"),
    )
    d = etl.import_encounters(e).withColumn("v", F.parse_json("doc"))
    body = F.md5(F.encode(D.document_text(F.col("v")), "UTF-8"))
    return d.select(C("source_id").cast("bigint").alias("doc_id"), D.text(F.col("v"), "resourceType").alias("kind"), F.coalesce(D.text(F.col("v"), "class.code"), body).alias("detail"))


@query(
    "e04_import_profile",
    """select c_custkey, 'DocumentReference' as kind, cast(null as varchar) as text, 'longitudinal_patients.profile' as source_key from customer union all select c_custkey, 'Condition', c_mktsegment, 'profile/chronic_conditions/0' from customer
       union all select c_custkey, 'AllergyIntolerance', 'penicillin', 'profile/allergies/0' from customer where c_custkey%2=1
       union all select c_custkey, 'MedicationStatement', 'aspirin', 'profile/home_medications/0' from customer union all select c_custkey, 'MedicationStatement', 'ibuprofen', 'profile/home_medications/1' from customer""",
)
def import_profile(spark, sf):
    allergy = F.when(C("c_custkey") % 2 == 0, " NKDA ").otherwise("penicillin")
    profile = F.concat(F.lit('{"chronic_conditions":["'), "c_mktsegment", F.lit('"],"allergies":["'), allergy, F.lit('"],"home_medications":[{"name":"aspirin","dose":"1"},"ibuprofen"]}'))
    p = table(spark, sf, "customer").select(C("c_custkey").cast("string").alias("source_id"), profile.alias("profile"))
    d = etl.import_profile(p).withColumn("v", F.parse_json("doc"))
    said = F.coalesce(D.text(F.col("v"), "code.text"), D.text(F.col("v"), "medicationCodeableConcept.text"))
    return d.select(C("source_id").cast("bigint").alias("c_custkey"), D.text(F.col("v"), "resourceType").alias("kind"), said.alias("text"), "source_key")


@query(
    "k04_e05_ledger_and_provenance",
    sql("""select resource_ref as target_ref, case when status='draft' then 'generated-workflow' else 'source-profile' end as activity from sr where o_orderkey%7<>0 union all select resource_ref, 'source-preserved' from cov""", "sr", "cov"),
)
def provenance(spark, sf):
    deletable = charts.servicerequest(spark, sf).where(F.substring("id", 2, 20).cast("bigint") % 7 == 0).select(C("resource_ref").alias("ref"))
    p = etl.emit_provenance(_ledger(spark, sf), deletable, "2026-01-01", "Organization/n1").withColumn("v", F.parse_json("doc"))
    return p.select(D.text(F.col("v"), "target[0].reference").alias("target_ref"), D.text(F.col("v"), "activity.text").alias("activity"))


@query("e06_repair_allergy_status", "select 'AllergyIntolerance/'||o_orderkey as ref, 'active' as clinical, 'unconfirmed' as verification, case when o_orderkey%4=1 then 2 else 1 end as notes from orders where o_orderkey%2=1")
def repair_allergy(spark, sf):
    from chartloom.sources.ndjson import from_documents

    k = C("o_orderkey")
    status = F.when(k % 2 == 0, F.struct(F.lit("known").alias("text")))
    note = F.when(k % 4 == 1, F.array(F.struct(F.lit("old").alias("text"))))
    doc = F.to_json(F.struct(F.lit("AllergyIntolerance").alias("resourceType"), k.cast("string").alias("id"), status.alias("clinicalStatus"), note.alias("note")))
    fixed, _ = etl.repair_allergy_status(from_documents(table(spark, sf, "orders").select(doc.alias("doc"))))
    f = fixed.withColumn("v", F.parse_json("doc"))
    return f.select("ref", D.text(F.col("v"), "clinicalStatus.coding[0].code").alias("clinical"), D.text(F.col("v"), "verificationStatus.coding[0].code").alias("verification"), F.size(D.values_at(F.col("v"), "note")).alias("notes"))


@query(
    "e07_repair_device_link",
    """select 'DeviceUseStatement/'||o_orderkey as ref, case when o_orderkey%3=1 then 1 else 0 end as based_on, 0 as entities from orders where o_orderkey%3<2 and o_orderkey%5<>0 union all select 'Provenance/p'||o_orderkey, 0, 1 from orders where o_orderkey%3<2 and o_orderkey%5<>0""",
)
def repair_device(spark, sf):
    from chartloom.sources.ndjson import from_documents

    k = C("o_orderkey")
    r = lambda p: F.struct(F.concat(F.lit(p), k.cast("string")).alias("reference"))
    links = F.when(k % 3 == 0, F.array(r("DeviceRequest/"))).when(k % 3 == 1, F.array(r("DeviceRequest/"), r("ServiceRequest/"))).otherwise(F.array(r("ServiceRequest/")))
    o = table(spark, sf, "orders")
    use = o.select(F.to_json(F.struct(F.lit("DeviceUseStatement").alias("resourceType"), k.cast("string").alias("id"), links.alias("basedOn"))).alias("doc"))
    prov = o.where(k % 5 != 0).select(F.to_json(F.struct(F.lit("Provenance").alias("resourceType"), F.concat(F.lit("p"), k.cast("string")).alias("id"), F.array(r("DeviceUseStatement/")).alias("target"))).alias("doc"))
    docs, _ = etl.repair_device_links(from_documents(use.unionByName(prov)))
    d = docs.withColumn("v", F.parse_json("doc"))
    return d.select("ref", F.size(D.values_at(F.col("v"), "basedOn")).alias("based_on"), F.size(D.values_at(F.col("v"), "entity")).alias("entities"))


@query(
    "e08_refresh_gold",
    sql("""select t.patient_ref as task_id, n, t.date, t.value, t.resource_ref from (select patient_ref, row_number() over (partition by patient_ref order by date, resource_ref) as n, date, value, resource_ref from obs where status='final' and date between '1996-01-01' and '1999-12-31') t
        where date>='1997-01-01' and date<=case when substr(patient_ref,10)::bigint%2=0 then '1997-12-31' else '1998-12-31' end""", "obs"),
)
def refresh_gold(spark, sf):
    from chartloom.plans import library

    trend = library.lab_trend(charts.observation(spark, sf), "1996-01-01", "1999-12-31")
    last = F.when(F.substring("id", 2, 20).cast("bigint") % 2 == 0, "1997-12-31").otherwise("1998-12-31")
    tasks = charts.patient(spark, sf).select(C("resource_ref").alias("task_id"), C("resource_ref").alias("patient_ref"), F.lit("1997-01-01").alias("start"), last.alias("end"))
    return etl.refresh_trend_gold(tasks, trend).drop("unit")


@query(
    "e08_refresh_steps",
    "select o_orderkey, case when o_orderkey%2=0 then 'Communication?patient=1&_count=50&sent=eq2024-01-01' else 'Condition?patient=1&_count=50&_tag=https://fhir-workflows.example/origin|source-profile' end as path from orders",
)
def refresh_steps(spark, sf):
    k = C("o_orderkey")
    step = F.array(F.struct(F.lit("GET").alias("method"), F.when(k % 2 == 0, "Communication?patient=1").otherwise("Condition?patient=1").alias("path")))
    family = F.when(k % 2 == 0, "message_followup").otherwise("documented_conditions")
    return table(spark, sf, "orders").select("o_orderkey", etl.refresh_steps(step, family, F.lit("2024-01-01T10:00:00Z"))[0]["path"].alias("path"))


@query(
    "e09_merge_corpus",
    sql("""select 'Task' as kind, count(*) as n, count(*) as with_text from task union all select 'Provenance', count(*), 0 from task where status<>'draft' union all select 'ServiceRequest', count(*), 0 from sr where status='active'""", "task", "sr"),
)
def merge_corpus(spark, sf):
    originals = charts.resources(spark, sf, "ServiceRequest").where(C("doc").contains('"status":"active"')).select("ref", "doc")
    additions = charts.resources(spark, sf, "Task").select("ref", "doc")
    ledger = additions.select(C("ref").alias("resource_ref"), F.lit("generated-workflow").alias("origin"), F.lit("p").alias("source_patient_id"))
    deletable = charts.task(spark, sf).where("status = 'draft'").select(C("resource_ref").alias("ref"))
    fixed = originals.limit(0)
    corpus, _ = etl.merge_corpus(originals, fixed, additions, ledger, deletable, "2026-01-01", "Organization/n1")
    c = corpus.select(F.substring_index("ref", "/", 1).alias("kind"), D.node(F.parse_json("doc"), "text").isNotNull().alias("t"))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("with_text"))


@query(
    "e10_pair_names",
    "select c_custkey, 'Jordan Synthetic'||c_nationkey||'Pair'||((row_number() over (partition by c_nationkey order by c_name)-1)//2) as name from customer",
)
def pair_names(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", C("c_nationkey").alias("shard"), "c_name")
    return etl.pair_names(c, "shard", "c_name").select("c_custkey", "name")


@query("e11_rescale_timeline", "select o_orderkey, datediff('day', date '1995-01-01', cast(o_orderdate as date))*(o_custkey%3+1)-(o_custkey%7+2) as day from orders")
def rescale(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", C("o_custkey").alias("patient_ref"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("day"))
    k = C("c_custkey")
    plans = table(spark, sf, "customer").select(k.alias("patient_ref"), (k % 3 + 1).alias("stretch"), (k % 7 + 2).alias("offset"))
    return etl.rescale_timeline(o, plans).select("o_orderkey", "day")


@query(
    "e12_shared_entities",
    """select c_custkey, label, substr(sha256('v1|17|'||case when label='clinic' then 'scope/'||(c_custkey%2) else 'c'||c_custkey end||'|'||label),1,24) as id from customer, (values ('clinic'),('order')) l(label)""",
)
def shared(spark, sf):
    c = table(spark, sf, "customer").withColumn("label", F.explode(F.array(F.lit("clinic"), F.lit("order"))))
    i = etl.entity_id("v1", 17, F.lit("scope"), C("c_custkey") % 2, F.concat(F.lit("c"), C("c_custkey").cast("string")), C("label"))
    return c.select("c_custkey", "label", i.alias("id"))


# -- tasks -------------------------------------------------------------------------------

_GOLD = "struct<answer:string,evidence:array<string>,target_evidence:array<string>,evidence_fields:map<string,array<string>>,updates:array<struct<ref:string,field:string,value:string>>,creates:array<string>,deletes:array<string>>"


def _tasks(spark, sf):
    """One task per order."""
    k, m = C("o_orderkey"), C("o_orderkey") % 4
    s = k.cast("string")
    none = F.array().cast("array<string>")
    gold = F.struct(
        F.lit("{}").alias("answer"), F.array(F.concat(F.lit("ServiceRequest/o"), s)).alias("evidence"), F.lit(None).cast("array<string>").alias("target_evidence"),
        F.lit(None).cast("map<string,array<string>>").alias("evidence_fields"),
        F.when(m == 1, F.array(F.struct(F.lit("a").alias("ref"), F.lit("b").alias("field"), F.lit("c").alias("value")))).alias("updates"),
        F.when(m == 2, F.array(F.lit("{}"))).otherwise(none).alias("creates"), F.when(m == 3, F.array(F.lit("x"))).otherwise(none).alias("deletes"),
    )
    e = lambda *pairs: F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs])
    edges = (
        F.when(m == 0, e(("supplied_mrn", "patient"))).when(m == 1, e(("supplied_mrn", "patient"), ("patient", "order"), ("order", "report"), ("supplied_mrn", "report")))
        .when(m == 2, e(("b", "c"), ("supplied_x", "a"), ("supplied_x", "b"), ("a", "b"), ("c", "d"))).otherwise(e(("supplied_x", "a"), ("a", "b"), ("b", "a")))
    )
    patient = F.concat(F.lit("c"), C("o_custkey").cast("string"))
    order = F.concat(F.lit("o"), s)
    step = lambda method, path, body=None: F.struct(
        F.lit(method).alias("method"), path.alias("path"), (F.lit(None).cast("string") if body is None else body).alias("body"), F.lit(None).cast("map<string,string>").alias("headers"))
    steps = F.array(step("GET", F.concat(F.lit("Patient?identifier=MRN-"), C("o_custkey").cast("string"))), step("GET", F.concat(F.lit("ServiceRequest/"), F.when(m == 3, "none").otherwise(order))))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("t"), s).alias("id"), patient.alias("patient_id"), C("o_orderpriority").alias("family"), F.lit("dev").alias("split"), F.when(k % 3 > 0, F.lit("billing")).alias("domain"),
        F.lit(None).cast("string").alias("role"), F.lit("do").alias("prompt"), gold.alias("gold"), edges.alias("dependency_edges"), steps.alias("reference_steps"),
        (m + 1).cast("int").alias("dependency_depth"), F.lit(None).cast("int").alias("workflow_depth"), F.lit(2).alias("reference_calls"), F.lit(None).cast("boolean").alias("requires_transaction"), "o_orderkey",
    )


@query("t01_dependency_depth", "select 't'||o_orderkey as id, case o_orderkey%4 when 0 then 1 when 1 then 3 when 2 then 4 end as depth from orders")
def depth(spark, sf):
    return _tasks(spark, sf).select("id", T.dependency_depth(C("dependency_edges")).alias("depth"))


@query(
    "t02_task_dimensions",
    """select 't'||o_orderkey as id, m+1 as retrieval_hops, case m when 0 then 'easy' when 1 then 'medium' when 2 then 'hard' else 'very_hard' end as difficulty_bin, m+1+case when m>0 then 1 else 0 end as workflow_depth,
       1 as required_evidence_resources, case when m>0 then 1 else 0 end as required_mutation_entries, case m when 0 then 'R' when 1 then 'RU' when 2 then 'CR' else 'RD' end as crud, 2 as reference_calls, false as requires_transaction from (select o_orderkey, o_orderkey%4 as m from orders) z""",
)
def dimensions(spark, sf):
    return T.task_dimensions(_tasks(spark, sf))


@query(
    "f12_l4_t03_task_info",
    """select 't'||o_orderkey as id, 'legacy' as domain, 'CR' as crud from orders where o_orderkey%3=0 and o_orderkey%4=2 order by 't'||o_orderkey limit 500""",
)
def task_info(spark, sf):
    return T.task_info(_tasks(spark, sf), max_depth=3, domains=["legacy"], crud="CR", max_examples=500).select("id", "domain", "crud")


@query("t04_explode_steps", "select 't'||o_orderkey as task_id, 1 as step, 'GET' as method, 'Patient?identifier=MRN-'||o_custkey as path from orders union all select 't'||o_orderkey, 2, 'GET', 'ServiceRequest/'||case when o_orderkey%4=3 then 'none' else 'o'||o_orderkey end from orders")
def steps(spark, sf):
    return T.explode_steps(_tasks(spark, sf)).select("task_id", "step", "method", "path")


@query("t05_replay_reads", "select 't'||o_orderkey as task_id, 1 as step, 200 as status, 1 as found from orders union all select 't'||o_orderkey, 2, case when o_orderkey%4=3 then 404 else 200 end, case when o_orderkey%4=3 then 0 else 1 end from orders")
def replay(spark, sf):
    t = _tasks(spark, sf)
    empty = spark.createDataFrame([], "episode_id string, ref string, doc string")
    policy = spark.createDataFrame([], "episode_id string, policy_patient string, writable_types array<string>, writable_refs array<string>, delete_refs array<string>")
    reads, _, _, _ = T.replay(t, charts.resources(spark, sf, "Patient", "ServiceRequest"), policy, empty)
    return reads.select("task_id", "step", "status", "found")


def _replayed(spark, sf):
    """A task for each order that reads, writes and reads again on the order's own chart; every fifth lacks its order."""
    from chartloom.plans.registered.writes import _world
    from chartloom.sources.ndjson import from_documents

    o, k, ep, subject, current, policy = _world(spark, sf)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    null = F.lit(None).cast("string")
    tag = lambda n: F.create_map(F.lit("If-Match"), F.lit(f'W/"{n}"'))
    none = F.lit(None).cast("map<string,string>")
    step = lambda method, path, body=null, headers=none: F.struct(F.lit(method).alias("method"), path.alias("path"), body.alias("body"), headers.alias("headers"))
    done = text('{"resourceType":"Task","id":"t', k, '","meta":{"versionId":"1"},"status":"completed","identifier":[{"value":"T-', k, '"}],"focus":{"reference":"ServiceRequest/o', k, '"},"for":', subject, "}")
    new = text('{"resourceType":"Task","status":"requested","for":', subject, "}")
    steps = F.array(
        step("GET", text("ServiceRequest?identifier=ORD-", k)), step("PUT", text("Task/t", k), done, tag(1)), step("GET", text("Task/t", k)),
        step("GET", text("Task?identifier=T-", k, "&status=completed")), step("GET", text("Task?identifier=T-", k, "&status=requested")),
        step("DELETE", text("Task/d", k), null, tag(3)), step("POST", F.lit("Task"), new), step("GET", F.lit("Task/created-00001")),
    )
    # Every seventh reads what it has deleted.
    steps = F.when(C("o_orderkey") % 7 == 0, F.array_append(steps, step("GET", text("Task/d", k)))).otherwise(steps)
    lacks = F.when(C("o_orderkey") % 5 == 0, F.array(text("ServiceRequest/o", k))).otherwise(F.array().cast("array<string>"))
    tasks = o.select(ep.alias("id"), steps.alias("reference_steps"), lacks.alias("omit"), F.array(text("ServiceRequest/o", k), text("Task/t", k)).alias("evidence"), F.lit(3).alias("writes"))
    # The charts of the orders share their patients.
    snapshot = from_documents(current.groupBy("ref").agg(F.first("doc").alias("doc")).select("doc"))
    return tasks, *T.replay(tasks, snapshot, policy, current)


@query(
    "t05_replay_own_writes",
    """with s as (select o_orderkey as k, o_orderkey%5=0 as lacks from orders)
        select 'e'||k as task_id, step, status, found from (
          select k, 1 as step, 200 as status, case when lacks then 0 else 1 end as found from s union all select k, 3, 200, 1 from s
          union all select k, 4, 200, case when lacks then 0 else 1 end from s union all select k, 5, 200, case when lacks then 1 else 0 end from s
          union all select k, 8, 200, 1 from s union all select k, 9, 410, 0 from s where k%7=0) z""",
)
def replay_own_writes(spark, sf):
    _, reads, _, _, _ = _replayed(spark, sf)
    return reads.select("task_id", F.col("step").cast("int").alias("step"), "status", "found")


@query(
    "t05_replay_score",
    """select 'e'||k as task_id, case when lacks then 2 when k%7=0 then 9 end as failed_step, 2 as evidence, case when lacks then 1 else 2 end as evidence_seen, case when lacks then 2 else 3 end as committed, not lacks and k%7<>0 as strict_success
       from (select o_orderkey as k, o_orderkey%5=0 as lacks from orders) s""",
)
def replay_score(spark, sf):
    tasks, reads, hits, outcomes, _ = _replayed(spark, sf)
    return T.replay_score(tasks, reads, hits, outcomes)


@query("t06_absence_scope", sql("select p.resource_ref as patient_ref, 'DocumentReference' as kind, 'src3' as code from patient p where not exists (select 1 from docref d where d.patient_ref=p.resource_ref and code='src3')", "patient", "docref"))
def absence_scope(spark, sf):
    from chartloom.plans import library

    gone = library.document_availability(charts.patient(spark, sf), charts.documentreference(spark, sf), "src3").where("not documented")
    scope = F.struct(F.lit("DocumentReference").alias("resourceType"), C("patient_ref").alias("patient"), F.lit("src3").alias("code"))
    return gone.select(scope.alias("s")).select(C("s.patient").alias("patient_ref"), C("s.resourceType").alias("kind"), "s.code")


@query(
    "t07_q29_discovery",
    """select substr(sha256('t'||o_orderkey||':discovery-v1'),1,24) as id, 't'||o_orderkey as base_task_id, case when o_orderkey%3=0 then 'referral_closure_discovery' else 'referral_acknowledgement_discovery' end as family,
       'DiagnosticReport/g'||o_orderkey||',ImagingStudy/i'||o_orderkey||',ServiceRequest/o'||o_orderkey||',Task/t'||o_orderkey as evidence, 'DX' as modality from orders where o_orderkey%3<2 and o_orderkey%5<>0""",
)
def discovery(spark, sf):
    from chartloom.sources.ndjson import from_documents

    k = C("o_orderkey")
    s = k.cast("string")
    o = table(spark, sf, "orders")
    family = F.when(k % 3 == 0, "referral_loop_closure").when(k % 3 == 1, "acknowledgement_and_task_completion").otherwise("latest_result")
    t = o.select(F.concat(F.lit("t"), s).alias("id"), family.alias("family"), F.concat(F.lit("c"), C("o_custkey").cast("string")).alias("patient_id"), F.lit(None).cast("string").alias("scenario_variant"))
    r = lambda p: F.struct(F.concat(F.lit(p), s).alias("reference"))
    doc = lambda kind, prefix, **parts: F.to_json(F.struct(F.lit(kind).alias("resourceType"), F.concat(F.lit(prefix), s).alias("id"), *[c.alias(n) for n, c in parts.items()]))
    docs = o.select(F.explode(F.array(
        doc("Task", "t", focus=r("ServiceRequest/o")), doc("DiagnosticReport", "g", imagingStudy=F.array(r("ImagingStudy/i")), conclusion=F.lit("ok")),
        F.when(k % 5 != 0, doc("ImagingStudy", "i", status=F.lit("available"), modality=F.array(F.struct(F.lit("DX").alias("code"))))),
    )).alias("doc")).where("doc is not null")
    ev = o.select(F.concat(F.lit("t"), s).alias("task_id"), F.explode(F.array(F.concat(F.lit("Task/t"), s), F.concat(F.lit("DiagnosticReport/g"), s))).alias("ref"))
    d = T.discovery_variants(t, ev, from_documents(docs))
    return d.select("id", "base_task_id", "family", F.array_join("evidence", ",").alias("evidence"), C("answer")["modality"].alias("modality"))


@query("t08_evidence_fields", sql("select 'x'||id as task_id, resource_ref as ref, 'description,focus,for,status' as fields from task", "task"))
def evidence_fields(spark, sf):
    t = charts.task(spark, sf).select(F.concat(F.lit("x"), "id").alias("task_id"), C("resource_ref").alias("ref"))
    return T.evidence_fields_default(t, charts.resources(spark, sf, "Task")).withColumn("fields", F.array_join("fields", ","))


@query("u06_append_variants", "select 't'||o_orderkey as id, cast(null as varchar) as base_task_id from orders union all select 'v'||o_orderkey, 't'||o_orderkey from orders where o_orderkey%9=0")
def append(spark, sf):
    o = table(spark, sf, "orders")
    s = C("o_orderkey").cast("string")
    return T.append_variants(o.select(F.concat(F.lit("t"), s).alias("id")), o.where("o_orderkey % 9 = 0").select(F.concat(F.lit("v"), s).alias("id"), F.concat(F.lit("t"), s).alias("base_task_id")))


# -- sources and sinks -------------------------------------------------------------------

@query("k01_ndjson_lines", sql("""select '{"description":"'||description||'","focus":{"reference":"'||focus_ref||'"},"for":{"reference":"'||patient_ref||'"},"id":"'||id||'","meta":{"versionId":"1"},"resourceType":"Task","status":"'||status||'"}' as value from task""", "task"))
def ndjson(spark, sf):
    return sinks.ndjson_lines(charts.documents_of(spark, sf, "Task"))


@query("k02_shards", "select c_custkey, lpad(cast((row_number() over (partition by c_mktsegment order by c_name)-1)//8 as varchar),4,'0') as shard from customer")
def shards(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", C("c_mktsegment").alias("split"), "c_name")
    return sinks.assign_shards(c, "split", "c_name").select("c_custkey", "shard")


@query("k03_manifest_rows", "select 'status' as section, o_orderstatus as key, cast(count(*) as varchar) as value from orders group by 2")
def manifest(spark, sf):
    return sinks.manifest_rows(P.corpus_counts(table(spark, sf, "orders"), {"status": C("o_orderstatus")}))


@query("k07_k08_package_and_release", "select 't'||o_orderkey as id, case when o_orderkey%3=0 then 'train' else 'dev' end as split from orders where o_orderkey%3<2")
def package(spark, sf):
    k = C("o_orderkey")
    t = _tasks(spark, sf).withColumn("split", F.when(k % 3 == 0, "train").when(k % 3 == 1, "dev").otherwise("heldout"))
    return sinks.release_split(sinks.package_splits(t, {"digests": True}))[0].select("id", "split")


@query("k09_export_bundles", sql("select patient_ref, 0 as part, count(*) as entries from task group by 1", "task"))
def bundles(spark, sf):
    r = charts.resources(spark, sf, "Task").select("ref", "doc", "patient_ref")
    b = sinks.export_bundles(r, "patient_ref")
    return b.where(D.text(F.parse_json("bundle"), "type") == "collection").select("patient_ref", "part", "entries")


@query("k11_export_variants", "select split, 'f' as family, count(*) as n, min('v'||o_orderkey) as example from (select *, case when o_orderkey%2=0 then 'train' else 'dev' end as split from orders) z where o_orderkey%9=0 group by 1")
def export_variants(spark, sf):
    o = table(spark, sf, "orders")
    s = C("o_orderkey").cast("string")
    tasks = o.select(F.concat(F.lit("t"), s).alias("id"), F.when(C("o_orderkey") % 2 == 0, "train").otherwise("dev").alias("split"))
    variants = o.where("o_orderkey % 9 = 0").select(F.concat(F.lit("v"), s).alias("id"), F.concat(F.lit("t"), s).alias("base_task_id"), F.lit("f").alias("family"))
    return sinks.export_variants(variants, tasks)


@query("k10_csv_rows", sql("select 'm1' as model, tool_profile, training_step, bin as category, count(*) as observed, avg(strict_success) as mean from rollout group by 2,3,4", "rollout"))
def csv_rows(spark, sf):
    from chartloom.operators import experiments as E

    s = E.stratified_summary(charts.rollouts(spark, sf), ["strict_success"], 0).withColumn("ci_low", F.lit(None).cast("double")).withColumn("ci_high", F.lit(None).cast("double"))
    c = E.csv_rows(s).where("stratum = 'difficulty' and scope = 'all_rollouts'")
    return c.select("model", "tool_profile", "training_step", "category", "observed", "mean")


@query("s08_validation_issues", "select case when o_orderkey%2=0 then 'old' else 'new' end as side, 'f'||o_orderkey as file, case when o_orderkey%3=0 then 'error' else 'warning' end as severity, 'Task/t'||o_orderkey as resource from orders")
def issues(spark, sf):
    k = C("o_orderkey")
    s = k.cast("string")
    sev = F.when(k % 3 == 0, "error").otherwise("warning")
    doc = F.concat(F.lit('{"entry":[{"resource":{"extension":[{"valueString":"f'), s, F.lit('"}],"issue":[{"severity":"'), sev, F.lit('","details":{"text":"m"},"expression":["Bundle.entry[0].resource/*Task/t'), s, F.lit('*/.status"]}]}}]}'))
    r = table(spark, sf, "orders").select(F.when(k % 2 == 0, "old").otherwise("new").alias("side"), doc.alias("doc"))
    return files.validation_issues(r).select("side", "file", "severity", "resource")


@query("s09_verify_manifest", "select 'f'||o_orderkey as path, case when o_orderkey%4=0 then 'missing' when o_orderkey%4=1 then 'not listed' else 'changed' end as problem from orders where o_orderkey%4<3")
def verify_manifest(spark, sf):
    k = C("o_orderkey")
    o = table(spark, sf, "orders").select(k, F.concat(F.lit("f"), k.cast("string")).alias("path"), F.sha2(k.cast("string"), 256).alias("sha256"))
    listed = o.where(k % 4 != 1).withColumn("sha256", F.when(k % 4 == 2, "other").otherwise(C("sha256")))
    return files.verify_manifest(o.where(k % 4 != 0).select("path", "sha256"), listed.select("path", "sha256"))
