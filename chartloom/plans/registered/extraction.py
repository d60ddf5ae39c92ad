"""Projections and extraction from documents, and the scalar functions."""

from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions import text as X
from chartloom.operators import edges as G
from chartloom.plans import charts
from chartloom.plans.charts import table
from chartloom.plans.registry import query
from chartloom.plans.reports import PART_BYTES
from chartloom.plans.sqltext import sql



@query("p01_ref", sql("select resource_ref as ref, id from sr union all select resource_ref, id from cov", "sr", "cov"))
def ref(spark, sf):
    r = charts.resources(spark, sf, "ServiceRequest", "Coverage")
    return r.select(D.ref(D.text(F.col("v"), "resourceType"), D.text(F.col("v"), "id")).alias("ref"), D.text(F.col("v"), "id").alias("id"))


@query(
    "p02_references",
    sql("""select resource_ref as src_ref, 'basedOn' as field, 0 as n, based_on_ref as dst_ref from obs union all
        select resource_ref, 'focus', 0, focus_ref from obs union all select resource_ref, 'subject', 0, patient_ref from obs""", "obs"),
)
def references(spark, sf):
    return G.edges(charts.resources(spark, sf, "Observation")).drop("src_owner")


@query(
    "p03_p04_owner_and_date",
    sql("""select resource_ref as ref, patient_ref, date as resource_date from obs union all select resource_ref, patient_ref, "start" from appt
        union all select resource_ref, patient_ref, start_date from cov union all select resource_ref, resource_ref, '' from patient
        union all select resource_ref, null, '' from medication""", "obs", "appt", "cov", "patient", "medication"),
)
def owner_and_date(spark, sf):
    return charts.resources(spark, sf, "Observation", "Appointment", "Coverage", "Patient", "Medication").select("ref", "patient_ref", "resource_date")


@query(
    "p05_values_at",
    sql("""select resource_ref as ref, 1 as focus, 1 as subject, 0 as issued from obs union all select resource_ref, 0, 1, 0 from medreq""", "obs", "medreq"),
)
def values_at(spark, sf):
    r = charts.resources(spark, sf, "Observation", "MedicationRequest")
    return r.select("ref", *[F.size(D.values_at(F.col("v"), f)).alias(f) for f in ("focus", "subject", "issued")])


@query("p06_first_code", sql("select resource_ref as ref, code from docref union all select resource_ref, code from proc union all select resource_ref, null from task", "docref", "proc", "task"))
def first_code(spark, sf):
    return charts.resources(spark, sf, "DocumentReference", "Procedure", "Task").select("ref", D.first_code(F.col("v")).alias("code"))


@query("p07_first_ref", sql("select resource_ref as ref, slot_ref as slot, null as subject from appt union all select resource_ref, null, patient_ref from sr", "appt", "sr"))
def first_ref(spark, sf):
    r = charts.resources(spark, sf, "Appointment", "ServiceRequest")
    return r.select("ref", D.first_ref(F.col("v"), "slot").alias("slot"), D.first_ref(F.col("v"), "subject").alias("subject"))


@query(
    "p18_origin",
    sql("select resource_ref as ref, coalesce(tag,'') as origin, coalesce(tag like 'generated-%', false) as generated, coalesce(tag='source-preserved', false) as preserved from docref", "docref"),
)
def origin(spark, sf):
    r = charts.resources(spark, sf, "DocumentReference")
    return r.select("ref", F.array_join(D.tag_codes(F.col("v")), ",").alias("origin"), D.is_generated(F.col("v")).alias("generated"), D.is_source_preserved(F.col("v")).alias("preserved"))


@query(
    "p19_strip_version",
    sql("""select s.resource_ref as ref, s.o_orderkey % 2 = 0 as same from sr s""", "sr"),
)
def strip_version(spark, sf):
    r = charts.resources(spark, sf, "ServiceRequest")
    odd = F.substring("id", 2, 20).cast("bigint") % 2 == 1
    newer = F.replace("doc", F.lit('"versionId":"1"'), F.lit('"versionId":"2"'))
    changed = F.when(odd, F.regexp_replace(newer, '"status":"[a-z]+"', '"status":"revoked"')).otherwise(newer)
    after = r.withColumn("v2", F.parse_json(changed))
    return after.select("ref", (D.fingerprint(D.strip_version(F.col("v"))) == D.fingerprint(D.strip_version(F.col("v2")))).alias("same"))


@query(
    "p20_drop_fields",
    sql("""select resource_ref as ref, 'resourceType,sent,status,subject' as kept, '"'||date||'"' as sent from comm""", "comm"),
)
def drop_fields(spark, sf):
    kept = charts.resources(spark, sf, "Communication").select("ref", D.drop_fields(F.col("v")).alias("m"))
    return kept.select("ref", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kept"), F.col("m")["sent"].alias("sent"))


@query(
    "p21_document_text",
    sql("""select resource_ref as ref, md5(substr(text, 101, 400)) as page_md5, length(text) as total_characters,
        case when length(text) > 500 then 500 end as next_start from docref""", "docref"),
)
def document_text(spark, sf):
    page = D.document_page(F.col("body"), 100, 400)
    r = charts.resources(spark, sf, "DocumentReference").select("ref", D.document_text(F.col("v")).alias("body")).withColumn("p", page)
    return r.select("ref", F.md5(F.encode("p.text", "UTF-8")).alias("page_md5"), F.col("p.total_characters").alias("total_characters"), F.col("p.next_start").alias("next_start"))


@query(
    "p22_generated_text",
    sql("""select resource_ref as ref, 'attachment' as kind, md5(text) as text_md5 from docref union all
        select resource_ref, 'payload', md5(payload) from comm union all select resource_ref, 'note', md5(sender) from comm""", "docref", "comm"),
)
def generated_text(spark, sf):
    from chartloom.plans.reports import generated_text as rows

    r = rows(charts.resources(spark, sf, "DocumentReference", "Communication"))
    return r.select("ref", "kind", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(
    "p23_p24_age",
    sql("""select id, age, case when age<18 then 'child' when age<40 then 'adult18_39' when age<65 then 'adult40_64' else 'older65plus' end as band
        from (select id, 2000 - cast(substr(birth_date,1,4) as integer) - (case when '06-30' < substr(birth_date,6) then 1 else 0 end) as age from patient) z""", "patient"),
)
def age(spark, sf):
    a = charts.patient(spark, sf).select("id", X.age_at(F.col("birth_date"), F.lit("2000-06-30")).alias("age"))
    return a.withColumn("band", X.age_band(F.col("age")))


@query(
    "p25_p26_crud_and_bin",
    sql("""select o_orderkey, case when o_orderstatus='O' then 'C' else '' end||'R'||case when o_orderstatus='F' then 'U' else '' end||case when o_orderkey%5=0 then 'D' else '' end as crud,
        case when o_orderkey%5<=1 then 'easy' when o_orderkey%5=2 then 'medium' when o_orderkey%5=3 then 'hard' else 'very_hard' end as bin from orders"""),
)
def crud_and_bin(spark, sf):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    crud = X.crud_code((s == "O").cast("int"), (s == "F").cast("int"), (k % 5 == 0).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", crud.alias("crud"), X.difficulty_bin(k % 5).alias("bin"))


@query(
    "p27_narrative",
    sql("""select resource_ref as ref, '<div xmlns="http://www.w3.org/1999/xhtml"><p>Task. Synthetic record. '||status||'. '||description||'</p></div>' as div from task union all
        select resource_ref, '<div xmlns="http://www.w3.org/1999/xhtml"><p>Medication. Synthetic record. '||text||'</p></div>' from medication""", "task", "medication"),
)
def narrative(spark, sf):
    return charts.resources(spark, sf, "Task", "Medication").select("ref", D.narrative(F.col("v")).alias("div"))


@query("p28_stable_id", sql("select resource_ref as ref, substr(sha256('Patient|'||identifier||'|17'),1,24) as stable_id from patient", "patient"))
def stable_id(spark, sf):
    p = charts.patient(spark, sf)
    return p.select(F.col("resource_ref").alias("ref"), X.stable_id(F.lit("Patient"), F.col("identifier"), F.lit(17)).alias("stable_id"))


@query(
    "p29_shape_paths",
    sql("""select resource_ref as ref, 'basedOn,basedOn[].reference,code,code.coding,code.coding[].code,code.coding[].system,effectiveDateTime,focus,focus[].reference,resourceType,status,subject,subject.reference,valueQuantity,valueQuantity.unit,valueQuantity.value' as paths from obs
        union all select resource_ref, 'beneficiary,beneficiary.reference,class,class[].value,payor,payor[].reference,period,period.end,period.start,resourceType,status,subscriberId' from cov""", "obs", "cov"),
)
def shape_paths(spark, sf):
    r = D.shape_paths(charts.resources(spark, sf, "Observation", "Coverage"))
    return r.select("ref", F.array_join("paths", ",").alias("paths"))


@query(
    "p30_feature_flags",
    sql("""select resource_ref as ref, 'Observation.basedOn,Observation.valueQuantity' as flags from obs union all
        select resource_ref, 'MedicationRequest.medicationReference' from medreq union all
        select resource_ref, case when count(result_ref)>0 then 'DiagnosticReport.basedOn,DiagnosticReport.result' else 'DiagnosticReport.basedOn' end from report group by 1""", "obs", "medreq", "report"),
)
def feature_flags(spark, sf):
    r = charts.resources(spark, sf, "Observation", "MedicationRequest", "DiagnosticReport")
    return r.select("ref", F.array_join(D.feature_flags(F.col("v")), ",").alias("flags"))


@query(
    "p31_remap_refs",
    sql("select resource_ref as ref, 'Patient/new-'||substr(patient_ref,10) as subject, code from sr", "sr"),
)
def remap_refs(spark, sf):
    r = charts.resources(spark, sf, "ServiceRequest")
    mapping = F.create_map(F.col("patient_ref"), F.concat(F.lit("Patient/new-"), F.substring("patient_ref", 10, 30)))
    out = r.select("ref", F.parse_json(D.remap(F.col("doc"), mapping)).alias("v"))
    return out.select("ref", D.first_ref(F.col("v"), "subject").alias("subject"), D.first_code(F.col("v")).alias("code"))


@query(
    "p33_patient_context",
    sql("""select patient_ref, count(*) as documents, cast(sum(length(r)) as bigint) as characters from (select patient_ref, resource_ref as r from sr union all select patient_ref, resource_ref from cov) z group by 1""", "sr", "cov"),
)
def patient_context(spark, sf):
    from chartloom.plans.reports import patient_context as context

    r = charts.resources(spark, sf, "ServiceRequest", "Coverage").withColumn("doc", F.col("ref"))
    c = context(r)
    return c.select("patient_ref", "documents", (F.char_length("context") - F.col("documents") + 1).alias("characters"))


@query(
    "p33_context_texts",
    sql(f"""with d as (select 'Group/'||code as patient_ref, resource_ref as ref, text, strlen(text)+1 as size from docref where text is not null and code is not null),
        s as (select *, sum(size) over (partition by patient_ref order by text, ref) as upto, sum(size) over (partition by patient_ref) as whole from d)
        select patient_ref, cast(case when whole<={PART_BYTES} then 0 else floor((upto-1)/{PART_BYTES}) end as integer) as part, count(*) as documents,
        cast(sum(size)-1 as bigint) as bytes, md5(string_agg(text, chr(10) order by text)) as context_md5 from s group by 1, 2""", "docref"),
)
def context_texts(spark, sf):
    """All texts of every source as one context, hot sources in several parts."""
    from chartloom.plans.reports import patient_context as context

    d = table(spark, sf, "documents").where("text is not null and source is not null")
    rows = d.select(F.concat(F.lit("Group/"), "source").alias("patient_ref"), charts.key("DocumentReference/d", "doc_id").alias("ref"), F.col("text").alias("doc"))
    return context(rows).select("patient_ref", "part", "documents", "bytes", F.md5("context").alias("context_md5"))


# -- scalar functions --------------------------------------------------------------------

@query(
    "v01_sql_functions",
    sql("""select o_orderkey, coalesce(nullif(o_orderpriority,'5-LOW'),'low') as p, lower(o_orderstatus)||upper('x') as s, length(o_orderpriority) as n,
        abs(o_orderkey-100) as a, strftime(o_orderdate,'%Y-%m') as ym, o_orderpriority like '1-%' as urgent,
        json_extract_string('{"k":'||o_orderkey||'}','$.k') as j from orders"""),
)
def sql_functions(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(
        """SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'low') AS p, concat(lower(o_orderstatus), upper('x')) AS s,
        length(o_orderpriority) AS n, abs(o_orderkey - 100) AS a, date_format(o_orderdate, 'yyyy-MM') AS ym, o_orderpriority LIKE '1-%' AS urgent,
        variant_get(parse_json(concat('{"k":', o_orderkey, '}')), '$.k', 'string') AS j FROM orders"""
    )


@query(
    "v02_lexical_terms",
    r"""select doc_id, count(distinct t) as terms, min(t) as first_term, max(t) as last_term from
        (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[-./][\p{L}\p{N}_]+)*')) as t from documents) z group by doc_id""",
)
def lexical_terms(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(X.lexical_terms(F.col("text"))).alias("t"))
    return d.groupBy("doc_id").agg(F.count("t").alias("terms"), F.min("t").alias("first_term"), F.max("t").alias("last_term"))


@query(
    "v03_string_rules",
    sql("""select resource_ref as ref, regexp_replace('ge'||date, '^(eq|ne|gt|lt|ge|le|sa|eb|ap)([0-9]{4}-)', '\\2') as plain_date, 'o'||o_orderkey as tail,
        '&lt;'||code||'&gt;' as escaped, sha256(code) as digest, 1 as hex_ids from sr""", "sr"),
)
def string_rules(spark, sf):
    s = charts.servicerequest(spark, sf)
    return s.select(
        F.col("resource_ref").alias("ref"),
        X.strip_date_prefix(F.concat(F.lit("ge"), "date")).alias("plain_date"),
        X.after_bar(F.concat(F.lit("urn:x|"), "id")).alias("tail"),
        D.html_escape(F.concat(F.lit("<"), "code", F.lit(">"))).alias("escaped"),
        F.sha2("code", 256).alias("digest"),
        F.size(X.hex_ids(F.concat(F.lit("Task/"), X.stable_id(F.col("id")), F.lit("?x=1")))).alias("hex_ids"),
    )


@query(
    "v04_url_parts",
    r"""select page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^/+|/+$', '', 'g') as path, pairs,
        case when pairs>0 then regexp_extract(url, '\?([^=&#]*)=', 1) end as first_key from
        (select *, case when contains(regexp_extract(url, '^[^#]*', 0),'?') then len(string_split(regexp_extract(url,'\?([^#]*)',1),'&')) else 0 end as pairs from pages) z""",
)
def url_parts(spark, sf):
    p = table(spark, sf, "pages")
    pairs = X.query_pairs(F.col("url"), keep_blank=True)
    return p.select("page_id", X.url_path(F.col("url")).alias("path"), F.size(pairs).alias("pairs"), F.try_element_at(pairs, F.lit(1))["key"].alias("first_key"))


@query(
    "v05_dates",
    sql("""select id, strftime(cast(date as date)+30,'%Y-%m-%d') as later, datediff('day', date '1995-01-01', cast(date as date)) as days,
        datediff('day', date '1995-01-01', cast(date as date))*2-5 as rescaled from sr""", "sr"),
)
def dates(spark, sf):
    days = F.datediff(F.to_date("date"), F.lit("1995-01-01").cast("date"))
    return charts.servicerequest(spark, sf).select("id", charts.day(F.date_add(F.to_date("date"), 30)).alias("later"), days.alias("days"), (days * 2 - 5).alias("rescaled"))


@query("v06_math", sql("select code, count(*) as n, avg(value) as mean, median(value) as median, round(max(value)/3, 3) as third from obs group by code", "obs"))
def math(spark, sf):
    o = charts.observation(spark, sf)
    return o.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.round(F.max("value") / 3, 3).alias("third"))


@query(
    "v07_arrays",
    sql("""select o_orderkey, o_orderkey%3=0 as subset, 2+(case when o_orderkey%2=0 then 0 else 1 end) as n from orders""", ),
)
def arrays(spark, sf):
    k = F.col("o_orderkey")
    a = F.array_sort(F.array_distinct(F.array(F.lit("a"), F.lit("b"), F.when(k % 2 == 0, "a").otherwise("c"))))
    want = F.array(F.lit("a"), F.when(k % 3 == 0, "b").otherwise("z"))
    return table(spark, sf, "orders").select("o_orderkey", F.forall(want, lambda x: F.array_contains(a, x)).alias("subset"), F.size(a).alias("n"))


_FORMS = [
    '{{"answer":{{"v":{k}}},"evidence":["A/1"]}}',
    '```json\n{{"answer":{{"v":{k}}},"evidence":[]}}\n```',
    'Here: {{"answer":{k},"evidence":[]}}',
    '{{"answer":{k},"answer":1,"evidence":[]}}',
    '{{"answer":NaN,"evidence":[]}}',
    '[{k}]',
    '{{"answer":{k},"evidence":[]}} {{"x":1}}',
    ' {{"answer":"}} {{ \\" {k}","evidence":[],"more":1}} ',
]


def answer_column(k):
    n = len(_FORMS)
    forms = []
    for f in _FORMS:
        before, after = f.format(k="\x00").split("\x00") if "{k}" in f else (f.format(), None)
        forms.append(F.lit(before) if after is None else F.concat(F.lit(before), k.cast("string"), F.lit(after)))
    return F.element_at(F.array(*forms), (k % n + 1).cast("int"))


@query(
    "v08_parse_answer",
    "select o_orderkey, o_orderkey%8 in (0,7) as strict, o_orderkey%8 in (0,1,7) as fenced, o_orderkey%8=0 as final, o_orderkey%8 in (0,1) as final_fenced from orders",
)
def parse_answer(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", answer_column(F.col("o_orderkey")).alias("a"))
    return a.select(
        "o_orderkey",
        X.answer_text(F.col("a")).isNotNull().alias("strict"),
        X.answer_text(F.col("a"), True).isNotNull().alias("fenced"),
        X.is_final(F.col("a")).alias("final"),
        X.is_final(F.col("a"), True).alias("final_fenced"),
    )


@query("v09_json_compare", "select o_orderkey, o_orderkey%11 in (0,1,4,5,6,7,10) as equal from orders")
def json_compare(spark, sf):
    k = F.col("o_orderkey")
    pairs = [
        ('{"a":1.0,"b":[true,"x,1.0,y"]}', '{"b":[true,"x,1.0,y"],"a":1}'),
        ('{"a":null}', '{"a":null}'),
        ('{"a":true}', '{"a":1}'),
        ('{"a":[1,2]}', '{"a":[2,1]}'),
        ('{"a":1e10}', '{"a":10000000000}'),
        ('{"a":1e-7}', '{"a":0.0000001}'),
        ('{"a":-0.0}', '{"a":0}'),
        ('{"a":2.50}', '{"a":2.5}'),
        ('{"a":9007199254740993}', '{"a":9007199254740992}'),
        ('{"a":"1e10"}', '{"a":"10000000000"}'),
        ('{"a":1e16}', '{"a":10000000000000000}'),
    ]
    pick = lambda i: F.parse_json(F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), (k % 11 + 1).cast("int")))
    return table(spark, sf, "orders").select("o_orderkey", (D.canonical(pick(0)) == D.canonical(pick(1))).alias("equal"))


@query("v10_bytes", "select doc_id, strlen(text) as bytes, length(text) as characters from documents")
def byte_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.char_length("text").alias("characters"))


@query("sql_functions", sql("select resource_ref as ref, substr(sha256(id||'|'||code),1,24) as sid, code='1-URGENT' as urgent, date as d from sr", "sr"))
def registered_functions(spark, sf):
    X.register_functions(spark)
    charts.resources(spark, sf, "ServiceRequest").createOrReplaceTempView("sr_resources")
    return spark.sql(
        """SELECT ref, stable_id(array(id, variant_get(v, '$.code.coding[0].code', 'string'))) AS sid,
        token_match('urn:chart:codes', variant_get(v, '$.code.coding[0].code', 'string'), '|1-URGENT') AS urgent, resource_date(v) AS d FROM sr_resources"""
    )
