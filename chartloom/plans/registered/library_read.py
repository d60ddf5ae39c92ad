"""Task families over all patients; write families show the change rows they would commit."""

from pyspark.sql import functions as F

from chartloom.plans import charts
from chartloom.plans import library as L
from chartloom.plans.charts import table
from chartloom.plans.registry import query
from chartloom.plans.sqltext import sql
from chartloom.sources.ndjson import parsed_once

AS_OF = "2000-06-30"
C = F.col
_PICK = ("patient_ref", "seq", "method", "url", "if_match")


def _ch(rows, *more):
    return rows.select(*_PICK, *more)


@query(
    "q01_latest_result",
    sql(
        f"""select patient_ref, resource_ref, date, value, unit from (
        select *, row_number() over (partition by patient_ref order by date desc, resource_ref) as rn
        from obs where status='final' and date<='{AS_OF}') z where rn=1""",
        "obs",
    ),
)
def latest_result(spark, sf):
    return L.latest_result(charts.observation(spark, sf), AS_OF)


query("j13_as_of_latest", sql(f"""select patient_ref, max_by(resource_ref, date||substr(resource_ref,1,0)) is not null as found, max(date) as date from sr where date<='{AS_OF}' group by 1""", "sr"))(
    lambda spark, sf: L.as_of_latest(charts.servicerequest(spark, sf), "patient_ref", "date", AS_OF).select("patient_ref", C("resource_ref").isNotNull().alias("found"), "date")
)


@query("q02_coverage_lookup", sql("select p.resource_ref as patient_ref, identifier as mrn, subscriber_id, status from patient p join cov c on c.patient_ref=p.resource_ref where status='active'", "patient", "cov"))
def coverage_lookup(spark, sf):
    return L.coverage_lookup(charts.patient(spark, sf), charts.coverage(spark, sf))


@query(
    "q03_lab_trend",
    sql("""select patient_ref, row_number() over (partition by patient_ref order by date, resource_ref) as n, date, value, unit, resource_ref from obs where status='final' and date between '1996-01-01' and '1999-12-31'""", "obs"),
)
def lab_trend(spark, sf):
    return L.lab_trend(charts.observation(spark, sf), "1996-01-01", "1999-12-31")


_LINKED = "select o.patient_ref, o.identifier, o.resource_ref as order_ref, r.resource_ref as report_ref, r.result_ref, v.value, v.unit from sr o join report r on r.based_on_ref=o.resource_ref join obs v on v.resource_ref=r.result_ref where o.status='completed'"


def _linked(spark, sf):
    return L.linked_report(charts.servicerequest(spark, sf), charts.diagnosticreport(spark, sf), charts.observation(spark, sf))


@query("q04_linked_report", sql(_LINKED, "sr", "report", "obs"))
def linked_report(spark, sf):
    return _linked(spark, sf)


@query(
    "q05_message_followup",
    sql(f"""with l as ({_LINKED}), w as (select distinct patient_ref from comm where date='2024-01-02')
        select distinct l.patient_ref, 1 as seq, 'POST' as method, 'Task' as url, cast(null as varchar) as if_match,
        '{{"resourceType":"Task","status":"requested","intent":"order","for":{{"reference":"'||l.patient_ref||'"}},"focus":{{"reference":"'||report_ref||'"}},"description":"Send the patient a copy of the result"}}' as body
        from l join w on w.patient_ref=l.patient_ref""", "sr", "report", "obs", "comm"),
)
def message_followup(spark, sf):
    return _ch(L.message_followup(_linked(spark, sf), charts.communication(spark, sf), "2024-01-02")[1], "body")


@query(
    "q06_cancel_referral",
    sql("""with j as (select s.resource_ref as o, s.patient_ref, t.resource_ref as t from sr s join task t on t.focus_ref=s.resource_ref where s.status='active' and t.status='requested')
        select patient_ref, 1 as seq, 'PUT' as method, o as url, 'W/"1"' as if_match, o as bundle_id, '{"status":"revoked"}' as sets from j union all select patient_ref, 2, 'PUT', t, 'W/"1"', o, '{"status":"cancelled"}' from j""", "sr", "task"),
)
def cancel_referral(spark, sf):
    return _ch(L.cancel_referral(charts.servicerequest(spark, sf), charts.task(spark, sf))[1], "bundle_id", "sets")


@query(
    "q07_coverage_change",
    sql("""select patient_ref, 1 as seq, 'PUT' as method, resource_ref as url, 'W/"1"' as if_match, '{"status":"cancelled","period":{"start":"'||start_date||'","end":"2000-06-30"}}' as content from cov where status='active'
        union all select patient_ref, 2, 'POST', 'Coverage', null, '{"resourceType":"Coverage","status":"active","beneficiary":{"reference":"'||patient_ref||'"},"payor":[{"reference":"'||payor_ref||'"}],"subscriberId":"NEW-'||substr(sha256(resource_ref),1,8)||'","period":{"start":"2000-06-30"}}' from cov where status='active'""", "cov"),
)
def coverage_change(spark, sf):
    return _ch(L.coverage_change(charts.coverage(spark, sf), AS_OF)[1], F.coalesce("sets", "body").alias("content"))


@query(
    "q08_delete_drafts",
    sql("""select patient_ref, 1 as seq, 'DELETE' as method, resource_ref as url, 'W/"1"' as if_match from task where status='draft' and o_orderkey%2=0""", "task"),
)
def delete_drafts(spark, sf):
    t = charts.task(spark, sf)
    pointed = t.where(F.substring("id", 2, 20).cast("bigint") % 2 == 1).select(C("resource_ref").alias("ref"))
    return _ch(L.delete_drafts(t, pointed)[1])


@query("q09_document_availability", sql("select p.resource_ref as patient_ref, exists(select 1 from docref d where d.patient_ref=p.resource_ref and code='src3') as documented from patient p", "patient", "docref"))
def document_availability(spark, sf):
    return L.document_availability(charts.patient(spark, sf), charts.documentreference(spark, sf), "src3")


@query(
    "q10_prior_auth",
    sql("""select p.resource_ref as patient_ref, exists(select 1 from sr s where s.patient_ref=p.resource_ref and code='1-URGENT') as requested_service,
        coalesce(datediff('day', cast(d as date), date '1998-06-30')<=90, false) as prerequisite, d as prerequisite_date, exists(select 1 from docref x where x.patient_ref=p.resource_ref and code='src5') as external_study
        from patient p left join (select patient_ref, max(date) as d from proc where code='2-HIGH' and date<='1998-06-30' group by 1) q on q.patient_ref=p.resource_ref""", "patient", "sr", "proc", "docref"),
)
def prior_auth(spark, sf):
    return L.prior_auth(
        charts.patient(spark, sf), charts.servicerequest(spark, sf), charts.procedure(spark, sf), charts.documentreference(spark, sf), "1998-06-30", "1-URGENT", "2-HIGH", "src5"
    )


@query("q11_correct_erroneous", sql("""select patient_ref, 1 as seq, 'PUT' as method, resource_ref as url, 'W/"1"' as if_match, '{"status":"entered-in-error"}' as sets from obs where status='final' and value>=49""", "obs"))
def correct_erroneous(spark, sf):
    return _ch(L.correct_erroneous(charts.observation(spark, sf).where("status = 'final' and value >= 49")), "sets")


@query(
    "q12_documented_names",
    sql("""with n as (select q.patient_ref, m.text as name, count(*) as times from medreq q join medication m on m.resource_ref=q.medication_ref where q.status='active' group by 1,2)
        select p.resource_ref as patient_ref, n.name, coalesce(times,0) as times from patient p left join n on n.patient_ref=p.resource_ref""", "patient", "medreq", "medication"),
)
def documented_names(spark, sf):
    m = charts.medication(spark, sf).select(C("resource_ref").alias("medication_ref"), "text")
    records = charts.medicationrequest(spark, sf).where("status = 'active'").join(m, "medication_ref")
    return L.documented_names(charts.patient(spark, sf), records, "text")


@query(
    "q13_reconciliation",
    sql("""select patient_ref, 1 as seq, 'POST' as method, 'Task' as url, cast(null as varchar) as if_match, '{"resourceType":"Task","status":"requested","intent":"order","for":{"reference":"'||patient_ref||'"},"focus":{"reference":"'||resource_ref||'"},"description":"Compare the reported medicines with the list on file."}' as body from comm where sender='user'""", "comm"),
)
def reconciliation(spark, sf):
    return _ch(L.reconciliation(charts.communication(spark, sf).where("sender = 'user'")), "body")


@query("q14_ambiguous_identity", "select p_name as name, count(*) as candidates, case when count(*)>1 then 'clarify' else 'proceed' end as action from part group by 1")
def ambiguous(spark, sf):
    return L.ambiguous_identity(table(spark, sf, "part").select(C("p_name").alias("name")))


@query(
    "q15_contact_change",
    sql("""select 'Patient/c'||c_custkey as patient_ref, 1 as seq, 'PUT' as method, 'Patient/c'||c_custkey as url, 'W/"1"' as if_match,
        '{"telecom":[{"system":"phone","value":"202-555-'||(100+c_custkey%100)||'","use":"home"},{"system":"email","value":"'||c_custkey||'@example.invalid","use":"work"}]}' as sets from customer where c_custkey%3=0
        union all select patient_ref, 1, 'POST', 'Task', null, '{"resourceType":"Task","status":"requested","intent":"order","for":{"reference":"'||patient_ref||'"},"focus":{"reference":"'||resource_ref||'"},"description":"Book language support for the next talk."}' from docref where lang<>'en'""", "docref"),
)
def contact_change(spark, sf):
    k = C("c_custkey").cast("string")
    entry = lambda s, v, u: F.struct(F.lit(s).alias("system"), v.alias("value"), F.lit(u).alias("use"))
    people = table(spark, sf, "customer").select(
        F.concat(F.lit("Patient/c"), k).alias("patient_ref"), F.array(entry("phone", F.lit("202-555-0199"), "home"), entry("email", F.concat(k, F.lit("@example.invalid")), "work")).alias("telecom"),
        F.when(C("c_custkey") % 3 == 0, F.concat(F.lit("Identity verified. Replace the home phone with 202-555-"), (100 + C("c_custkey") % 100).cast("string"), F.lit("; keep any email."))).otherwise("No change.").alias("message"),
    )
    flags = charts.documentreference(spark, sf).where("lang <> 'en'").withColumn("status", F.lit("active"))
    return _ch(L.contact_change(people)[1], "sets").unionByName(_ch(L.interpreter_handoff(flags)[1], C("body").alias("sets")))


@query(
    "q16_reschedule",
    """with s as (select 'Slot/s'||o_orderkey as r, 'Schedule/h'||(o_orderkey%50) as sch, strftime(o_orderdate,'%Y-%m-%d')||'T09:00:00Z' as st, o_orderstatus, o_custkey, o_orderkey from orders),
       f as (select * from s where o_orderstatus='O'), b as (select * from s where o_orderstatus='F' and o_orderkey%5<>0)
       select 'Patient/c'||b.o_custkey as patient_ref, 'Appointment/a'||b.o_orderkey as resource_ref, b.r as slot_ref, min(struct_pack(t := f.st, r := f.r)).r as new_slot from b join f on f.sch=b.sch and f.st>b.st group by 1,2,3""",
)
def reschedule(spark, sf):
    k = C("o_orderkey")
    o = table(spark, sf, "orders")
    slots = charts.slot(spark, sf).withColumn("schedule_ref", F.concat(F.lit("Schedule/h"), (F.substring("id", 2, 20).cast("bigint") % 50).cast("string")))
    start = F.concat(charts.day("o_orderdate"), F.lit("T09:00:00Z"))
    appts = o.where("o_orderstatus = 'F'").select(
        charts.key("Appointment/a", "o_orderkey").alias("resource_ref"), charts.key("Patient/c", "o_custkey").alias("patient_ref"), charts.key("Slot/s", "o_orderkey").alias("slot_ref"),
        start.alias("start"), F.when(k % 5 == 0, "cancelled").otherwise("booked").alias("status"),
    )
    return L.reschedule(appts, slots)[0].select("patient_ref", "resource_ref", "slot_ref", "new_slot")


@query(
    "q16_cancel_visit",
    sql("""select patient_ref, 1 as seq, 'PUT' as method, resource_ref as url, 'W/"1"' as if_match, '{"status":"cancelled"}' as sets from appt where status='booked'
        union all select patient_ref, 2, 'PUT', slot_ref, 'W/"1"', '{"status":"free"}' from appt where status='booked'""", "appt"),
)
def cancel_visit(spark, sf):
    return _ch(L.cancel_visit(charts.appointment(spark, sf))[1], "sets")


@query(
    "q17_recollection",
    sql("""select o.patient_ref, 1 as seq, 'POST' as method, 'Task' as url, cast(null as varchar) as if_match, p.resource_ref as specimen_ref,
        '{"resourceType":"Task","status":"requested","intent":"order","for":{"reference":"'||o.patient_ref||'"},"focus":{"reference":"'||o.resource_ref||'"},"description":"Take the rejected sample again."}' as body
        from sr o join specimen p on p.request_ref=o.resource_ref where o.status='active' and p.status='unsatisfactory'""", "sr", "specimen"),
)
def recollection(spark, sf):
    j, ch = L.recollection(charts.servicerequest(spark, sf), charts.specimen(spark, sf))
    seen = j.select("specimen_ref", L.review_task(C("patient_ref"), C("order_ref"), "Take the rejected sample again.").alias("body"))
    return _ch(ch, "body").join(seen, "body")


@query(
    "q17_corrected_result",
    sql("""with r as (select patient_ref, max(collected) as rj from specimen where status='unsatisfactory' group by 1)
        select o.patient_ref, o.resource_ref, o.code as test, o.value, o.unit, p.collected as collected_at, coalesce(rj>p.collected,false) as newer_sample_rejected
        from obs o join specimen p on p.request_ref=o.based_on_ref and p.status='available' left join r on r.patient_ref=o.patient_ref where o.status='final'""", "obs", "specimen"),
)
def corrected_result(spark, sf):
    return L.corrected_result(charts.observation(spark, sf).where("status = 'final'"), charts.specimen(spark, sf))


@query(
    "q18_imaging_and_loop",
    sql("""with said as (select patient_ref, bool_or(doc_id%3=0) as a from docref group by 1), t as (select o.resource_ref, o.patient_ref, 'MS'||(o_orderkey%4) as modality from task o)
        select t.patient_ref, t.resource_ref, s.a as acknowledged, case when s.a then 'completed' else 'in-progress' end as tracking_status, modality from t join said s on s.patient_ref=t.patient_ref""", "docref", "task"),
)
def imaging_and_loop(spark, sf):
    t = charts.task(spark, sf)
    n = F.substring("id", 2, 20).cast("bigint")
    study = t.select(F.concat(F.lit("ImagingStudy/"), "id").alias("resource_ref"), F.concat(F.lit("MS"), (n % 4).cast("string")).alias("modality"), F.lit("available").alias("status"))
    reports = t.select(F.concat(F.lit("DiagnosticReport/"), "id").alias("resource_ref"), "patient_ref", F.concat(F.lit("ImagingStudy/"), "id").alias("study_ref"), F.lit("none").alias("conclusion"))
    linked = L.imaging_linkage(reports, study).select(C("report_ref"), "modality")
    replies = charts.documentreference(spark, sf).select("patient_ref", F.when(C("doc_id") % 3 == 0, "The referring clinician has acknowledged the report.").otherwise("The report was delivered.").alias("text"))
    trackers = t.select("resource_ref", "patient_ref", F.concat(F.lit("DiagnosticReport/"), "id").alias("report_ref"))
    j, close, log = L.loop_closure(trackers, replies, AS_OF)
    return j.join(linked, "report_ref").select("patient_ref", "resource_ref", "acknowledged", "tracking_status", "modality")


@query(
    "q18_acknowledgement",
    sql("""with said as (select patient_ref, bool_or(doc_id%3=0) as a from docref group by 1)
        select t.patient_ref, 1 as seq, 'PUT' as method, t.resource_ref as url, 'W/"1"' as if_match, '{"status":"completed"}' as content from task t join said s on s.patient_ref=t.patient_ref where s.a
        union all select t.patient_ref, 2, 'POST', 'Communication', null, '{"resourceType":"Communication","status":"completed","subject":{"reference":"'||t.patient_ref||'"},"about":[{"reference":"DiagnosticReport/'||t.id||'"}],"sent":"2000-06-30","payload":[{"contentString":"Acknowledged."}]}' from task t join said s on s.patient_ref=t.patient_ref where s.a""", "docref", "task"),
)
def acknowledgement(spark, sf):
    replies = charts.documentreference(spark, sf).select("patient_ref", F.when(C("doc_id") % 3 == 0, "Referring clinician has acknowledged the report.").otherwise("Delivered.").alias("text"))
    trackers = charts.task(spark, sf).select("resource_ref", "patient_ref", F.concat(F.lit("DiagnosticReport/"), "id").alias("report_ref"))
    return _ch(L.loop_closure(trackers, replies, AS_OF)[2], F.coalesce("sets", "body").alias("content"))


@query(
    "q19_supply_vs_administration",
    """select 'Patient/c'||o_custkey as patient_ref, 'ServiceRequest/o'||o_orderkey as request_ref, bool_or(l_returnflag='A') as dispensed, bool_or(l_returnflag='N') as observed_dose_given, min(case when l_returnflag='R' then 'declined' end) as reason
       from lineitem join orders on o_orderkey=l_orderkey group by 1,2""",
)
def supply(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey"))
    base = [charts.key("ServiceRequest/o", "o_orderkey").alias("request_ref"), charts.key("Patient/c", "o_custkey").alias("patient_ref")]
    f = C("l_returnflag")
    return L.supply_vs_administration(
        j.select(*base, F.when(f == "A", "completed").otherwise("stopped").alias("status")),
        j.select(base[0], F.when(f == "N", "completed").otherwise("not-done").alias("status"), F.when(f == "R", "declined").alias("reason")),
    )


@query("q19_refill_routing", sql("""select patient_ref, 1 as seq, 'POST' as method, 'Task' as url, cast(null as varchar) as if_match, 'identifier=REVIEW-'||id as if_none_exist from comm where sender='user'""", "comm"))
def refill(spark, sf):
    return _ch(L.refill_routing(charts.communication(spark, sf).where("sender = 'user'")), "if_none_exist")


@query(
    "q20_outside_immunization",
    sql("""select patient_ref, 1 as seq, 'POST' as method, 'Immunization' as url, cast(null as varchar) as if_match, '{"resourceType":"Immunization","status":"completed","patient":{"reference":"'||patient_ref||'"},'||
        case when o_orderkey%2=0 then '"occurrenceDateTime":"'||date||'"' else '"occurrenceString":"Reported, date unknown"' end||',"primarySource":false}' as content from sr
        union all select patient_ref, 1, 'PUT', 'Immunization/x'||id, 'W/"1"', '{"status":"entered-in-error"}' from sr where o_orderkey%17=0""", "sr"),
)
def immunization(spark, sf):
    s = charts.servicerequest(spark, sf)
    n = F.substring("id", 2, 20).cast("bigint")
    notes = s.select("patient_ref", F.when(n % 2 == 0, F.concat(F.lit("Record reviewed: seasonal influenza vaccine on "), "date", F.lit("; lot unavailable."))).otherwise("Recalls a vaccine last winter.").alias("text"))
    wrong = s.where(n % 17 == 0).select("patient_ref", F.concat(F.lit("Immunization/x"), "id").alias("resource_ref"))
    made = L.outside_immunization(notes)[1].unionByName(L.immunization_error(wrong))
    return _ch(made, F.coalesce("sets", "body").alias("content"))


@query(
    "q21_eligibility_charges_claims",
    sql("""select patient_ref, resource_ref as coverage_ref, status as coverage_status, '2000-06-30' as service_date, start_date<='2000-06-30' and end_date>='2000-06-30' as in_force, end_date>='1998-01-01' as benefit_period_documented from cov""", "cov"),
)
def eligibility(spark, sf):
    c = charts.coverage(spark, sf)
    responses = c.select("patient_ref", C("resource_ref").alias("coverage_ref"), F.lit(AS_OF).alias("service_date"), ((C("start_date") <= AS_OF) & (C("end_date") >= AS_OF)).alias("inforce"), F.when(C("end_date") >= "1998-01-01", C("end_date")).alias("benefit_end"))
    return L.eligibility_on(responses, c)


@query(
    "q21_charges_and_claims",
    sql("""with c as (select *, min(resource_ref) over (partition by patient_ref, code) as keep, count(*) over (partition by patient_ref, code) as n from sr)
        select patient_ref, 1 as seq, 'PUT' as method, resource_ref as url, 'W/"1"' as if_match from c where n>1 and resource_ref<>keep and substr(patient_ref,10)::bigint%2=0
        union all select patient_ref, 1, 'DELETE', resource_ref, 'W/"1"' from sr s where status='draft' and exists (select 1 from sr x where x.status='completed' and x.patient_ref=s.patient_ref and x.code=s.code)""", "sr"),
)
def charges_and_claims(spark, sf):
    s = charts.servicerequest(spark, sf)
    account = F.concat(F.lit("Account/"), "patient_ref")
    charges = s.select("resource_ref", "patient_ref", "code", account.alias("account_ref"), F.lit("billable").alias("status"))
    accounts = charts.patient(spark, sf).select(F.concat(F.lit("Account/"), "resource_ref").alias("resource_ref"), F.when(F.substring("id", 2, 20).cast("bigint") % 2 == 0, "active").otherwise("inactive").alias("status"))
    claims = s.select("resource_ref", "patient_ref", "status", C("patient_ref").alias("coverage_ref"), C("code").alias("service"))
    return _ch(L.correct_charge(charges, accounts)[1]).unionByName(_ch(L.delete_draft_claims(claims, claims.where("status = 'completed'"))[1]))


@query(
    "q22_equipment_and_nutrition",
    sql("""select patient_ref, 'Task' as url, '{"resourceType":"Task","status":"requested","intent":"order","for":{"reference":"'||patient_ref||'"},"focus":{"reference":"'||resource_ref||'"},"description":"Plan equipment '||case when status='completed' then 'teaching' else 'delivery' end||'."}' as body from sr
        union all select patient_ref, 'Task', '{"resourceType":"Task","status":"requested","intent":"order","for":{"reference":"'||patient_ref||'"},"focus":{"reference":"'||resource_ref||'"},"description":"Ask the ordering team which diet holds."}' from sr where status='active' and patient_ref in (select patient_ref from comm)""", "sr", "comm"),
)
def equipment(spark, sf):
    s = charts.servicerequest(spark, sf)
    a, b = L.equipment_handoff(s)[1], L.nutrition_discrepancy(s, charts.communication(spark, sf))[1]
    return a.unionByName(b).select("patient_ref", "url", "body")


@query(
    "q23_release_scope",
    sql("""select s.patient_ref, s.resource_ref, 'Organization/n'||(o_orderkey%25) as recipient_ref, exists(select 1 from cov c where c.patient_ref=s.patient_ref and c.payor_ref='Organization/n'||(o_orderkey%25) and c.status='active' and c.start_date<='1997-06-30' and c.end_date>='1997-06-30') as authorization_current from sr s""", "sr", "cov"),
)
def release_scope(spark, sf):
    requests = charts.servicerequest(spark, sf).select("patient_ref", "resource_ref", F.concat(F.lit("Organization/n"), (F.substring("id", 2, 20).cast("bigint") % 25).cast("string")).alias("recipient_ref"))
    consents = charts.coverage(spark, sf).withColumnRenamed("payor_ref", "recipient_ref")
    return L.release_scope(requests, consents, "1997-06-30")


@query(
    "q24_allergy_and_nursing",
    sql("""select patient_ref, 1 as seq, 'POST' as method, 'AllergyIntolerance' as url, cast(null as varchar) as if_match, '{"resourceType":"AllergyIntolerance","patient":{"reference":"'||patient_ref||'"},"clinicalStatus":{"coding":[{"code":"active"}]},"verificationStatus":{"coding":[{"code":"unconfirmed"}]},"code":{"text":"'||sender||'"}}' as content from comm
        union all select patient_ref, 1, 'POST', 'Observation', null, '{"resourceType":"Observation","status":"final","subject":{"reference":"'||patient_ref||'"},"encounter":{"reference":"Encounter/'||id||'"},"effectiveDateTime":"'||date||'T09:15:00Z","valueQuantity":{"value":'||(o_orderkey%80+1)||'.5,"unit":"kg"}}' from sr where o_orderkey%3=0
        union all select patient_ref, 2, 'PUT', 'Encounter/'||id, 'W/"1"', '{"status":"finished","period":{"start":"'||date||'","end":"'||date||'T09:30:00Z"}}' from sr where o_orderkey%3=0""", "comm", "sr"),
)
def allergy_and_nursing(spark, sf):
    s = charts.servicerequest(spark, sf)
    n = F.substring("id", 2, 20).cast("bigint")
    note = F.concat(F.lit("Weight measured in clinic: "), (n % 80 + 1).cast("string"), F.lit(".5 kg at "), "date", F.lit("T09:15:00Z. The nurse completed this visit at "), "date", F.lit("T09:30:00Z. Transcribe."))
    sheets = s.select("patient_ref", F.concat(F.lit("Encounter/"), "id").alias("encounter_ref"), C("date").alias("start"), F.when(n % 3 == 0, note).otherwise("Nothing measured.").alias("text"))
    allergies = charts.communication(spark, sf).select("patient_ref", C("sender").alias("substance"))
    return _ch(L.reported_allergy(allergies), F.coalesce("sets", "body").alias("content")).unionByName(_ch(L.nursing_close(sheets)[1], F.coalesce("sets", "body").alias("content")))


@query(
    "q25_panel_measurements",
    sql("""select r.resource_ref as report_ref, 'final' as report_status, r.patient_ref, r.based_on_ref, o.code, o.value, o.unit from report r left join obs o on o.resource_ref=r.result_ref where coalesce(o.status,'')<>'preliminary'
        union all select r.resource_ref, 'final', r.patient_ref, r.based_on_ref, 'part', o.value+1, 'mg' from report r join obs o on o.resource_ref=r.result_ref and o.status='preliminary'""", "report", "obs"),
)
def panels(spark, sf):
    r = charts.resources(spark, sf, "DiagnosticReport", "Observation")
    # Preliminary results become panels whose value sits in a component.
    part = F.regexp_replace("doc", r'"valueQuantity":\{"value":([0-9.]+),"unit":"mg"\}', '"component":[{"code":{"coding":[{"code":"part"}]},"valueQuantity":{"value":1$1,"unit":"mg"}}]')
    doc = F.when((C("resource_type") == "Observation") & C("doc").contains("preliminary"), part).otherwise(C("doc"))
    m = L.panel_measurements(parsed_once(r, F.parse_json(doc)))
    # The rewrite puts a 1 in front of the digits: value v with d digits reads as 10^d + v.
    digits = F.length(F.floor("value").cast("string")) - 1
    back = F.when(C("code") == "part", C("value") - F.pow(F.lit(10.0), digits) + 1).otherwise(C("value"))
    return m.withColumn("value", back)


_PLAIN = "1 as seq, 'DELETE' as method, resource_ref as url, 'W/\"1\"' as if_match"


@query(
    "q25_lab_followup",
    sql(f"""select distinct patient_ref, 1 as seq, 'POST' as method, 'Task' as url, cast(null as varchar) as if_match, '{{"resourceType":"Task","status":"requested","intent":"order","for":{{"reference":"'||patient_ref||'"}},"focus":{{"reference":"'||based_on_ref||'"}},"description":"Look into the caller laboratory question.","authoredOn":"{AS_OF}"}}' as body from report""", "report"),
)
def lab_followup(spark, sf):
    return _ch(L.lab_followup(charts.diagnosticreport(spark, sf), AS_OF), "body")


@query(
    "q26_delete_duplicate_tasks",
    sql(f"""select patient_ref, {_PLAIN} from task t where status='draft' and exists (select 1 from task x where x.patient_ref=t.patient_ref and x.description=t.description and x.status='requested')""", "task"),
)
def duplicate_tasks(spark, sf):
    return _ch(L.delete_duplicate_drafts(charts.task(spark, sf), ["description"], "requested")[1])


@query(
    "q23_delete_release_drafts",
    sql(f"""select patient_ref, {_PLAIN} from sr t where status='draft' and exists (select 1 from sr x where x.patient_ref=t.patient_ref and x.code=t.code and x.status='active')""", "sr"),
)
def release_drafts(spark, sf):
    requests = charts.servicerequest(spark, sf).withColumnRenamed("code", "recipient_ref")
    return _ch(L.delete_duplicate_drafts(requests, ["recipient_ref"], "active")[1])


@query(
    "q26_medication_handoff",
    sql("""select q.patient_ref, q.resource_ref, m.code, q.status as dispense_status, q.handed_over>='2000-01-01' as handed_over from medreq q join medication m on m.resource_ref=q.medication_ref where m.code in ('SMALL','LARGE')""", "medreq", "medication"),
)
def medication_handoff(spark, sf):
    q = charts.medicationrequest(spark, sf)
    d = q.select(C("resource_ref").alias("request_ref"), "status", F.when(C("handed_over") >= "2000-01-01", C("handed_over")).alias("handed_over"))
    return L.medication_handoff(q.drop("status", "handed_over"), charts.medication(spark, sf).where("code in ('SMALL', 'LARGE')"), d)


@query(
    "q27_transfer_packet",
    """select 'Patient/c'||o_custkey as patient_ref, 'Task/h'||o_orderkey as resource_ref, 'DocumentManifest/m'||o_orderkey as manifest_ref, count(distinct l_partkey) as document_count, case when o_orderstatus='F' then 'finished' else 'active' end as episode_status, false as receipt_documented
       from orders join lineitem on l_orderkey=o_orderkey where o_orderkey%4<>1 group by 1,2,3,5""",
)
def transfer(spark, sf):
    o = table(spark, sf, "orders")
    ref = lambda p: charts.key(p, "o_orderkey")
    h = o.select(ref("Task/h").alias("resource_ref"), charts.key("Patient/c", "o_custkey").alias("patient_ref"), ref("EpisodeOfCare/e").alias("episode_ref"), ref("List/l").alias("list_ref"), ref("DocumentManifest/m").alias("manifest_ref"))
    e = o.select(ref("EpisodeOfCare/e").alias("resource_ref"), F.when(C("o_orderstatus") == "F", "finished").otherwise("active").alias("status"), ref("CareTeam/t").alias("team_ref"))
    teams = o.where("o_orderkey % 4 <> 1").select(ref("CareTeam/t").alias("resource_ref"))
    lists = table(spark, sf, "lineitem").select(charts.key("List/l", "l_orderkey").alias("list_ref"), charts.key("DocumentReference/d", "l_partkey").alias("document_ref"))
    return L.transfer_packet(h, e, teams, lists, o.select(ref("DocumentManifest/m").alias("resource_ref")))


@query(
    "q27_record_transmission",
    """select 'Patient/c'||o_custkey as patient_ref, 1 as seq, 'PUT' as method, 'Task/h'||o_orderkey as url, 'W/"1"' as if_match from orders union all select 'Patient/c'||o_custkey, 2, 'POST', 'Communication', null from orders""",
)
def transmission(spark, sf):
    p = table(spark, sf, "orders").select(charts.key("Patient/c", "o_custkey").alias("patient_ref"), charts.key("Task/h", "o_orderkey").alias("resource_ref"), charts.key("DocumentManifest/m", "o_orderkey").alias("manifest_ref"))
    return _ch(L.record_transmission(p, AS_OF))


@query(
    "q28_decline_and_similar",
    sql("""select patient_ref, 1 as seq, 'PUT' as method, resource_ref as url, 'W/"1"' as if_match from appt where status='booked' union all select patient_ref, 2, 'PUT', slot_ref, 'W/"1"' from appt where status='booked'
        union all select patient_ref, 3, 'PUT', 'AppointmentResponse/'||id, 'W/"1"' from appt where status='booked'
        union all select patient_ref, 1, 'POST', 'Task', null from (select patient_ref, code, substr(date,1,4) from sr where status='active' group by 1,2,3 having count(*)>1) z""", "appt", "sr"),
)
def decline(spark, sf):
    a = charts.appointment(spark, sf)
    r = a.select(F.concat(F.lit("AppointmentResponse/"), "id").alias("resource_ref"), C("resource_ref").alias("appointment_ref"))
    s = charts.servicerequest(spark, sf).withColumn("date", F.substring("date", 1, 4))
    return _ch(L.decline_appointment(a, r)[1]).unionByName(_ch(L.similar_orders(s)[1]))
