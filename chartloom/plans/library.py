"""Task families as queries over all patients.

Read families return the answer of every patient. Write families return the answer and the change rows to
commit with ``changes.apply_changes``: (patient_ref, bundle_id, seq, method, url, sets, body, if_match,
if_none_exist). ``sets`` is the JSON object of the fields to replace; ``complete_bodies`` turns it into a full body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions.ranks import ranked

C = F.col


# -- change rows -------------------------------------------------------------------------

def _s(x) -> Column:
    return F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x


def write(seq: int, method: str, url, sets=None, body=None, version=None, bundle=None, if_none_exist=None) -> Column:
    etag = F.lit(None).cast("string") if version is None else F.concat(F.lit('W/"'), F.lit(version).cast("string") if not isinstance(version, Column) else version.cast("string"), F.lit('"'))
    return F.struct(
        _s(bundle).alias("bundle_id"), F.lit(seq).alias("seq"), F.lit(method).alias("method"), _s(url).alias("url"), _s(sets).alias("sets"),
        _s(body).alias("body"), etag.alias("if_match"), _s(if_none_exist).alias("if_none_exist"),
    )


def change_rows(df: DataFrame, *writes: Column, patient: str = "patient_ref") -> DataFrame:
    return df.select(C(patient).alias("patient_ref"), F.explode(F.array(*writes)).alias("w")).select("patient_ref", "w.*")


def complete_bodies(changes: DataFrame, chart: DataFrame) -> DataFrame:
    """Full bodies of updates from the fields they set; ``chart`` has (ref, v)."""
    j = changes.join(chart.select(C("ref").alias("url"), C("v").alias("_v")), "url", "left")
    new = F.transform_values(D.fields(F.parse_json("sets")), lambda _, x: F.to_json(x))
    body = F.when(C("sets").isNotNull(), D.with_fields(C("_v"), new)).otherwise(C("body"))
    return j.withColumn("body", body).drop("_v", "sets")


def json_of(**parts) -> Column:
    """JSON object text; trailing underscores of names that are Python keywords are dropped."""
    return F.to_json(F.struct(*[_s(v).alias(k.rstrip("_")) for k, v in parts.items()]))


def link(ref) -> Column:
    return F.struct(_s(ref).alias("reference"))


def review_task(patient, focus, description, **more) -> Column:
    """Body of a requested follow-up Task."""
    return json_of(resourceType="Task", status="requested", intent="order", for_=link(patient), focus=link(focus), description=description, **more)


# -- as of -------------------------------------------------------------------------------

def as_of_latest(df: DataFrame, by: str, date: str, at: str, ref: str = "resource_ref") -> DataFrame:
    """Newest row per group on or before a date, ties to the first in stored (ref) order.

    ``rn <= 1`` is cut inside each task before the shuffle, so a hot group moves few rows.
    """
    w = Window.partitionBy(by).orderBy(C(date).desc(), C(ref))
    dated = df.where((C(date) != "") & (F.substring(C(date), 1, 10) <= at))
    return dated.withColumn("_rn", F.row_number().over(w)).where("_rn <= 1").drop("_rn")


# -- laboratory, orders and messages -----------------------------------------------------

def latest_result(observations: DataFrame, at: str) -> DataFrame:
    final = observations.where("status = 'final'")
    return as_of_latest(final, "patient_ref", "date", at).select("patient_ref", "resource_ref", "date", "value", "unit")


def coverage_lookup(patients: DataFrame, coverages: DataFrame) -> DataFrame:
    """Active coverage by MRN."""
    active = coverages.where("status = 'active'").select("patient_ref", "subscriber_id", "status")
    return patients.select(C("resource_ref").alias("patient_ref"), C("identifier").alias("mrn")).join(active, "patient_ref")


def lab_trend(observations: DataFrame, start: str, end: str) -> DataFrame:
    """Final results in a window, oldest first, as numbered rows of each patient."""
    day = F.substring("date", 1, 10)
    rows = observations.where((C("status") == "final") & (day >= start) & (day <= end))
    numbered = ranked(rows, ["patient_ref"], F.substring("date", 1, 7), [C("date"), C("resource_ref")], "n")
    return numbered.select("patient_ref", "n", day.alias("date"), "value", "unit", "resource_ref")


def linked_report(orders: DataFrame, reports: DataFrame, observations: DataFrame) -> DataFrame:
    """Completed order -> final report -> value of each linked result."""
    o = orders.where("status = 'completed'").select(C("resource_ref").alias("order_ref"), "patient_ref", "identifier")
    r = reports.where("status = 'final' and result_ref is not null").select(C("resource_ref").alias("report_ref"), C("based_on_ref").alias("order_ref"), "result_ref")
    v = observations.select(C("resource_ref").alias("result_ref"), "value", "unit")
    return o.join(r, "order_ref").join(v, "result_ref").select("patient_ref", "identifier", "order_ref", "report_ref", "result_ref", "value", "unit")


def message_followup(linked: DataFrame, messages: DataFrame, sent_on: str):
    """Linked result of patients who wrote on a day; one follow-up Task per report."""
    wrote = messages.where((C("status") == "completed") & (F.substring("date", 1, 10) == sent_on)).select("patient_ref").distinct()
    answer = linked.join(wrote, "patient_ref", "left_semi")
    reports = answer.select("patient_ref", "report_ref").distinct()
    body = review_task(C("patient_ref"), C("report_ref"), "Send the patient a copy of the result")
    return answer, change_rows(reports, write(1, "POST", "Task", body=body))


def cancel_referral(orders: DataFrame, tasks: DataFrame):
    """Active orders with a requested fulfilment Task: revoke and cancel together."""
    o = orders.where("status = 'active'").select(C("resource_ref").alias("order_ref"), "patient_ref", "identifier")
    t = tasks.where("status = 'requested'").select(C("resource_ref").alias("task_ref"), C("focus_ref").alias("order_ref"))
    j = o.join(t, "order_ref")
    b = C("order_ref")
    return j, change_rows(
        j, write(1, "PUT", C("order_ref"), json_of(status="revoked"), version=1, bundle=b), write(2, "PUT", C("task_ref"), json_of(status="cancelled"), version=1, bundle=b)
    )


def coverage_change(coverages: DataFrame, at: str):
    """Close each active coverage on a day and open its successor with the same payer."""
    j = coverages.where("status = 'active'").withColumn("new_subscriber", F.concat(F.lit("NEW-"), F.substring(F.sha2(C("resource_ref"), 256), 1, 8)))
    period = F.struct(C("start_date").alias("start"), F.lit(at).alias("end"))
    new = json_of(
        resourceType="Coverage", status="active", beneficiary=link(C("patient_ref")), payor=F.array(link(C("payor_ref"))),
        subscriberId=C("new_subscriber"), period=F.struct(F.lit(at).alias("start")),
    )
    b = C("resource_ref")
    return j, change_rows(
        j, write(1, "PUT", b, json_of(status="cancelled", period=period), version=1, bundle=b), write(2, "POST", "Coverage", body=new, bundle=b)
    )


def delete_drafts(tasks: DataFrame, pointed_at: DataFrame):
    """Unreferenced draft Tasks; ``pointed_at`` has (ref) of everything some document refers to."""
    free = tasks.where("status = 'draft'").join(pointed_at.select(C("ref").alias("resource_ref")), "resource_ref", "left_anti")
    return free, change_rows(free, write(1, "DELETE", C("resource_ref"), version=1))


def document_availability(patients: DataFrame, documents: DataFrame, code: str) -> DataFrame:
    """Is a document of a type in the chart? Absence is 'not documented', never 'did not happen'."""
    have = documents.where(C("code") == code).select("patient_ref").distinct().withColumn("_d", F.lit(True))
    p = patients.select(C("resource_ref").alias("patient_ref"))
    return p.join(have, "patient_ref", "left").select("patient_ref", F.coalesce("_d", F.lit(False)).alias("documented"))


def prior_auth(patients: DataFrame, orders: DataFrame, procedures: DataFrame, documents: DataFrame, at: str, service: str, prerequisite: str, study: str, days: int = 90) -> DataFrame:
    """Three-item checklist: the service ordered, the prerequisite done within a window, a study on file."""
    base = document_availability(patients, documents, study).withColumnRenamed("documented", "external_study")
    ordered = orders.where(C("code") == service).select("patient_ref").distinct().withColumn("_o", F.lit(True))
    done = procedures.where((C("code") == prerequisite) & (C("date") <= at)).groupBy("patient_ref").agg(F.max("date").alias("prerequisite_date"))
    recent = F.datediff(F.to_date(F.lit(at)), F.to_date("prerequisite_date")) <= days
    return base.join(ordered, "patient_ref", "left").join(done, "patient_ref", "left").select(
        "patient_ref", F.coalesce("_o", F.lit(False)).alias("requested_service"), F.coalesce(recent, F.lit(False)).alias("prerequisite"),
        "prerequisite_date", "external_study",
    )


def correct_erroneous(observations: DataFrame):
    """Mark named results as entered in error, everything else kept."""
    return change_rows(observations, write(1, "PUT", C("resource_ref"), json_of(status="entered-in-error"), version=1))


def documented_names(patients: DataFrame, records: DataFrame, name: str) -> DataFrame:
    """Names documented for each patient with how often, one NULL row for a patient without any."""
    named = records.groupBy("patient_ref", C(name).alias("name")).agg(F.count(F.lit(1)).alias("times"))
    return patients.select(C("resource_ref").alias("patient_ref")).join(named, "patient_ref", "left").na.fill(0, ["times"])


def reconciliation(messages: DataFrame):
    """One review Task per reported discrepancy; medication records are left alone."""
    text = "Compare the reported medicines with the list on file."
    return change_rows(messages, write(1, "POST", "Task", body=review_task(C("patient_ref"), C("resource_ref"), text)))


def ambiguous_identity(patients: DataFrame) -> DataFrame:
    """Names shared by several patients: ask for an identifier or birth date, change nothing."""
    n = patients.groupBy("name").agg(F.count(F.lit(1)).alias("candidates"))
    return n.select("name", "candidates", F.when(C("candidates") > 1, "clarify").otherwise("proceed").alias("action"))


# -- registration and scheduling ---------------------------------------------------------

def contact_change(people: DataFrame):
    """Replace the home phone named in the verified call, keep the other contacts.

    ``people`` has (patient_ref, telecom array<struct<system,value,use>>, message).
    """
    phone = F.regexp_extract("message", r"home phone with ([0-9-]+)", 1)
    told = people.withColumn("home_phone", phone).where("home_phone <> ''")
    home = lambda t: (t.system == "phone") & (t.use == "home")
    new = F.transform("telecom", lambda t: F.when(home(t), F.struct(t.system.alias("system"), C("home_phone").alias("value"), t.use.alias("use"))).otherwise(t))
    told = told.withColumn("telecom", new)
    return told, change_rows(told, write(1, "PUT", C("patient_ref"), F.to_json(F.struct("telecom")), version=1))


def interpreter_handoff(flags: DataFrame):
    """A follow-up Task per active communication flag; the flag itself stays active."""
    active = flags.where("status = 'active'")
    return active, change_rows(active, write(1, "POST", "Task", body=review_task(C("patient_ref"), C("resource_ref"), "Book language support for the next talk.")))


def reschedule(appointments: DataFrame, slots: DataFrame):
    """Move booked visits to the first free later slot of the same schedule; free the old, take the new, together.

    Free slots and visits of a schedule are laid on one time line cut by month, so each visit sees the next
    free slot without pairs being formed. Two visits may be offered the same slot; committing the changes
    lets the first one have it.
    """
    booked = appointments.where("status = 'booked'").join(
        slots.select(C("resource_ref").alias("slot_ref"), "schedule_ref"), "slot_ref"
    )
    free = slots.where("status = 'free'").select("schedule_ref", C("start").alias("at"), C("end").alias("new_end"), C("resource_ref").alias("new_slot"))
    both = booked.select("schedule_ref", C("start").alias("at"), F.lit(1).alias("kind"), F.struct("resource_ref", "patient_ref", "slot_ref", "start").alias("a"), F.lit(None).cast("struct<at:string,new_slot:string,new_end:string>").alias("f")).unionByName(
        free.select("schedule_ref", "at", F.lit(0).alias("kind"), F.lit(None).cast("struct<resource_ref:string,patient_ref:string,slot_ref:string,start:string>").alias("a"), F.struct("at", "new_slot", "new_end").alias("f"))
    )
    # Two levels again: first free slot inside the month, else the first of the following months.
    month = F.substring("at", 1, 7)
    both = both.withColumn("_m", month)
    inner = Window.partitionBy("schedule_ref", "_m").orderBy(C("at").desc(), C("kind").desc(), C("f.new_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.last("f", ignorenulls=True).over(inner))
    months = both.groupBy("schedule_ref", "_m").agg(F.min("f").alias("_first"))
    later = Window.partitionBy("schedule_ref").orderBy(C("_m").desc()).rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_later", F.last("_first", ignorenulls=True).over(later)).drop("_first")
    moved = near.where("kind = 1").join(months, ["schedule_ref", "_m"]).withColumn("to", F.coalesce("_near", "_later")).where("to is not null")
    j = moved.select("a.*", "to.*")
    b = C("resource_ref")
    sets = json_of(start=C("at"), end=C("new_end"), slot=F.array(link(C("new_slot"))))
    return j, change_rows(
        j, write(1, "PUT", b, sets, version=1, bundle=b), write(2, "PUT", C("slot_ref"), json_of(status="free"), version=1, bundle=b),
        write(3, "PUT", C("new_slot"), json_of(status="busy"), version=1, bundle=b),
    )


def cancel_visit(appointments: DataFrame):
    """Cancel booked visits and free their slots together."""
    j = appointments.where("status = 'booked' and slot_ref is not null")
    b = C("resource_ref")
    return j, change_rows(
        j, write(1, "PUT", b, json_of(status="cancelled"), version=1, bundle=b), write(2, "PUT", C("slot_ref"), json_of(status="free"), version=1, bundle=b)
    )


# -- specimens, imaging and referrals ----------------------------------------------------

def recollection(orders: DataFrame, specimens: DataFrame):
    """Active orders whose specimen was rejected: no result, one recollection Task under the same order."""
    bad = specimens.where("status = 'unsatisfactory'").select(C("request_ref").alias("order_ref"), C("resource_ref").alias("specimen_ref"), C("status").alias("specimen_status"))
    j = orders.where("status = 'active'").select(C("resource_ref").alias("order_ref"), "patient_ref").join(bad, "order_ref")
    body = review_task(C("patient_ref"), C("order_ref"), "Take the rejected sample again.")
    return j, change_rows(j, write(1, "POST", "Task", body=body))


def corrected_result(observations: DataFrame, specimens: DataFrame) -> DataFrame:
    """Usable results of completed orders with their collection time, and whether the patient has a newer rejected specimen."""
    sp = specimens.select("patient_ref", C("request_ref").alias("based_on_ref"), "collected", "status")
    ok = observations.join(sp.where("status = 'available'").drop("status", "patient_ref"), "based_on_ref")
    newest = specimens.where("status = 'unsatisfactory'").groupBy("patient_ref").agg(F.max("collected").alias("rejected_at"))
    j = ok.join(newest, "patient_ref", "left")
    return j.select(
        "patient_ref", "resource_ref", C("code").alias("test"), "value", "unit", C("collected").alias("collected_at"),
        F.coalesce(C("rejected_at") > C("collected"), F.lit(False)).alias("newer_sample_rejected"),
    )


def imaging_linkage(reports: DataFrame, studies: DataFrame) -> DataFrame:
    """Report -> the study under it."""
    s = studies.select(C("resource_ref").alias("study_ref"), "modality", C("status").alias("study_status"))
    return reports.join(s, "study_ref").select("patient_ref", C("resource_ref").alias("report_ref"), "study_ref", "modality", "study_status", "conclusion")


ACKNOWLEDGED = "referring clinician has acknowledged"


def loop_closure(trackers: DataFrame, replies: DataFrame, at: str):
    """Close a tracking Task only when the reply text records acknowledgement; delivery alone is not enough.

    trackers (resource_ref, patient_ref, report_ref), replies (patient_ref, text). The third result logs the
    acknowledgement in the same transaction.
    """
    said = replies.groupBy("patient_ref").agg(F.max(F.lower("text").contains(ACKNOWLEDGED)).alias("acknowledged"))
    j = trackers.join(said, "patient_ref").withColumn("tracking_status", F.when(C("acknowledged"), "completed").otherwise("in-progress"))
    done = j.where("acknowledged")
    close = write(1, "PUT", C("resource_ref"), json_of(status="completed"), version=1, bundle=C("resource_ref"))
    log = json_of(
        resourceType="Communication", status="completed", subject=link(C("patient_ref")), about=F.array(link(C("report_ref"))), sent=at,
        payload=F.array(F.struct(F.lit("Acknowledged.").alias("contentString"))),
    )
    return j, change_rows(done, close), change_rows(done, close, write(2, "POST", "Communication", body=log, bundle=C("resource_ref")))


# -- medication, vaccines and billing ----------------------------------------------------

def supply_vs_administration(dispenses: DataFrame, administrations: DataFrame) -> DataFrame:
    """Dispensed is not given: per prescription, was it dispensed, was the dose given, and why not."""
    given = administrations.groupBy("request_ref").agg(
        F.max((C("status") == "completed").cast("int")).alias("_g"), F.min("reason").alias("reason")
    )
    d = dispenses.groupBy("request_ref", "patient_ref").agg(F.max((C("status") == "completed").cast("int")).alias("_d"))
    return d.join(given, "request_ref", "left").select(
        "patient_ref", "request_ref", (C("_d") == 1).alias("dispensed"), F.coalesce(C("_g") == 1, F.lit(False)).alias("observed_dose_given"), "reason"
    )


def refill_routing(messages: DataFrame):
    """One verification Task per call, made conditionally so that a repeat finds the first."""
    name = F.concat(F.lit("REVIEW-"), F.element_at(F.split("resource_ref", "/"), -1))
    body = review_task(C("patient_ref"), C("resource_ref"), "Ask the prescriber to confirm the dose before a refill.", identifier=F.array(F.struct(name.alias("value"))))
    return change_rows(messages, write(1, "POST", "Task", body=body, if_none_exist=F.concat(F.lit("identifier="), name)))


def outside_immunization(notes: DataFrame):
    """Vaccination from a note: the date when an administration record states one, else recall only."""
    day = F.nullif(F.regexp_extract("text", r"vaccine on (\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    j = notes.withColumn("day", day).withColumn("exact_date_known", C("day").isNotNull())
    body = F.to_json(F.struct(
        F.lit("Immunization").alias("resourceType"), F.lit("completed").alias("status"), link(C("patient_ref")).alias("patient"), C("day").alias("occurrenceDateTime"),
        F.when(~C("exact_date_known"), "Reported, date unknown").alias("occurrenceString"), F.lit(False).alias("primarySource"),
    ))
    return j, change_rows(j, write(1, "POST", "Immunization", body=body))


def immunization_error(entries: DataFrame):
    return change_rows(entries, write(1, "PUT", C("resource_ref"), json_of(status="entered-in-error"), version=1))


def eligibility_on(responses: DataFrame, coverages: DataFrame) -> DataFrame:
    """In force by the insurer's response for the service date, beside what the registration screen says."""
    c = coverages.select(C("resource_ref").alias("coverage_ref"), C("status").alias("coverage_status"))
    return responses.join(c, "coverage_ref").select(
        "patient_ref", "coverage_ref", "coverage_status", "service_date", C("inforce").alias("in_force"), C("benefit_end").isNotNull().alias("benefit_period_documented")
    )


def correct_charge(charges: DataFrame, accounts: DataFrame):
    """Duplicate billable charges (same patient, code and account): all but the first become errors."""
    a = accounts.where("status = 'active'").select(C("resource_ref").alias("account_ref"))
    first = charges.where("status = 'billable'").groupBy("patient_ref", "code", "account_ref").agg(F.min("resource_ref").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    dup = charges.where("status = 'billable'").join(first.where("_n > 1"), ["patient_ref", "code", "account_ref"]).where("resource_ref <> _keep")
    j = dup.join(a, "account_ref", "left_semi")
    return j, change_rows(j, write(1, "PUT", C("resource_ref"), json_of(status="entered-in-error"), version=1))


def delete_draft_claims(claims: DataFrame, submitted: DataFrame):
    """Draft claims whose coverage and service already have a submitted claim."""
    j = claims.where("status = 'draft'").join(submitted.select("coverage_ref", "service").distinct(), ["coverage_ref", "service"], "left_semi")
    return j, change_rows(j, write(1, "DELETE", C("resource_ref"), version=1))


# -- equipment, nutrition, records and nursing -------------------------------------------

def equipment_handoff(deliveries: DataFrame):
    """Teaching after a confirmed delivery, else a delivery follow-up; use is never assumed."""
    delivered = C("status") == "completed"
    j = deliveries.withColumn("delivered", delivered).withColumn("followup", F.when(delivered, "teaching").otherwise("delivery"))
    body = review_task(C("patient_ref"), C("resource_ref"), F.concat(F.lit("Plan equipment "), C("followup"), F.lit(".")))
    return j, change_rows(j, write(1, "POST", "Task", body=body))


def nutrition_discrepancy(orders: DataFrame, messages: DataFrame):
    """Active nutrition orders of patients who report other instructions: clarify, keep the order."""
    told = messages.select("patient_ref").distinct()
    j = orders.where("status = 'active'").join(told, "patient_ref", "left_semi")
    return j, change_rows(j, write(1, "POST", "Task", body=review_task(C("patient_ref"), C("resource_ref"), "Ask the ordering team which diet holds.")))


def release_scope(requests: DataFrame, consents: DataFrame, at: str) -> DataFrame:
    """A release is covered when an active consent names the recipient and includes the day."""
    c = consents.where((C("status") == "active") & (C("start_date") <= at) & (C("end_date") >= at)).select("patient_ref", "recipient_ref").distinct().withColumn("_ok", F.lit(True))
    return requests.join(c, ["patient_ref", "recipient_ref"], "left").select(
        "patient_ref", "resource_ref", "recipient_ref", F.coalesce("_ok", F.lit(False)).alias("authorization_current")
    )


def reported_allergy(messages: DataFrame):
    """Uncertain allergy history from a message, recorded as unconfirmed."""
    concept = lambda c: F.struct(F.array(F.struct(F.lit(c).alias("code"))).alias("coding"))
    body = F.to_json(F.struct(
        F.lit("AllergyIntolerance").alias("resourceType"), link(C("patient_ref")).alias("patient"), concept("active").alias("clinicalStatus"),
        concept("unconfirmed").alias("verificationStatus"), F.struct(C("substance").alias("text")).alias("code"),
    ))
    return change_rows(messages, write(1, "POST", "AllergyIntolerance", body=body))


def nursing_close(worksheets: DataFrame):
    """Weight and times transcribed from a worksheet text; the visit closed in the same transaction.

    ``worksheets`` has (patient_ref, encounter_ref, start, text).
    """
    w = F.regexp_extract("text", r"clinic: ([0-9.]+) kg at (\S+)\.", 1)
    j = worksheets.withColumn("weight_kg", F.when(w != "", w.try_cast("double"))).withColumn("measured_at", F.regexp_extract("text", r"kg at (\S+)\. ", 1)).withColumn(
        "closed_at", F.regexp_extract("text", r"completed this visit at (\S+)\.", 1)
    ).where("weight_kg is not null")
    obs = json_of(
        resourceType="Observation", status="final", subject=link(C("patient_ref")), encounter=link(C("encounter_ref")), effectiveDateTime=C("measured_at"),
        valueQuantity=F.struct(C("weight_kg").alias("value"), F.lit("kg").alias("unit")),
    )
    period = F.struct(C("start"), C("closed_at").alias("end"))
    b = C("encounter_ref")
    return j, change_rows(
        j, write(1, "POST", "Observation", body=obs, bundle=b), write(2, "PUT", b, json_of(status="finished", period=period), version=1, bundle=b)
    )


# -- laboratory episodes -----------------------------------------------------------------

def panel_measurements(resources: DataFrame) -> DataFrame:
    """Measurements of every report whatever the panel's form: scalar, components or member observations.

    (report_ref, report_status, patient_ref, based_on_ref, code, value, unit); one member level, as panels nest.
    """
    v = C("v")
    reports = resources.where("resource_type = 'DiagnosticReport'").select(
        C("ref").alias("report_ref"), D.text(v, "status").alias("report_status"), "patient_ref", D.first_ref(v, "basedOn").alias("based_on_ref"),
        F.explode_outer(D.references_in(v, "result")).alias("result_ref"),
    )
    quantity = lambda x: F.struct(D.text(x, "code.coding[0].code").alias("code"), D.get(x, "valueQuantity.value", "double").alias("value"), F.coalesce(D.text(x, "valueQuantity.code"), D.text(x, "valueQuantity.unit")).alias("unit"))
    own = F.when(D.node(v, "valueQuantity").isNotNull(), F.array(quantity(v)))
    parts = F.transform(F.filter(D.values_at(v, "component"), lambda c: D.node(c, "valueQuantity").isNotNull()), quantity)
    none = F.array().cast("array<struct<code:string,value:double,unit:string>>")
    obs = resources.where("resource_type = 'Observation'").select(
        C("ref").alias("result_ref"), F.concat(F.coalesce(own, none), F.coalesce(parts, none)).alias("q"), D.references_in(v, "hasMember").alias("members")
    )
    members = obs.select("result_ref", F.explode("members").alias("member_ref")).join(obs.select(C("result_ref").alias("member_ref"), "q"), "member_ref").select("result_ref", "q")
    measured = obs.select("result_ref", "q").unionByName(members).select("result_ref", F.explode("q").alias("m")).select("result_ref", "m.*")
    return reports.join(measured, "result_ref", "left").drop("result_ref")


def lab_followup(reports: DataFrame, at: str):
    body = review_task(C("patient_ref"), C("based_on_ref"), "Look into the caller laboratory question.", authoredOn=at)
    return change_rows(reports.select("patient_ref", "based_on_ref").distinct(), write(1, "POST", "Task", body=body))


def delete_duplicate_drafts(rows: DataFrame, same: list[str], kept_status: str):
    """Drafts of a patient that repeat (in ``same``) a row in ``kept_status``: they go, that row stays.

    ``rows`` has (patient_ref, resource_ref, status) and the columns of ``same``.
    """
    kept = rows.where(C("status") == kept_status).select("patient_ref", *same).distinct()
    drafts = rows.where("status = 'draft'").join(kept, ["patient_ref", *same], "left_semi")
    return drafts, change_rows(drafts, write(1, "DELETE", C("resource_ref"), version=1))


def medication_handoff(requests: DataFrame, medications: DataFrame, dispenses: DataFrame) -> DataFrame:
    """Prescription by medication code (through the referenced medication) and what became of it."""
    m = medications.select(C("resource_ref").alias("medication_ref"), "code")
    d = dispenses.select(C("request_ref").alias("resource_ref"), C("status").alias("dispense_status"), C("handed_over").isNotNull().alias("handed_over"))
    return requests.join(m, "medication_ref").join(d, "resource_ref").select("patient_ref", "resource_ref", "code", "dispense_status", "handed_over")


# -- transfers and declines --------------------------------------------------------------

def transfer_packet(handoffs: DataFrame, episodes: DataFrame, teams: DataFrame, lists: DataFrame, manifests: DataFrame) -> DataFrame:
    """Task -> care episode -> team, packet list and manifest -> documents; transmission is not receipt.

    handoffs (resource_ref, patient_ref, episode_ref, list_ref, manifest_ref), episodes (resource_ref, status, team_ref),
    teams (resource_ref), lists (list_ref, document_ref), manifests (resource_ref).
    """
    e = episodes.select(C("resource_ref").alias("episode_ref"), C("status").alias("episode_status"), "team_ref")
    counts = lists.groupBy("list_ref").agg(F.countDistinct("document_ref").alias("document_count"))
    return (
        handoffs.join(e, "episode_ref").join(teams.select(C("resource_ref").alias("team_ref")), "team_ref", "left_semi")
        .join(manifests.select(C("resource_ref").alias("manifest_ref")), "manifest_ref", "left_semi").join(counts, "list_ref")
        .select("patient_ref", "resource_ref", "manifest_ref", "document_count", "episode_status", F.lit(False).alias("receipt_documented"))
    )


def record_transmission(packets: DataFrame, at: str):
    sent = json_of(
        resourceType="Communication", status="completed", subject=link(C("patient_ref")), about=F.array(link(C("manifest_ref"))), sent=at,
        payload=F.array(F.struct(F.lit("Packet sent; no receipt so far.").alias("contentString"))),
    )
    b = C("resource_ref")
    return change_rows(packets, write(1, "PUT", b, json_of(status="completed"), version=1, bundle=b), write(2, "POST", "Communication", body=sent, bundle=b))


def decline_appointment(appointments: DataFrame, responses: DataFrame):
    """Booked visit declined: appointment, slot and response change together."""
    r = responses.select(C("appointment_ref").alias("resource_ref"), C("resource_ref").alias("response_ref"))
    j = appointments.where("status = 'booked'").join(r, "resource_ref")
    b = C("resource_ref")
    person = F.array(F.struct(link(C("patient_ref")).alias("actor"), F.lit("declined").alias("status")))
    return j, change_rows(
        j, write(1, "PUT", b, json_of(status="cancelled", participant=person), version=1, bundle=b),
        write(2, "PUT", C("slot_ref"), json_of(status="free"), version=1, bundle=b),
        write(3, "PUT", C("response_ref"), json_of(participantStatus="declined"), version=1, bundle=b),
    )


def similar_orders(orders: DataFrame):
    """Active orders of one patient with the same code on the same day: one review, no order cancelled.

    Groups are counted, never paired.
    """
    g = orders.where("status = 'active'").groupBy("patient_ref", "code", "date").agg(F.count(F.lit(1)).alias("orders"), F.min("resource_ref").alias("first_ref")).where("orders > 1")
    text = "Two similar laboratory orders: a clinician decides, both stay."
    return g, change_rows(g, write(1, "POST", "Task", body=review_task(C("patient_ref"), C("first_ref"), text)))
