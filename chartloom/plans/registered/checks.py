"""Integrity checks over the charts; the comparison queries restate each rule."""

from pyspark.sql import functions as F

from chartloom.operators import checks
from chartloom.operators import edges as G
from chartloom.plans import charts
from chartloom.plans.charts import table
from chartloom.plans.registry import query
from chartloom.plans.sqltext import sql
from chartloom.sources.contracts import contract_rows, root_contracts
from chartloom.sources.ndjson import parsed_once


@query(
    "i01_duplicate_identity",
    """select 'Line/'||l_orderkey||'-'||l_linenumber as ref, 'duplicate_identity' as rule, cast(count(*) as varchar) as detail
       from lineitem group by l_orderkey, l_linenumber having count(*)>1""",
)
def duplicate_identity(spark, sf):
    return checks.duplicate_identity(table(spark, sf, "lineitem").select(charts.key("Line/", "l_orderkey", "l_linenumber").alias("ref")))


@query(
    "i02_multi_patient",
    sql("""select 'ServiceRequest/'||id as ref, 'multi_patient' as rule, list_aggregate(list_sort([patient_ref, 'Patient/c5']), 'string_agg', ',') as detail
        from sr where o_orderkey%10=3 and patient_ref<>'Patient/c5'""", "sr"),
)
def multi_patient(spark, sf):
    r = charts.resources(spark, sf, "ServiceRequest")
    second = F.regexp_replace("doc", r"\}$", ',"patient":{"reference":"Patient/c5"}}')
    odd = F.substring("id", 2, 20).cast("bigint") % 10 == 3
    return checks.multi_patient(parsed_once(r, F.parse_json(F.when(odd, second).otherwise(F.col("doc")))))


def _edges(spark, sf):
    """Edges of appointments and tasks, read off the typed projections."""
    a = charts.appointment(spark, sf).select(F.col("resource_ref").alias("src_ref"), F.col("patient_ref").alias("src_owner"), F.lit("slot").alias("field"), F.col("slot_ref").alias("dst_ref"))
    t = charts.task(spark, sf).select(F.col("resource_ref").alias("src_ref"), F.col("patient_ref").alias("src_owner"), F.lit("focus").alias("field"), F.col("focus_ref").alias("dst_ref"))
    return a.unionByName(t)


@query(
    "i05_j06_broken_refs",
    sql("""select resource_ref as ref, 'broken_reference' as rule, result_ref as detail from report where result_ref in
        (select resource_ref from obs where status='entered-in-error')""", "report", "obs"),
)
def broken_refs(spark, sf):
    reports = charts.resources(spark, sf, "DiagnosticReport")
    others = charts.observation(spark, sf).where("status <> 'entered-in-error'").select(F.col("resource_ref").alias("ref"))
    for kind in ("ServiceRequest", "Patient"):
        others = others.unionByName(charts.VIEWS[kind](spark, sf).select(F.col("resource_ref").alias("ref")))
    return checks.broken_references(others, G.edges(reports))


@query(
    "i06_j07_cross_patient_refs",
    sql("""select t.resource_ref as ref, 'cross_patient_reference' as rule, s.resource_ref as detail from task t
        join sr s on s.resource_ref='ServiceRequest/o'||(t.o_orderkey+1) where s.patient_ref<>t.patient_ref""", "task", "sr"),
)
def cross_patient_refs(spark, sf):
    t = charts.task(spark, sf).select(
        F.col("resource_ref").alias("src_ref"), F.col("patient_ref").alias("src_owner"),
        F.concat(F.lit("ServiceRequest/o"), (F.regexp_extract("focus_ref", r"o(\d+)$", 1).cast("bigint") + 1).cast("string")).alias("dst_ref"),
    )
    owners = charts.servicerequest(spark, sf).select(F.col("resource_ref").alias("ref"), "patient_ref")
    return checks.cross_patient_references(owners, t)


@query(
    "i07_team_on_behalf",
    "select 'CareTeam/'||s_suppkey as ref, 'team_on_behalf' as rule, cast(null as varchar) as detail from supplier where s_suppkey%3<>0",
)
def team(spark, sf):
    from chartloom.sources.ndjson import from_documents

    k = F.col("s_suppkey")
    member = F.when(k % 3 == 0, F.concat(F.lit("Practitioner/p"), k.cast("string"))).when(k % 3 == 1, "Patient/c1")
    who = F.struct(F.struct(F.lit("Organization/n1").alias("reference")).alias("onBehalfOf"), F.when(member.isNotNull(), F.struct(member.alias("reference"))).alias("member"))
    doc = F.to_json(F.struct(F.lit("CareTeam").alias("resourceType"), k.cast("string").alias("id"), F.array(who).alias("participant")))
    return checks.team_on_behalf(from_documents(table(spark, sf, "supplier").select(doc.alias("doc"))))


@query(
    "i08_list_dates",
    "select 'List/'||o_orderkey as ref, 'list_dates' as rule, cast(null as varchar) as detail from orders where o_orderstatus<>'F' and o_orderkey%2=0",
)
def list_dates(spark, sf):
    from chartloom.sources.ndjson import from_documents

    k = F.col("o_orderkey")
    entry = F.struct(F.when(k % 2 == 0, charts.day("o_orderdate")).alias("date"), F.struct(F.concat(F.lit("Task/t"), k.cast("string")).alias("reference")).alias("item"))
    mode = F.when(F.col("o_orderstatus") == "F", "working").when(F.col("o_orderstatus") == "O", "snapshot")
    doc = F.to_json(F.struct(F.lit("List").alias("resourceType"), k.cast("string").alias("id"), mode.alias("mode"), F.array(entry).alias("entry")))
    return checks.list_dates(from_documents(table(spark, sf, "orders").select(doc.alias("doc"))))


@query(
    "i09_intervals",
    sql("""select resource_ref as ref, 'interval' as rule, "start"||'..'||"end" as detail from appt where "start">="end" """, "appt"),
)
def intervals(spark, sf):
    both = charts.appointment(spark, sf).select("resource_ref", "start", "end").unionByName(charts.slot(spark, sf).select("resource_ref", "start", "end"))
    return checks.intervals(both)


@query(
    "i10_j08_slot_containment",
    sql("""select a.resource_ref as ref, 'slot_containment' as rule, case when s.status is null or s.status='free' then 'not reserved' else 'outside slot' end as detail
        from appt a left join slot s on s.resource_ref=a.slot_ref where a.status='booked' and (s.status is null or s.status='free' or a."start"<s."start" or a."end">s."end")""", "appt", "slot"),
)
def slot_containment(spark, sf):
    return checks.slot_containment(charts.appointment(spark, sf), charts.slot(spark, sf))


@query(
    "i11_j09_double_booking",
    sql("""select slot_ref as ref, 'double_booking' as rule, cast(count(*) as varchar) as detail from appt where status='booked' and slot_ref not in
        (select resource_ref from slot where overbooked) group by slot_ref having count(*)>1""", "appt", "slot"),
)
def double_booking(spark, sf):
    return checks.double_booking(charts.appointment(spark, sf), charts.slot(spark, sf))


@query(
    "i12_value_and_absent",
    sql("select resource_ref as ref, 'value_and_absent' as rule, cast(null as varchar) as detail from obs where status='entered-in-error'", "obs"),
)
def value_and_absent(spark, sf):
    r = charts.resources(spark, sf, "Observation")
    absent = F.regexp_replace("doc", r"\}$", ',"dataAbsentReason":{"text":"unknown"}}')
    wrong = F.col("doc").contains("entered-in-error")
    return checks.value_and_absent(parsed_once(r, F.parse_json(F.when(wrong, absent).otherwise(F.col("doc")))))


@query(
    "i13_occurrence_choice",
    "select 'Immunization/'||o_orderkey as ref, 'occurrence_choice' as rule, cast(null as varchar) as detail from orders where o_orderkey%4 in (0,3)",
)
def occurrence_choice(spark, sf):
    from chartloom.sources.ndjson import from_documents

    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(
        F.lit("Immunization").alias("resourceType"), k.cast("string").alias("id"),
        F.when((k % 4).isin(0, 1), charts.day("o_orderdate")).alias("occurrenceDateTime"), F.when((k % 4).isin(0, 2), "childhood").alias("occurrenceString"),
    ))
    return checks.occurrence_choice(from_documents(table(spark, sf, "orders").select(doc.alias("doc"))))


@query(
    "i13_handover_order",
    sql("select resource_ref as ref, 'handover_order' as rule, date||'>'||handed_over as detail from medreq where date>handed_over", "medreq"),
)
def handover(spark, sf):
    return checks.handover_order(charts.medicationrequest(spark, sf).withColumnRenamed("date", "prepared"))


@query(
    "i14_episode_rules",
    sql("""with o as (select o.*, s.resource_ref as specimen_ref, s.status as sp_status, s.request_ref, s.collected from obs o join specimen s on s.request_ref=o.based_on_ref)
        select resource_ref as ref, 'result_from_rejected_specimen' as rule, specimen_ref as detail from o where status='final' and sp_status='unsatisfactory'
        union all select resource_ref, 'result_before_collection', specimen_ref from o where date<collected
        union all select resource_ref, 'received_before_collected', null from specimen where received<collected""", "obs", "specimen"),
)
def episode_rules(spark, sf):
    o = charts.observation(spark, sf).withColumn("specimen_ref", F.replace("based_on_ref", F.lit("ServiceRequest/o"), F.lit("Specimen/z")))
    return checks.episode_rules(o, charts.specimen(spark, sf), charts.servicerequest(spark, sf), charts.diagnosticreport(spark, sf))


@query(
    "i14_dispense_links",
    sql("""select 'D'||m.id as ref, 'dispense_link' as rule, m.resource_ref as detail from medreq m join orders o on 'o'||o.o_orderkey = 'o'||split_part(m.id,'-',1)
        where m.status='stopped' or o.o_orderkey%9=0""", "medreq"),
)
def dispense_links(spark, sf):
    m = charts.medicationrequest(spark, sf)
    order = F.split("id", "-")[0].cast("bigint")
    d = m.select(F.concat(F.lit("D"), "id").alias("resource_ref"), F.when(order % 9 == 0, "Patient/other").otherwise(F.col("patient_ref")).alias("patient_ref"), F.col("resource_ref").alias("prescription_ref"))
    return checks.dispense_links(d, m.where("status = 'active'"))


def _definitions(spark, sf):
    """Structure definitions derived from the charts: the fields each type has in the data."""
    r = charts.resources(spark, sf, "Observation", "Slot", "Task")
    from chartloom.functions import documents as D

    seen = r.select("resource_type", F.explode(F.map_keys(D.fields(F.col("v")))).alias("field")).groupBy("resource_type", "field").agg(F.count(F.lit(1)).alias("n"))
    el = F.struct(
        F.concat_ws(".", "resource_type", "field").alias("path"),
        F.when(F.col("field") == "description", 2).when(F.col("field").isin("code", "status"), 1).otherwise(0).alias("min"),
        F.when(F.col("field") == "basedOn", "*").when(F.col("field") == "focus", "1").otherwise("1").alias("max"),
        F.when(
            F.col("field").isin("focus", "basedOn", "subject", "for"),
            F.array(F.struct(F.lit("Reference").alias("code"), F.array(F.concat(F.lit("http://x/"), F.when(F.col("field") == "focus", "ServiceRequest").when(F.col("field") == "basedOn", "CarePlan").otherwise("Patient"))).alias("targetProfile"))),
        ).otherwise(F.array(F.struct(F.lit("string").alias("code"), F.array().cast("array<string>").alias("targetProfile")))).alias("type"),
    )
    return seen.groupBy(F.col("resource_type").alias("type")).agg(F.struct(F.array_sort(F.collect_list(el)).alias("element")).alias("snapshot"))


@query(
    "i03_j18_contracts",
    sql("""select resource_ref as ref, 'focus' as path, 'list_for_scalar' as violation from obs union all select resource_ref, 'focus', 'target='||focus_ref from obs
        union all select resource_ref, 'basedOn', 'target='||based_on_ref from obs union all select resource_ref, 'description', 'cardinality=1' from task""", "obs", "task"),
)
def contracts(spark, sf):
    c = contract_rows(_definitions(spark, sf))
    return checks.contract_violations(charts.resources(spark, sf, "Observation", "Slot", "Task"), c)


@query(
    "i04_root_contracts",
    sql("""select resource_ref as ref, 'focus' as path, 'list_for_scalar' as violation from obs union all select resource_ref, 'focus', 'target='||focus_ref from obs
        union all select resource_ref, 'basedOn', 'target='||based_on_ref from obs""", "obs"),
)
def root(spark, sf):
    c = contract_rows(_definitions(spark, sf))
    return checks.root_contract_violations(charts.resources(spark, sf, "Observation"), c)


@query(
    "s10_s11_contract_rows",
    """select * from (values ('Observation','code,status','basedOn->CarePlan,focus->ServiceRequest,subject->Patient'), ('Slot','status',''),
       ('Task','description,status','focus->ServiceRequest,for->Patient')) z(type, required, refs) where (select count(*) from orders)>0""",
)
def contract_table(spark, sf):
    c = root_contracts(contract_rows(_definitions(spark, sf)))
    return c.select("type", F.array_join("required", ",").alias("required"), F.array_join("references", ",").alias("refs"))


@query(
    "i15_shapes",
    sql("""select resource_ref as ref, 'unknown:overbooked' as violation from slot union all select resource_ref, 'kind:start' from slot union all select resource_ref, 'missing:schedule' from slot
        union all select resource_ref, 'kind:status' from task""", "slot", "task"),
)
def shapes(spark, sf):
    from chartloom.functions import documents as D

    r = charts.resources(spark, sf, "Slot", "Task")
    seen = r.select("resource_type", F.explode(F.map_entries(D.fields(F.col("v")))).alias("e"))
    kinds = seen.where("e.key <> 'overbooked'").groupBy("resource_type", F.col("e.key").alias("k")).agg(F.min(F.substring_index(F.schema_of_variant("e.value"), "<", 1)).alias("kind"))
    kinds = kinds.withColumn("kind", F.when((F.col("resource_type") == "Slot") & (F.col("k") == "start"), "OBJECT").when((F.col("resource_type") == "Task") & (F.col("k") == "status"), "BOOLEAN").otherwise(F.col("kind")))
    declared = kinds.groupBy("resource_type").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "kind"))).alias("fields"),
        F.when(F.first("resource_type") == "Slot", F.array(F.lit("schedule"), F.lit("status"))).otherwise(F.array(F.lit("status"))).alias("required"),
    )
    return checks.shape_violations(r, declared)


@query(
    "i16_reconcile",
    """select coalesce(a.k, b.k) as k, coalesce(a.n,0) as left_n, coalesce(b.n,0) as right_n from
       (select o_custkey as k, count(*) as n from orders where o_orderstatus='F' group by 1) a full join (select o_custkey as k, count(*) as n from orders where o_orderstatus='O' group by 1) b on a.k=b.k
       where coalesce(a.n,0)<>coalesce(b.n,0)""",
)
def reconcile(spark, sf):
    o = table(spark, sf, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return checks.reconcile(side("F"), side("O"), ["k"])


@query(
    "graph_violations",
    sql("""select rule, count(*) as n from (
        select 'interval' as rule from appt where "start">="end"
        union all select 'slot_containment' from appt a left join slot s on s.resource_ref=a.slot_ref where a.status='booked' and (s.status is null or s.status='free' or a."start"<s."start" or a."end">s."end")
        union all select 'double_booking' from (select slot_ref from appt where status='booked' and slot_ref not in (select resource_ref from slot where overbooked) group by slot_ref having count(*)>1) d
        union all select 'broken_reference' from task t where t.focus_ref is not null
        union all select 'broken_reference' from task t) z group by rule""", "appt", "slot", "task"),
)
def graph(spark, sf):
    r = charts.resources(spark, sf, "Appointment", "Slot", "Task", "Patient")
    # Tasks are checked without the orders they point at, and with a second link to nowhere.
    extra = F.regexp_replace("doc", r"\}$", ',"note":[{"authorReference":{"reference":"Organization/none"}}]}')
    task_doc = F.when(F.col("resource_type") == "Task", extra).otherwise(F.col("doc"))
    kept = parsed_once(r.where("resource_type <> 'Patient'"), F.parse_json(task_doc)).unionByName(
        parsed_once(r.where("resource_type = 'Patient'"), F.parse_json(F.regexp_replace("doc", r',"managingOrganization":\{"reference":"[^"]*"\}', "")))
    )
    return checks.graph_violations(kept).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# -- edges -------------------------------------------------------------------------------

@query("j10_referenced_by", sql("select resource_ref as ref from slot where resource_ref in (select slot_ref from appt)", "slot", "appt"))
def referenced_by(spark, sf):
    return G.referenced_by(charts.slot(spark, sf).select(F.col("resource_ref").alias("ref")), _edges(spark, sf))


@query(
    "a06_edge_counts",
    sql("""select 'Appointment->Patient' as edge, count(*) as n from appt union all select 'Appointment->Slot', count(*) from appt union all
        select 'Observation->ServiceRequest', count(*) from obs union all select 'Observation->Medication', count(*) from obs union all select 'Observation->Patient', count(*) from obs""", "appt", "obs"),
)
def edge_counts(spark, sf):
    return G.edge_counts(G.edges(charts.resources(spark, sf, "Appointment", "Observation")))


@query(
    "j11_closure",
    sql("""with own as (select patient_ref, resource_ref as ref from task union select patient_ref, resource_ref from appt),
        e as (select resource_ref as s, focus_ref as d from task union select resource_ref, patient_ref from task union select resource_ref, slot_ref from appt union select resource_ref, patient_ref from appt
          union select resource_ref, patient_ref from sr union select resource_ref, organization_ref from patient),
        recursive_free as (select * from own union select o.patient_ref, e.d from own o join e on e.s=o.ref),
        third as (select * from recursive_free union select o.patient_ref, e.d from recursive_free o join e on e.s=o.ref),
        fourth as (select * from third union select o.patient_ref, e.d from third o join e on e.s=o.ref)
        select patient_ref, ref from fourth where ref in (select resource_ref from task union select resource_ref from appt union select resource_ref from slot union select resource_ref from sr union select resource_ref from patient)""",
        "task", "appt", "sr", "slot", "patient"),
)
def closure(spark, sf):
    kinds = ("Task", "Appointment", "Slot", "ServiceRequest", "Patient")
    refs = None
    for k in kinds:
        part = charts.VIEWS[k](spark, sf).select(F.col("resource_ref").alias("ref"))
        refs = part if refs is None else refs.unionByName(part)
    link = lambda kind, col: charts.VIEWS[kind](spark, sf).select(F.col("resource_ref").alias("src_ref"), F.col(col).alias("dst_ref"))
    e = link("Task", "focus_ref").unionByName(link("Task", "patient_ref")).unionByName(link("Appointment", "slot_ref")).unionByName(link("Appointment", "patient_ref"))
    e = e.unionByName(link("ServiceRequest", "patient_ref")).unionByName(link("Patient", "organization_ref"))
    own = charts.task(spark, sf).select("patient_ref", F.col("resource_ref").alias("ref")).unionByName(charts.appointment(spark, sf).select("patient_ref", F.col("resource_ref").alias("ref")))
    return G.closure(own, e, refs)
