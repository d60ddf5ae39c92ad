from pyspark.sql import functions as F

from chartloom.operators import views
from chartloom.plans import charts
from chartloom.plans.registry import query
from chartloom.plans.sqltext import sql

_FROM = {
    "Patient": ("patient", "resource_ref, id, identifier, name, birth_date, gender"),
    "Observation": ("obs", "resource_ref, id, patient_ref, code, status, date, value, unit"),
    "ServiceRequest": ("sr", "resource_ref, id, patient_ref, identifier, code, status, date"),
    "DiagnosticReport": ("report", "resource_ref, id, patient_ref, code, status, date, based_on_ref, result_ref"),
    "Coverage": ("cov", "resource_ref, id, patient_ref, status, subscriber_id, payor_ref, start_date, end_date"),
    "Task": ("task", "resource_ref, id, patient_ref, status, focus_ref, description"),
    "Communication": ("comm", "resource_ref, id, patient_ref, status, payload, date"),
    "DocumentReference": ("docref", "resource_ref, id, patient_ref, status, code, title"),
    "Procedure": ("proc", "resource_ref, id, patient_ref, code, status, date"),
}


def _view(kind):
    return lambda spark, sf: views.project(charts.resources(spark, sf, kind), kind)


for _n, (_kind, (_cte, _cols)) in enumerate(_FROM.items(), 8):
    query(f"p{_n:02d}_{_kind.lower()}_view", sql(f"select {_cols} from {_cte}", _cte))(_view(_kind))


@query(
    "p17_resource_view",
    sql(
        """select resource_ref, 'Slot' as resource_type, cast(null as varchar) as patient_ref,
        '{"end":"'||"end"||'","id":"'||id||'","meta":{"versionId":"1"},"overbooked":'||(case when overbooked then 'true' else 'false' end)||
        ',"resourceType":"Slot","start":"'||"start"||'","status":"'||status||'"}' as resource_json from slot
        union all
        select resource_ref, 'Task', patient_ref, '{"description":"'||description||'","focus":{"reference":"'||focus_ref||'"},"for":{"reference":"'||patient_ref||
        '"},"id":"'||id||'","meta":{"versionId":"1"},"resourceType":"Task","status":"'||status||'"}' from task""",
        "slot", "task",
    ),
)
def resource_view(spark, sf):
    return views.project(charts.resources(spark, sf, "Slot", "Task"), "Resource")


@query(
    "l3_truncate",
    sql("""with r as (select resource_ref, status from sr where status='draft' order by resource_ref limit 51)
        select *, (select count(*)>50 from r) as truncated from r order by resource_ref limit 50""", "sr"),
)
def truncate(spark, sf):
    df = charts.servicerequest(spark, sf).where("status = 'draft'").select("resource_ref", "status").orderBy("resource_ref")
    return views.truncate(df)
