"""The chart mapping restated over the raw tables, as named SQL subqueries for the comparison queries."""

from __future__ import annotations

DAY = "strftime({}, '%Y-%m-%d')"

PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "patient": (
        """select 'Patient/c'||c_custkey as resource_ref, 'c'||c_custkey as id, 'MRN-'||c_custkey as identifier, c_name as name,
        strftime(date '1940-01-01' + cast((c_custkey*37)%25000 as integer), '%Y-%m-%d') as birth_date,
        case when c_custkey%2=0 then 'female' else 'male' end as gender, 'Organization/n'||c_nationkey as organization_ref from customer""",
        (),
    ),
    "medication": (
        "select 'Medication/m'||p_partkey as resource_ref, 'm'||p_partkey as id, p_type as code, p_name as text from part", (),
    ),
    "sr": (
        """select 'ServiceRequest/o'||o_orderkey as resource_ref, 'o'||o_orderkey as id, 'Patient/c'||o_custkey as patient_ref,
        'ORD-'||o_orderkey as identifier, o_orderpriority as code,
        case o_orderstatus when 'F' then 'completed' when 'O' then 'active' else 'draft' end as status,
        strftime(o_orderdate, '%Y-%m-%d') as date, o_orderkey from orders""",
        (),
    ),
    "lines": (
        """select *, l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||n as line_id from (select *,
        row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey order by l_extendedprice, l_shipdate, l_quantity) as n
        from lineitem) z""",
        (),
    ),
    "obs": (
        """select 'Observation/'||line_id as resource_ref, line_id as id, 'Patient/c'||o_custkey as patient_ref, p_type as code,
        case when l_returnflag='R' then 'entered-in-error' when l_linestatus='O' then 'preliminary' else 'final' end as status,
        strftime(l_shipdate, '%Y-%m-%d') as date, l_quantity as value, 'mg' as unit,
        'ServiceRequest/o'||l_orderkey as based_on_ref, 'Medication/m'||l_partkey as focus_ref
        from lines join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey""",
        ("lines",),
    ),
    "medreq": (
        """select 'MedicationRequest/'||line_id as resource_ref, line_id as id, 'Patient/c'||o_custkey as patient_ref,
        case when l_returnflag='R' then 'stopped' else 'active' end as status, 'Medication/m'||l_partkey as medication_ref,
        strftime(o_orderdate, '%Y-%m-%d') as date, strftime(l_shipdate, '%Y-%m-%d') as handed_over
        from lines join orders on l_orderkey=o_orderkey""",
        ("lines",),
    ),
    "report": (
        """select 'DiagnosticReport/g'||o_orderkey as resource_ref, 'g'||o_orderkey as id, 'Patient/c'||o_custkey as patient_ref,
        o_orderpriority as code, 'final' as status, strftime(o_orderdate, '%Y-%m-%d') as date,
        'ServiceRequest/o'||o_orderkey as based_on_ref, 'Observation/'||line_id as result_ref
        from orders left join lines on l_orderkey=o_orderkey where o_orderstatus='F'""",
        ("lines",),
    ),
    "cov": (
        """select 'Coverage/k'||c_custkey as resource_ref, 'k'||c_custkey as id, 'Patient/c'||c_custkey as patient_ref,
        case when c_acctbal>=0 then 'active' else 'cancelled' end as status, 'SUB-'||c_custkey as subscriber_id,
        'Organization/n'||c_nationkey as payor_ref, strftime(date '1994-01-01' + cast((c_custkey*13)%1460 as integer), '%Y-%m-%d') as start_date,
        strftime(date '1994-01-01' + cast((c_custkey*13)%1460 + (c_custkey%5+1)*365 as integer), '%Y-%m-%d') as end_date,
        c_mktsegment as class from customer""",
        (),
    ),
    "task": (
        """select 'Task/t'||o_orderkey as resource_ref, 't'||o_orderkey as id, 'Patient/c'||o_custkey as patient_ref,
        case when o_orderkey%3=0 then 'draft' else 'requested' end as status, 'ServiceRequest/o'||o_orderkey as focus_ref,
        'Fulfil '||o_orderpriority as description, o_orderkey from orders where o_orderstatus='O'""",
        (),
    ),
    "proc": (
        """select 'Procedure/x'||o_orderkey as resource_ref, 'x'||o_orderkey as id, 'Patient/c'||o_custkey as patient_ref,
        o_orderpriority as code, 'completed' as status, strftime(o_orderdate, '%Y-%m-%d') as date from orders where o_orderstatus='P'""",
        (),
    ),
    "comm": (
        """select 'Communication/v'||conv_id||'-'||turn as resource_ref, 'v'||conv_id||'-'||turn as id,
        'Patient/c'||(conv_id % (select count(*) from customer)) as patient_ref, 'completed' as status, text as payload,
        strftime(date '2024-01-01' + cast(turn as integer), '%Y-%m-%d') as date, role as sender, conv_id, turn from conversations""",
        (),
    ),
    "docref": (
        """select 'DocumentReference/d'||d.doc_id as resource_ref, 'd'||d.doc_id as id,
        'Patient/c'||(d.doc_id % (select count(*) from customer)) as patient_ref, 'current' as status, source as code,
        'Document '||d.doc_id as title, lang, text, case quality when 1 then 'source-preserved' when 0 then 'generated-note' end as tag,
        d.doc_id from documents d left join labels l on l.doc_id=d.doc_id""",
        (),
    ),
    "slot": (
        """select 'Slot/s'||o_orderkey as resource_ref, 's'||o_orderkey as id,
        case o_orderstatus when 'F' then 'busy' when 'O' then 'free' else 'busy-tentative' end as status,
        strftime(o_orderdate, '%Y-%m-%d')||'T09:00:00Z' as "start", strftime(o_orderdate, '%Y-%m-%d')||'T10:00:00Z' as "end",
        o_orderkey%11=0 as overbooked from orders""",
        (),
    ),
    "appt": (
        """select 'Appointment/a'||o_orderkey as resource_ref, 'a'||o_orderkey as id, 'Patient/c'||o_custkey as patient_ref,
        case when o_orderkey%5=0 then 'cancelled' else 'booked' end as status,
        'Slot/s'||(case when o_orderkey%7=0 then o_orderkey - o_orderkey%14 else o_orderkey end) as slot_ref,
        strftime(o_orderdate, '%Y-%m-%d')||(case when o_orderkey%10=1 then 'T08:30:00Z' else 'T09:00:00Z' end) as "start",
        strftime(o_orderdate, '%Y-%m-%d')||(case when o_orderkey%13=0 then 'T08:45:00Z' else 'T09:30:00Z' end) as "end" from orders""",
        (),
    ),
    "specimen": (
        """select 'Specimen/z'||o_orderkey as resource_ref, 'z'||o_orderkey as id, 'Patient/c'||o_custkey as patient_ref,
        case when o_totalprice<20000 then 'unsatisfactory' else 'available' end as status,
        'ServiceRequest/o'||o_orderkey as request_ref, strftime(o_orderdate, '%Y-%m-%d') as collected,
        strftime(cast(o_orderdate as date) + cast(o_orderkey%4-1 as integer), '%Y-%m-%d') as received from orders""",
        (),
    ),
    "ev0": (
        """select *, cast(json_extract_string(props,'$.k') as integer) as k,
        row_number() over (partition by user_id order by ts, event_id) as seq from events""",
        (),
    ),
    "ev": (
        """select 'ep'||user_id as episode_id, seq, ts, user_id, k, event_type,
        case when event_type='view' and k%4=0 then 'sql' else 'rest' end as route,
        case when event_type='click' then 'read_document' when event_type='view' and k%4=0 then 'sql_query' else 'fhir_request' end as via_tool,
        case when event_type='view' and k%4=0 then 'SELECT' when event_type='purchase' then 'POST' when event_type='signup' then 'PUT' else 'GET' end as method,
        case when event_type='view' and k%4=0 then 'SELECT resource_ref, value FROM Observation WHERE code = ''k'||k||''' AND status = ''final'''
          when event_type='view' then 'Observation?patient=c'||user_id||'&code=urn:codes%7Ck'||k||'&date=ge2024-01-'||lpad(cast(k%28+1 as varchar),2,'0')||'&_count=5'
          when event_type='click' then 'ServiceRequest/o'||k when event_type='purchase' then 'Task' when event_type='signup' then 'Patient/c'||user_id
          else 'Observation?code=k'||k||'&_sort=bogus' end as query,
        case when event_type='error' then 400 when event_type='purchase' then 201 else 200 end as status,
        cast(floor(k/10) as integer) as round, value as bytes,
        (event_type='view' and k%4<>0) or event_type='signup' as shows_patient,
        event_type in ('view','click','purchase') as shows_order,
        case when event_type='view' and k%4<>0 then k%3 end as total from ev0""",
        ("ev0",),
    ),
    "evref": (
        """select episode_id, seq, round, route, method, status, user_id, k, 'Patient/c'||user_id as ref, true as fields_shown from ev where shows_patient
        union all select episode_id, seq, round, route, method, status, user_id, k, 'ServiceRequest/o'||k as ref, route<>'sql' as fields_shown from ev where shows_order""",
        ("ev",),
    ),
    "rollout": (
        """select 'task-'||d.doc_id as task_id, 'pt'||(d.doc_id%50) as patient_id, source as family,
        case when d.doc_id%3=0 then 'CR' else 'R' end as crud, 'dev' as split, cast(n_chars%4+1 as integer) as hops,
        case when n_chars%4=0 then 'easy' when n_chars%4=1 then 'medium' when n_chars%4=2 then 'hard' else 'very_hard' end as bin,
        case when lang='en' then 'raw' else 'assisted' end as tool_profile,
        case when d.doc_id%2=0 then 0 else 10 end as training_step, cast(quality as double) as strict_success,
        cast(toxic as double) as unsafe_attempts, cast(n_chars as double) as response_bytes,
        case when d.doc_id%5=0 then -1.0 else cast(n_chars%97 as double) end as model_total_tokens, d.doc_id
        from documents d join labels l on l.doc_id=d.doc_id""",
        (),
    ),
}


def _need(name: str, seen: list[str]) -> None:
    for dep in PARTS[name][1]:
        _need(dep, seen)
    if name not in seen:
        seen.append(name)


def sql(body: str, *names: str) -> str:
    """A statement with the named subqueries (and what they build on) in front of it."""
    seen: list[str] = []
    for n in names:
        _need(n, seen)
    if not seen:
        return body
    ctes = ",\n".join(f"{n} as ({PARTS[n][0]})" for n in seen)
    text = body.strip()
    if text.lower().startswith("with "):
        return f"with {ctes},\n{text[5:]}"
    return f"with {ctes}\n{text}"
