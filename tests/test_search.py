import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.functions import ranks
from chartloom.operators import search
from chartloom.sources.ndjson import from_documents

CODE = "http://loinc.org"


def concept(code, system=CODE):
    return {"coding": [{"system": system, "code": code}]}


CHART = [
    {"resourceType": "Patient", "id": "p1", "identifier": [{"system": "mrn", "value": "M1"}], "name": [{"text": "Jo Lee"}], "birthDate": "1980-01-01"},
    {"resourceType": "Patient", "id": "p2", "identifier": [{"system": "mrn", "value": "M2"}], "name": [{"text": "Jo Lee"}], "birthDate": "1990-01-01"},
    *[
        {"resourceType": "Observation", "id": f"o{i}", "status": s, "code": concept("718-7"), "subject": {"reference": p}, **({"effectiveDateTime": d} if d else {}), "basedOn": [{"reference": "ServiceRequest/s1"}]}
        for i, (s, p, d) in enumerate([("final", "Patient/p1", "2024-01-02T10:00:00Z"), ("final", "Patient/p1", "2024-01-02T08:00:00Z"), ("preliminary", "Patient/p1", "2024-02-01"), ("final", "Patient/p2", ""), ("entered-in-error", "Patient/p2", "2024-03-01")])
    ],
    {"resourceType": "ServiceRequest", "id": "s1", "status": "completed", "subject": {"reference": "Patient/p1"}},
    {"resourceType": "DiagnosticReport", "id": "r1", "status": "final", "subject": {"reference": "Patient/p1"}, "result": [{"reference": "Observation/o0"}, {"reference": "Observation/o1"}, {"reference": "Observation/gone"}], "basedOn": {"reference": "ServiceRequest/s1"}},
    {"resourceType": "Medication", "id": "m1", "code": concept("aspirin")},
    {"resourceType": "MedicationRequest", "id": "q1", "status": "active", "subject": {"reference": "Patient/p1"}, "medicationReference": {"reference": "Medication/m1"}, "medicationCodeableConcept": concept("inline")},
    {"resourceType": "MedicationRequest", "id": "q2", "status": "active", "subject": {"reference": "Patient/p1"}, "medicationReference": {"reference": "Medication/none"}, "medicationCodeableConcept": concept("inline")},
    {"resourceType": "Appointment", "id": "a1", "status": "booked", "participant": [{"actor": {"reference": "Patient/p1"}}], "slot": [{"reference": "Slot/x"}]},
    {"resourceType": "QuestionnaireResponse", "id": "qr", "status": "completed", "identifier": {"value": "scalar"}},
    {"resourceType": "HealthcareService", "id": "h1", "providedBy": {"reference": "Organization/g1"}, "active": True},
]


@pytest.fixture(scope="module")
def chart(spark):
    return from_documents(spark.createDataFrame([(json.dumps(d),) for d in CHART], "doc string")).cache()


CASES = [
    ("Observation?patient=p1&status=final", ["o0", "o1"]),
    ("Observation?patient=Patient/p1&status=final,preliminary&date=ge2024-01-15", ["o2"]),
    ("Observation?date=ne2024-01-02", ["o2", "o4"]),
    ("Observation?date=2024-01-02&_sort=-date", ["o0", "o1"]),
    ("Observation?code=http://loinc.org|718-7&status=final", ["o0", "o1", "o3"]),
    ("Observation?code=other|718-7", []),
    ("Observation?patient.identifier=mrn|M2", ["o3", "o4"]),
    ("Observation?status=final&status=preliminary", []),
    ("Observation?date:missing=true&status=final", ["o0", "o1", "o3"]),
    ("DiagnosticReport?based-on=s1", ["r1"]),
    ("DiagnosticReport?based-on=ServiceRequest/s1&code:missing=true", ["r1"]),
    ("MedicationRequest?code=aspirin", ["q1"]),
    ("MedicationRequest?code=inline", ["q2"]),
    ("Appointment?patient=p1", ["a1"]),
    ("QuestionnaireResponse?identifier=scalar", ["qr"]),
    ("HealthcareService?organization=g1&active=true", ["h1"]),
    ("Patient?name=jo%20L&birthdate=gt1985-01-01", ["p2"]),
    ("Patient?_id=p1", ["p1"]),
]


def test_single_and_batch_search_agree(spark, chart):
    queries = spark.createDataFrame([(u, u) for u, _ in CASES], "query_id string, url string")
    index = search.search_index(chart)
    batch = {}
    for r in search.batch_matches(queries, index).collect():
        batch.setdefault(r.query_id, []).append(r.id)
    for url, want in CASES:
        assert [r.id for r in search.search(chart, url).collect()] == want, url
        assert sorted(batch.get(url, [])) == sorted(want), url


def test_include_follows_the_page_and_drops_missing_targets(spark, chart):
    url = "DiagnosticReport?patient=p1&_include=DiagnosticReport:result&_include=DiagnosticReport:based-on"
    rows = search.search(chart, url).collect()
    want = {("DiagnosticReport/r1", "match"), ("Observation/o0", "include"), ("Observation/o1", "include"), ("ServiceRequest/s1", "include")}
    assert {(r.ref, r["mode"]) for r in rows} == want
    q = spark.createDataFrame([("q", url)], "query_id string, url string")
    assert {(r.ref, r["mode"]) for r in search.batch_search(q, chart).collect()} == want


def test_paging_total_and_next(spark, chart):
    rows = search.search(chart, "Observation?_count=2&_page=1&_sort=-_id&status=final,preliminary,entered-in-error").collect()
    assert [r.id for r in rows] == ["o2", "o1"] and rows[0].total == 5 and "_page=2" in rows[0].next_page


@pytest.mark.parametrize("url", ["Nothing?x=1", "Task?colour=red", "Task?status:exact=x", "Observation?date=2024-01", "Task?_count=0", "Task?_sort=name", "Task?_include=Coverage:payor", "Organization?patient.identifier=1"])
def test_unknown_queries_are_refused(spark, chart, url):
    with pytest.raises(search.SearchError):
        search.search(chart, url)
    q = spark.createDataFrame([("q", url)], "query_id string, url string")
    # A chain on a type without patients is an unknown parameter of the batch form.
    assert search.read_queries(q).first().error


def test_deep_pages_use_two_level_ranks(spark, chart):
    q = spark.createDataFrame([("a", "Observation?_count=2&_page=0&_sort=-date"), ("b", "Observation?_count=1&_page=2&_sort=date"), ("c", "Task?_count=50&_page=30")], "query_id string, url string")
    got = {(r.query_id, r.page_pos): r.ref for r in search.batch_search(q, chart).collect()}
    assert got == {("a", 1): "Observation/o4", ("a", 2): "Observation/o2", ("b", 1): "Observation/o0"}


def test_dates_and_names_are_looked_up(spark, monkeypatch):
    """Ranges of dates and pieces of names against the single form, with posting lists cut into many salts."""
    random = np.random.default_rng(3)
    days = ["", "2023", "2023-07", "not a date", *(f"{y}-{m:02d}-{d:02d}" for y in (1899, 1999, 2000, 2023, 2024) for m in (1, 2, 7, 12) for d in (1, 15, 28, 31) if (m, d) != (2, 31))]
    docs = [{"resourceType": "Observation", "id": f"o{i}", "status": "final", **({"effectiveDateTime": d} if d else {})} for i, d in enumerate(days)]
    names = ["Jo Lee", "Joanna Leeds", "al", "x", "", "O'Brien", "Lee Jo"]
    docs += [{"resourceType": "Patient", "id": f"p{i}", "name": [{"text": n}], "birthDate": d} for i, n in enumerate(names) for d in [days[i * 7 % len(days)]]]
    table = from_documents(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")).cache()
    urls = ["Observation?date=ge1999-12-31&date=lt2023-07-15", "Observation?date=2023-07-01,2024-12-31", "Observation?date=ne2023-07-01&date=le2024-01-01", "Observation?date=gt2024-02-30", "Observation?date=le1899-01-15", "Observation?date=ge2024-01-01&date=le2023-01-01"]
    urls += [f"Observation?date={a}{random.choice(days[5:])}&date={b}{random.choice(days[5:])}" for a in ("ge", "gt", "") for b in ("le", "lt", "ne")]
    urls += ["Patient?name=lee", "Patient?name=LE", "Patient?name=o", "Patient?name=x,jo%20l", "Patient?name=zzz", "Patient?name=o'b", "Patient?name=e&birthdate=ge1999-01-01", "Patient?birthdate:missing=false&name=jo"]
    monkeypatch.setattr(search, "SALT_ROWS", 3)
    found = {}
    for r in search.batch_matches(spark.createDataFrame([(u, u) for u in urls], "query_id string, url string"), search.search_index(table)).collect():
        found.setdefault(r.query_id, []).append(r.id)
    for u in urls:
        assert sorted(found.get(u, [])) == sorted(r.id for r in search.matches(table, u).collect()), u
    # The chosen lists are short: a month for days in it, three letters for a name.
    q = search.read_queries(spark.createDataFrame([("a", "Observation?date=ge2023-07-01&date=le2023-07-31")], "query_id string, url string")).withColumnRenamed("kind", "resource_type")
    codes = {r.code for r in search._lookups(q, spark.createDataFrame([], "query_id string, chain_ref string"), []).where("n = 10000").collect()}
    assert {"d2023-07-01", "d2023-07-31", "d2023-07", "d2023", "x"} <= codes and len(codes) <= 40


def test_ranges_rank_repeated_keys(spark):
    """A key held by a third of the rows, and keys that share a long prefix."""
    rows = [("g", "same" if i % 3 == 0 else "p" * 600 + str(i % 40), i) for i in range(600)] + [(None, "x", 1000), ("h", None, 1001)]
    df = spark.createDataFrame(rows, "g string, k string, i int").repartition(4)
    got = ranks.range_ranked(df, ["g"], [F.col("k"), F.col("i")], "n").collect()
    for g in ("g", "h", None):
        mine = sorted(((r[1] is not None, r[1] or "", r[2]) for r in rows if r[0] == g))
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == [i for _, _, i in mine]
        assert sorted(r.n for r in got if r.g == g) == list(range(1, len(mine) + 1))
    total = {r.i: r.upto for r in ranks.range_running(df.where("g = 'g'"), ["g"], [F.col("k"), F.col("i")], F.col("i").cast("bigint"), "upto").collect()}
    upto = 0
    for _, k, i in sorted((r for r in rows if r[0] == "g"), key=lambda r: (r[1], r[2])):
        upto += i
        assert total[i] == upto


def test_timeline_entries_show_their_documents(spark):
    p = {"reference": "Patient/1"}
    docs = [
        {"resourceType": "Task", "id": "b", "status": "draft", "for": p, "description": "call \"back\""},
        {"resourceType": "Procedure", "id": "a", "subject": p, "performedDateTime": "2024-02-01", "code": {"text": "x"}, "meta": {"tag": [{"code": "t"}]}},
        {"resourceType": "Procedure", "id": "c", "status": "done", "subject": p, "performedDateTime": "2024-01-01"},
    ]
    r = from_documents(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"))
    pages = search.chart_timeline(r, ["Task", "Procedure"])
    got = {x.position: (x.ref, x.status, json.loads(x.label), json.loads(x.origin)) for x in search.timeline_entries(pages, r).collect()}
    assert got == {
        1: ("Task/b", "draft", "call \"back\"", []),
        2: ("Procedure/c", "done", {}, []),
        3: ("Procedure/a", None, {"text": "x"}, [{"code": "t"}]),
    }
    assert search.timeline_entries(search.chart_timeline(r.limit(0), ["Task"]), r).isEmpty()


def test_equal_identity_requests_are_looked_up_once(spark, monkeypatch):
    people = spark.createDataFrame([("Patient/1", "M1", "Ann Lee", "1950-01-01"), ("Patient/2", "M2", "Anna Orr", "1950-01-01"), ("Patient/3", "M3", "Bob", "1960-01-01")], "resource_ref string, identifier string, name string, birth_date string")
    rows = [(f"r{i}", None, "ann", None) for i in range(50)]
    # One id with two wishes that share a candidate, one named twice, one without a name, one that wants nothing.
    rows += [("two", None, "ann", None), ("two", None, "ANN,bob", None), ("again", "x|M3", None, None), ("again", "x|M3", None, None), (None, None, "ann", None), ("none", None, None, None)]
    requests = spark.createDataFrame(rows, "request_id string, identifier string, name string, birthdate string")
    looked, by_name = [], search._by_name
    monkeypatch.setattr(search, "_by_name", lambda r, p: looked.append(r.count()) or by_name(r, p))
    got = [(r.request_id, r.candidates, r.resolution) for r in search.find_patient(requests, people).collect()]
    assert looked == [2] and len(got) == len(rows)
    assert set(got) == {(f"r{i}", 2, "ambiguous") for i in range(50)} | {("two", 3, "ambiguous"), ("again", 1, "unique"), (None, 0, "not_found"), ("none", 0, "not_found")}
