import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions import ranks
from chartloom.functions import text as X


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def doc(spark, body):
    return spark.createDataFrame([(json.dumps(body),)], "doc string").withColumn("v", F.parse_json("doc"))


def test_references_keep_order_and_ignore_quoted_text(spark):
    body = {"a": {"reference": "A/1"}, "b": [{"reference": "B/1"}, {"reference": "A/1"}], "t": 'say "reference":"C/1"', "reference": 5}
    assert doc(spark, body).select(D.references(F.col("doc"))).first()[0] == ["A/1", "B/1", "A/1"]


def test_long_strings_do_not_overflow_the_patterns(spark):
    body = {"resourceType": "X", "id": "1", "text": "a\\\"" * 200000, "n": 1.0, "subject": {"reference": "Patient/1"}}
    row = doc(spark, body).select(D.canonical(F.col("v")).alias("c"), D.patient_ref(F.col("v")).alias("p")).first()
    assert json.loads(row.c)["n"] == 1 and row.p == "Patient/1"


@pytest.mark.parametrize(
    "body, date",
    [({"issued": "2024-02-01", "date": "2020"}, "2024-02-01"), ({"effectiveDateTime": "", "sent": "2021"}, "2021"), ({"period": {"start": "2019-01-01"}}, "2019-01-01"), ({}, "")],
)
def test_resource_date(spark, body, date):
    assert doc(spark, body).select(D.resource_date(F.col("v"))).first()[0] == date


def test_several_owners_have_no_single_owner(spark):
    body = {"resourceType": "Task", "id": "1", "for": {"reference": "Patient/1"}, "subject": {"reference": "Patient/2"}}
    row = doc(spark, body).select(D.owners(F.col("v")).alias("o"), D.patient_ref(F.col("v")).alias("p")).first()
    assert sorted(row.o) == ["Patient/1", "Patient/2"] and row.p is None


@pytest.mark.parametrize("needle, hit", [("718-7", True), ("http://loinc.org|718-7", True), ("|718-7", True), ("other|718-7", False), ("718", False)])
def test_token_match_on_concepts(spark, needle, hit):
    body = {"code": {"coding": [{"system": "http://loinc.org", "code": "718-7"}]}}
    assert doc(spark, body).select(D.token_match(D.tokens_at(F.col("v"), "code"), needle)).first()[0] is hit


def test_token_match_on_plain_values(spark):
    d = doc(spark, {"status": "final", "active": True})
    row = d.select(
        D.token_match(D.tokens_at(F.col("v"), "status"), "final").alias("a"), D.token_match(D.tokens_at(F.col("v"), "status"), "|final").alias("b"),
        D.token_match(D.tokens_at(F.col("v"), "active"), "true").alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (True, False, True)


@pytest.mark.parametrize("value, gone", [([], True), ("", True), (0, True), (False, True), (None, True), ({}, True), ("x", False), ([0], False)])
def test_missing_is_json_falsy(spark, value, gone):
    assert doc(spark, {"f": value}).select(D.falsy(F.col("v"), "f")).first()[0] is gone


def test_canonical_compares_numbers_but_not_booleans(spark):
    c = lambda s: one(spark, D.canonical(F.parse_json(F.lit(s))))
    assert c('{"a":1.0,"b":"2.0,"}') == c('{"b":"2.0,","a":1}')
    assert c('{"a":true}') != c('{"a":1}')
    assert c("[1,2]") != c("[2,1]")


@pytest.mark.parametrize(
    "text, strict, fenced",
    [('{"answer":1,"evidence":[]}', True, True), ('```json\n{"answer":1,"evidence":[]}\n```', False, True), ('x {"answer":1,"evidence":[]}', False, False),
     ('{"answer":1,"answer":2,"evidence":[]}', False, False), ('{"answer":NaN,"evidence":[]}', False, False), ("[1]", False, False),
     ('{"answer":1,"evidence":[]} {}', False, False), ('{"answer":"}{","evidence":[]}', True, True)],
)
def test_final_answers(spark, text, strict, fenced):
    row = spark.createDataFrame([(text,)], "s string").select(X.is_final(F.col("s")).alias("a"), X.is_final(F.col("s"), True).alias("b")).first()
    assert (row.a, row.b) == (strict, fenced)


def test_remap_changes_values_only(spark):
    m = F.create_map(F.lit("A/1"), F.lit("B$2"))
    out = one(spark, D.remap(F.lit('{"A/1":"x","r":["A/1","A/12"],"t":"see A/1"}'), m))
    assert json.loads(out) == {"A/1": "x", "r": ["B$2", "A/12"], "t": "see A/1"}


def test_ranked_equals_one_global_sort(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(5)}", rng.randrange(1000), i) for i in range(3000)] + [(None, 7, 9000)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    got = {(r.g, r.i): r.seq for r in ranks.ranked(df, ["g"], F.floor(F.col("x") / 50), [F.col("x"), F.col("i")]).collect()}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            assert got[(g, r[2])] == n
    assert len(got) == len(rows)


def test_order_statistics_and_median(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice([0.0, 0.0, rng.random() * 100, 1e9])) for g in ("a", "b") for _ in range(rng.randrange(50, 80))] + [("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    q = {r.g: r for r in ranks.order_statistics(df, ["g"], "x", {"p25": ranks.at_fraction(0.25), "p75": ranks.at_fraction(0.75)}).collect()}
    m = {r.g: r["median"] for r in ranks.median_of(df, ["g"], "x").collect()}
    for g in "abc":
        values = sorted(x for k, x in rows if k == g)
        assert q[g].p25 == values[round((len(values) - 1) * 0.25)] and q[g].p75 == values[round((len(values) - 1) * 0.75)]
        assert m[g] == pytest.approx(statistics.median(values))
