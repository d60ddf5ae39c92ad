"""Work grows no faster than the rows: round 3's projections."""

import pytest
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.operators import scoring, search
from chartloom.plans import reports
from chartloom.sources.ndjson import from_documents


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counted(spark, df, by="ref"):
    """The rows, and how often one of them was made."""
    seen = spark.sparkContext.accumulator(0)

    def look(_):
        seen.add(1)
        return True

    return df.where(F.udf(look, "boolean").asNondeterministic()(F.col(by))), seen


@pytest.mark.parametrize("common", [1, 20_000])
def test_texts_are_dealt_by_their_start(spark, monkeypatch, common):
    """the driver's sample holds starts of texts, and whole texts only of a start that very many share."""
    texts = ["x" * 100 + t for t in "badc"] + ["short", "x" * 64, "x" * 63, "é" * 70, "same", "same"] + [f"{i:03d} line" for i in range(30)]
    rows = spark.createDataFrame([("g" if i % 2 else "h", f"D/{i}", t) for i, t in enumerate(texts)], "patient_ref string, ref string, doc string")
    dealt = []
    ranked = reports.range_running

    def look(df, by, order, value, out, deal):
        dealt.extend(df.select(*[c.alias(f"k{n}") for n, c in enumerate(deal)]).collect())
        return ranked(df, by, order, value, out, deal)

    monkeypatch.setattr(reports, "range_running", look)
    monkeypatch.setattr(reports, "COMMON_START", common)
    got = reports.patient_context(rows, 100).orderBy("patient_ref", "part").collect()
    for g in "gh":
        assert "\n".join(r.context for r in got if r.patient_ref == g) == "\n".join(sorted(t for i, t in enumerate(texts) if ("g" if i % 2 else "h") == g))
    assert len(dealt) == len(texts) and any(len(k.k0) > 64 for k in dealt) == (common == 1)
    assert len(got) > 2


def test_flags_and_owners_are_looked_up_in_one_pass(spark):
    """F32, F40: no path is looked up by itself, and a plain owner is not written out as JSON."""
    docs = [
        ('{"resourceType":"Observation","id":"1","status":"corrected","basedOn":[],"component":null,"subject":{"reference":"Patient/a"},"identifier":[1,2]}',
         ["Observation.basedOn", "Observation.component", "Observation.corrected", "multiple_identifiers"], "Patient/a", ""),
        ('{"resourceType":"MedicationDispense","id":"2","whenPrepared":"x","result":1,"for":{"reference":"Patient/b"},"subject":{"reference":"Patient/a"}}',
         ["MedicationDispense.prepared_without_handover", "MedicationDispense.result"], None, ""),
        ('{"resourceType":"Appointment","id":"3","participant":[{"actor":{"reference":"Patient/a"}},{"actor":{"reference":"Group/a"}}],"issued":"","period":{"start":"1999"}}', [], "Patient/a", "1999"),
        ('{"resourceType":"Patient","id":"4","subject":{"reference":"Patient/a"},"date":"1998","sent":"1997"}', [], "Patient/4", "1998"),
        ('{"resourceType":"CoverageEligibilityResponse","id":"5","insurance":[{"inforce":true},{"benefitPeriod":{}}],"patient":"\\"reference\\":\\"Patient/a\\""}',
         ["Eligibility.benefitPeriod_false", "Eligibility.benefitPeriod_true", "Eligibility.inforce_none", "Eligibility.inforce_true"], None, ""),
        ('{"resourceType":"Task","id":"6","for":{"reference":"Patient/a","also":{"reference":"Patient/a"}},"patient":{"reference":"Patient/\\"b"},"period":"1999"}', [], None, ""),
        ("7", [], None, ""),
    ]
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(docs)], "i int, doc string").select("i", F.explode(F.array(F.parse_json("doc"))).alias("v"))
    v = F.col("v")
    out = df.select("i", D.feature_flags(v).alias("flags"), D.patient_ref(v).alias("owner"), D.resource_date(v).alias("date"))
    assert {r.i: (r.flags, r.owner, r.date) for r in out.collect()} == {i: d[1:] for i, d in enumerate(docs)}
    assert not any(p in plan(out) for p in ("$.basedOn", "$.subject", "$.issued", "map_filter("))


def test_states_are_stripped_once(spark):
    """both prints of a final document come from the same stripped fields, each written as JSON once."""
    state = lambda rows: spark.createDataFrame(rows, "episode_id string, ref string, doc string").select("episode_id", "ref", F.parse_json("doc").alias("v"))
    doc = '{"resourceType":"Task","id":"a","meta":{"versionId":"%d"},"status":"%s","n":%s}'
    initial = state([("e", "Task/a", doc % (1, "draft", "1")), ("e", "Task/b", doc % (1, "draft", "1.0"))])
    final = state([("e", "Task/a", doc % (2, "failed", "1")), ("e", "Task/b", doc % (3, "draft", "1")), ("e", "Task/new", '{"id":"n","resourceType":"Task","meta":{"versionId":"1"}}')])
    updates = spark.createDataFrame([("e", "Task/a", "status", '"done"')], "episode_id string, ref string, field string, value string")
    creates = spark.createDataFrame([("e", '{"resourceType":"Task"}')], "episode_id string, body string")
    deletes = spark.createDataFrame([], "episode_id string, ref string")
    found = scoring.state_delta(initial, final, updates, creates, deletes)
    assert [tuple(r) for r in found.collect()] == [("e", "Task/a", "changed")]
    one = state([("e", "Task/a", doc % (1, "draft", "1"))]).select(D.canonical(F.col("v")).alias("c"))
    assert plan(one).count("StructsToJsonEvaluator(") == 1


def chart(spark):
    docs = [
        '{"resourceType":"Task","id":"t%d","status":"%s","focus":{"reference":"ServiceRequest/o%d"},"for":{"reference":"Patient/p%d"}}' % (i, s, i % 3, i % 2)
        for i, s in enumerate(["draft", "done", "draft", "", "done"])
    ]
    docs += ['{"resourceType":"Patient","id":"p%d","birthDate":"19%d0-01-01","name":[{"text":"Ann %d"}],"identifier":[{"value":"M-%d"}]}' % (i, i + 5, i, i) for i in range(2)]
    return from_documents(spark.createDataFrame([(d,) for d in docs], "doc string"))


@pytest.mark.parametrize(
    "url, empty",
    [
        ("Task?patient=p0&status=draft", {"targets", "names", "present"}), ("Task?focus=ServiceRequest/o1", {"tokens", "names", "present"}),
        ("Task?status:missing=true", {"tokens", "targets", "names"}), ("Task?patient.identifier=M-1", {"targets", "names", "present"}),
        ("Patient?name=ann%201", {"tokens", "targets", "present"}), ("Patient?birthdate=lt1955-01-01", {"tokens", "targets", "names", "present"}),
        ("Task?_id=t4", {"tokens", "targets", "names", "present"}),
    ],
)
def test_an_index_holds_what_is_asked(spark, url, empty):
    """lists that no query looks at are not made, and the matches are those of the whole index."""
    r = chart(spark)
    parsed = search.read_queries(spark.createDataFrame([("q", url)], "query_id string, url string"))
    index = search.search_index(r, asked=search.fields_asked(parsed))
    made = index.select(*[F.sum(F.size(c)).alias(c) for c in ("tokens", "targets", "names", "present")]).first()
    assert {c for c in made.asDict() if not made[c]} == empty
    refs = lambda i: sorted(x.ref for x in search.batch_matches(parsed, i).collect())
    assert refs(index) == refs(search.search_index(r)) == sorted(x.ref for x in search.matches(r, url).collect()) != []


def test_exploded_tokens_are_made_once(spark):
    """the filter that Spark infers from an explode does not make the list again."""
    used = search.search_index(chart(spark)).select(F.explode("tokens").alias("t"))
    assert not any("Filter" in line and "transform(" in line for line in plan(used).splitlines())
    assert {r.t.code for r in used.collect()} == {"draft", "done", "", "M-0", "M-1"}


def test_a_timeline_reads_its_rows_once(spark):
    """the cuts of the ranges, the ranges and the counts share one narrow copy."""
    rows, seen = counted(spark, chart(spark))
    got = search.chart_timeline(rows, ["Task"], per_type=2).collect()
    assert {(r.ref, r.page, r.continued) for r in got if r.patient_ref == "Patient/p0"} == {("Task/t0", 1, True), ("Task/t2", 1, True), ("Task/t4", 2, False)}
    assert seen.value == 7
