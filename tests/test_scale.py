"""Work is done once per row, whatever looks at it later."""

import hashlib
import json
import re
from collections import defaultdict

from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions import ranks
from chartloom.operators import changes, checks, edges, scoring, search, tasks
from chartloom.plans import etl, reports
from chartloom.sources.ndjson import from_documents, parsed_once


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counted(spark, df, by="ref"):
    """The rows, and how often one of them was made."""
    seen = spark.sparkContext.accumulator(0)

    def look(_):
        seen.add(1)
        return True

    return df.where(F.udf(look, "boolean").asNondeterministic()(F.col(by))), seen


def test_a_search_parses_each_document_once(spark):
    docs = ['{"resourceType":"Observation","id":"%d","status":"%s","code":{"coding":[{"code":"a"}]}}' % (i, s) for i, s in enumerate(["final", "draft", "final"])]
    r = from_documents(spark.createDataFrame([(d,) for d in docs], "doc string"))
    hits = search.matches(r, "Observation?code=a,b&status=final,amended")
    assert plan(hits).lower().count("parsejson") + plan(hits).lower().count("parse_json") == 1
    assert {x.ref for x in hits.collect()} == {"Observation/0", "Observation/2"}


def test_shape_paths_look_at_a_document_once(spark):
    docs = spark.createDataFrame([("a", '{"k":{"a":[1,{"b":2}]}}'), ("b", '{"k":null,"l":[]}'), ("c", "7")], "ref string, doc string")
    rows, seen = counted(spark, docs)
    found = {r.ref: r.paths for r in D.shape_paths(rows.withColumn("v", F.parse_json("doc"))).collect()}
    assert found == {"a": ["k", "k.a", "k.a[].b"], "b": ["k", "l"], "c": []}
    assert seen.value == 3


FACTS = "ref string, resource_type string, shape string, features array<string>, edges int, side string"


def facts(spark, old=300, new=700):
    rows = [(f"T/{i}", "T", f"s{i % 3}", ["f", f"f{i % 2}"], i % 4, "old" if i < old else "new") for i in range(old + new)]
    return rows + [("C/1", "C", "c", [], 1, "old"), ("C/2", "C", "c", [], 1, "new"), ("L/1", "L", "l", ["x"], 9, "new")]


def test_describe_reads_its_rows_once(spark):
    rows, seen = counted(spark, spark.createDataFrame(facts(spark), FACTS))
    got = {r.resource_type: tuple(r[1:]) for r in reports.describe(rows, ["resource_type"]).select("resource_type", "resources", "distinct_shapes", "nonpatient_reference_edges", "distinct_features").collect()}
    assert got == {"T": (1000, 3, 1500, 3), "C": (2, 1, 2, 0), "L": (1, 1, 9, 1)}
    assert seen.value == 1003


def test_balanced_resample_reads_its_rows_once_and_is_exact(spark):
    data = facts(spark)
    rows, seen = counted(spark, spark.createDataFrame(data, FACTS))
    got = {r.side: r for r in reports.balanced_resample(rows, "side", resamples=7).collect()}
    assert seen.value == len(data)
    edges, features = defaultdict(list), defaultdict(list)
    for b in range(7):
        for side in ("old", "new"):
            drawn = []
            for kind, budget in (("T", 300), ("C", 1)):
                mine = [r for r in data if r[1] == kind and r[5] == side]
                drawn += sorted(mine, key=lambda r: hashlib.md5(f"17|{b}|{r[0]}".encode()).hexdigest())[:budget]
            edges[side].append(sum(r[4] for r in drawn))
            features[side].append(len({f for r in drawn for f in r[3]}))
    for side in ("old", "new"):
        r = got[side]
        assert (r.nonpatient_reference_edges_min, r.nonpatient_reference_edges_max) == (min(edges[side]), max(edges[side]))
        assert r.nonpatient_reference_edges_mean == round(sum(edges[side]) / 7, 2)
        assert (r.distinct_shapes_min, r.distinct_features_max) == (4, max(features[side]))


def test_contract_rules_write_no_schemas(spark):
    docs = [
        '{"resourceType":"T","id":"1","a":[1],"_a":{"x":1},"vString":"s","vInt":2,"who":{"reference":"P/1"}}',
        '{"resourceType":"T","id":"2","_a":{"x":1},"who":{"reference":"Q/1"}}',
        '{"resourceType":"T","id":"3","a":null,"_vInt":{"x":1}}',
    ]
    r = from_documents(spark.createDataFrame([(d,) for d in docs], "doc string"))
    c = spark.createDataFrame(
        [("T", ["a"], 1, "1", ["string"], []), ("T", ["v[x]"], 0, "1", ["string", "int"], []), ("T", ["who"], 1, "1", ["Reference"], ["Q"])],
        "type string, path array<string>, min int, max string, types array<string>, targets array<string>",
    )
    found = checks.root_contract_violations(r, c)
    # No schema is written out only to tell objects from lists.
    assert "schema" not in plan(found).lower()
    assert sorted(tuple(x) for x in found.collect()) == [
        ("T/1", "a", "list_for_scalar"), ("T/1", "v[x]", "cardinality=2"), ("T/1", "v[x]", "multiple_choices"), ("T/1", "who", "target=P/1"),
        ("T/3", "who", "cardinality=0"),
    ]


def test_dependency_depth_walks_a_graph_once(spark):
    graphs = [
        ([("supplied_x", "a"), ("a", "b"), ("b", "c"), ("supplied_x", "c")], 3), ([("supplied_x", "a"), ("a", "b"), ("b", "a")], None),
        ([("supplied_x", "a"), ("b", "c")], None), ([], None), (None, None),
    ]
    rows = [(i, None if g is None else [list(e) for e in g]) for i, (g, _) in enumerate(graphs)]
    df = spark.createDataFrame(rows, "i int, e array<array<string>>").select("i", tasks.dependency_depth(F.col("e")).alias("d"))
    assert plan(df).count("reduce(") + plan(df).count("aggregate(") == 1
    assert {r.i: r.d for r in df.collect()} == {i: d for i, (_, d) in enumerate(graphs)}


def test_conditional_creates_index_a_chart_once(spark):
    docs = [(f"e{i}", f"Task/t{i}", "Task", "Patient/p", '{"resourceType":"Task","id":"t%d","status":"%s","identifier":[{"value":"T-%d"}]}' % (i, s, i)) for i, s in enumerate(["draft", "requested", "draft"])]
    rows, seen = counted(spark, spark.createDataFrame(docs, "episode_id string, ref string, resource_type string, owner string, doc string"))
    chart = rows.withColumn("v", F.parse_json("doc")).drop("doc")
    posts = spark.createDataFrame(
        [("e0", 1, "Task", "identifier=T-0"), ("e1", 1, "Task", "status=draft"), ("e2", 1, "Task", "colour=red"), ("e2", 2, "Task", None)],
        "episode_id string, seq int, url string, if_none_exist string",
    )
    got = {(r.episode_id, r.seq): (r.matches, r.existing, r.bad_condition) for r in changes.conditional_counts(posts, chart).collect()}
    assert got == {("e0", 1): (1, "Task/t0", False), ("e1", 1): (0, None, False), ("e2", 1): (0, None, True)}
    # Once for the index, once to look for medications.
    assert seen.value == 2 * len(docs)


def test_lines_move_once_for_their_number_and_their_order(spark, tmp_path):
    """numbering the copies of a line and joining it with its order share one exchange."""
    from chartloom.plans import charts

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_shipdate timestamp, l_returnflag string, l_linestatus string"
    rows = [(1, 5, 7, 1, 2.0, 3.0, None, "N", "F"), (1, 5, 7, 1, 1.0, 4.0, None, "N", "O"), (1, None, 7, 2, 1.0, 4.0, None, "N", "O"), (2, 5, 7, 1, 1.0, 6.0, None, "R", "F"), (None, 5, 7, 1, 1.0, 1.0, None, "N", "F")]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 11), (2, 12)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, "T")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = charts.observation(spark, str(tmp_path))
        physical = o._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.id, r.patient_ref, r.status) for r in o.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert physical.count("hashpartitioning(l_orderkey") == 1
    assert got == [
        ("1-1-5-7-1", "Patient/c10", "preliminary"), ("1-1-5-7-2", "Patient/c10", "final"),
        ("2-1-5-7-1", "Patient/c11", "entered-in-error"), ("2-1-5-7-1", "Patient/c12", "entered-in-error"),
    ]


def test_owners_are_read_behind_the_written_ends(spark):
    doc = lambda kind, i, **k: json.dumps({"resourceType": kind, "id": i, **k})
    me, you = {"reference": "Patient/p"}, {"reference": "Patient/q"}
    base = [("Patient/p", doc("Patient", "p")), ("Patient/q", doc("Patient", "q")), ("Task/t", doc("Task", "t", **{"for": me})), ("Task/u", doc("Task", "u", focus={"reference": "Task/t"}, **{"for": you}))]
    current = spark.createDataFrame([(e, *d) for e in ("e", "f") for d in base], "episode_id string, ref string, doc string")
    written = [("e", "Task/t", doc("Task", "t", **{"for": me})), ("f", "Task/t", None), ("f", "Task/v", doc("Task", "v", focus={"reference": "Task/u"}, **{"for": you}))]
    final = spark.createDataFrame(written, "episode_id string, ref string, doc string")
    found = changes.post_state_violations(changes._Charts(current), final)
    assert {tuple(r) for r in found.collect()} == {("e", "cross_patient_reference"), ("f", "broken_reference")}
    # No filter makes an owner, or a document, a second time.
    filters = [line for line in plan(found).splitlines() if re.match(r"[\s:+|-]*Filter", line)]
    assert filters and not any("parse" in line.lower() for line in filters)


def test_a_document_is_put_together_once(spark):
    """What is put into a document is made once, not once for each of its fields."""
    docs = spark.createDataFrame([('{"id":"a","k":1,"l":2,"m":null}', 3), ("[1]", 1), (None, 1)], "doc string, n int")
    new = F.create_map(F.lit("k"), F.sha2(F.col("n").cast("string"), 256))
    put = docs.select(D.with_fields(F.parse_json("doc"), new).alias("d"))
    digest = hashlib.sha256(b"3").hexdigest()
    assert [r.d for r in put.collect()] == ['{"id":"a","k":%s,"l":2,"m":null}' % digest, None, None]
    assert plan(put).count("sha2(") == 1
    stamped = docs.select(D.with_version(F.parse_json("doc"), F.col("n")).alias("d"))
    assert [r.d for r in stamped.collect()] == ['{"id":"a","k":1,"l":2,"m":null,"meta":{"versionId":"3"}}', None, None]


def test_slots_are_compared_without_their_digests(spark):
    rows = [('{"id":"s","status":"busy","n":1.0}', '{"n":1,"status":"free","id":"s","meta":{"versionId":"2"}}', False), ('{"id":"s","n":1}', '{"id":"s","n":2}', True), ('{"id":"s"}', '{"id":"s","n":null}', True), ("[1]", "{}", None)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select(changes._slot_changed(F.parse_json("a"), F.parse_json("b")).alias("got"), "want")
    assert all(r.got == r.want for r in got.collect())
    assert "sha2" not in plan(got).lower()


def test_what_is_parsed_once_shares_its_parts(spark):
    docs = spark.createDataFrame([('{"a":{"b":1}}',)], "doc string")
    v = F.parse_json("doc")
    both = parsed_once(docs, F.struct(D.text(v, "a.b").alias("x"), D.text(v, "a.b").alias("y")), "found")
    assert both.first().found == ("1", "1")
    # Made by a projection, where an expression that is named twice is made once, below the generator.
    assert not any("parse" in line.lower() for line in plan(both).splitlines() if "Generate" in line)


def broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_offsets_of_many_groups_are_not_sent_to_every_task(spark):
    rows = spark.range(40).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), (F.col("id") * 7 % 40).alias("x"))
    got = ranks.ranked(rows, ["g"], F.floor(F.col("x") / 8), [F.col("x")], "n")
    total = ranks.running_total(rows, ["g"], F.floor(F.col("x") / 8), [F.col("x")], F.lit(1), "n")
    ranged = ranks.range_ranked(rows, ["g"], [F.col("x")], "n")
    want = {(r.g, r.x, r.n) for r in rows.withColumn("n", F.expr("row_number() over (partition by g order by x)")).collect()}
    for df in (got, total, ranged):
        assert {(r.g, r.x, r.n) for r in df.select("g", "x", "n").collect()} == want
        assert not broadcasts(df)


def test_queries_of_a_batch_are_not_sent_to_every_task(spark):
    docs = ['{"resourceType":"Observation","id":"%d","status":"final","subject":{"reference":"Patient/%d"},"effectiveDateTime":"2024-01-%02d"}' % (i, i % 3, i + 1) for i in range(9)]
    docs += ['{"resourceType":"Patient","id":"%d","identifier":[{"value":"M%d"}]}' % (i, i) for i in range(3)]
    r = from_documents(spark.createDataFrame([(d,) for d in docs], "doc string"))
    urls = spark.createDataFrame([(f"q{i}", f"Observation?{p}&_sort=-date&_count=2") for i, p in enumerate(["patient=0", "patient.identifier=M1", "status=draft"])], "query_id string, url string")
    found = search.batch_search(urls, r)
    assert {(x.query_id, x.ref, x.page_pos, x.total) for x in found.collect()} == {("q0", "Observation/6", 1, 3), ("q0", "Observation/3", 2, 3), ("q1", "Observation/7", 1, 3), ("q1", "Observation/4", 2, 3)}
    hits = search.batch_matches(urls, search.search_index(r))
    assert hits.count() == 6 and not broadcasts(hits)
    pages = search.chart_timeline(r, ["Observation"], per_type=2)
    assert not broadcasts(pages) and not broadcasts(search.timeline_entries(pages, r))


def test_counters_of_many_episodes_are_not_sent_to_every_task(spark):
    some = lambda *cols: spark.range(2).select(*[F.expr(c) for c in cols])
    e = "concat('e', id) as episode_id"
    outcomes = some(e, "'1' as unit", "1 as seq", "if(id = 0, 403, 200) as status")
    got = scoring.agent_counters(some(e), some(e), some(e, "id as bytes").where("bytes > 0"), outcomes, some(e).where("episode_id = 'e1'"))
    assert {tuple(r) for r in got.select("episode_id", "agent_tool_calls", "helper_calls", "unsafe_attempts", "committed_mutations").collect()} == {("e0", 1, 0, 1, 0), ("e1", 1, 1, 0, 1)}
    assert not broadcasts(got)


def test_slots_ends_and_lineage_are_not_sent_to_every_task(spark):
    n = lambda *cols: spark.range(4).select(*[F.expr(c) for c in cols])
    slots = n("concat('s', id) as resource_ref", "if(id = 0, 'free', 'busy') as status", "'1' as start", "'2' as end", "id = 1 as overbooked")
    appts = n("concat('a', id) as resource_ref", "'booked' as status", "'1' as start", "'2' as end", "concat('s', id) as slot_ref")
    loose, twice = checks.slot_containment(appts, slots), checks.double_booking(appts.unionByName(appts), slots)
    assert loose.count() == 1 and twice.count() == 3
    edge = n("concat('x', id) as src_ref", "if(id = 1, 'p', 'q') as src_owner", "concat('d', id) as dst_ref")
    broken = edges.broken_refs(edge, n("concat('d', id) as ref").where("ref <> 'd3'"))
    crossed = edges.cross_patient_refs(edge, n("concat('d', id) as ref", "'q' as patient_ref"))
    assert [r.dst_ref for r in broken.collect()] == ["d3"] and [r.dst_ref for r in crossed.collect()] == ["d1"]
    use = n("""concat('{"resourceType":"DeviceUseStatement","id":"', id, '","basedOn":{"reference":"DeviceRequest/1"}}') as doc""")
    lineage = n("""concat('{"resourceType":"Provenance","id":"', id, '","target":[{"reference":"DeviceUseStatement/', id, '"}]}') as doc""").where("doc not like '%Statement/3%'")
    docs, repairs = etl.repair_device_links(from_documents(use.unionByName(lineage)))
    assert docs.count() == 6 and {r.repair: r.n for r in repairs.groupBy("repair").agg(F.count(F.lit(1)).alias("n")).collect()} == {"device_order_link_in_provenance": 3, "no_lineage": 1}
    assert not any(broadcasts(df) for df in (loose, twice, broken, crossed, docs))


def test_conditional_creates_index_what_they_ask_for(spark, monkeypatch):
    doc = lambda kind, i, **k: json.dumps({"resourceType": kind, "id": i, **k})
    code = lambda c: {"coding": [{"code": c}]}
    me = {"subject": {"reference": "Patient/p"}}
    base = [
        ("Patient/p", doc("Patient", "p", identifier=[{"value": "M1"}])), ("Slot/s", doc("Slot", "s", status="a")), ("Medication/m", doc("Medication", "m", code=code("x"))),
        ("MedicationRequest/r", doc("MedicationRequest", "r", status="a", medicationReference={"reference": "Medication/m"}, **me)), ("MedicationRequest/q", doc("MedicationRequest", "q", status="b", **me)),
    ]
    chart = changes._chart(spark.createDataFrame([("e", *d) for d in base], "episode_id string, ref string, doc string"))
    conditions = ["code=x", "patient.identifier=M1&status=a,b", "status=c", "colour=red", "status=b"]
    posts = spark.createDataFrame([("e", i, "MedicationRequest", c) for i, c in enumerate(conditions)], "episode_id string, seq int, url string, if_none_exist string")
    seen, keep = [], search.search_index
    monkeypatch.setattr(search, "search_index", lambda *a: seen.append(a) or keep(*a))
    got = {r.seq: (r.matches, r.existing, r.bad_condition) for r in changes.conditional_counts(posts, chart).collect()}
    assert got == {0: (1, "MedicationRequest/r", False), 1: (2, "MedicationRequest/q", False), 2: (0, None, False), 3: (0, None, True), 4: (1, "MedicationRequest/q", False)}
    rows, _, asked = seen[0]
    assert {r.ref for r in rows.collect()} == {ref for ref, _ in base} - {"Slot/s"} and asked == {"code", "identifier", "patient", "status"}
