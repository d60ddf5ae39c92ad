import json
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.operators import behavior, changes, checks, scoring, traces, windows
from chartloom.plans import etl, reports
from chartloom.session import ensure_checkpoint_dir
from chartloom.sources import files, ndjson, relational, sinks
from chartloom.streaming import episodes as Z


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="chartloom-test-")


def test_bad_lines_are_set_aside_and_order_is_kept(spark, folder):
    lines = ['{"resourceType":"Task","id":"b"}', "", "not json", '{"resourceType":"Task"}', '{"resourceType":"Task","id":"a"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder + "/in")
    good, bad = ndjson.read_resources(spark, folder + "/in")
    assert [r.id for r in good.orderBy("pos").collect()] == ["b", "a"] and bad.count() == 2


def test_shards_round_trip_with_omitted_refs(spark, folder):
    docs = spark.createDataFrame([("dev", f"{i // 2:04d}", json.dumps({"resourceType": "Task", "id": f"t{i}", "note": "é"})) for i in range(6)], "split string, shard string, doc string")
    sinks.write_sharded(docs, folder + "/out")
    omit = spark.createDataFrame([("Task/t1",)], "ref string")
    got = ndjson.read_shards(spark, folder + "/out", "dev", ["0000", "0001"], omit)
    assert sorted(r.id for r in got.collect()) == ["t0", "t2", "t3"]


def test_episodes_with_problems_become_warnings(spark, folder):
    trace = {"version": 1, "ok": True, "errors": [], "nodes": [], "calls": [], "metrics": {"strict_success": 1.0}}
    rows = [{"id": "a", "task": {"key": "t"}, "traces": [trace]}, {"id": "b", "task": {}, "traces": [{"version": 2}]}, {"id": "c", "traces": []}]
    spark.createDataFrame([(json.dumps(r),) for r in rows] + [("{",)], "value string").coalesce(1).write.text(folder + "/e")
    good, bad = ndjson.read_episodes(spark, folder + "/e")
    assert [r.outcome for r in good.select(traces.outcome().alias("outcome")).collect()] == ["Correct"] and bad.count() == 3


def test_empty_rollouts_are_an_error(spark, folder):
    spark.createDataFrame([], "value string").write.text(folder + "/r")
    with pytest.raises(ValueError):
        ndjson.read_rollouts(spark, folder + "/r")


def test_publish_is_checked_and_never_replaces(spark, folder):
    df = spark.range(3)
    empty = spark.range(0)
    sinks.publish_snapshot(spark, lambda p: df.write.parquet(p), [empty], folder + "/final")
    assert spark.read.parquet(sinks.snapshot_path(spark, folder + "/final")).count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish_snapshot(spark, lambda p: df.write.parquet(p), [], folder + "/final")
    with pytest.raises(ValueError):
        sinks.publish_snapshot(spark, lambda p: df.write.parquet(p), [spark.range(1)], folder + "/other")
    # A failed publication leaves what is there; one that replaces is seen at once.
    with pytest.raises(ValueError):
        sinks.publish_snapshot(spark, lambda p: df.write.parquet(p), [spark.range(1)], folder + "/final", replace=True)
    assert spark.read.parquet(sinks.snapshot_path(spark, folder + "/final")).count() == 3
    sinks.publish_snapshot(spark, lambda p: spark.range(7).write.parquet(p), [], folder + "/final", replace=True)
    assert spark.read.parquet(sinks.snapshot_path(spark, folder + "/final")).count() == 7
    assert sinks.snapshot_path(spark, folder + "/none") is None and sinks.snapshot_path(spark, folder + "/other") is None


def test_relational_reads_are_cut_by_key(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",), ("a'b",), ("b",), ("c",), ("zz",)], "patient_id string")
    for cuts in ([], ["b"], ["a'b", "c", "b", "b"]):
        parts = relational.key_predicates("patient_id", cuts)
        held = [r[0] for p in parts for r in rows.where(p).collect()]
        assert len(parts) == len(set(cuts)) + 1 and sorted(held, key=str) == sorted((r[0] for r in rows.collect()), key=str)


def test_manifest_digests(spark, folder):
    sinks.write_ndjson(spark.createDataFrame([('{"b":1,"a":"é"}',)], "doc string"), folder + "/data")
    listed = files.file_digests(spark, folder + "/data")
    assert files.verify_manifest(listed, listed).isEmpty()
    # Files above the size of a value are read in pieces; both ways agree.
    whole = sorted(map(tuple, listed.collect()))
    assert whole and sorted(map(tuple, files.file_digests(spark, folder + "/data", value_bytes=0).collect())) == whole
    some = sorted(files.file_digests(spark, folder + "/data", value_bytes=10).collect())
    assert [tuple(x) for x in some] == whole
    wrong = listed.withColumn("sha256", F.lit("x"))
    assert {r.problem for r in files.verify_manifest(listed, wrong).collect()} == {"changed"}


def test_run_folders(spark, folder):
    import pathlib

    run = pathlib.Path(folder) / "batch-20260101-000000Z-x"
    (run / "receipts").mkdir(parents=True)
    (run / "plan.json").write_text('{"num_examples":2,"rollouts_per_example":3,"preset":"m"}')
    (run / "receipts" / "finished.json").write_text('{"status":"completed","episodes":6}')
    row = traces.run_status(files.read_runs(spark, folder)).first()
    assert (row.state, row.requested, row.model, row.submitted) == ("Completed", 6, "m", "20260101-000000Z")


def test_patient_source_rejects_conflicts(spark):
    p = spark.createDataFrame([("a",)], "patient_id string")
    e = spark.createDataFrame([("a", "2020-01-01", "1")], "patient_id string, encounter_date string, encounter_id string")
    two = spark.createDataFrame([("a", "train"), ("a", "dev")], "patient_id string, split string")
    with pytest.raises(ValueError):
        relational.patient_source(two, p, e)
    with pytest.raises(ValueError):
        relational.patient_source(two.limit(0), p, e)
    assert relational.patient_source(two.limit(1), p, e)[0].first().encounters == 1


def _world(spark):
    doc = lambda **k: json.dumps(k)
    rows = [
        ("e", "Patient/p", doc(resourceType="Patient", id="p", meta={"versionId": "1"})),
        ("e", "Task/t", doc(resourceType="Task", id="t", meta={"versionId": "1"}, status="draft", **{"for": {"reference": "Patient/p"}})),
    ]
    current = spark.createDataFrame(rows, "episode_id string, ref string, doc string")
    policy = spark.createDataFrame([("e", "Patient/p", ["Task"], [], ["Task/t"])], "episode_id string, policy_patient string, writable_types array<string>, writable_refs array<string>, delete_refs array<string>")
    return current, policy


CHANGE = "episode_id string, bundle_id string, seq int, method string, url string, body string, if_match string, if_none_exist string"


def test_two_writes_to_one_document_inside_a_bundle(spark):
    current, policy = _world(spark)
    body = lambda s: json.dumps({"resourceType": "Task", "id": "t", "status": s, "for": {"reference": "Patient/p"}})
    ch = spark.createDataFrame([("e", "b", 1, "PUT", "Task/t", body("requested"), 'W/"1"', None), ("e", "b", 2, "PUT", "Task/t", body("completed"), 'W/"2"', None)], CHANGE)
    state, audit, outcomes = changes.apply_changes(current, ch, policy)
    final = json.loads(state.where("ref = 'Task/t'").first().doc)
    assert final["status"] == "completed" and final["meta"]["versionId"] == "3"
    assert audit.count() == 2 and all(r.committed for r in outcomes.collect())


def test_dangling_reference_and_large_bundle_and_budget(spark):
    current, policy = _world(spark)
    task = lambda ref: json.dumps({"resourceType": "Task", "status": "requested", "for": {"reference": "Patient/p"}, "focus": {"reference": ref}})
    many = [("e", "big", i, "POST", "Task", task("Task/t"), None, None) for i in range(10, 31)]
    ch = spark.createDataFrame([("e", None, 1, "POST", "Task", task("Task/none"), None, None), *many, ("e", None, 40, "DELETE", "Task/t", None, 'W/"1"', None), ("e", None, 50, "DELETE", "Task/t", None, 'W/"1"', None)], CHANGE)
    state, audit, outcomes = changes.apply_changes(current, ch, policy, max_calls=3)
    status = {r.seq: r.status for r in outcomes.collect()}
    assert status[1] == 400 and status[10] == 400 and status[40] == 204 and status[50] == 429
    assert {r.ref for r in state.collect()} == {"Patient/p"} and audit.count() == 1


@pytest.mark.parametrize("staged_episodes", [0, 65536])
def test_charts_of_any_number_are_judged_alike(spark, staged_episodes):
    doc = lambda **k: json.dumps(k)
    me = {"reference": "Patient/p"}
    task = lambda i, status="draft", **k: doc(resourceType="Task", id=i, meta={"versionId": "1"}, status=status, **{"for": me}, **k)
    slot = lambda status: doc(resourceType="Slot", id="s", meta={"versionId": "1"}, status=status, start="2024-01-01T09:00:00Z", end="2024-01-01T10:00:00Z")
    booked = doc(resourceType="Appointment", id="a", status="booked", start="2024-01-01T09:00:00Z", end="2024-01-01T10:00:00Z", slot=[{"reference": "Slot/s"}])
    chart = [("Patient/p", doc(resourceType="Patient", id="p")), ("Task/t", task("t")), ("Task/u", task("u", focus={"reference": "Task/t"})), ("Slot/s", slot("busy")), ("Appointment/a", booked)]
    current = spark.createDataFrame([(e, *d) for e in ("e", "f", "idle") for d in chart], "episode_id string, ref string, doc string")
    policy = spark.createDataFrame([(e, "Patient/p", ["Task", "Slot"], ["Slot/s"], ["Task/t", "Task/u"]) for e in ("e", "f")], "episode_id string, policy_patient string, writable_types array<string>, writable_refs array<string>, delete_refs array<string>")
    tag = 'W/"1"'
    rows = [
        # Its document is pointed at, until the one that points is gone; a third look finds nothing.
        ("e", None, 1, "DELETE", "Task/t", None, tag, None), ("e", None, 2, "DELETE", "Task/u", None, tag, None),
        ("e", None, 3, "DELETE", "Task/t", None, tag, None), ("e", None, 4, "PUT", "Task/t", task("t"), tag, None),
        # A Slot freed under its booking; two creates, numbered on; a create that points at nothing.
        ("f", None, 1, "PUT", "Slot/s", slot("free"), tag, None), ("f", None, 2, "POST", "Task", doc(resourceType="Task", status="x", **{"for": me}), None, None),
        ("f", None, 3, "POST", "Task", doc(resourceType="Task", status="y", focus={"reference": "Task/created-00001"}, **{"for": me}), None, None),
        ("f", None, 4, "POST", "Task", doc(resourceType="Task", status="z", focus={"reference": "Task/none"}, **{"for": me}), None, None),
        ("f", None, 5, "PUT", "Task/t", task("t", "done"), tag, None),
    ]
    state, audit, outcomes = changes.apply_changes(current, spark.createDataFrame(rows, CHANGE), policy, staged_episodes=staged_episodes)
    got = {(r.episode_id, r.seq): (r.status, r.ref, r.committed) for r in outcomes.collect()}
    assert got == {
        ("e", 1): (409, "Task/t", False), ("e", 2): (204, "Task/u", True), ("e", 3): (204, "Task/t", True), ("e", 4): (404, "Task/t", False),
        ("f", 1): (400, "Slot/s", False), ("f", 2): (201, "Task/created-00001", True), ("f", 3): (201, "Task/created-00002", True),
        ("f", 4): (400, "Task/created-00003", False), ("f", 5): (200, "Task/t", True),
    }
    refs = sorted((r.episode_id, r.ref) for r in state.collect())
    both = {"Patient/p", "Slot/s", "Appointment/a"}
    whole = both | {"Task/t", "Task/u"}
    assert refs == sorted([("e", r) for r in both] + [("f", r) for r in whole | {"Task/created-00001", "Task/created-00002"}] + [("idle", r) for r in whole])
    assert audit.count() == 5 and json.loads(state.where("episode_id = 'f' and ref = 'Task/t'").first().doc)["meta"]["versionId"] == "2"


def test_charts_of_many_episodes_are_not_stored(spark, monkeypatch):
    current, policy = _world(spark)
    large = spark.range(2000).select(F.lit("e").alias("episode_id"), F.concat(F.lit("Observation/"), F.col("id").cast("string")).alias("ref"), F.concat(F.lit('{"resourceType":"Observation","id":"'), F.col("id").cast("string"), F.lit('","note":"'), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8), F.lit('"}')).alias("doc"))
    seen = []
    keep = changes.staged
    monkeypatch.setattr(changes, "staged", lambda df: seen.append(df) or keep(df))
    body = json.dumps({"resourceType": "Task", "id": "t", "status": "requested", "for": {"reference": "Patient/p"}})
    ch = spark.createDataFrame([("e", None, 1, "PUT", "Task/t", body, 'W/"1"', None)], CHANGE)
    _, _, outcomes = changes.apply_changes(current.unionByName(large), ch, policy, staged_episodes=0)
    assert [r.status for r in outcomes.collect()] == [200]
    # Nothing but the change set and what it writes is stored.
    assert all(df.count() <= 1 for df in seen)


def test_counters_of_an_episode(spark):
    tasks = spark.createDataFrame([("e",), ("e",), ("idle",)], "episode_id string")
    tools = spark.createDataFrame([("e",)] * 3, "episode_id string")
    helped = spark.createDataFrame([("e", 5), ("e", None)], "episode_id string, bytes bigint")
    # Unit 1 stops at a conflict before the forbidden entry; units 2 and 3 stop at a forbidden one, 2 has two of them.
    rows = [("e", "1", 1, 409), ("e", "1", 2, 403), ("e", "2", 3, 201), ("e", "2", 4, 403), ("e", "2", 5, 403), ("e", "3", 6, 403), ("e", "4", 7, 200)]
    outcomes = spark.createDataFrame(rows, "episode_id string, unit string, seq int, status int")
    audit = spark.createDataFrame([("e", 7)], "episode_id string, seq int")
    got = {tuple(r) for r in scoring.agent_counters(tasks, tools, helped, outcomes, audit).collect()}
    assert got == {("e", 3, 2, 5, 2, 1), ("idle", 0, 0, 0, 0, 0)}


def test_contexts_are_cut_into_parts(spark):
    rows = [("P/1", f"D/{i}", f"text {i % 7} " + "é" * (i % 3)) for i in range(40)] + [("P/2", "D/x", "only"), ("P/2", "D/y", ""), (None, "D/z", "nobody")]
    df = spark.createDataFrame(rows, "patient_ref string, ref string, doc string")
    got = reports.patient_context(df, part_bytes=100).collect()
    whole = {r.patient_ref: r for r in reports.patient_context(df).collect()}
    assert set(whole) == {"P/1", "P/2"} and whole["P/2"].context == "\nonly"
    mine = sorted((r for r in got if r.patient_ref == "P/1"), key=lambda r: r.part)
    assert len(mine) > 3 and "\n".join(r.context for r in mine) == whole["P/1"].context
    assert all(r.bytes == len(r.context.encode()) for r in got) and sum(r.documents for r in mine) == 40


def test_contract_rules(spark):
    docs = [
        {"resourceType": "Obs", "id": "1", "part": [{"ref": {"reference": "A/1"}}, {}], "valueA": 1, "valueB": 2},
        {"resourceType": "Obs", "id": "2", "part": [{"ref": {"reference": "B/1"}}], "one": [1]},
    ]
    r = ndjson.from_documents(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"))
    c = spark.createDataFrame(
        [("Obs", ["part", "ref"], 1, "1", ["Reference"], ["A"]), ("Obs", ["value[x]"], 0, "1", ["a", "b"], []), ("Obs", ["one"], 0, "1", [], [])],
        "type string, path array<string>, min int, max string, types array<string>, targets array<string>",
    )
    rows = lambda df: sorted((x.ref, x.path, x.violation) for x in df.collect())
    got = set(rows(checks.contract_violations(r, c)))
    # A catalogue that is too large to lie beside the documents meets them in shares, with the same result.
    assert rows(checks.contract_violations(r, c, lookup_bytes=0)) == sorted(got)
    one_type = checks.root_contract_violations(r.where("resource_type = 'Obs'"), c)
    assert "CartesianProduct" not in one_type._jdf.queryExecution().toString()
    assert got == {("Obs/1", "part.ref", "cardinality=0"), ("Obs/1", "value[x]", "multiple_choices"), ("Obs/1", "value[x]", "cardinality=2"), ("Obs/2", "part.ref", "target=B/1"), ("Obs/2", "one", "list_for_scalar")}


def test_where_literals_step_over_quotes(spark):
    q = "SELECT a FROM T WHERE x = 'it''s group by' AND y > 10 AND z = '$.p' GROUP BY a HAVING count(*) > 5"
    assert spark.createDataFrame([(q,)], "q string").select(behavior.where_literals(F.col("q"))).first()[0] == ["it's group by", "10"]


def test_streams_over_several_batches_equal_batch(spark, folder):
    rows = [("a" if i % 3 else "b", i, "rest", "GET", f"Task?code=k{i % 5}", f"saw k{i % 4}" if i % 2 else None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "episode_id string, seq bigint, route string, method string, query string, shown_text string").withColumn("round", F.lit(1))
    for n in range(3):
        df.where((F.col("seq") > n * 20) & (F.col("seq") <= n * 20 + 20)).coalesce(1).write.mode("append").json(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{folder}/in")
    got = {(r.episode_id, r.seq): (r.call, r.refused) for r in Z.stream_budget(spark, 10).run_available(stream).collect()}
    for e in "ab":
        for n, r in enumerate([r for r in rows if r[0] == e], 1):
            assert got[(e, r[1])] == (n, n > 10)
    batch = behavior.term_novelty(df, df.where("shown_text is not null").select("episode_id", "seq", F.col("shown_text").alias("text")), spark.createDataFrame([("a", "k1")], "episode_id string, prompt string"))
    live = Z.stream_novelty(spark, spark.createDataFrame([("a", "k1")], "episode_id string, prompt string")).run_available(stream)
    key = lambda d: sorted((r.episode_id, r.seq, r.term) for r in d.collect())
    assert key(live) == key(batch)


def test_stream_exposure_has_one_row_for_each_episode(spark, folder):
    refs = {3: ["A/1"], 25: ["A/2"], 45: ["A/1", "A/2"]}
    ddl = "episode_id string, seq bigint, route string, method string, query string, status int, round int, refs array<string>, exposed array<struct<ref:string,fields:array<string>>>"
    for n, (seq, seen) in enumerate(refs.items()):
        rows = [(e, seq, "rest", "GET", "Task", 200, n + 1, seen, [(r, ["code", "status"]) for r in seen]) for e in "ab"]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(f"{folder}/seen")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(f"{folder}/seen")
    need = [("A/1", ["code"]), ("A/2", ["code"])]
    tasks = spark.createDataFrame(
        [(e, ["A/1", "A/2"], need, ["A/1"]) for e in "ab"],
        "episode_id string, evidence array<string>, evidence_fields array<struct<ref:string,fields:array<string>>>, target_evidence array<string>",
    )
    got = Z.stream_exposure(spark, tasks).run_available(stream).collect()
    assert sorted(r.episode_id for r in got) == ["a", "b"]
    assert all(r.first_evidence_call is not None and r.all_evidence_call is not None for r in got)


def test_stream_changes_sees_earlier_batches(spark, folder):
    ddl = "episode_id string, seq int, method string, url string, body string, if_match string, if_none_exist string, bundle_id string"
    body = json.dumps({"resourceType": "Task", "id": "t", "meta": {"versionId": "1"}, "status": "draft", "for": {"reference": "Patient/1"}})
    for seq in (1, 2):
        spark.createDataFrame([("e", seq, "DELETE", "Task/t", None, 'W/"1"', None, None)], ddl).coalesce(1).write.mode("append").json(f"{folder}/log{seq}")
    current = spark.createDataFrame([("e", "Task/t", body), ("f", "Task/t", body)], "episode_id string, ref string, doc string")
    policy = spark.createDataFrame(
        [("e", "Patient/1", ["Task"], ["Task/t"], ["Task/t"])],
        "episode_id string, policy_patient string, writable_types array<string>, writable_refs array<string>, delete_refs array<string>",
    )
    live = Z.stream_changes(current, policy)
    first, second = (spark.read.schema(ddl).json(f"{folder}/log{seq}") for seq in (1, 2))
    live.apply(first, 0)
    live.apply(second, 1)
    rows = {r.seq: r.status for r in spark.read.parquet(f"{live.folder}/rows/*").collect()}
    assert rows[1] == 204 and rows[2] in (404, 410, 412), rows
    assert [r.episode_id for r in live.state(1).collect()] == ["f"]
    # A repeated batch gives the same, and only the parts that it touches are written.
    live.apply(second, 1)
    assert {r.seq: r.status for r in spark.read.parquet(f"{live.folder}/rows/*").collect()} == rows and live.state(1).count() == 1


def test_stream_state_is_cut_and_ends(spark, folder):
    ddl = "episode_id string, seq bigint, ts timestamp, round int, status int, bytes double"
    minute = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    # Three batches an hour and more apart; episode old is only in the first, new only in the last.
    batches = [
        [("old", 1, minute(0)), ("old", 2, minute(5)), ("hot", 3, minute(6))] + [(f"e{i}", 10 + i, minute(7)) for i in range(30)],
        [("hot", 100, minute(90)), ("e1", 101, minute(91))],
        [("hot", 200, minute(200)), ("new", 201, minute(201)), ("old", 202, minute(202))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame([(*r, 1, 400 if r[1] == 2 else 200, 1.5) for r in rows], ddl).coalesce(1).write.mode("append").json(f"{folder}/in{n}")
    read = [spark.read.schema(ddl).json(f"{folder}/in{n}") for n in range(3)]
    live = Z.stream_budget(spark, 1, idle="60 minutes", parts=8)
    for n, batch in enumerate(read):
        live.apply(batch, n)
        if n == 1:
            live.apply(batch, n)
            # Nothing had ended when batch 1 came: the newest event before it was of minute 7.
            assert {r.episode_id: r.calls for r in live.state(1).collect()} == {"old": 2, "hot": 2, "e1": 2, **{f"e{i}": 1 for i in range(30) if i != 1}}
    assert {r.episode_id: r.calls for r in live.state(2).collect()} == {"hot": 3, "e1": 2, "new": 1, "old": 1}
    calls = {r.seq: r.call for r in spark.read.parquet(f"{live.folder}/rows/*").collect()}
    assert calls[100] == 2 and calls[200] == 3 and calls[201] == 1 and calls[202] == 1
    # Batch 1 touched two episodes: the other parts are still those of batch 0.
    at = {r["_part"]: r["n"] for r in spark.read.parquet(f"{live.folder}/state").where("_at = 1").groupBy("_part").agg(F.countDistinct("episode_id").alias("n")).collect()}
    assert 1 <= len(at) <= 2

    rounds = Z.stream_rounds(spark, delay="10 minutes", gap="30 minutes", parts=4)
    for n, batch in enumerate(read):
        rounds.apply(batch, n)
    assert sorted(r.episode_id for r in rounds.state(2).collect()) == ["e1", "hot", "hot", "new", "old"]
    given = spark.read.parquet(f"{rounds.folder}/rows/*").where("episode_id = 'old'").collect()
    assert [(r.calls, r.errors, r.bytes, r.started) for r in given] == [(2, 1, 3.0, minute(0))]


def test_stream_rounds_equal_batch_sessions(spark, folder):
    random = np.random.default_rng(1)
    t, rows = datetime(2024, 1, 1), []
    for i in range(400):
        t += timedelta(minutes=int(random.integers(0, 12)))
        rows.append((f"e{random.integers(0, 4)}", i, t, int(random.integers(0, 2)), int(random.choice([200, 400])), 1.0))
    ddl = "episode_id string, seq bigint, ts timestamp, round int, status int, bytes double"
    df = spark.createDataFrame(rows, ddl)
    for n in range(4):
        df.where((F.col("seq") >= n * 100) & (F.col("seq") < n * 100 + 100)).coalesce(1).write.mode("append").json(f"{folder}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    live = Z.stream_rounds(spark, gap="30 minutes", parts=4).run_available(stream)
    whole = df.groupBy("episode_id", "round", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") >= 400).alias("errors"))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(live.select("episode_id", "round", "started", "calls", "errors")) == key(whole.select("episode_id", "round", "w.start", "calls", "errors"))


def test_interleave_needs_every_band(spark):
    p = spark.createDataFrame([("a", "x")], "id string, band string")
    with pytest.raises(ValueError):
        windows.interleave_strata(p, "band", ["x", "y"], "id", 1)


def test_repair_without_lineage_is_reported(spark):
    d = {"resourceType": "DeviceUseStatement", "id": "1", "basedOn": [{"reference": "DeviceRequest/1"}]}
    fixed, repairs = etl.repair_device_links(ndjson.from_documents(spark.createDataFrame([(json.dumps(d),)], "doc string")))
    assert fixed.count() == 0 and repairs.first().repair == "no_lineage"


def test_checkpoint_folder_is_kept(spark):
    ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == first
