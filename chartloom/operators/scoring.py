"""Scoring of episodes: answers, evidence, state deltas and costs, many episodes in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions import text as X
from chartloom.sources.ndjson import parsed_once

WRITES = ("POST", "PUT", "DELETE")


def _none() -> Column:
    return F.array().cast("array<string>")


# -- evidence ----------------------------------------------------------------------------

def exposures(events: DataFrame) -> DataFrame:
    """One row per document an event returned, with the fields it showed; ``i`` is 0 for given context."""
    i = F.when(F.col("route") == "context", 0).otherwise(F.col("seq"))
    return events.select("episode_id", "seq", "round", i.alias("i"), "route", "method", "status", F.explode("exposed").alias("x")).select(
        "episode_id", "seq", "round", "i", "route", "method", "status", "x.ref", "x.fields"
    )


def required_evidence(tasks: DataFrame) -> DataFrame:
    """(episode_id, ref, need, target): the documents a task asks for and the fields of each."""
    need = tasks.select("episode_id", F.explode("evidence_fields").alias("n")).select("episode_id", "n.ref", F.col("n.fields").alias("need"))
    want = tasks.select(
        "episode_id", F.explode("evidence").alias("ref"), F.coalesce("target_evidence", "evidence").alias("targets")
    )
    return want.join(need, ["episode_id", "ref"], "left").select(
        "episode_id", "ref", F.coalesce("need", _none()).alias("need"), F.array_contains("targets", F.col("ref")).alias("target")
    )


def evidence_access(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Required documents whose fields have all been shown over the episode: (episode_id, ref, eligible)."""
    shown = exposures(events).where("status < 300").select("episode_id", "ref", F.explode_outer("fields").alias("field")).distinct()
    want = required_evidence(tasks).withColumn("part", F.explode_outer("need"))
    seen = shown.select("episode_id", "ref").distinct().withColumn("_seen", F.lit(True))
    fields = shown.where("field is not null").withColumn("_shown", F.lit(True))
    j = want.join(seen, ["episode_id", "ref"], "left").join(
        fields.withColumnRenamed("field", "part"), ["episode_id", "ref", "part"], "left"
    )
    ok = F.coalesce("_seen", F.lit(False)) & (F.col("part").isNull() | F.coalesce("_shown", F.lit(False)))
    return j.groupBy("episode_id", "ref").agg(F.bool_and(ok).alias("eligible"))


def first_sightings(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """First event that shows each required document with all its fields."""
    j = exposures(events).join(required_evidence(tasks), ["episode_id", "ref"])
    hit = j.where(F.forall("need", lambda n: F.array_contains("fields", n)))
    return hit.groupBy("episode_id", "ref").agg(
        F.min(F.struct("seq", "i", "round")).alias("at"), F.first("target").alias("target")
    )


def absence_call(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """First executed search that proves the stated absence: (episode_id, absent_at); 0 without a scope.

    The search must be on the right type, for exactly one patient, with nothing but the allowed
    parameters, the right code and tag, and find nothing.
    """
    scoped = tasks.where("absence_scope is not null").select("episode_id", "absence_scope")
    e = events.where("status < 300 and route = 'rest' and method = 'GET'").join(scoped, "episode_id")
    pairs = X.query_pairs(F.col("query"))
    e = e.withColumn("_keys", F.array_distinct(F.transform(pairs, lambda p: p.key)))
    values = lambda k: F.transform(F.filter(pairs, lambda p: p.key == k), lambda p: p.value)
    s = F.col("absence_scope")
    allowed = F.array_compact(F.array(F.lit("patient"), F.lit("_count"), F.when(s.code.isNotNull(), F.lit("type")), F.when(s.tag.isNotNull(), F.lit("_tag"))))
    patient = values("patient")
    good = (
        (X.url_path(F.col("query")) == s.resourceType)
        & (F.size(F.array_except("_keys", allowed)) == 0)
        & (F.size(patient) == 1)
        & F.coalesce(F.try_element_at(patient, F.lit(1)).isin(s.patient, F.substring_index(s.patient, "/", -1)), F.lit(False))
        & (s.tag.isNull() | (values("_tag") == F.array(s.tag)))
        & (s.code.isNull() | (values("type") == F.array(s.code)))
        & (F.col("total") == 0)
    )
    found = e.where(good).groupBy("episode_id").agg(F.min("seq").alias("absent_at"))
    free = tasks.where("absence_scope is null").select("episode_id", F.lit(0).alias("absent_at"))
    return free.unionByName(found.select("episode_id", F.col("absent_at").cast("int").alias("absent_at")))


def evidence_latency(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """First target evidence and first event at which everything required has been seen, by call and round.

    Cumulative coverage is the latest of the first sightings, so no set is carried along the log.
    """
    seen = first_sightings(events, tasks)
    absent = absence_call(events, tasks) if "absence_scope" in tasks.columns else tasks.select("episode_id", F.lit(0).alias("absent_at"))
    g = seen.groupBy("episode_id").agg(
        F.min(F.when(F.col("target"), F.col("at"))).alias("first"), F.count(F.lit(1)).alias("covered"), F.max("at.seq").alias("last_seq")
    )
    base = tasks.select(
        "episode_id", F.size("evidence").alias("required"), (F.size(F.coalesce("target_evidence", "evidence")) > 0).alias("applicable")
    ).join(g, "episode_id", "left").join(absent, "episode_id", "left")
    ready = base.where((F.coalesce("covered", F.lit(0)) == F.col("required")) & F.col("absent_at").isNotNull()).select(
        "episode_id", "absent_at", F.greatest(F.coalesce("last_seq", F.lit(1)), "absent_at").alias("from_seq")
    )
    i = F.when(F.col("route") == "context", 0).otherwise(F.col("seq"))
    done = (
        events.select("episode_id", "seq", "round", i.alias("i")).join(ready, "episode_id")
        .where((F.col("seq") >= F.col("from_seq")) & (F.col("i") >= F.col("absent_at")))
        .groupBy("episode_id").agg(F.min(F.struct("seq", "i", "round")).alias("all"))
    )
    return base.join(done, "episode_id", "left").select(
        "episode_id",
        F.col("first.i").alias("first_evidence_call"),
        F.col("first.round").alias("first_evidence_round"),
        F.col("all.i").alias("all_evidence_call"),
        F.col("all.round").alias("all_evidence_round"),
        F.col("applicable").cast("int").alias("first_evidence_applicable"),
        (F.col("applicable") & F.col("first").isNull()).cast("int").alias("first_evidence_censored"),
        F.col("all").isNull().cast("int").alias("all_evidence_censored"),
    )


def read_before_write(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Was all evidence read before the first committed write? (episode_id, ok)"""
    good = events.where("status < 300")
    wrote = good.where(F.col("method").isin(*WRITES)).groupBy("episode_id").agg(F.min("seq").alias("first_write"))
    reads = good.where((F.col("method") == "GET") | F.col("route").isin("sql", "context"))
    seen = first_sightings(reads, tasks).groupBy("episode_id").agg(F.count(F.lit(1)).alias("covered"), F.max("at.seq").alias("last_seq"))
    j = tasks.select("episode_id", F.size("evidence").alias("required")).join(wrote, "episode_id", "left").join(seen, "episode_id", "left")
    ok = F.col("first_write").isNull() | (
        (F.coalesce("covered", F.lit(0)) == F.col("required")) & (F.coalesce("last_seq", F.lit(0)) < F.col("first_write"))
    )
    return j.select("episode_id", ok.alias("ok"))


def evidence_pr(finals: DataFrame, tasks: DataFrame, access: DataFrame) -> DataFrame:
    """Recall and precision of cited evidence; only cited, required and really seen documents count.

    ``finals`` has (episode_id, submitted array<string>). Nothing required: recall 1, precision 1 only
    when nothing was cited.
    """
    eligible = access.where("eligible").groupBy("episode_id").agg(F.collect_set("ref").alias("eligible"))
    j = tasks.select("episode_id", F.array_distinct("evidence").alias("required")).join(finals, "episode_id", "left").join(eligible, "episode_id", "left")
    sub = F.array_distinct(F.coalesce("submitted", _none()))
    hit = F.size(F.array_intersect(F.array_intersect(sub, "required"), F.coalesce("eligible", _none())))
    return j.select(
        "episode_id",
        F.when(F.size("required") > 0, hit / F.size("required")).otherwise(1.0).alias("evidence_recall"),
        F.when(F.size(sub) > 0, hit / F.size(sub)).otherwise((F.size("required") == 0).cast("double")).alias("evidence_precision"),
    )


# -- answers -----------------------------------------------------------------------------

def parse_finals(finals: DataFrame, allow_fence: bool = False) -> DataFrame:
    """(episode_id, answer_v, submitted, keys_ok) from final texts; an invalid text is an empty answer."""
    body = F.try_parse_json(X.answer_text(F.col("final"), allow_fence))
    f = finals.withColumn("_v", body)
    v = F.col("_v")
    listed = D.items(D.node(v, "evidence"))
    strings = F.forall(listed, lambda x: F.schema_of_variant(x) == "STRING")
    cited = F.when(strings, F.transform(listed, lambda x: x.try_cast("string"))).otherwise(_none())
    return f.select(
        "episode_id",
        D.node(v, "answer").alias("answer_v"),
        F.coalesce(cited, _none()).alias("submitted"),
        X.is_final(F.col("final"), allow_fence).alias("keys_ok"),
    )


def answer_ok(parsed: DataFrame, tasks: DataFrame) -> DataFrame:
    """Exactly answer and evidence, and the answer equal to the gold one (true is not 1, lists ordered)."""
    j = tasks.select("episode_id", F.parse_json("gold_answer").alias("gold_v")).join(parsed, "episode_id", "left")
    same = D.canonical(F.col("answer_v")) == D.canonical(F.col("gold_v"))
    return j.select("episode_id", (F.coalesce("keys_ok", F.lit(False)) & F.coalesce(same, F.lit(False))).alias("answer_ok"))


# -- writes ------------------------------------------------------------------------------

def create_print(v: Column) -> Column:
    """Fingerprint of a created body apart from id and version."""
    return created_print(D.strip_version(v))


def created_print(stripped: Column) -> Column:
    """``create_print`` of fields that ``strip_version`` has made already."""
    return D.fingerprint(F.map_filter(stripped, lambda k, _: k != "id"))


def audit_allowed(audit: DataFrame, gold_updates: DataFrame, gold_creates: DataFrame, gold_deletes: DataFrame) -> DataFrame:
    """Judge every committed write on its own, so that spoiling and restoring a record still fails.

    audit (episode_id, seq, method, ref, before, after), gold_updates (episode_id, ref, field, value),
    gold_creates (episode_id, body), gold_deletes (episode_id, ref); bodies and values are JSON text.
    """
    a = audit.withColumn("_before", F.parse_json("before")).withColumn("_after", F.parse_json("after"))
    deletes = gold_deletes.select("episode_id", "ref").distinct().withColumn("_delete", F.lit(True))
    creates = gold_creates.select("episode_id", create_print(F.parse_json("body")).alias("_print")).distinct().withColumn("_create", F.lit(True))
    sets = gold_updates.groupBy("episode_id", "ref").agg(
        F.map_from_entries(F.collect_list(F.struct("field", D.canonical(F.parse_json("value")).alias("value")))).alias("_set")
    )
    a = a.withColumn("_print", F.when(F.col("method") == "POST", create_print(F.col("_after"))))
    j = a.join(deletes, ["episode_id", "ref"], "left").join(creates, ["episode_id", "_print"], "left").join(sets, ["episode_id", "ref"], "left")
    before, after = D.strip_version(F.col("_before")), D.strip_version(F.col("_after"))
    wanted = F.map_concat(F.map_filter(before, lambda k, _: ~F.map_contains_key("_set", k)), F.col("_set"))
    update_ok = F.col("_set").isNotNull() & (D.fingerprint(after) == D.fingerprint(wanted))
    ok = (
        F.when(F.col("method") == "DELETE", F.coalesce("_delete", F.lit(False)))
        .when(F.col("method") == "POST", F.coalesce("_create", F.lit(False)))
        .otherwise(F.coalesce(update_ok, F.lit(False)))
    )
    return j.select("episode_id", "seq", "ref", "method", ok.alias("ok"))


def one_transaction(events: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tasks that need one transaction: exactly one committed write, to the root, with all entries.

    ``sizes`` has (episode_id, entries).
    """
    w = events.where(F.col("method").isin(*WRITES) & (F.col("status") < 300)).groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("query").alias("q"), F.min("primitive_operations").alias("ops")
    )
    j = sizes.join(w, "episode_id", "left")
    return j.select("episode_id", F.coalesce((F.col("n") == 1) & (F.col("q") == "") & (F.col("ops") == F.col("entries")), F.lit(False)).alias("ok"))


def mutation_integrity(tasks: DataFrame, audit_ok: DataFrame, order_ok: DataFrame, transaction_ok: DataFrame, unsafe: DataFrame, invalid: DataFrame) -> DataFrame:
    """All of: each write allowed, reads before writes, one transaction, no unsafe attempt, a valid graph.

    Order and transaction only bind episodes that wrote and tasks that ask for them. ``unsafe`` and
    ``invalid`` list episodes.
    """
    writes = audit_ok.groupBy("episode_id").agg(F.bool_and("ok").alias("writes_ok"))
    j = (
        tasks.select("episode_id", "requires_read_before_write", "requires_transaction")
        .join(writes, "episode_id", "left").join(order_ok.withColumnRenamed("ok", "order_ok"), "episode_id", "left")
        .join(transaction_ok.withColumnRenamed("ok", "tx_ok"), "episode_id", "left")
        .join(unsafe.select("episode_id").distinct().withColumn("_unsafe", F.lit(True)), "episode_id", "left")
        .join(invalid.select("episode_id").distinct().withColumn("_invalid", F.lit(True)), "episode_id", "left")
    )
    wrote = F.col("writes_ok").isNotNull()
    t = lambda c: F.coalesce(c, F.lit(True))
    binding = lambda flag, ok: ~(F.coalesce(flag, F.lit(False)) & wrote) | F.coalesce(ok, F.lit(False))
    ok = (
        t(F.col("writes_ok")) & binding(F.col("requires_read_before_write"), F.col("order_ok"))
        & binding(F.col("requires_transaction"), F.col("tx_ok")) & F.col("_unsafe").isNull() & F.col("_invalid").isNull()
    )
    return j.select("episode_id", ok.alias("integrity"))


def state_delta(initial: DataFrame, final: DataFrame, gold_updates: DataFrame, gold_creates: DataFrame, gold_deletes: DataFrame) -> DataFrame:
    """Differences between the final state and the initial one with the gold changes applied.

    initial and final have (episode_id, ref, v). Rows: (episode_id, ref, kind) with kind missing, changed,
    undeleted, extra_create or missing_create; no row means the state is as wanted.
    """
    sets = gold_updates.groupBy("episode_id", "ref").agg(
        F.map_from_entries(F.collect_list(F.struct("field", D.canonical(F.parse_json("value")).alias("value")))).alias("_set")
    )
    dels = gold_deletes.select("episode_id", "ref").distinct().withColumn("_del", F.lit(True))
    before = D.strip_version(F.col("v"))
    base = initial.join(sets, ["episode_id", "ref"], "left").join(dels, ["episode_id", "ref"], "left")
    want = F.when(F.col("_set").isNotNull(), F.map_concat(F.map_filter(before, lambda k, _: ~F.map_contains_key("_set", k)), F.col("_set"))).otherwise(before)
    expected = base.select("episode_id", "ref", "_del", D.fingerprint(want).alias("_want"))
    # Both prints come from the same stripped fields, made once per document.
    stripped = parsed_once(final, D.strip_version(F.col("v")), "_fields")
    have = stripped.select("episode_id", "ref", D.fingerprint(F.col("_fields")).alias("_have"), created_print(F.col("_fields")).alias("_print"))
    j = expected.join(have, ["episode_id", "ref"], "full")
    kind = (
        F.when(F.col("_del") & F.col("_have").isNotNull(), "undeleted")
        .when(F.col("_del"), F.lit(None))
        .when(F.col("_want").isNotNull() & F.col("_have").isNull(), "missing")
        .when(F.col("_want") != F.col("_have"), "changed")
    )
    old = j.select("episode_id", "ref", kind.alias("kind")).where("kind is not null")
    added = j.where("_want is null and _have is not null").groupBy("episode_id", "_print").agg(F.count(F.lit(1)).alias("got"), F.min("ref").alias("ref"))
    patterns = gold_creates.select("episode_id", create_print(F.parse_json("body")).alias("_print")).groupBy("episode_id", "_print").agg(F.count(F.lit(1)).alias("wanted"))
    c = added.join(patterns, ["episode_id", "_print"], "full").na.fill(0, ["got", "wanted"])
    made = F.when(F.col("got") > F.col("wanted"), "extra_create").when(F.col("got") < F.col("wanted"), "missing_create")
    return old.unionByName(c.select("episode_id", "ref", made.alias("kind")).where("kind is not null"))


# -- costs and scores --------------------------------------------------------------------

def cost_metrics(events: DataFrame, tasks: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Calls, bytes, errors and documents read per episode.

    Read documents are counted through distinct (episode, ref) rows, not by gathering lists. ``owners``
    (ref, patient_ref) adds reads of other patients' documents.
    """
    asked = F.col("route") != "context"
    read = asked & F.col("method").isin("GET", "SELECT")
    base = events.groupBy("episode_id").agg(
        F.count_if(asked).alias("tool_calls"),
        F.sum("primitive_operations").alias("primitive_operations"),
        F.coalesce(F.sum(F.when(asked, F.col("bytes"))), F.lit(0)).alias("response_bytes"),
        F.coalesce(F.sum(F.when(~asked, F.col("bytes"))), F.lit(0)).alias("context_bytes"),
        F.count_if(F.col("status") >= 400).alias("tool_errors"),
        F.count_if(read).alias("read_calls"),
        F.count_if(asked & F.col("method").isin(*WRITES)).alias("write_calls"),
    )
    refs = events.where(read).select("episode_id", F.explode("refs").alias("ref")).distinct()
    gold = tasks.select("episode_id", F.explode("evidence").alias("ref")).distinct().withColumn("_gold", F.lit(1))
    r = refs.join(gold, ["episode_id", "ref"], "left")
    aggs = [F.count(F.lit(1)).alias("unique_read_resources"), F.count_if(F.col("_gold").isNull()).alias("non_gold_read_resources")]
    if owners is not None:
        own = owners.where("patient_ref is not null").select("ref", F.col("patient_ref").alias("_owner"))
        r = r.join(own, "ref", "left").join(tasks.select("episode_id", F.col("patient_ref").alias("_mine")), "episode_id", "left")
        aggs.append(F.count_if(F.col("_owner") != F.col("_mine")).alias("cross_patient_read_resources"))
    counts = r.groupBy("episode_id").agg(*aggs)
    names = [a for a in counts.columns if a != "episode_id"]
    return base.join(counts, "episode_id", "left").na.fill(0, names)


def agent_counters(tasks: DataFrame, tools: DataFrame, assistance: DataFrame, outcomes: DataFrame, audit: DataFrame) -> DataFrame:
    """Tools called, helper answers, unsafe attempts and committed writes of every episode of ``tasks``, zero where none.

    ``tools`` has a row per tool that the agent called, ``assistance`` (episode_id, bytes) one per helper answer, ``outcomes`` and
    ``audit`` are those of ``apply_changes``. A unit stops at its first refused entry, so it counts as one unsafe attempt
    when that entry was refused for its patient, type or permission (403), however many follow.
    """
    count = lambda df, name: df.groupBy("episode_id").agg(F.count(F.lit(1)).alias(name))
    helped = assistance.groupBy("episode_id").agg(F.count(F.lit(1)).alias("helper_calls"), F.sum("bytes").alias("helper_response_bytes"))
    stopped = outcomes.where("status >= 300").groupBy("episode_id", "unit").agg(F.min_by("status", "seq").alias("status"))
    parts = [count(tools, "agent_tool_calls"), helped, count(stopped.where("status = 403"), "unsafe_attempts"), count(audit, "committed_mutations")]
    # As many rows as episodes, which the planner takes for few.
    out = reduce(lambda a, b: a.join(b.hint("merge"), "episode_id", "left"), parts, tasks.select("episode_id").distinct())
    return out.na.fill(0)


def strict_reward(success: Column, calls: Column, reference_calls: Column, weight: float = 0.0, max_calls: int = 40) -> Column:
    """1 on success, less a bounded share for calls beyond the reference plan."""
    if not 0 <= weight <= 0.15:
        raise ValueError("efficiency weight must be in [0, 0.15]")
    excess = F.greatest(F.lit(0), calls - reference_calls)
    return F.when(success, 1 - weight * F.least(F.lit(1.0), excess / max_calls)).otherwise(0.0)


def score(parts: DataFrame, weight: float = 0.0, max_calls: int = 40) -> DataFrame:
    """Strict score of one row per episode with answer_ok, evidence_recall, evidence_precision, state_ok, absence_ok,
    tool_calls and reference_calls."""
    p = parts
    success = F.col("answer_ok") & (F.col("evidence_recall") == 1) & (F.col("evidence_precision") == 1) & F.col("state_ok") & F.col("absence_ok")
    return p.select(
        "episode_id",
        success.cast("double").alias("strict_success"),
        F.col("answer_ok").cast("double").alias("answer_success"),
        F.col("state_ok").cast("double").alias("state_success"),
        "evidence_recall",
        "evidence_precision",
        strict_reward(success, F.col("tool_calls"), F.col("reference_calls"), weight, max_calls).alias("reward"),
    )


def score_training(strict: DataFrame, canonical: DataFrame, extra: DataFrame, answer_mode: str = "strict", retrieval_weight: float = 0.0) -> DataFrame:
    """Training view: the canonical (fence-tolerant) score beside the strict one, and shaping for safe failures.

    ``extra`` has (episode_id, json_format_valid, required, eligible, attempted, integrity).
    """
    if answer_mode not in ("strict", "json_or_fence"):
        raise ValueError("answer_mode must be strict or json_or_fence")
    if not 0 <= retrieval_weight <= 0.2:
        raise ValueError("retrieval_weight must be in [0, 0.2]")
    c = canonical.select("episode_id", F.col("strict_success").alias("canonical_success"), F.col("reward").alias("_canonical_reward"))
    j = strict.join(c, "episode_id").join(extra, "episode_id")
    fenced = answer_mode == "json_or_fence"
    success = F.col("canonical_success" if fenced else "strict_success")
    base = F.col("_canonical_reward" if fenced else "reward")
    progress = F.when(F.col("required") > 0, F.col("eligible") / F.col("required")).otherwise(0.0)
    shaping = F.when((success == 0) & F.col("attempted") & F.col("integrity"), retrieval_weight * progress).otherwise(0.0)
    return j.select(
        "episode_id", "strict_success", "canonical_success", F.col("json_format_valid").cast("int").alias("json_format_valid"),
        success.alias("workflow_success"), progress.alias("retrieval_progress"), F.col("integrity").cast("int").alias("mutation_integrity"),
        shaping.alias("retrieval_shaping"), (base + shaping).alias("reward"),
    )


def observed_latency(latency: DataFrame) -> DataFrame:
    """Latencies with -1 for not observed."""
    names = ["first_evidence_call", "first_evidence_round", "all_evidence_call", "all_evidence_round"]
    return latency.select("*", *[F.coalesce(F.col(n), F.lit(-1)).alias(n + "_observed") for n in names])


# -- field exposure of SQL results -------------------------------------------------------

# The document field behind each projected column.
COLUMN_FIELDS = {
    "identifier": "identifier",
    "name": "name",
    "birth_date": "birthDate",
    "gender": "gender",
    "patient_ref": "subject",
    "code": "code",
    "status": "status",
    "value": "valueQuantity",
    "unit": "valueQuantity",
    "based_on_ref": "basedOn",
    "result_ref": "result",
    "subscriber_id": "subscriberId",
    "payor_ref": "payor",
    "start_date": "period",
    "end_date": "period",
    "focus_ref": "focus",
    "description": "description",
    "payload": "payload",
    "title": "content",
}


def sql_field_exposure(lineage: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, ref, fields): what a SQL result showed of each document it returned.

    ``lineage`` has (query_id, alias, view, column) of plain output columns, ``results`` (query_id, alias, ref) of
    the resource_ref values returned, ``documents`` (ref, resource_type, top-level ``keys``). Fields count only
    beside the resource_ref of the same alias; value and unit count together, and only where the document has them;
    the whole document column shows everything.
    """
    per = lineage.groupBy("query_id", "alias").agg(F.collect_set("column").alias("columns")).where(F.array_contains("columns", "resource_ref"))
    hit = results.join(per, ["query_id", "alias"]).join(documents, "ref")
    names = F.create_map(*[F.lit(x) for kv in COLUMN_FIELDS.items() for x in kv])
    kind = F.col("resource_type")
    quantity = F.array_contains("columns", "value") & F.array_contains("columns", "unit") & F.array_contains("keys", "valueQuantity")

    def field(c: Column) -> Column:
        known = F.coalesce(F.try_element_at(names, c), c)
        return (
            F.when((c == "date") & (kind == "Observation"), "effectiveDateTime")
            .when((c == "date") & (kind == "Procedure"), "performedDateTime")
            .when((c == "code") & (kind == "DocumentReference"), "type")
            .when((known == "valueQuantity") & ~quantity, F.lit(None))
            .otherwise(known)
        )

    plain = F.array_compact(F.transform(F.filter("columns", lambda c: c != "resource_json"), field))
    whole = F.when(F.array_contains("columns", "resource_json"), F.col("keys")).otherwise(_none())
    rows = hit.select("query_id", "ref", F.explode(F.concat(plain, whole)).alias("field")).distinct()
    return rows.groupBy("query_id", "ref").agg(F.array_sort(F.collect_list("field")).alias("fields"))
