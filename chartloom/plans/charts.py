"""The driver's tables re-shaped as charts: typed projections and, from them, lossless documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions.ranks import ranked


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def key(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))


def customer_count(spark: SparkSession, sf: str) -> int:
    """Number of patients: parquet footers hold it, so this is a metadata read and one number."""
    return table(spark, sf, "customer").count()


def patient(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        key("Patient/c", "c_custkey").alias("resource_ref"),
        key("c", "c_custkey").alias("id"),
        key("MRN-", "c_custkey").alias("identifier"),
        F.col("c_name").alias("name"),
        day(F.date_add(F.lit("1940-01-01").cast("date"), ((F.col("c_custkey") * 37) % 25000).cast("int"))).alias("birth_date"),
        F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male").alias("gender"),
        key("Organization/n", "c_nationkey").alias("organization_ref"),
    )


def organization(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(
        key("Organization/n", "n_nationkey").alias("resource_ref"),
        key("n", "n_nationkey").alias("id"),
        key("ORG-", "n_nationkey").alias("identifier"),
        F.col("n_name").alias("name"),
        key("Location/r", "n_regionkey").alias("location_ref"),
    )


def location(spark, sf) -> DataFrame:
    r = table(spark, sf, "region")
    return r.select(
        key("Location/r", "r_regionkey").alias("resource_ref"), key("r", "r_regionkey").alias("id"), F.col("r_name").alias("name")
    )


def practitioner(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        key("Practitioner/p", "s_suppkey").alias("resource_ref"),
        key("p", "s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        key("Organization/n", "s_nationkey").alias("organization_ref"),
    )


def medication(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        key("Medication/m", "p_partkey").alias("resource_ref"),
        key("m", "p_partkey").alias("id"),
        F.col("p_type").alias("code"),
        F.col("p_name").alias("text"),
    )


def servicerequest(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        key("ServiceRequest/o", "o_orderkey").alias("resource_ref"),
        key("o", "o_orderkey").alias("id"),
        key("Patient/c", "o_custkey").alias("patient_ref"),
        key("ORD-", "o_orderkey").alias("identifier"),
        F.col("o_orderpriority").alias("code"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("draft").alias("status"),
        day("o_orderdate").alias("date"),
    )


def _numbered_lines(spark, sf) -> DataFrame:
    """Lines with an id made unique by a row number over the few copies of each key.

    They are dealt by order, which the joins with orders ask for as well, so that lines move once for both.
    """
    from pyspark.sql import Window

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    w = Window.partitionBy(*keys).orderBy("l_extendedprice", "l_shipdate", "l_quantity")
    return table(spark, sf, "lineitem").repartition("l_orderkey").withColumn("n", F.row_number().over(w)).withColumn(
        "line_id", F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.col("n").cast("string"))
    )


def observation(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    li = _numbered_lines(spark, sf)
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return joined.select(
        F.concat(F.lit("Observation/"), "line_id").alias("resource_ref"),
        F.col("line_id").alias("id"),
        key("Patient/c", "o_custkey").alias("patient_ref"),
        F.col("p_type").alias("code"),
        F.when(F.col("l_returnflag") == "R", "entered-in-error")
        .when(F.col("l_linestatus") == "O", "preliminary")
        .otherwise("final")
        .alias("status"),
        day("l_shipdate").alias("date"),
        F.col("l_quantity").alias("value"),
        F.lit("mg").alias("unit"),
        key("ServiceRequest/o", "l_orderkey").alias("based_on_ref"),
        key("Medication/m", "l_partkey").alias("focus_ref"),
    )


def medicationrequest(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = _numbered_lines(spark, sf)
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("MedicationRequest/"), "line_id").alias("resource_ref"),
        F.col("line_id").alias("id"),
        key("Patient/c", "o_custkey").alias("patient_ref"),
        F.when(F.col("l_returnflag") == "R", "stopped").otherwise("active").alias("status"),
        key("Medication/m", "l_partkey").alias("medication_ref"),
        day("o_orderdate").alias("date"),
        day("l_shipdate").alias("handed_over"),
    )


def diagnosticreport(spark, sf) -> DataFrame:
    """One row per report; ``result_ref`` holds one result, so reports fan out over their results."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    li = _numbered_lines(spark, sf).select("l_orderkey", "line_id")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select(
        key("DiagnosticReport/g", "o_orderkey").alias("resource_ref"),
        key("g", "o_orderkey").alias("id"),
        key("Patient/c", "o_custkey").alias("patient_ref"),
        F.col("o_orderpriority").alias("code"),
        F.lit("final").alias("status"),
        day("o_orderdate").alias("date"),
        key("ServiceRequest/o", "o_orderkey").alias("based_on_ref"),
        F.concat(F.lit("Observation/"), "line_id").alias("result_ref"),
    )


def coverage(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    start = F.date_add(F.lit("1994-01-01").cast("date"), ((F.col("c_custkey") * 13) % 1460).cast("int"))
    return c.select(
        key("Coverage/k", "c_custkey").alias("resource_ref"),
        key("k", "c_custkey").alias("id"),
        key("Patient/c", "c_custkey").alias("patient_ref"),
        F.when(F.col("c_acctbal") >= 0, "active").otherwise("cancelled").alias("status"),
        key("SUB-", "c_custkey").alias("subscriber_id"),
        key("Organization/n", "c_nationkey").alias("payor_ref"),
        day(start).alias("start_date"),
        day(F.date_add(start, ((F.col("c_custkey") % 5 + 1) * 365).cast("int"))).alias("end_date"),
        F.col("c_mktsegment").alias("class"),
    )


def task(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    return o.select(
        key("Task/t", "o_orderkey").alias("resource_ref"),
        key("t", "o_orderkey").alias("id"),
        key("Patient/c", "o_custkey").alias("patient_ref"),
        F.when(F.col("o_orderkey") % 3 == 0, "draft").otherwise("requested").alias("status"),
        key("ServiceRequest/o", "o_orderkey").alias("focus_ref"),
        F.concat(F.lit("Fulfil "), "o_orderpriority").alias("description"),
    )


def procedure(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return o.select(
        key("Procedure/x", "o_orderkey").alias("resource_ref"),
        key("x", "o_orderkey").alias("id"),
        key("Patient/c", "o_custkey").alias("patient_ref"),
        F.col("o_orderpriority").alias("code"),
        F.lit("completed").alias("status"),
        day("o_orderdate").alias("date"),
    )


def communication(spark, sf) -> DataFrame:
    n = customer_count(spark, sf)
    v = table(spark, sf, "conversations")
    return v.select(
        key("Communication/v", "conv_id", "turn").alias("resource_ref"),
        key("v", "conv_id", "turn").alias("id"),
        F.concat(F.lit("Patient/c"), (F.col("conv_id") % n).cast("string")).alias("patient_ref"),
        F.lit("completed").alias("status"),
        F.col("text").alias("payload"),
        day(F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int"))).alias("date"),
        F.col("role").alias("sender"),
    )


def documentreference(spark, sf) -> DataFrame:
    n = customer_count(spark, sf)
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").select(
        key("DocumentReference/d", "doc_id").alias("resource_ref"),
        key("d", "doc_id").alias("id"),
        F.concat(F.lit("Patient/c"), (F.col("doc_id") % n).cast("string")).alias("patient_ref"),
        F.lit("current").alias("status"),
        F.col("source").alias("code"),
        key("Document ", "doc_id").alias("title"),
        "lang",
        "text",
        F.when(F.col("quality") == 1, "source-preserved").when(F.col("quality") == 0, "generated-note").alias("tag"),
        "doc_id",
    )


def schedule(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        key("Schedule/h", "s_suppkey").alias("resource_ref"), key("h", "s_suppkey").alias("id"), key("Practitioner/p", "s_suppkey").alias("actor_ref")
    )


def slot(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        key("Slot/s", "o_orderkey").alias("resource_ref"),
        key("s", "o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "busy").when(F.col("o_orderstatus") == "O", "free").otherwise("busy-tentative").alias("status"),
        F.concat(day("o_orderdate"), F.lit("T09:00:00Z")).alias("start"),
        F.concat(day("o_orderdate"), F.lit("T10:00:00Z")).alias("end"),
        (F.col("o_orderkey") % 11 == 0).alias("overbooked"),
    )


def appointment(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        key("Appointment/a", "o_orderkey").alias("resource_ref"),
        key("a", "o_orderkey").alias("id"),
        key("Patient/c", "o_custkey").alias("patient_ref"),
        F.when(k % 5 == 0, "cancelled").otherwise("booked").alias("status"),
        F.concat(F.lit("Slot/s"), F.when(k % 7 == 0, k - k % 14).otherwise(k).cast("string")).alias("slot_ref"),
        F.concat(day("o_orderdate"), F.when(k % 10 == 1, "T08:30:00Z").otherwise("T09:00:00Z")).alias("start"),
        F.concat(day("o_orderdate"), F.when(k % 13 == 0, "T08:45:00Z").otherwise("T09:30:00Z")).alias("end"),
    )


def specimen(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        key("Specimen/z", "o_orderkey").alias("resource_ref"),
        key("z", "o_orderkey").alias("id"),
        key("Patient/c", "o_custkey").alias("patient_ref"),
        F.when(F.col("o_totalprice") < 20000, "unsatisfactory").otherwise("available").alias("status"),
        key("ServiceRequest/o", "o_orderkey").alias("request_ref"),
        day("o_orderdate").alias("collected"),
        day(F.date_add(F.col("o_orderdate").cast("date"), (k % 4 - 1).cast("int"))).alias("received"),
    )


VIEWS = {
    "Patient": patient,
    "Organization": organization,
    "Location": location,
    "Practitioner": practitioner,
    "Medication": medication,
    "ServiceRequest": servicerequest,
    "Observation": observation,
    "MedicationRequest": medicationrequest,
    "DiagnosticReport": diagnosticreport,
    "Coverage": coverage,
    "Task": task,
    "Procedure": procedure,
    "Communication": communication,
    "DocumentReference": documentreference,
    "Schedule": schedule,
    "Slot": slot,
    "Appointment": appointment,
    "Specimen": specimen,
}


# -- lossless documents ------------------------------------------------------------------

def _ref(c) -> Column:
    return F.struct((F.col(c) if isinstance(c, str) else c).alias("reference"))


def _concept(code, system="urn:chart:codes", text=None) -> Column:
    coding = F.array(F.struct(F.lit(system).alias("system"), F.col(code).alias("code")))
    return F.struct(coding.alias("coding"), *([F.col(text).alias("text")] if text else []))


def _identifier(c="identifier") -> Column:
    return F.array(F.struct(F.lit(D.MRN_SYSTEM).alias("system"), F.col(c).alias("value")))


def _doc(df: DataFrame, kind: str, **parts: Column) -> DataFrame:
    tag = parts.pop("_tag", None)
    meta = [F.lit("1").alias("versionId")]
    if tag is not None:
        meta.append(
            F.when(tag.isNotNull(), F.array(F.struct(F.lit(D.ORIGIN_SYSTEM).alias("system"), tag.alias("code")))).alias("tag")
        )
    body = F.struct(
        F.lit(kind).alias("resourceType"), F.col("id"), F.struct(*meta).alias("meta"), *[c.alias(n) for n, c in parts.items()]
    )
    return df.select(F.lit(kind).alias("resource_type"), F.to_json(body).alias("doc"))


def documents_of(spark, sf, kind: str) -> DataFrame:
    """One JSON document per row for a resource type."""
    c = F.col
    df = VIEWS[kind](spark, sf)
    if kind == "Patient":
        name = F.array(F.struct(c("name").alias("text"), F.element_at(F.split("name", "#"), 1).alias("family")))
        return _doc(df, kind, identifier=_identifier(), name=name, gender=c("gender"), birthDate=c("birth_date"), managingOrganization=_ref("organization_ref"))
    if kind == "Organization":
        return _doc(df, kind, identifier=_identifier(), name=c("name"), endpoint=F.array(_ref("location_ref")))
    if kind == "Location":
        return _doc(df, kind, name=c("name"))
    if kind == "Practitioner":
        return _doc(df, kind, name=F.array(F.struct(c("name").alias("text"))), qualification=F.array(F.struct(_ref("organization_ref").alias("issuer"))))
    if kind == "Medication":
        return _doc(df, kind, code=_concept("code", text="text"))
    if kind == "ServiceRequest":
        return _doc(df, kind, identifier=_identifier(), status=c("status"), code=_concept("code"), subject=_ref("patient_ref"), authoredOn=c("date"))
    if kind == "Observation":
        return _doc(
            df, kind, status=c("status"), code=_concept("code"), subject=_ref("patient_ref"), basedOn=F.array(_ref("based_on_ref")),
            focus=F.array(_ref("focus_ref")), effectiveDateTime=c("date"), valueQuantity=F.struct(c("value"), c("unit")),
        )
    if kind == "MedicationRequest":
        return _doc(df, kind, status=c("status"), subject=_ref("patient_ref"), medicationReference=_ref("medication_ref"), authoredOn=c("date"))
    if kind == "DiagnosticReport":
        g = df.groupBy("id", "patient_ref", "code", "status", "date", "based_on_ref").agg(
            F.array_sort(F.collect_list("result_ref")).alias("results")
        )
        return _doc(
            g, kind, status=c("status"), code=_concept("code"), subject=_ref("patient_ref"), issued=c("date"),
            basedOn=F.array(_ref("based_on_ref")), result=F.when(F.size("results") > 0, F.transform("results", lambda r: F.struct(r.alias("reference")))),
        )
    if kind == "Coverage":
        return _doc(
            df, kind, status=c("status"), beneficiary=_ref("patient_ref"), payor=F.array(_ref("payor_ref")), subscriberId=c("subscriber_id"),
            period=F.struct(c("start_date").alias("start"), c("end_date").alias("end")), **{"class": F.array(F.struct(c("class").alias("value")))},
        )
    if kind == "Task":
        return _doc(df, kind, status=c("status"), focus=_ref("focus_ref"), description=c("description"), **{"for": _ref("patient_ref")})
    if kind == "Procedure":
        return _doc(df, kind, status=c("status"), code=_concept("code"), subject=_ref("patient_ref"), performedDateTime=c("date"))
    if kind == "Communication":
        return _doc(
            df, kind, status=c("status"), subject=_ref("patient_ref"), sent=c("date"),
            payload=F.array(F.struct(c("payload").alias("contentString"))), note=F.array(F.struct(c("sender").alias("text"))),
        )
    if kind == "DocumentReference":
        att = F.struct(F.lit("text/plain").alias("contentType"), F.base64(F.encode("text", "UTF-8")).alias("data"), c("title"), c("lang").alias("language"))
        return _doc(df, kind, status=c("status"), type=_concept("code"), subject=_ref("patient_ref"), content=F.array(F.struct(att.alias("attachment"))), _tag=c("tag"))
    if kind == "Schedule":
        return _doc(df, kind, active=F.lit(True), actor=F.array(_ref("actor_ref")))
    if kind == "Slot":
        return _doc(df, kind, status=c("status"), start=c("start"), end=c("end"), overbooked=c("overbooked"))
    if kind == "Appointment":
        person = F.struct(_ref("patient_ref").alias("actor"), F.lit("accepted").alias("status"))
        return _doc(df, kind, status=c("status"), start=c("start"), end=c("end"), slot=F.array(_ref("slot_ref")), participant=F.array(person))
    if kind == "Specimen":
        return _doc(
            df, kind, status=c("status"), subject=_ref("patient_ref"), request=F.array(_ref("request_ref")),
            collection=F.struct(c("collected").alias("collectedDateTime")), receivedTime=c("received"),
        )
    raise KeyError(kind)


def documents(spark, sf, *kinds: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [documents_of(spark, sf, k) for k in (kinds or VIEWS)])


def resources(spark, sf, *kinds: str) -> DataFrame:
    """Parsed resource rows of the given types (all when none is named)."""
    from chartloom.sources.ndjson import from_documents

    return from_documents(documents(spark, sf, *kinds))


# -- event logs --------------------------------------------------------------------------

def tool_events(spark, sf) -> DataFrame:
    """One row per call; ``seq`` orders the calls of an episode."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, k, u = F.col("event_type"), F.col("k"), F.col("user_id")
    s = lambda c: c.cast("string")
    sql = (kind == "view") & (k % 4 == 0)
    e = ranked(e, ["user_id"], F.date_trunc("day", "ts"), [F.col("ts"), F.col("event_id")])
    read = F.concat(F.lit("ServiceRequest/o"), s(k))
    who = F.concat(F.lit("Patient/c"), s(u))
    query = (
        F.when(sql, F.concat(F.lit("SELECT resource_ref, value FROM Observation WHERE code = 'k"), s(k), F.lit("' AND status = 'final'")))
        .when(kind == "view", F.concat(F.lit("Observation?patient=c"), s(u), F.lit("&code=urn:codes%7Ck"), s(k), F.lit("&date=ge2024-01-"), F.lpad(s(k % 28 + 1), 2, "0"), F.lit("&_count=5")))
        .when(kind == "click", read)
        .when(kind == "purchase", F.lit("Task"))
        .when(kind == "signup", who)
        .otherwise(F.concat(F.lit("Observation?code=k"), s(k), F.lit("&_sort=bogus")))
    )
    none = F.array().cast("array<string>")
    refs = (
        F.when(sql, F.array(read))
        .when(kind == "view", F.array(who, read))
        .when(kind.isin("click", "purchase"), F.array(read))
        .when(kind == "signup", F.array(who))
        .otherwise(none)
    )
    shown = F.when(sql, F.array(F.lit("valueQuantity"))).otherwise(F.array(F.lit("code"), F.lit("status")))
    return e.select(
        F.concat(F.lit("ep"), s(u)).alias("episode_id"),
        "seq",
        "ts",
        F.when(sql, "sql").otherwise("rest").alias("route"),
        F.when(kind == "click", "read_document").when(sql, "sql_query").otherwise("fhir_request").alias("via_tool"),
        F.when(sql, "SELECT").when(kind == "purchase", "POST").when(kind == "signup", "PUT").otherwise("GET").alias("method"),
        query.alias("query"),
        F.when(kind == "error", 400).when(kind == "purchase", 201).otherwise(200).alias("status"),
        F.floor(k / 10).cast("int").alias("round"),
        refs.alias("refs"),
        F.transform(refs, lambda r: F.struct(r.alias("ref"), shown.alias("fields"))).alias("exposed"),
        F.col("value").alias("bytes"),
        F.lit(1).alias("primitive_operations"),
        F.when((kind == "view") & ~sql, k % 3).cast("int").alias("total"),
        "k",
        "user_id",
    )


def episode_tasks(spark, sf) -> DataFrame:
    """One task per episode: two required documents, the fields each must show, and the prompt."""
    u = table(spark, sf, "events").select("user_id").distinct()
    s = lambda c: c.cast("string")
    who = F.concat(F.lit("Patient/c"), s(F.col("user_id")))
    order = F.concat(F.lit("ServiceRequest/o"), s(F.col("user_id") % 100))
    return u.select(
        F.concat(F.lit("ep"), s(F.col("user_id"))).alias("episode_id"),
        "user_id",
        F.concat(F.lit("Find order k"), s(F.col("user_id") % 100), F.lit(" of the caller")).alias("prompt"),
        F.array(who, order).alias("evidence"),
        F.array(order).alias("target_evidence"),
        F.array(
            F.struct(who.alias("ref"), F.array().cast("array<string>").alias("fields")),
            F.struct(order.alias("ref"), F.array(F.lit("code"), F.lit("status")).alias("fields")),
        ).alias("evidence_fields"),
        who.alias("patient_ref"),
        F.lit(3).alias("reference_calls"),
    )


def rollouts(spark, sf) -> DataFrame:
    """One recorded rollout per labelled document."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.drop("text").join(l, "doc_id").select(
        key("task-", "doc_id").alias("task_id"),
        F.concat(F.lit("pt"), (F.col("doc_id") % 50).cast("string")).alias("patient_id"),
        F.col("source").alias("family"),
        F.when(F.col("doc_id") % 3 == 0, "CR").otherwise("R").alias("crud"),
        F.lit("dev").alias("split"),
        (F.col("n_chars") % 4 + 1).cast("int").alias("retrieval_hops"),
        F.lit("m1").alias("model"),
        F.when(F.col("lang") == "en", "raw").otherwise("assisted").alias("tool_profile"),
        F.lit("rest").alias("query_mode"),
        F.lit(17).alias("seed"),
        F.sha2(F.lit("corpus"), 256).alias("digest"),
        F.when(F.col("doc_id") % 2 == 0, 0).otherwise(10).alias("training_step"),
        F.lit(0).alias("rollout_id"),
        F.create_map(
            F.lit("strict_success"), F.col("quality").cast("double"),
            F.lit("unsafe_attempts"), F.col("toxic").cast("double"),
            F.lit("response_bytes"), F.col("n_chars").cast("double"),
            F.lit("model_total_tokens"), F.when(F.col("doc_id") % 5 == 0, -1.0).otherwise((F.col("n_chars") % 97).cast("double")),
        ).alias("metrics"),
        "doc_id",
    )
