"""Corpus ETL: import of source patients, repairs, lineage, merging and the refresh of exhaustive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions import text as X
from chartloom.functions.ranks import range_ranked, ranked

C = F.col

# Statements that say there is no allergy.
NO_ALLERGY = ("nkda", "none", "no known allergies", "no known drug allergies", "nka")


def assign_dev_split(patients: DataFrame, patient: str = "patient_id", split: str = "split") -> DataFrame:
    """A tenth of the train patients (at least one), those with the smallest hash, become dev."""
    train = patients.where(C(split) == "train").withColumn("_h", X.stable_id(F.lit("development"), C(patient)))
    order = ranked(train.select(patient, "_h"), [], F.substring("_h", 1, 3), [C("_h")], "_k")
    total = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    dev = order.where(C("_k") <= F.greatest(F.lit(1), F.floor(total / 10))).select(patient, F.lit(True).alias("_dev"))
    return patients.join(dev, patient, "left").withColumn("upstream_split", C(split)).withColumn(
        split, F.when(C("_dev"), "dev").otherwise(C(split))
    ).drop("_dev")


def _resource(kind: str, identity: Column, origin: str, **parts: Column) -> Column:
    meta = F.struct(F.lit("1").alias("versionId"), F.array(F.struct(F.lit(D.ORIGIN_SYSTEM).alias("system"), F.lit(origin).alias("code"))).alias("tag"))
    body = F.struct(F.lit(kind).alias("resourceType"), X.stable_id(F.lit(kind), identity).alias("id"), meta.alias("meta"), *[c.alias(n.rstrip("_")) for n, c in parts.items()])
    return F.to_json(body)


def patient_reference(source_id: Column) -> Column:
    return F.struct(F.concat(F.lit("Patient/"), X.stable_id(F.lit("Patient"), F.concat(source_id, F.lit("/patient")))).alias("reference"))


def import_patients(patients: DataFrame) -> DataFrame:
    """(source_id, name, sex, age, first_date) -> Patient documents with an MRN and a birth date before the first visit."""
    offset = X.hash63(C("source_id")) % 300 + 1
    birth = F.date_sub(F.to_date("first_date"), (F.greatest(F.lit(0), C("age")) * 365 + offset).cast("int"))
    mrn = F.concat(F.lit("SYN-"), F.substring(X.stable_id(F.lit("mrn"), C("source_id")), 1, 10))
    names = F.split("name", " ")
    doc = _resource(
        "Patient", F.concat("source_id", F.lit("/patient")), "source-with-generated-demographics",
        identifier=F.array(F.struct(F.lit(D.MRN_SYSTEM).alias("system"), mrn.alias("value"))),
        name=F.array(F.struct(C("name").alias("text"), F.element_at(names, -1).alias("family"), F.array(F.element_at(names, 1)).alias("given"))),
        gender=F.when(C("sex") == "F", "female").when(C("sex") == "M", "male").otherwise("unknown"), birthDate=F.date_format(birth, "yyyy-MM-dd"), active=F.lit(True),
    )
    return patients.select("source_id", doc.alias("doc"), F.lit("longitudinal_patients.profile").alias("source_key"), F.lit("source-with-generated-demographics").alias("origin"))


def import_encounters(encounters: DataFrame) -> DataFrame:
    """(source_id, encounter_id, encounter_date, encounter_type, note_text) -> Encounter and its note."""
    who = patient_reference(C("source_id"))
    kind = F.when(C("encounter_type").isin("inpatient", "icu"), "IMP").when(C("encounter_type") == "ed", "EMER").otherwise("AMB")
    at = F.concat_ws("/", "source_id", "encounter_id")
    key = F.concat(F.lit("longitudinal_encounters/"), "encounter_id")
    encounter = _resource(
        "Encounter", at, "source-with-generated-provider", status=F.lit("finished"), class_=F.struct(kind.alias("code")), subject=who,
        period=F.struct(F.substring("encounter_date", 1, 10).alias("start")), type=F.array(F.struct(C("encounter_type").alias("text"))),
    )
    link = F.struct(F.concat(F.lit("Encounter/"), X.stable_id(F.lit("Encounter"), at)).alias("reference"))
    attachment = F.struct(F.lit("text/plain").alias("contentType"), F.base64(F.encode("note_text", "UTF-8")).alias("data"), F.lit("Source clinical note").alias("title"))
    note = _resource(
        "DocumentReference", at, "source-preserved", status=F.lit("current"), subject=who, context=F.struct(F.array(link).alias("encounter")),
        content=F.array(F.struct(attachment.alias("attachment"))),
    )
    rows = F.array(
        F.struct(encounter.alias("doc"), key.alias("source_key"), F.lit("source-with-generated-provider").alias("origin")),
        F.struct(note.alias("doc"), F.concat(key, F.lit("/note_text")).alias("source_key"), F.lit("source-preserved").alias("origin")),
    )
    return encounters.select("source_id", F.explode(rows).alias("r")).select("source_id", "r.*")


def import_profile(patients: DataFrame) -> DataFrame:
    """Profiles (source_id, profile JSON) -> the exact profile document, conditions, allergies and medications.

    Negative allergy statements stay only in the profile document. Position keys tell repeated names apart.
    """
    p = patients.withColumn("v", F.parse_json("profile"))
    who = patient_reference(C("source_id"))
    at = lambda label: F.concat(C("source_id"), F.lit("/" + label))
    attachment = F.struct(F.lit("application/json").alias("contentType"), F.base64(F.encode(F.to_json("v"), "UTF-8")).alias("data"), F.lit("Exact source profile").alias("title"))
    exact = p.select(
        "source_id", _resource("DocumentReference", at("source-profile"), "source-preserved", status=F.lit("current"), subject=who, content=F.array(F.struct(attachment.alias("attachment")))).alias("doc"),
        F.lit("longitudinal_patients.profile").alias("source_key"), F.lit("source-preserved").alias("origin"),
    )

    def each(field: str, label: str, build, keep=None) -> DataFrame:
        rows = p.select("source_id", F.posexplode(D.values_at(C("v"), field)).alias("i", "x"))
        plain = C("x").try_cast("string")
        rows = rows.withColumn("text", F.when(F.schema_of_variant("x").startswith("OBJECT"), F.coalesce(D.text(C("x"), "name"), F.lit("Reported home medication"))).otherwise(plain))
        rows = rows.withColumn("dose", D.text(C("x"), "dose"))
        rows = rows if keep is None else rows.where(keep)
        identity = F.concat("source_id", F.lit(f"/{label}-"), C("i").cast("string"))
        return rows.select("source_id", build(identity).alias("doc"), F.concat(F.lit(f"profile/{field}/"), C("i").cast("string")).alias("source_key"), F.lit("source-profile").alias("origin"))

    concept = F.struct(C("text"))
    conditions = each("chronic_conditions", "condition", lambda i: _resource("Condition", i, "source-profile", subject=who, code=concept))
    stated = ~F.lower(F.trim("text")).isin(*NO_ALLERGY)
    allergies = each("allergies", "allergy", lambda i: _resource("AllergyIntolerance", i, "source-profile", patient=who, code=concept), stated)
    dosage = F.when(F.coalesce(C("dose"), F.lit("")) != "", F.array(F.struct(C("dose").alias("text"))))
    medications = each("home_medications", "medication", lambda i: _resource("MedicationStatement", i, "source-profile", status=F.lit("active"), subject=who, medicationCodeableConcept=concept, dosage=dosage))
    return exact.unionByName(conditions).unionByName(allergies).unionByName(medications)


def ledger_rows(imported: DataFrame, version: str, seed: int) -> DataFrame:
    """One lineage row per document that is no Provenance."""
    v = F.parse_json("doc")
    return imported.withColumn("v", v).where(D.text(C("v"), "resourceType") != "Provenance").select(
        D.ref(D.text(C("v"), "resourceType"), D.text(C("v"), "id")).alias("resource_ref"), "origin", C("source_id").alias("source_patient_id"), "source_key",
        F.lit(version).alias("generator_version"), F.lit(seed).alias("seed"),
    )


def emit_provenance(ledger: DataFrame, deletable: DataFrame, recorded: str, agent_ref: str) -> DataFrame:
    """One Provenance per ledger row, none for documents a task may delete: (ref, doc)."""
    kept = ledger.join(deletable.select(C("ref").alias("resource_ref")), "resource_ref", "left_anti")
    doc = _resource(
        "Provenance", F.concat_ws("/", "source_patient_id", "resource_ref"), "generated-lineage", target=F.array(F.struct(C("resource_ref").alias("reference"))),
        recorded=F.lit(recorded + "T12:00:00Z"), agent=F.array(F.struct(F.struct(F.lit(agent_ref).alias("reference")).alias("who"))), activity=F.struct(C("origin").alias("text")),
    )
    return kept.select(C("resource_ref").alias("target_ref"), doc.alias("doc"))


_ALLERGY_SYSTEM = "http://terminology.hl7.org/CodeSystem/allergyintolerance-"


def repair_allergy_status(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allergies without a clinical status become active and unconfirmed with a note; returns (ref, doc) and repairs."""
    v = C("v")
    broken = resources.where("resource_type = 'AllergyIntolerance'").where(D.node(v, "clinicalStatus").isNull())
    concept = lambda kind, code: F.to_json(F.struct(F.array(F.struct(F.lit(_ALLERGY_SYSTEM + kind).alias("system"), F.lit(code).alias("code"))).alias("coding")))
    remark = F.lit('{"text":"Reported in the source profile\'s current allergy list; not clinically reconciled."}')
    notes = F.concat(F.lit("["), F.array_join(F.concat(F.transform(D.values_at(v, "note"), lambda x: F.to_json(x)), F.array(remark)), ","), F.lit("]"))
    new = F.create_map(F.lit("clinicalStatus"), concept("clinical", "active"), F.lit("verificationStatus"), concept("verification", "unconfirmed"), F.lit("note"), notes)
    fixed = broken.select("ref", D.with_fields(v, new).alias("doc"))
    repairs = broken.select("ref", F.lit("reported_allergy_status").alias("repair"), F.array(F.lit("clinicalStatus"), F.lit("verificationStatus"), F.lit("note")).alias("fields"))
    return fixed, repairs


def repair_device_links(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order links a device use may not have move to the entities of its Provenance; returns (ref, doc) and repairs.

    A device use without a Provenance is reported with repair ``no_lineage`` and left as it is.
    """
    v = C("v")
    links = D.values_at(v, "basedOn")
    wrong = lambda x: F.coalesce(D.text(x, "reference").startswith("DeviceRequest/"), F.lit(False))
    use = resources.where("resource_type = 'DeviceUseStatement'").select("ref", "v", F.transform(F.filter(links, wrong), lambda x: F.to_json(x)).alias("bad"), F.transform(F.filter(links, lambda x: ~wrong(x)), lambda x: F.to_json(x)).alias("good")).where(F.size("bad") > 0)
    lineage = resources.where("resource_type = 'Provenance'").where(F.size(D.values_at(v, "target")) == 1).select(C("ref").alias("p_ref"), C("v").alias("p_v"), D.text(v, "target[0].reference").alias("ref"))
    # As many as device uses, which the planner takes for few.
    j = use.join(lineage.hint("merge"), "ref", "left")
    ok = j.where("p_ref is not null")
    listed = F.concat(F.lit("["), F.array_join("good", ","), F.lit("]"))
    kept = F.when(F.size("good") > 0, D.with_fields(v, F.create_map(F.lit("basedOn"), listed))).otherwise(D.object_json(F.map_filter(D.json_fields(v), lambda k, _: k != "basedOn")))
    moved = F.transform("bad", lambda b: F.concat(F.lit('{"role":"source","what":'), b, F.lit("}")))
    entity = F.concat(F.lit("["), F.array_join(F.concat(F.transform(D.values_at(C("p_v"), "entity"), lambda x: F.to_json(x)), moved), ","), F.lit("]"))
    docs = ok.select("ref", kept.alias("doc")).unionByName(ok.select(C("p_ref").alias("ref"), D.with_fields(C("p_v"), F.create_map(F.lit("entity"), entity)).alias("doc")))
    repairs = j.select("ref", F.when(C("p_ref").isNull(), "no_lineage").otherwise("device_order_link_in_provenance").alias("repair"), F.array(F.lit("basedOn")).alias("fields"))
    return docs, repairs


def replace_documents(resources: DataFrame, fixed: DataFrame) -> DataFrame:
    """(ref, doc) with repaired bodies in place of the old ones."""
    f = fixed.select("ref", C("doc").alias("_new"))
    return resources.select("ref", "doc").join(f, "ref", "left").select("ref", F.coalesce("_new", "doc").alias("doc"))


def refresh_steps(steps: Column, family: Column, sent_on: Column) -> Column:
    """Searches get an explicit page of 50, message lookups the date, source-profile lists their tag."""
    tag = D.ORIGIN_SYSTEM + "|source-profile"

    def path(s: Column) -> Column:
        p = F.when((s.method == "GET") & s.path.contains("?") & ~s.path.contains("_count="), F.concat(s.path, F.lit("&_count=50"))).otherwise(s.path)
        p = F.when((family == "message_followup") & p.startswith("Communication?"), F.concat(p, F.lit("&sent=eq"), F.substring(sent_on, 1, 10))).otherwise(p)
        listing = family.isin("documented_home_medications", "documented_conditions") & p.rlike(r"^(MedicationStatement|Condition)\?")
        return F.when(listing, F.concat(p, F.lit("&_tag=" + tag))).otherwise(p)

    return F.transform(steps, lambda s: s.withField("path", path(s)))


def refresh_trend_gold(tasks: DataFrame, trend: DataFrame) -> DataFrame:
    """Exhaustive trend answers recomputed from the corpus: (task_id, n, date, value, unit, ref) rows of all tasks.

    ``trend`` is ``library.lab_trend`` over the merged corpus, ``tasks`` (task_id, patient_ref, start, end).
    """
    j = tasks.join(trend, "patient_ref").where((C("date") >= C("start")) & (C("date") <= C("end")))
    return j.select("task_id", "n", "date", "value", "unit", "resource_ref")


def pair_names(patients: DataFrame, shard: str, key: str) -> DataFrame:
    """Two consecutive patients of a shard share a name."""
    r = range_ranked(patients, [shard], [C(key), F.xxhash64(*patients.columns)], "_k")
    return r.withColumn("name", F.concat(F.lit("Jordan Synthetic"), C(shard).cast("string"), F.lit("Pair"), F.floor((C("_k") - 1) / 2).cast("string"))).drop("_k")


def rescale_timeline(events: DataFrame, plans: DataFrame, key: str = "patient_ref") -> DataFrame:
    """Planned days stretched and shifted by each patient's plan."""
    return events.join(plans.select(key, "stretch", "offset"), key).withColumn("day", C("day") * C("stretch") - C("offset")).drop("stretch", "offset")


SHARED = ("clinic", "clinic-location", "clinician", "clinician-role", "laboratory", "payer")


def entity_id(version: str, seed: int, scope: Column, site: Column, patient: Column, label: Column) -> Column:
    """Shared facilities take their id from the scope and site, everything else from the patient."""
    who = F.when(label.isin(*SHARED), F.concat_ws("/", scope, site.cast("string"))).otherwise(patient)
    return X.stable_id(F.lit(version), F.lit(seed), who, label)


def merge_corpus(originals: DataFrame, fixed: DataFrame, additions: DataFrame, ledger: DataFrame, deletable: DataFrame, recorded: str, agent_ref: str):
    """Originals with repairs, additions with narrative, Provenance for the additions; and the rows that forbid publishing.

    Every input but the ledger is (ref, doc); returns (corpus, problems) where problems is (ref, problem).
    """
    from chartloom.operators import checks
    from chartloom.plans.reports import merge_additions
    from chartloom.sources.ndjson import from_documents

    base = replace_documents(originals, fixed)
    lineage = emit_provenance(ledger.join(additions.select(C("ref").alias("resource_ref")), "resource_ref", "left_semi"), deletable, recorded, agent_ref)
    v = F.parse_json("doc")
    text = D.narrative(C("v"))
    told = additions.withColumn("v", v).withColumn("_t", text)
    body = F.to_json(F.struct(F.lit("generated").alias("status"), C("_t").alias("div")))
    added = told.select("ref", F.when(C("_t").isNotNull(), D.with_fields(C("v"), F.create_map(F.lit("text"), body))).otherwise(C("doc")).alias("doc"))
    provenance = lineage.withColumn("v", v).select(D.ref(D.text(C("v"), "resourceType"), D.text(C("v"), "id")).alias("ref"), "doc")
    corpus, clashes = merge_additions(base, added.unionByName(provenance))
    bad = checks.graph_violations(from_documents(corpus.select("doc")))
    problems = clashes.select("ref", C("clash").alias("problem")).unionByName(bad.select("ref", C("rule").alias("problem")))
    return corpus, problems
