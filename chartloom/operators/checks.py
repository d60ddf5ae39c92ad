"""Integrity and conformance checks: each returns the rows that break a rule, as (ref, rule, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.operators import edges as G
from chartloom.session import checkpointed



def _rows(df: DataFrame, rule: str, detail: Column | None = None, ref: str = "ref") -> DataFrame:
    d = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(F.col(ref).alias("ref"), F.lit(rule).alias("rule"), d.alias("detail"))


def duplicate_identity(resources: DataFrame) -> DataFrame:
    n = resources.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows(n, "duplicate_identity", F.col("n"))


def multi_patient(resources: DataFrame) -> DataFrame:
    owned = resources.select("ref", D.owners(F.col("v")).alias("owners")).where(F.size("owners") > 1)
    return _rows(owned, "multi_patient", F.array_join(F.array_sort("owners"), ","))


def broken_references(resources: DataFrame, edge_rows: DataFrame) -> DataFrame:
    return _rows(G.broken_refs(edge_rows, resources), "broken_reference", F.col("dst_ref"), "src_ref")


def cross_patient_references(resources: DataFrame, edge_rows: DataFrame) -> DataFrame:
    return _rows(G.cross_patient_refs(edge_rows, resources), "cross_patient_reference", F.col("dst_ref"), "src_ref")


def team_on_behalf(resources: DataFrame) -> DataFrame:
    """``onBehalfOf`` needs a Practitioner member."""
    bad = F.exists(
        D.values_at(F.col("v"), "participant"),
        lambda p: ~D.falsy(p, "onBehalfOf") & ~F.coalesce(D.text(p, "member.reference").startswith("Practitioner/"), F.lit(False)),
    )
    return _rows(resources.where("resource_type = 'CareTeam'").where(bad), "team_on_behalf")


def list_dates(resources: DataFrame) -> DataFrame:
    """Entry dates are for working lists only."""
    dated = F.exists(D.values_at(F.col("v"), "entry"), lambda e: ~D.falsy(e, "date"))
    mode = F.coalesce(D.text(F.col("v"), "mode"), F.lit(""))
    return _rows(resources.where("resource_type = 'List'").where(dated & (mode != "working")), "list_dates")


def _interval_bad(start: Column, end: Column) -> Column:
    s, e = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    return ((s == "") != (e == "")) | ((s != "") & (s >= e))


def intervals(slots_and_appointments: DataFrame) -> DataFrame:
    """Slot and Appointment rows (resource_ref, start, end): both ends or neither, start before end."""
    bad = _interval_bad(F.col("start"), F.col("end"))
    return _rows(slots_and_appointments.where(bad), "interval", F.concat_ws("..", "start", "end"), "resource_ref")


def slot_containment(appointments: DataFrame, slots: DataFrame) -> DataFrame:
    """A booked appointment needs a reserved slot that contains it; an absent slot is not reserved."""
    s = slots.select(
        F.col("resource_ref").alias("slot_ref"), F.col("status").alias("s_status"), F.col("start").alias("s_start"), F.col("end").alias("s_end")
    )
    booked = appointments.where("status = 'booked' and slot_ref is not null").join(s.hint("merge"), "slot_ref", "left")
    reserved = F.coalesce(F.col("s_status").isin("busy", "busy-tentative"), F.lit(False))
    outside = (F.col("start") < F.col("s_start")) | (F.col("end") > F.col("s_end"))
    detail = F.when(~reserved, "not reserved").when(outside, "outside slot")
    return _rows(booked.withColumn("detail", detail).where("detail is not null"), "slot_containment", F.col("detail"), "resource_ref")


def double_booking(appointments: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots held by several booked appointments without being marked overbooked."""
    held = (
        appointments.where("status = 'booked' and slot_ref is not null").groupBy("slot_ref")
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    over = slots.where("overbooked").select(F.col("resource_ref").alias("slot_ref"))
    return _rows(held.join(over.hint("merge"), "slot_ref", "left_anti"), "double_booking", F.col("n"), "slot_ref")


def value_and_absent(resources: DataFrame) -> DataFrame:
    """An Observation has a value or the reason it has none, not both."""
    valued = F.exists(F.map_keys(D.fields(F.col("v"))), lambda k: k.startswith("value"))
    return _rows(resources.where("resource_type = 'Observation'").where(~D.falsy(F.col("v"), "dataAbsentReason") & valued), "value_and_absent")


def occurrence_choice(resources: DataFrame) -> DataFrame:
    both = D.falsy(F.col("v"), "occurrenceDateTime") == D.falsy(F.col("v"), "occurrenceString")
    return _rows(resources.where("resource_type = 'Immunization'").where(both), "occurrence_choice")


def handover_order(dispenses: DataFrame) -> DataFrame:
    """Rows (resource_ref, prepared, handed_over): handed over no earlier than prepared."""
    bad = (F.col("prepared") != "") & (F.col("handed_over") != "") & (F.col("prepared") > F.col("handed_over"))
    return _rows(dispenses.where(bad), "handover_order", F.concat_ws(">", "prepared", "handed_over"), "resource_ref")


def episode_rules(observations: DataFrame, specimens: DataFrame, orders: DataFrame, reports: DataFrame) -> DataFrame:
    """Links and order of the laboratory chain.

    ``observations`` (resource_ref, status, date, based_on_ref, specimen_ref), ``specimens`` (resource_ref, status,
    request_ref, collected, received), ``orders`` (resource_ref, date), ``reports`` (resource_ref, based_on_ref, result_ref).
    """
    sp = specimens.select(
        F.col("resource_ref").alias("specimen_ref"), F.col("status").alias("sp_status"), F.col("request_ref"), "collected", "received"
    )
    o = observations.join(sp, "specimen_ref")
    usable = F.col("status").isin("final", "corrected", "amended")
    rules = {
        "specimen_of_other_order": F.col("request_ref") != F.col("based_on_ref"),
        "result_from_rejected_specimen": usable & (F.col("sp_status") == "unsatisfactory"),
        "result_before_collection": F.col("date") < F.col("collected"),
    }
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    found = o.select(F.col("resource_ref").alias("ref"), F.explode(named).alias("rule"), F.col("specimen_ref").alias("detail"))
    early = specimens.where("received < collected")
    ordered = orders.select(F.col("resource_ref").alias("request_ref"), F.col("date").alias("ordered"))
    before = specimens.join(ordered, "request_ref").where("collected < ordered")
    results = reports.where("result_ref is not null").select("resource_ref", F.col("based_on_ref").alias("order_ref"), "result_ref")
    of = observations.select(F.col("resource_ref").alias("result_ref"), "based_on_ref")
    unlike = results.join(of, "result_ref").where("order_ref <> based_on_ref")
    parts = [
        found,
        _rows(early, "received_before_collected", None, "resource_ref"),
        _rows(before, "collected_before_ordered", None, "resource_ref"),
        _rows(unlike, "report_of_other_order", F.col("result_ref"), "resource_ref"),
    ]
    return reduce(DataFrame.unionByName, parts)


def dispense_links(dispenses: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Dispenses (resource_ref, patient_ref, prescription_ref) whose prescription is absent or another patient's."""
    p = prescriptions.select(F.col("resource_ref").alias("prescription_ref"), F.col("patient_ref").alias("owner"))
    j = dispenses.join(p, "prescription_ref", "left").where("owner is null or owner <> patient_ref")
    return _rows(j, "dispense_link", F.col("prescription_ref"), "resource_ref")


# -- contracts ---------------------------------------------------------------------------

def _child_step(children, part: Column):
    return lambda x: children(x, part)


# A catalogue up to this many bytes is laid beside the documents; a larger one meets them in shares.
LOOKUP_BYTES = 8 * 1024 * 1024
# Documents of one type that meet a share of a larger catalogue.
SHARE_ROWS = 1_000_000


def beside_type(rows: DataFrame, catalogue: DataFrame, lookup_bytes: int = LOOKUP_BYTES, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Rows with what the catalogue (one row per ``resource_type``) says of their type.

    There are few types, so a join on the type would put the documents of one type into one task. The size of the catalogue is
    measured: up to ``lookup_bytes`` it is broadcast and no document moves; beyond, types are cut into shares by their counts.
    """
    size = catalogue.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= lookup_bytes:
        return rows.join(F.broadcast(catalogue), "resource_type")
    counts = rows.groupBy("resource_type").agg(F.ceil(F.count(F.lit(1)) / share_rows).cast("int").alias("_shares"))
    shares = checkpointed(catalogue.select("resource_type").join(counts, "resource_type"))
    split = rows.join(shares, "resource_type").withColumn("_share", F.pmod(F.xxhash64("ref"), F.col("_shares")).cast("int")).drop("_shares")
    copies = catalogue.join(shares, "resource_type").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return split.join(copies, ["resource_type", "_share"]).drop("_share")


def contract_violations(resources: DataFrame, contracts: DataFrame, depth: int | None = None, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """Cardinality, scalar-or-list, choice exclusivity and legal reference targets at nested paths.

    ``contracts`` has (type, path, min, max, types, targets). The rules of a type are gathered by parent path (a
    catalogue has a few per parent), so a document meets its catalogue entry once; all rules of a parent are then
    evaluated inside the row.
    """
    parent_path = F.slice("path", F.lit(1), F.size("path") - 1)
    field = F.element_at("path", -1)
    choices = F.transform("types", lambda t: F.concat(F.regexp_replace(field, r"\[x\]$", ""), F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))
    names = F.when(field.endswith("[x]"), choices).otherwise(F.array(field))
    rule = F.struct("path", "min", "max", "types", "targets", names.alias("names"))
    by_parent = contracts.groupBy(F.col("type").alias("resource_type"), parent_path.alias("parent")).agg(F.collect_list(rule).alias("rules"))
    entries = checkpointed(by_parent.groupBy("resource_type").agg(F.collect_list(F.struct("parent", "rules")).alias("parents")))
    if depth is None:
        # As deep as the catalogue goes: one number from a small table.
        depth = max(1, entries.agg(F.max(F.array_max(F.transform("parents", lambda p: F.size(p.parent))))).first()[0] or 0)
    rows = beside_type(resources.select("ref", "resource_type", "v"), entries, lookup_bytes)
    rows = rows.select("ref", "v", F.explode("parents").alias("_e")).select("ref", "v", "_e.*")

    def children(x: Column, part: Column) -> Column:
        stem = F.regexp_replace(part, r"\[x\]$", "")
        entries = F.filter(
            F.coalesce(F.map_entries(D.fields(x)), F.array().cast("array<struct<key:string,value:variant>>")),
            lambda e: F.when(part.endswith("[x]"), e.key.startswith(stem)).otherwise(e.key == part),
        )
        return F.flatten(F.transform(entries, lambda e: F.coalesce(D.items(e.value), F.array(e.value))))

    rows = rows.withColumn("_p", F.array("v"))
    for level in range(1, depth + 1):
        part = F.try_element_at("parent", F.lit(level))
        rows = rows.withColumn(
            "_p", F.when(F.size("parent") >= level, F.flatten(F.transform("_p", _child_step(children, part)))).otherwise(F.col("_p"))
        )
    # A generator makes the fields of an object once; a projection would be copied into the rules and made for each.
    objects = F.filter(F.transform("_p", D.fields), lambda o: o.isNotNull())
    rows = rows.select("ref", "rules", F.explode(objects).alias("_all"))
    bare = lambda k: F.regexp_replace(k, "^_", "")
    none = F.array().cast("array<variant>")
    listed = lambda x: F.coalesce(D.items(x), F.array(x))

    def one_name(r: Column) -> Column:
        """A rule of one name looks its key and the underscored twin up."""
        name = r["names"][0]
        x = F.try_element_at("_all", name)
        keys = F.map_contains_key("_all", name) | F.map_contains_key("_all", F.concat(F.lit("_"), name))
        return F.struct(
            r.alias("r"), keys.cast("int").alias("keys"), D.items(x).isNotNull().alias("listed"),
            F.when(F.map_contains_key("_all", name), listed(x)).otherwise(none).alias("values"),
        )

    def choice(r: Column) -> Column:
        entries = F.filter(F.map_entries("_all"), lambda e: F.array_contains(r["names"], bare(e.key)))
        plain = F.filter(entries, lambda e: ~e.key.startswith("_"))
        return F.struct(
            r.alias("r"), F.size(F.array_distinct(F.transform(entries, lambda e: bare(e.key)))).alias("keys"),
            F.exists(plain, lambda e: D.items(e.value).isNotNull()).alias("listed"),
            F.flatten(F.transform(plain, lambda e: listed(e.value))).alias("values"),
        )

    # A name that starts with an underscore is also what other keys are without theirs.
    simple = lambda r: (F.size(r["names"]) == 1) & ~r["names"][0].startswith("_")
    facts = F.transform("rules", lambda r: F.when(simple(r), one_name(r)).otherwise(choice(r)))

    def broken(f: Column) -> Column:
        r = f.r
        # A key present only through its underscored twin counts as one value.
        n = F.when((F.size(f["values"]) == 0) & (f["keys"] > 0), 1).otherwise(F.size(f["values"]))
        bounded = (F.coalesce(F.size(r.targets), F.lit(0)) > 0) & ~F.array_contains(r.targets, "Resource")
        refs = F.flatten(F.transform(f["values"], lambda x: D.references(F.to_json(x))))
        wrong = F.filter(refs, lambda x: ~x.rlike(G.EXTERNAL) & ~F.array_contains(r.targets, F.substring_index(x, "/", 1)))
        first_wrong = F.when(bounded, F.try_element_at(wrong, F.lit(1)))
        found = F.array_compact(F.array(
            F.when((r["max"] == "1") & f.listed, F.lit("list_for_scalar")),
            F.when(f["keys"] > 1, F.lit("multiple_choices")),
            F.when((n < r["min"]) | ((r["max"] != "*") & (n > r["max"].try_cast("int"))), F.concat(F.lit("cardinality="), n.cast("string"))),
            F.concat(F.lit("target="), first_wrong),
        ))
        return F.transform(found, lambda x: F.struct(F.array_join(r.path, ".").alias("path"), x.alias("violation")))

    return rows.select("ref", F.explode(F.flatten(F.transform(facts, broken))).alias("b")).select("ref", "b.*")


def root_contract_violations(resources: DataFrame, contracts: DataFrame) -> DataFrame:
    """The same at root level only."""
    return contract_violations(resources, contracts.where(F.size("path") == 1), depth=1)


def shape_violations(resources: DataFrame, shapes: DataFrame) -> DataFrame:
    """Unknown top-level fields, wrong JSON kinds and missing required fields.

    ``shapes`` has (resource_type, fields map<name, kind>, required array<string>) where kind is a prefix of
    the field's schema: STRING, BIGINT, BOOLEAN, OBJECT, ARRAY, ...
    """
    j = beside_type(resources.select("ref", "resource_type", "v"), checkpointed(shapes)).withColumn("m", D.fields(F.col("v")))
    entries = F.map_entries("m")
    unknown = F.filter(F.map_keys("m"), lambda k: ~F.map_contains_key("fields", k) & ~k.startswith("_"))
    numeric = lambda s: s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT", "BIGINT")
    kind_ok = lambda e: F.schema_of_variant(e.value).startswith(F.try_element_at("fields", e.key)) | (
        (F.try_element_at("fields", e.key) == "NUMBER") & numeric(F.schema_of_variant(e.value))
    )
    wrong = F.filter(entries, lambda e: F.map_contains_key("fields", e.key) & ~kind_ok(e))
    missing = F.array_except("required", F.map_keys("m"))
    tag = lambda name, arr: F.transform(arr, lambda k: F.concat(F.lit(name + ":"), k))
    every = F.concat(tag("unknown", unknown), tag("kind", F.transform(wrong, lambda e: e.key)), tag("missing", missing))
    return j.select("ref", F.explode(every).alias("violation"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Counts that differ between two sides, absent counts read as zero."""
    l, r = left.withColumnRenamed(value, "left_n"), right.withColumnRenamed(value, "right_n")
    j = l.join(r, keys, "full").na.fill(0, ["left_n", "right_n"])
    return j.where("left_n <> right_n")


def graph_violations(resources: DataFrame) -> DataFrame:
    """All whole-graph rules at once; a chart is valid when this is empty."""
    e = G.edges(resources)
    typed = lambda kind: resources.where(F.col("resource_type") == kind)
    at = lambda p: D.text(F.col("v"), p)
    appts = typed("Appointment").select(
        F.col("ref").alias("resource_ref"), at("status").alias("status"), at("start").alias("start"), at("end").alias("end"),
        F.explode_outer(D.references_in(F.col("v"), "slot")).alias("slot_ref"),
    )
    slots = typed("Slot").select(
        F.col("ref").alias("resource_ref"), at("status").alias("status"), at("start").alias("start"), at("end").alias("end"),
        F.coalesce(D.get(F.col("v"), "overbooked", "boolean"), F.lit(False)).alias("overbooked"),
    )
    dispenses = typed("MedicationDispense").select(
        F.col("ref").alias("resource_ref"), F.coalesce(at("whenPrepared"), F.lit("")).alias("prepared"),
        F.coalesce(at("whenHandedOver"), F.lit("")).alias("handed_over"),
    )
    spans = appts.select("resource_ref", "start", "end").distinct().unionByName(slots.select("resource_ref", "start", "end"))
    parts = [
        duplicate_identity(resources), multi_patient(resources), broken_references(resources, e),
        cross_patient_references(resources, e), team_on_behalf(resources), list_dates(resources), intervals(spans),
        slot_containment(appts, slots), double_booking(appts, slots), value_and_absent(resources),
        occurrence_choice(resources), handover_order(dispenses),
    ]
    return reduce(DataFrame.unionByName, parts)
