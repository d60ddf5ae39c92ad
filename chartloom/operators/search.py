"""The search language: one query as Column filters, or many queries as one join.

``Type?k=v&k2=v2``; repeated keys are ANDed, commas inside one value are ORed, unknown keys are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions import text as X
from chartloom.functions.ranks import range_ranked
from chartloom.session import checkpointed, staged
from chartloom.sources.ndjson import parsed_once
from chartloom.operators import catalogue as C

DAY_PREDICATE = r"^(eq|ne|gt|ge|lt|le)?(\d{4}-\d{2}-\d{2})$"


class SearchError(ValueError):
    """A query outside the supported language."""


@dataclass(frozen=True)
class Query:
    kind: str
    pairs: tuple[tuple[str, str], ...]
    includes: tuple[str, ...]
    sort: str
    count: int
    page: int

    @property
    def next_page(self) -> str:
        rest = [(k, v) for k, v in self.pairs if k != "_page"] + [("_page", str(self.page + 1))]
        return f"{self.kind}?{urlencode(rest)}"


def read_query(url: str) -> Query:
    """Check a query string against the catalogue; the last duplicate of a control wins."""
    parts = urlsplit(url)
    kind = parts.path.strip("/")
    pairs = tuple(parse_qsl(parts.query, keep_blank_values=True))
    if kind not in C.PARAMS:
        raise SearchError(f"unsupported resource: {kind}")
    for key, value in pairs:
        base, _, modifier = key.partition(":")
        if key == "patient.identifier":
            if "patient" not in C.PARAMS[kind]:
                raise SearchError("patient chaining is not supported for this resource")
        elif key == "_include":
            if value not in C.INCLUDES or not value.startswith(kind + ":"):
                raise SearchError(f"unsupported include: {value}")
        elif key not in C.COMMON and (base not in C.PARAMS[kind] or (modifier and modifier != "missing")):
            raise SearchError(f"unsupported parameter: {key}")
    last = dict(pairs)
    sort, count, page = last.get("_sort", "_id"), int(last.get("_count", "10")), int(last.get("_page", "0"))
    if sort.removeprefix("-") not in ("date", "_id"):
        raise SearchError("sort by date or _id")
    if not 1 <= count <= 50 or not 0 <= page <= 10000:
        raise SearchError("invalid page size or offset")
    return Query(kind, pairs, tuple(v for k, v in pairs if k == "_include"), sort, count, page)


# -- predicates --------------------------------------------------------------------------

def date_predicate(value: Column, search: str) -> Column:
    """Day precision; a missing date never matches, not even ``ne``."""
    m = re.fullmatch(DAY_PREDICATE, search)
    if not m:
        raise SearchError("only day-precision date predicates are supported")
    op, day = m.group(1) or "eq", m.group(2)
    d = F.substring(value, 1, 10)
    compare = {"eq": d == day, "ne": d != day, "gt": d > day, "ge": d >= day, "lt": d < day, "le": d <= day}[op]
    return (d != "") & compare


def reference_predicate(refs: Column, value: str) -> Column:
    """Full ``Type/id`` or the bare id."""
    return F.exists(refs, lambda r: (r == value) | (F.element_at(F.split(r, "/"), -1) == value))


def reference_field(kind: str, base: str) -> str:
    return "providedBy" if (kind, base) == ("HealthcareService", "organization") else C.REFERENCE_FIELDS[base]


def code_field(kind: str, base: str) -> str:
    if base == "code" and kind in C.MEDICATION_CODED:
        return "codeCodeableConcept" if kind == "DeviceRequest" else "medicationCodeableConcept"
    return C.TOKEN_FIELDS.get(base, base)


def predicate(kind: str, key: str, value: str) -> Column:
    """One ``key=value`` choice as a Column over (id, patient_ref, resource_date, v)."""
    v = F.col("v")
    base, _, modifier = key.partition(":")
    if modifier == "missing":
        if value not in ("true", "false"):
            raise SearchError("missing takes true or false")
        gone = D.falsy(v, C.missing_field(base))
        return gone if value == "true" else ~gone
    if base == "_id":
        return F.col("id") == value
    if base == "_tag":
        return D.token_match(D.tokens_at(v, "meta.tag"), value)
    if base == "patient":
        target = value if "/" in value else f"Patient/{value}"
        if kind == "Appointment":
            actors = F.transform(D.values_at(v, "participant"), lambda p: D.text(p, "actor.reference"))
            return F.array_contains(actors, target)
        return F.col("patient_ref") == target
    if base == "name":
        return F.exists(D.name_text(v), lambda n: n.contains(value.lower()))
    if base == "birthdate":
        return date_predicate(F.coalesce(D.text(v, "birthDate"), F.lit("")), value)
    if base in C.DATE_PARAMS:
        return date_predicate(F.col("resource_date"), value)
    if base in C.REFERENCE_FIELDS:
        return reference_predicate(D.references_in(v, reference_field(kind, base)), value)
    if base == "code" and kind in C.MEDICATION_CODED:
        return D.token_match(F.coalesce("_medication_tokens", D.tokens_at(v, code_field(kind, base))), value)
    return D.token_match(D.tokens_at(v, code_field(kind, base)), value)


def with_medication_tokens(df: DataFrame, resources: DataFrame) -> DataFrame:
    """Codes of the medication a row refers to; NULL when the target is absent (then the inline concept counts)."""
    meds = resources.where("resource_type = 'Medication'").select(
        F.col("ref").alias("_medication_ref"), D.tokens_at(F.col("v"), "code").alias("_medication_tokens")
    )
    keyed = df.withColumn("_target", D.text(F.col("v"), "medicationReference.reference"))
    return keyed.join(meds, F.col("_target") == F.col("_medication_ref"), "left").drop("_target", "_medication_ref")


def matches(resources: DataFrame, query: str | Query) -> DataFrame:
    """All rows a query selects, before sorting and paging."""
    q = read_query(query) if isinstance(query, str) else query
    df = resources.where(F.col("resource_type") == q.kind)
    extra = q.kind in C.MEDICATION_CODED and any(k == "code" for k, _ in q.pairs)
    if extra:
        df = with_medication_tokens(df, resources)
    for key, value in q.pairs:
        if key in C.CONTROLS:
            continue
        if key == "patient.identifier":
            owners = resources.where("resource_type = 'Patient'").where(predicate("Patient", "identifier", value))
            df = df.join(owners.select(F.col("ref").alias("patient_ref")), "patient_ref", "left_semi")
            continue
        choices = [predicate(q.kind, key, c) for c in value.split(",")]
        any_of = choices[0]
        for c in choices[1:]:
            any_of = any_of | c
        df = df.where(any_of)
    return (df.drop("_medication_tokens") if extra else df).select(*resources.columns)


def sort_columns(sort: str) -> list[Column]:
    """Ties keep stored order, also when descending; dates sort by their full text."""
    key = F.col("resource_date" if sort.endswith("date") else "id")
    return [key.desc() if sort.startswith("-") else key.asc(), F.col("pos").asc()]


def page_of(found: DataFrame, q: Query) -> DataFrame:
    ordered = found.orderBy(*sort_columns(q.sort))
    page = ordered.offset(q.page * q.count).limit(q.count) if q.page else ordered.limit(q.count)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page.withColumn("total", total).withColumn(
        "next_page", F.when(F.col("total") > (q.page + 1) * q.count, F.lit(q.next_page))
    )


def follow(page: DataFrame, resources: DataFrame, includes, by: tuple[str, ...] = ()) -> DataFrame:
    """Targets of the include directives of a page: distinct, present, not already on the page."""
    v = F.col("v")
    wanted = F.flatten(F.array(*[D.references_in(v, C.INCLUDES[i]) for i in includes]))
    targets = page.select(*by, F.explode(wanted).alias("ref")).distinct()
    fresh = targets.join(page.select(*by, "ref"), [*by, "ref"], "left_anti")
    return fresh.join(resources, "ref").withColumn("mode", F.lit("include"))


def search(resources: DataFrame, query: str) -> DataFrame:
    """One page of results with ``total``, ``next_page`` and ``mode`` (match or include)."""
    q = read_query(query)
    page = page_of(matches(resources, q), q).withColumn("mode", F.lit("match"))
    if not q.includes:
        return page
    more = follow(page, resources, q.includes)
    return page.unionByName(more.select(*resources.columns, "mode"), allowMissingColumns=True)


def read_by_id(requests: DataFrame, resources: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Status of direct reads: 200 present, 410 deleted, 404 never there."""
    here = resources.select("ref", F.lit(True).alias("_here"))
    gone = tombstones.select("ref").distinct().select("ref", F.lit(True).alias("_gone"))
    joined = requests.join(here, "ref", "left").join(gone, "ref", "left")
    status = F.when(F.col("_gone"), 410).when(F.col("_here"), 200).otherwise(404)
    return joined.withColumn("status", status).drop("_here", "_gone")


def hide(resources: DataFrame, omit: DataFrame) -> DataFrame:
    """Leave out the refs hidden from a task."""
    return resources.join(omit.select("ref"), "ref", "left_anti")


# -- many queries at once ----------------------------------------------------------------

def fields_asked(parsed: DataFrame) -> set[str]:
    """What the predicates of queries that ``read_queries`` has read look at; ``:missing`` stands for which fields are there."""
    p = parsed.where("error is null").select(F.explode("predicates").alias("p"))
    names = F.when(F.col("p.key").endswith(":missing"), F.array(F.lit(":missing"))).when(
        F.col("p.key") == "patient.identifier", F.array(F.lit("identifier"), F.lit("patient"))
    ).otherwise(F.array("p.field", "p.base"))
    # Names of the catalogue: as many as it has.
    return {r[0] for r in p.select(F.explode(names)).distinct().collect()}


def search_index(resources: DataFrame, keep: tuple[str, ...] = (), asked: set[str] | None = None) -> DataFrame:
    """One row per resource with everything a predicate can look at; ``keep`` carries further columns along.

    With ``asked`` (``fields_asked``) it holds only what these queries look at; other lists are empty.
    """
    v, kind = F.col("v"), F.col("resource_type")
    wants = lambda f: asked is None or f in asked
    concept = F.when(kind == "DeviceRequest", "codeCodeableConcept").when(kind.isin(*C.MEDICATION_CODED), "medicationCodeableConcept").otherwise("code")
    concepts = ("code", "codeCodeableConcept", "medicationCodeableConcept")
    # The few fields that hold tokens are looked up; a map of all fields would copy every value of the document.
    names = [f for f in sorted({*concepts, *C.TOKEN_FIELDS.values()}) if wants("code" if f in concepts else f)]
    mine = lambda s, f: F.when(concept == f, s[f]) if f in concepts else s[f]
    entry = lambda s, f: F.struct(F.lit(f).alias("key"), mine(s, f).alias("value"))
    nothing = F.array().cast(f"array<struct<field:string,{D.TOKEN.removeprefix('struct<')}>")
    coded = F.array().cast("array<struct<key:string,value:variant>>") if not names else D.once(
        D.looked_up(v, **{f: "variant" for f in names}), lambda s: F.filter(F.array(*[entry(s, f) for f in names]), lambda e: e.value.isNotNull())
    )
    tokens = F.transform(
        coded,
        lambda e: F.transform(
            F.flatten(F.transform(F.coalesce(D.items(e.value), F.array(e.value)), D.token_values)),
            lambda t: F.struct(
                F.when(e.key.isin(*concepts), "code").otherwise(e.key).alias("field"),
                t.system.alias("system"), t.code.alias("code"), t.plain.alias("plain"),
            ),
        ),
    )
    field_of = lambda k: F.when((k == "providedBy") & (kind == "HealthcareService"), "organization").otherwise(k)
    links = [f for f in dict.fromkeys(C.REFERENCE_FIELDS.values()) if wants(f)]
    linked = lambda entries: F.filter(entries, lambda e: field_of(e.key).isin(*links))
    targets = lambda entries: F.transform(
        linked(entries),
        lambda e: F.transform(D.references(F.to_json(e.value)), lambda r: F.struct(field_of(e.key).alias("field"), r.alias("target"))),
    )
    tags = F.transform(
        D.tokens_at(v, "meta.tag"),
        lambda t: F.struct(F.lit("_tag").alias("field"), t.system.alias("system"), t.code.alias("code"), t.plain.alias("plain")),
    )
    actors = F.filter(
        F.transform(D.values_at(v, "participant"), lambda p: D.text(p, "actor.reference")), lambda r: r.isNotNull()
    )
    owned = F.when(kind == "Appointment", actors).when(F.col("patient_ref").isNotNull(), F.array("patient_ref"))
    none = F.array().cast("array<string>")
    present = lambda entries: F.transform(F.filter(entries, lambda e: ~D.empty(e.value)), lambda e: e.key)
    # The fields are made a list once for both; a projection of its own, so that who asks for neither does not pay for it.
    no_links = F.array().cast("array<struct<field:string,target:string>>")
    both = lambda x: F.struct(
        (F.flatten(targets(x)) if links else no_links).alias("targets"), (present(x) if wants(":missing") else none).alias("present")
    )
    written = D.once(F.map_entries(D.fields(v)), both) if links or wants(":missing") else F.struct(no_links.alias("targets"), none.alias("present"))
    found = F.concat(F.flatten(tokens) if names else nothing, tags if wants("_tag") else nothing)
    # Behind a generator: a filter on the list, which Spark infers where it is exploded, would make it again.
    flat = parsed_once(resources, found, "tokens").select(
        *keep,
        "ref",
        "resource_type",
        "id",
        "resource_date",
        "pos",
        F.coalesce(owned, none).alias("owners"),
        "patient_ref",
        "tokens",
        written.alias("_written"),
        (D.name_text(v) if wants("name") else none).alias("names"),
        (F.coalesce(D.text(v, "birthDate"), F.lit("")) if wants("birthdate") else F.lit("")).alias("birth_date"),
        F.when(kind.isin(*C.MEDICATION_CODED), D.text(v, "medicationReference.reference")).alias("_target"),
    )
    shown = [c for c in flat.columns if c not in ("_written", "names", "birth_date", "_target")]
    flat = flat.select(*shown, "_written.targets", "names", "birth_date", "_written.present", "_target")
    return _medication_codes(flat, keep)


def _medication_codes(flat: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Where the medication a row refers to is present, its code tokens replace the inline concept."""
    of_code = lambda t: t.field == "code"
    meds = flat.where("resource_type = 'Medication'").select(
        *[F.col(k).alias("_m_" + k) for k in keep], F.col("ref").alias("_med"), F.filter("tokens", of_code).alias("_codes")
    )
    others = F.filter("tokens", lambda t: ~of_code(t))
    same = [F.col(k) == F.col("_m_" + k) for k in keep]
    joined = flat.join(meds, [F.col("_target") == F.col("_med"), *same], "left").drop(*["_m_" + k for k in keep])
    tokens = F.when(F.col("_med").isNotNull(), F.concat(others, "_codes")).otherwise(F.col("tokens"))
    return joined.withColumn("tokens", tokens).drop("_target", "_med", "_codes")


def _bare(r: Column) -> Column:
    return F.element_at(F.split(r, "/"), -1)


def read_queries(queries: DataFrame) -> DataFrame:
    """Parse (query_id, url) rows: kind, controls, predicates, and the first thing wrong, if any."""
    field_of = F.create_map(*[F.lit(x) for p, f in (C.TOKEN_FIELDS | C.REFERENCE_FIELDS).items() for x in (p, f)])
    params = F.create_map(*[x for k, ps in C.PARAMS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in ps]))])
    q = queries.withColumn("kind", X.url_path("url")).withColumn("pairs", X.query_pairs(F.col("url"), keep_blank=True))
    q = q.withColumn("allowed", F.try_element_at(params, F.col("kind")))
    last = lambda name, default: F.coalesce(
        F.try_element_at(F.transform(F.filter("pairs", lambda p: p.key == name), lambda p: p.value), F.lit(-1)), F.lit(default)
    )
    q = q.select(
        *queries.columns,
        "kind",
        "allowed",
        "pairs",
        last("_sort", "_id").alias("sort"),
        last("_count", "10").try_cast("int").alias("count"),
        last("_page", "0").try_cast("int").alias("page"),
        F.transform(F.filter("pairs", lambda p: p.key == "_include"), lambda p: p.value).alias("includes"),
        F.transform(
            F.filter("pairs", lambda p: ~p.key.isin(*C.CONTROLS)),
            lambda p: F.struct(
                p.key.alias("key"), p.value.alias("value"), F.substring_index(p.key, ":", 1).alias("base"),
                F.coalesce(F.try_element_at(field_of, F.substring_index(p.key, ":", 1)), F.substring_index(p.key, ":", 1)).alias("field"),
            ),
        ).alias("predicates"),
    )
    directive = F.create_map(*[F.lit(x) for k, f in C.INCLUDES.items() for x in (k, f)])
    base = lambda p: p.base
    known = lambda p: F.when(p.key.isin("_id", "_tag"), True).when(
        p.key == "patient.identifier", F.array_contains("allowed", "patient")
    ).otherwise(F.array_contains("allowed", base(p)) & (~p.key.contains(":") | p.key.endswith(":missing")))
    dated = lambda p: base(p).isin(*C.DATE_PARAMS) & ~p.key.contains(":")
    good_day = lambda p: F.forall(F.split(p.value, ","), lambda c: c.rlike(DAY_PREDICATE))
    error = (
        F.when(F.col("allowed").isNull(), "unsupported resource")
        .when(F.exists("predicates", lambda p: ~known(p)), "unsupported parameter")
        .when(
            F.exists("includes", lambda i: F.try_element_at(directive, i).isNull() | (F.substring_index(i, ":", 1) != F.col("kind"))),
            "unsupported include",
        )
        .when(~F.col("sort").isin("_id", "-_id", "date", "-date"), "unsupported sort")
        .when(~F.coalesce(F.col("count").between(1, 50) & F.col("page").between(0, 10000), F.lit(False)), "invalid page")
        .when(F.exists("predicates", lambda p: dated(p) & ~good_day(p)), "unsupported date predicate")
        .when(
            F.exists("predicates", lambda p: p.key.endswith(":missing") & ~p.value.isin("true", "false")), "unsupported missing value"
        )
    )
    return q.withColumn("error", error).drop("allowed", "pairs")


#: Rows of a posting list that meet their queries in one task.
SALT_ROWS = 50_000


def many(df: DataFrame) -> DataFrame:
    """There can be as many queries, tasks or documents as patients, and more: whatever the planner guesses from the size of compressed
    files, they are not sent to all tasks by way of the driver."""
    return df.hint("merge")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _row_matches(p: Column) -> Column:
    """Does the index row satisfy one predicate (any of its comma-separated choices)?"""
    base, field = p.base, p.field
    choices = F.when(p.key == "patient.identifier", F.array(p.value)).otherwise(F.split(p.value, ","))
    missing = F.when(base.isin(*[b for b in C.TOKEN_FIELDS if C.missing_field(b) == b]), base).otherwise(field)
    absent = ~F.array_contains("present", missing)
    day = F.substring(F.when(base == "birthdate", F.col("birth_date")).otherwise(F.col("resource_date")), 1, 10)

    def dated(c: Column) -> Column:
        op, d = F.regexp_extract(c, DAY_PREDICATE, 1), F.regexp_extract(c, DAY_PREDICATE, 2)
        compare = (
            F.when(op == "ne", day != d).when(op == "gt", day > d).when(op == "ge", day >= d)
            .when(op == "lt", day < d).when(op == "le", day <= d).otherwise(day == d)
        )
        return (day != "") & compare

    def one(c: Column) -> Column:
        mine = F.filter("tokens", lambda t: t.field == field)
        return (
            F.when(p.key.endswith(":missing"), absent == (c == "true"))
            .when(base == "_id", F.col("id") == c)
            .when(base == "patient", F.array_contains("owners", F.when(c.contains("/"), c).otherwise(F.concat(F.lit("Patient/"), c))))
            .when(base == "patient.identifier", F.lit(True))
            .when(base == "name", F.exists("names", lambda n: n.contains(F.lower(c))))
            .when(base.isin(*C.DATE_PARAMS), dated(c))
            .when(
                base.isin(*C.REFERENCE_FIELDS),
                F.exists("targets", lambda t: (t.field == field) & ((t.target == c) | (_bare(t.target) == c))),
            )
            .otherwise(D.token_match(mine, c))
        )

    return F.exists(choices, one)


def resolve_chains(good: DataFrame, index: DataFrame, world: list[str]) -> DataFrame:
    """Patients behind every ``patient.identifier`` predicate: adds ``chained``, one set per query.

    Two chained predicates in one query must both hold, so their sets are intersected by counting.
    """
    chained = good.select(
        "query_id",
        *world,
        F.posexplode(F.filter("predicates", lambda p: p.key == "patient.identifier")).alias("n", "p"),
        F.size(F.filter("predicates", lambda p: p.key == "patient.identifier")).alias("wanted"),
    ).withColumn("code", X.after_bar(F.col("p.value")))
    people = index.where("resource_type = 'Patient'").select(
        *[F.col(w).alias("_i_" + w) for w in world], "ref", F.filter("tokens", lambda t: t.field == "identifier").alias("ids")
    ).withColumn("id_", F.explode("ids"))
    same = [F.col(w) == F.col("_i_" + w) for w in world]
    hit = chained.join(many(people), [F.col("code") == F.col("id_.code"), *same]).where(D.token_match(F.array("id_"), F.col("p.value")))
    return (
        hit.groupBy("query_id", "ref").agg(F.countDistinct("n").alias("got"), F.first("wanted").alias("wanted"))
        .where("got = wanted").select("query_id", F.col("ref").alias("chain_ref"))
    )


def _day_codes(day: Column) -> Column:
    """What a date text is found by: itself, its month, its year, its century; texts of another form by one mark."""
    cut = lambda k, n: F.concat(F.lit(k), F.substring(day, 1, n))
    whole = F.array(cut("d", 10), F.when(F.length(day) >= 7, cut("m", 7)), cut("y", 4), cut("c", 2))
    shaped = day.rlike(r"^\d{4}(-\d\d(-\d\d)?)?$")
    return F.when(day == "", F.array().cast("array<string>")).when(shaped, F.array_compact(whole)).otherwise(F.array(F.lit("x")))


def _range_codes(low: Column, high: Column) -> Column:
    """Codes that cover all date texts from one day to another (null: open): days, months, years or centuries by the length of the
    range. They may cover a little more, never less."""
    none = F.array().cast("array<string>")
    first, last = F.try_to_timestamp(F.coalesce(low, F.lit("0000-01-01"))).cast("date"), F.try_to_timestamp(F.coalesce(high, F.lit("9999-12-31"))).cast("date")
    every = lambda kind, step, form: F.transform(
        F.sequence(F.trunc(first, kind) if kind else first, last, F.expr(f"interval {step}")), lambda d: F.date_format(d, form)
    )
    mark = lambda k, codes: F.transform(codes, lambda c: F.concat(F.lit(k), c))
    years = mark("y", every("year", "1 year", "yyyy"))
    centuries = F.transform(F.sequence((F.year(first) / 100).cast("int"), (F.year(last) / 100).cast("int")), lambda c: F.format_string("c%02d", c))
    # Texts that name only a month or a year sort before their days.
    short_years, short_months = mark("d", every("year", "1 year", "yyyy")), mark("d", every("month", "1 month", "yyyy-MM"))
    days = F.concat(mark("d", every(None, "1 day", "yyyy-MM-dd")), short_months, short_years)
    months = F.concat(mark("m", every("month", "1 month", "yyyy-MM")), short_years)
    span = F.datediff(last, first)
    # A day that is none in the calendar compares as a text: only the centuries are sure.
    bad = first.isNull() | last.isNull()
    all_centuries = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda c: F.format_string("c%02d", c))
    codes = (
        F.when(bad, all_centuries).when(span < 0, none).when(span <= 45, days).when(span <= 730, months).when(span <= 366 * 60, years).otherwise(centuries)
    )
    return F.concat(codes, F.array(F.lit("x")))


def _bounds(choice: Column) -> tuple[Column, Column, Column]:
    """Operator, lowest and highest day of a date choice; null where it is open."""
    op, day = F.regexp_extract(choice, DAY_PREDICATE, 1), F.regexp_extract(choice, DAY_PREDICATE, 2)
    return op, F.when(~op.isin("lt", "le", "ne"), day), F.when(~op.isin("gt", "ge", "ne"), day)


def postings(index: DataFrame, worlds: list[str] | None = None, fields: set[str] | None = None) -> DataFrame:
    """The slim index: resource_type, field, code, ref of everything that an equality, a date or a piece of a name can be looked up by,
    or of the given fields only."""
    of = lambda field, codes: F.transform(codes, lambda c: F.struct(F.lit(field).alias("field"), c.alias("code")))
    day = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 10)
    special = {
        "": lambda: F.array(F.lit("")), "_id": lambda: F.array("id"), "patient": lambda: F.transform("owners", _bare),
        "@date": lambda: _day_codes(day("resource_date")), "@birth": lambda: _day_codes(day("birth_date")),
        "@name": lambda: F.array_distinct(F.flatten(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: _grams(n)))),
    }
    parts = [of(k, made()) for k, made in special.items() if fields is None or k in fields]
    rest = None if fields is None else sorted(fields - {"", "_id", "@date", "@birth", "@name"})
    if rest is None or rest:
        mine = lambda t: F.lit(True) if rest is None else t.field.isin(*rest)
        parts.append(F.transform(F.filter("tokens", mine), lambda t: F.struct(t.field.alias("field"), X.after_bar(t.code).alias("code"))))
        parts.append(F.transform(F.filter("targets", mine), lambda t: F.struct(t.field.alias("field"), _bare(t.target).alias("code"))))
    entries = F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<struct<field:string,code:string>>")
    listed = parsed_once(index, entries, "_entries")
    return listed.select(*(worlds or []), "resource_type", "ref", F.explode("_entries").alias("e")).select(*(worlds or []), "resource_type", "ref", "e.*").where("code is not null")


def _lookups(good: DataFrame, chains: DataFrame, worlds: list[str]) -> DataFrame:
    """All ways to find a query's rows: (query_id, n, m, alt, field, code, owner).

    Every predicate n can be the anchor; all its choices m are then looked up, each by one of its alternatives, and an
    alternative by all its codes. A chain always is the anchor. The whole type is the last resort.
    """
    base, none = lambda p: p.base, F.array().cast("array<struct<field:string,codes:array<string>>>")
    way = lambda field, codes: F.struct(field.alias("field"), codes.alias("codes"))
    dated = lambda p: base(p).isin(*C.DATE_PARAMS) & ~p.key.contains(":")
    date_field = lambda p: F.when(base(p) == "birthdate", "@birth").otherwise("@date")

    def ways(p: Column, c: Column) -> Column:
        op, low, high = _bounds(c)
        pieces = F.filter(_grams(F.lower(c)), lambda g: F.length(g) == F.least(F.length(c), F.lit(3)))
        code = F.when(base(p) == "_id", c).when(base(p).isin("patient", *C.REFERENCE_FIELDS), _bare(c)).otherwise(X.after_bar(c))
        field = F.when(base(p) == "patient", "patient").otherwise(p.field)
        return (
            F.when(dated(p), F.array(way(date_field(p), _range_codes(low, high))))
            .when(base(p) == "name", F.transform(pieces, lambda g: way(F.lit("@name"), F.array(g))))
            .otherwise(F.array(way(field, F.array(code))))
        )

    keys = ["query_id", *worlds, "resource_type"]
    single = good.select(*keys, F.posexplode("predicates").alias("n", "p")).where(~F.col("p.key").endswith(":missing") & (F.col("p.key") != "patient.identifier"))
    each = single.select(*keys, "n", "p", F.posexplode(F.array_distinct(F.split("p.value", ","))).alias("m", "c"))
    found = each.select(*keys, "n", "m", F.posexplode(ways(F.col("p"), F.col("c"))).alias("alt", "w"))

    # Several bounds on one date are one range.
    plain = lambda kind: F.filter(
        "predicates", lambda p: dated(p) & (date_field(p) == kind) & ~p.value.contains(",") & ~p.value.startswith("ne")
    )
    ends = lambda kind, at, f: f(F.transform(plain(kind), lambda p: _bounds(p.value)[at]))
    ranges = None
    for k, kind in enumerate(("@date", "@birth")):
        several = good.where(F.size(plain(kind)) > 1).select(
            *keys, F.lit(10_000 + k).alias("n"), F.lit(0).alias("m"), F.lit(0).alias("alt"),
            way(F.lit(kind), _range_codes(ends(kind, 1, F.array_max), ends(kind, 2, F.array_min))).alias("w"),
        )
        ranges = several if ranges is None else ranges.unionByName(several)
    whole = good.select(*keys, F.lit(20_000).alias("n"), F.lit(0).alias("m"), F.lit(0).alias("alt"), way(F.lit(""), F.array(F.lit(""))).alias("w"))
    open_ = found.unionByName(ranges).unionByName(whole).select(*keys, "n", "m", "alt", F.col("w.field").alias("field"), F.explode("w.codes").alias("code"), F.lit(None).cast("string").alias("owner"))
    open_ = open_.join(many(_chained(good).select("query_id")), "query_id", "left_anti")
    tied = good.join(many(chains), "query_id").select(*keys, F.lit(-1).alias("n"), F.lit(0).alias("m"), F.lit(0).alias("alt"), F.lit("patient").alias("field"), _bare(F.col("chain_ref")).alias("code"), F.col("chain_ref").alias("owner"))
    return open_.unionByName(tied)


def _chained(good: DataFrame) -> DataFrame:
    return good.where(F.exists("predicates", lambda p: p.key == "patient.identifier"))


def batch_matches(queries: DataFrame, index: DataFrame, world: str | None = None, people: DataFrame | None = None) -> DataFrame:
    """(query_id, ref) of every match of every valid query.

    ``world`` names a column of both sides that keeps separate charts apart. ``people`` is the index whose patients a chain
    leads to, when that is another one, which all worlds share.

    Everything that can be looked up is a posting (field, code, ref). The posting lists of the fields that the queries ask for
    are counted, without their rows, and each query goes by the predicate with the fewest: an equality, a range of dates, a
    piece of a name. Only the fields chosen are then posted. Long lists are salted by their counts, so one held by a third
    of the rows is spread over many tasks, and only for what is found there the full row is read and all predicates are checked.
    """
    worlds = [world] if world else []
    # Queries may come as read already.
    parsed = queries if "predicates" in queries.columns else checkpointed(read_queries(queries))
    good = parsed.where("error is null").withColumnRenamed("kind", "resource_type")
    lookups = checkpointed(_lookups(good, resolve_chains(_chained(good), index if people is None else people, worlds if people is None else []), worlds))
    keys = [*worlds, "resource_type", "field", "code"]
    # Names of fields: as many as the catalogue has.
    fields = lambda df: {r[0] for r in df.select("field").distinct().collect()}
    sizes = postings(index, worlds, fields(lookups)).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))

    # A code without rows costs nothing: its predicate matches nothing.
    cost = lookups.join(many(sizes), keys, "left").withColumn("size", F.coalesce("size", F.lit(0))).repartition("query_id")
    code = F.struct("field", "code", "owner", "size")
    alts = cost.groupBy("query_id", "n", "m", "alt").agg(F.sum("size").alias("cost"), F.collect_list(code).alias("codes"))
    choices = alts.groupBy("query_id", "n", "m").agg(F.min(F.struct("cost", "alt", "codes")).alias("b"))
    anchors = choices.groupBy("query_id", "n").agg(F.sum("b.cost").alias("cost"), F.flatten(F.collect_list("b.codes")).alias("codes"))
    best = anchors.groupBy("query_id").agg(F.min(F.struct("cost", "n", "codes")).alias("b")).select("query_id", F.explode(F.array_distinct("b.codes")).alias("c"))
    wanted = checkpointed(
        good.select("query_id", *worlds, "resource_type", "predicates").join(many(best), "query_id").select("query_id", *worlds, "resource_type", "predicates", "c.*")
        .where("size > 0").withColumn("salts", F.ceil(F.col("size") / SALT_ROWS).cast("int"))
    )
    asked = postings(index, worlds, fields(wanted)).join(many(wanted.select(*keys, "salts").distinct()), keys)
    spread = asked.withColumn("salt", F.pmod(F.xxhash64("ref"), F.col("salts").cast("bigint")).cast("int")).drop("salts")
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "size")
    found = spread.join(many(salted), [*keys, "salt"]).select("query_id", *worlds, "ref", "predicates", "owner").dropDuplicates(["query_id", "ref"])
    read = index.join(many(found), ["ref", *worlds])
    kept = read.where(F.forall("predicates", _row_matches) & (F.col("owner").isNull() | (F.col("owner") == F.col("patient_ref"))))
    return kept.select("query_id", "ref", "id", "resource_date", "pos")


def batch_search(queries: DataFrame, resources: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Pages of many queries: (query_id, total, page_pos, ref, mode, more); a bad query gives none.

    ``queries`` has (query_id, url), or comes as read already. Includes follow the page and are appended with mode ``include``.
    """
    parsed = queries if "predicates" in queries.columns else checkpointed(read_queries(queries))
    index = checkpointed(search_index(resources, asked=fields_asked(parsed))) if index is None else index
    plan = parsed.where("error is null").select("query_id", "sort", "count", "page", "includes")
    found = checkpointed(batch_matches(parsed, index).join(many(plan), "query_id"))
    totals = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    by_date, down = F.col("sort").endswith("date"), F.col("sort").startswith("-")
    key = F.when(by_date, F.col("resource_date")).otherwise(F.col("id"))
    order = [F.when(~down, key).asc(), F.when(down, key).desc(), F.col("pos").asc(), F.col("ref").asc()]
    # Ranks by ranges, however deep the page: no query's rows meet in one task.
    rows = range_ranked(found, ["query_id"], order, "_rn")
    first = F.col("page") * F.col("count")
    page = rows.where((F.col("_rn") > first) & (F.col("_rn") <= first + F.col("count"))).join(many(totals), "query_id")
    matched = page.select(
        "query_id", "total", (F.col("_rn") - first).cast("int").alias("page_pos"), "ref", F.lit("match").alias("mode"),
        (F.col("total") > first + F.col("count")).alias("more"), "includes",
    )
    # Pages are read three times below.
    matched = checkpointed(matched)
    follows = matched.where(F.size("includes") > 0)
    # Only types that a query with includes searches are on its pages; as many as the catalogue has.
    kinds = [r[0] for r in parsed.where(F.col("error").isNull() & (F.size("includes") > 0)).select("kind").distinct().collect()]
    if not kinds:
        return matched.drop("includes")
    bodies = follows.join(many(resources.where(F.col("resource_type").isin(kinds)).select("ref", "v")), "ref")
    field = F.create_map(*[F.lit(x) for k, f in C.INCLUDES.items() for x in (k, f)])
    targets = bodies.select("query_id", "total", "more", F.col("v"), F.explode("includes").alias("i")).select(
        "query_id", "total", "more",
        F.explode(D.references(F.to_json(F.map_filter(D.fields(F.col("v")), lambda k, _: k == F.try_element_at(field, F.col("i")))))).alias("ref"),
    ).distinct()
    included = (
        targets.join(many(matched.select("query_id", "ref")), ["query_id", "ref"], "left_anti")
        .join(many(resources.select("ref")), "ref", "left_semi")
        .select("query_id", "total", F.lit(None).cast("int").alias("page_pos"), "ref", F.lit("include").alias("mode"), "more")
    )
    return matched.drop("includes").unionByName(included)


# -- the remaining chart tools -----------------------------------------------------------

def _grams(s: Column, sizes=(1, 2, 3)) -> Column:
    def cut(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(F.length(s) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[cut(n) for n in sizes])))


def _by_name(requests: DataFrame, people: DataFrame) -> DataFrame:
    """Substring matches through the rarest of the (at most three-letter) pieces of each wanted name.

    A name holds the wanted text only if it holds every piece of it, so joining on one piece loses
    nothing; taking the rarest keeps the join small when one piece is in every name.
    """
    pieces = people.select("ref", "_name", F.explode(_grams(F.col("_name"))).alias("_g"))
    often = pieces.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    wanted = requests.select("request_id", F.explode("_wanted").alias("_want"))
    size = F.least(F.length("_want"), F.lit(3))
    cut = F.transform(F.sequence(F.lit(1), F.length("_want") - size + 1), lambda i: F.substring(F.col("_want"), i, size))
    rare = (
        wanted.where("_want <> ''").withColumn("_g", F.explode(F.array_distinct(cut))).join(often, "_g", "left")
        .groupBy("request_id", "_want").agg(F.min_by("_g", F.coalesce("_df", F.lit(0))).alias("_g"))
    )
    return rare.join(pieces.hint("merge"), "_g").where(F.col("_name").contains(F.col("_want"))).select("request_id", "ref")


def find_patient(requests: DataFrame, patients: DataFrame) -> DataFrame:
    """Candidates of each identity request and whether the identity is unique, ambiguous or not found.

    ``requests`` has (request_id, identifier, name, birthdate), NULL where not supplied; ``patients`` is
    the Patient projection. Requests with an identifier or birth date are joined on it; a name alone is
    matched as a case-insensitive substring (commas separate alternatives).
    """
    p = patients.select(F.col("resource_ref").alias("ref"), F.col("identifier").alias("_id"), F.lower("name").alias("_name"), F.col("birth_date").alias("_birth"))
    # The files of a patient table are far smaller than its rows, so the planner's guess would send all patients to every task.
    p = p.hint("merge")
    # Equal wishes are looked up once; pairs are made again only for a request id that comes with several of them.
    wish = F.to_json(F.struct("identifier", "name", "birthdate"))
    asked = requests.select("request_id", wish.alias("_wish")).distinct()
    wishes = requests.select(wish.alias("request_id"), "identifier", "name", "birthdate").distinct()
    r = wishes.withColumn("_code", X.after_bar(F.col("identifier"))).withColumn("_wanted", F.split(F.lower("name"), ","))
    named = F.col("name").isNull() | F.exists("_wanted", lambda n: F.col("_name").contains(n))
    born = F.col("birthdate").isNull() | (F.col("_birth") == F.col("birthdate"))
    hits = r.where("identifier is not null").join(p, F.col("_code") == F.col("_id")).where(named & born)
    dated = r.where("identifier is null and birthdate is not null")
    hits = hits.unionByName(dated.join(p, F.col("_birth") == F.col("birthdate")).where(named))
    only_name = r.where("identifier is null and birthdate is null and name is not null")
    hits = hits.select("request_id", "ref").unionByName(_by_name(only_name, p)).distinct()
    hits = hits.select(F.col("request_id").alias("_wish"), "ref")
    found = hits.groupBy("_wish").agg(F.count(F.lit(1)).alias("candidates"))
    several = asked.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("request_id")
    lone = asked.join(several, "request_id", "left_anti").join(found, "_wish").select("request_id", "candidates")
    pairs = asked.join(several, "request_id", "left_semi").join(hits, "_wish").select("request_id", "ref").distinct()
    counted = lone.unionByName(pairs.groupBy("request_id").agg(F.count(F.lit(1)).alias("candidates")))
    out = requests.select("request_id").join(counted, "request_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    word = F.when(F.col("candidates") == 0, "not_found").when(F.col("candidates") == 1, "unique").otherwise("ambiguous")
    return out.withColumn("resolution", word)


def chart_timeline(
    resources: DataFrame, kinds, start: str = "", end: str = "", by: str = "patient_ref", per_type: int = 50, page: int | None = None
) -> DataFrame:
    """Dated index of each patient's chart in pages of ``per_type`` rows per type, undated rows kept, window inclusive.

    All pages come out, numbered from 1, or only ``page``; ``continued`` marks pages that others of the type follow.
    """
    kinds = list(dict.fromkeys(kinds))
    if not 1 <= len(kinds) <= 6 or any("patient" not in C.PARAMS.get(k, ()) for k in kinds):
        raise SearchError("choose one to six supported patient types")
    mine = resources.where(F.col("resource_type").isin(kinds) & F.col(by).isNotNull())
    # Read three times: for the cuts of the ranges, into them, and for the counts.
    mine = staged(mine.select(by, "resource_type", "ref", "id", "resource_date"))
    numbered = range_ranked(mine, [by, "resource_type"], [F.col("id"), F.col("ref")], "_rn")
    paged = numbered.withColumn("page", F.ceil(F.col("_rn") / per_type)).where(F.lit(True) if page is None else F.col("page") == page)
    counts = mine.groupBy(by, "resource_type").agg(F.count(F.lit(1)).alias("_rows"))
    day = F.substring("resource_date", 1, 10)
    inside = (day == "") | ((day >= start if start else F.lit(True)) & (day <= end if end else F.lit(True)))
    return paged.where(inside).join(many(counts), [by, "resource_type"]).select(
        by, "resource_type", "ref", F.nullif("resource_date", F.lit("")).alias("date"), "page", (F.col("_rows") > F.col("page") * per_type).alias("continued")
    )


def timeline_entries(timeline: DataFrame, resources: DataFrame, by: str = "patient_ref") -> DataFrame:
    """Timeline rows with status, label (JSON) and origin tags (JSON) of their documents, numbered as they are shown.

    ``position`` counts a patient's page by (date, ref), undated rows first. A page holds at most six types of ``per_type``
    rows, so the window over it stays small. Documents without a label show ``{}``, without tags ``[]``.
    """
    v = F.col("v")
    label = F.coalesce(*[F.to_json(D.node(v, f)) for f in ("code", "type", "description")], F.lit("{}"))
    shown = resources.select("ref", D.text(v, "status").alias("status"), label.alias("label"), F.coalesce(F.to_json(D.node(v, "meta.tag")), F.lit("[]")).alias("origin"))
    place = Window.partitionBy(by, "page").orderBy(F.coalesce("date", F.lit("")), "ref")
    return timeline.join(many(shown), "ref").withColumn("position", F.row_number().over(place))
