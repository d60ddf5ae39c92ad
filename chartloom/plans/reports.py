"""Corpus reports: counts, distributions, structure summaries, review rows and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import documents as D
from chartloom.functions.ranks import MIDDLE, at_fraction, join_groups, middle_mean, order_statistics, range_running, ranked
from chartloom.session import checkpointed, staged


def generated_text(resources: DataFrame) -> DataFrame:
    """(ref, kind, n, text): readable text of documents' text attachments, message payloads and notes."""
    v = F.col("v")
    decode = lambda a: F.decode(F.unbase64(D.text(a, "attachment.data")), "UTF-8")
    parts = {
        "attachment": F.when(
            F.col("resource_type") == "DocumentReference",
            F.transform(F.filter(D.values_at(v, "content"), lambda c: D.text(c, "attachment.data").isNotNull() & D.text(c, "attachment.contentType").startswith("text/")), decode),
        ).otherwise(F.array().cast("array<string>")),
        "payload": F.transform(D.values_at(v, "payload"), lambda p: D.text(p, "contentString")),
        "note": F.transform(D.values_at(v, "note"), lambda n: D.text(n, "text")),
    }
    one = lambda k: (lambda t, i: F.struct(F.lit(k).alias("kind"), i.alias("n"), t.alias("text")))
    tagged = F.flatten(F.array(*[F.transform(c, one(k)) for k, c in parts.items()]))
    return resources.select("ref", F.explode(tagged).alias("t")).select("ref", "t.*").where("text is not null")


PART_BYTES = 64 * 1024 * 1024
# Charts above one part that may be named beside the rows (some 50 MB); beyond, they are joined.
NAMED_CHARTS = 500_000
# Characters of a text that its place is dealt by, and rows with the same start that may meet in one task.
START_CHARS = 64
COMMON_START = 20_000


def patient_context(resources: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """All documents of each patient as sorted text with its size: (patient_ref, part, documents, bytes, context).

    A chart is one part unless it outgrows ``part_bytes``; joined by line breaks the parts are the whole text. Documents
    without an owner or text are left out. Sizes are added up without moving texts; only charts above one part, counted before
    they are broadcast, are put in order across tasks.
    """
    size = (F.octet_length("doc") + 1).cast("bigint")
    owned = resources.where("patient_ref is not null and doc is not null").select("patient_ref", "ref", "doc")
    big = checkpointed(owned.groupBy("patient_ref").agg(F.sum(size).alias("_size")).where(F.col("_size") > part_bytes).select("patient_ref"))
    named = big.count()
    named_big = F.broadcast(big) if named <= NAMED_CHARTS else big

    def joined(rows: DataFrame, *by) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("documents"), (F.sum(size) - 1).alias("bytes"), F.array_join(F.array_sort(F.collect_list("doc")), "\n").alias("context")
        )

    out = joined(owned.join(named_big, "patient_ref", "left_anti"), "patient_ref", F.lit(0).alias("part"))
    if named:
        mine = owned.join(named_big, "patient_ref", "left_semi")
        # The driver gets a sample of what rows are dealt by, so that is the start of a text; only among texts with a start that
        # very many share it is all of it, and the ref.
        start = F.substring("doc", 1, START_CHARS)
        common = checkpointed(mine.groupBy("patient_ref", start.alias("_start")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > COMMON_START).drop("_n"))
        # At most one row in COMMON_START of the texts.
        mine = mine.withColumn("_start", start).join(F.broadcast(common.withColumn("_whole", F.lit(True))), ["patient_ref", "_start"], "left")
        deal = [F.when(F.col("_whole"), F.col(whole)).otherwise(short) for whole, short in (("doc", F.col("_start")), ("ref", F.lit("")))]
        placed = range_running(mine, ["patient_ref"], [F.col("doc"), F.col("ref")], size, "_upto", deal)
        out = out.unionByName(joined(placed, "patient_ref", F.floor((F.col("_upto") - 1) / part_bytes).cast("int").alias("part")))
    return out


# -- counts and distributions ------------------------------------------------------------

def corpus_counts(tasks: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Long counts (dimension, value, n) in one pass over the tasks."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dims.items()])
    return tasks.select(F.explode(pairs).alias("p")).select("p.*").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, min, quartiles by position, median, max and mean to three places."""
    stats = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 3).alias("mean")
    )
    found = order_statistics(df, by, value, {"p25": at_fraction(0.25), "p75": at_fraction(0.75), **MIDDLE})
    return join_groups(stats, found.select(*by, "p25", "p75", middle_mean().alias("median")), list(by))


def histogram(rows: DataFrame, owner: str, item: Column | None = None) -> DataFrame:
    """How many owners have how many rows (or distinct items)."""
    n = F.count(F.lit(1)) if item is None else F.countDistinct(item)
    return rows.groupBy(owner).agg(n.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("frequency"))


def per_family_profile(tasks: DataFrame, family: str, dims: dict[str, Column]) -> DataFrame:
    """(family, dimension, value, n): what each family is made of."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dims.items()])
    return tasks.select(F.col(family).alias("family"), F.explode(pairs).alias("p")).select("family", "p.*").groupBy("family", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_mismatches(profile: DataFrame, tasks: DataFrame, family: str) -> DataFrame:
    """Dimensions whose counts do not add up to the tasks of the family."""
    sums = profile.groupBy("family", "dimension").agg(F.sum("n").alias("total"))
    want = tasks.groupBy(F.col(family).alias("family")).agg(F.count(F.lit(1)).alias("tasks"))
    return join_groups(sums, want, ["family"]).where("total <> tasks")


# -- structure ---------------------------------------------------------------------------


def shapes(resources: DataFrame) -> DataFrame:
    """(ref, resource_type, status, shape) with the sorted field paths of each document as one text."""
    s = D.shape_paths(resources.where("resource_type <> 'Provenance'"))
    return s.select("ref", "resource_type", D.text(F.col("v"), "status").alias("status"), F.array_join("paths", ",").alias("shape"))


def shape_counts(resources: DataFrame) -> DataFrame:
    """Distinct shapes, statuses and documents of each type."""
    s = shapes(resources)
    n = s.groupBy("resource_type").agg(F.count(F.lit(1)).alias("resources"), F.countDistinct("shape").alias("shapes"))
    st = s.where("status is not null").select("resource_type", "status").distinct().groupBy("resource_type").agg(F.array_join(F.array_sort(F.collect_list("status")), ",").alias("statuses"))
    return n.join(st, "resource_type", "left")


def observation_structures(resources: DataFrame) -> DataFrame:
    """How Observations carry their result."""
    keys = F.filter(F.map_keys(D.fields(F.col("v"))), lambda k: k.startswith("value") | k.isin("component", "hasMember", "dataAbsentReason"))
    return resources.where("resource_type = 'Observation'").select(F.explode(keys).alias("structure")).groupBy("structure").agg(F.count(F.lit(1)).alias("n"))


def sample_facts(resources: DataFrame) -> DataFrame:
    """Per document what structural comparisons count: shape, feature flags and non-patient edges."""
    v = F.col("v")
    e = F.filter(D.references(F.col("doc")), lambda r: ~r.rlike(r"^(https?:|urn:|#)") & ~r.startswith("Patient/"))
    return D.shape_paths(resources).select(
        "ref", "resource_type", F.md5(F.array_join("paths", ",")).alias("shape"), D.feature_flags(v).alias("features"), F.size(e).alias("edges"),
        F.coalesce(D.text(v, "status"), F.lit("(none)")).alias("status"),
    )


def describe(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Documents, distinct shapes (of a type), distinct features and edges of each group.

    Documents alike in type, shape and features are counted first, so they are made once and only their kinds move.
    """
    alike = [*by, *[c for c in ("resource_type", "shape", "features") if c not in by]]
    kinds = checkpointed(facts.groupBy(*alike).agg(F.count(F.lit(1)).alias("_n"), F.sum("edges").alias("edges")))
    return _describe_kinds(kinds, by)


def _describe_kinds(kinds: DataFrame, by: Sequence[str]) -> DataFrame:
    base = kinds.groupBy(*by).agg(
        F.sum("_n").alias("resources"), F.countDistinct("resource_type", "shape").alias("distinct_shapes"), F.sum("edges").alias("nonpatient_reference_edges")
    )
    f = kinds.select(*by, F.explode("features").alias("f")).groupBy(*by).agg(F.countDistinct("f").alias("distinct_features"))
    if not by:
        return base.withColumn("distinct_features", f.select("distinct_features").scalar())
    return join_groups(base, f, list(by), "left").na.fill(0, ["distinct_features"])


def balanced_resample(facts: DataFrame, side: str, resamples: int = 100, seed: int = 17) -> DataFrame:
    """Mean, least and most of each structural count over resamples with the same budget per type on both sides.

    ``facts`` has a ``side`` column. A resample takes, without replacement, the documents with the lowest
    hash of (seed, resample, ref), as many per type as the smaller side has. Documents are counted by resample and the first
    two digits of their hash; all of the digits below the one that holds the last place are in, only those of that one are ranked.
    Documents alike in type, shape, features and edges are counted, so no document moves for a resample. A side that gives
    all it has is counted once for all resamples.
    """
    alike = ["resource_type", side, "shape", "features", "edges"]
    facts = staged(facts.select("ref", *alike))
    per = facts.groupBy("resource_type", side).agg(F.count(F.lit(1)).alias("n"))
    budget = per.groupBy("resource_type").agg(F.min("n").alias("budget"), F.count(F.lit(1)).alias("sides")).where("sides = 2")
    # One row per type and side.
    takes = checkpointed(per.join(budget, "resource_type").select("resource_type", side, "budget", (F.col("budget") < F.col("n")).alias("_some")))
    dealt = facts.join(F.broadcast(takes), ["resource_type", side])
    every = F.sequence(F.lit(0), F.lit(resamples - 1))
    whole = dealt.where("not _some").groupBy(*alike).agg(F.count(F.lit(1)).alias("_n")).withColumn("b", F.explode(every))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("ref")))
    drawn = dealt.where("_some").withColumn("b", F.explode(every)).withColumn("_h", h).withColumn("_digits", F.substring("_h", 1, 2))
    group = ["b", "resource_type", side]
    digits = drawn.groupBy(*group, "budget", "_digits").agg(F.count(F.lit(1)).alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy(*group).orderBy("_digits"))
    last = digits.withColumn("_upto", upto).where("_upto >= budget and _upto - _in < budget")
    # One row per type, side and resample, whatever the number of documents.
    cuts = checkpointed(last.select(*group, F.col("_digits").alias("_last"), (F.col("budget") - (F.col("_upto") - F.col("_in"))).alias("_rest")))
    placed = drawn.drop("budget").join(F.broadcast(cuts), group)
    low = placed.where("_digits < _last").groupBy("b", *alike).agg(F.count(F.lit(1)).alias("_n"))
    edge = ranked(placed.where("_digits = _last"), group, F.substring("_h", 3, 2), [F.col("_h")], "_k").where("_k <= _rest")
    edge = edge.groupBy("b", *alike).agg(F.count(F.lit(1)).alias("_n"))
    kinds = whole.unionByName(low).unionByName(edge).withColumn("edges", F.col("edges") * F.col("_n"))
    d = _describe_kinds(checkpointed(kinds), ["b", side])
    names = ["distinct_shapes", "distinct_features", "nonpatient_reference_edges"]
    return d.groupBy(side).agg(*[g(n).alias(f"{n}_{k}") for n in names for k, g in (("mean", lambda c: F.round(F.avg(c), 2)), ("min", F.min), ("max", F.max))])


# -- reports -----------------------------------------------------------------------------

def coverage_report(tasks: DataFrame, ledger: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """One long table (section, key, value): task counts, origins, types and per-patient histograms."""
    counts = corpus_counts(tasks, dims).select(F.concat(F.lit("task."), "dimension").alias("section"), F.col("value").alias("key"), F.col("n").cast("double").alias("value"))
    kind = F.substring_index("resource_ref", "/", 1)
    parts = [
        counts,
        ledger.groupBy(F.col("origin").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("section", F.lit("ledger.origin")),
        ledger.groupBy(kind.alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("section", F.lit("ledger.type")),
        histogram(ledger, "source_patient_id").select(F.col("value").cast("string").alias("key"), F.col("frequency").cast("double").alias("value")).withColumn("section", F.lit("patient.resources")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("section", "key", "value"))
    return out


def review_examples(tasks: DataFrame, family: str, preferred: Column, pos: str) -> DataFrame:
    """One task per family: a preferred variant if there is one, else the first seen."""
    first = F.min_by(F.struct(*[F.col(c) for c in tasks.columns if c != family]), F.struct((~preferred).cast("int"), F.col(pos)))
    return tasks.groupBy(family).agg(first.alias("t")).select(family, "t.*")


def review_pack_rows(evidence: DataFrame, ledger: DataFrame, texts: DataFrame, limit: int = 1600) -> DataFrame:
    """Evidence of review tasks with its origin and a text excerpt, marked where it was cut."""
    l = ledger.select(F.col("resource_ref").alias("ref"), "origin")
    cut = F.when(F.char_length("text") > limit, F.concat(F.substring("text", 1, limit), F.lit(" [excerpt]"))).otherwise(F.col("text"))
    return evidence.join(l, "ref", "left").join(texts, "ref", "left").select("task_id", "ref", F.coalesce("origin", F.lit("not present in ledger")).alias("origin"), cut.alias("excerpt"))


def probe_queries(probes: DataFrame, resources: DataFrame) -> DataFrame:
    """Probes (query_id, url, expected) whose matches are not exactly the expected ref."""
    from chartloom.operators import search as Q

    hits = Q.batch_search(probes.select("query_id", "url"), resources).where("mode = 'match'")
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref"))
    j = probes.join(got, "query_id", "left").na.fill(0, ["n"])
    return j.where(~F.coalesce((F.col("n") == 1) & (F.col("ref") == F.col("expected")), F.lit(False))).select("query_id", "expected", "n")


def branch_examples(cases: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """First case of every combination of keys."""
    return cases.groupBy(*keys).agg(F.min(pos).alias(pos), F.count(F.lit(1)).alias("cases"))


def type_delta(old: DataFrame, new: DataFrame, key: str = "resource_type") -> DataFrame:
    """Old and new counts per type and the difference."""
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    j = count(old, "old_n").join(count(new, "new_n"), key, "full").na.fill(0, ["old_n", "new_n"])
    return j.withColumn("delta", F.col("new_n") - F.col("old_n"))


# -- set rules ---------------------------------------------------------------------------

def split_overlaps(rows: DataFrame, patient: str, split: str) -> DataFrame:
    """Patients found in more than one split."""
    return rows.groupBy(patient).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def lost_coverage(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old families, types or task ids that are gone."""
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


def merge_additions(originals: DataFrame, additions: DataFrame):
    """Union of (ref, doc) rows, one per ref; and the refs that clash: two bodies, or an original's name."""
    canon = D.canonical(F.parse_json("doc"))
    a = additions.withColumn("_canon", F.sha2(canon, 256))
    per = a.groupBy("ref").agg(F.countDistinct("_canon").alias("bodies"), F.min("doc").alias("doc"))
    torn = per.where("bodies > 1").select("ref", F.lit("differs").alias("clash"))
    taken = per.join(originals.select("ref"), "ref", "left_semi").select("ref", F.lit("original").alias("clash"))
    return originals.select("ref", "doc").unionByName(per.select("ref", "doc")), torn.unionByName(taken)


def source_preservation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Originals missing from the new corpus and source-preserved documents whose body changed: (ref, problem)."""
    n = new.select("ref", F.col("v").alias("nv"))
    j = old.select("ref", "v").join(n, "ref", "left")
    changed = D.is_source_preserved(F.col("v")) & (D.canonical(F.col("v")) != D.canonical(F.col("nv")))
    problem = F.when(F.col("nv").isNull(), "missing").when(changed, "changed")
    return j.select("ref", problem.alias("problem")).where("problem is not null")


def ledger_join(ledger: DataFrame, refs: DataFrame) -> DataFrame:
    """Ledger rows without a document and documents without a ledger row."""
    l, r = ledger.select(F.col("resource_ref").alias("ref"), "origin"), refs.select("ref").withColumn("_r", F.lit(True))
    j = l.join(r, "ref", "full")
    return j.select("ref", F.when(F.col("_r").isNull(), "no document").when(F.col("origin").isNull(), "no ledger row").alias("problem")).where("problem is not null")


def corpus_comparison(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shapes and documents of each type on both sides."""
    o = shape_counts(old).select("resource_type", F.col("resources").alias("old_resources"), F.col("shapes").alias("old_shapes"))
    n = shape_counts(new).select("resource_type", F.col("resources").alias("new_resources"), F.col("shapes").alias("new_shapes"))
    return o.join(n, "resource_type", "full").na.fill(0)
