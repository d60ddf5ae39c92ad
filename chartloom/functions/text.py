"""Text, URL, hash, age and JSON-answer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_PATTERN = r"[\p{L}\p{N}_]++(?:[-./][\p{L}\p{N}_]++)*+"
DATE_PREFIX = r"^(?:eq|ne|gt|lt|ge|le|sa|eb|ap)(?=\d{4}-)"
HEX_ID = r"(?<![a-f0-9])[a-f0-9]{24}(?![a-f0-9])"


def lexical_terms(s: Column) -> Column:
    """Distinct lower-cased lexical tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(TERM_PATTERN), F.lit(0)))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 24)


def hash63(s: Column) -> Column:
    """A 60-bit integer from md5: the same number in every SQL engine."""
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def strip_date_prefix(s: Column) -> Column:
    return F.regexp_replace(s, DATE_PREFIX, "")


def after_bar(s: Column) -> Column:
    return F.element_at(F.split(s, r"\|"), -1)


def hex_ids(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(HEX_ID), F.lit(0)))


def url_path(s: Column) -> Column:
    """Path without query, fragment and outer slashes."""
    return F.regexp_replace(F.regexp_extract(s, r"^([^?#]*)", 1), r"^/+|/+$", "")


def query_pairs(s: Column, keep_blank: bool = False) -> Column:
    """Decoded key/value pairs of the query part, in order, repeated keys kept."""
    raw = F.regexp_extract(s, r"\?([^#]*)", 1)
    parts = F.filter(F.split(raw, "&"), lambda p: p != "")
    decode = lambda p: F.try_url_decode(p)
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("key"),
            F.when(p.contains("="), decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1))).otherwise(F.lit("")).alias("value"),
        ),
    )
    return pairs if keep_blank else F.filter(pairs, lambda p: p.value != "")


def url_encode_pairs(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(F.url_encode(p.key), F.lit("="), F.url_encode(p.value))), "&"
    )


def age_at(birth: Column, at: Column) -> Column:
    """Completed years: the year difference, less one before the birthday."""
    b, a = birth.cast("date"), at.cast("date")
    early = F.date_format(a, "MMdd") < F.date_format(b, "MMdd")
    return F.year(a) - F.year(b) - early.cast("int")


def age_band(age: Column) -> Column:
    return (
        F.when(age < 18, "child").when(age < 40, "adult18_39").when(age < 65, "adult40_64").when(age >= 65, "older65plus")
    )


def crud_code(creates: Column, updates: Column, deletes: Column) -> Column:
    """Letters C, R, U, D in that order from three sizes; R always."""
    letter = lambda n, c: F.when(n > 0, F.lit(c)).otherwise(F.lit(""))
    return F.concat(letter(creates, "C"), F.lit("R"), letter(updates, "U"), letter(deletes, "D"))


def difficulty_bin(hops: Column) -> Column:
    return F.when(hops <= 1, "easy").when(hops == 2, "medium").when(hops == 3, "hard").otherwise("very_hard")


MAX_ANSWER = 65536


def answer_text(s: Column, allow_fence: bool = False) -> Column:
    """The single JSON object of an answer as text, NULL when it is not exactly one object."""
    body = s
    if allow_fence:
        fence = r"(?s)^\s*```(?:json)?\s*\n(.*?)\n```\s*$"
        body = F.when(s.rlike(fence), F.regexp_extract(s, fence, 1)).otherwise(s)
    parsed = F.try_parse_json(body)
    one_object = F.regexp_like(body, F.lit(r"(?s)^\s*\{.*\}\s*$")) & F.schema_of_variant(parsed).startswith("OBJECT")
    # The parser stops after the first value: text left over shows as a second object when
    # the braces outside strings close before the end.
    outside = F.regexp_replace(body, r'"(?:[^"\\]|\\.)*+"', "")
    tail = F.regexp_replace(outside, r"[^{}]", "")
    depth = F.aggregate(
        F.filter(F.split(tail, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("zeros")),
        lambda acc, c: F.struct(
            (acc.d + F.when(c == "{", 1).otherwise(-1)).alias("d"),
            (acc.zeros + F.when((acc.d == 1) & (c == "}"), 1).otherwise(0)).alias("zeros"),
        ),
    )
    return F.when((F.char_length(s) <= MAX_ANSWER) & one_object & (depth.zeros == 1), body)


def is_final(s: Column, allow_fence: bool = False) -> Column:
    keys = F.json_object_keys(answer_text(s, allow_fence))
    return F.coalesce(F.array_sort(keys) == F.array(F.lit("answer"), F.lit("evidence")), F.lit(False))


def register_functions(spark) -> None:
    """SQL twins of the expressions users call from ``spark.sql``."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION stable_id(parts ARRAY<STRING>) RETURNS STRING "
        "RETURN substr(sha2(array_join(parts, '|'), 256), 1, 24)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION lexical_terms(s STRING) RETURNS ARRAY<STRING> RETURN "
        r"array_distinct(regexp_extract_all(lower(s), r'[\p{L}\p{N}_]++(?:[-./][\p{L}\p{N}_]++)*+', 0))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_match(system STRING, code STRING, needle STRING) RETURNS BOOLEAN "
        "RETURN code = needle OR (contains(needle, '|') AND code = substr(needle, instr(needle, '|') + 1) "
        "AND (startswith(needle, '|') OR system = substring_index(needle, '|', 1)))"
    )
    from chartloom.functions.documents import DATE_FIELDS

    dates = ", ".join(f"nullif(try_variant_get(v, '$.{f}', 'string'), '')" for f in DATE_FIELDS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION resource_date(v VARIANT) RETURNS STRING "
        f"RETURN coalesce({dates}, try_variant_get(v, '$.period.start', 'string'), '')"
    )
