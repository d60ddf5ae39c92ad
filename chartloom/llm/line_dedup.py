"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

Symbols are the words of a line (cut at single blanks), and the edit bound is one: a word replaced, put in or left out.
The neighbourhood of a line is the line and the line without word i, for every i, each as a hashed key. Two lines of
equal length are within the bound if and only if they share a key at the same i; a line is one word longer than another
if and only if one of its keys is the other line. So a group of equal variants needs its earliest line and no pairs, and
the distance to that line is verified on the words.

A line goes if an earlier line, by (doc_id, line number, line hash), equals it or, from `min_words` words on, is within
the bound. Variants are emitted only for lines that share their first or their last half with another line: one edit
leaves one half as it is, so no pair is lost by it.

Cases: null text is an empty text; lines without a character other than blanks stay; shorter lines go only as exact copies;
rows with null ids count as the earliest; repeated rows (same id, same text) are earlier than neither, so both stay as they are;
a document whose every line goes keeps its row with an empty text; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.tables import free_of, fresh, staged

#: Words from which lines are compared with edits.
MIN_WORDS = 8
#: Words of a stretch in which hashes are summed up.
STRETCH = 256
#: A line is common when it makes up more than one in so many; there are always fewer such lines than this.
COMMON = 1000
#: Parts in which the copies of a common line meet its fate.
SALTS = 64

_KEY = ["h1", "h2"]


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a character: id, hash of its text, number, 128-bit hash and words."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "").select(
        "doc_id", "th", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line",
    )


_PLACE = "struct(doc_id, line_no, th)"


def _halves() -> str:
    """Keys of the first and the last half of `words`, for a partner of the same length or of one word more: even numbers
    tell a shared front from a shared back."""
    front = "xxhash64('front', slice(words, 1, {h})) & -2L"
    back = "xxhash64('back', slice(words, n - {h} + 1, {h})) | 1L"
    keys = [part.format(h=h) for h in ("n div 2", "(n + 1) div 2") for part in (front, back)]
    return f"if(n % 2 = 0, array({keys[0]}, {keys[1]}), array({', '.join(keys)}))"


def earliest_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each different line: its hash, earliest place, the keys of its halves (null below `min_words`) and its copies."""
    rows = _lines(docs).withColumn("words", F.split("line", " ")).withColumn("n", F.size("words"))
    rows = rows.select(*_KEY, F.expr(_PLACE).alias("place"), F.expr(f"case when n >= {min_words} then {_halves()} end").alias("halves"))
    # Copies of a line are put together inside each task first.
    return rows.groupBy(*_KEY).agg(F.min("place").alias("place"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("copies"))


def _suspects(lines: DataFrame) -> DataFrame:
    """Lines that share a half with a different line, and whether it is the front, the back or both."""
    halves = lines.where("halves is not null").select(*_KEY, "place", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    return halves.join(shared, "half").groupBy(*_KEY).agg(
        F.first("place").alias("place"), F.max(F.col("half") % 2 == 0).alias("front"), F.max(F.col("half") % 2 != 0).alias("back"),
    )


def _with_words(suspects: DataFrame, docs: DataFrame) -> DataFrame:
    """The suspects' words, from the document of their earliest place."""
    wanted = suspects.groupBy(F.col("place.doc_id").alias("d"), F.col("place.th").alias("t")).agg(F.collect_list(F.struct("place.line_no", *_KEY, "front", "back")).alias("wanted"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = wanted.join(texts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
    found = found.select("doc_id", "th", "wanted", F.split("text", "\n").alias("lines")).select("doc_id", "th", "lines", F.explode("wanted").alias("w"))
    found = found.select(F.struct("doc_id", "w.line_no", "th").alias("place"), "w.h1", "w.h2", "w.front", "w.back", F.expr("split(element_at(lines, w.line_no + 1), ' ')").alias("words"))
    # Repeated rows of a document give a line once.
    return found.dropDuplicates(_KEY)


def _scan(array: str) -> str:
    """Exclusive-or of what stands before each element, in stretches so that long lines take no quadratic time."""
    fold = "aggregate({a}, array(0L), (s, x) -> array_append(s, element_at(s, -1) ^ x), s -> slice(s, 1, size(s) - 1))"
    total = "aggregate({a}, 0L, (s, x) -> s ^ x)"
    part = f"slice({array}, k * {STRETCH} + 1, {STRETCH})"
    parts = f"sequence(0, (size({array}) - 1) div {STRETCH})"
    before = fold.format(a=f"transform({parts}, k -> {total.format(a=part)})")
    return f"flatten(zip_with({parts}, {before}, (k, b) -> transform({fold.format(a=part)}, x -> x ^ b)))"


def variants(lines: DataFrame) -> DataFrame:
    """The deletion neighbourhood: a line's length n, the place i and the hash of the line without word i, where the edit may
    be. Hashes are exclusive sums over (word, place): what stands before i and, one place nearer, what stands after it."""
    w = lines.withColumn("here", F.expr("transform(words, (x, i) -> xxhash64(x, i))")).withColumn("nearer", F.expr("transform(words, (x, i) -> xxhash64(x, i - 1))"))
    w = w.withColumn("change", F.expr("zip_with(here, nearer, (a, b) -> a ^ b)")).withColumn("rest", F.expr("aggregate(nearer, 0L, (s, x) -> s ^ x)"))
    w = w.withColumn("before", F.expr(_scan("change"))).withColumn("n", F.size("words"))
    cut = w.select(*_KEY, "place", "n", "front", "back", F.posexplode(F.expr("zip_with(before, nearer, (b, x) -> b ^ x ^ rest)")).alias("i", "without"))
    # A shared front leaves the edit to the last half, a shared back to the first.
    return cut.where("(front and i >= n div 2) or (back and i <= n - 1 - n div 2)").drop("front", "back")


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h1, h2 of lines that have an earlier line within one edit, verified, with the place of such a line."""
    with_words = staged(_with_words(_suspects(lines), docs))
    whole = with_words.select(*_KEY, "place", F.size("words").alias("n"), F.lit(-1).alias("i"), F.expr("aggregate(transform(words, (x, i) -> xxhash64(x, i)), 0L, (s, x) -> s ^ x)").alias("without"))
    emitted = variants(with_words).unionByName(whole)
    # First the hashes that several lines have; few do, and only their variants go on.
    several = staged(emitted.groupBy("without").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("without"))
    shared = emitted.join(several, "without")
    # Partners: lines of equal length without the same place, and a whole line with those that have one word more. The
    # earliest of a group serves all the others.
    replaced = shared.where("i >= 0").select(*_KEY, "place", "n", "i", "without", F.lit(0).alias("side"))
    longer = shared.where("i >= 0").select(*_KEY, "place", (F.col("n") - 1).alias("n"), F.lit(-1).alias("i"), "without", F.lit(1).alias("side"))
    meeting = staged(replaced.unionByName(longer).unionByName(shared.where("i < 0").withColumn("side", F.lit(2))))
    key = ["n", "i", "without"]
    least = lambda side: F.min(F.when(F.col("side") == side, F.col("place")))
    sides = meeting.groupBy(*key).agg(least(0).alias("same"), least(1).alias("longer"), least(2).alias("whole"))
    partner = F.when(F.col("side") == 0, F.col("same")).when(F.col("side") == 1, F.col("whole")).otherwise(F.col("longer"))
    linked = meeting.join(sides, key).withColumn("partner", partner).where("partner < place")
    return _verified(linked.select(*_KEY, "partner").distinct(), with_words)


def _verified(pairs: DataFrame, with_words: DataFrame) -> DataFrame:
    """Pairs whose words are one edit apart: what the two have in common at the front and at the back leaves at most one word."""
    texts = with_words.select(F.col("place").alias("p"), "words")
    mine = pairs.join(with_words.select(*_KEY, F.col("words").alias("x")), _KEY)
    both = mine.join(texts.select(F.col("p").alias("partner_place"), F.col("words").alias("y")), F.col("partner").eqNullSafe(F.col("partner_place")))
    # The first place where they differ; from there on, one of three edits must make them equal.
    same = "filter(sequence(1, least(size(x), size(y))), k -> element_at(x, k) <> element_at(y, k))"
    at = F.expr(f"coalesce(element_at(nullif({same}, array()), 1), least(size(x), size(y)) + 1)")
    rest = [
        "slice(x, at + 1, size(x)) = slice(y, at + 1, size(y))",
        "slice(x, at + 1, size(x)) = slice(y, at, size(y))",
        "slice(x, at, size(x)) = slice(y, at + 1, size(y))",
    ]
    return both.withColumn("at", at).where(" or ".join(rest)).groupBy(*_KEY).agg(F.min("partner").alias("partner"))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th and the numbers of the lines that go, one row for each document that loses any."""
    lines = staged(earliest_lines(docs, min_words))
    near = near_lines(docs, lines).select(*_KEY, F.lit(True).alias("near"))
    total = lines.agg(F.sum("copies")).first()[0] or 0
    common = F.col("copies") * COMMON > total
    salts = F.when(common, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    fate = lines.join(near, _KEY, "left").select(*_KEY, "place", "near", F.explode(salts).alias("salt"))
    # Fewer than COMMON rows, whatever the input.
    marked = _lines(docs).drop("line").join(F.broadcast(lines.where(common).select(*_KEY, F.lit(True).alias("common"))), _KEY, "left")
    salted = marked.withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SALTS)).cast("int")).otherwise(0))
    rows = salted.join(fate, [*_KEY, "salt"]).where(F.expr(f"near or place < {_PLACE}"))
    return rows.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their remaining lines; columns n_lines and n_dropped are added."""
    free_of(docs, "n_lines", "n_dropped")
    d, th, own, g = fresh(docs, "gone_doc", "gone_text", "text_hash", "gone")
    gone = dropped_lines(docs, min_words).select(F.col("doc_id").alias(d), F.col("th").alias(th), F.col("gone").alias(g))
    joined = docs.withColumn(own, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(th)), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(g, i)), "\n"))
    return joined.select(
        *(kept.alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_dropped"),
    )
