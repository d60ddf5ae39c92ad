"""Near-duplicate documents by DartMinHash signatures of weighted word shingles and a banded join.

A document is a weighted set: its shingles of `SHINGLE` words, weighted by how often they occur (a text shorter than a shingle
is one shingle of all its words). Every unit of weight of a shingle is a region at which hashed darts are thrown: their
ranks are the arrivals of a Poisson process that only the shingle and the unit fix, and each dart names a coordinate. The
earliest dart of each coordinate is the signature, so two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Darts are thrown up to rank (ln k + 2) k / weight first, then further until no coordinate
is empty, so the cost follows k log k and the length, not their product.

Equal texts are one class before any of this. Signatures are cut into bands; texts with an equal band are a bucket. First
each member of a bucket is held against the bucket's centre (a hash picks it, another one in each band): where the
signatures do not tell two apart, the shingles decide at `SIMILARITY`. Links make components by large-star and small-star.
Then only buckets are looked at again whose members lie in several components: the members outside the bucket's largest
component meet all of its members, in blocks, the likeliest pairs first, and a pair whose components have been joined
meanwhile is skipped. So every component is found as if all pairs of a bucket had been compared, and no list of pairs is made.

Cases: null and empty texts, and texts without a word, belong to no group: each is its own class; of a group the row
with the smallest doc_id stays, and of several texts with it the one of the smallest hash; null ids come last; repeated rows are copies; an empty table gives no rows; other columns are kept by
`keep_one` and left out by `near_duplicates`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.bpe import slices
from chartloom.llm.tables import fresh, staged

SHINGLE, SIMILARITY = 5, 0.8
#: Similar texts of 0.8 share a band with probability 0.9999.
BANDS, BAND_ROWS = 25, 5
#: Agreement of signatures below which the shingles are not asked: four standard deviations under SIMILARITY.
FAR = 0.66
#: Members of a bucket that meet at a time.
BLOCK = 1024

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def units_of(texts: list[str | None], words: dict[str, int], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text one hash for each unit of weight: the n-th occurrence of a shingle is its n-th unit."""
    cut = [(t or "").split() for t in texts]
    lengths = np.array([len(c) for c in cut], np.int64)
    w = np.fromiter((words[x] for c in cut for x in c), np.uint64, lengths.sum())
    # Shingles start at every word whose text goes on for `size` words; a shorter text is hashed as one shingle of its words.
    shingles = np.zeros(len(w), np.uint64)
    short = np.repeat(lengths < size, lengths)
    begin = np.cumsum(lengths) - lengths
    left = np.repeat(begin + lengths, lengths) - np.arange(len(w))
    for k in range(size):
        next_ = np.zeros(len(w), np.uint64)
        next_[: max(0, len(w) - k)] = w[k:]
        shingles = np.where(left > k, _mix(shingles + next_ + _STEP), shingles)
    first = np.zeros(len(w), bool)
    first[begin[lengths > 0]] = True
    real = np.where(short, first, left >= size)
    doc = np.repeat(np.arange(len(texts)), lengths)[real]
    shingles = shingles[real]
    order = np.lexsort((shingles, doc))
    shingles = shingles[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    nth = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    return np.split(_mix(shingles + _mix(nth.astype(np.uint64))), np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])


def signatures_of(sets: list[np.ndarray], k: int) -> np.ndarray:
    """The earliest dart of each of k coordinates, as 64-bit hashes, for each set; no set is empty."""
    out, todo, factor = np.zeros((len(sets), k), np.uint64), np.arange(len(sets)), 1.0
    while len(todo):
        n = np.array([len(sets[i]) for i in todo])
        region, doc = np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(len(todo)), n)
        limit, at, dart = np.repeat(factor * (math.log(k) + 2) * k / n, n), np.zeros(len(region)), 0
        rank, thrown = np.full(len(todo) * k, np.inf), []
        while len(region):
            # The next dart of each region: an exponential gap after the one before.
            hashed = _mix(region + _U(0x9E3779B97F4A7C15 * (2 * dart + 1) % (1 << 64)))
            at = at - np.log((hashed >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            near = at <= limit
            region, doc, limit, at = region[near], doc[near], limit[near], at[near]
            value = _mix(hashed[near] ^ _U(0xD1B54A32D192ED03))
            place = doc * k + ((value >> _U(32)) % _U(k)).astype(np.int64)
            np.minimum.at(rank, place, at)
            thrown.append((place, at, value))
            dart += 1
        earliest = np.zeros(len(rank), np.uint64)
        for place, at, value in thrown:
            won = rank[place] == at
            earliest[place[won]] = value[won]
        full = np.isfinite(rank).reshape(-1, k).all(1)
        out[todo[full]] = earliest.reshape(-1, k)[full]
        todo, factor = todo[~full], factor * 2
    return out


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, size: int = SHINGLE) -> DataFrame:
    """id (hash of the text), bands (a hash for each) and bits (the low 16 bits of each coordinate), for each text with a word."""
    k, rows_of = bands * rows, rows

    def run(batches):
        words = _WordHashes()
        for b in slices(batches):
            ids = b.column(0).to_pylist()
            # Copies inside a slice are thrown for once.
            rows = list({i: at for at, i in enumerate(ids)}.values())
            sets = units_of(b.column(1).take(pa.array(rows, pa.int64())).to_pylist(), words, size)
            rows, sets = [r for r, s in zip(rows, sets) if len(s)], [s for s in sets if len(s)]
            sig = signatures_of(sets, k)
            keys = np.full((len(rows), bands), 7, np.uint64)
            for r in range(rows_of):
                keys = _mix(keys + sig[:, r::rows_of])
            bits = pa.array([x.tobytes() for x in sig.astype("<u2")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in rows], pa.int64()), pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64())), bits], names=["id", "bands", "bits"])

    made = docs.select(F.xxhash64("text").alias("id"), "text").mapInArrow(run, "id long, bands array<long>, bits binary")
    return made.dropDuplicates(["id"])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of different unit hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of at least the similarity; columns a, b, units_a, units_b."""

    def run(batches):
        for b in slices(batches, 512):
            keep = [weighted_jaccard(_unpacked(x), _unpacked(y)) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "units_a", "units_b").mapInArrow(run, "a long, b long")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures leave it open that they are similar; columns a, b, bits_a, bits_b."""

    def run(batches):
        for b in slices(batches, 4096):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(b.num_rows, -1) for i in (2, 3))
            yield b.filter(pa.array((x == y).mean(1) >= FAR)).select(["a", "b"])

    return pairs.select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def unit_sets(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id and units (sorted 64-bit hashes, packed) of texts."""

    def run(batches):
        words = _WordHashes()
        for b in slices(batches):
            packed = [np.sort(u).astype("<u8").tobytes() for u in units_of(b.column(1).to_pylist(), words, size)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["id", "units"])

    return texts.select("id", "text").mapInArrow(run, "id long, units binary")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def joining_links(few: pd.DataFrame, many: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links that join the components of `few` with those of `many` (id, root, bits, units), as many as it takes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    x, y = (np.frombuffer(b"".join(t["bits"]), "<u2").reshape(len(t), -1) for t in (few, many))
    roots_x, roots_y, ids_x, ids_y = few["root"].to_numpy(), many["root"].to_numpy(), few["id"].to_numpy(), many["id"].to_numpy()
    found = [(a, b, s) for a in range(len(few)) for s in [(y == x[a]).mean(1)] for b in [np.flatnonzero((s >= FAR) & (roots_y != roots_x[a]))] if len(b)]
    if not found:
        return []
    a = np.concatenate([np.full(len(b), a) for a, b, _ in found])
    b = np.concatenate([b for _, b, _ in found])
    order = np.argsort(-np.concatenate([s[b] for _, b, s in found]), kind="stable")
    out = []
    sets_x, sets_y = few["units"].to_list(), many["units"].to_list()
    for m, n in zip(a[order].tolist(), b[order].tolist()):
        p, q = root(roots_x[m]), root(roots_y[n])
        if p != q and weighted_jaccard(_unpacked(sets_x[m]), _unpacked(sets_y[n])) >= similarity:
            parent[p] = q
            out.append((int(ids_x[m]), int(ids_y[n])))
    return out


#: A character of a word: what is not white space to the cutter of words (`str.split`).
WORD_CHARACTER = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def has_word(text: str = "text") -> Column:
    return F.col(text).rlike(WORD_CHARACTER)


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.where(has_word())


def text_classes(docs: DataFrame) -> DataFrame:
    """Each different text with a word once: id (a 64-bit hash of it), its smallest doc_id and its copies."""
    return _with_words(docs).select("doc_id", F.xxhash64("text").alias("id")).groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def links(docs: DataFrame, classes: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between the ids of different, similar texts: enough of them for the components of all."""
    sig = staged(signatures(_with_words(docs), bands, rows, size))
    keyed = sig.select("id", F.posexplode("bands").alias("band", "key"))
    crowded = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    bucket = staged(keyed.join(crowded, ["band", "key"]).select("band", "key", "id"))
    # Shingles and signature of what shares a bucket with something, once: the row of the smallest doc_id speaks for a text.
    some = classes.join(bucket.select("id").distinct(), "id").select("id", "doc_id")
    texts = docs.select("doc_id", F.xxhash64("text").alias("id"), "text")
    mine = texts["doc_id"].eqNullSafe(some["doc_id"]) & (texts["id"] == some["id"])
    sets = unit_sets(texts.join(some, mine).select(some["id"], "text"), size).dropDuplicates(["id"])
    sets = staged(sets.join(sig.select("id", "bits"), "id"))

    # Each member of a bucket and its centre, which a hash picks anew in each band.
    centres = bucket.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("id", "band"), "id")).alias("c")).select("band", "key", F.col("c.id").alias("b"))
    pairs = bucket.join(centres, ["band", "key"]).where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    bits, units_ = sets.select("id", "bits"), sets.select("id", "units")
    close = staged(agreeing(pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")))
    found = staged(similar(close.join(units_.toDF("a", "units_a"), "a").join(units_.toDF("b", "units_b"), "b"), similarity))

    # Buckets that still hold several components: those outside the largest meet all members.
    rooted = bucket.join(components(found).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    parts = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top")).where("parts > 1")
    blocks = mixed.select("band", "key", F.col("top.root").alias("top"), F.ceil(F.col("all") / BLOCK).alias("many_blocks"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("few_blocks"))
    members = staged(rooted.join(blocks, ["band", "key"]))
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n))
    few = members.where("root <> top").select("band", "key", "id", "root", place("few_blocks").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("many_blocks") - 1)).alias("j"), F.lit(True).alias("few"))
    many = members.select("band", "key", "id", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few_blocks") - 1)).alias("i"), place("many_blocks").alias("j"), F.lit(False).alias("few"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(joining_links(rows[rows["few"]], rows[~rows["few"]], similarity), columns=["a", "b"])

    later = few.unionByName(many).join(sets, "id").groupBy("band", "key", "i", "j").applyInPandas(meet, "a long, b long")
    return found.unionByName(later.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for nodes with a link."""

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(edges)
    while True:
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the node, go to the smallest of them.
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = staged(small)
        after = state(edges)
        if after == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = after


def _classed(docs: DataFrame, bands: int, rows: int, size: int, similarity: float) -> DataFrame:
    """doc_id, id and root (text hashes, null without a word), class_id, leads, n_copies and n_joining_links of every document.

    The rows that lead are those with the doc_id and the text that stand for their root; ids may be null or repeated."""
    classes = staged(text_classes(docs))
    found = staged(links(docs, classes, bands, rows, size, similarity))
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_joining_links"))
    grouped = classes.join(components(found).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    leaders = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id")).alias("first"))
    table = grouped.join(leaders, "root").join(degree, "id", "left").select("id", "root", "first", "copies", "n_joining_links")
    keyed = docs.select("doc_id", F.when(has_word(), F.xxhash64("text")).alias("id"))
    alone = F.col("id").isNull()
    return keyed.join(table, "id", "left").select(
        "doc_id", "id", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("id").eqNullSafe(F.col("first.id")))).alias("leads"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_joining_links", F.lit(0)).cast("long").alias("n_joining_links"),
    )


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest doc_id of its group), n_copies of its text, n_joining_links
    (links of its text that joined its group, not the number of similar texts), kept (one row of each group), root (the
    smallest text hash of its group, which tells groups apart where ids are null or repeated)."""
    classed = _classed(docs, bands, rows, size, similarity)
    again = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("class_id"))
    return classed.withColumn("r", again).select("doc_id", "class_id", "n_copies", "n_joining_links", (F.col("id").isNull() | (F.col("leads") & (F.col("r") == 1))).alias("kept"), "root")


def keep_one(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The row with the smallest doc_id of each group, and every document without a group, with all columns."""
    classed = _classed(docs, bands, rows, size, similarity)
    d, i, own, nth = fresh(docs, "gone_doc", "gone_text", "text_hash", "nth")
    gone = classed.where(~F.col("leads")).select(F.col("doc_id").alias(d), F.col("id").alias(i)).distinct()
    keyed = docs.withColumn(own, F.when(has_word(), F.xxhash64("text")))
    rest = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(i)), "left_anti")
    # Repeated rows of one id and text count once.
    r = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(F.lit(0)))
    return rest.withColumn(nth, r).where(F.col(own).isNull() | (F.col(nth) == 1)).select(*docs.columns)
