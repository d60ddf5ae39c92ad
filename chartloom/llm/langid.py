"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword; each of its bits is a binary classifier that tells the languages with 1 from those with 0 by
the log odds of hashed bigrams and trigrams of letters. A text's margins are held against all codewords: a bit's loss
counts by how well that bit did on the sample, the codeword of least loss wins, and a runner-up within `AMBIGUOUS` of
its probability flags the text. Up to `FULL_CODE` languages get the exhaustive code, more get random words of 10 log2 bits.

Languages are the `LANGUAGES` values of `lang` with the most documents, of at least `LEAST_DOCS` each, ties by name; what comes to
the driver is one count for each of their buckets. Learned from at most `TRAIN_DOCS` documents of each language (smallest hash of the id first, of the rows that repeat an
id in a language the one whose text hashes lowest) whose crc32(doc_id) mod 5 is
not 0. Only the text is an input of a prediction, and all of it.

Cases: a text that is null or has no letter gives `und` with score 0; a null doc_id is neither held out nor learned from;
without a language to learn every text is `und`; one language is always the answer; repeated rows each give a row;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.bpe import slices
from chartloom.llm.tables import one_row_each, smallest_hashes

TRAIN_DOCS = 2000
#: Languages learned, and the documents that a value of `lang` needs to be one.
LANGUAGES, LEAST_DOCS = 128, 5
BUCKETS = 1 << 15
FULL_CODE = 7
#: Scale of a mean margin in its loss.
SHARPNESS = 6.0
AMBIGUOUS = 0.8
#: n-grams looked at together; a matter of memory only.
STRETCH = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Of each code point, its first lower-case letter, or a blank."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def grams(text: str | None) -> np.ndarray:
    """Buckets of the bigrams and trigrams of letters, where a run of other characters is one blank; empty without a letter."""
    code = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.concatenate([[32], code, [32]]).astype(np.uint64)
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    if len(code) < 3:
        return np.empty(0, np.int64)
    two = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + code[2:] * np.uint64(0x27D4EB2F165667C5)
    mixed = np.concatenate([two, three])
    return ((mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % BUCKETS


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= FULL_CODE:
        bits = np.arange(1, 1 << (n - 1))
        rows = [np.ones(len(bits), np.int8)] + [np.where(bits >> k & 1, -1, 1).astype(np.int8) for k in range(n - 1)]
        return np.stack(rows)
    width, random = math.ceil(10 * math.log2(n)), np.random.default_rng(9)
    # Of some random codes, the one whose closest words are farthest apart; every bit splits the languages in halves.
    best, apart = None, -1
    for _ in range(50):
        code = np.stack([random.permutation(np.where(np.arange(n) < n // 2, 1, -1)) for _ in range(width)], 1).astype(np.int8)
        same = code.astype(np.int32) @ code.T
        np.fill_diagonal(same, -width)
        if (distance := width - same.max()) > apart:
            best, apart = code, distance
    return best


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, languages: int = LANGUAGES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang and text of the documents to learn from."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    ids = known.select("doc_id", "lang").distinct()
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    # At most `languages` rows.
    learned = counts.orderBy(F.col("n").desc(), "lang").limit(languages).select("lang")
    chosen = smallest_hashes(ids.join(F.broadcast(learned), "lang", "left_semi"), "lang", {None: train_docs})
    # At most train_docs rows for each language, however often an id is repeated.
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    return one_row_each(rows, "doc_id", "lang").select("lang", "text")


def gram_counts(texts: DataFrame) -> DataFrame:
    """lang, bucket, n: how often each language has an n-gram; each task sums its own texts first."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, 64):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their codewords, log odds by bucket and bit, and the weight of each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages, self.code = languages, codewords(len(languages))
        # Each language speaks with the same voice, however many texts it has.
        rates = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS) if len(languages) else np.zeros((0, BUCKETS))
        yes, no = self.code.T == 1, self.code.T == -1
        odds = [np.log(rates[y].mean(0)) - np.log(rates[z].mean(0)) for y, z in zip(yes, no)]
        self.odds = np.stack(odds, 1).astype(np.float32) if odds else np.zeros((BUCKETS, 0), np.float32)
        # A bit weighs by the smallest mean margin that its languages have on their own n-grams.
        margins = rates @ self.odds * self.code if odds else np.zeros((len(languages), 0))
        weight = np.clip(margins.min(0), 0.05, None) if odds else np.zeros(0)
        self.weight = weight / weight.sum() if odds else weight

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the runner-up is near."""
        g = grams(text)
        if not len(g) or not self.languages:
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = sum(self.odds[g[at : at + STRETCH]].sum(0, dtype=np.float64) for at in range(0, len(g), STRETCH)) / len(g)
        loss = (np.logaddexp(0, -SHARPNESS * self.code * margin) * self.weight).sum(1)
        p = np.exp(-len(self.weight) * (loss - loss.min()))
        order = np.argsort(-p, kind="stable")
        return self.languages[order[0]], float(p[order[0]] / p.sum()), bool(p[order[1]] >= AMBIGUOUS * p[order[0]])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    rows = gram_counts(sample(docs, train_docs)).toArrow()
    langs = rows.column("lang").to_pylist()
    languages = sorted(set(langs))
    counts, place = np.zeros((len(languages), BUCKETS)), {x: i for i, x in enumerate(languages)}
    counts[np.array([place[x] for x in langs], int), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches):
        for b in slices(batches):
            found = [model.predict(t) for t in b.column(2).to_pylist()]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=schema.names)

    return docs.select("doc_id", is_held_out().alias("held_out"), "text").mapInArrow(run, schema)
