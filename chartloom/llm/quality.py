"""Quality classifier by co-training: a view of the text's content and a view of the page's metadata teach each other.

Each view has a logistic classifier. In every round both learn from their labelled rows, and each hands the unlabelled rows
that it is surest of, with its own answer, to the other. At the end both views are calibrated together on labelled rows
that neither has learned from, and every document gets the combined probability of good quality; below `REJECT` it goes.

The classifiers are fitted on at most `LABELLED` rows of each label and `POOL` rows without one (smallest hash of the id
first, one row of a repeated id: the one whose columns hash lowest); features of this sample, of fixed width, are what comes to the driver. Scores are computed for all documents.

Cases: null text is an empty text, null metadata a value of its own, and a missing metadata column counts as null; labels
other than 0 and 1 are no labels, of repeated labels the lowest counts, labels without a document do nothing; without
rows of both labels every score is 0.5 and every document stays; repeated rows and null ids each give a row.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.bpe import slices
from chartloom.llm.tables import one_row_each, smallest_hashes

LABELLED, POOL = 3000, 6000
ROUNDS, HANDED = 3, 600
#: Share of a view's answers that must be right, on labelled rows it has not learned from, for it to hand them on.
CONFIDENT = 0.95
#: Share of the labelled rows that calibrate.
HELD = 4
REJECT = 0.3
META = ("lang", "source", "n_chars")
GRAMS = 256

_SHAPES = 10
#: Buckets of language, source, size in half octaves, and language with size.
_META_WIDTHS = (16, 64, 48, 64)
_META_WIDTH = sum(_META_WIDTHS)


def text_features(text: str | None) -> np.ndarray:
    """Shares of hashed character pairs, and the shape of the text: symbols, cases, digits, words, repetition."""
    text = text or ""
    out = np.zeros(GRAMS + _SHAPES, np.float32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return out
    for at in range(0, len(code) - 1, 1 << 20):
        part = code[at : at + (1 << 20) + 1].astype(np.uint64)
        pairs = (part[:-1] * np.uint64(0x9E3779B1) + part[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
        out[:GRAMS] += np.bincount((pairs % np.uint64(GRAMS)).astype(np.int64), minlength=GRAMS)
    out[:GRAMS] = np.sqrt(out[:GRAMS] / len(code))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    times = Counter(words)
    share = lambda low, high: ((code >= low) & (code <= high)).mean()
    out[GRAMS:] = [
        np.isin(code, [ord(c) for c in "#*$%&|<>!@^~_=+\\{}[]"]).mean() * 5, share(65, 90) * 3, share(48, 57) * 3, np.isin(code, [9, 10, 13, 32]).mean() * 3,
        len(text) / n / 20, len(times) / n, max(times.values(), default=0) / n, len(set(lines)) / len(lines), np.log1p(len(words)) / 10, 1,
    ]
    return out


def _bucket(value, width: int) -> int:
    return zlib.crc32(str(value).encode()) % width


def meta_features(lang, source, n_chars) -> np.ndarray:
    """One-hot buckets of language, source, size, and language with size: columns only, nothing of the text."""
    out = np.zeros(_META_WIDTH, np.float32)
    size = int(n_chars) if n_chars is not None and n_chars >= 0 else 0
    steps = (2 * size.bit_length() + (size >> max(0, size.bit_length() - 2)) % 2) if size else 0
    at = 0
    for place, width in zip((_bucket(lang, 16), _bucket(source, 64), min(47, steps), _bucket((lang, steps), 64)), _META_WIDTHS):
        out[at + place] = 1
        at += width
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights (the last one is the constant), with both labels weighing the same; accelerated gradient steps of fixed number."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = v = np.zeros(x.shape[1])
    rate = 4 / max(1e-9, (share[:, None] * x**2).sum() + decay)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ (share * (p - y)) + decay * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def logits(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _threshold(z: np.ndarray, right: np.ndarray) -> float:
    """The lowest value from which on at least `CONFIDENT` of the rows are right; infinite where there is none."""
    order = np.argsort(-z, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(z) + 1)
    sure = np.flatnonzero((share >= CONFIDENT) & (np.arange(len(z)) >= 4))
    return float(z[order[sure[-1]]]) if len(sure) else np.inf


def _sure(z: np.ndarray, free: np.ndarray, n: int, good_share: float, held: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a view is surest of, good and poor in the proportion of the labels, and its answers; only rows beyond
    the values at which the view is right on labelled rows that it has not learned from."""
    open_ = np.flatnonzero(free)
    order = open_[np.argsort(z[open_], kind="stable")]
    good, poor = order[::-1][: round(n * good_share)], order[: round(n * (1 - good_share))]
    good = good[z[good] >= max(0, _threshold(z[held], y[held] == 1))]
    poor = poor[-z[poor] >= max(0, _threshold(-z[held], y[held] == 0))]
    return np.concatenate([good, poor]), np.concatenate([np.ones(len(good)), np.zeros(len(poor))])


class Model:
    """Weights of the two views and of their combination; None where there is nothing to tell apart."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, good_share: float, rounds: int = ROUNDS) -> None:
        """y: 1, 0, or -1 without a label."""
        self.text = self.meta = self.both = None
        known = np.flatnonzero(y >= 0)
        held = known[np.arange(len(known)) % HELD == 0]
        learn = np.setdiff1d(known, held)
        if min((y[learn] == k).sum() for k in (0, 1)) == 0 or len(set(y[held])) < 2:
            return
        views, taught, free = (text, meta), [[], []], [y == -1, y == -1]
        for _ in range(rounds + 1):
            fitted = []
            for view, more in zip(views, taught):
                rows = np.concatenate([learn, *(r for r, _ in more)])
                fitted.append(fit_logistic(view[rows], np.concatenate([y[learn], *(a for _, a in more)])))
            for me, other in ((0, 1), (1, 0)):
                rows, answers = _sure(logits(fitted[me], views[me]), free[other], HANDED, good_share, held, y)
                taught[other].append((rows, answers))
                free[other][rows] = False
        self.text, self.meta = fitted
        z = np.stack([logits(w, v[held]) for w, v in zip(fitted, views)], 1)
        self.scale = np.maximum(z.std(0), 1e-9)
        self.both = fit_logistic(z / self.scale, y[held], steps=1000)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by the text, by the metadata, and by both."""
        if self.both is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        z = np.stack([logits(self.text, text), logits(self.meta, meta)], 1)
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (z[:, 0], z[:, 1], logits(self.both, z / self.scale)))


def _inputs(docs: DataFrame, *first: str) -> DataFrame:
    meta = [F.col(c) if c in docs.columns else F.lit(None).alias(c) for c in META]
    return docs.select(*first, *meta[:2], meta[2].cast("long").alias("n_chars"), "text")


def _features(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch whose columns from `at` on are lang, source, n_chars, text."""
    lang, source, n_chars, text = (b.column(at + i).to_pylist() for i in range(4))
    return np.stack([text_features(t) for t in text]), np.stack([meta_features(*m) for m in zip(lang, source, n_chars)])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    quality = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = ids.join(quality, "doc_id", "left").withColumn("y", F.coalesce("y", F.lit(-1)))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = smallest_hashes(known, "y", {-1: pool, 0: labelled, 1: labelled})
    width = GRAMS + _SHAPES

    def run(batches):
        for b in slices(batches, 64):
            text, meta = _features(b, 2)
            both = np.concatenate([text, meta], 1).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in both], pa.binary())], names=["doc_id", "y", "features"])

    # One row of each of the sample's ids: at most 2 * labelled + pool rows, however often an id is repeated.
    rows = one_row_each(_inputs(docs.join(F.broadcast(chosen.select("doc_id", "y")), "doc_id"), "doc_id", "y"), "doc_id", "y")
    found = rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("features", T.BinaryType())])).toArrow()
    found = found.sort_by([("y", "ascending"), ("doc_id", "ascending")])
    x = np.frombuffer(b"".join(found.column("features").to_pylist()), "<f4").reshape(-1, width + _META_WIDTH).astype(np.float64)
    # Labels by turns, so that the calibrating rows are a fair part.
    good = shares.get(1, 0) / max(1, shares.get(1, 0) + shares.get(0, 0))
    return Model(x[:, :width], x[:, width:], found.column("y").to_numpy(), good)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_text, p_meta, score and kept of every document."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.DoubleType()) for n in ("p_text", "p_meta", "score")), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for b in slices(batches, 256):
            p = model.score(*_features(b, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p), pa.array(p[2] >= REJECT)], names=schema.names)

    return _inputs(docs, "doc_id").mapInArrow(run, schema)


def kept_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with all their columns; each is judged where it lies, without a join."""
    schema, names = docs.schema, docs.columns

    def run(batches):
        nulls = lambda b: pa.nulls(b.num_rows)
        for b in slices(batches, 256):
            columns = [b.column(names.index(c)) if c in names else nulls(b) for c in (*META, "text")]
            yield b.filter(pa.array(model.score(*_features(pa.RecordBatch.from_arrays(columns, names=[*META, "text"]), 0))[2] >= REJECT))

    return docs.mapInArrow(run, schema)
