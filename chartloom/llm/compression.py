"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks, with limits by length.

The ratio is compressed size over size. Text that repeats itself falls below its band, text without the order of language
lies above it. Short texts compress less, so the limits of a whole document follow its length: at lengths half an octave
apart the middle ratio and its spread, between them a straight line; a document goes that is more than `REACH` spreads
off. Then the text is cut into chunks of each size of `CHUNKS` that it reaches, each size with a band of its own: small
chunks show short stretches, large ones what repeats over a distance. The last chunk is the final bytes of its size, so
every byte is judged, and a document goes when of one size more than `CHUNK_SHARE` of the chunks lie outside their band.

The limits are fitted on all documents that are labelled good and pass the base counts (of a repeated id the row whose text
hashes lowest). Every text is measured where it lies and only measures meet their labels; quartiles by length are exact on ratios
counted by hundred-thousandths, tails of chunk ratios on thousandths, where documents weigh the same. To the driver come a
row for each length step and one for each thousandth. With fewer than `LEAST` documents the wide bands of `WIDE` hold.

Base counts come first: a document with few words, or mostly made of repeated word windows, fails whatever its ratios.

Cases: null text has no words and fails; an empty text likewise; a text below the smallest chunk is judged by its whole, which
is all of it; very long texts are compressed in one stream; labels other than 1 are not good, of repeated labels the
lowest counts; repeated rows and null ids each give a row; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.bpe import slices
from chartloom.llm.tables import staged

LEVEL = 3
CHUNK_SHARE = 0.25
#: Bytes of a chunk, and the share of good chunks that may lie below, and above, the band of their size.
CHUNKS, CHUNK_TAIL = (256, 1024, 4096), 0.001
#: Fewest documents labelled good to fit on.
LEAST = 200
#: Spreads (between quartiles) that a whole document may be off, documents for a point of the line, and the least spread.
REACH, POINT_DOCS, LEAST_SPREAD = 3.0, 20, 0.005
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Weight of a document, shared by its chunks of a size.
WEIGHT = 1 << 30

_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_COLUMNS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("n_bytes", "long"), ("ratio", "double"), ("n_chunks", "long"), ("n_chunks_out", "long"), ("chunk_out_share", "double"),
]


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of three that are found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    a = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    if len(number) == n:
        return 0
    base = len(number)
    pairs = np.unique(a[:-1] * base + a[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * base + a[2:], return_inverse=True, return_counts=True)
    found = np.flatnonzero(times[which] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[found + k] = True
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.encode().split():
            seen.add(line)
    blanks = sum(text.count(c) for c in " \t\n\v\f\r")
    return len(words), len(text) - blanks, sum(map(len, _SYMBOLS.findall(text))), again, repeat_words(words)


@dataclass(frozen=True)
class Limits:
    """points: log2 of the length, middle ratio and spread, by length. chunks: size, lowest and highest ratio."""

    points: tuple[tuple[float, float, float], ...]
    chunks: tuple[tuple[int, float, float], ...]

    def whole(self, n_bytes: int) -> tuple[float, float]:
        """Lowest and highest ratio of a document. Beyond the outermost points the line goes on and the band widens."""
        x, (at, middle, spread) = math.log2(n_bytes), map(np.array, zip(*self.points))
        beyond = max(0.0, x - at[-1], at[0] - x)
        m, d = np.interp(x, at, middle), np.interp(x, at, spread) * (1 + 2 * beyond)
        if beyond and len(at) > 1:
            i, j = (-2, -1) if x > at[-1] else (0, 1)
            m += (middle[j] - middle[i]) / (at[j] - at[i]) * (x - at[-1] if x > at[-1] else x - at[0])
        return float(m - REACH * d), float(m + REACH * d)


#: Without labels: bands that let pass what is not plainly broken.
WIDE = Limits(((8.0, 0.65, 0.1), (10.0, 0.55, 0.08), (12.0, 0.48, 0.07), (14.0, 0.44, 0.07), (17.0, 0.40, 0.07)), ((256, 0.48, 0.90), (1024, 0.30, 0.70), (4096, 0.26, 0.70)))


def chunk_ratios(data: bytes, size: int, compress) -> list[float]:
    if len(data) < size:
        return []
    return [len(compress(data[at : at + size])) / size for at in [*range(0, len(data) - size, size), len(data) - size]]


def bands(data: bytes, compress, limits: Limits = WIDE) -> tuple[float, int, int, bool, float]:
    """Ratio of the whole, chunks of all sizes, chunks outside their band, the verdict, and the largest share outside of a size."""
    if not data:
        return 0.0, 0, 0, False, 0.0
    ratio = len(compress(data)) / len(data)
    low, high = limits.whole(len(data))
    n, n_out, worst = 0, 0, 0.0
    for size, least, most in limits.chunks:
        ratios = chunk_ratios(data, size, compress)
        out = sum(not least <= x <= most for x in ratios)
        n, n_out, worst = n + len(ratios), n_out + out, max(worst, out / max(1, len(ratios)))
    return ratio, n, n_out, low <= ratio <= high and worst <= CHUNK_SHARE, worst


def passes_base(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] >= MIN_WORDS and 100 * counts[4] <= REPEAT_PERCENT * counts[0]


def fit(docs: DataFrame, labels: DataFrame, least: int = LEAST) -> Limits:
    """Limits from all documents labelled good."""
    quality = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    good = quality.where("y = 1").select("doc_id")
    fields = [("n_bytes", pa.int64()), ("ratio", pa.float64()), ("chunks", pa.list_(pa.struct([("size", pa.int64()), ("ratio", pa.float64()), ("weight", pa.int64())])))]
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("hash long, n_bytes long, ratio double, chunks array<struct<size:long,ratio:double,weight:long>>").fields])

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in slices(batches):
            out = []
            for text in b.column(1).to_pylist():
                data = (text or "").encode()
                if not passes_base(base_counts(text)):
                    out.append((None, None, None))
                    continue
                chunks = []
                for size in CHUNKS:
                    ratios = chunk_ratios(data, size, compress)
                    chunks += [{"size": size, "ratio": round(x, 3), "weight": WEIGHT // len(ratios)} for x in ratios]
                out.append((len(data), len(compress(data)) / len(data), chunks))
            made = [pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], names=schema.names)

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, schema)
    chosen = rows.groupBy("doc_id").agg(F.min(F.struct("hash", "n_bytes", "ratio", "chunks")).alias("m")).select("doc_id", "m.*")
    known = staged(chosen.where("n_bytes is not null").join(good, "doc_id").select("n_bytes", "ratio", "chunks"))
    step = F.bround(2 * F.log2("n_bytes")).alias("step")
    whole = known.groupBy(step, F.round("ratio", 5).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log2("n_bytes")).alias("x"))
    quartiles = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    lengths = whole.groupBy("step").agg(F.sum("n").alias("n"), (F.sum("x") / F.sum("n")).alias("x"), quartiles.alias("q")).orderBy("step").collect()
    if sum(r.n for r in lengths) < least:
        return WIDE
    each = known.select(F.explode("chunks").alias("c")).groupBy("c.size", "c.ratio").agg(F.sum("c.weight").alias("weight"))
    return limits_of([(r.n, r.x, *r.q) for r in lengths], [tuple(r) for r in each.collect()])


def limits_of(lengths: list[tuple[int, float, float, float, float]], chunk_counts: list[tuple[int, float, int]]) -> Limits:
    """From documents, mean log2 of the length and quartiles of each length step, and from size, ratio and weight of chunks."""
    points = [(x, middle, max(LEAST_SPREAD, high - low)) for n, x, low, middle, high in lengths if n >= POINT_DOCS]
    chunks = []
    for size, *wide in WIDE.chunks:
        rows = sorted((r, w) for s, r, w in chunk_counts if s == size)
        if rows:
            r, below = np.array([r for r, _ in rows]), np.cumsum([w for _, w in rows])
            # The ratios are rounded, so the band ends half a step outside.
            wide = [r[np.searchsorted(below, CHUNK_TAIL * below[-1])] - 0.0005, r[np.searchsorted(below, (1 - CHUNK_TAIL) * below[-1])] + 0.0005]
        chunks.append((size, float(wide[0]), float(wide[1])))
    return Limits(tuple(points) or WIDE.points, tuple(chunks))


def compression_rules(docs: DataFrame, limits: Limits = WIDE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the ratios behind the verdict."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[t]) for n, t in _COLUMNS)])

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                counts = base_counts(text)
                failed = not passes_base(counts)
                data = (text or "").encode()
                ratio, n, out, good, share = bands(data, compress, limits)
                rows.append((*counts, failed, good and not failed, len(data), ratio, n, out, share))
            columns = list(zip(*rows)) or [()] * len(_COLUMNS)
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            made = [pa.array(c, kinds[t]) for c, (_, t) in zip(columns, _COLUMNS)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def kept_documents(docs: DataFrame, limits: Limits = WIDE) -> DataFrame:
    """The documents that the rules keep, with all their columns; the verdict is taken beside each text, without a join."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in slices(batches):
            keep = []
            for text in b.column(at).to_pylist():
                keep.append(passes_base(base_counts(text)) and bands((text or "").encode(), compress, limits)[3])
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
