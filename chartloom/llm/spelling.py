"""Spelling variants of words by blocked Gram matrices of letter counts.

Words are runs of Latin letters, counted over all documents. Two words one edit apart have letter counts whose squared
distance is at most two, and their lengths are adjacent. The letters are dealt to `GROUPS` groups of even weight; an edit
changes the counts of two groups at most, so near words agree in all groups but two, for one choice of these two. Words
with an equal choice and equal counts in the other groups are a block. Inside a block, sorted by length, NumPy products
of the count matrices of adjacent lengths give all squared distances; pairs of at most two are verified letter by letter.
A pair found in several blocks counts in the first. Blocks above `BLOCK_ROWS` are cut into parts, and each two parts
meet in a task of their own.

A word's form is its near word of largest count, if that is `TIMES` the word's; roots follow the forms, whose counts grow by
that factor at every step, so that a few joins of doubling reach reach the end.

Cases: null and empty texts hold no word; a null doc_id counts as an empty one in the hash; repeated rows count again; ties of
count go to the smallest word in code-point order; very long words are compared like others; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.bpe import slices
from chartloom.llm.tables import staged

#: Fewest letters and occurrences of a word; how much more frequent a form is; one in so many runs loses a letter.
LETTERS, OCCURRENCES, TIMES, TYPO_RATE = 6, 5, 5, 199
#: Groups of letters, words of one product, and words of a block that stay in one task.
GROUPS, TILE, BLOCK_ROWS = 5, 512, 20_000
#: Different words that a task sums up before it sends them on.
HELD = 300_000
#: Letters up to which pairs are verified side by side, and how many pairs at a time.
WIDE, PAIRS = 64, 50_000

#: All letters of runs are single bytes in this encoding; other characters become a mark that ends a run.
_CODE = "latin-1"
_CHOICES = list(itertools.combinations(range(GROUPS), 2))
#: For each set of differing groups (as bits), the first choice that covers it; -1 for more than two.
_FIRST = np.array([next((i for i, c in enumerate(_CHOICES) if not s & ~sum(1 << g for g in c)), -1) for s in range(1 << GROUPS)])


def runs_of(text: str, letters: int = LETTERS) -> list[bytes]:
    """Maximal runs of at least so many letters, A to Z lower-cased."""
    return re.findall(rb"[a-z\xc0-\xff]{%d,}" % letters, text.encode(_CODE, "replace").lower())


def typed(run: bytes, seed: int) -> bytes:
    """The run as it counts: where the crc32 of `<doc_id>:<run>` says so, without one letter. seed: crc32 of `<doc_id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode(_CODE).encode(), seed)
    if h % TYPO_RATE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word and n; every task sums up its own words before they meet."""

    def packed(held: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode(_CODE) for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict[bytes, int] = {}
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seed = zlib.crc32(f"{doc_id or ''}:".encode())
                for found, n in Counter(runs_of(text, letters)).items():
                    if len(word := typed(found, seed)) >= letters:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield packed(held)
                    held = {}
        yield packed(held)

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def counts_of(words: list[bytes]) -> np.ndarray:
    """A row of counts by letter (byte) for each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8)
    place = np.repeat(np.arange(len(words)) * 256, lengths) + letters
    return np.bincount(place, minlength=256 * len(words)).reshape(-1, 256).astype(np.uint16 if lengths.max(initial=0) < 1 << 16 else np.int64)


def groups_of_letters(words: DataFrame) -> np.ndarray:
    """The group of every letter (byte): the most frequent letter goes to the lightest group, then the next. One sum for each letter."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for b in slices(batches, 8192):
            total += np.bincount(np.frombuffer("".join(b.column(0).to_pylist()).encode(_CODE), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int64()), pa.array(total)], names=["letter", "n"])

    total = dict(words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n")).collect())
    load, group = [0] * GROUPS, np.zeros(256, np.int64)
    for n, letter in sorted(((-n, x) for x, n in total.items() if n)):
        group[letter] = k = load.index(min(load))
        load[k] -= n
    return group


def one_edit(words: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words at a[i] and b[i], of lengths at most one apart, differ by exactly one letter put in, left out or replaced."""
    out, size = np.zeros(len(a), bool), np.fromiter(map(len, words), np.int64, len(words))
    wide = np.maximum(size[a], size[b]) > WIDE
    for i in np.flatnonzero(wide):
        x, y = sorted((words[a[i]], words[b[i]]), key=len)
        at = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
        out[i] = x != y and x[at + (len(x) == len(y)) :] == y[at + 1 :]
    narrow = np.flatnonzero(~wide)
    letters = np.array([w[: WIDE + 1] for w in words], f"S{WIDE + 1}").view(np.uint8).reshape(len(words), WIDE + 1)
    letters = letters[:, : min(int(size.max(initial=0)), WIDE) + 1]
    for at in range(0, len(narrow), PAIRS):
        some = narrow[at : at + PAIRS]
        turn = size[a[some]] < size[b[some]]
        long, short = np.where(turn, b[some], a[some]), np.where(turn, a[some], b[some])
        x, y = letters[long], letters[short]
        differ = x != y
        # A letter more: after the first difference the longer word goes on like the shorter one, a place later.
        first, later = differ.argmax(1), x[:, 1:] != y[:, :-1]
        late = (later & (np.arange(later.shape[1]) >= first[:, None])).any(1)
        out[some] = np.where(size[long] == size[short], differ.sum(1) == 1, ~late)
    return out


def close_pairs(counts: np.ndarray, lengths: np.ndarray, block: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of pairs in one block, at adjacent lengths and at a squared distance of two or less, by Gram matrices, a tile at a time.

    Rows come sorted by block and length. side: only pairs of different sides, where given (0: meets its own kind as well)."""
    kind = np.float32 if int(counts.max(initial=0)) ** 2 * counts.shape[1] < 1 << 24 else np.float64
    rows = counts.astype(kind)
    norms = (rows * rows).sum(1)
    # Rows that can be near a tile's: those of its last block and length, and of the next length.
    order = block * (lengths.max(initial=0) + 2) + lengths
    for at in range(0, len(rows), TILE):
        end = min(at + TILE, len(rows))
        reach = int(np.searchsorted(order, order[end - 1] + 1, "right"))
        for other in range(at, reach, TILE):
            stop = min(other + TILE, reach)
            far = norms[at:end, None] + norms[other:stop] - 2 * (rows[at:end] @ rows[other:stop].T)
            i, j = np.nonzero(far <= 2)
            i, j = i + at, j + other
            fits = (i < j) & (block[i] == block[j]) & (lengths[j] - lengths[i] <= 1)
            if side is not None:
                fits &= (side[i] == 0) | (side[i] != side[j])
            yield i[fits], j[fits]


def near_words(words: DataFrame, group: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, n_near, form and form_n (the near word of largest count), for words with a near word. words: word and n."""
    random = np.random.default_rng(13).integers(1, 1 << 62, 256)

    def keyed(batches):
        for b in slices(batches, 4096):
            counts = counts_of([w.encode(_CODE) for w in b.column(0).to_pylist()])
            # One sum of weights for each group; equal sums stand for equal counts, and pairs are verified anyhow.
            sums = np.stack([(counts * np.where(group == g, random, 0)).sum(1) for g in range(GROUPS)], 1)
            for at, left_out in enumerate(_CHOICES):
                key = np.zeros(len(counts), np.int64)
                for g in set(range(GROUPS)) - set(left_out):
                    key = (key ^ sums[:, g]) * 0x1E3779B97F4A7C15 + (key >> 29)
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(counts), pa.int32()), pa.array(key), b.column(0), b.column(1)], names=["choice", "key", "word", "n"])

    def met(batches):
        rest = None
        for b in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([x for x in (rest, b) if x is not None])
            if not len(table):
                continue
            table = table.combine_chunks()
            cut = len(table)
            if b is not None:
                # What may go on in the next batch waits: the last block.
                last = [table.column(c)[-1].as_py() for c in ("choice", "key", "i", "j")]
                same = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(("choice", "key", "i", "j"), last)])
                cut = int(np.argmax(same))
            rest = table.slice(cut).combine_chunks().to_batches()[0] if cut < len(table) else None
            if cut:
                yield from summed(table.slice(0, cut))

    def summed(table: pa.Table):
        choice, key, i, j, part, n = (table.column(c).to_numpy() for c in ("choice", "key", "i", "j", "part", "n"))
        words = [w.encode(_CODE) for w in table.column("word").to_pylist()]
        new = np.zeros(len(words), bool)
        for x in (choice, key, i, j):
            new[1:] |= x[1:] != x[:-1]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = counts_of(words)
        letters = np.flatnonzero(counts.any(0))
        counts, own = counts[:, letters], group[letters]
        side = np.where(i == j, 0, np.where(part == i, 1, 2))
        found = [np.empty((2, 0), np.int64)]
        for a, b in close_pairs(counts, lengths, np.cumsum(new), side if side.any() else None):
            bits = np.zeros(len(a), np.int64)
            for g in range(GROUPS):
                bits |= (counts[a][:, own == g] != counts[b][:, own == g]).any(1).astype(np.int64) << g
            first = _FIRST[bits] == choice[a]
            found.append(np.stack([a[first], b[first]]))
        a, b = np.concatenate(found, 1)
        real = one_edit(words, a, b)
        one, other = np.concatenate([a[real], b[real]]), np.concatenate([b[real], a[real]])
        if not len(one):
            return
        # Of each word here: how many near words, and the one of largest count.
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda x: (-n[x], words[x]))] = np.arange(len(words))
        order = np.lexsort((rank[other], one))
        one, other = one[order], other[order]
        head = np.concatenate([[True], one[1:] != one[:-1]])
        text = lambda at: pa.array([words[x].decode(_CODE) for x in at], pa.string())
        times = np.diff(np.append(np.flatnonzero(head), len(one)))
        yield pa.RecordBatch.from_arrays([text(one[head]), pa.array(times), text(other[head]), pa.array(n[other[head]])], names=["word", "n_near", "form", "form_n"])

    rows = staged(words.mapInArrow(keyed, "choice int, key long, word string, n long"))
    sizes = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = rows.join(sizes, ["choice", "key"])
    # A block above the limit is met part by part; others have one part.
    parts = F.ceil(F.col("size") / block_rows).cast("int")
    placed = placed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("choice", "key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "word", "n")
    block = ["choice", "key", "i", "j"]
    sorted_ = placed.repartition(*block).sortWithinPartitions(*block, F.length("word"))
    found = sorted_.mapInArrow(met, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots_of(forms: DataFrame, steps: int) -> DataFrame:
    """word and root for rows of word and form; steps: how long a chain of forms can be."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        reached = staged(reached)
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return reached


def spelling_groups(docs: DataFrame, times: int = TIMES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = staged(word_counts(docs))
    near = near_words(words, groups_of_letters(words), block_rows)
    linked = words.join(near, "word", "left").withColumn("follows", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    linked = staged(linked.select(
        "word", F.when(F.col("follows"), F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("follows"), F.col("form_n")).alias("form_n"),
    ))
    least, most = linked.agg(F.min("n"), F.max("n")).first()
    steps = math.floor(math.log(most / least, times)) + 1 if most else 1
    roots = roots_of(linked.where("form is not null"), steps)
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
