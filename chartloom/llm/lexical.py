"""Ranked lexical search by dual trees: exact best documents of every item.

Documents become sparse vectors of impacts over the items' terms. A task sorts the documents of a stretch by their strongest
terms and builds a hierarchy over them: `LEAF` documents a leaf, `FAN` nodes a node, every node with the coordinate maxima of
what it holds. The items of a block have a hierarchy of their own, where a node holds the weights of all its items'
terms. Pairs of nodes are searched from the roots: the product of the two vectors of maxima bounds every score below, and
a pair goes when that bound is below the weakest k-th score of the node's items. What is left at the leaves is scored
exactly, the highest bounds first, so that k-th scores rise early and cut the rest.

A first pass walks every item down its best path only; the k-th of these scores over all tasks is a bound that the second,
exact pass starts with. Items are taken in blocks of bounded size, with a pass over the documents for each block.

Cases: null and empty texts have no terms, are no documents of the counts and are never found; an item without a known term
gives no rows; equal scores go by ascending doc_id, null ids last; repeated document rows each count and may each have
a rank; repeated item rows (same id, same text) are one item, different texts under one id are items of their own; a
null item_id is an id like others; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.bpe import slices
from chartloom.llm.tables import staged

K = 10
#: Items and bytes of item text in a block.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
#: Documents of a leaf, children of a node, and documents and coordinates of a stretch.
LEAF, FAN, STRETCH_DOCS, STRETCH_PAIRS = 16, 8, 16_384, 4_000_000
#: Leaves scored at a time.
STEP = 8

#: Bytes of terms stay (A to Z as a to z), all others become blanks: terms hold digits, letters and all of UTF-8 beyond ASCII.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary) and tf, for every document with a term."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        place = {w: i for i, w in enumerate(shared.value)}
        for b in slices(batches):
            rows, lengths, sizes, terms, tf = [], [], [0], [], []
            for at, text in enumerate(b.column(1).to_pylist()):
                if words := terms_of(text):
                    known = [(p, n) for w, n in Counter(words).items() if (p := place.get(w)) is not None]
                    rows.append(at)
                    lengths.append(len(words))
                    terms += [p for p, _ in known]
                    tf += [n for _, n in known]
                    sizes.append(len(terms))
            ends = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places from start[i] to before stop[i], one after the other."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


@dataclass
class Level:
    """Sparse rows: those of row i stand from ends[i] to ends[i + 1]."""

    ends: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def products(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each of the rows with the dense weights, exact in 64-bit integers."""
        at = _ranges(self.ends[rows], self.ends[rows + 1])
        total = np.concatenate([[0], np.cumsum(weight[self.terms[at]] * self.values[at])])
        size = np.cumsum(self.ends[rows + 1] - self.ends[rows])
        return total[size] - total[np.concatenate([[0], size[:-1]])]

    def above(self, fan: int) -> Level:
        """A level with the coordinate maxima of each `fan` rows."""
        n, rows = len(self.ends) - 1, np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends)) // fan
        order = np.lexsort((self.terms, rows))
        rows, terms, values = rows[order], self.terms[order], self.values[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
        first = np.flatnonzero(new)
        most = np.maximum.reduceat(values, first) if len(first) else values
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows[first], minlength=-(-n // fan)))])
        return Level(ends, terms[first], most)


def levels_of(lowest: Level, leaf: int, fan: int) -> list[Level]:
    """From the rows themselves up to a single node."""
    out = [lowest, lowest.above(leaf)]
    while len(out[-1].ends) > 2:
        out.append(out[-1].above(fan))
    return out


def by_strongest(level: Level, weight: np.ndarray) -> np.ndarray:
    """An order of the rows in which those whose two strongest terms are the same stand together."""
    n = len(level.ends) - 1
    rows = np.repeat(np.arange(n), np.diff(level.ends))
    order = np.lexsort((level.terms, -weight[level.terms] * level.values, rows))
    two = np.full((2, n), -1, np.int64)
    for k in range(2):
        has = np.diff(level.ends) > k
        two[k, has] = level.terms[order[level.ends[:-1][has] + k]]
    return np.lexsort((np.arange(n), two[1], two[0]))


def reordered(level: Level, order: np.ndarray) -> Level:
    at = _ranges(level.ends[order], level.ends[order + 1])
    return Level(np.concatenate([[0], np.cumsum(np.diff(level.ends)[order])]), level.terms[at], level.values[at])


class Items:
    """The items of a block with their hierarchy. own: each item's places in the vocabulary; weight: by place."""

    def __init__(self, own: list[np.ndarray], weight: np.ndarray) -> None:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        terms = np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64)
        plain = Level(ends, terms, np.ones(len(terms), np.int64))
        self.weight, self.order = weight, by_strongest(plain, weight)
        self.levels = [reordered(plain, self.order)]
        while len(self.levels[-1].ends) > 2:
            self.levels.append(self.levels[-1].above(FAN))

    def dense(self, level: int, node: int) -> np.ndarray:
        """Weights of the terms below a node, 0 elsewhere."""
        x = self.levels[level]
        out = np.zeros(len(self.weight), np.int64)
        mine = x.terms[x.ends[node] : x.ends[node + 1]]
        out[mine] = self.weight[mine]
        return out


class Best:
    """The k best so far of each item (in tree order): (-score, null last, doc_id), and the score that another must reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor, self.found = k, np.maximum(floor, 1), [[] for _ in floor]

    def add(self, item: int, scores: list[int], ids: list) -> None:
        mine = self.found[item]
        mine += [(-s, i is None, i) for s, i in zip(scores, ids)]
        mine.sort(key=lambda x: x[:2] + ((x[2],) if x[2] is not None else ()))
        del mine[self.k :]
        if len(mine) == self.k:
            self.floor[item] = max(self.floor[item], -mine[-1][0])


class Stretch:
    """The hierarchy over some documents, sorted by their strongest terms. ids: doc_ids, ascending with nulls last."""

    def __init__(self, ids: list, docs: Level, weight: np.ndarray) -> None:
        self.order = by_strongest(docs, weight)
        self.ids, self.levels = ids, levels_of(reordered(docs, self.order), LEAF, FAN)

    def score(self, leaves: np.ndarray, weight: np.ndarray, item: int, best: Best) -> None:
        n = len(self.order)
        rows = _ranges(leaves * LEAF, np.minimum(leaves * LEAF + LEAF, n))
        scores = self.levels[0].products(rows, weight)
        good = np.flatnonzero(scores >= best.floor[item])
        good = good[np.lexsort((self.order[rows[good]], -scores[good]))[: best.k]]
        best.add(item, scores[good].tolist(), [self.ids[i] for i in self.order[rows[good]]])

    def walk(self, items: Items, best: Best) -> None:
        """Every item down its best path."""
        for item in range(len(best.found)):
            weight, node = items.dense(0, item), 0
            for level in range(len(self.levels) - 2, 0, -1):
                children = np.arange(node * FAN, min(node * FAN + FAN, len(self.levels[level].ends) - 1))
                node = int(children[self.levels[level].products(children, weight).argmax()])
            self.score(np.array([node]), weight, item, best)

    def search(self, items: Items, best: Best) -> None:
        """Both hierarchies at once, from the roots."""
        todo = [(len(items.levels) - 1, 0, len(self.levels) - 1, np.array([0]))]
        while todo:
            level, node, depth, nodes = todo.pop()
            weight = items.dense(level, node)
            bounds = self.levels[depth].products(nodes, weight)
            # The weakest k-th score of the items below the node.
            near = bounds >= best.floor[node * FAN**level : (node + 1) * FAN**level].min()
            nodes, bounds = nodes[near], bounds[near]
            if not len(nodes):
                continue
            if depth > 1:
                nodes = _ranges(nodes * FAN, np.minimum(nodes * FAN + FAN, len(self.levels[depth - 1].ends) - 1))
                depth -= 1
                # While the items' hierarchy goes on, both go down; the items' one waits where documents are still few.
                if level and len(nodes) > FAN:
                    todo += [(level - 1, child, depth, nodes) for child in range(node * FAN, min(node * FAN + FAN, len(items.levels[level - 1].ends) - 1))]
                else:
                    todo.append((level, node, depth, nodes))
            elif level:
                todo += [(level - 1, child, depth, nodes) for child in range(node * FAN, min(node * FAN + FAN, len(items.levels[level - 1].ends) - 1))]
            else:
                order = np.argsort(-bounds, kind="stable")
                nodes, bounds = nodes[order], bounds[order]
                at = 0
                while at < len(nodes) and bounds[at] >= best.floor[node]:
                    end = min(at + STEP, at + int(np.searchsorted(-bounds[at:], -best.floor[node], "right")))
                    self.score(nodes[at:end], weight, node, best)
                    at = end


def _stretches(batches, m_of, weight: np.ndarray):
    """Hierarchies over the documents of a task, with impacts in place of frequencies."""
    held, pairs = [], 0

    def made() -> Stretch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("doc_id").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None,) + (() if ids[i] is None else (ids[i],))), np.int64)
        m = m_of(table.column("n").to_numpy())
        lists, tf = (table.column(c).combine_chunks() for c in ("terms", "tf"))
        ends = lists.offsets.to_numpy().astype(np.int64)
        terms, tf = lists.values.to_numpy().astype(np.int64), tf.values.to_numpy().astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends)))
        return Stretch([ids[i] for i in order], reordered(Level(ends, terms, impact), order), weight)

    for b in slices(batches, 1024):
        held.append(b)
        pairs += len(b.column(2).flatten())
        if sum(x.num_rows for x in held) >= STRETCH_DOCS or pairs >= STRETCH_PAIRS:
            yield made()
            held, pairs = [], 0
    if sum(x.num_rows for x in held):
        yield made()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(own: list[list[bytes]], docs: DataFrame, k: int = K) -> DataFrame:
    """item (place in `own`), rank, doc_id, score. own: the terms of each item of a block."""
    vocabulary = sorted({w for words in own for w in words})
    place = {w: i for i, w in enumerate(vocabulary)}
    table = staged(vectors(docs, vocabulary))
    counted = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = counted[0], counted[1] or 1
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    places = [np.array(sorted({place[w] for w in words}), np.int64) for words in own]
    shared = docs.sparkSession.sparkContext.broadcast((places, weight))
    schema = T.StructType([T.StructField("item", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
    kind = table.select("doc_id").limit(0).toArrow().schema.field(0).type

    def task(exact: bool, floor: list[int]):
        def run(batches):
            own, weight = shared.value
            items = Items(own, weight)
            best = Best(np.array(floor, np.int64)[items.order], k)
            for stretch in _stretches(batches, lambda n: 10 + 90 * n * n_docs // n_terms, weight):
                (stretch.search if exact else stretch.walk)(items, best)
            rows = [(int(items.order[i]), x[2], -x[0]) for i, mine in enumerate(best.found) for x in mine]
            made = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), kind, pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["item", "doc_id", "score"])

        return table.mapInArrow(run, schema)

    floor = [0] * len(own)
    for item, score in _ranked(task(False, floor), k).where(F.col("rank") == k).select("item", "score").collect():
        floor[item] = score
    return _ranked(task(True, floor), k)


def rank_documents(items: DataFrame, docs: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, exactly."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").dropDuplicates()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil(size / block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        # One block of items, bounded in rows and bytes, is with the driver and in every task.
        rows = dealt.where(F.col("block") == block).select("item_id", "text").collect()
        if not rows:
            continue
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
        found = search_block([terms_of(r[1]) for r in rows], docs, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        return spark.createDataFrame([], kinds)
    return out
