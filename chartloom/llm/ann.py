"""Approximate nearest neighbours with a robust-pruned directed graph for each shard of vectors.

Different vectors are dealt to shards by hash. In a shard, batches of vectors search the graph greedily from its medoid;
what a search visits is pruned: the nearest candidate becomes an edge, and candidates that are closer to it, by the factor
`ALPHA`, than to the vector itself are left out, so that few but diverse edges remain. Back edges are pruned the same way.
Queries search every shard with a beam: a shard and its graph, which are stored, meet the queries in large blocks, read once for
each. The shards' best are rescored in double precision on the vectors as they came and merged.

Nearness is the cosine. Vectors that are null or zero, or hold a null or a value that is not finite, take no part. Equal vectors
are one node with the smallest `k` + 1 ids, which is all that a list of k can need; of rows that repeat a vec_id, the
smallest vector counts; vectors meet only those of their own length; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.tables import staged

K = 5
#: Vectors of a shard, queries that meet a shard in one task, and queries searched side by side.
SHARD_ROWS, BLOCK_ROWS, SIDE_ROWS = 2048, 8192, 512
#: Edges of a node, width of the searches that build a graph and of those for queries, pruning factor, nodes put in at a time.
DEGREE, BEAM, QUERY_BEAM, ALPHA, BATCH = 24, 64, 64, 1.2, 256

_INDEX = "dim int, shard int, vectors binary, ids binary, graph binary, start int"
_HIT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, dim of the vectors that take part, one row for each vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    real = vectors.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return real.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def prune(points: np.ndarray, at: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges for the nodes `at` from their candidates `near` (-1: none), all nodes at once."""
    near = np.sort(near, 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == at[:, None]] = -1
    own = points[near]
    far = 2 - 2 * np.einsum("bcd,bd->bc", own, points[at])
    far[near < 0] = np.inf
    order = np.argsort(far, 1)
    far, near = np.take_along_axis(far, order, 1), np.take_along_axis(near, order, 1)
    own = np.take_along_axis(own, order[..., None], 1)
    row, out = np.arange(len(at)), np.full((len(at), degree), -1, np.int32)
    for k in range(degree):
        best = far.argmin(1)
        live = np.isfinite(far[row, best])
        if not live.any():
            break
        out[live, k] = near[row, best][live]
        between = 2 - 2 * np.einsum("bcd,bd->bc", own, own[row, best])
        # Squared distances: the factor counts twice.
        far[alpha * alpha * between <= far] = np.inf
        far[row, best] = np.inf
    return out


def search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: nodes and similarities, nearest first (-1: none)."""
    n, q = len(points), len(queries)
    beam = min(beam, n)
    row = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    nodes, sims, open_ = np.full((q, beam), -1, np.int32), np.full((q, beam), -np.inf, np.float32), np.zeros((q, beam), bool)
    nodes[:, 0], sims[:, 0], open_[:, 0] = start, queries @ points[start], True
    seen[:, start] = seen[:, -1] = True
    while open_.any():
        go = np.flatnonzero(open_.any(1))
        best = np.where(open_[go], sims[go], -np.inf).argmax(1)
        open_[go, best] = False
        next_ = graph[nodes[go, best]]
        next_ = np.where(seen[go[:, None], next_], -1, next_)
        seen[go[:, None], next_] = True
        new = np.einsum("qrd,qd->qr", points[next_], queries[go])
        new[next_ < 0] = -np.inf
        all_nodes, all_sims = np.concatenate([nodes[go], next_], 1), np.concatenate([sims[go], new], 1)
        all_open = np.concatenate([open_[go], next_ >= 0], 1)
        top = np.argsort(-all_sims, 1, kind="stable")[:, :beam]
        nodes[go], sims[go], open_[go] = (np.take_along_axis(x, top, 1) for x in (all_nodes, all_sims, all_open))
    del row
    return nodes, sims


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph of unit vectors and its entry."""
    n = len(points)
    start = int((points @ points.mean(0)).argmax())
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(3).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done, sweep = 1, 0
    while sweep < 2:
        # Batches double while the graph is small, so that early nodes find each other.
        size = min(BATCH, max(1, done)) if sweep == 0 else BATCH
        batch = order[done : done + size]
        if len(batch):
            found, _ = search(points, graph, start, points[batch], beam)
            graph[batch] = prune(points, batch, np.concatenate([found, graph[batch]], 1), degree, alpha if sweep else 1.0)
            _back_edges(points, graph, batch, degree, alpha if sweep else 1.0)
        done += size
        if done >= n:
            done, sweep = 0, sweep + 1
    return graph, start


def _back_edges(points: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    to = graph[batch].ravel()
    source = np.repeat(batch, degree)[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    # All new back edges of a node are candidates, in a table as wide as the largest number of them.
    more = np.full((len(nodes), count.max(initial=0)), -1, np.int32)
    more[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = source
    for at in range(0, len(nodes), BATCH):
        some = nodes[at : at + BATCH]
        graph[some] = prune(points, some, np.concatenate([graph[some], more[at : at + BATCH]], 1), degree, alpha)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    # Scale first, so that squares of very large or small components stay finite.
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def raw_kind(vectors: DataFrame) -> str:
    """The components as they are stored: 8 bytes where they came as doubles, else 4."""
    return "<f8" if isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType) else "<f4"


def index(vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row for each shard: its vectors, the smallest ids of each, the graph and its entry; and the number of shards."""
    kind = raw_kind(vectors)
    same = Window.partitionBy("dim", "embedding").orderBy("vec_id")
    # The smallest ids of a vector are cut inside each task before the shuffle.
    nodes = vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    nodes = nodes.groupBy("dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    shards = max(1, math.ceil(vectors.count() / shard_rows))

    def of_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        raw = np.stack(rows["embedding"].to_list()).astype(kind)
        ids = np.full((len(rows), k + 1), -1, "<i8")
        held = np.zeros((len(rows), k + 1), bool)
        for at, x in enumerate(rows["ids"]):
            ids[at, : len(x)], held[at, : len(x)] = x, True
        graph, start = build(unit(raw))
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "vectors": raw.tobytes(), "ids": np.concatenate([ids.ravel(), held.ravel().astype("<i8")]).tobytes(), "graph": graph.astype("<i4").tobytes(), "start": start}])

    # As many partitions as shards: building is work for the processor, which partitions joined by their bytes would not show.
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")).repartition(shards, "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInPandas(of_shard, _INDEX), shards


def nearest(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query, its own row left out."""
    rows = staged(usable(vectors))
    kind = raw_kind(rows)
    shards_of, shards = index(rows, k, shard_rows)
    # Stored, so that a lost executor costs no graph.
    shards_of = staged(shards_of)
    queries = rows.where(is_query)
    blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    # The stated queries against all rows, in blocks: every block meets every shard once, and brings its vectors only.
    place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select("dim", "vec_id", "embedding", place, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    met = shards_of.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = [x for r in shard.itertuples(index=False) if len(asked) for x in _best(asked, r, k, beam, kind)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["dim", "shard", "block"]
    found = asked.groupBy(*key).cogroup(met.groupBy(*key)).applyInPandas(meet, _HIT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(asked: pd.DataFrame, r, k: int, beam: int, kind: str) -> list[tuple[int, int, float]]:
    raw = np.frombuffer(r.vectors, kind).reshape(-1, r.dim)
    ids, held = np.frombuffer(r.ids, "<i8").reshape(2, len(raw), k + 1)
    graph = np.frombuffer(r.graph, "<i4").reshape(len(raw), -1)
    points, out = unit(raw), []
    for at in range(0, len(asked), SIDE_ROWS):
        side = asked.iloc[at : at + SIDE_ROWS]
        queries = np.stack(side["embedding"].to_list())
        nodes, _ = search(points, graph, r.start, unit(queries), max(beam, 2 * k))
        for q, vector, near in zip(side["vec_id"], queries.astype(np.float64), nodes):
            near = near[near >= 0]
            exact = raw[near].astype(np.float64)
            score = (exact * vector).sum(1) / (np.sqrt((exact * exact).sum(1)) * np.sqrt((vector * vector).sum()))
            pairs = [(-s, int(i)) for s, node in zip(score, near) for i, real in zip(ids[node], held[node]) if real and i != q]
            out += [(int(q), i, float(-s)) for s, i in sorted(pairs)[:k]]
    return out
