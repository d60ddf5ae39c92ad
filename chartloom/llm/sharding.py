"""Shards of near-equal bytes for indivisible groups of documents, by Karmarkar-Karp differencing.

Documents of equal text are a group and stay together. Groups are dealt to workers; each starts with one partial partition
for a group (its bytes in one shard, nothing in the others) and again and again combines the two with the largest spread,
the largest shard of one with the smallest of the other, until one is left. The workers' partial partitions are combined
the same way, in rounds of `FAN_IN`, up to one; every round is a grouped job and only shard sums go up.

Cases: null text has no bytes and counts as an empty text; empty texts are one group; repeated rows each keep a slot;
null document ids come first in a shard; an empty table gives no rows; a group above its share fills a shard alone.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
#: Groups of one worker, workers combined at a time, and documents numbered by one window.
WORKER_GROUPS, FAN_IN, BLOCK_ROWS = 4096, 512, 20_000


def differenced(parts: np.ndarray) -> np.ndarray:
    """For rows of sums by shard, where each row's shards go: place[i, j] is the shard that takes shard j of row i.

    Ties are broken by the row's number, so that the same rows give the same result.
    """
    n, k = parts.shape
    # Leaves are the rows; a node's `sums` fall, and it knows how its two sides' shards lie in that order.
    orders = [np.argsort(-row, kind="stable") for row in parts]
    heap, sides, made = [], {}, n
    for i, row in enumerate(parts):
        s = row[orders[i]]
        heap.append((-int(s[0] - s[-1]), i, s))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        total = x + y[::-1]
        order = np.argsort(-total, kind="stable")
        sides[made] = (a, b, order)
        total = total[order]
        heapq.heappush(heap, (-int(total[0] - total[-1]), made, total))
        made += 1
    place = np.zeros((n, k), np.int64)
    # Downwards: `to[r]` is the final shard of a node's r-th largest sum.
    todo = [(heap[0][1], np.arange(k))] if n else []
    while todo:
        node, to = todo.pop()
        if node < n:
            place[node, orders[node]] = to
            continue
        a, b, order = sides[node]
        left = np.empty(k, np.int64)
        left[order] = to
        todo += [(a, left), (b, left[::-1])]
    return place


def balanced_groups(groups: DataFrame, shards: int = SHARDS, worker_groups: int = WORKER_GROUPS) -> DataFrame:
    """groups: h1, h2 and bytes. Adds `shard`."""
    workers = max(1, math.ceil(groups.count() / worker_groups))

    def of_worker(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "h1", "h2"], ascending=[False, True, True])
        first = np.zeros((len(rows), shards), np.int64)
        first[:, 0] = rows["bytes"]
        return pd.DataFrame({"h1": rows["h1"], "h2": rows["h2"], "bytes": rows["bytes"], "node": key[0], "part": differenced(first)[:, 0]})

    out = groups.withColumn("node", F.pmod(F.xxhash64("h1", "h2"), F.lit(workers))).groupBy("node").applyInPandas(of_worker, "h1 long, h2 long, bytes long, node long, part long")
    while workers > 1:
        above = math.ceil(workers / FAN_IN)
        sums = out.groupBy("node", "part").agg(F.sum("bytes").alias("bytes")).withColumn("up", F.pmod("node", F.lit(above)))

        def combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            table = rows.pivot(index="node", columns="part", values="bytes").reindex(columns=range(shards)).fillna(0).astype(np.int64).sort_index()
            place = differenced(table.to_numpy())
            return pd.DataFrame({"node": np.repeat(table.index.to_numpy(), shards), "part": np.tile(np.arange(shards), len(table)), "up": key[0], "to": place.ravel()})

        moves = sums.groupBy("up").applyInPandas(combined, "node long, part long, up long, to long")
        out = out.join(moves, ["node", "part"]).select("h1", "h2", "bytes", F.col("up").alias("node"), F.col("to").alias("part"))
        workers = above
    return out.select("h1", "h2", F.col("part").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, worker_groups: int = WORKER_GROUPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
    )
    # A group of copies is summed inside each task first, so a hot group is one row for each task.
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    placed = rows.join(balanced_groups(groups, shards, worker_groups), ["h1", "h2"])

    # Slots in two levels: blocks of a shard by hash, then rows inside a block.
    blocks = max(1, math.ceil(docs.count() / block_rows))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "h1", F.lit(7)), F.lit(blocks)))
    in_block = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = in_block.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "h1", "h2")
    return placed.withColumn("r", F.row_number().over(within) - 1).join(base, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
