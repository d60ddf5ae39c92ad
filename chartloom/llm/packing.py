"""Harmonic packing of documents into sequences of at most `capacity` tokens.

A document's whole sequences stand alone; what is left of it, or all of a shorter one, is kept in one piece where it can be.
Class k holds pieces of more than capacity // (k + 1) and at most capacity // k tokens, and each of its bins takes exactly
k of them. Documents are dealt to workers, as many as the text asks for, and every worker fills the bins of each class by
itself with that fixed count. What the bins leave is filled from the worker's shortest pieces, as many as hold the
tokens that are missing, together with those that would leave a class's last bin open: the longest that fits goes whole into a
gap; where none fits and the gap is above `LOSS` tokens, one is cut. The rest of them makes bins of its own in the same way.

Cases: null text is an empty text and gives its end id alone; a document longer than a sequence spans several; repeated rows
and null document ids are packed like any other row (rows equal in id and text share a worker, which is filled in turns of
`TURN_BYTES`); an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.bpe import slices, tokenizer

CAPACITY = 4096
END_ID = 2
#: Bytes of text and documents for each worker, and bytes of ids that it packs at a time.
WORKER_BYTES, WORKER_ROWS, TURN_BYTES = 4_000_000, 20_000, 64 << 20
#: Tokens that a sequence may be left without, and the shortest piece that a cut makes.
LOSS, LEAST_PIECE = 32, 32
#: Bits of a sequence id for the bins of one worker.
BIN_BITS = 32


def harmonic_class(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    return capacity // lengths


def fillers(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Places of the shortest pieces that together hold what the bins of all others would leave."""
    order = np.argsort(lengths, kind="stable")
    short = lengths[order]
    # A piece's share of its bin's gap.
    gap = capacity / harmonic_class(short, capacity) - short
    held, missing = np.cumsum(short), gap.sum() - np.cumsum(gap)
    if gap.sum() <= 0:
        return order[:0]
    return order[: int(np.argmax(held >= missing)) + 1]


def fill_bins(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (place, from, length, bin, offset) that cover all lengths, each of 1 to `capacity`."""
    out: list[tuple[int, int, int, int, int]] = []
    kind = harmonic_class(lengths, capacity)
    loose = np.zeros(len(lengths), bool)
    loose[fillers(lengths, capacity)] = True
    gaps: list[tuple[int, int]] = []
    bins = 0
    for k in np.unique(kind[~loose]).tolist():
        mine = np.flatnonzero((kind == k) & ~loose)
        closed = len(mine) // k * k
        loose[mine[closed:]] = True
        for at in range(0, closed, k):
            offset = 0
            for place in mine[at : at + k].tolist():
                out.append((place, 0, int(lengths[place]), bins, offset))
                offset += int(lengths[place])
            if offset < capacity:
                gaps.append((capacity - offset, bins))
            bins += 1
    # What is loose, by length: (length, place, from).
    rest = sorted((int(lengths[p]), p, 0) for p in np.flatnonzero(loose).tolist())
    gaps.sort()
    while rest:
        if gaps:
            room, bin_ = gaps.pop()
        else:
            room, bin_ = capacity, bins
            bins += 1
        while rest and room:
            at = bisect.bisect_right(rest, (room, len(lengths), 0)) - 1
            if at >= 0:
                n, place, start = rest.pop(at)
                used = n
            elif room > LOSS and rest[0][0] >= 2 * LEAST_PIECE:
                # The shortest that is too long gives its head.
                n, place, start = rest.pop(0)
                used = min(room, n - LEAST_PIECE)
                bisect.insort(rest, (n - used, place, start + used))
            else:
                break
            out.append((place, start, used, bin_, capacity - room))
            room -= used
    return out


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (binary) and doc_tokens of every whole sequence of a document and of what it has beyond."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
    ])
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = tokenizer(path).encode
        for b in slices(batches):
            rows, starts, ids, totals = [], [], [], []
            for at, data in enumerate(encode(b.column(1).to_pylist())):
                data += end
                for start in range(0, len(data), 4 * capacity):
                    rows.append(at)
                    starts.append(start // 4)
                    ids.append(data[start : start + 4 * capacity])
                    totals.append(len(data) // 4)
            doc_ids = b.column(0).take(pa.array(rows, pa.int64()))
            made = [pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays([doc_ids, *made], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, worker_bytes: int = WORKER_BYTES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    workers = max(1, math.ceil(size / worker_bytes), math.ceil(rows / WORKER_ROWS))
    cut = cut_documents(docs, path, capacity, end_id)
    worker = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(workers)).alias("worker")
    order = ["worker", "doc_id", "start", "hash"]
    # One exchange by worker and one sort; the hash settles ties, so that equal tables are packed alike.
    dealt = cut.select("doc_id", "start", "length", "ids", "doc_tokens", worker, F.xxhash64("ids").alias("hash")).repartition("worker").sortWithinPartitions(*order)
    schema = T.StructType([*(cut.schema[c] for c in ("doc_id", "start", "length", "ids", "doc_tokens")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def packed(table: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        pieces = fill_bins(table.column("length").to_numpy(), capacity)
        place, start, length, bin_, offset = (np.array(x, np.int64) for x in zip(*pieces))
        taken = table.select(["doc_id", "start", "ids", "doc_tokens", "length"]).take(pa.array(place)).combine_chunks()
        ids = taken.column("ids").to_pylist()
        for i in np.flatnonzero(length != taken.column("length").to_numpy()).tolist():
            ids[i] = ids[i][4 * start[i] : 4 * (start[i] + length[i])]
        whole_start = taken.column("start").to_numpy() + start
        made = [pa.array(whole_start), pa.array(length), pa.array(ids, pa.binary()), taken.column("doc_tokens").combine_chunks(), pa.array(bin_ + first), pa.array(offset)]
        return pa.RecordBatch.from_arrays([taken.column("doc_id").combine_chunks(), *made], names=schema.names), int(bin_.max()) + 1

    def run(batches):
        held, worker, bytes_, bins = [], None, 0, 0
        for b in batches:
            of = b.column("worker").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if held and (of[at] != worker or bytes_ > TURN_BYTES):
                    out, used = packed(pa.Table.from_batches(held), (worker << BIN_BITS) + bins)
                    yield out
                    bins = bins + used if of[at] == worker else 0
                    held, bytes_ = [], 0
                worker = int(of[at])
                held.append(b.slice(at, to - at))
                bytes_ += 4 * (pc.sum(held[-1].column("length")).as_py() or 0)
        if held:
            yield packed(pa.Table.from_batches(held), (worker << BIN_BITS) + bins)[0]

    return dealt.mapInArrow(run, schema)
