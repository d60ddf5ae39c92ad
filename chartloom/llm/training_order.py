"""Training-order materialisation: every sequence of token ids gets a global slot, and shards hold fixed-stride records in slot order.

Documents are encoded and cut into sequences of at most `length` ids, which are staged once with their place (task, number
in the task). Places are made one gapless index; a keyed Feistel permutation of the next even power of two, walked along
its cycle until it falls below the number of sequences, turns the index into the slot. Sequences are then dealt by ranges
of slots, and each shard is one row: its records padded to the same stride, one after another, with a manifest. A reader
finds slot s in shard s // records, at byte s % records * stride, and can resume anywhere.

Cases: null text is an empty text and gives the end id alone; repeated rows and null document ids are sequences like any
other; an empty table gives no shards; other columns are left out. The order is fixed by the key and the staged table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chartloom.llm.bpe import slices, tokenizer
from chartloom.llm.tables import staged

END_ID = 2
#: Ids of a sequence, and sequences of a shard.
LENGTH, RECORDS = 1024, 1024
ROUNDS = 6


def shard_schema(doc_id: T.StructField) -> T.StructType:
    """A shard's columns; ids keep the type that they have in the documents."""
    longs = T.ArrayType(T.LongType())
    kinds = {"shard": T.LongType(), "first_slot": T.LongType(), "records": T.LongType(), "stride": T.LongType(), "doc_ids": T.ArrayType(doc_id.dataType), "pieces": longs, "lengths": longs, "payload": T.BinaryType()}
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])



def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of indices in 0..n-1: a permutation that depends on the key."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & low)
        return left << half | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def narrow(path: str, *more_ids: int) -> bool:
    """Whether all ids fit two bytes; sequences then travel and rest in half the space until their shard is laid out."""
    return max(*tokenizer(path).tokens, *more_ids) < 1 << 16


def cut_sequences(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, short: bool = False) -> DataFrame:
    """task, number, doc_id, piece, length and tokens (little-endian unsigned, 32-bit, or 16-bit if short) of every sequence."""
    schema = T.StructType([
        T.StructField("task", T.LongType()), T.StructField("number", T.LongType()), docs.schema["doc_id"],
        T.StructField("piece", T.LongType()), T.StructField("length", T.LongType()), T.StructField("tokens", T.BinaryType()),
    ])
    end, width = end_id.to_bytes(4, "little"), 2 if short else 4

    def run(batches):
        encode, task, done = tokenizer(path).encode, TaskContext.get().partitionId(), 0
        for b in slices(batches):
            rows, pieces, tokens = [], [], []
            for at, data in enumerate(encode(b.column(1).to_pylist())):
                data += end
                if short:
                    data = np.frombuffer(data, "<u4").astype("<u2").tobytes()
                for piece, start in enumerate(range(0, len(data), width * length)):
                    rows.append(at)
                    pieces.append(piece)
                    tokens.append(data[start : start + width * length])
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, task, np.int64)), pa.array(np.arange(done, done + n)), b.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int64()), pa.array([len(t) // width for t in tokens], pa.int64()), pa.array(tokens, pa.binary()),
                ],
                names=schema.names,
            )
            done += n

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_slots(sequences: DataFrame, key: int) -> tuple[DataFrame, int]:
    """The staged sequences with `slot`, and their number. To the driver comes one count for each task that cut them."""
    counts = sequences.groupBy("task").agg(F.max("number").alias("last")).orderBy("task").collect()
    totals = np.array([r["last"] + 1 for r in counts], np.int64)
    n, tasks = int(totals.sum()), np.array([r["task"] for r in counts], np.int64)
    base = np.cumsum(totals) - totals

    @F.pandas_udf("long")
    def slot(task: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(permuted(base[np.searchsorted(tasks, task.to_numpy())] + number.to_numpy(), n, key))

    return sequences.withColumn("slot", slot("task", "number")), n


def training_shards(docs: DataFrame, path: str, key: int, length: int = LENGTH, records: int = RECORDS, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """One row for each shard, in slot order inside and between partitions."""
    short = narrow(path, end_id, pad_id)
    placed, n = with_slots(staged(cut_sequences(docs, path, length, end_id, short)), key)
    stride = 4 * length
    pad = pad_id.to_bytes(4, "little") * length
    parts = max(1, min(-(-n // records), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = placed.select((F.col("slot") - F.col("slot") % records).alias("first"), "slot", "doc_id", "piece", "length", "tokens")
    dealt = dealt.repartitionByRange(parts, "first").sortWithinPartitions("slot")

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        for first, group in itertools.groupby(rows(), key=lambda r: r[0]):
            of = list(group)
            of = [(*r[:5], np.frombuffer(r[5], "<u2").astype("<u4").tobytes()) for r in of] if short else of
            payload = b"".join([r[5] + pad[len(r[5]) :] for r in of])
            row = {"shard": first // records, "first_slot": first, "records": len(of), "stride": stride, "doc_ids": [r[2] for r in of], "pieces": [r[3] for r in of], "lengths": [r[4] for r in of], "payload": payload}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    schema = shard_schema(docs.schema["doc_id"])
    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(run, schema)


def write_shards(shards: DataFrame, folder: str) -> None:
    """Through Spark's writer, so that a lost executor leaves no half shard and any file system will do."""
    shards.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def records_of(shards: DataFrame) -> DataFrame:
    """One row for each record, from the payloads: slot, shard, doc_id, piece, length, tokens without padding."""
    r = shards.select("shard", "first_slot", "stride", "payload", F.posexplode(F.arrays_zip("doc_ids", "pieces", "lengths")).alias("n", "r"))
    return r.selectExpr(
        "first_slot + n as slot", "shard", "cast(n as long) as position", "r.doc_ids as doc_id", "r.pieces as piece", "r.lengths as length",
        "substring(payload, cast(n * stride + 1 as int), cast(4 * r.lengths as int)) as tokens",
    )


def read_from(spark: SparkSession, folder: str, slot: int = 0, records: int = RECORDS, ordered: bool = True) -> DataFrame:
    """The records from a slot on, in order: what a resumed run reads. ordered: False leaves out the sort over all shards,
    inside a shard records are in order anyhow."""
    shards = spark.read.parquet(folder).where(F.col("shard") >= slot // records)
    records_ = records_of(shards).where(F.col("slot") >= slot)
    return records_.orderBy("slot") if ordered else records_
