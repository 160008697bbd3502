"""Sequences of token ids in training order, in shards of fixed stride.

Every sequence has an index (the counts of earlier slices plus its place in its own slice). A keyed
Feistel network over the next even power of two, walked until it lands below the number of
sequences, turns the index into a global slot: a permutation that needs no sort and no stored order.
Range partitions of slots are written as shards of ``per_shard`` records. Record r of shard s is slot
s * per_shard + r, and begins at r * stride, so a reader that stopped at a slot goes on at a byte.

A record is the number of tokens (2 bytes), the piece (4), the CRC-32 of the ids (4), and the ids,
padded with zeros; all little-endian, 2 bytes an id. Shards are rows of a Parquet table (shard, first_slot, records, blob), so that any file
system Spark reaches can hold them.

Defined results: null text is the empty text, whose one sequence is the end mark; repeated rows are
separate sequences; an empty table gives no shards; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlatlas.llm.common import CHUNK, scratch
from crawlatlas.llm.tokens import encoder

ROUNDS = 6
HEADER = np.dtype([("length", "<u2"), ("piece", "<u4"), ("crc", "<u4")])


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A round function: 64-bit finaliser of the half block and the round's key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(key: int) -> list[int]:
    return [int(k) for k in _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), key)]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of indices below n: a permutation of range(n) for each key."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, bits, keys = np.uint64((1 << half) - 1), np.uint64(half), round_keys(key)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walking):
            x = out[walking]
            left, right = x >> bits, x & mask
            for k in keys:
                left, right = right, left ^ (_mixed(right, k) & mask)
            out[walking] = x = (left << bits) | right
            walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, length: int, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, n_tokens, ids (binary, 2 bytes an id), slice and place of every sequence."""

    def run(batches):
        place, slice_no, encode = 0, TaskContext.get().partitionId(), encoder(path).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), CHUNK):
                source, rows = [], []
                for i, t in enumerate(texts.slice(at, CHUNK).to_pylist()):
                    ids = np.append(encode(t or ""), end)
                    if ids.max() > 0xFFFF:
                        raise ValueError(f"id {ids.max()} of {path} does not fit the 2 bytes of an id")
                    ids = ids.astype("<u2")
                    for piece, start in enumerate(range(0, len(ids), length)):
                        own = ids[start:start + length]
                        source.append(at + i)
                        rows.append((piece, len(own), own.tobytes(), slice_no, place))
                        place += 1
                columns = [pa.array(c, k) for c, k in zip(
                    zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(source)), *columns],
                                                 ["key", "piece", "n_tokens", "ids", "slice", "place"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, piece int, n_tokens int, ids binary, slice int, place long")
    return out.withColumnRenamed("key", key)


def with_slots(found: DataFrame, path: str, key: int) -> DataFrame:
    """``sequences``, written to ``path`` and read again with their global slot."""
    spark = found.sparkSession
    found.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(found.schema).parquet(path)
    counts = stored.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # One row a slice, as many as there were input splits.
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("slice").alias("b_slice"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("b_base"))
    indexed = stored.join(F.broadcast(base), stored["slice"] == base["b_slice"]).select(
        *[c for c in stored.columns if c not in ("slice", "place")], (F.col("b_base") + F.col("place")).alias("slot"))

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), total, key))

    return indexed.withColumn("slot", slot_of("slot"))


def write_shards(slotted: DataFrame, path: str, length: int, per_shard: int, key: str = "doc_id") -> None:
    """Shards below ``path``/shards and the key of every slot, which need not be a number, in ``path``/keys."""
    stride = HEADER.itemsize + 2 * length

    def blobs(batches):
        shard, slots, records = None, [], []

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([slots[0]], pa.int64()), pa.array([len(records)], pa.int32()),
                 pa.array([b"".join(records)], pa.binary())], ["shard", "first_slot", "records", "blob"])

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for slot, piece, n, ids in zip(*columns, strict=True):
                if shard is not None and slot // per_shard != shard:
                    yield done()
                    slots, records = [], []
                shard = slot // per_shard
                head = np.array([(n, piece, zlib.crc32(ids))], HEADER).tobytes()
                slots.append(slot)
                records.append((head + ids).ljust(stride, b"\0"))
        if records:
            yield done()

    slotted.select("slot", key, "piece", "n_tokens").write.parquet(f"{path}/keys")
    ranged = (slotted.select("slot", "piece", "n_tokens", "ids")
              .repartitionByRange(F.floor(F.col("slot") / per_shard)).sortWithinPartitions("slot"))
    (ranged.mapInArrow(blobs, "shard long, first_slot long, records int, blob binary")
     .write.option("compression", "zstd").parquet(f"{path}/shards"))


def read_from(spark: SparkSession, path: str, length: int, slot: int = 0) -> DataFrame:
    """slot, piece, n_tokens, crc32 and ids (array<int>) of every record from ``slot`` on.

    Earlier shards are not read, and in the shard that holds the slot reading begins at its byte.
    """
    stride = HEADER.itemsize + 2 * length

    def run(batches):
        for batch in batches:
            for first, count, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                skip = max(0, slot - first)
                for begin in range(skip, count, CHUNK):
                    n = min(CHUNK, count - begin)
                    raw = np.frombuffer(blob, np.uint8, n * stride, begin * stride).reshape(n, stride)
                    head = np.ascontiguousarray(raw[:, :HEADER.itemsize]).view(HEADER).ravel()
                    ids = np.ascontiguousarray(raw[:, HEADER.itemsize:]).view("<u2")
                    for r, size, crc in zip(ids, head["length"], head["crc"], strict=True):
                        if zlib.crc32(r[:size].tobytes()) != crc:
                            raise ValueError(f"a record of the shard of slot {first} is damaged")
                    kept = np.arange(length) < head["length"][:, None]
                    ends = np.concatenate([[0], np.cumsum(head["length"], dtype=np.int64)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first + begin + np.arange(n), pa.int64()), pa.array(head["piece"].astype(np.int32)),
                         pa.array(head["length"].astype(np.int32)), pa.array(head["crc"].astype(np.int64)),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[kept].astype(np.int32)))],
                        ["slot", "piece", "n_tokens", "crc32", "ids"])

    shards = spark.read.parquet(f"{path}/shards").where(F.col("first_slot") + F.col("records") > slot)
    return shards.select("first_slot", "records", "blob").mapInArrow(
        run, "slot long, piece int, n_tokens int, crc32 long, ids array<int>")


def materialise(docs: DataFrame, path: str, length: int, end: int, seed: int, per_shard: int,
                key: str = "doc_id") -> str:
    """Tokenize, permute and write; the folder that ``read_from`` takes."""
    out = scratch(docs.sparkSession, "shards")
    slotted = with_slots(sequences(docs, path, length, end, key), f"{out}/sequences", seed)
    write_shards(slotted, out, length, per_shard, key)
    return out



def digests(spark: SparkSession, path: str, length: int, per_shard: int, slot: int = 0) -> DataFrame:
    """slot, the key, piece, n_tokens, crc32, shard and the byte at which the record begins in it."""
    keys = spark.read.parquet(f"{path}/keys").withColumnRenamed("slot", "k_slot").drop("piece", "n_tokens")
    found = read_from(spark, path, length, slot).drop("ids")
    return found.join(keys, F.col("slot") == F.col("k_slot")).drop("k_slot").select(
        "*", F.floor(F.col("slot") / per_shard).alias("shard"),
        ((F.col("slot") % per_shard) * (HEADER.itemsize + 2 * length)).alias("byte"))
