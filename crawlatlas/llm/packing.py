"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. How many pieces there are of each length is
all that best-fit decreasing needs: it is run over counts, so the plan has at most a few thousand
entries however many documents there are. Each piece then finds its rank among the pieces of its
length (the counts of earlier slices plus its place in its own slice) and takes the slot that the
plan has for that rank, by a join on length. No piece moves through the driver, and a length that
most pieces share is spread over all slices.

Defined results: null text is the empty text; a document without tokens is its end mark alone; equal
rows are packed one by one; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlatlas.llm.common import CHUNK, materialize, tidy
from crawlatlas.llm.tokens import encoder

ENTRY = "p_length int, p_rank long, p_count long, p_sequence long, p_offset int, p_each int"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for a shorter first one."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, end: int = 0, key: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Pieces of every row: key, piece, start, length, ids_crc32, slice (the task) and place (number
    among the pieces of its length in the slice); ``with_ids`` adds the ids."""

    @tidy
    def run(batches):
        seen = np.zeros(capacity + 1, np.int64)
        slice_no, encode = TaskContext.get().partitionId(), encoder(path).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), CHUNK):
                source, rows, ids_of = [], [], []
                for i, t in enumerate(texts.slice(at, CHUNK).to_pylist()):
                    ids = np.append(encode(t or ""), np.array([end], "<u4")).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start:start + length]
                        source.append(at + i)
                        rows.append((piece, start, length, zlib.crc32(own.tobytes()), slice_no, int(seen[length])))
                        seen[length] += 1
                        if with_ids:
                            ids_of.append(own.astype(np.int32))
                columns = [pa.array(c, k) for c, k in zip(
                    zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()),
                    strict=True)]
                names = ["key", "piece", "start", "length", "ids_crc32", "slice", "place"]
                if with_ids:
                    columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(source)), *columns], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, slice int, place long"
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, schema + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("key", key)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    An entry (length, rank, count, sequence, offset, each) says: the ``count`` pieces of that length
    from that rank on go to sequences from ``sequence`` on, ``each`` in a row into one, at ``offset``.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, sequences)
    entries, sequences = [], 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0

        def fill(free: int, first: int, count: int, length: int = length) -> None:
            """Put pieces into up to ``count`` sequences with ``free`` tokens left."""
            nonlocal left, rank
            each = free // length
            full = min(count, left // each)
            if full:
                entries.append((length, rank, full * each, first, capacity - free, each))
                left, rank = left - full * each, rank + full * each
                room[free - each * length].append((first, full))
            if full < count and left:
                entries.append((length, rank, left, first + full, capacity - free, each))
                room[free - left * length].append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < count:
                room[free].append((first + full, count - full))

        for free in range(length, capacity):
            while left and room[free]:
                fill(free, *room[free].pop())
            if not left:
                break
        if left:
            new = -(-left // (capacity // length))
            first, sequences = sequences, sequences + new
            fill(capacity, first, new)
    return entries


def pack(cut_pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset; writes the pieces once, as ranks must not change."""
    spark = cut_pieces.sparkSession
    placed = materialize(cut_pieces, "pieces")
    counts = placed.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("b_length"), F.col("slice").alias("b_slice"),
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("b_base"))
    slots = spark.createDataFrame(plan(histogram, capacity), ENTRY)
    ranked = placed.join(base, (placed["length"] == base["b_length"]) & (placed["slice"] == base["b_slice"]))
    ranked = ranked.withColumn("rank", F.col("b_base") + F.col("place"))
    after = F.col("rank") - F.col("p_rank")
    return (ranked.join(F.broadcast(slots), (F.col("length") == F.col("p_length")) & (after >= 0)
                        & (after < F.col("p_count")))
            .withColumn("sequence_id", F.col("p_sequence") + F.floor(after / F.col("p_each")))
            .withColumn("offset", F.col("p_offset") + (after % F.col("p_each")) * F.col("length"))
            .select(*[c for c in placed.columns if c not in ("slice", "place")], "sequence_id", "offset"))
