"""Exact top-k search by inner product with multi-resolution segment statistics.

Of every vector, the means and deviations of its segments are kept, for a few segments (coarse) and
for many (fine). Per segment, sum(q*x) = n*mean(q)*mean(x) + sum of products of what is left, and the
latter is at most dev(q)*dev(x). So the inner product is at most the inner product of the statistics
(and the distance at least what follows from that), at either resolution. Candidates that the coarse
bound leaves go to the fine one, and only survivors of both are multiplied out.

Candidates are dealt into blocks of bounded size, and every block meets the stated query set in
batches: candidates are shuffled once, and queries once a block. Each block returns k rows a query,
which are merged. The bounds only save work: all rows that could be among the k are multiplied out.

Vectors become floor(scale * x), which makes scores exact integers.

Defined results: null vectors, and those with null or non-finite components, take no part; neither do
rows with a null id; a vector of another length than the query scores as if padded with zeros; of rows
with the same id each is a candidate and each is a query; equal scores go to the smaller id; fewer
than k candidates give fewer rows; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlatlas.llm.common import materialize, with_row

COARSE, FINE = 4, 16
#: Candidates a block and queries a batch; bounds of a task's memory.
BLOCK, BATCH = 16_384, 128


def scaled(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, id and v (array<long>) of the vectors that take part."""
    fit = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(
        F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return with_row(vectors.where(fit).select(
        F.col(key).alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")), "row")


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means times sqrt(n) and deviations times sqrt(n) of the segments; their inner product bounds that of x."""
    parts = [p for p in np.array_split(x, min(segments, x.shape[1]), axis=1)] if x.shape[1] else []
    if not parts:
        return np.zeros((len(x), 1))
    mean = np.stack([p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)
    rest = np.stack([np.linalg.norm(p - p.mean(axis=1, keepdims=True), axis=1) for p in parts], axis=1)
    return np.concatenate([mean, rest], axis=1)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of a list column as rows, padded with zeros to the longest (or cut to ``width``)."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == lengths[0]).all():
        out = column.flatten().to_numpy().reshape(len(column), int(lengths[0]))
    else:
        out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
        out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    if width is not None and out.shape[1] != width:
        wide = np.zeros((len(out), width), out.dtype)
        n = min(width, out.shape[1])
        wide[:, :n] = out[:, :n]
        return wide
    return out


class Block:
    """Candidates with their statistics at both resolutions."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.x = rows[order], ids[order], np.ascontiguousarray(x[order])
        self.real = self.x.astype(np.float64)
        self.coarse, self.fine = statistics(self.real, COARSE), statistics(self.real, FINE)
        # Scores beyond what a double holds exactly are taken in integers.
        self.small = float(np.abs(self.real).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0 ** 52

    def search(self, q_rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
        """(query row, query id, id, score) of the k best of the block for each query."""
        real = q.astype(np.float64)
        bounds = statistics(real, COARSE) @ self.coarse.T
        fine = statistics(real, FINE)
        slack = 1e-6 * (1 + np.abs(bounds).max(axis=1)) + 1e-3
        exact_in_floats = self.small and float(np.abs(real).max(initial=0)) ** 2 * max(1, q.shape[1]) < 2.0 ** 52
        out = []
        for i in range(len(q)):
            own = np.searchsorted(self.ids, q_ids[i])
            bound = bounds[i]
            while own < len(self.ids) and self.ids[own] == q_ids[i]:
                if self.rows[own] == q_rows[i]:
                    bound[own] = -np.inf
                    break
                own += 1
            valid = len(self.ids) - int(own < len(self.ids) and self.ids[own] == q_ids[i])
            want = min(k, valid)
            if not want:
                continue

            def scores(at, i=i):
                if exact_in_floats:
                    return (self.real[at] @ real[i]).astype(np.int64)
                return self.x[at] @ q[i]

            # The k best by the coarse bound give a score that the k best overall reach.
            first = np.argpartition(bound, len(bound) - want)[len(bound) - want:]
            least = scores(first).min()
            left = np.flatnonzero(bound >= least - slack[i])
            left = left[self.fine[left] @ fine[i] >= least - slack[i]]
            got = scores(left)
            if len(got) > want:
                kth = np.partition(got, len(got) - want)[len(got) - want]
                left, got = left[got >= kth], got[got >= kth]
            best = np.argsort(-got, kind="stable")[:want]  # ids ascend
            out += [(int(q_rows[i]), int(q_ids[i]), int(self.ids[left[b]]), int(got[b])) for b in best]
        return out


def search(vectors: DataFrame, k: int, is_query, scale: int = 256,
           key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for the rows that ``is_query``
    (a condition on the column ``id``) holds for, each against all rows but itself."""
    table = materialize(scaled(vectors, scale, key, vector), "vectors")
    total = table.count()
    blocks = max(1, -(-total // block))
    home = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    width = table.agg(F.max(F.size("v"))).first()[0] or 0
    candidates = table.select(home.alias("block"), F.lit(False).alias("asks"), "row", "id", "v")
    asking = table.where(is_query(F.col("id"))).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "row", "id", "v")

    def run(batches):
        at, parts, ready, waiting = None, [], None, []

        def ask():
            q_rows, q_ids, q = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            for i in range(0, len(q), BATCH):
                got = ready.search(q_rows[i:i + BATCH], q_ids[i:i + BATCH], q[i:i + BATCH], k)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)],
                                                     ["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            number, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(starts, [*starts[1:], len(number)], strict=True):
                if not b - a:
                    continue
                run_of = batch.slice(a, b - a)
                rows, ids = run_of.column(2).to_numpy(), run_of.column(3).to_numpy()
                piece = (rows, ids, matrix(run_of.column(4), width))
                if number[a] != at:
                    if waiting:
                        yield from ask()
                    at, parts, ready = number[a], [], None
                if not asks[a]:
                    parts.append(piece)
                    continue
                if parts:
                    ready, parts = Block(*(np.concatenate(c) for c in zip(*parts, strict=True))), []
                if ready is not None:
                    waiting.append(piece)
                    if sum(len(w[0]) for w in waiting) >= BATCH:
                        yield from ask()
        if waiting:
            yield from ask()

    dealt = candidates.unionByName(asking).repartition(blocks, "block").sortWithinPartitions("block", "asks", "row")
    parts = dealt.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
