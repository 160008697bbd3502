"""Ranked lexical search: impact vectors in buckets by length, pruned by bounds, rescored in integers.

A document's impact vector has a coordinate for each term of the query set; a score is its inner product
with the weights of a query. Vectors are written in order of their length within each task and looked
through bucket by bucket, longest first. For a query with threshold t (its k-th best score so far):

- Cauchy-Schwarz leaves out a bucket whose longest vector times the query is below t, and inside a
  bucket all vectors behind the first one that is too short;
- the largest coordinates of the bucket bound what the light terms of a query can add. Only vectors
  that hold one of the other, heavy terms can reach t; with what they score there, and the smaller of
  that bound and of Cauchy-Schwarz over the light terms, most are out;
- survivors are rescored over all terms in 64-bit integers.

Lengths are taken with each coordinate times the root of its term's weight, and queries likewise, which
leaves products as they are and evens both sides out.

The first thresholds come from the longest vectors of all, about ``first`` of them; every task starts
with these and raises them by what it finds. Thresholds save work and never a row: all that could be
among the k are rescored.

The query set is dealt into blocks of bounded size; a block meets all documents in one pass over the
texts, which writes the block's terms of every document. What reaches the driver: a block's queries, the
document frequencies of its terms, and two sums. No postings of a term are gathered anywhere.

Defined results: null text has no term, and matches nothing; a query without terms, or whose terms no
document holds, gives no rows; every row of the queries is a query, whatever its id; every row of the
documents is a document, so that equal rows rank one behind the other; a null key ranks behind others of
the same score; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlatlas.llm.common import materialize, portions, text_or_empty, with_row

#: Bytes that are no part of a term become blanks, A-Z become a-z, all others stay.
PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Queries and terms of a block, documents and coordinates of a bucket: bounds of memory.
BLOCK_QUERIES, BLOCK_TERMS, BUCKET, COORDINATES = 1000, 100_000, 4096, 1 << 20
#: About how many of the longest vectors give the first thresholds.
FIRST = 20_000
#: Characters of a text that are split into terms at once.
STRETCH = 1 << 20


def counted(text: bytes) -> Counter:
    """How often each term stands in a text; long texts are split stretch by stretch."""
    plain, found, at = text.translate(PLAIN), Counter(), 0
    while len(plain) - at > STRETCH:
        end = plain.find(b" ", at + STRETCH)
        if end < 0:
            break
        found.update(plain[at:end].split())
        at = end
    found.update(plain[at:].split())
    return found


def terms_of(queries: DataFrame, key: str, text: str) -> DataFrame:
    """row, id and terms (each once) of every query."""

    def run(batches):
        for batch in batches:
            texts = pc.cast(batch.column(2), pa.binary())
            for start, stop in portions(texts):
                terms = [sorted(counted(t)) for t in texts.slice(start, stop - start).to_pylist()]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(terms, pa.list_(pa.binary()))],
                                                 ["row", "id", "terms"])

    named = with_row(queries.select(F.col(key).alias("id"), text_or_empty(text).alias("text")), "row").select("row", "id", "text")
    kind = queries.schema[key].dataType.simpleString()
    return materialize(named.mapInArrow(run, f"row long, id {kind}, terms array<binary>"), "queries")


def blocks(queries: DataFrame) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """The queries with terms, in blocks of a bounded number of queries and terms."""
    block, terms = [], set()
    for r in queries.where(F.size("terms") > 0).toLocalIterator():
        own = [bytes(t) for t in r["terms"]]
        if block and (len(block) >= BLOCK_QUERIES or len(terms) + len(own) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        block.append((r["row"], r["id"], own))
        terms.update(own)
    if block:
        yield block


def scanned(docs: DataFrame, number: dict[bytes, int], key: str, text: str) -> DataFrame:
    """key, n (terms with repeats), terms (numbers of those that ``number`` has, ascending) and tfs."""

    def run(batches):
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            for start, stop in portions(texts):
                lengths, ends, terms, tfs = [], [0], [], []
                for t in texts.slice(start, stop - start).to_pylist():
                    found = counted(t)
                    lengths.append(found.total())
                    known = sorted((number[w], f) for w, f in found.items() if w in number)
                    terms += [w for w, _ in known]
                    tfs += [f for _, f in known]
                    ends.append(len(terms))
                at = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["key", "n", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    asked = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    return materialize(asked.mapInArrow(run, f"key {kind}, n long, terms array<int>, tfs array<long>"), "scanned")


def impacts(rows: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray) -> DataFrame:
    """key, length, terms and values of the impact vectors, written longest first within each task."""
    schema = f"key {rows.schema['key'].dataType.simpleString()}, length double, terms array<int>, values array<long>"

    def run(batches):
        for batch in batches:
            terms, tfs = batch.column(2), batch.column(3).flatten().to_numpy()
            at = terms.offsets.to_numpy()
            of = np.repeat(np.arange(len(terms)), np.diff(at))
            m = 50 + 50 * batch.column(1).to_numpy() * n_docs // n_terms
            values = 1_000_000_000 * tfs // (1000 * tfs + 20 * m[of])
            scaled = values.astype(np.float64) ** 2 * weights[terms.flatten().to_numpy()]
            length = np.sqrt(np.bincount(of, scaled, minlength=len(terms)))
            lists = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), terms, lists],
                                             ["key", "length", "terms", "values"])

    held = rows.where(F.size("terms") > 0).mapInArrow(run, schema)
    return materialize(held.sortWithinPartitions(F.desc("length")), "impacts")


class Query:
    """Weights of a query's terms, the heaviest first, and the best rows that a task has found for it."""

    def __init__(self, number: int, terms: np.ndarray, weights: np.ndarray, least: int):
        order = np.argsort(-weights[terms], kind="stable")
        self.number, self.terms, self.least = number, terms[order], least
        self.weights = weights[self.terms]
        self.length = math.sqrt(float(self.weights.sum()))
        self.best: pa.Table | None = None

    def keep(self, keys: pa.Array, scores: np.ndarray, k: int) -> None:
        """Take rows in, the k best stay; ties go to smaller keys, null last."""
        new = pa.table({"key": keys, "score": pa.array(scores)})
        both = new if self.best is None else pa.concat_tables([self.best, new])
        order = pc.sort_indices(both, sort_keys=[("score", "descending"), ("key", "ascending")], null_placement="at_end")
        self.best = both.take(order[:k]).combine_chunks()
        if len(self.best) == k:
            self.least = max(self.least, self.best["score"][k - 1].as_py())


class Bucket:
    """Impact vectors, longest first, by row and by term."""

    def __init__(self, keys: pa.Array, length: np.ndarray, at: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int):
        order = np.argsort(-length, kind="stable")
        self.keys, self.length = keys.take(pa.array(order)), length[order]
        sizes = np.diff(at)[order]
        self.at = np.append(0, np.cumsum(sizes))
        self.terms, self.values = (x[_ranges(at[:-1][order], sizes)] for x in (terms, values))
        by_term = np.argsort(self.terms, kind="stable")
        self.doc_of = np.repeat(np.arange(len(sizes)), sizes)[by_term]
        self.value_of = self.values[by_term]
        self.first = np.searchsorted(self.terms[by_term], np.arange(n_terms + 1))
        self.top = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.top[held] = np.maximum.reduceat(self.value_of, self.first[held])

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[term], self.first[term + 1])
        return self.doc_of[own], self.value_of[own]

    def survivors(self, q: Query, least: int) -> np.ndarray:
        """Rows that may score ``least`` or more."""
        # A hair is added to all that is computed in floating point.
        long_enough = int(np.searchsorted(-self.length * q.length * (1 + 1e-9), -float(least), "right"))
        if not long_enough:
            return np.zeros(0, np.int64)
        adds = q.weights * self.top[q.terms]
        order = np.argsort(-adds, kind="stable")
        behind = adds.sum() - np.cumsum(adds[order])
        if adds.sum() < least:
            return np.zeros(0, np.int64)
        heavy = int(np.argmax(behind < least)) + 1
        score, squares = np.zeros(len(self.length), np.int64), np.zeros(len(self.length))
        for i in order[:heavy]:
            docs, values = self.postings(q.terms[i])
            score[docs] += q.weights[i] * values
            squares[docs] += float(q.weights[i]) * values.astype(np.float64) ** 2
        met = np.flatnonzero(score[:long_enough])
        rest = math.sqrt(float(q.weights[order[heavy:]].sum()))
        left = np.sqrt(np.maximum(self.length[met] ** 2 * (1 + 1e-9) - squares[met], 0.0))
        return met[score[met] + np.minimum(behind[heavy - 1], rest * left * (1 + 1e-9) + 1) >= least]

    def scores(self, q: Query, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of rows; ``dense`` is all zeros before and after."""
        dense[q.terms] = q.weights
        sizes = np.diff(self.at)[rows]
        at = _ranges(self.at[:-1][rows], sizes)
        out = np.add.reduceat(dense[self.terms[at]] * self.values[at], np.append(0, np.cumsum(sizes)[:-1]))
        dense[q.terms] = 0
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size says."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def looked_through(vectors: DataFrame, queries: list[np.ndarray], weights: np.ndarray, k: int,
                   least: list[int] | None = None) -> DataFrame:
    """q, key and score of the rows that may be among the k best of a query, k a task and query at most."""
    kind = vectors.schema["key"].dataType.simpleString()
    n_terms = len(weights)

    def buckets(batch):
        at, values = batch.column(2).offsets.to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
        terms, length, start = batch.column(2).flatten().to_numpy(), batch.column(1).to_numpy(), 0
        at = at - at[0]
        while start < len(length):
            stop = min(start + BUCKET, int(np.searchsorted(at, at[start] + COORDINATES, "right")) - 1)
            stop = max(stop, start + 1)
            own = slice(at[start], at[stop])
            yield Bucket(batch.column(0).slice(start, stop - start), length[start:stop], at[start:stop + 1] - at[start],
                         terms[own], values[own], n_terms)
            start = stop

    def run(batches):
        asked = [Query(i, t, weights, 1 if least is None else least[i]) for i, t in enumerate(queries)]
        dense = np.zeros(n_terms, np.int64)
        for batch in batches:
            for bucket in buckets(batch):
                for q in asked:
                    if bucket.length[0] * q.length * (1 + 1e-9) < q.least:
                        continue
                    rows = bucket.survivors(q, q.least)
                    if len(rows):
                        scores = bucket.scores(q, rows, dense)
                        good = scores >= q.least
                        if good.any():
                            q.keep(bucket.keys.take(pa.array(rows[good])), scores[good], k)
        for q in asked:
            if q.best is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q.best), q.number), pa.int32()), *(q.best[c].combine_chunks() for c in ("key", "score"))],
                    ["q", "key", "score"])

    return vectors.select("key", "length", "terms", "values").mapInArrow(run, f"q int, key {kind}, score long")


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("key").asc_nulls_last()))


def search_block(docs: DataFrame, block: list[tuple[int, object, list[bytes]]], id_kind: str, k: int, key: str, text: str,
                 first: int) -> DataFrame:
    """id, rank, key and score for the queries of a block."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, _, terms in block for t in terms}))}
    rows = scanned(docs, number, key, text)
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
    queries = [np.array([number[t] for t in terms], np.int64) for _, _, terms in block]
    vectors = impacts(rows, n_docs, max(1, n_terms), weights)
    held = vectors.count()
    cut = vectors.agg(F.percentile_approx("length", max(0.0, 1 - first / max(1, held)), 1000)).first()[0]
    least = [1] * len(queries)
    longest = looked_through(vectors.where(F.col("length") >= F.lit(cut)), queries, weights, k)
    for r in longest.withColumn("rank", _rank()).where(F.col("rank") == k).select("q", "score").collect():
        least[r["q"]] = r["score"]
    found = looked_through(vectors, queries, weights, k, least).withColumn("rank", _rank()).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, of) for i, (_, of, _) in enumerate(block)], f"q int, id {id_kind}")
    return found.join(F.broadcast(ids), "q").select("id", F.col("rank").cast("int").alias("rank"), "key", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
           query_key: str = "item_id", query_text: str = "text", first: int = FIRST) -> DataFrame:
    """query_key, rank (from 1), key and score of the ``k`` best documents of every query, all scores above 0."""
    id_kind = queries.schema[query_key].dataType.simpleString()
    out = None
    for block in blocks(terms_of(queries, query_key, query_text)):
        found = search_block(docs, block, id_kind, k, key, text, first)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = docs.schema[key].dataType.simpleString()
        out = docs.sparkSession.createDataFrame([], f"id {id_kind}, rank int, key {kind}, score long")
    return out.select(F.col("id").alias(query_key), "rank", F.col("key").alias(key), "score")
