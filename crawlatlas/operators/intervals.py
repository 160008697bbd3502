"""Points and overlapping ranges of one order: the smallest range value that covers each point.

Both ends of the ranges are cut into slices. A range stands in the slice of its first and in that of its last
place; of those that go right through a slice only the smallest value matters there, which binary intervals of
slices give in one grouping. A task sweeps its slice and notes where the smallest value changes. Points
and changes are then put in one order, and each point takes the change at or before it, carried over slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.operators import ordered
from crawlatlas.session import materialize

#: Ends of ranges that a task sweeps at a time.
SWEPT = 200_000
#: Added to a place, gives the next one: places have one width, so nothing lies between.
AFTER = "!"
_CHANGES = pa.schema([("_place", pa.string()), ("_value", pa.string())])

# Binary intervals (level, number) that the slices after ``_s`` and before ``_e`` fall into, at most two a level.
_THROUGH = """flatten(transform(sequence(0, 30), k -> transform(array(
    named_struct('k', k, 'low', (_s + shiftleft(1L, k)) div shiftleft(1L, k), 'high', _e div shiftleft(1L, k))), b ->
    filter(array(if(b.low % 2 = 1 and b.low < b.high, struct(k, b.low AS i), null),
                 if(b.high % 2 = 1 and b.low < b.high, struct(k, b.high - 1 AS i), null)), x -> x is not null))[0]))"""


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of the smallest value, of rows (slice, first, last, value) that are sorted by slice, first and value.

    No first place: begins in an earlier slice. No last place: ends in a later one. The heap holds what is open,
    without ranges that a smaller value outlasts.
    """
    heap: list[tuple[str, bool, str]] = []
    places: list[str] = []
    values: list[str | None] = []
    told: list[str | None] = []

    def tell(place: str) -> None:
        value = heap[0][0] if heap else None
        if told != [value]:
            told[:] = [value]
            places.append(place)
            values.append(value)

    def close(until: str | None) -> None:
        """Drop what ends before a place, or in the slice."""
        while heap and not heap[0][1] and (until is None or heap[0][2] < until):
            end = heappop(heap)[2]
            while heap and not heap[0][1] and heap[0][2] <= end:
                heappop(heap)
            tell(end + AFTER)

    at = None
    for batch in batches:
        for number, first, last, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != at:
                close(None)
                heap.clear()
                told.clear()
                at = number
            if first is not None:
                close(first)
            beyond, end = last is None, last or ""
            if not (heap and heap[0][0] <= value and heap[0][1:] >= (beyond, end)):
                heappush(heap, (value, beyond, end))
            if first is not None:
                tell(first)
        if len(places) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(values, pa.string())], schema=_CHANGES)
            places.clear()
            values.clear()
    close(None)
    yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(values, pa.string())], schema=_CHANGES)


def changes(spans: DataFrame, slices: int | None = None, swept: int = SWEPT) -> DataFrame:
    """Places (``_place``) from which on the smallest ``value`` of the ranges ``first`` to ``last`` is ``_value``, or none."""
    own = spans.where("first <= last").groupBy("first", "last").agg(F.min("value").alias("value")).where("value IS NOT NULL")
    cut = ordered.number_slices(materialize(own, "ranges"), {"first": "_s", "last": "_e"}, slices, swept)
    none = F.lit(None).cast("string")
    begin = cut.select(F.col("_s").alias("_slice"), "first", F.when(F.col("_s") == F.col("_e"), F.col("last")).alias("last"), "value")
    end = cut.where("_s < _e").select(F.col("_e").alias("_slice"), none.alias("first"), "last", "value")
    through = cut.where("_e - _s > 1").select(F.explode(F.expr(_THROUGH)).alias("b"), "value").groupBy("b.k", "b.i").agg(
        F.min("value").alias("value")).select(
        F.explode(F.expr("sequence(shiftleft(i, k), shiftleft(i + 1, k) - 1)")).alias("_slice"), "value").groupBy("_slice").agg(
        F.min("value").alias("value")).select(F.col("_slice").cast("int"), none.alias("first"), none.alias("last"), "value")
    dealt = begin.unionByName(end).unionByName(through).repartition("_slice").sortWithinPartitions("_slice", "first", "value")
    return dealt.select("_slice", "first", "last", "value").mapInArrow(_sweep, "_place string, _value string")


def least_cover(points: DataFrame, place: str, spans: DataFrame, out: str, slices: int | None = None,
                hot_rows: int = ordered.HOT_ROWS, swept: int = SWEPT) -> DataFrame:
    """``points`` with the smallest ``value`` of the spans (``first`` to ``last``, both included) around ``place``.

    Places are texts of which none is the beginning of another, and are not null in ``points``. Spans with a null
    or in the wrong order hold no place.
    """
    noted = changes(spans, slices, swept).select("_place", F.lit(0).alias("_kind"), F.struct("_value").alias("_change"))
    asked = points.select("*", F.col(place).alias("_at"), F.lit(1).alias("_kind"))
    both = materialize(asked.unionByName(noted.withColumnRenamed("_place", "_at"), allowMissingColumns=True), "places")
    known = ordered.last_known(both, [], ["_at", "_kind"], "_change", "_cover", slices, hot_rows)
    return known.where("_kind = 1").select(*points.columns, F.col("_cover._value").alias(out))
