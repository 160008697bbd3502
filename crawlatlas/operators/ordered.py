"""Per-group orderings that hold when one group fills a large share of the table.

A window over a whole group runs in one task. So groups with more than ``HOT_ROWS`` rows are cut into
slices by borders in their order, which come from a sample of each such group. The borders are a small
written table, so every row finds the same slice however often it is read: nothing else is written, and
rows are shuffled once, by (group, slice). What the earlier slices of a group add up to is carried over
from sums of the hot groups alone.

There are at most rows / ``HOT_ROWS`` hot groups, with one border for each ``HOT_ROWS`` rows, so borders
and carried values are safe to broadcast. Orders are ascending, and nulls come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlatlas.session import materialize

#: Rows of a group, or of a slice, that one task may order.
HOT_ROWS = 1_000_000
#: Sampled rows a slice; borders that are looked through at once.
PER_SLICE, CHUNK = 16, 64


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right["_k_" + k]) for k in keys])


def _borders(df: DataFrame, keys: list[str], slices: int | None, hot_rows: int) -> DataFrame:
    """The groups that are cut, and their borders in chunks of ``CHUNK``."""
    hot_rows = 1 if slices else hot_rows
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = hot.select(*[F.col(k).alias("_k_" + k) for k in keys], "_n")
    # Rows are picked by the hash of their place, at a rate that gives each slice a few.
    turn = 1 << 30
    few = F.lit(True) if hot_rows <= PER_SLICE else F.pmod(F.xxhash64("_o"), F.lit(turn)) < turn * PER_SLICE // hot_rows
    rows = df.select(*keys, "_o")
    picked = rows.join(F.broadcast(hot), _same(rows, hot, keys)).where(few)
    wanted = F.lit(slices) if slices else F.ceil(F.col("_n") / hot_rows)
    chosen = picked.groupBy(*["_k_" + k for k in keys], "_n").agg(F.sort_array(F.collect_set("_o")).alias("_s")).select(
        "*", F.greatest(F.lit(1), F.floor(F.size("_s") / wanted)).alias("_step"))
    borders = F.filter("_s", lambda _, i: (i > 0) & (i % F.col("_step") == 0))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_b") - 1) / CHUNK)),
                         lambda i: F.slice("_b", (i * CHUNK + 1).cast("int"), F.lit(CHUNK)))
    return materialize(chosen.withColumn("_b", borders).where(F.size("_b") > 0).select(
        *["_k_" + k for k in keys], chunks.alias("_chunks")), "borders")


def _cut(df: DataFrame, keys: list[str], borders: DataFrame, how: str) -> DataFrame:
    """``df`` with ``_slice``; null in groups that are not cut."""
    place = F.col("_o")
    before = F.size(F.filter("_chunks", lambda c: c[0] <= place))
    inside = F.size(F.filter(F.get("_chunks", before - 1), lambda b: b <= place))
    found = F.when(before == 0, 0).otherwise((before - 1) * CHUNK + inside)
    joined = df.join(F.broadcast(borders), _same(df, borders, keys), how)
    return joined.withColumn("_slice", F.when(F.col("_chunks").isNotNull(), found)).drop("_chunks", *["_k_" + k for k in keys])


def number_slices(df: DataFrame, places: dict[str, str], slices: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with, for each column of ``places``, the slice of one common order that its value falls in."""
    def at(table: DataFrame, column: str) -> DataFrame:
        return table.withColumn("_all", F.lit(0)).withColumn("_o", F.struct(F.col(column).alias("o0")))

    borders = _borders(reduce(DataFrame.unionByName, [at(df, c).select("_all", "_o") for c in places]), ["_all"], slices, hot_rows)
    for column, name in places.items():
        cut = _cut(at(df, column), ["_all"], borders, "left")
        df = cut.withColumn(name, F.coalesce(F.col("_slice").cast("int"), F.lit(0))).drop("_slice", "_all", "_o")
    return df


def _carried(df: DataFrame, keys: list[str], order: list[Column], per_slice, carried, out: Column, slices: int | None,
             hot_rows: int) -> DataFrame:
    """``df`` with ``_out``: ``out`` over the window of its slice, where ``_carried`` is what earlier slices give."""
    columns = df.columns
    own = keys or ["_all"]
    placed = (df if keys else df.withColumn("_all", F.lit(0))).withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    borders = _borders(placed, own, slices, hot_rows)
    sums = _cut(placed, own, borders, "inner").groupBy(*own, "_slice").agg(per_slice.alias("_part"))
    earlier = Window.partitionBy(*own).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("_carried", carried(F.col("_part")).over(earlier)).where(F.col("_carried").isNotNull()).select(
        *[F.col(k).alias("_k_" + k) for k in own], F.col("_slice").alias("_k__slice"), "_carried")
    cut = _cut(placed, own, borders, "left")
    met = cut.join(F.broadcast(carry), _same(cut, carry, [*own, "_slice"]), "left")
    return met.withColumn("_out", out).select(*columns, "_out")


def _inside(keys: list[str]):
    return Window.partitionBy(*(keys or ["_all"]), "_slice").orderBy("_o")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str,
                slices: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (0 for the first)."""
    before = F.sum(value).over(_inside(keys).rowsBetween(Window.unboundedPreceding, -1))
    total = F.coalesce(F.col("_carried"), F.lit(0)) + F.coalesce(before, F.lit(0))
    done = _carried(df, keys, order, F.sum(value), F.sum, total, slices, hot_rows)
    return done.select(*[c for c in df.columns if c != out], F.col("_out").alias(out))


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], out: str,
                slices: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, which must be total."""
    number = F.coalesce(F.col("_carried"), F.lit(0)) + F.row_number().over(_inside(keys))
    done = _carried(df, keys, order, F.count(F.lit(1)), F.sum, number, slices, hot_rows)
    return done.select(*[c for c in df.columns if c != out], F.col("_out").alias(out))


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
               slices: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Newest non-null ``value`` at or before each row of the group, in ascending ``order``."""
    newest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    upto = _inside(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.coalesce(F.last(value, ignorenulls=True).over(upto), F.col("_carried"))
    done = _carried(df, keys, [F.col(c) for c in order], newest, lambda c: F.last(c, ignorenulls=True), known, slices, hot_rows)
    return done.select(*[c for c in df.columns if c != out], F.col("_out").alias(out))


def sorted_numbers(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number all rows from 1 in any sort order, descending or with nulls last too, which must be total.

    Rows are range-partitioned and written once, since the borders come from sampling and both readers have
    to see the same ones; a task numbers one range after what the ranges before it hold.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "slices")
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_slice").alias("_k"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return ranged.join(F.broadcast(before), F.col("_slice") == F.col("_k")).withColumn(out, number).drop("_slice", "_k", "_before")
