"""Joining rows to per-key values when one key may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is handled without shuffling its rows onto one task.
HOT_ROWS = 1_000_000


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys])


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], values: list[str],
           rows: str = "_n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join ``per_key`` (one row per key, ``rows`` = rows of ``df`` under it) to ``df``.

    Hot keys come from the counts, so there are at most rows(df) / hot_rows of them:
    their values are broadcast. Their rows then carry the number of their input
    partition in the join key, which spreads them and matches nothing, while every
    other row joins on the key itself.
    """
    renamed = per_key.select(*[F.col(k).alias("_k_" + k) for k in keys],
                             *[F.col(v).alias("_v_" + v) for v in values], rows)
    hot = (renamed.where(F.col(rows) > hot_rows).drop(rows).withColumn("_hot", F.lit(True)))
    hot = hot.select(*[F.col(c).alias("_h" + c) if c != "_hot" else F.col(c) for c in hot.columns])
    marked = df.join(F.broadcast(hot), _same(df, hot, keys, "_h_k_"), "left").drop(*["_h_k_" + k for k in keys])
    key_hash = F.xxhash64(*keys)
    marked = marked.withColumn(
        "_spread", F.when(F.col("_hot"), F.spark_partition_id().cast("bigint")).otherwise(key_hash))
    cold = (renamed.where(F.col(rows) <= hot_rows).drop(rows)
            .withColumn("_spread_k", F.xxhash64(*["_k_" + k for k in keys])))
    joined = marked.join(
        cold, (marked["_spread"] == cold["_spread_k"]) & _same(marked, cold, keys, "_k_"), "left")
    return joined.select(
        *[joined[c] for c in df.columns if c not in values],
        *[F.when(F.col("_hot"), F.col("_h_v_" + v)).otherwise(F.col("_v_" + v)).alias(v) for v in values])


def annotate(df: DataFrame, keys: list[str], aggregates: dict[str, Column],
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add per-group aggregates to every row; groups are only ever combined map-side first."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in aggregates.items()])
    return attach(df, per_key, keys, list(aggregates), hot_rows=hot_rows)


def look_up(df: DataFrame, table: DataFrame, on: dict[str, str], values: list[str],
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join a table with unique keys to ``df``; ``on`` maps columns of df to those of the table."""
    keys = list(on)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    right = table.select(*[F.col(on[k]).alias("_t_" + k) for k in keys], *values)
    # Keys without a match are kept, since one of them may be the hot one.
    per_key = counts.join(right, reduce(lambda a, b: a & b, [counts[k] == right["_t_" + k] for k in keys]), "left")
    return attach(df, per_key.drop(*["_t_" + k for k in keys]), keys, values, hot_rows=hot_rows)
