"""Chains, stars and trees of pointers are followed to their ends."""

import random

import pytest
from pyspark.sql import functions as F

from crawlatlas.operators.pagegraph import follow

SCHEMA = "page_id string, idx int, ptr int, text string"


def ends(data):
    """(text from the end on, last row) of every row, by walking."""
    at = {(p, i): (ptr, t) for p, i, ptr, t in data}
    out = {}
    for p, i, _, _ in data:
        text, here = "", i
        while True:
            ptr, t = at[p, here]
            text = t + text
            if ptr is None or (p, ptr) not in at:
                break
            here = ptr
        out[p, i] = (text, here)
    return out


def tree(seed, n):
    r = random.Random(seed)
    return [(f"p{i % 3}", i, None if i < 3 or r.random() < 0.05 else r.choice([i - 3, i % 3, 3 * r.randrange(i // 3 + 1) + i % 3 if i >= 3 else 0]), r.choice("LR"))
            for i in range(n)]


@pytest.mark.parametrize("data", [
    [("p", i, i - 1 if i else None, "LR"[i % 2]) for i in range(700)],
    [("p", i, 0 if i else None, "L") for i in range(2000)],
    [row for row in tree(1, 600) if row[2] != row[1]], [("p", 1, 99, "x"), ("q", 1, None, "y")], []])
def test_every_row_reaches_its_end(spark, data):
    got = follow(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert {(r["page_id"], r["idx"]): (r["text"], r["root"]) for r in got.collect()} == ends(data)


def test_a_chain_of_ten_thousand_and_a_star_of_a_hundred_thousand(spark):
    i = F.col("id")
    chain = spark.range(10_000).select(F.lit("chain").alias("page_id"), i.cast("int").alias("idx"), F.when(i > 0, i - 1).cast("int").alias("ptr"),
                                       F.lit("L").alias("text"))
    star = spark.range(100_000).select(F.lit("star").alias("page_id"), i.cast("int").alias("idx"), F.when(i > 0, 0).cast("int").alias("ptr"),
                                       F.lit("L").alias("text"))
    got = follow(chain.unionByName(star)).groupBy("page_id").agg(F.max("root").alias("root"), F.max(F.length("text")).alias("n"), F.count("*").alias("rows"))
    assert {tuple(r) for r in got.collect()} == {("chain", 0, 10_000, 10_000), ("star", 0, 2, 100_000)}
