"""Hot groups: the spread forms give what a plain window or join gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlatlas.operators import ordered, skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else (None if rng.random() < 0.1 else f"k{rng.randrange(200)}")
        data.append((i, key, rng.randrange(50), rng.randrange(1000), rng.choice([None, None, f"v{i}"])))
    return spark.createDataFrame(data, "id int, key string, seq int, value int, mark string").repartition(6).cache()


def test_annotate_with_hot_keys(rows):
    got = skew.annotate(rows, ["key"], {"top": F.max("value"), "first": F.min("id")}, hot_rows=50)
    w = Window.partitionBy("key")
    want = rows.select("*", F.max("value").over(w).alias("top"), F.min("id").over(w).alias("first"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("hot_rows", [1, 50, 10**6])
def test_look_up_matches_left_join(spark, rows, hot_rows):
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("k4", 3)], "name string, number int")
    got = skew.look_up(rows, table, {"key": "name"}, ["number"], hot_rows=hot_rows)
    want = rows.join(table, rows["key"] == table["name"], "left").drop("name")
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("slices", [None, 1, 5, 40])
def test_ordered_forms_match_windows(rows, slices):
    order = ["seq", "id"]
    w = Window.partitionBy("key").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r["id"]: (r["n"], r["s"], r["m"]) for r in rows.select(
        "id", F.row_number().over(w).alias("n"), F.coalesce(F.sum("value").over(before), F.lit(0)).alias("s"),
        F.last("mark", ignorenulls=True).over(upto).alias("m")).collect()}
    cols = [F.col(c) for c in order]
    n = {r["id"]: r["n"] for r in ordered.row_numbers(rows, ["key"], cols, "n", slices).collect()}
    s = {r["id"]: r["s"] for r in ordered.running_sum(rows, ["key"], cols, F.col("value"), "s", slices).collect()}
    m = {r["id"]: r["m"] for r in ordered.last_known(rows, ["key"], order, "mark", "m", slices).collect()}
    assert {i: (n[i], s[i], m[i]) for i in want} == want


def test_a_hot_key_is_spread_over_tasks(rows):
    """No task of the joined stage gets all the rows of the hot key."""
    got = skew.annotate(rows, ["key"], {"top": F.max("value")}, hot_rows=50)
    per_task = (got.where("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(per_task) > 1


def test_large_groups_are_sliced(rows):
    got = ordered.row_numbers(rows, ["key"], [F.col("seq"), F.col("id")], "n")
    assert got.where("key = 'hot'").agg(F.max("n"), F.count_distinct("n")).first() == (
        rows.where("key = 'hot'").count(),) * 2


@pytest.mark.parametrize("hot_rows", [7, 40, 600])
def test_sampled_borders_give_what_windows_give(rows, hot_rows):
    """Only groups above the bound are cut, by borders from a sample of them."""
    w = Window.partitionBy("key").orderBy("seq", "id")
    want = {r["id"]: (r["n"], r["s"]) for r in rows.select("id", F.row_number().over(w).alias("n"), F.coalesce(
        F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s")).collect()}
    cols = [F.col("seq"), F.col("id")]
    n = {r["id"]: r["n"] for r in ordered.row_numbers(rows, ["key"], cols, "n", hot_rows=hot_rows).collect()}
    s = {r["id"]: r["s"] for r in ordered.running_sum(rows, ["key"], cols, F.col("value"), "s", hot_rows=hot_rows).collect()}
    assert {i: (n[i], s[i]) for i in want} == want
    alone = ordered.row_numbers(rows, [], cols, "n", hot_rows=hot_rows)
    assert [r["n"] for r in alone.orderBy("seq", "id").select("n").collect()] == list(range(1, rows.count() + 1))


def test_slices_are_of_about_the_stated_size(rows):
    placed = rows.withColumn("_o", F.struct(F.col("seq").alias("o0"), F.col("id").alias("o1")))
    cut = ordered._cut(placed, ["key"], ordered._borders(placed, ["key"], None, 100), "left")
    sizes = [r["count"] for r in cut.where("key = 'hot'").groupBy("_slice").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 500
    assert cut.where("key <> 'hot'").agg(F.count("_slice")).first()[0] == 0
