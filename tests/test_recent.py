"""Cut-offs of the newest rows against sorting, with ties, repeated rows and missing numbers."""

import random

import pytest
from pyspark.sql import functions as F

from crawlatlas.operators.recent import cut_offs, retain, window_stats

SCHEMA = "log_type string, warc_id string, execution_id string, ingestion_seq bigint, payload string"


def logs(seed, n, numbers):
    r = random.Random(seed)
    return [(r.choice(["crawl", "crawl", "page", None]), f"w{i % 50}", "e", r.choice(numbers), r.choice(["a", "bb", "ccc"])) for i in range(n)]


CASES = [list(range(10_000)), [5], [1, 2, 2, 3, None], [-(1 << 63), -7, 0, (1 << 63) - 1, None], [1 << 40, (1 << 40) + 1, 12, 1 << 62]]


@pytest.mark.parametrize("numbers", CASES)
@pytest.mark.parametrize(("crawl", "page"), [(10, 3), (0, 40), (10_000, 1)])
def test_as_many_of_the_newest_as_the_limit_says(spark, numbers, crawl, page):
    data = logs(len(numbers), 400, numbers)
    rows = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = [tuple(r) for r in retain(rows, crawl, page).collect()]
    left = list(data)
    for r in got:  # only rows there are, each as often as it is there
        left.remove(r)
    low = -(1 << 63)
    for kind in ("crawl", "page", None):
        limit = crawl if kind == "crawl" else page
        want = sorted((low if r[3] is None else r[3] for r in data if r[0] == kind), reverse=True)[:limit]
        assert sorted((low if r[3] is None else r[3] for r in got if r[0] == kind), reverse=True) == want
    stats = {r["log_type"]: r for r in window_stats(rows, crawl, page).collect()}
    for kind in {r[0] for r in data}:
        assert stats[kind]["kept"] == sum(r[0] == kind for r in got) and stats[kind]["kept"] + stats[kind]["evicted"] == sum(r[0] == kind for r in data)


def test_no_sort_and_no_exchange_of_rows(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 4 == 0, "page").otherwise("crawl").alias("log_type"), F.col("id").alias("ingestion_seq"),
                                    F.lit("p").alias("payload"))
    kept = retain(rows, 100, 7)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan
    assert kept.groupBy("log_type").count().collect() and kept.count() == 107
    cuts = cut_offs(rows.withColumnRenamed("ingestion_seq", "v"), "v", {"page": 7, "crawl": 100})
    assert {t: c for t, (c, _, _) in cuts.items()} == {"page": 4972, "crawl": sorted(i for i in range(5000) if i % 4)[-100]}


def test_nothing_to_keep(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert retain(empty, 5, 5).collect() == [] and window_stats(empty, 5, 5).collect() == []
