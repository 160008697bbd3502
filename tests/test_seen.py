"""The lasting table of seen URIs: nothing of it is shuffled, runs add to it, ended jobs leave it."""

import re

import pytest
from pyspark.sql import functions as F

from crawlatlas.plans.admission import first_sights
from crawlatlas.plans.seen import compact, remember, seen_table, without_seen
from crawlatlas.session import materialize, scratch


@pytest.fixture
def table(spark):
    path = scratch(spark, "seen")
    name = "seen_" + path[-32:]
    seen_table(spark, name, path, 8)
    yield name, path
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def queued(spark, low, high, jobs=3):
    i = F.col("id")
    return spark.range(low, high).select(F.concat(F.lit("j"), i % jobs).alias("job_execution_id"), F.sha1(i.cast("string")).alias("uri_hash"),
                                         F.when(i % 10 == 9, "REJECTED").otherwise("QUEUED").alias("decision"))


def test_the_seen_side_is_not_shuffled(spark, table):
    name, _ = table
    remember(queued(spark, 0, 5000), name)
    first = queued(spark, 4000, 6000).groupBy("job_execution_id", "uri_hash").agg(F.count("*").alias("n"))
    new = without_seen(first, spark.table(name))
    rows = new.collect()
    # 4000 to 4999 without the rejected ones are known.
    assert len(rows) == 2000 - 900
    plan = new._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line)
    depth = re.search(r"[+:]- ", lines[scan]).start()
    side, at = [], scan
    while at > join:  # the nodes above the scan, up to the join
        at -= 1
        here = re.search(r"[+:]- ", lines[at])
        if here and here.start() < depth:
            side.append(lines[at])
            depth = here.start()
    assert join and not any("Exchange" in line for line in side[:-1]), plan
    assert any("Sort " in line for line in side) and "BroadcastHashJoin" not in plan


def test_runs_add_to_it_and_ended_jobs_leave(spark, table):
    name, path = table
    remember(queued(spark, 0, 300), name)
    remember(queued(spark, 300, 600), name)
    assert spark.table(name).count() == 540
    compact(spark, name, spark.createDataFrame([("j1",), (None,)], "job_execution_id string"))
    left = spark.table(name)
    assert left.count() == 360 and {r[0] for r in left.select("job_execution_id").distinct().collect()} == {"j0", "j2"}
    # Another session knows the folder only.
    spark.sql(f"DROP TABLE {name}")
    again = seen_table(spark, name, path, 8)
    assert again.count() == 360
    known = queued(spark, 0, 600).select("job_execution_id", "uri_hash").distinct()
    assert without_seen(known, again).count() == 600 - 360


def test_admission_over_two_runs(spark, table):
    """What a run has queued, the next one rejects as seen."""
    name, path = table
    i = F.col("id")
    pages = spark.range(60).select(
        i.alias("page_id"), F.concat(F.lit("u"), i % 25).alias("found_uri"), F.concat(F.lit("u"), i % 25).alias("uri"),
        F.sha1(F.concat(F.lit("u"), i % 25)).alias("uri_hash"), F.lit("e").alias("execution_id"), F.lit("j").alias("job_execution_id"),
        F.lit("s").alias("seed_uri"), F.lit("L").alias("discovery_path"), F.lit("r").alias("referrer"), F.lit(1).alias("sequence"),
        F.lit(1.0).alias("priority_weight"), F.lit("h").alias("host"), F.lit("10.0.0.1").alias("ip"), F.lit(None).cast("int").alias("_reason"),
        F.lit("NONE").alias("outcome"), F.lit("g").alias("host_group_id"))
    one = materialize(first_sights(pages.where("page_id < 20"), spark.table(name)), "admitted")
    remember(one, name)
    two = first_sights(pages.where("page_id >= 20"), seen_table(spark, name, path, 8)).collect()
    assert one.where("decision = 'QUEUED'").count() == 20
    assert sorted(r["uri"] for r in two if r["decision"] == "QUEUED") == ["u20", "u21", "u22", "u23", "u24"]
    assert {r["reason"] for r in two if r["decision"] == "REJECTED"} == {-4100}
