"""Keyed state: batches equal their batch twins, ended jobs and expired digests leave it."""

import random

import pytest
from pyspark.sql import functions as F

from crawlatlas.operators.frontier import already_seen, revisit_mark
from crawlatlas.session import scratch
from crawlatlas.streaming import logs as S
from crawlatlas.streaming import state
from crawlatlas.streaming import tables as T
from test_streams import batches


def ran(stream, path):
    spark = stream.sparkSession
    with state.keyed_state(spark):
        T.run_available(stream, lambda rows, batch: T.write_batch(rows, path, "out", batch), path)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def held(spark, path, variable):
    return spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", variable).load()


def parts(spark, tables, label="input"):
    """Tables as a stream of one batch each."""
    path = scratch(spark, label)
    for i, rows in enumerate(tables):
        rows.coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_first_sights_over_fifty_batches(spark):
    r = random.Random(1)
    data = [(i, r.choice(["j0", "j1", "j2", None]), "hot" if r.random() < 0.4 else r.choice([None, *(f"u{k}" for k in range(300))]), f"x{i}")
            for i in range(2000)]
    rows = spark.createDataFrame(data, "pos bigint, job_execution_id string, uri_hash string, more string").repartition(1)
    got = S.already_seen_stream(batches(spark, rows, 50, "pos"), "pos")
    want = already_seen(rows, "pos")
    assert sorted(map(tuple, got.select(rows.columns).collect()), key=repr) == sorted(map(tuple, want.select(rows.columns).collect()), key=repr)


def test_the_end_of_a_job_clears_what_it_has_seen(spark):
    schema = "pos bigint, job_execution_id string, uri_hash string"
    each = [spark.createDataFrame([(10 * b + i, f"j{i % 2}", f"u{i}") for i in range(6)], schema) for b in range(3)]
    nothing = spark.createDataFrame([], "job_execution_id string")
    ends = [nothing, spark.createDataFrame([("j0",)], "job_execution_id string"), nothing]
    path = scratch(spark, "ended")
    got = ran(state.first_sights(parts(spark, each), "pos", parts(spark, ends, "ends"), shards=3), path).collect()
    # The third batch sees all of j0 again, which the second one has ended.
    assert sorted((r["pos"], r["job_execution_id"]) for r in got) == [*((i, f"j{i % 2}") for i in range(6)), *((20 + i, "j0") for i in (0, 2, 4))]
    path = scratch(spark, "ended")
    ends = [nothing, nothing, spark.createDataFrame([("j0",), ("never",)], "job_execution_id string")]
    ran(state.first_sights(parts(spark, each), "pos", parts(spark, ends, "ends"), shards=3), path)
    left = held(spark, path, "seen")
    assert left.count() == 3 and {r[0] for r in left.select("key.job_execution_id").collect()} == {"j1"}


def records(spark, data):
    return spark.createDataFrame(data, "record_id string, collection string, digest string, block_digest string, seq bigint, record_type string, at timestamp, ends timestamp")


def test_known_content_over_fifty_batches(spark):
    r = random.Random(2)
    data = [(f"r{i}", r.choice("ab"), r.choice(["", None, "hot", "hot", *(f"d{k}" for k in range(40))]), r.choice(["", "b1", "b2"]), i,
             r.choice(["response", "resource", "request"]), None, None) for i in range(800)]
    rows = records(spark, data).repartition(1)
    got = S.revisit_stream(batches(spark, rows, 50, "seq"), ["seq"], F.lit(None).cast("timestamp"), F.current_timestamp())
    want = {x["record_id"]: (x["is_revisit"], x["refers_to"]) for x in revisit_mark(rows, ["seq"]).collect()}
    assert {x["record_id"]: (x["is_revisit"], x["refers_to"]) for x in got.collect()} == want and got.count() == 800


def test_digests_leave_when_their_period_ends(spark):
    """Content of one day is new again on the next, and the state holds the last day alone."""
    stamp = "2024-01-0{} {:02d}:00:00"
    each = []
    for day in (1, 2, 3):
        data = [(f"r{day}{h}", "c", f"d{h % 3}", "", 100 * day + h, "response", stamp.format(day, h), stamp.format(day + 1, 0)) for h in range(6)]
        text = "record_id string, collection string, digest string, block_digest string, seq bigint, record_type string, at string, ends string"
        each.append(spark.createDataFrame(data, text).withColumns({c: F.col(c).cast("timestamp") for c in ("at", "ends")}))
    last = spark.createDataFrame([("z", "c", "d9", "", 999, "response", "2024-01-04 12:00:00", None)], text).withColumns(
        {c: F.col(c).cast("timestamp") for c in ("at", "ends")})
    path = scratch(spark, "expired")
    stream = state.known_content(parts(spark, [*each, last]), ["seq"], F.col("ends"), F.col("at"), time="at", shards=2)
    got = {r["record_id"]: r["refers_to"] for r in ran(stream, path).collect()}
    assert got == {**{f"r{d}{h}": None if h < 3 else f"r{d}{h % 3}" for d in (1, 2, 3) for h in range(6)}, "z": None}
    assert {r[0] for r in held(spark, path, "known").select("user_map_value.record").collect()} == {"z"}


@pytest.mark.parametrize("shards", [1, 5])
def test_a_row_meets_what_is_known_at_its_own_time(spark, shards):
    """The answer is the same however rows fall into batches, expired or not."""
    r = random.Random(3)
    data = [(f"r{i}", "c", f"d{r.randrange(4)}", "", i, "response", f"2024-01-01 00:{i:02d}:00", f"2024-01-01 00:{min(59, i + r.randrange(20)):02d}:00")
            for i in range(50)]
    text = "record_id string, collection string, digest string, block_digest string, seq bigint, record_type string, at string, ends string"
    rows = spark.createDataFrame(data, text).withColumns({c: F.col(c).cast("timestamp") for c in ("at", "ends")})
    results = []
    for n in (1, 4):
        stream = state.known_content(batches(spark, rows, n, "seq"), ["seq"], F.col("ends"), F.col("at"), shards=shards)
        results.append({x["record_id"]: x["refers_to"] for x in ran(stream, scratch(spark, "own")).collect()})
    assert results[0] == results[1] and len(results[0]) == 50 and None in results[0].values()
