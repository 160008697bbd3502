"""Streams over several batches give what their batch twins give."""

import pytest
from pyspark.sql import functions as F

from crawlatlas.operators.executions import fold_changes
from crawlatlas.operators.rollups import job_totals_from_changes
from crawlatlas.operators.frontier import already_seen, oos_new_hosts, revisit_mark
from crawlatlas.operators.recent import replace_rewritten, retain
from crawlatlas.session import scratch
from crawlatlas.streaming import executions as E
from crawlatlas.streaming import logs as S
from crawlatlas.streaming import tables as T

CHANGE = ("execution_id string, job_execution_id string, seq bigint, state string, change_time timestamp_ntz, end_time timestamp_ntz, "
          "add_documents_crawled bigint, add_bytes_crawled bigint, add_uris_crawled bigint, add_documents_failed bigint, "
          "add_documents_out_of_scope bigint, add_documents_retried bigint, add_documents_denied bigint, error_code int")


def batches(spark, rows, n, order):
    """The rows as a stream of ``n`` batches in order."""
    path = scratch(spark, "input")
    total = rows.count()
    ranked = [r[order] for r in rows.select(order).orderBy(order).collect()]
    for i in range(n):
        low, high = ranked[i * total // n], ranked[min((i + 1) * total // n, total - 1)]
        part = rows.where((F.col(order) >= low) & ((F.col(order) < high) if i < n - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@pytest.fixture(scope="module")
def changes(spark):
    data = [
        ("a", 1, "CREATED", None, None), ("a", 2, "FETCHING", None, None), ("a", 3, "SLEEPING", None, None),
        ("a", 5, "FINISHED", 5, None), ("a", 7, "FETCHING", None, -4), ("a", 8, "FAILED", 8, None), ("a", 9, "CREATED", None, None),
        ("b", 4, "UNDEFINED", None, None), ("b", 6, "FAILED", None, -5), ("b", 10, "FINISHED", 10, None), ("b", 12, "UNDEFINED", 12, None),
        ("c", 11, "FETCHING", 11, None), ("c", 13, "ABORTED_MANUAL", 13, None), ("d", 14, "UNDEFINED", None, None),
    ]
    stamp = "2024-01-01 00:00:{:02d}"
    rows = spark.createDataFrame([(e, "j", s, st, stamp.format(s), None if end is None else stamp.format(end), err)
                                  for e, s, st, end, err in data],
                                 "execution_id string, job_execution_id string, seq bigint, state string, change_time string, end_time string, error_code int")
    counters = [F.col("seq").alias(c.split()[0]) for c in CHANGE.split(", ") if c.startswith("add_")]
    return rows.select("execution_id", "job_execution_id", "seq", "state", F.col("change_time").cast("timestamp_ntz"),
                       F.col("end_time").cast("timestamp_ntz"), *counters, "error_code")


def test_state_machine_golden(changes):
    got = {r["execution_id"]: r for r in fold_changes(changes).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a["state"], a["end_time"].second, a["start_time"].second, a["error_code"]) == ("FINISHED", 5, 2, -4)
    assert (b["state"], b["end_time"].second, b["start_time"].second) == ("FAILED", 10, 6)
    assert (c["state"], c["end_time"].second, c["desired_cleared"]) == ("ABORTED_MANUAL", 13, True)
    assert (d["state"], d["start_time"], d["documents_crawled"]) == ("CREATED", None, 14)


def test_state_machine_stream(spark, changes):
    stream = batches(spark, changes, 3, "seq")
    out = T.updated(E.state_machine(stream), ["execution_id"], "states")
    columns = fold_changes(changes).columns
    got = out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_time") else F.col(c) for c in columns])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold_changes(changes).collect()))


def test_state_machine_over_shuffled_batches(spark):
    """30 000 changes of one execution, shuffled over batches, lead where they lead in order."""
    i = F.col("id")
    states = F.element_at(F.array(*[F.lit(s) for s in ("FETCHING", "SLEEPING", "UNDEFINED", "CREATED", "FETCHING")]), (i % 5 + 1).cast("int"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + i).cast("timestamp_ntz")
    state = F.when(i == 20_011, "FAILED").when(i == 25_000, "FINISHED").otherwise(states)
    rows = spark.range(30_000).select(
        F.lit("x").alias("execution_id"), F.lit("j").alias("job_execution_id"), i.alias("seq"), state.alias("state"),
        at.alias("change_time"), F.when(i % 4999 == 0, at).alias("end_time"),
        *[(i % 3).alias(c.split()[0]) for c in CHANGE.split(", ") if c.startswith("add_")],
        F.when(i % 7001 == 5, i.cast("int")).alias("error_code"), F.xxhash64(i).alias("shuffled"))
    want = fold_changes(rows.drop("shuffled")).first()
    for n in (1, 3):
        stream = batches(spark, rows, n, "shuffled").drop("shuffled")
        got = T.updated(E.state_machine(stream), ["execution_id"], "states")
        got = got.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_time") else F.col(c)
                           for c in fold_changes(rows).columns]).first()
        assert tuple(got) == tuple(want) and got["state"] == "FAILED"


def test_job_totals_over_batches(spark, changes):
    old = F.when(F.col("state") == "CREATED", "UNDEFINED").otherwise("CREATED")
    rows = changes.withColumn("new_state", F.col("state")).withColumn("old_state", old).withColumn(
        "job_execution_id", F.when(F.col("execution_id") == "d", "unknown").otherwise("j"))
    want = {r["job_execution_id"]: r.asDict() for r in job_totals_from_changes(rows).collect()}
    got = {r["job_execution_id"]: r.asDict() for r in E.job_totals_stream(batches(spark, rows, 3, "seq")).collect()}
    assert got == want and set(want) == {"j"} and want["j"]["documents_crawled"] == sum(range(1, 14))


def test_recent_window(spark):
    rows = spark.createDataFrame([
        ("crawl", "crawl-1", "e", 1, "a"), ("crawl", "crawl-2", "e", 2, "b"), ("crawl", "crawl-3", "e", 3, "c"),
        ("page", "page-1", "e", 4, "p"), ("crawl", "crawl-2", "e", 5, "new"), ("page", "page-2", "e", 6, "q"),
        ("crawl", "", "e", 0, "blank")],
        "log_type string, warc_id string, execution_id string, ingestion_seq bigint, payload string")
    first = retain(replace_rewritten(rows.where("ingestion_seq <= 3")), 2, 1)
    assert [r["warc_id"] for r in first.orderBy(F.desc("ingestion_seq")).collect()] == ["crawl-3", "crawl-2"]
    want = {("crawl-2", "new"), ("crawl-3", "c"), ("page-2", "q")}
    for result in (retain(replace_rewritten(rows), 2, 1), S.recent_window(batches(spark, rows, 3, "ingestion_seq"), 2, 1)):
        assert {(r["warc_id"], r["payload"]) for r in result.collect()} == want


def test_already_seen_over_batches(spark):
    rows = spark.createDataFrame([(i, f"j{i % 2}", f"u{i % 7}") for i in range(60)],
                                 "pos bigint, job_execution_id string, uri_hash string")
    got = S.already_seen_stream(batches(spark, rows, 4, "pos"), "pos")
    want = already_seen(rows, "pos")
    assert sorted(map(tuple, got.select(rows.columns).collect())) == sorted(map(tuple, want.select(rows.columns).collect()))
    ended = spark.createDataFrame([("j0",)], "job_execution_id string")
    again = S.already_seen_stream(batches(spark, rows, 4, "pos"), "pos", ended)
    assert again.where("job_execution_id = 'j0'").count() > want.where("job_execution_id = 'j0'").count()


def test_revisits_over_batches(spark):
    rows = spark.createDataFrame([(f"r{i}", "c", "" if i % 9 == 0 else f"d{i % 5}", "" if i % 18 == 0 else f"b{i % 3}", i,
                                   "request" if i % 11 == 0 else "response") for i in range(1, 60)],
                                 "record_id string, collection string, digest string, block_digest string, seq bigint, record_type string")
    end, now = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    got = S.revisit_stream(batches(spark, rows, 3, "seq"), ["seq"], end, now)
    want = {r["record_id"]: r["refers_to"] for r in revisit_mark(rows, ["seq"]).collect()}
    assert {r["record_id"]: r["refers_to"] for r in got.collect()} == want
    late = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    expired = S.revisit_stream(batches(spark, rows, 3, "seq"), ["seq"], end, late)
    assert expired.where("is_revisit").count() < sum(v is not None for v in want.values())


def test_out_of_scope_hosts_over_batches(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.lit("http")).alias("scheme"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 13 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("h"), F.col("id") % 701)).alias("host"), F.lit("clash").alias("_shard"))
    existing = spark.createDataFrame([("http", "h5", 1), ("http", "h6", 2), (None, "hot", 3)], "scheme string, host string, id int")
    want = oos_new_hosts(rows, existing.drop("id"))
    got = S.new_oos_hosts(batches(spark, rows, 6, "id"), existing)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_hot_host_is_cut_down_before_the_shuffle(spark):
    rows = spark.createDataFrame([("http", "hot")] * 500 + [("http", "h1"), (None, None), (None, None)], "scheme string, host string").coalesce(1)
    few = rows.mapInArrow(S._distinct_in_batch, rows.schema).collect()
    assert sorted(map(tuple, few), key=repr) == [("http", "h1"), ("http", "hot"), (None, None)]


def test_records_of_one_write_are_not_compared(spark):
    rows = spark.createDataFrame([("r1", "w1"), ("r2", "w1"), ("r3", "w2")], "record_id string, write_id string").select(
        "*", F.lit("c").alias("collection"), F.lit("d").alias("digest"), F.lit("").alias("block_digest"),
        F.lit("response").alias("record_type"), F.col("record_id").alias("seq"))
    got = {r["record_id"]: r["refers_to"] for r in revisit_mark(rows, ["seq"], "write_id").collect()}
    assert got == {"r1": None, "r2": None, "r3": "r1"}


def test_rates_match_batch(spark):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00") for i in range(100)], "n bigint, at string").select(
        "n", F.col("at").cast("timestamp").alias("ts"))
    got = T.updated(S.rate(batches(spark, rows, 3, "n"), "ts", [], delay="2 hours"), ["window_start"], "rate")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.rate(rows, "ts", []).collect()))


def test_failed_archive_skips_the_recent_copy(spark):
    done = []

    def fail(rows, batch):
        raise RuntimeError("disk")

    with pytest.raises(RuntimeError):
        S.fanout(fail, lambda r, b: done.append(b))(None, 1)
    assert done == []
    S.fanout(lambda r, b: done.append(("archive", b)), fail, lambda b, e: done.append(("lost", b)))(None, 2)
    assert done == [("archive", 2), ("lost", 2)]


def test_source_reads_a_file_and_a_folder_of_parts(spark):
    """Large tables are folders of part files, which a name filter on the files inside would miss."""
    folder = scratch(spark, "tables")
    spark.range(40).repartition(4).write.parquet(f"{folder}/many.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{folder}/parts")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = jvm.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in files.listStatus(jvm.Path(f"{folder}/parts")) if s.getPath().getName().endswith(".parquet"))
    files.rename(part, jvm.Path(f"{folder}/one.parquet"))
    assert sorted(r["id"] for r in T.appended(T.source(spark, folder, "many"), "many").collect()) == list(range(40))
    assert sorted(r["id"] for r in T.appended(T.source(spark, folder, "one"), "one").collect()) == list(range(7))
