"""Queries that run a stream over what is there and read its result."""

from pyspark.sql import functions as F

from crawlatlas.functions import urls as U
from crawlatlas.operators import updates as UP
from crawlatlas.operators.executions import fold_changes
from crawlatlas.registry.base import query
from crawlatlas.registry.ordering import _RECENT, recent_rows
from crawlatlas.registry.rollups import JOB_CHANGES, with_states
from crawlatlas.registry.updates import _at
from crawlatlas.schemas import COUNTERS, TERMINAL_STATES
from crawlatlas.session import scratch
from crawlatlas.sources import logs as L
from crawlatlas.sources.derived import crawl_execution, derive, rowwise
from crawlatlas.sources.tables import load
from crawlatlas.streaming import executions as E
from crawlatlas.streaming import logs as S
from crawlatlas.streaming import tables as T


def stream_of(spark, sf_dir, name):
    base = {"crawled": "documents"}.get(name, "events")
    return derive(T.source(spark, sf_dir, base), name)


_TERMINAL = "state IN (" + ", ".join(f"'{s}'" for s in TERMINAL_STATES) + ")"
_SUMS = ", ".join(f"cast(sum(add_{c}) as bigint) AS {c}" for c in COUNTERS)
_FOLD = f"""WITH v AS (SELECT * FROM execution_change WHERE state <> 'CREATED'),
m AS (SELECT *, min(CASE WHEN {_TERMINAL} THEN seq END) OVER (PARTITION BY execution_id) AS ended FROM v)
SELECT execution_id, coalesce(arg_min(state, seq) FILTER (WHERE {_TERMINAL}), arg_max(state, seq) FILTER (WHERE state IN ('FETCHING', 'SLEEPING')), 'CREATED') AS state,
  arg_min(change_time, seq) FILTER (WHERE {_TERMINAL} OR state = 'FETCHING') AS start_time,
  coalesce(arg_max(end_time, seq) FILTER (WHERE end_time IS NOT NULL AND (ended IS NULL OR seq <= ended)),
    arg_min(end_time, seq) FILTER (WHERE end_time IS NOT NULL AND seq > ended)) AS end_time,
  arg_max(change_time, seq) AS last_change_time, arg_max(error_code, seq) FILTER (WHERE error_code IS NOT NULL) AS error_code,
  bool_or(state LIKE 'ABORTED%') AS desired_cleared, {_SUMS}
FROM m GROUP BY 1"""


@query("execution_state_fold", _FOLD)
def execution_state_fold(spark, sf_dir):
    return fold_changes(rowwise(spark, sf_dir, "execution_change"))


@query("execution_state_machine", _FOLD)
def execution_state_machine(spark, sf_dir):
    out = T.updated(E.state_machine(stream_of(spark, sf_dir, "execution_change")), ["execution_id"], "states")
    return out.select("execution_id", "state", *[F.col(c).cast("timestamp_ntz").alias(c) for c in (
        "start_time", "end_time", "last_change_time")], "error_code", "desired_cleared", *COUNTERS)


@query("job_totals_stream", JOB_CHANGES)
def job_totals_stream(spark, sf_dir):
    return E.job_totals_stream(with_states(stream_of(spark, sf_dir, "execution_change")))


@query("watch_executions", """
SELECT DISTINCT execution_id, job_execution_id, state, end_time FROM execution_change WHERE state IN ('FETCHING', 'FINISHED')""")
def watch_executions(spark, sf_dir):
    changes = stream_of(spark, sf_dir, "execution_change").select(
        "execution_id", "job_execution_id", "state", "end_time", "change_time")
    found = E.watch(changes, F.col("state").isin("FETCHING", "FINISHED"), "60 days")
    return T.appended(found.drop("change_time"), "watch")


@query("watch_with_initial", """
SELECT id, state, true AS initial FROM crawl_execution WHERE state = 'FINISHED'
UNION ALL SELECT execution_id, state, false FROM execution_change WHERE state = 'FINISHED'""")
def watch_with_initial(spark, sf_dir):
    changes = stream_of(spark, sf_dir, "execution_change").select(F.col("execution_id").alias("id"), "state")
    current = crawl_execution(spark, sf_dir).select("id", "state")
    return E.watch_with_initial(changes, current, F.col("state") == "FINISHED")


@query("already_seen_stream", """
SELECT id, job_execution_id, uri FROM queued_uri
QUALIFY row_number() OVER (PARTITION BY job_execution_id, uri ORDER BY cast(substring(id, 2) as bigint)) = 1""")
def already_seen_stream(spark, sf_dir):
    uris = stream_of(spark, sf_dir, "queued_uri").select(
        "id", "job_execution_id", "uri", U.uri_hash(F.col("uri")).alias("uri_hash"),
        F.substring("id", 2, 20).cast("bigint").alias("pos"))
    return S.already_seen_stream(uris, "pos").select("id", "job_execution_id", "uri")


@query("revisit_stream", """
WITH k AS (SELECT *, CASE WHEN record_type IN ('response', 'resource') THEN coalesce(nullif(digest, ''), nullif(block_digest, '')) END AS key FROM crawled),
m AS (SELECT *, first_value(record_id) OVER (PARTITION BY collection, key ORDER BY seq) AS first_id FROM k)
SELECT record_id, key IS NOT NULL AND first_id <> record_id AS is_revisit, CASE WHEN key IS NOT NULL AND first_id <> record_id THEN first_id END AS refers_to FROM m""")
def revisit_stream(spark, sf_dir):
    end = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    rows = S.revisit_stream(stream_of(spark, sf_dir, "crawled"), ["seq"], end, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    return rows.select("record_id", "is_revisit", "refers_to")


@query("due_items", "SELECT id, crawl_host_group_id FROM queued_uri WHERE earliest_fetch <= 1705000000000")
def due_items(spark, sf_dir):
    return UP.due_items(rowwise(spark, sf_dir, "queued_uri"), 1_705_000_000_000, "earliest_fetch").select(
        "id", "crawl_host_group_id")


@query("execution_timeouts", """
SELECT e.id, 'ABORTED_TIMEOUT' AS desired_state FROM crawl_execution e JOIN crawl_job j ON j.id = e.job_id
WHERE max_duration_s > 0 AND created_time + to_seconds(max_duration_s) <= timestamp '2024-01-10 00:00:00' AND end_time IS NULL
  AND state IN ('UNDEFINED', 'CREATED', 'FETCHING', 'SLEEPING')""")
def execution_timeouts(spark, sf_dir):
    return UP.execution_timeouts(crawl_execution(spark, sf_dir), rowwise(spark, sf_dir, "crawl_job"),
                                 _at("2024-01-10 00:00:00")).select("id", "desired_state")


@query("recent_window_stream", f"""WITH {_RECENT},
r AS (SELECT log_type, warc_id, max(ingestion_seq) AS ingestion_seq FROM recent WHERE warc_id <> '' GROUP BY 1, 2
  UNION ALL SELECT log_type, warc_id, ingestion_seq FROM recent WHERE warc_id = '')
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY log_type ORDER BY ingestion_seq DESC) <= CASE WHEN log_type = 'crawl' THEN 800 ELSE 200 END""")
def recent_window_stream(spark, sf_dir):
    rows = recent_rows(spark, sf_dir, T.source(spark, sf_dir, "events"))
    return S.recent_window(rows, 800, 200).select("log_type", "warc_id", "ingestion_seq")


_FORWARDED = "cast(substring(warc_id, 2) as bigint) % 2 = 0"


@query("stream_crawl_log", f"""
SELECT warc_id, CASE WHEN {_FORWARDED} THEN time_stamp ELSE 1710000000123 END AS time_ms, fetch_time_stamp AS fetch_ms FROM crawl_log""")
def stream_crawl_log(spark, sf_dir):
    logs = stream_of(spark, sf_dir, "crawl_log").select(
        "warc_id", F.timestamp_millis("time_stamp").alias("time_stamp"),
        F.timestamp_millis("fetch_time_stamp").alias("fetch_time_stamp"), F.expr(_FORWARDED).alias("forwarded"))
    stamped = S.normalize_logs(logs, F.lit("2024-03-09 16:00:00.123456").cast("timestamp"))
    return T.appended(stamped.select("warc_id", F.unix_millis("time_stamp").alias("time_ms"),
                                     F.unix_millis("fetch_time_stamp").alias("fetch_ms")), "ingest")


@query("fanout_archive_recent", """
SELECT collection_final_name AS collection, count(*) AS archived, 0 AS recent_failures FROM crawl_log GROUP BY 1""")
def fanout_archive_recent(spark, sf_dir):
    path = scratch(spark, "fanout")
    failures = []
    each = S.fanout(
        lambda rows, batch: L.sink_crawl_log(rows, f"{path}/archive/batch={batch}", mode="overwrite"),
        lambda rows, batch: T.write_batch(rows.select("warc_id", "execution_id", "time_stamp"), path, "recent", batch),
        lambda batch, error: failures.append(batch))
    T.run_available(stream_of(spark, sf_dir, "crawl_log"), each, path)
    archived = spark.read.option("basePath", f"{path}/archive").parquet(f"{path}/archive/batch=*/crawl_log")
    return archived.groupBy("collection").agg(
        F.count("*").alias("archived"), F.lit(len(failures)).alias("recent_failures"))


_WINDOWS = """windows AS (SELECT *, (epoch_us(ts) // 60000000) * 60000 - o * 60000 AS window_start FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS o))"""


@query("rate_pages", f"WITH {_WINDOWS} SELECT window_start, count(*) / 300 AS per_second FROM windows WHERE event_type = 'view' GROUP BY 1")
def rate_pages(spark, sf_dir):
    pages = T.source(spark, sf_dir, "events").where("event_type = 'view'")
    return T.updated(S.rate(pages, "ts", []), ["window_start"], "rate")


@query("rate_failures_by_code", f"""WITH {_WINDOWS}
SELECT window_start, error_code, count(*) / 300 AS per_second FROM (SELECT *, -1 - event_id % 10 AS error_code FROM windows WHERE event_type = 'error') GROUP BY 1, 2""")
def rate_failures_by_code(spark, sf_dir):
    failed = T.source(spark, sf_dir, "events").where("event_type = 'error'").withColumn(
        "error_code", -1 - F.col("event_id") % 10)
    return T.updated(S.rate(failed, "ts", ["error_code"]), ["window_start", "error_code"], "rate")


@query("rate_oos", f"WITH {_WINDOWS} SELECT window_start, count(*) / 300 AS per_second FROM windows WHERE event_type = 'signup' GROUP BY 1")
def rate_oos(spark, sf_dir):
    blocked = T.source(spark, sf_dir, "events").where("event_type = 'signup'")
    return T.updated(S.rate(blocked, "ts", []), ["window_start"], "rate")


@query("mean_fetch_time", """
SELECT (epoch_us(ts) // 60000000) * 60000 AS window_start, sum((event_id * 37) % 45000) / count(*) AS mean_ms FROM events GROUP BY 1""")
def mean_fetch_time(spark, sf_dir):
    rows = T.source(spark, sf_dir, "events").withColumn("fetch_ms", (F.col("event_id") * 37) % 45000)
    return T.updated(S.mean_fetch_time(rows, "ts", "fetch_ms"), ["window_start"], "mean")


@query("oos_stream", """
SELECT DISTINCT 'http' AS scheme, host FROM queued_uri WHERE host NOT IN (SELECT concat('h', n_nationkey, '.example.com') FROM nation)""")
def oos_stream(spark, sf_dir):
    uris = U.with_site(stream_of(spark, sf_dir, "queued_uri").select(F.col("uri").alias("url")))
    existing = load(spark, sf_dir, "nation").select(
        F.lit("http").alias("scheme"), F.concat(F.lit("h"), "n_nationkey", F.lit(".example.com")).alias("host"))
    return S.new_oos_hosts(uris, existing)
