"""Totals, counters and reports.

Every group is combined map-side before its shuffle, and nothing gathers the rows of
a group: lists come out as rows, or are bounded by an enumeration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlatlas.functions.archive import mime_of
from crawlatlas.operators.skew import annotate, look_up
from crawlatlas.schemas import COUNTERS, EXECUTION_STATES, RUNNING_STATES

# Upper bounds of the page fetch histogram, in seconds.
PAGE_FETCH_BOUNDS = [.005, .01, .025, .05, .075, .1, .25, .5, .75, 1, 2.5, 5, 7.5, 10, 20, 30, 40, 50, 60, 120, 180, 240]

# Request types that do not hold up a page.
BACKGROUND_TYPES = ["Ping", "EventSource", "WebSocket", "CSPViolationReport", "Preflight", "XHR", "Fetch",
                    "Manifest", "SignedExchange", "FedCM", "Other", "Prefetch"]

# The states and sizes reported per job.
GAUGE_STATES = ["ABORTED_MANUAL", "ABORTED_SIZE", "ABORTED_TIMEOUT", "CREATED", "FAILED", "FETCHING", "FINISHED", "SLEEPING"]
GAUGE_SIZES = ["documents_crawled", "documents_denied", "documents_failed", "documents_out_of_scope",
               "documents_retried", "uris_crawled", "bytes_crawled"]


def job_totals(executions: DataFrame) -> DataFrame:
    """Counter sums and a state -> count map per job execution."""
    by_state = executions.groupBy("job_execution_id", "state").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in COUNTERS])
    return by_state.groupBy("job_execution_id").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("executions_state"))


def counted_changes(changes: DataFrame, known_jobs: DataFrame | None = None) -> DataFrame:
    """Deltas from the one on that creates their job execution; those of a job nobody has created are ignored."""
    marked = annotate(changes, ["job_execution_id"], {
        "_created": F.min(F.when(F.col("new_state") == "CREATED", F.col("seq")))})
    if known_jobs is not None:
        known = known_jobs.select("id").distinct().withColumn("_known", F.lit(True))
        marked = look_up(marked, known, {"job_execution_id": "id"}, ["_known"])
    else:
        marked = marked.withColumn("_known", F.lit(None).cast("boolean"))
    return marked.where(F.col("_known") | (F.col("seq") >= F.col("_created")))


def change_sums(counted: DataFrame) -> DataFrame:
    """Per job execution: sums of the counters, a column for each state's count, and how many are running."""
    def count(state: str) -> Column:
        return F.count_if(F.col("new_state") == state) - F.count_if(F.col("old_state") == state)

    sums = counted.groupBy("job_execution_id").agg(
        *[F.sum("add_" + c).alias(c) for c in COUNTERS], *[count(s).alias(s.lower()) for s in EXECUTION_STATES if s != "UNDEFINED"])
    return with_running(sums)


def with_running(sums: DataFrame) -> DataFrame:
    running = [F.col(s.lower()) for s in RUNNING_STATES if s != "UNDEFINED"]
    return sums.withColumn("running", reduce(lambda a, b: a + b, running))


def job_totals_from_changes(changes: DataFrame, known_jobs: DataFrame | None = None) -> DataFrame:
    """Counters, state counts and running executions per job execution, from deltas."""
    return change_sums(counted_changes(changes, known_jobs))


def job_running_count(executions: DataFrame) -> DataFrame:
    """Executions of a job that have not ended."""
    return executions.groupBy("job_execution_id").agg(
        F.count_if(F.col("state").isin(RUNNING_STATES)).alias("running"), F.count(F.lit(1)).alias("total"))


def job_finalize(jobs: DataFrame, executions: DataFrame, now: Column) -> DataFrame:
    """End the jobs that have executions and none running, with totals merged in."""
    totals = job_totals(executions).drop("executions_state")
    running = job_running_count(executions)
    done = totals.join(running.where((F.col("total") > 0) & (F.col("running") == 0)), "job_execution_id")
    ended = jobs.join(done.withColumnRenamed("job_execution_id", "id"), "id", "left")
    is_done = F.col("total").isNotNull()
    state = (F.when(F.col("state").isin("FAILED", "ABORTED_MANUAL"), F.col("state"))
             .otherwise(F.coalesce("desired_state", F.lit("FINISHED"))))
    return (ended.withColumn("state", F.when(is_done, state).otherwise(F.col("state")))
            .withColumn("end_time", F.when(is_done, now).otherwise(F.col("end_time")))
            .drop("running", "total"))


def label_keys(objects: DataFrame, kind: str) -> DataFrame:
    """Distinct lower-cased label keys of a kind."""
    return (objects.where(F.col("kind") == kind)
            .select(F.explode(F.transform("meta.label", lambda e: F.lower(e["key"]))).alias("key")).distinct())


def uri_counters(logs: DataFrame) -> DataFrame:
    """Request, failure, status, record type and mime counts in one pass."""
    def counter(name: str, label: Column) -> Column:
        return F.struct(F.lit(name).alias("counter"), label.cast("string").alias("label"))

    blank = F.lit("")
    mime = mime_of(F.col("content_type"))
    counters = F.array_compact(F.array(
        counter("requests", blank),
        F.when(F.col("error_code") != 0, counter("requests_failed", blank)),
        counter("status_code", F.col("status_code")),
        counter("record_type", F.col("record_type")),
        F.when(mime != "", counter("mime_type", mime))))
    return logs.select(F.explode(counters).alias("c")).groupBy("c.counter", "c.label").agg(
        F.count(F.lit(1)).alias("n"))


def positive_summary(logs: DataFrame, column: str) -> DataFrame:
    """Count and sum over the rows with a positive value."""
    return logs.where(F.col(column) > 0).agg(F.count(F.lit(1)).alias("count"), F.sum(column).alias("sum"))


def fetch_time_summary(logs: DataFrame) -> DataFrame:
    return positive_summary(logs, "fetch_time_ms").select("count", (F.col("sum") / 1000).alias("sum_seconds"))


def size_summary(logs: DataFrame) -> DataFrame:
    return positive_summary(logs, "size").select("count", F.col("sum").alias("sum_bytes"))


def page_counters(messages: DataFrame) -> DataFrame:
    """Page, outlink, resource and cache totals of page log messages, one row per counter."""
    per_page = messages.groupBy("page_id").agg(
        F.count("outlink").alias("outlinks"), F.count("resource").alias("resources"),
        F.count_if(F.col("resource.from_cache")).alias("cached"))
    totals = per_page.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("outlinks") > 0).alias("pages_with_outlinks"),
        F.sum("outlinks").alias("links_outlinks"),
        F.count_if(F.col("resources") > 0).alias("pages_with_resources"),
        F.sum("cached").alias("links_resources_cached"),
        F.sum(F.col("resources") - F.col("cached")).alias("links_resources_notcached"))
    return unpivot_row(totals, "counter", "n")


def unpivot_row(row: DataFrame, name: str, value: str) -> DataFrame:
    """Columns of a one-row table as rows."""
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("bigint").alias(value)) for c in row.columns])).alias("e")).select("e.*")


def queue_total(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("n"))


def queue_count_for(queue: DataFrame, ids: list[str], column: str) -> DataFrame:
    """Counts of the requested ids (at most 100) in request order, 0 where none is queued."""
    if len(ids) > 100:
        raise ValueError("at most 100 ids may be requested")
    spark = queue.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    counts = (queue.where(F.col(column).isin(ids)).groupBy(F.col(column).alias("id"))
              .agg(F.count(F.lit(1)).alias("n")))
    return wanted.join(counts, "id", "left").select("pos", "id", F.coalesce("n", F.lit(0)).alias("n"))


def queue_count_by(queue: DataFrame, column: str) -> DataFrame:
    return queue.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def busy_host_groups(queue: DataFrame) -> DataFrame:
    """Host groups with a fetch in progress."""
    return queue.where("fetch_started").agg(F.count_distinct("crawl_host_group_id").alias("n"))


def page_harvest_totals(requests: DataFrame) -> DataFrame:
    """URIs and bytes per page over records with a warc id; resources are all logged requests."""
    stored = F.col("has_crawl_log") & (F.col("warc_id") != "")
    return requests.groupBy("page_id").agg(
        F.count_if(stored).alias("uris"),
        F.coalesce(F.sum(F.when(stored, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if("has_crawl_log").alias("resources"))


def page_fetch_histogram(rows: DataFrame, millis: str) -> DataFrame:
    """Cumulative buckets over fetch times truncated to whole seconds."""
    seconds = F.floor(F.col(millis) / 1000)
    counted = rows.agg(*[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(PAGE_FETCH_BOUNDS)],
                       F.count(millis).alias("all"))
    bounds = [str(b) for b in PAGE_FETCH_BOUNDS] + ["+Inf"]
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(le).alias("le"), F.col(c).alias("n")) for le, c in zip(bounds, counted.columns)])).alias("e")).select("e.*")


def failures_by_code(rows: DataFrame, code: str = "error_code") -> DataFrame:
    return rows.where(F.col(code) != 0).groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def page_completeness(requests: DataFrame, listed: int = 8) -> DataFrame:
    """Blocking, resolved, unresolved and ignored requests per page, with the first few missing ones."""
    blocking = F.col("got_new") & ~F.col("resource_type").isin(BACKGROUND_TYPES)
    missing = blocking & ~F.col("has_crawl_log")
    counts = requests.groupBy("page_id").agg(
        F.count_if(blocking).alias("blocking"),
        F.count_if(blocking & F.col("has_crawl_log")).alias("resolved"),
        F.count_if(missing).alias("unresolved"),
        F.count_if(~blocking).alias("ignored"))
    # The rank limit is applied before the shuffle, so a page sends a few rows per task.
    first = (requests.where(missing).select("page_id", "idx", "request_id")
             .withColumn("_rank", F.row_number().over(Window.partitionBy("page_id").orderBy("idx", "request_id")))
             .where(F.col("_rank") <= listed)
             .groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "request_id"))).alias("m")))
    return counts.join(first, "page_id", "left").select(
        *counts.columns, F.coalesce(F.col("m.request_id"), F.array().cast("array<string>")).alias("missing"))


def oos_totals(uris: DataFrame) -> DataFrame:
    """Requests, duplicates and unique hosts among out-of-scope submissions."""
    return uris.agg(F.count(F.lit(1)).alias("requests"),
                    F.count_distinct("scheme", "host").alias("unique_hosts")).select(
        "requests", (F.col("requests") - F.col("unique_hosts")).alias("duplicates"), "unique_hosts")


def duplicate_keys(pairs: DataFrame) -> DataFrame:
    """Every (key, id) of a key that two or more ids share; ids are rows, so a key may have any number."""
    distinct = pairs.select("key", "id").distinct()
    return annotate(distinct, ["key"], {"n_ids": F.count(F.lit(1))}).where(F.col("n_ids") >= 2)


def duplicate_totals(pairs: DataFrame) -> DataFrame:
    """Number of shared keys and of the ids that share them."""
    per_key = pairs.select("key", "id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.where("n >= 2").agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids"))


def latest_per_job(rows: DataFrame, job: str = "job_id", start: str = "start_time") -> DataFrame:
    """The row with the newest start per job, by aggregation rather than a window over the job."""
    newest = F.max_by(F.struct(*rows.columns), F.when(F.col(start).isNotNull(), F.struct(start, "id")))
    return rows.groupBy(job).agg(newest.alias("_r")).where("_r IS NOT NULL").select("_r.*")


def job_state_gauges(latest: DataFrame, totals: DataFrame) -> DataFrame:
    """State counts and sizes of the latest execution of each job, 0 where missing, one row per gauge."""
    joined = latest.select("job_id", F.col("id").alias("job_execution_id")).join(totals, "job_execution_id", "left")
    states = [F.struct(F.lit(s).alias("gauge"),
                       F.coalesce(F.try_element_at("executions_state", F.lit(s)), F.lit(0)).cast("bigint").alias("value"))
              for s in GAUGE_STATES]
    sizes = [F.struct(F.lit(c).alias("gauge"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("value"))
             for c in GAUGE_SIZES]
    return joined.select("job_id", F.explode(F.array(*states, *sizes)).alias("g")).select("job_id", "g.*")


def remaining_seeds(executions: DataFrame) -> DataFrame:
    """Seeds of a job that are counted but have not finished or failed."""
    done = F.col("state").isin("FINISHED", "FAILED")
    counted = F.col("state").isin("FETCHING", "SLEEPING", "CREATED", "FINISHED", "FAILED")
    return executions.groupBy("job_id").agg((F.count_if(counted) - F.count_if(done)).alias("remaining"))


def warc_file_index(logs: DataFrame) -> DataFrame:
    """Records, bytes, offsets and record types per archive file named in ``storage_ref``."""
    pattern = r"^warcfile:(.*):(\d+)$"
    placed = logs.where(F.col("storage_ref").rlike(pattern)).select(
        F.regexp_extract("storage_ref", pattern, 1).alias("file"),
        F.regexp_extract("storage_ref", pattern, 2).cast("bigint").alias("offset"), "size", "record_type")
    return placed.groupBy("file").agg(
        F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"),
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
        F.concat_ws(",", F.array_sort(F.collect_set("record_type"))).alias("record_types"))


def crawler_status(queue: DataFrame, pause_wanted: bool) -> DataFrame:
    """Queue size, busy groups and run status in one pass over the queue."""
    totals = queue.agg(
        F.count(F.lit(1)).alias("queue_size"),
        F.count_distinct(F.when(F.col("fetch_started"), F.col("crawl_host_group_id"))).alias("busy_groups"))
    paused = F.when(F.col("busy_groups") > 0, "PAUSE_REQUESTED").otherwise("PAUSED")
    return totals.withColumn("run_status", paused if pause_wanted else F.lit("RUNNING"))


def common_labels(objects: DataFrame) -> DataFrame:
    """Labels that every selected object carries."""
    total = objects.select("id").distinct().count()
    pairs = objects.select("id", F.explode(F.array_distinct("meta.label")).alias("l")).select("id", "l.key", "l.value")
    return (pairs.distinct().groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == total).select("key", "value"))
