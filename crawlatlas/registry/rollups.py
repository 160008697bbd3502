"""Queries over totals, counters and reports."""

from pyspark.sql import functions as F

from crawlatlas.functions import urls as U
from crawlatlas.operators import pagelog
from crawlatlas.operators import rollups as A
from crawlatlas.registry.base import query
from crawlatlas.schemas import COUNTERS, EXECUTION_STATES
from crawlatlas.sources.derived import (
    config_object, crawl_execution, job_execution, rowwise, seed_object,
)
from crawlatlas.sources.tables import load

_SUMS = ", ".join(f"cast(sum({c}) as bigint) AS {c}" for c in COUNTERS)
_STATES = ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s.lower()}" for s in EXECUTION_STATES)


def _state_columns(totals):
    return [F.coalesce(F.try_element_at("executions_state", F.lit(s)), F.lit(0)).alias(s.lower()) for s in EXECUTION_STATES]


@query("job_totals", f"SELECT job_execution_id, {_SUMS}, {_STATES} FROM crawl_execution GROUP BY 1")
def job_totals(spark, sf_dir):
    totals = A.job_totals(crawl_execution(spark, sf_dir))
    return totals.select("job_execution_id", *COUNTERS, *_state_columns(totals))


def deltas(spark, sf_dir):
    """Execution deltas with the state left and the state entered."""
    return with_states(rowwise(spark, sf_dir, "execution_change"))


def with_states(changes):
    old = F.when(F.col("seq") % 3 == 0, "CREATED").when(F.col("seq") % 3 == 1, "FETCHING").otherwise("UNDEFINED")
    return changes.withColumn("new_state", F.col("state")).withColumn("old_state", old)


_DELTAS = """
deltas AS (SELECT *, state AS new_state, CASE seq % 3 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'FETCHING' ELSE 'UNDEFINED' END AS old_state
  FROM execution_change),
born AS (SELECT job_execution_id, min(seq) AS born FROM deltas WHERE new_state = 'CREATED' GROUP BY 1),
live AS (SELECT d.* FROM deltas d JOIN born USING (job_execution_id) WHERE d.seq >= born)
"""
_CHANGED = [s for s in EXECUTION_STATES if s != "UNDEFINED"]
_CHANGE_SUMS = ", ".join(f"cast(sum(add_{c}) as bigint) AS {c}" for c in COUNTERS) + ", " + ", ".join(
    f"count(*) FILTER (WHERE new_state = '{s}') - count(*) FILTER (WHERE old_state = '{s}') AS {s.lower()}" for s in _CHANGED)
_RUNNING = "count(*) FILTER (WHERE new_state IN ({0})) - count(*) FILTER (WHERE old_state IN ({0})) AS running".format(
    "'CREATED', 'FETCHING', 'SLEEPING'")
JOB_CHANGES = f"WITH {_DELTAS} SELECT job_execution_id, {_CHANGE_SUMS}, {_RUNNING} FROM live GROUP BY 1"


@query("job_totals_incremental", JOB_CHANGES)
def job_totals_incremental(spark, sf_dir):
    return A.job_totals_from_changes(deltas(spark, sf_dir))


@query("job_running_count", """
SELECT job_execution_id, count(*) FILTER (WHERE state IN ('UNDEFINED', 'CREATED', 'FETCHING', 'SLEEPING')) AS running,
  count(*) AS total FROM crawl_execution GROUP BY 1""")
def job_running_count(spark, sf_dir):
    return A.job_running_count(crawl_execution(spark, sf_dir))


@query("job_finalize", """
WITH done AS (SELECT job_execution_id, cast(sum(bytes_crawled) as bigint) AS bytes_crawled FROM crawl_execution GROUP BY 1
  HAVING count(*) FILTER (WHERE state IN ('UNDEFINED', 'CREATED', 'FETCHING', 'SLEEPING') AND seed_id LIKE '%1') = 0)
SELECT j.id, CASE WHEN d.job_execution_id IS NULL OR state IN ('FAILED', 'ABORTED_MANUAL') THEN state
    ELSE coalesce(desired_state, 'FINISHED') END AS state,
  CASE WHEN d.job_execution_id IS NULL THEN end_time ELSE timestamp '2024-02-01 00:00:00' END AS end_time, bytes_crawled
FROM job_execution j LEFT JOIN done d ON d.job_execution_id = j.id""")
def job_finalize(spark, sf_dir):
    e = crawl_execution(spark, sf_dir)
    open_state = F.col("seed_id").endswith("1") | ~F.col("state").isin("UNDEFINED", "CREATED", "FETCHING", "SLEEPING")
    e = e.withColumn("state", F.when(open_state, F.col("state")).otherwise("FINISHED"))
    done = A.job_finalize(job_execution(spark, sf_dir), e, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return done.select("id", "state", "end_time", "bytes_crawled")


@query("label_keys", """
SELECT DISTINCT key FROM (SELECT 'brand' AS key FROM config_flat WHERE kind = 'seed' UNION ALL
  SELECT 'type' FROM config_flat WHERE kind = 'seed' UNION ALL
  SELECT 'size' FROM config_flat WHERE kind = 'seed' AND label_size IS NOT NULL)""")
def label_keys(spark, sf_dir):
    return A.label_keys(config_object(spark, sf_dir), "seed")


_MIME = "CASE WHEN strpos(content_type, ';') > 1 THEN split_part(content_type, ';', 1) ELSE content_type END"


@query("uri_counters", f"""
SELECT 'requests' AS counter, '' AS label, count(*) AS n FROM crawl_log UNION ALL
SELECT 'requests_failed', '', count(*) FROM crawl_log WHERE error_code <> 0 UNION ALL
SELECT 'status_code', cast(status_code as varchar), count(*) FROM crawl_log GROUP BY 2 UNION ALL
SELECT 'record_type', record_type, count(*) FROM crawl_log GROUP BY 2 UNION ALL
SELECT 'mime_type', {_MIME}, count(*) FROM crawl_log WHERE content_type <> '' GROUP BY 2""")
def uri_counters(spark, sf_dir):
    return A.uri_counters(rowwise(spark, sf_dir, "crawl_log"))


@query("fetch_time_summary", """
SELECT count(*) AS count, sum(fetch_time_ms) / 1000 AS sum_seconds FROM crawl_log WHERE fetch_time_ms > 0""")
def fetch_time_summary(spark, sf_dir):
    return A.fetch_time_summary(rowwise(spark, sf_dir, "crawl_log"))


@query("size_summary", """
SELECT count(*) AS count, cast(sum(size) as bigint) AS sum_bytes FROM crawl_log WHERE size > 0""")
def size_summary(spark, sf_dir):
    return A.size_summary(rowwise(spark, sf_dir, "crawl_log"))


@query("page_counters", """
WITH p AS (SELECT page_id,
    count(*) FILTER (WHERE idx > 0 AND resource_type = 'Script') AS outlinks,
    count(*) FILTER (WHERE idx > 0 AND has_crawl_log) AS resources,
    count(*) FILTER (WHERE idx > 0 AND has_crawl_log AND from_cache) AS cached
  FROM browser_request GROUP BY 1),
t AS (SELECT count(*) AS pages, count(*) FILTER (WHERE outlinks > 0) AS pages_with_outlinks,
    cast(sum(outlinks) as bigint) AS links_outlinks, count(*) FILTER (WHERE resources > 0) AS pages_with_resources,
    cast(sum(cached) as bigint) AS links_resources_cached,
    cast(sum(resources - cached) as bigint) AS links_resources_notcached FROM p)
UNPIVOT t ON COLUMNS(*) INTO NAME counter VALUE n""")
def page_counters(spark, sf_dir):
    return A.page_counters(pagelog.page_log_messages(rowwise(spark, sf_dir, "browser_request")))


@query("queue_total", "SELECT count(*) AS n FROM queued_uri")
def queue_total(spark, sf_dir):
    return A.queue_total(rowwise(spark, sf_dir, "queued_uri"))


@query("queue_by_execution", """
SELECT pos, id, (SELECT count(*) FROM queued_uri q WHERE q.execution_id = w.id) AS n
FROM (VALUES (0, 'ce8_0'), (1, 'none'), (2, 'ce3_1'), (3, 'ce46_1')) w(pos, id)""")
def queue_by_execution(spark, sf_dir):
    return A.queue_count_for(rowwise(spark, sf_dir, "queued_uri"), ["ce8_0", "none", "ce3_1", "ce46_1"], "execution_id")


@query("queue_by_job", """
SELECT pos, id, (SELECT count(*) FROM queued_uri q WHERE q.job_execution_id = w.id) AS n
FROM (VALUES (0, 'je7'), (1, 'je99'), (2, 'je0')) w(pos, id)""")
def queue_by_job(spark, sf_dir):
    return A.queue_count_for(rowwise(spark, sf_dir, "queued_uri"), ["je7", "je99", "je0"], "job_execution_id")


@query("queue_by_host_group", "SELECT crawl_host_group_id, count(*) AS n FROM queued_uri GROUP BY 1")
def queue_by_host_group(spark, sf_dir):
    return A.queue_count_by(rowwise(spark, sf_dir, "queued_uri"), "crawl_host_group_id")


@query("busy_host_groups", "SELECT count(DISTINCT crawl_host_group_id) AS n FROM queued_uri WHERE fetch_started")
def busy_host_groups(spark, sf_dir):
    return A.busy_host_groups(rowwise(spark, sf_dir, "queued_uri"))


@query("page_harvest_totals", """
SELECT page_id, count(*) FILTER (WHERE has_crawl_log AND warc_id <> '') AS uris,
  cast(coalesce(sum(size) FILTER (WHERE has_crawl_log AND warc_id <> ''), 0) as bigint) AS bytes,
  count(*) FILTER (WHERE has_crawl_log) AS resources FROM browser_request GROUP BY 1""")
def page_harvest_totals(spark, sf_dir):
    return A.page_harvest_totals(rowwise(spark, sf_dir, "browser_request"))


_BOUNDS = ", ".join(f"('{b}', {b})" for b in A.PAGE_FETCH_BOUNDS) + ", ('+Inf', 1e300)"


@query("page_fetch_histogram", f"""
SELECT le, (SELECT count(*) FROM queued_uri WHERE floor(page_fetch_time_ms / 1000) <= b) AS n
FROM (VALUES {_BOUNDS}) v(le, b)""")
def page_fetch_histogram(spark, sf_dir):
    return A.page_fetch_histogram(rowwise(spark, sf_dir, "queued_uri"), "page_fetch_time_ms")


@query("page_failures_by_code", "SELECT error_code, count(*) AS n FROM queued_uri WHERE error_code <> 0 GROUP BY 1")
def page_failures_by_code(spark, sf_dir):
    return A.failures_by_code(rowwise(spark, sf_dir, "queued_uri"))


@query("page_completeness", """
WITH r AS (SELECT *, got_new AND resource_type NOT IN ('Ping', 'XHR') AS blocking FROM browser_request)
SELECT page_id, count(*) FILTER (WHERE blocking) AS blocking,
  count(*) FILTER (WHERE blocking AND has_crawl_log) AS resolved,
  count(*) FILTER (WHERE blocking AND NOT has_crawl_log) AS unresolved,
  count(*) FILTER (WHERE NOT blocking) AS ignored,
  coalesce(string_agg(request_id, ',' ORDER BY idx) FILTER (WHERE blocking AND NOT has_crawl_log), '') AS missing
FROM r GROUP BY 1""")
def page_completeness(spark, sf_dir):
    rows = A.page_completeness(rowwise(spark, sf_dir, "browser_request"))
    return rows.withColumn("missing", F.concat_ws(",", "missing"))


def submissions(spark, sf_dir):
    """Out-of-scope submissions: the pages' own URLs and the redirects seen in the log."""
    p = load(spark, sf_dir, "pages").select("url")
    q = rowwise(spark, sf_dir, "queued_uri").select(F.col("uri").alias("url"))
    return U.with_site(p.unionAll(q))


_SUBMISSIONS = """submissions AS (SELECT url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM (SELECT url FROM pages UNION ALL SELECT uri FROM queued_uri))"""


@query("oos_totals", f"""WITH {_SUBMISSIONS}
SELECT count(*) AS requests, count(*) - count(DISTINCT concat(scheme, '://', host)) AS duplicates,
  count(DISTINCT concat(scheme, '://', host)) AS unique_hosts FROM submissions""")
def oos_totals(spark, sf_dir):
    return A.oos_totals(submissions(spark, sf_dir))


_SEED_KEY = """seed_key AS (SELECT id, concat(split_part(name, '://', 1), '://', lower(regexp_extract(name, '://([^/?#]*)', 1)),
  CASE WHEN regexp_extract(name, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(name, '://[^/?#]*([^?#]*)', 1) END,
  regexp_extract(name, '(\\?[^#]*)', 1)) AS key FROM seed)"""


def seed_pairs(spark, sf_dir):
    return rowwise(spark, sf_dir, "seed").select(U.url_key(F.col("name")).alias("key"), "id")


@query("duplicate_keys", f"""WITH {_SEED_KEY}
SELECT key, id, count(*) OVER (PARTITION BY key) AS n_ids FROM seed_key QUALIFY n_ids >= 2""")
def duplicate_keys(spark, sf_dir):
    return A.duplicate_keys(seed_pairs(spark, sf_dir))


@query("duplicate_totals", f"""WITH {_SEED_KEY}
SELECT count(*) AS keys, cast(coalesce(sum(n), 0) as bigint) AS ids
FROM (SELECT key, count(DISTINCT id) AS n FROM seed_key GROUP BY 1) WHERE n >= 2""")
def duplicate_totals(spark, sf_dir):
    return A.duplicate_totals(seed_pairs(spark, sf_dir))


@query("duplicate_seeds", """
WITH k AS (SELECT id, name, description, entity_id, concat('//', lower(regexp_extract(name, '://([^/?#]*)', 1)), '/') AS key FROM seed)
SELECT key, k.id AS seed_id, k.name AS uri, k.description AS seed_description, k.entity_id,
  e.name AS entity_name, e.description AS entity_description
FROM k LEFT JOIN entity e ON e.id = k.entity_id
QUALIFY count(*) OVER (PARTITION BY key) >= 2""")
def duplicate_seeds(spark, sf_dir):
    from crawlatlas.operators.joins import duplicate_seed_report
    return duplicate_seed_report(seed_object(spark, sf_dir), rowwise(spark, sf_dir, "entity"),
                                 top_level=True, ignore_scheme=True)


@query("job_state_gauges", f"""
WITH latest AS (SELECT * FROM crawl_execution WHERE start_time IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC, id DESC) = 1),
t AS (SELECT l.job_id, {", ".join(f"cast(sum(e.{c}) as bigint) AS {c}" for c in A.GAUGE_SIZES)},
  {", ".join(f"count(*) FILTER (WHERE e.state = '{s}') AS {s}" for s in A.GAUGE_STATES)}
  FROM latest l JOIN crawl_execution e ON e.job_execution_id = l.job_execution_id GROUP BY 1)
SELECT job_id, gauge, value FROM (UNPIVOT t ON COLUMNS(* EXCLUDE job_id) INTO NAME gauge VALUE value)""")
def job_state_gauges(spark, sf_dir):
    e = crawl_execution(spark, sf_dir)
    latest = A.latest_per_job(e).select("job_id", F.col("job_execution_id").alias("id"))
    return A.job_state_gauges(latest, A.job_totals(e))


@query("remaining_seeds", """
SELECT job_id, count(*) FILTER (WHERE state IN ('FETCHING', 'SLEEPING', 'CREATED')) AS remaining FROM crawl_execution GROUP BY 1""")
def remaining_seeds(spark, sf_dir):
    return A.remaining_seeds(crawl_execution(spark, sf_dir))


@query("warc_file_index", """
SELECT split_part(storage_ref, ':', 2) AS file, count(*) AS records, cast(sum(size) as bigint) AS bytes,
  min(cast(split_part(storage_ref, ':', 3) as bigint)) AS first_offset,
  max(cast(split_part(storage_ref, ':', 3) as bigint)) AS last_offset,
  string_agg(DISTINCT record_type, ',' ORDER BY record_type) AS record_types
FROM crawl_log GROUP BY 1""")
def warc_file_index(spark, sf_dir):
    return A.warc_file_index(rowwise(spark, sf_dir, "crawl_log"))


@query("crawler_status", """
SELECT count(*) AS queue_size, count(DISTINCT crawl_host_group_id) FILTER (WHERE fetch_started) AS busy_groups,
  CASE WHEN count(*) FILTER (WHERE fetch_started) > 0 THEN 'PAUSE_REQUESTED' ELSE 'PAUSED' END AS run_status FROM queued_uri""")
def crawler_status(spark, sf_dir):
    return A.crawler_status(rowwise(spark, sf_dir, "queued_uri"), pause_wanted=True)


@query("common_labels", """
WITH chosen AS (SELECT * FROM config_flat WHERE label_brand = 'Brand#3'),
l AS (SELECT id, 'Brand' AS key, label_brand AS value FROM chosen UNION ALL SELECT id, 'type', label_type FROM chosen
  UNION ALL SELECT id, 'size', label_size FROM chosen WHERE label_size IS NOT NULL)
SELECT key, value FROM l GROUP BY ALL HAVING count(DISTINCT id) = (SELECT count(*) FROM chosen)""")
def common_labels(spark, sf_dir):
    chosen = config_object(spark, sf_dir).where(F.exists("meta.label", lambda e: e["value"] == "Brand#3"))
    return A.common_labels(chosen)


@query("recent_window_stats", """
WITH l AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'page' ELSE 'crawl' END AS log_type, event_id, length(props) + 10 AS bytes,
    row_number() OVER (PARTITION BY CASE WHEN event_id % 4 = 0 THEN 'page' ELSE 'crawl' END ORDER BY event_id DESC) AS rn FROM events)
SELECT log_type, count(*) FILTER (WHERE rn <= 500) AS kept, count(*) FILTER (WHERE rn > 500) AS evicted,
  cast(sum(bytes) FILTER (WHERE rn <= 500) as bigint) AS payload_bytes FROM l GROUP BY 1""")
def recent_window_stats(spark, sf_dir):
    from crawlatlas.operators.recent import window_stats
    from crawlatlas.registry.ordering import recent_rows
    return window_stats(recent_rows(spark, sf_dir), 500, 500)
