"""Queries over per-group order: windows, queue order, first sight and revisits."""

from pyspark.sql import functions as F

from crawlatlas.functions import urls as U
from crawlatlas.operators import frontier as Q
from crawlatlas.operators import recent as W
from crawlatlas.operators import rollups as A
from crawlatlas.registry.base import query
from crawlatlas.registry.rollups import _SUBMISSIONS, submissions
from crawlatlas.sources.derived import job_execution, rowwise
from crawlatlas.sources.tables import load


@query("latest_per_job", """
SELECT job_id, id, state FROM job_execution QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC, id DESC) = 1""")
def latest_per_job(spark, sf_dir):
    return A.latest_per_job(job_execution(spark, sf_dir)).select("job_id", "id", "state")


def recent_rows(spark, sf_dir, events=None):
    """Ingested logs: page logs and crawl logs, some rewritten, some without a warc id."""
    e = F.col("event_id")
    return (load(spark, sf_dir, "events") if events is None else events).select(
        F.when(e % 4 == 0, "page").otherwise("crawl").alias("log_type"),
        F.when(e % 13 == 0, "").otherwise(F.concat(F.lit("w"), e % 3000)).alias("warc_id"),
        F.concat(F.lit("ce"), "user_id", F.lit("_"), e % 10).alias("execution_id"),
        e.alias("ingestion_seq"),
        F.concat(F.lit("log entry "), "props").alias("payload"))


_RECENT = """recent AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'page' ELSE 'crawl' END AS log_type,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('w', event_id % 3000) END AS warc_id,
  concat('ce', user_id, '_', event_id % 10) AS execution_id, event_id AS ingestion_seq FROM events)"""


@query("recent_replace", f"""WITH {_RECENT}
SELECT log_type, warc_id, max(ingestion_seq) AS ingestion_seq FROM recent WHERE warc_id <> '' GROUP BY 1, 2
UNION ALL SELECT log_type, warc_id, ingestion_seq FROM recent WHERE warc_id = ''""")
def recent_replace(spark, sf_dir):
    return W.replace_rewritten(recent_rows(spark, sf_dir)).select("log_type", "warc_id", "ingestion_seq")


@query("recent_retain", f"""WITH {_RECENT}
SELECT log_type, warc_id, ingestion_seq FROM recent
QUALIFY row_number() OVER (PARTITION BY log_type ORDER BY ingestion_seq DESC) <= CASE WHEN log_type = 'crawl' THEN 1000 ELSE 250 END""")
def recent_retain(spark, sf_dir):
    return W.retain(recent_rows(spark, sf_dir), 1000, 250).select("log_type", "warc_id", "ingestion_seq")


@query("recent_by_execution", f"""WITH {_RECENT}
SELECT log_type, warc_id, ingestion_seq FROM recent WHERE execution_id = 'ce8_0' ORDER BY ingestion_seq DESC LIMIT 4 OFFSET 2""")
def recent_by_execution(spark, sf_dir):
    return W.by_execution(recent_rows(spark, sf_dir), "ce8_0", 2, 4).select("log_type", "warc_id", "ingestion_seq")


@query("revisit_mark", """
WITH k AS (SELECT *, CASE WHEN record_type IN ('response', 'resource') THEN coalesce(nullif(digest, ''), nullif(block_digest, '')) END AS key FROM crawled),
m AS (SELECT *, first_value(record_id) OVER (PARTITION BY collection, key ORDER BY seq) AS first_id FROM k)
SELECT record_id, collection, key IS NOT NULL AND first_id <> record_id AS is_revisit,
  CASE WHEN key IS NOT NULL AND first_id <> record_id THEN first_id END AS refers_to FROM m""")
def revisit_mark(spark, sf_dir):
    return Q.revisit_mark(rowwise(spark, sf_dir, "crawled"), ["seq"]).select(
        "record_id", "collection", "is_revisit", "refers_to")


_PICK = """
w AS (SELECT crawl_host_group_id, execution_id, max(priority_weight + CASE WHEN discovery_path = '' THEN 100 ELSE 0 END) AS weight
  FROM queued_uri GROUP BY 1, 2),
d AS (SELECT *, max(weight) OVER (PARTITION BY crawl_host_group_id) AS top,
    cast(concat('0x', substring(sha1(concat('s1|', crawl_host_group_id)), 1, 8)) as bigint) / 4294967296 AS share,
    cast(concat('0x', substring(sha1(concat('s1|', crawl_host_group_id, '|', execution_id)), 1, 8)) as bigint) / 4294967296 AS draw FROM w),
picked AS (SELECT crawl_host_group_id, execution_id, weight FROM d WHERE weight >= share * top
  QUALIFY row_number() OVER (PARTITION BY crawl_host_group_id ORDER BY draw, execution_id) = 1)"""


@query("weighted_execution_pick", f"WITH {_PICK} SELECT * FROM picked")
def weighted_execution_pick(spark, sf_dir):
    return Q.weighted_execution_pick(rowwise(spark, sf_dir, "queued_uri"), "s1")


@query("next_uri_per_host_group", f"""WITH {_PICK}
SELECT q.crawl_host_group_id, q.execution_id, id, sequence, earliest_fetch <= 1705000000000 AS due,
  CASE WHEN earliest_fetch > 1705000000000 THEN earliest_fetch END AS due_at
FROM queued_uri q JOIN picked p ON p.crawl_host_group_id = q.crawl_host_group_id AND p.execution_id = q.execution_id
QUALIFY row_number() OVER (PARTITION BY q.crawl_host_group_id ORDER BY sequence, earliest_fetch, id) = 1""")
def next_uri_per_host_group(spark, sf_dir):
    queue = rowwise(spark, sf_dir, "queued_uri")
    return Q.next_uri(queue, Q.weighted_execution_pick(queue, "s1"), 1_705_000_000_000).select(
        "crawl_host_group_id", "execution_id", "id", "sequence", "due", "due_at")


_DELAY = "least(greatest(page_fetch_time_ms, 5000), 30000)"


@query("politeness_slots", f"""
SELECT id, crawl_host_group_id, cast(coalesce(sum({_DELAY}) OVER (PARTITION BY crawl_host_group_id ORDER BY sequence, earliest_fetch, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as bigint) AS start_offset_ms FROM queued_uri""")
def politeness_slots(spark, sf_dir):
    queue = rowwise(spark, sf_dir, "queued_uri").withColumn("delay_ms", Q.politeness_delay(
        F.col("page_fetch_time_ms"), F.lit(1.0), F.lit(5000), F.lit(30000)))
    return Q.politeness_slots(queue).select("id", "crawl_host_group_id", "start_offset_ms")


@query("already_seen", """
SELECT id, job_execution_id, uri FROM queued_uri
QUALIFY row_number() OVER (PARTITION BY job_execution_id, uri ORDER BY cast(substring(id, 2) as bigint)) = 1""")
def already_seen(spark, sf_dir):
    uris = rowwise(spark, sf_dir, "queued_uri").select(
        "id", "job_execution_id", "uri", U.uri_hash(F.col("uri")).alias("uri_hash"),
        F.substring("id", 2, 20).cast("bigint").alias("pos"))
    return Q.already_seen(uris, "pos").select("id", "job_execution_id", "uri")


@query("oos_new_hosts", f"""WITH {_SUBMISSIONS}
SELECT DISTINCT scheme, host FROM submissions WHERE (scheme, host) NOT IN
  (SELECT ('http', concat('h', n_nationkey, '.example.com')) FROM nation)""")
def oos_new_hosts(spark, sf_dir):
    existing = load(spark, sf_dir, "nation").select(
        F.lit("http").alias("scheme"), F.concat(F.lit("h"), "n_nationkey", F.lit(".example.com")).alias("host"))
    return Q.oos_new_hosts(submissions(spark, sf_dir), existing)
