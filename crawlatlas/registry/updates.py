"""Queries over table rewrites."""

from pyspark.sql import functions as F

from crawlatlas.operators import joins as J
from crawlatlas.operators import rollups as A
from crawlatlas.operators import updates as U
from crawlatlas.registry.base import query
from crawlatlas.registry.joins import _HOST_GROUP, _SHA, ip_ranges
from crawlatlas.schemas import COUNTERS
from crawlatlas.sources.derived import (
    config_object, crawl_execution, job_execution, rowwise,
)
from crawlatlas.sources.tables import load


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


@query("upsert_config", """
WITH n AS (SELECT id, kind, CASE WHEN size % 2 = 0 THEN '' ELSE concat('new ', name) END AS name, created FROM config_flat WHERE size % 10 = 0
  UNION ALL SELECT concat('x', id), kind, concat('new ', name), created FROM config_flat WHERE size % 10 = 1)
SELECT coalesce(n.id, o.id) AS id, coalesce(nullif(n.name, ''), o.name) AS name,
  CASE WHEN o.id IS NULL THEN timestamp '2024-03-01 00:00:00' ELSE o.created END AS created,
  CASE WHEN o.id IS NULL THEN 'ann' ELSE 'importer' END AS created_by,
  CASE WHEN n.id IS NULL THEN o.created ELSE timestamp '2024-03-01 00:00:00' END AS modified,
  CASE WHEN n.id IS NULL THEN 'importer' ELSE 'ann' END AS modified_by
FROM config_flat o FULL JOIN n ON n.id = o.id""")
def upsert_config(spark, sf_dir):
    stored = config_object(spark, sf_dir)
    size = F.element_at("meta.annotation", 1)["value"].cast("int")
    renamed = F.concat(F.lit("new "), F.col("meta.name"))
    changed = stored.where(size % 10 == 0).withColumn("meta", F.struct(
        F.when(size % 2 == 0, "").otherwise(renamed).alias("name"), F.col("meta.description").alias("description")))
    added = stored.where(size % 10 == 1).withColumn("id", F.concat(F.lit("x"), "id")).withColumn("meta", F.struct(
        renamed.alias("name"), F.col("meta.description").alias("description")))
    rows = U.upsert_config(stored, changed.unionByName(added), "ann", _at("2024-03-01 00:00:00"))
    return rows.selectExpr("id", "meta.name AS name", "meta.created AS created", "meta.createdBy AS created_by",
                           "meta.lastModified AS modified", "meta.lastModifiedBy AS modified_by")


@query("derive_kind", """
SELECT id, CASE WHEN size % 4 = 0 AND kind = 'browserScript' THEN NULL WHEN size % 4 = 1 AND kind = 'seed' THEN 'crawlJob' ELSE kind END AS kind,
  CASE WHEN size % 13 = 0 THEN 'missing apiVersion' WHEN size % 4 = 0 AND kind = 'browserScript' THEN 'missing kind'
  WHEN size % 4 = 1 AND kind = 'seed' THEN 'kind mismatch' ELSE '' END AS reason FROM config_flat""")
def derive_kind(spark, sf_dir):
    size = F.element_at("meta.annotation", 1)["value"].cast("int")
    rows = config_object(spark, sf_dir)
    blurred = rows.withColumn("apiVersion", F.when(size % 13 == 0, "").otherwise(F.col("apiVersion"))).withColumn(
        "kind", F.when(size % 4 == 0, "").when((size % 4 == 1) & (F.col("kind") == "seed"), "crawlJob").otherwise(F.col("kind")))
    return U.derive_kind(blurred).select("id", "kind", "reason")


@query("masked_update", """
SELECT id, name, CASE WHEN kind = 'crawlJob' THEN NULL ELSE description END AS description,
  CASE WHEN kind <> 'crawlJob' THEN false ELSE true END AS updated,
  cast(1 + CASE WHEN kind = 'crawlJob' THEN 1 ELSE 0 END + CASE WHEN kind = 'crawlJob' AND label_type = 'ECONOMY' THEN 0 ELSE 1 END
    + CASE WHEN label_size IS NOT NULL THEN 1 ELSE 0 END as bigint) AS labels,
  CASE WHEN kind = 'crawlJob' THEN 'ann' ELSE 'importer' END AS modified_by FROM config_flat""")
def masked_update(spark, sf_dir):
    template = {"meta": {"label": [{"key": "big", "value": "bang"}], "name": "ignored"}}
    first = U.masked_update(config_object(spark, sf_dir), F.col("kind") == "crawlJob", template,
                            ["meta.label+", "meta.description", "meta.created"], "ann", _at("2024-03-01 00:00:00"))
    gone = {"meta": {"label": [{"key": "type", "value": "ECONOMY"}]}}
    rows = U.masked_update(first.withColumnRenamed("updated", "_first"), F.col("kind") == "crawlJob", gone,
                           ["meta.label-"], "ann", _at("2024-03-01 00:00:00"))
    return rows.select("id", F.col("meta.name").alias("name"), F.col("meta.description").alias("description"),
                       (F.col("updated") | F.col("_first")).alias("updated"),
                       F.size("meta.label").cast("bigint").alias("labels"), F.col("meta.lastModifiedBy").alias("modified_by"))


_ADDED = ", ".join(f"cast(e.{c} + coalesce(d.{c}, 0) as bigint) AS {c}" for c in COUNTERS)


@query("apply_counters", f"""
WITH d AS (SELECT execution_id, {", ".join(f"sum(add_{c}) AS {c}" for c in COUNTERS)} FROM execution_change GROUP BY 1)
SELECT e.id, {_ADDED} FROM crawl_execution e LEFT JOIN d ON d.execution_id = e.id""")
def apply_counters(spark, sf_dir):
    changes = rowwise(spark, sf_dir, "execution_change")
    return U.apply_counters(crawl_execution(spark, sf_dir), changes).select("id", *COUNTERS)


@query("merge_job_status", """
SELECT id, CASE WHEN end_time IS NOT NULL THEN state ELSE 'DIED' END AS state,
  CASE WHEN end_time IS NOT NULL THEN end_time ELSE timestamp '2024-03-01 00:00:00' END AS end_time FROM job_execution""")
def merge_job_status(spark, sf_dir):
    jobs = job_execution(spark, sf_dir)
    saved = jobs.withColumn("state", F.lit("DIED")).withColumn("end_time", _at("2024-03-01 00:00:00"))
    return U.merge_job_status(jobs, saved).select("id", "state", "end_time")


@query("abort_job", """
SELECT id, CASE WHEN id = 'je3' AND end_time IS NULL THEN 'ABORTED_MANUAL' ELSE desired_state END AS desired_state, 'job' AS target FROM job_execution
UNION ALL SELECT id, CASE WHEN job_execution_id = 'je3' AND end_time IS NULL THEN 'ABORTED_MANUAL' ELSE desired_state END, 'execution' FROM crawl_execution""")
def abort_job(spark, sf_dir):
    jobs, executions = U.abort_job(job_execution(spark, sf_dir), crawl_execution(spark, sf_dir), "je3")
    return jobs.select("id", "desired_state", F.lit("job").alias("target")).unionAll(
        executions.select("id", "desired_state", F.lit("execution").alias("target")))


@query("fail_if_empty", """
WITH jobs AS (SELECT id, state, end_time FROM job_execution
  UNION ALL SELECT concat('jn', n_nationkey), CASE n_regionkey WHEN 0 THEN 'CREATED' ELSE 'RUNNING' END, NULL FROM nation),
j AS (SELECT *, state = 'RUNNING' AND end_time IS NULL AND id NOT IN (SELECT job_execution_id FROM crawl_execution) AS empty FROM jobs)
SELECT id, CASE WHEN empty THEN 'FAILED' ELSE state END AS state, CASE WHEN empty THEN timestamp '2024-03-01 00:00:00' ELSE end_time END AS end_time,
  CASE WHEN empty THEN 'no seeds' ELSE concat('was ', id) END AS error_msg FROM j""")
def fail_if_empty(spark, sf_dir):
    waiting = load(spark, sf_dir, "nation").select(
        F.concat(F.lit("jn"), "n_nationkey").alias("id"),
        F.when(F.col("n_regionkey") == 0, "CREATED").otherwise("RUNNING").alias("state"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"))
    jobs = job_execution(spark, sf_dir).select("id", "state", "end_time").unionByName(waiting)
    jobs = jobs.withColumn("error_msg", F.concat(F.lit("was "), "id"))
    return U.fail_if_empty(jobs, crawl_execution(spark, sf_dir), "no seeds", _at("2024-03-01 00:00:00")).select(
        "id", "state", "end_time", "error_msg")


@query("new_execution", """
SELECT concat(j.id, '-', s.id) AS id, 'CREATED' AS state, j.job_id, s.id AS seed_id, desired_state, timestamp '2024-03-01 00:00:00' AS created_time
FROM job_execution j JOIN seed s ON s.job_a = j.job_id""")
def new_execution(spark, sf_dir):
    jobs = job_execution(spark, sf_dir)
    pairs = rowwise(spark, sf_dir, "seed").select(F.col("id").alias("seed_id"), F.col("job_a").alias("job_id")).join(
        jobs.select("job_id", F.col("id").alias("job_execution_id")), "job_id").drop("job_id")
    return U.new_executions(pairs, jobs, _at("2024-03-01 00:00:00")).select(
        "id", "state", "job_id", "seed_id", "desired_state", "created_time")


@query("purge_queue", """
WITH gone AS (SELECT id FROM crawl_execution WHERE state = 'FINISHED'),
q AS (SELECT q.*, g.id IS NOT NULL AS hit FROM queued_uri q LEFT JOIN gone g ON g.id = q.execution_id)
SELECT execution_id, count(*) FILTER (WHERE hit AND NOT fetch_started) AS deleted, count(*) FILTER (WHERE hit AND fetch_started) AS kept,
  count(*) FILTER (WHERE NOT hit OR fetch_started) AS remaining FROM q GROUP BY 1""")
def purge_queue(spark, sf_dir):
    finished = crawl_execution(spark, sf_dir).where("state = 'FINISHED'")
    left, report = U.purge_queue(rowwise(spark, sf_dir, "queued_uri"), finished, keep_active=True)
    remaining = left.groupBy("execution_id").agg(F.count("*").alias("remaining"))
    return remaining.join(report, "execution_id", "full_outer").select("execution_id", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("deleted", "kept", "remaining")])


@query("move_host_group", f"""WITH {_HOST_GROUP},
m AS (SELECT q.id, q.crawl_host_group_id AS old, CASE WHEN q.ip IS NULL THEN concat('TEMP_CHG_', {_SHA.format('host')})
  ELSE coalesce(g.config_id, {_SHA.format('q.ip')}) END AS new FROM queued_uri q LEFT JOIN grp g ON g.ip = q.ip)
SELECT new AS crawl_host_group_id, count(*) AS n, count(*) FILTER (WHERE new <> old) AS moved FROM m GROUP BY 1""")
def move_host_group(spark, sf_dir):
    queue = rowwise(spark, sf_dir, "queued_uri")
    moved = U.move_host_group(queue, J.host_groups(queue, ip_ranges(spark, sf_dir)))
    return moved.groupBy("crawl_host_group_id").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"))


@query("clear_reached_desired", """
SELECT id, state, CASE WHEN state <> desired_state THEN desired_state END AS desired_state FROM crawl_execution""")
def clear_reached_desired(spark, sf_dir):
    return U.clear_reached_desired(crawl_execution(spark, sf_dir)).select("id", "state", "desired_state")


@query("inactive_job_guard", """
WITH t AS (SELECT job_execution_id, cast(sum(bytes_crawled) as bigint) AS bytes_crawled FROM crawl_execution GROUP BY 1)
SELECT j.id, state, CASE WHEN state IN ('RUNNING', 'CREATED', 'UNDEFINED') THEN t.bytes_crawled ELSE 7 END AS bytes_crawled
FROM job_execution j LEFT JOIN t ON t.job_execution_id = j.id""")
def inactive_job_guard(spark, sf_dir):
    jobs = job_execution(spark, sf_dir).select("*", *[F.lit(7).cast("bigint").alias(c) for c in COUNTERS])
    return U.roll_into_open_jobs(jobs, A.job_totals(crawl_execution(spark, sf_dir))).select("id", "state", "bytes_crawled")


@query("event_diff", """
WITH n AS (SELECT id, CASE WHEN size % 5 = 0 THEN concat(name, '!') ELSE name END AS name, size, label_brand, label_type, label_size FROM config_flat
  UNION ALL SELECT concat('y', id), name, size, label_brand, label_type, label_size FROM config_flat WHERE size % 9 = 0)
SELECT n.id, 'CREATED' AS type, '' AS field FROM n WHERE id LIKE 'y%'
UNION ALL SELECT n.id, 'CHANGED', 'meta.name' FROM n WHERE size % 5 = 0 AND id NOT LIKE 'y%'
UNION ALL SELECT id, 'ARRAY_ADD', 'meta.label' FROM config_flat WHERE size % 7 = 0
UNION ALL SELECT id, 'ARRAY_DELETE', 'meta.label' FROM config_flat WHERE size % 7 = 0 AND label_type = 'ECONOMY'""")
def event_diff(spark, sf_dir):
    old = config_object(spark, sf_dir).select("id", F.struct("meta.name", "meta.label").alias("meta"))
    size = F.element_at("meta.annotation", 1)["value"].cast("int")
    added = F.array(F.struct(F.lit("big").alias("key"), F.lit("bang").alias("value")))
    gone = F.array(F.struct(F.lit("type").alias("key"), F.lit("ECONOMY").alias("value")))
    label = F.when(size % 7 == 0, U.remove_set(U.append_set(F.col("meta.label"), added), gone)).otherwise(F.col("meta.label"))
    name = F.when(size % 5 == 0, F.concat("meta.name", F.lit("!"))).otherwise(F.col("meta.name"))
    full = config_object(spark, sf_dir)
    new = full.select("id", F.struct(name.alias("name"), label.alias("label")).alias("meta")).unionByName(
        full.where(size % 9 == 0).select(F.concat(F.lit("y"), "id").alias("id"), F.struct("meta.name", "meta.label").alias("meta")))
    return U.event_diff(old, new).select("id", "type", "field")


_ABORT = "desired_state IN ('ABORTED_TIMEOUT', 'ABORTED_SIZE', 'ABORTED_MANUAL')"
_ENDED = "state IN ('FINISHED', 'ABORTED_TIMEOUT', 'ABORTED_SIZE', 'ABORTED_MANUAL', 'FAILED', 'DIED')"


@query("reconcile_executions", f"""
WITH q AS (SELECT execution_id, count(*) AS n, count(*) FILTER (WHERE fetch_started) AS active FROM queued_uri GROUP BY 1),
a AS (SELECT e.id, desired_state, CASE WHEN {_ENDED} THEN 'PURGE_AND_REPAIR_JOB' WHEN {_ABORT} AND active > 0 THEN 'PURGE_PENDING_AND_WAIT'
  WHEN {_ABORT} THEN 'PURGE_AND_END' WHEN coalesce(n, 0) = 0 THEN 'FINISH' ELSE 'NONE' END AS action
  FROM crawl_execution e LEFT JOIN q ON q.execution_id = e.id)
SELECT id, action, CASE action WHEN 'PURGE_AND_END' THEN desired_state WHEN 'FINISH' THEN 'FINISHED' END AS end_state FROM a""")
def reconcile_executions(spark, sf_dir):
    return U.reconcile_executions(crawl_execution(spark, sf_dir), rowwise(spark, sf_dir, "queued_uri")).select("id", "action", "end_state")


@query("anti_entropy", f"""
SELECT e.id, count(*) AS queued FROM crawl_execution e JOIN queued_uri q ON q.execution_id = e.id WHERE {_ENDED} OR {_ABORT} GROUP BY 1""")
def anti_entropy(spark, sf_dir):
    return U.anti_entropy(crawl_execution(spark, sf_dir), rowwise(spark, sf_dir, "queued_uri")).select("id", "queued")
