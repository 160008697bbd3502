"""Queries over projections and array updates."""

from pyspark.sql import functions as F

from crawlatlas.operators import projection as P
from crawlatlas.registry.base import query
from crawlatlas.sources.derived import config_object, rowwise


@query("mask_project", """
SELECT 'v1' AS apiVersion, kind, id, name AS meta_name,
  concat_ws(',', 'Brand', 'type', CASE WHEN label_size IS NOT NULL THEN 'size' END) AS label_keys
FROM config_flat""")
def mask_project(spark, sf_dir):
    rows = P.mask_project(config_object(spark, sf_dir), ["meta.name", "meta.label", "meta.label.key"])
    return rows.select("apiVersion", "kind", "id", F.col("meta.name").alias("meta_name"),
                       F.concat_ws(",", F.col("meta.label.key")).alias("label_keys"))


@query("flatten_error", """
SELECT warc_id, error_code, error_msg, error_detail FROM crawl_log""")
def flatten_error(spark, sf_dir):
    logs = rowwise(spark, sf_dir, "crawl_log")
    nested = logs.select("warc_id", F.when(F.col("error_code") != 0, F.struct(
        F.col("error_code").alias("code"), F.col("error_msg").alias("msg"),
        F.col("error_detail").alias("detail"))).alias("error"))
    return P.flatten_error(nested)


@query("flatten_state_map", """
SELECT job_execution_id, state, count(*) AS n FROM crawl_execution GROUP BY ALL""")
def flatten_state_map(spark, sf_dir):
    from crawlatlas.sources.derived import crawl_execution
    counts = crawl_execution(spark, sf_dir).groupBy("job_execution_id", "state").agg(F.count("*").alias("n"))
    stored = counts.groupBy("job_execution_id").agg(
        F.collect_list(F.create_map("state", "n")).alias("stored"))  # one entry per state of a fixed enum
    return stored.select("job_execution_id", F.explode(P.flatten_state_map(F.col("stored"))).alias("state", "n"))


@query("drop_field", """
SELECT id, name AS meta_name, 0 AS has_description FROM config_flat""")
def drop_field(spark, sf_dir):
    rows = P.drop_field(config_object(spark, sf_dir), "meta.description")
    has = "description" in rows.schema["meta"].dataType.fieldNames()
    return rows.select("id", F.col("meta.name").alias("meta_name"), F.lit(int(has)).alias("has_description"))


@query("annotations_to_map", """
SELECT id, 'a' AS key, cast(size + 1 as varchar) AS value FROM config_flat UNION ALL
SELECT id, 'b', name FROM config_flat""")
def annotations_to_map(spark, sf_dir):
    def pair(k, v):
        return F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))

    rows = rowwise(spark, sf_dir, "config_flat").select("id", F.array(
        pair("a", F.col("size")), pair("b", F.col("name")), pair("a", F.col("size") + 1)).alias("annotation"))
    return rows.select("id", F.explode(P.annotations_to_map(F.col("annotation"))).alias("key", "value"))


@query("rejected_crawl_log", """
SELECT id AS warc_id, execution_id, job_execution_id, error_code AS status_code, 'response' AS record_type,
  uri AS requested_uri, discovery_path, referrer, retries, error_code, 1710000000000 AS time_stamp
FROM queued_uri WHERE error_code <> 0""")
def rejected_crawl_log(spark, sf_dir):
    failed = rowwise(spark, sf_dir, "queued_uri").where(F.col("error_code") != 0)
    return P.crawl_log_rows(failed, 1_710_000_000_000)


@query("page_log_from_events", """
SELECT page_id, max(url) FILTER (WHERE idx = 0) AS uri, max(method) FILTER (WHERE idx = 0) AS method,
  count(*) FILTER (WHERE idx > 0 AND has_crawl_log) AS n_resources,
  string_agg(url, ' ' ORDER BY seq) FILTER (WHERE idx > 0 AND has_crawl_log) AS resources,
  string_agg(url, ' ' ORDER BY seq) FILTER (WHERE resource_type = 'Script' AND idx > 0) AS outlinks
FROM browser_request GROUP BY page_id""")
def page_log_from_events(spark, sf_dir):
    from crawlatlas.operators.pagelog import page_log_messages, assemble_page_logs
    logs = assemble_page_logs(page_log_messages(rowwise(spark, sf_dir, "browser_request")))
    blank = F.lit(None).cast("string")
    return logs.select(
        "page_id", "uri", "method", F.size("resource").cast("bigint").alias("n_resources"),
        F.when(F.size("resource") > 0, F.concat_ws(" ", "resource.uri")).otherwise(blank).alias("resources"),
        F.when(F.size("outlink") > 0, F.concat_ws(" ", "outlink")).otherwise(blank).alias("outlinks"))


@query("array_append_set", """
SELECT id, cast(CASE WHEN label_brand = 'Brand#1' THEN 2 ELSE 3 END
  + CASE WHEN label_size IS NOT NULL THEN 1 ELSE 0 END as bigint) AS n FROM config_flat""")
def array_append_set(spark, sf_dir):
    from crawlatlas.operators.updates import append_set
    added = F.array(F.struct(F.lit("Brand").alias("key"), F.lit("Brand#1").alias("value")))
    rows = config_object(spark, sf_dir)
    return rows.select("id", F.size(append_set(F.col("meta.label"), added)).cast("bigint").alias("n"))


@query("array_remove_set", """
SELECT id, cast(CASE WHEN label_type = 'ECONOMY' THEN 1 ELSE 2 END
  + CASE WHEN label_size IS NOT NULL THEN 1 ELSE 0 END as bigint) AS n FROM config_flat""")
def array_remove_set(spark, sf_dir):
    from crawlatlas.operators.updates import remove_set
    gone = F.array(F.struct(F.lit("type").alias("key"), F.lit("ECONOMY").alias("value")))
    rows = config_object(spark, sf_dir)
    return rows.select("id", F.size(remove_set(F.col("meta.label"), gone)).cast("bigint").alias("n"))


@query("array_concat", """
SELECT id, concat_ws(',', job_a, job_b, entity_id) AS refs FROM seed""")
def array_concat(spark, sf_dir):
    from crawlatlas.operators.joins import refs_of_seed
    from crawlatlas.sources.derived import seed_object
    rows = seed_object(spark, sf_dir).select("id", refs_of_seed().alias("ref"))
    return rows.select("id", F.concat_ws(",", F.col("ref.id")).alias("refs"))


@query("distinct_rows", """
SELECT DISTINCT execution_id, job_execution_id, crawl_host_group_id FROM queued_uri""")
def distinct_rows(spark, sf_dir):
    return rowwise(spark, sf_dir, "queued_uri").select(
        "execution_id", "job_execution_id", "crawl_host_group_id").distinct()
