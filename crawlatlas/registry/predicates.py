"""Queries over filters, ordering and limits."""

from pyspark.sql import functions as F

from crawlatlas.functions import labels as L
from crawlatlas.operators import listing as R
from crawlatlas.operators import selection as S
from crawlatlas.operators.ordered import sorted_numbers
from crawlatlas.registry.base import query
from crawlatlas.sources.derived import (
    config_object, crawl_execution, job_execution, rowwise, seed_object,
)
from crawlatlas.sources.tables import load

CONFIG_COLUMNS = ["id", "kind", "meta.name AS name"]


@query("list_by_id", """
SELECT id, kind, name FROM config_flat WHERE id IN (SELECT concat('part', l_partkey) FROM lineitem WHERE l_quantity = 7)
""")
def list_by_id(spark, sf_dir):
    ids = load(spark, sf_dir, "lineitem").where("l_quantity = 7").select(
        F.concat(F.lit("part"), "l_partkey").alias("id"))
    return R.with_ids(config_object(spark, sf_dir), ids).selectExpr(*CONFIG_COLUMNS)


@query("list_by_kind", "SELECT id, kind, name FROM config_flat WHERE kind = 'crawlJob'")
def list_by_kind(spark, sf_dir):
    return R.list_rows(config_object(spark, sf_dir), R.ListRequest(kind="crawlJob")).selectExpr(*CONFIG_COLUMNS)


@query("list_by_state", "SELECT id, state, job_id FROM crawl_execution WHERE state IN ('FINISHED', 'FAILED')")
def list_by_state(spark, sf_dir):
    rows = R.list_rows(crawl_execution(spark, sf_dir), R.ListRequest(states=["FINISHED", "FAILED"]))
    return rows.select("id", "state", "job_id")


@query("template_eq", """
SELECT id, kind, name FROM config_flat
WHERE kind = 'crawlJob' AND coalesce(disabled, false) = false AND coalesce(description, '') = ''""")
def template_eq(spark, sf_dir):
    request = R.ListRequest(
        template={"kind": "crawlJob", "crawlJob": {"disabled": False}},
        template_mask=["kind", "crawlJob.disabled", "meta.description"])
    return R.list_rows(config_object(spark, sf_dir), request).selectExpr(*CONFIG_COLUMNS)


@query("template_message_eq", """
SELECT id, kind, name FROM config_flat WHERE kind = 'crawlJob' AND size % 5 = 2""")
def template_message_eq(spark, sf_dir):
    request = R.ListRequest(
        template={"crawlJob": {"scheduleRef": {"kind": "crawlScheduleConfig", "id": "sch2"}}},
        template_mask=["crawlJob.scheduleRef"])
    return R.list_rows(config_object(spark, sf_dir), request).selectExpr(*CONFIG_COLUMNS)


@query("template_contains_all", """
SELECT id, kind, name FROM config_flat WHERE label_brand = 'Brand#3' AND label_type = 'ECONOMY'""")
def template_contains_all(spark, sf_dir):
    request = R.ListRequest(
        template={"meta": {"label": [{"key": "Brand", "value": "Brand#3"}, {"key": "type", "value": "ECONOMY"}]}},
        template_mask=["meta.label"])
    return R.list_rows(config_object(spark, sf_dir), request).selectExpr(*CONFIG_COLUMNS)


@query("time_between", """
SELECT id, state FROM crawl_execution
WHERE start_time >= timestamp '2024-01-02 00:00:00' AND start_time < timestamp '2024-01-05 12:00:00'""")
def time_between(spark, sf_dir):
    request = R.ListRequest(time_from="2024-01-02 00:00:00", time_to="2024-01-05 12:00:00")
    return R.list_rows(crawl_execution(spark, sf_dir), request).select("id", "state")


@query("label_select", """
SELECT id, kind, name FROM config_flat
WHERE lower(label_brand) LIKE 'brand#1%' AND (lower(label_type) = 'economy') AND label_size IS NOT NULL""")
def label_select(spark, sf_dir):
    request = R.ListRequest(label_selectors=["brand:BRAND#1*", "economy", "SIZE:", ":"])
    return R.list_rows(config_object(spark, sf_dir), request).selectExpr(*CONFIG_COLUMNS)


@query("name_regex", "SELECT id, kind, name FROM config_flat WHERE regexp_matches(name, 'RED.*3$', 'i')")
def name_regex(spark, sf_dir):
    return R.list_rows(config_object(spark, sf_dir), R.ListRequest(name_regex="RED.*3$")).selectExpr(*CONFIG_COLUMNS)


@query("has_error", "SELECT id, state, error_code FROM crawl_execution WHERE error_code IS NOT NULL")
def has_error(spark, sf_dir):
    request = R.ListRequest(has_error=True, error_column="error_code")
    return R.list_rows(crawl_execution(spark, sf_dir), request).select("id", "state", "error_code")


@query("filter_string", """
SELECT id, kind, name FROM config_flat WHERE kind = 'seed' AND coalesce(disabled, false) = false
  AND label_brand = 'Brand#7'""")
def filter_string(spark, sf_dir):
    return R.filter_string(config_object(spark, sf_dir), "kind=seed", "seed.disabled=false",
                           "meta.label+=Brand:Brand#7").selectExpr(*CONFIG_COLUMNS)


@query("abort_requests", """
SELECT id, state, desired_state FROM crawl_execution WHERE state IN ('CREATED', 'FETCHING', 'SLEEPING')
  AND desired_state IN ('ABORTED_TIMEOUT', 'ABORTED_SIZE', 'ABORTED_MANUAL')""")
def abort_requests(spark, sf_dir):
    return S.abort_requests(crawl_execution(spark, sf_dir)).select("id", "state", "desired_state")


@query("log_lookup", """
SELECT warc_id, execution_id, time_stamp FROM crawl_log WHERE execution_id = 'ce8_0'
ORDER BY cast(substring(warc_id, 2) as bigint) DESC LIMIT 5 OFFSET 1""")
def log_lookup(spark, sf_dir):
    logs = rowwise(spark, sf_dir, "crawl_log").withColumn(
        "ingestion_seq", F.substring("warc_id", 2, 20).cast("bigint"))
    return R.log_lookup(logs, execution_id="ce8_0", page_size=5, offset=1).select(
        "warc_id", "execution_id", "time_stamp")


@query("enabled_seeds_for_job", """
SELECT id, name FROM seed WHERE (job_a = 'job3' OR job_b = 'job3') AND NOT coalesce(disabled, false)""")
def enabled_seeds_for_job(spark, sf_dir):
    return S.enabled_seeds_for_job(seed_object(spark, sf_dir), "job3").select(
        "id", F.col("meta.name").alias("name"))


@query("startable_jobs", """
SELECT j.id, s.cron FROM crawl_job j JOIN schedule s ON s.id = j.schedule_id
WHERE NOT j.disabled AND s.cron <> ''
  AND (s.valid_from IS NULL OR s.valid_from < timestamp '2024-01-15 00:00:00')
  AND (s.valid_to IS NULL OR s.valid_to > timestamp '2024-01-15 00:00:00')
  AND j.id NOT IN (SELECT job_id FROM job_execution WHERE state = 'RUNNING')""")
def startable_jobs(spark, sf_dir):
    return S.startable_jobs(
        rowwise(spark, sf_dir, "crawl_job"), rowwise(spark, sf_dir, "schedule"),
        job_execution(spark, sf_dir), "2024-01-15 00:00:00").select("id", "cron")


@query("has_all_labels", """
SELECT id, kind, name FROM config_flat WHERE label_brand = 'Brand#3' AND label_size = '10'""")
def has_all_labels(spark, sf_dir):
    rows = config_object(spark, sf_dir)
    return rows.where(L.has_all_labels(F.col("meta.label"), [("Brand", "Brand#3"), ("size", "10")])).selectExpr(*CONFIG_COLUMNS)


@query("selected_scripts", """
SELECT p.page_id, concat('scr', n.n_nationkey) AS script_id FROM pages p JOIN nation n
ON n.n_nationkey % 2 = 0 AND (n.n_nationkey % 5 = 0
  OR regexp_matches(p.url, concat('/', n.n_nationkey, '[0-9]*(\\.html)?$')) OR (n.n_nationkey = 6 AND regexp_matches(p.url, '^https://blog\\.')))
""")
def selected_scripts(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    scripts = n.select(
        F.concat(F.lit("scr"), key).alias("script_id"),
        F.when(key % 2 == 0, "ON_LOAD").otherwise("ON_NEW_DOCUMENT").alias("script_type"),
        F.when(key % 5 == 0, F.array().cast("array<string>"))
         .when(key == 6, F.array(F.concat(F.lit("/"), key, F.lit(r"[0-9]*(\.html)?$")), F.lit(r"^https://blog\.")))
         .otherwise(F.array(F.concat(F.lit("/"), key, F.lit(r"[0-9]*(\.html)?$")))).alias("url_regexp"))
    urls = load(spark, sf_dir, "pages").select("page_id", "url")
    return S.selected_scripts(urls, scripts, "ON_LOAD").select("page_id", "script_id")


@query("browser_local_scheme", """
SELECT page_id, i, u FROM (
  SELECT page_id, unnest([0, 1, 2, 3]) AS i,
    unnest([url, concat('Data:text/html,', page_id), concat('javascript:f(', page_id, ')'), concat('dataset/', page_id)]) AS u
  FROM pages) WHERE lower(split_part(u, ':', 1)) NOT IN ('data', 'blob', 'about', 'javascript', 'chrome', 'devtools')
""")
def browser_local_scheme(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(
        F.col("url"), F.concat(F.lit("Data:text/html,"), "page_id"),
        F.concat(F.lit("javascript:f("), "page_id", F.lit(")")), F.concat(F.lit("dataset/"), "page_id"))).alias("i", "u"))
    return p.where(~S.is_browser_local(F.col("u")))


@query("valid_write_request", """
SELECT record_id, CASE WHEN seq % 31 = 0 THEN 'missing metadata object' WHEN seq % 29 = 0 THEN 'missing collection ref'
  WHEN seq % 23 = 0 THEN 'missing IP-address' WHEN seq % 19 = 0 THEN 'missing target URI'
  WHEN record_type = 'metadata' THEN concat('unknown collection: ', collection, '-gone')
  WHEN digest = '' THEN 'missing record metadata' ELSE '' END AS reason FROM crawled""")
def valid_write_request(spark, sf_dir):
    c = rowwise(spark, sf_dir, "crawled")
    blank = F.lit(None).cast("string")
    requests = c.select(
        "record_id", (F.col("seq") % 31 != 0).alias("has_meta"),
        F.when(F.col("seq") % 29 == 0, blank).when(
            F.col("record_type") == "metadata", F.concat("collection", F.lit("-gone")))
        .otherwise(F.col("collection")).alias("collection_id"),
        F.when(F.col("seq") % 23 == 0, "").otherwise("10.0.0.1").alias("ip_address"),
        F.when(F.col("seq") % 19 == 0, "").otherwise(F.col("uri")).alias("target_uri"),
        (F.col("digest") != "").alias("has_record_meta"))
    known = load(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct()
    return S.validate_write_requests(requests, known).select("record_id", "reason")


@query("order_by_path", """
SELECT id, name, row_number() OVER (ORDER BY lower(name) DESC, id) AS pos FROM config_flat
ORDER BY lower(name) DESC, id LIMIT 50""")
def order_by_path(spark, sf_dir):
    rows = R.list_rows(config_object(spark, sf_dir), R.ListRequest(
        order_by="meta.name", descending=True, page_size=50))
    return _positions(rows.select("id", F.col("meta.name").alias("name")))


def _positions(page):
    """Positions in a page of bounded size, to show its order."""
    return page.withColumn("pos", F.monotonically_increasing_id() + 1)


@query("page_slice", """
SELECT id, kind, name FROM config_flat WHERE kind = 'seed' ORDER BY lower(name), id LIMIT 25 OFFSET 40""")
def page_slice(spark, sf_dir):
    return R.list_rows(config_object(spark, sf_dir), R.ListRequest(
        kind="seed", order_by="meta.name", page_size=25, offset=40)).selectExpr(*CONFIG_COLUMNS)


@query("sort_nulls_last", """
SELECT id, row_number() OVER (ORDER BY lower(nullif(trim(description), '')) DESC NULLS LAST, id) AS pos
FROM config_flat""")
def sort_nulls_last(spark, sf_dir):
    order = R.nulls_last_order("description", descending=True)
    return sorted_numbers(rowwise(spark, sf_dir, "config_flat").select("id", "description"), order, "pos").select(
        "id", F.col("pos").cast("bigint").alias("pos"))


@query("recent_top_n", """
SELECT warc_id, collection_final_name FROM crawl_log ORDER BY cast(substring(warc_id, 2) as bigint) DESC LIMIT 20""")
def recent_top_n(spark, sf_dir):
    logs = rowwise(spark, sf_dir, "crawl_log").withColumn(
        "ingestion_seq", F.substring("warc_id", 2, 20).cast("bigint"))
    return R.log_lookup(logs, page_size=20, offset=-3).select("warc_id", "collection_final_name")


@query("query_limit", "SELECT id, name FROM seed ORDER BY id LIMIT 50")
def query_limit(spark, sf_dir):
    return R.query_limit(rowwise(spark, sf_dir, "seed").select("id", "name").orderBy("id"), 0)


@query("count_rows", """
SELECT count(*) AS count FROM config_flat WHERE kind = 'seed' AND lower(label_brand) LIKE 'brand#1%'""")
def count_rows(spark, sf_dir):
    return R.count_rows(config_object(spark, sf_dir), R.ListRequest(
        kind="seed", label_selectors=["brand:brand#1*"], page_size=3, offset=2))
