"""Queries over readers, writers and files."""

import os

from pyspark.sql import functions as F

from crawlatlas.operators import pagelog
from crawlatlas.plans import stored
from crawlatlas.registry.base import query
from crawlatlas.registry.rollups import _SUBMISSIONS, submissions
from crawlatlas.schemas import CRAWL_LOG
from crawlatlas.session import scratch
from crawlatlas.sources import logs as L
from crawlatlas.sources import records as R
from crawlatlas.sources.derived import crawl_execution, rowwise
from crawlatlas.sources.tables import load

_NAMES = [c.strip().split()[0] for c in CRAWL_LOG.split(",")]


def archived_logs(spark, sf_dir):
    """The crawl log written to the archive, with collection names that need escaping."""
    base = scratch(spark, "archive")
    logs = rowwise(spark, sf_dir, "crawl_log").withColumn(
        "collection_final_name", F.expr("decode(collection_final_name, 'coll0', 'a/b', 'coll1', 'a_b', '  ')"))
    L.sink_crawl_log(logs.select(*_NAMES), base, rows_per_file=2000)
    return base


@query("scan_crawl_log", f"""
SELECT l.* EXCLUDE (collection_final_name), CASE collection_final_name WHEN 'coll0' THEN 'a/b' WHEN 'coll1' THEN 'a_b' ELSE 'default' END AS collection FROM crawl_log l""")
def scan_crawl_log(spark, sf_dir):
    return L.scan_crawl_log(spark, archived_logs(spark, sf_dir)).drop("collection_final_name")


@query("sink_crawl_log", """
SELECT CASE collection_final_name WHEN 'coll0' THEN 'a/b' WHEN 'coll1' THEN 'a_b' ELSE 'default' END AS collection, count(*) AS n,
  cast(sum(size) as bigint) AS bytes, true AS within_limit FROM crawl_log GROUP BY 1""")
def sink_crawl_log(spark, sf_dir):
    base = archived_logs(spark, sf_dir)
    files = L.listing(spark, base, "crawl_log").groupBy("collection").agg(
        F.sum("rows").alias("n"), (F.max("rows") <= 2000).alias("within_limit"))
    sizes = L.scan_crawl_log(spark, base).groupBy("collection").agg(F.sum("size").alias("bytes"))
    return files.join(sizes, "collection").select("collection", "n", "bytes", "within_limit")


def archived_pages(spark, sf_dir):
    base = scratch(spark, "archive")
    n = F.substring("page_id", 2, 20).cast("bigint")
    first = F.col("idx") == 0
    requests = rowwise(spark, sf_dir, "browser_request").select(
        "*", F.concat(F.lit("ce"), n % 50).alias("execution_id"), F.concat(F.lit("je"), n % 5).alias("job_execution_id"),
        F.concat(F.lit("coll "), n % 3).alias("collection_final_name"), F.repeat(F.lit("L"), F.col("idx")).alias("discovery_path"),
        (F.col("content_type") == "text/html").alias("renderable"),
        F.when(F.col("error_code") != 0, F.concat(F.lit("failed "), "error_code")).alias("error_msg"),
        F.when(F.col("error_code") != 0, "no detail").alias("error_detail"))
    # A page's key is the id of its record.
    requests = requests.withColumn("warc_id", F.when(first, F.col("page_id")).otherwise(F.col("warc_id")))
    L.sink_page_messages(pagelog.page_log_messages(requests), base)
    return base


_PAGES = """p AS (SELECT page_id, max(url) FILTER (WHERE idx = 0) AS uri,
  count(*) FILTER (WHERE idx > 0 AND resource_type = 'Script') AS outlinks,
  string_agg(url, ' ' ORDER BY seq) FILTER (WHERE idx > 0 AND resource_type = 'Script') AS links FROM browser_request GROUP BY 1)"""


@query("scan_page_log", f"""WITH {_PAGES}
SELECT page_id AS warc_id, uri, concat('ce', cast(substring(page_id, 2) as bigint) % 50) AS execution_id,
  concat('je', cast(substring(page_id, 2) as bigint) % 5) AS job_execution_id, '' AS referrer,
  concat('coll ', cast(substring(page_id, 2) as bigint) % 3) AS collection, outlinks, coalesce(links, '') AS links FROM p""")
def scan_page_log(spark, sf_dir):
    return L.scan_page_log(spark, archived_pages(spark, sf_dir)).select(
        "warc_id", "uri", "execution_id", "job_execution_id", "referrer", "collection", F.size("outlinks").cast("bigint").alias("outlinks"),
        F.concat_ws(" ", "outlinks").alias("links"))


@query("scan_resource", """
SELECT page_id, warc_id, url AS uri, referrer, resource_type, content_type, repeat('L', idx) AS discovery_path, method, status_code,
  from_cache, content_type = 'text/html' AS renderable, error_code, CASE WHEN error_code <> 0 THEN concat('failed ', error_code) END AS error_msg,
  CASE WHEN error_code <> 0 THEN 'no detail' END AS error_detail, concat('coll ', cast(substring(page_id, 2) as bigint) % 3) AS collection
FROM browser_request WHERE idx > 0 AND has_crawl_log""")
def scan_resource(spark, sf_dir):
    return L.scan_resource(spark, archived_pages(spark, sf_dir)).select(
        "page_id", *pagelog.RESOURCE_FIELDS, "collection")


@query("sink_page_log_split", f"""WITH {_PAGES}
SELECT concat('coll ', cast(substring(p.page_id, 2) as bigint) % 3) AS collection, count(*) AS pages, cast(sum(r) as bigint) AS resources
FROM p JOIN (SELECT page_id, count(*) FILTER (WHERE idx > 0 AND has_crawl_log) AS r FROM browser_request GROUP BY 1) x ON x.page_id = p.page_id GROUP BY 1""")
def sink_page_log_split(spark, sf_dir):
    base = archived_pages(spark, sf_dir)
    pages = L.listing(spark, base, "page_log").groupBy("collection").agg(F.sum("rows").alias("pages"))
    resources = L.listing(spark, base, "resource").groupBy("collection").agg(F.sum("rows").alias("resources"))
    return pages.join(resources, "collection")


@query("collection_dir", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN concat('a%2Fb%20', p_partkey) WHEN 2 THEN concat('a_b~$&+=:@', p_partkey)
  ELSE concat('%23', replace(p_name, ' ', '%20'), '%2A') END AS dir FROM part""")
def collection_dir(spark, sf_dir):
    k = F.col("p_partkey")
    name = (F.when(k % 4 == 0, "   ").when(k % 4 == 1, F.concat(F.lit(" a/b "), k))
            .when(k % 4 == 2, F.concat(F.lit("a_b~$&+=:@"), k)).otherwise(F.concat(F.lit("#"), "p_name", F.lit("*"))))
    return load(spark, sf_dir, "part").select("p_partkey", L.collection_dir(name).alias("dir"))


@query("file_manifest", """
SELECT CASE collection_final_name WHEN 'coll0' THEN 'a/b' WHEN 'coll1' THEN 'a_b' ELSE 'default' END AS collection, count(*) AS rows,
  true AS all_dated, cast(0 as bigint) AS gone FROM crawl_log GROUP BY 1""")
def file_manifest(spark, sf_dir):
    files = L.listing(spark, archived_logs(spark, sf_dir), "crawl_log")
    early = F.lit("2024-01-01 00:00:00").cast("timestamp")
    index = files.where("rows % 2 = 0").select("path", early.alias("finalized_at")).unionAll(
        files.select(F.concat("path", F.lit(".gone")), early))
    manifest = L.file_manifest(files, index)
    return manifest.groupBy("collection").agg(
        F.sum("rows").alias("rows"), F.bool_and(F.col("finalized_at").isNotNull()).alias("all_dated"),
        F.count_if(F.col("path").endswith(".gone")).alias("gone"))


@query("handoff_candidates", """
SELECT 'logs/crawl_log/' || CASE collection_final_name WHEN 'coll0' THEN 'a%2Fb' WHEN 'coll1' THEN 'a_b' ELSE 'default' END AS place,
  count(*) AS rows FROM crawl_log GROUP BY 1""")
def handoff_candidates(spark, sf_dir):
    manifest = L.file_manifest(L.listing(spark, archived_logs(spark, sf_dir), "crawl_log"))
    later = F.col("modified") + F.make_interval(hours=F.lit(2))
    ready = L.handoff_candidates(manifest, later, 3600, "logs")
    return ready.groupBy(F.regexp_replace("object_key", "/[^/]*$", "").alias("place")).agg(F.sum("rows").alias("rows"))


@query("read_seed_import", """
SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN NULL ELSE concat('http://', lower(c_mktsegment), '.example.com/', c_custkey) END AS uri,
  CASE WHEN c_custkey % 13 = 0 THEN 'not a record' WHEN c_custkey % 17 = 0 THEN 'unknown field: uri2' ELSE '' END AS reason FROM customer""")
def read_seed_import(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    url = F.concat(F.lit("http://"), F.lower("c_mktsegment"), F.lit(".example.com/"), "c_custkey")
    record = F.to_json(F.struct(F.col("c_name").alias("entityName"), url.alias("uri"),
                                F.array(F.struct(F.lit("k").alias("key"), F.col("c_custkey").cast("string").alias("value"))).alias("seedLabel")))
    line = (F.when(F.col("c_custkey") % 13 == 0, F.concat(F.lit("{broken "), "c_custkey"))
            .when(F.col("c_custkey") % 17 == 0, F.regexp_replace(record, '"uri"', '"uri2"')).otherwise(record))
    path = scratch(spark, "import")
    c.select(line.alias("value")).write.text(path)
    good, bad = R.read_seed_import(spark, path)
    key_of_bad = F.regexp_extract("value", r"(?:broken |example\.com/)(\d+)", 1).cast("bigint")
    return (good.select(F.col("seedLabel")[0]["value"].cast("bigint").alias("c_custkey"), "uri", F.lit("").alias("reason"))
            .unionAll(bad.select(key_of_bad, F.lit(None).cast("string"), "reason")))


@query("read_lines", "SELECT url AS value FROM pages WHERE page_id % 3 > 0")
def read_lines(spark, sf_dir):
    path = scratch(spark, "lines")
    padded = F.when(F.col("page_id") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    load(spark, sf_dir, "pages").select(padded.alias("value")).write.text(path)
    return R.read_lines(spark, path)


@query("oos_shard_sink", f"""WITH {_SUBMISSIONS}, h AS (SELECT DISTINCT scheme, host FROM submissions)
SELECT concat(split_part(host, '.', -1), '_', substring(split_part(host, '.', -2), 1, 2)) AS shard, concat(scheme, '://', host) AS value FROM h""")
def oos_shard_sink(spark, sf_dir):
    path = scratch(spark, "shards")
    R.write_oos_shards(submissions(spark, sf_dir).select("scheme", "host").distinct(), path)
    return spark.read.text(path).select("shard", "value")


@query("export_json", """
SELECT concat('{"id":"', id, '","uris_crawled":', uris_crawled, CASE WHEN desired_state IS NULL THEN '' ELSE concat(',"desired_state":"', desired_state, '"') END, '}') AS value FROM crawl_execution""")
def export_json(spark, sf_dir):
    return R.json_rows(crawl_execution(spark, sf_dir).select("id", "uris_crawled", "desired_state"))


@query("stored_query", """
SELECT concat(job_id, ': ', count(*), ' (', sum(uris_crawled), ')') AS text FROM crawl_execution WHERE state = 'FINISHED' AND uris_crawled >= 3 GROUP BY job_id""")
def stored_query(spark, sf_dir):
    directory = os.path.join(os.path.dirname(os.path.dirname(__file__)), "plans", "queries")
    found = stored.read(stored.find("executions_by_job", directory))
    return stored.run(spark, found, ["FINISHED", 3], {"executions": crawl_execution(spark, sf_dir)})
