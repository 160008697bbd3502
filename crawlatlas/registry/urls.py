"""Queries over URLs, hashes, digests, periods, links and admission."""

from pyspark.sql import functions as F

from crawlatlas.functions import archive as X
from crawlatlas.functions import html as H
from crawlatlas.functions import urls as U
from crawlatlas.operators.frontier import politeness_delay
from crawlatlas.operators.scope import scope_default
from crawlatlas.plans.admission import admit_outlinks
from crawlatlas.plans.seen import remember, seen_table
from crawlatlas.registry.base import query
from crawlatlas.registry.joins import _SHA
from crawlatlas.session import materialize, scratch
from crawlatlas.sources.derived import rowwise
from crawlatlas.sources.tables import load

_C = """c AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS href, split_part(url, '://', 1) AS scheme,
  regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages)"""


def _parsed(spark, sf_dir, fully):
    p = load(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url"), fully).alias("c"))
    return p.select("page_id", "c.href", "c.scheme", "c.host", "c.port", "c.path", "c.query", "c.error")


@query("canonicalize_crawl", f"""WITH {_C}
SELECT page_id, href, scheme, host, CASE scheme WHEN 'http' THEN 80 ELSE 443 END AS port, path, query, CAST(NULL AS VARCHAR) AS error FROM c""")
def canonicalize_crawl(spark, sf_dir):
    return _parsed(spark, sf_dir, False)


@query("canonicalize_scope", """
SELECT id, CASE kind WHEN 0 THEN uri WHEN 1 THEN concat('https://sub.', regexp_extract(uri, 'sub\\.([^/]*)', 1), '/a%20b/', id % 200, '?b=1&q=2&sid=', id % 7)
  WHEN 2 THEN uri WHEN 3 THEN replace(uri, '//' || (id % 9), '/' || (id % 9))
  WHEN 4 THEN concat('http://', regexp_extract(uri, '@([^:]*)', 1), '/p/', id % 200)
  ELSE CASE WHEN id % 12 = 5 THEN uri ELSE concat('http:', uri) END END AS href,
  kind = 5 AND id % 12 = 5 AS failed
FROM scope_check""")
def canonicalize_scope(spark, sf_dir):
    c = rowwise(spark, sf_dir, "scope_check").select("id", U.canonical(F.col("uri"), True).alias("c"))
    return c.select("id", "c.href", F.col("c.error").isNotNull().alias("failed"))


@query("url_key", """
SELECT id, concat(split_part(name, '://', 1), '://', lower(regexp_extract(name, '://([^/?#]*)', 1)),
    CASE WHEN regexp_extract(name, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(name, '://[^/?#]*([^?#]*)', 1) END,
    regexp_extract(name, '(\\?[^#]*)', 1)) AS url_key,
  concat(split_part(name, '://', 1), '://', lower(regexp_extract(name, '://([^/?#]*)', 1)), '/') AS top_level,
  concat('//', lower(regexp_extract(name, '://([^/?#]*)', 1)), '/') AS top_level_any_scheme FROM seed""")
def url_key(spark, sf_dir):
    name = F.col("name")
    return rowwise(spark, sf_dir, "seed").select(
        "id", U.url_key(name).alias("url_key"), U.url_key(name, top_level=True).alias("top_level"),
        U.url_key(name, top_level=True, ignore_scheme=True).alias("top_level_any_scheme"))


@query("uri_hash", """
WITH a AS (SELECT id, uri FROM queued_uri)
SELECT id, sha256(from_hex(regexp_replace(hex(encode(uri)), '(..)', '\\100', 'g'))) AS uri_hash FROM a""")
def uri_hash(spark, sf_dir):
    return rowwise(spark, sf_dir, "queued_uri").select("id", U.uri_hash(F.col("uri")).alias("uri_hash"))


@query("block_digest", """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('sha1:', sha1(concat('HTTP/1.1 200 OK', chr(13), chr(10), text))) END AS digest FROM documents""")
def block_digest(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    header = F.lit("HTTP/1.1 200 OK\r\n")
    return d.select("doc_id", X.block_digest(header, F.col("text"), F.col("doc_id") % 10 == 0).alias("digest"))


@query("mime_of", """
SELECT warc_id, CASE WHEN strpos(content_type, ';') > 1 THEN split_part(content_type, ';', 1) ELSE content_type END AS mime FROM crawl_log""")
def mime_of(spark, sf_dir):
    return rowwise(spark, sf_dir, "crawl_log").select("warc_id", X.mime_of(F.col("content_type")).alias("mime"))


@query("oos_shard", """
WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
SELECT page_id, concat(split_part(host, '.', -1), '_', substring(split_part(host, '.', -2), 1, 2)) AS shard FROM h""")
def oos_shard(spark, sf_dir):
    sites = U.with_site(load(spark, sf_dir, "pages").select("page_id", "url"))
    return sites.select("page_id", U.oos_shard(F.col("host")).alias("shard"))


_POLICY = "CASE user_id % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'HOURLY' WHEN 2 THEN 'DAILY' WHEN 3 THEN 'MONTHLY' ELSE 'YEARLY' END"
_KEY = f"""CASE {_POLICY} WHEN 'HOURLY' THEN strftime(ts, '%Y%m%d%H') WHEN 'DAILY' THEN strftime(ts, '%Y%m%d')
  WHEN 'MONTHLY' THEN strftime(ts, '%Y%m') WHEN 'YEARLY' THEN strftime(ts, '%Y') ELSE '' END"""


def policies(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(_POLICY).alias("policy"))


@query("rotation_key", f"SELECT event_id, {_KEY} AS rotation_key FROM events")
def rotation_key(spark, sf_dir):
    return policies(spark, sf_dir).select("event_id", X.rotation_key(F.col("ts"), F.col("policy")).alias("rotation_key"))


@query("final_collection_name", f"""
SELECT event_id, concat('coll', user_id % 3, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_SCREENSHOT' ELSE '_DNS' END,
  CASE WHEN {_KEY} = '' THEN '' ELSE concat('_', {_KEY}) END) AS name FROM events""")
def final_collection_name(spark, sf_dir):
    sub = F.when(F.col("event_id") % 3 == 0, "UNDEFINED").when(F.col("event_id") % 3 == 1, "SCREENSHOT").otherwise("DNS")
    name = F.concat(F.lit("coll"), F.col("user_id") % 3)
    return policies(spark, sf_dir).select(
        "event_id", X.final_collection_name(name, sub, F.col("ts"), F.col("policy")).alias("name"))


@query("period_end", f"""
SELECT event_id, CASE {_POLICY} WHEN 'HOURLY' THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 'DAILY' THEN date_trunc('day', ts) + INTERVAL 1 DAY
  WHEN 'MONTHLY' THEN date_trunc('month', ts) + INTERVAL 1 MONTH WHEN 'YEARLY' THEN date_trunc('year', ts) + INTERVAL 1 YEAR END AS period_end,
  CASE WHEN {_POLICY} = 'HOURLY' THEN 'HOURLY' ELSE 'DAILY' END AS file_policy FROM events""")
def period_end(spark, sf_dir):
    return policies(spark, sf_dir).select(
        "event_id", X.period_end(F.col("ts"), F.col("policy")).alias("period_end"),
        X.finer_policy(F.col("policy"), F.lit("DAILY")).alias("file_policy"))


@query("politeness_delay", """
SELECT id, CASE id_num % 4 WHEN 0 THEN least(greatest(page_fetch_time_ms, 5000), 30000) WHEN 1 THEN least(greatest(0, 5000), 30000)
  WHEN 2 THEN cast(floor(page_fetch_time_ms * 1.5) as bigint) ELSE least(greatest(page_fetch_time_ms * 2, 5000), 3000) END AS delay_ms
FROM (SELECT *, cast(substring(id, 2) as bigint) AS id_num FROM queued_uri)""")
def delay(spark, sf_dir):
    n = F.substring("id", 2, 20).cast("bigint") % 4
    factor = F.when(n == 0, 0.0).when(n == 1, -1.0).when(n == 2, 1.5).otherwise(2.0)
    low = F.when(n == 2, 0).otherwise(5000)
    high = F.when(n == 2, 0).when(n == 3, 3000).otherwise(30000)
    return rowwise(spark, sf_dir, "queued_uri").select(
        "id", politeness_delay(F.col("page_fetch_time_ms"), factor, low, high).alias("delay_ms"))


_ENCODED = "concat(site, '/', replace(url_encode(substring(href, 2)), '%2C', ','))"


@query("extract_outlinks", f"SELECT DISTINCT page_id, {_ENCODED} AS uri FROM link")
def extract_outlinks(spark, sf_dir):
    return H.extract_outlinks(load(spark, sf_dir, "pages")).select("page_id", "uri")


@query("outlink_rows", f"""
SELECT DISTINCT page_id, {_ENCODED} AS uri, concat(CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'R' ELSE 'LR' END, 'L') AS discovery_path,
  page_url AS referrer FROM link""")
def outlink_rows(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    n = F.col("page_id") % 3
    roots = pages.select("page_id", "url", F.when(n == 0, "").when(n == 1, "R").otherwise("LR").alias("discovery_path"))
    return H.outlink_rows(H.extract_outlinks(pages), roots)


def admission_input(spark, sf_dir):
    """Parents, DNS answers and robots rules for the outlinks of the pages."""
    pages = load(spark, sf_dir, "pages")
    n = F.col("page_id")
    parameters = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in (
        "scope_allowedSchemes", F.when(n % 7 == 0, "https").otherwise("https http"),
        "scope_includeSubdomains", F.lit("true"), "scope_altSeeds", F.lit(""),
        "scope_maxHopsFromSeed", F.lit("2"), "scope_hopsIncludeRedirects", F.lit("no"),
        "scope_excludedUris", F.lit("http://none.example.com/"))])
    parents = pages.select(
        "page_id", "url", F.col("url").alias("seed_uri"),
        F.concat(F.lit("ce"), n % 20).alias("execution_id"), F.concat(F.lit("je"), n % 3).alias("job_execution_id"),
        F.when(n % 2 == 0, F.lit(2.0)).alias("priority_weight"), (n % 9).cast("bigint").alias("sequence"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "L").when(n % 4 == 2, "LL").otherwise("LR").alias("discovery_path"),
        parameters.alias("annotation"), (n % 11 != 0).alias("active"))
    hosts = U.with_site(pages.select("url")).select("host").distinct()
    size = F.length("host")
    dns = hosts.select("host", F.when(size % 5 >= 2, F.concat_ws(".", F.lit("10.0"), size, F.lit("1"))).alias("ip"),
                       F.when(size % 5 == 0, -9).when(size % 5 == 1, -1).otherwise(0).alias("dns_code"))
    robots = hosts.where(size % 3 == 0).select("host", F.lit("User-agent: *\nDisallow: /t\nDisallow: /*en\n").alias("rules"))
    return parents, dns, robots


@query("admit_outlinks", f"""
WITH l AS (SELECT DISTINCT page_id, page_url, regexp_extract(page_url, '://([^/?#]*)', 1) AS host, split_part(page_url, '://', 1) AS scheme,
    {_ENCODED} AS uri, {_ENCODED} AS found FROM link),
f AS (SELECT *, length(host) % 5 AS d, length(CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'L' WHEN 2 THEN 'LL' ELSE 'L' END) + 1 AS hops,
    length(host) % 3 = 0 AND (starts_with(split_part(uri, host, 2), '/t') OR split_part(uri, host, 2) LIKE '/%en%') AS denied FROM l),
r AS (SELECT *, CASE WHEN page_id % 7 = 0 AND scheme = 'http' THEN -5001 WHEN hops > 2 THEN -4001 WHEN d = 0 THEN -9
    WHEN d >= 2 AND denied THEN -9998 WHEN page_id % 11 = 0 THEN 0 END AS reason0 FROM f),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id % 3, uri, reason0 IS NULL ORDER BY page_id, found) AS rn FROM r)
SELECT page_id, uri, concat('ce', page_id % 20) AS execution_id, page_id % 9 + 1 AS sequence,
  CASE WHEN reason0 IS NULL AND rn = 1 THEN 'QUEUED' ELSE 'REJECTED' END AS decision,
  CASE WHEN reason0 IS NULL AND rn > 1 THEN -4100 ELSE reason0 END AS reason,
  CASE WHEN reason0 IS NULL AND rn = 1 THEN d = 1 END AS for_retry,
  CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS priority_weight,
  CASE WHEN reason0 IS NULL AND rn = 1 THEN CASE WHEN d = 1 THEN concat('TEMP_CHG_', {_SHA.format('host')})
    ELSE {_SHA.format("concat('10.0.', length(host), '.1')")} END END AS crawl_host_group_id
FROM s""")
def admit(spark, sf_dir):
    parents, dns, robots = admission_input(spark, sf_dir)
    outlinks = H.extract_outlinks(load(spark, sf_dir, "pages"))
    rows = admit_outlinks(outlinks, parents, dns, robots, scope_default(), "crawler")
    return rows.select("page_id", "uri", "execution_id", "sequence", "decision", "reason", "for_retry",
                       "priority_weight", "crawl_host_group_id")


POLICIES = ["OBEY_ROBOTS", "IGNORE_ROBOTS", "CUSTOM_ROBOTS", "CUSTOM_IF_MISSING"]


@query("admit_outlinks_full", f"""
WITH l AS (SELECT DISTINCT page_id, page_url, regexp_extract(page_url, '://([^/?#]*)', 1) AS host, split_part(page_url, '://', 1) AS scheme,
    {_ENCODED} AS uri, {_ENCODED} AS found FROM link),
e AS (SELECT *, length(host) % 5 AS d, page_id % 20 AS k, split_part(uri, host, 2) AS rest,
    length(CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'L' WHEN 2 THEN 'LL' ELSE 'L' END) + 1 AS hops,
    list_element(['OBEY_ROBOTS', 'IGNORE_ROBOTS', 'CUSTOM_ROBOTS', 'CUSTOM_IF_MISSING'], CAST((page_id // 3) % 4 + 1 AS BIGINT)) AS policy,
    length(host) % 3 = 0 AND scheme = 'http' AND (page_id % 5 = 0 OR page_id % 2 = 0) AS ruled FROM l),
f AS (SELECT *, page_id % 11 <> 0 AND k % 7 <> 6 AND NOT (k % 2 = 0 AND 10 * k > 150) AND NOT (k % 3 = 0 AND k > 12) AS active,
    CASE WHEN policy = 'IGNORE_ROBOTS' THEN false
         WHEN policy = 'CUSTOM_ROBOTS' OR (policy = 'CUSTOM_IF_MISSING' AND NOT ruled) THEN starts_with(rest, '/s')
         ELSE ruled AND (starts_with(rest, '/t') OR rest LIKE '/%en%') END AS denied FROM e),
r AS (SELECT *, CASE WHEN page_id % 7 = 0 AND scheme = 'http' THEN -5001 WHEN hops > 2 THEN -4001 WHEN d = 0 THEN -9
    WHEN d >= 2 AND denied THEN -9998 WHEN NOT active THEN 0 END AS reason0 FROM f),
b AS (SELECT DISTINCT uri AS old FROM l WHERE page_id % 4 = 1),
s AS (SELECT r.*, page_id % 3 = 0 AND old IS NOT NULL AS seen,
    row_number() OVER (PARTITION BY page_id % 3, uri, reason0 IS NULL ORDER BY page_id, found) AS rn FROM r LEFT JOIN b ON uri = old),
q AS (SELECT *, reason0 IS NULL AND rn = 1 AND NOT seen AS queued FROM s)
SELECT page_id, uri, concat('ce', k) AS execution_id, page_id % 9 + 1 AS sequence, CASE WHEN queued THEN 'QUEUED' ELSE 'REJECTED' END AS decision,
  CASE WHEN reason0 IS NULL AND NOT queued THEN -4100 ELSE reason0 END AS reason, CASE WHEN queued THEN d = 1 END AS for_retry,
  CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS priority_weight,
  CASE WHEN queued THEN CASE WHEN d = 1 THEN concat('TEMP_CHG_', {_SHA.format('host')}) WHEN length(host) = 17 THEN 'near'
    WHEN length(host) BETWEEN 19 AND 255 THEN 'far' ELSE {_SHA.format("concat('10.0.', length(host), '.1')")} END END AS crawl_host_group_id
FROM q""")
def admit_full(spark, sf_dir):
    """Admission by limits, robots policy and key, address ranges, and a bucketed table of what was seen before."""
    parents, dns, robots = admission_input(spark, sf_dir)
    n = F.col("page_id")
    parents = parents.withColumn("collection", F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("c"), n % 2))).withColumn(
        "robots_policy", F.element_at(F.array(*[F.lit(p) for p in POLICIES]), (F.floor(n / 3) % 4 + 1).cast("int")))
    robots = robots.select(F.explode(F.array(F.lit("c0"), F.lit("unscoped"))).alias("collection"), F.lit("http").alias("scheme"), "host",
                           F.lit(80).alias("port"), "rules")
    k = F.col("id")
    limits = spark.range(20).select(
        F.concat(F.lit("ce"), k).alias("execution_id"), F.when(k % 7 == 6, "FINISHED").otherwise("FETCHING").alias("state"),
        (10 * k).alias("bytes_crawled"), k.alias("age_s"), F.when(k % 2 == 0, 150).otherwise(0).cast("bigint").alias("max_bytes"),
        F.when(k % 3 == 0, 12).otherwise(0).cast("bigint").alias("max_duration_s"))
    ranges = spark.createDataFrame([("near", "10.0.17.0", "10.0.17.255"), ("wide", "10.0.16.0", "10.0.17.128"), ("far", "10.0.19.0", "10.0.255.255")],
                                   "config_id string, ip_from string, ip_to string")
    outlinks = materialize(H.extract_outlinks(load(spark, sf_dir, "pages")), "outlinks")
    name = scratch(spark, "seen")
    table = "seen_" + name[-32:]
    seen = seen_table(spark, table, name, 32)
    before = outlinks.where(n % 4 == 1).select(F.lit("je0").alias("job_execution_id"), U.uri_hash(F.col("uri")).alias("uri_hash"),
                                               F.lit("QUEUED").alias("decision"))
    remember(before, table)
    spark.catalog.refreshTable(table)
    rows = admit_outlinks(outlinks, parents, dns, robots, scope_default(), "crawler", seen=seen, limits=limits, ranges=ranges,
                          custom="User-agent: *\nDisallow: /s\n")
    return rows.select("page_id", "uri", "execution_id", "sequence", "decision", "reason", "for_retry",
                       "priority_weight", "crawl_host_group_id")
