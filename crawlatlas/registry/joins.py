"""Queries over look-ups between tables."""

from pyspark.sql import functions as F

from crawlatlas.operators import joins as J
from crawlatlas.operators import pagegraph as G
from crawlatlas.operators import rollups as A
from crawlatlas.registry.base import query
from crawlatlas.registry.rollups import _SEED_KEY
from crawlatlas.sources.derived import crawl_execution, rowwise, seed_object
from crawlatlas.sources.tables import load


@query("join_job_config_chain", """
SELECT j.id, c.name AS crawl_config_name, 'agent' || (r.r_regionkey % 2) AS user_agent,
  CASE WHEN c.id IS NULL OR c.politeness_id = 'pol9' THEN NULL WHEN r.r_regionkey % 2 = 0 THEN 'OBEY_ROBOTS' ELSE 'IGNORE_ROBOTS' END AS robots_policy,
  CASE r.r_regionkey % 3 WHEN 0 THEN 'HOURLY' WHEN 1 THEN 'DAILY' WHEN 2 THEN 'NONE' END AS dedup_policy
FROM crawl_job j LEFT JOIN crawl_config c ON c.id = j.crawl_config_id LEFT JOIN region r ON c.id = concat('cc', r.r_regionkey)""")
def join_job_config_chain(spark, sf_dir):
    r = load(spark, sf_dir, "region")
    n = F.col("r_regionkey")
    browser = r.select(
        F.concat(F.lit("bc"), n).alias("id"), F.concat(F.lit("agent"), n).alias("user_agent"))
    polite = r.select(
        F.concat(F.lit("pol"), n).alias("id"),
        F.when(n == 0, "OBEY_ROBOTS").otherwise("IGNORE_ROBOTS").alias("robots_policy"))
    collections = r.select(
        F.concat(F.lit("col"), n).alias("id"),
        F.when(n == 0, "HOURLY").when(n == 1, "DAILY").otherwise("NONE").alias("dedup_policy"))
    return J.join_job_config_chain(
        rowwise(spark, sf_dir, "crawl_job"), rowwise(spark, sf_dir, "crawl_config"), browser, polite, collections,
    ).select("id", "crawl_config_name", "user_agent", "robots_policy", "dedup_policy")


@query("join_seed_entity", """
SELECT s.id, s.entity_id, e.name AS entity_name, e.description AS entity_description
FROM seed s LEFT JOIN entity e ON e.id = s.entity_id""")
def join_seed_entity(spark, sf_dir):
    return J.join_seed_entity(seed_object(spark, sf_dir), rowwise(spark, sf_dir, "entity")).select(
        "id", "entity_id", "entity_name", "entity_description")


def config_keys(spark, sf_dir):
    """(kind, id) of every stored object."""
    kinds = {"seed": "seed", "entity": "crawlEntity", "crawl_job": "crawlJob", "schedule": "crawlScheduleConfig",
             "crawl_config": "crawlConfig"}
    tables = [rowwise(spark, sf_dir, t).select(F.lit(k).alias("kind"), "id") for t, k in kinds.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def all_references(spark, sf_dir):
    return J.seed_references(seed_object(spark, sf_dir)).unionByName(
        J.job_references(rowwise(spark, sf_dir, "crawl_job")))


_REFS = """
keys AS (SELECT 'seed' AS kind, id FROM seed UNION ALL SELECT 'crawlEntity', id FROM entity UNION ALL
  SELECT 'crawlJob', id FROM crawl_job UNION ALL SELECT 'crawlScheduleConfig', id FROM schedule UNION ALL
  SELECT 'crawlConfig', id FROM crawl_config),
refs AS (
  SELECT id AS source_id, 'seed' AS source_kind, 'entityRef' AS field, 'crawlEntity' AS expected, true AS required, entity_kind AS kind, entity_id AS id FROM seed
  UNION ALL SELECT id, 'seed', 'jobRef', 'crawlJob', true, 'crawlJob', job_a FROM seed
  UNION ALL SELECT id, 'seed', 'jobRef', 'crawlJob', true, 'crawlJob', job_b FROM seed WHERE job_b IS NOT NULL
  UNION ALL SELECT id, 'crawlJob', 'scheduleRef', 'crawlScheduleConfig', false, CASE WHEN schedule_id IS NOT NULL THEN 'crawlScheduleConfig' END, schedule_id FROM crawl_job
  UNION ALL SELECT id, 'crawlJob', 'crawlConfigRef', 'crawlConfig', true, CASE WHEN crawl_config_id IS NOT NULL THEN 'crawlConfig' END, crawl_config_id FROM crawl_job)
"""


@query("dangling_refs", f"""WITH {_REFS}
SELECT source_id, field, kind, id, CASE WHEN id IS NULL THEN 'missing' WHEN kind <> expected THEN 'wrong kind' ELSE 'not found' END AS reason
FROM refs r WHERE (id IS NULL AND required) OR (id IS NOT NULL AND (kind <> expected
  OR NOT EXISTS (SELECT 1 FROM keys k WHERE k.kind = r.kind AND k.id = r.id)))""")
def dangling_refs(spark, sf_dir):
    return J.dangling_refs(all_references(spark, sf_dir), config_keys(spark, sf_dir))


@query("referrers_of", f"""WITH {_REFS}
SELECT k.kind, k.id, r.source_kind, count(*) AS dependents FROM keys k JOIN refs r ON r.kind = k.kind AND r.id = k.id GROUP BY ALL""")
def referrers_of(spark, sf_dir):
    return J.referrers_of(config_keys(spark, sf_dir), all_references(spark, sf_dir))


@query("deletable", f"""WITH {_REFS}
SELECT kind, id FROM keys k WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.kind = k.kind AND r.id = k.id)""")
def deletable(spark, sf_dir):
    return J.deletable(config_keys(spark, sf_dir), all_references(spark, sf_dir)).select("kind", "id")


@query("reverse_refs", """
SELECT entity_kind AS kind, entity_id AS id, id AS source_id FROM seed WHERE entity_id IS NOT NULL UNION ALL
SELECT 'crawlJob', job_a, id FROM seed UNION ALL SELECT 'crawlJob', job_b, id FROM seed WHERE job_b IS NOT NULL""")
def reverse_refs(spark, sf_dir):
    return J.reverse_refs(seed_object(spark, sf_dir))


@query("seeds_not_in_execution", """
SELECT id, name FROM seed s WHERE (job_a = 'job3' OR job_b = 'job3')
  AND id NOT IN (SELECT seed_id FROM crawl_execution WHERE job_execution_id = 'je3')""")
def seeds_not_in_execution(spark, sf_dir):
    rows = J.seeds_not_in_execution(seed_object(spark, sf_dir), crawl_execution(spark, sf_dir), "job3", "je3")
    return rows.select("id", F.col("meta.name").alias("name"))


def import_records(spark, sf_dir):
    """Import records: redirect targets of the seeds' hosts, with repeats and names."""
    return rowwise(spark, sf_dir, "seed").select(
        F.col("id").alias("record"), F.substring("id", 5, 20).cast("bigint").alias("pos"),
        F.regexp_replace(F.regexp_replace("name", "^https?", "http"), r"\.example\.com", ".example.net").alias("uri"),
        F.concat(F.lit("Entity "), F.substring("id", 5, 20).cast("bigint") % 90).alias("entity_name"), "balance")


_RECORDS = f"""{_SEED_KEY},
records AS (SELECT id AS record, cast(substring(id, 5) as bigint) AS pos, balance, concat('Entity ', cast(substring(id, 5) as bigint) % 90) AS entity_name,
  regexp_replace(regexp_replace(key, '^https?', 'http'), '\\.example\\.com', '.example.net') AS key,
  regexp_replace(regexp_replace(name, '^https?', 'http'), '\\.example\\.com', '.example.net') AS uri FROM seed JOIN seed_key USING (id)),
known AS (SELECT key, id FROM (SELECT record AS id, key FROM records WHERE balance = 'debt'))"""


def known_pairs(spark, sf_dir):
    from crawlatlas.functions.urls import url_key
    return import_records(spark, sf_dir).where("balance = 'debt'").select(
        url_key(F.col("uri")).alias("key"), F.col("record").alias("id"))


@query("import_new_seeds", f"""WITH {_RECORDS}
SELECT record, uri, key FROM records r WHERE key NOT IN (SELECT key FROM known)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1""")
def import_new_seeds(spark, sf_dir):
    return J.import_new_seeds(import_records(spark, sf_dir), known_pairs(spark, sf_dir), "pos").select("record", "uri", "key")


@query("import_entity_match", f"""WITH {_RECORDS},
first AS (SELECT name, min_by(id, cast(substring(id, 4) as bigint)) AS id FROM entity GROUP BY 1)
SELECT record, f.id IS NULL AS is_new, coalesce(f.id, regexp_replace(md5(entity_name), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')) AS entity_id
FROM records LEFT JOIN first f ON f.name = entity_name""")
def import_entity_match(spark, sf_dir):
    entities = rowwise(spark, sf_dir, "entity").withColumn("order", F.substring("id", 4, 20).cast("bigint"))
    records = import_records(spark, sf_dir).withColumn("entity_id", F.lit(None).cast("string"))
    return J.import_entity_match(records, entities).select("record", "is_new", "entity_id")


@query("import_existing_code", f"""WITH {_RECORDS}
SELECT key, record AS id, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.key = r.key AND k.id = r.record) THEN 'EXISTS'
  WHEN EXISTS (SELECT 1 FROM known k WHERE k.key = r.key) THEN 'NEW_ID' ELSE 'NEW_KEY' END AS code FROM records r""")
def import_existing_code(spark, sf_dir):
    from crawlatlas.functions.urls import url_key
    pairs = import_records(spark, sf_dir).select(url_key(F.col("uri")).alias("key"), F.col("record").alias("id"))
    return J.import_existing_code(pairs, known_pairs(spark, sf_dir)).select("key", "id", "code")


@query("convert_oos", f"""WITH {_RECORDS}
SELECT uri, uri AS "entityName", 'source:oos' AS labels, key FROM records WHERE key NOT IN (SELECT key FROM known)""")
def convert_oos(spark, sf_dir):
    lines = import_records(spark, sf_dir).select(F.col("uri").alias("value"))
    rows = J.convert_oos(lines, known_pairs(spark, sf_dir))
    return rows.select("uri", "entityName", "key", F.concat_ws(",", F.transform(
        "seedLabel", lambda e: F.concat_ws(":", e["key"], e["value"]))).alias("labels"))


def ip_ranges(spark, sf_dir):
    """Address ranges of host groups, one per supplier; some overlap."""
    n = F.col("s_suppkey")
    base = F.concat_ws(".", 10 + n % 4, n % 200, n % 50)
    return load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("grp"), F.lpad(n.cast("string"), 9, "0")).alias("config_id"),
        F.concat(base, F.lit(".1")).alias("ip_from"),
        F.concat_ws(".", 10 + n % 4, n % 200 + 1, n % 50, F.lit("77")).alias("ip_to"))


_SHA = "regexp_replace(sha1({0}), '^0+', '')"
_HOST_GROUP = f"""
ranges AS (SELECT concat('grp', lpad(cast(s_suppkey as varchar), 9, '0')) AS config_id,
  ((10 + s_suppkey % 4) * 16777216 + (s_suppkey % 200) * 65536 + (s_suppkey % 50) * 256 + 1) AS lo,
  ((10 + s_suppkey % 4) * 16777216 + (s_suppkey % 200 + 1) * 65536 + (s_suppkey % 50) * 256 + 77) AS hi FROM supplier),
ips AS (SELECT DISTINCT ip, cast(split_part(ip, '.', 1) as bigint) * 16777216 + cast(split_part(ip, '.', 2) as bigint) * 65536
  + cast(split_part(ip, '.', 3) as bigint) * 256 + cast(split_part(ip, '.', 4) as bigint) AS num FROM queued_uri WHERE ip IS NOT NULL),
grp AS (SELECT ip, (SELECT min(config_id) FROM ranges WHERE num BETWEEN lo AND hi) AS config_id FROM ips)"""


@query("host_group_range", f"""WITH {_HOST_GROUP}
SELECT q.id, CASE WHEN q.ip IS NULL THEN concat('TEMP_CHG_', {_SHA.format('host')})
  ELSE coalesce(g.config_id, {_SHA.format('q.ip')}) END AS host_group_id FROM queued_uri q LEFT JOIN grp g ON g.ip = q.ip""")
def host_group_range(spark, sf_dir):
    return J.host_groups(rowwise(spark, sf_dir, "queued_uri"), ip_ranges(spark, sf_dir)).select("id", "host_group_id")


@query("host_group_id", f"""
SELECT id, {_SHA.format('host')} AS host_group_id FROM queued_uri""")
def host_group_id(spark, sf_dir):
    return J.host_groups(rowwise(spark, sf_dir, "queued_uri"), ip_ranges(spark, sf_dir), use_hostname=True).select(
        "id", "host_group_id")


def page_rows(spark, sf_dir):
    r = rowwise(spark, sf_dir, "browser_request").where("idx = 0")
    return r.select(F.col("page_id").alias("warc_id"), F.col("url").alias("uri"))


@query("resource_of_page", """
SELECT r.page_id, p.url AS page_uri, r.url AS uri, r.from_cache FROM browser_request r
JOIN browser_request p ON p.page_id = r.page_id AND p.idx = 0 WHERE r.idx > 0 AND r.has_crawl_log""")
def resource_of_page(spark, sf_dir):
    resources = rowwise(spark, sf_dir, "browser_request").where("idx > 0 AND has_crawl_log").select(
        "page_id", F.col("url").alias("uri"), "from_cache")
    return J.resource_of_page(resources, page_rows(spark, sf_dir))


_BY_URL = "by_url AS (SELECT page_id, url, max(idx) AS idx, max_by(has_crawl_log, idx) AS logged FROM browser_request WHERE url <> '' GROUP BY 1, 2)"

_REDIRECT = f"""{_BY_URL},
linked AS (SELECT r.*, CASE WHEN r.redirected AND r.redirect_from_url <> '' AND p.idx <> r.idx THEN p.idx END AS parent_idx,
    CASE WHEN r.redirected AND r.redirect_from_url <> '' AND p.idx <> r.idx THEN p.logged END AS parent_logged
  FROM browser_request r LEFT JOIN by_url p ON p.page_id = r.page_id AND p.url = r.redirect_from_url)"""


@query("redirect_parent", f"""WITH RECURSIVE {_REDIRECT},
following AS (SELECT page_id, parent_idx AS pos, min(idx) AS nxt FROM linked WHERE idx > parent_idx GROUP BY 1, 2),
walk(page_id, pos, step) AS (SELECT page_id, idx, 0 FROM browser_request WHERE idx = 0
  UNION ALL SELECT w.page_id, f.nxt, step + 1 FROM walk w JOIN following f ON f.page_id = w.page_id AND f.pos = w.pos),
root AS (SELECT page_id, max_by(pos, step) AS root_idx FROM walk GROUP BY 1)
SELECT l.page_id, l.idx, l.parent_idx AS redirect_parent_idx, root_idx FROM linked l JOIN root USING (page_id)""")
def redirect_parent(spark, sf_dir):
    requests = rowwise(spark, sf_dir, "browser_request")
    roots = G.redirect_roots(requests)
    return G.redirect_parents(requests).select("page_id", "idx", "redirect_parent_idx").join(roots, "page_id")


@query("referrer_parent", f"""WITH {_BY_URL}
SELECT r.page_id, r.idx, p.idx AS referrer_parent_idx FROM browser_request r
LEFT JOIN by_url p ON p.page_id = r.page_id AND p.url = r.referrer""")
def referrer_parent(spark, sf_dir):
    return G.referrer_parents(rowwise(spark, sf_dir, "browser_request")).select("page_id", "idx", "referrer_parent_idx")


_QUEUE_PATH = "CASE WHEN seq % 3 = 0 THEN 'L' ELSE '' END"


@query("discovery_type", f"""WITH {_REDIRECT}
SELECT page_id, idx, CASE WHEN idx = 0 THEN {_QUEUE_PATH} WHEN initiator = 'script' THEN 'X'
  WHEN parent_idx IS NOT NULL OR redirected THEN 'R' ELSE 'E' END AS discovery_type FROM linked""")
def discovery_type(spark, sf_dir):
    requests = rowwise(spark, sf_dir, "browser_request").withColumn("queue_path", F.expr(_QUEUE_PATH))
    return G.redirect_parents(requests).select("page_id", "idx", G.discovery_type().alias("discovery_type"))


@query("discovery_path", f"""WITH RECURSIVE {_REDIRECT},
typed AS (SELECT l.page_id, l.idx, CASE WHEN l.idx = 0 THEN {_QUEUE_PATH} WHEN initiator = 'script' THEN 'X'
    WHEN parent_idx IS NOT NULL OR redirected THEN 'R' ELSE 'E' END AS t,
    CASE WHEN parent_logged THEN parent_idx WHEN p.logged THEN p.idx END AS parent
  FROM linked l LEFT JOIN by_url p ON p.page_id = l.page_id AND p.url = l.referrer WHERE l.has_crawl_log),
walk(page_id, idx, parent, path) AS (
  SELECT page_id, idx, CASE WHEN parent < idx THEN parent END, t FROM typed
  UNION ALL SELECT w.page_id, w.idx, CASE WHEN x.parent < x.idx THEN x.parent END, concat(x.t, w.path)
  FROM walk w JOIN typed x ON x.page_id = w.page_id AND x.idx = w.parent)
SELECT page_id, idx, max_by(path, length(path)) AS discovery_path FROM walk WHERE parent IS NULL GROUP BY 1, 2""")
def discovery_path(spark, sf_dir):
    requests = rowwise(spark, sf_dir, "browser_request").withColumn("queue_path", F.expr(_QUEUE_PATH))
    return G.discovery_paths(requests)


@query("request_merge", """
WITH o AS (SELECT page_id, concat(page_id, '-', idx % 3) AS request_id, * EXCLUDE (page_id, request_id) FROM browser_request)
SELECT page_id, request_id, min_by(url, seq) AS original_url, max_by(url, seq) AS url,
  min_by(resource_type, seq) AS resource_type, min_by(referrer, seq) FILTER (WHERE referrer <> '') AS referrer,
  min_by(redirect_from_url, seq) FILTER (WHERE redirected) AS redirect_from_url,
  bool_or(redirected) AS redirected, bool_or(got_new) AS got_new, bool_or(from_cache) AS from_cache
FROM o GROUP BY 1, 2""")
def request_merge(spark, sf_dir):
    seen = rowwise(spark, sf_dir, "browser_request").withColumn(
        "request_id", F.concat_ws("-", "page_id", F.col("idx") % 3))
    return G.merge_requests(seen).select(
        "page_id", "request_id", "original_url", "url", "resource_type", "referrer", "redirect_from_url",
        "redirected", "got_new", "from_cache")


@query("revisit_original", """
SELECT l.warc_id, l.warc_refers_to, o.requested_uri AS original_uri
FROM crawl_log l LEFT JOIN crawl_log o ON o.warc_id = l.warc_refers_to WHERE l.warc_refers_to <> ''""")
def revisit_original(spark, sf_dir):
    return J.revisit_original(rowwise(spark, sf_dir, "crawl_log")).select("warc_id", "warc_refers_to", "original_uri")


@query("script_selector_match", """
SELECT concat('bc', n_nationkey) AS config_id, f.id AS script_id FROM nation n JOIN config_flat f
ON lower(f.label_brand) = concat('brand#', n_nationkey)
  AND CASE n_nationkey % 3 WHEN 0 THEN f.label_size IS NOT NULL WHEN 1 THEN lower(f.label_type) LIKE 's%' ELSE f.label_size LIKE '1%' OR lower(f.label_type) LIKE '1%' END""")
def script_selector_match(spark, sf_dir):
    from crawlatlas.sources.derived import config_object
    n = F.col("n_nationkey")
    extra = F.when(n % 3 == 0, "size:").when(n % 3 == 1, "TYPE:S*").otherwise("1*")
    configs = load(spark, sf_dir, "nation").select(
        F.concat(F.lit("bc"), n).alias("config_id"),
        F.array(F.concat(F.lit("brand:Brand#"), n), extra, F.lit(":")).alias("script_selector"))
    scripts = config_object(spark, sf_dir).select(F.col("id").alias("script_id"), F.col("meta.label").alias("label"))
    return J.script_selector_match(configs, scripts)


@query("latest_execution_per_job", """
SELECT job_id, id, state, start_time FROM crawl_execution WHERE start_time IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC, id DESC) = 1""")
def latest_execution_per_job(spark, sf_dir):
    jobs = rowwise(spark, sf_dir, "crawl_job").select(F.col("id").alias("job_id"))
    latest = A.latest_per_job(crawl_execution(spark, sf_dir))
    return jobs.join(latest, "job_id").select("job_id", "id", "state", "start_time")
