"""Crawl tables derived from the given tables.

Row-wise tables are lists of ``(column, SQL expression)``. An expression that
differs between Spark and the checking engine is a pair ``(spark, other)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlatlas.sources.tables import load

_MS = ("unix_millis(cast(ts as timestamp))", "(epoch_us(ts) // 1000)")


def _minus(ms: int) -> tuple[str, str]:
    return tuple(f"{e} - {ms}" for e in _MS)


CRAWL_LOG = ("events", [
    ("warc_id", "concat('w', event_id)"),
    ("execution_id", "concat('ce', user_id, '_', event_id % 10)"),
    ("job_execution_id", "concat('je', user_id % 20)"),
    ("collection_final_name", "concat('coll', user_id % 3)"),
    ("status_code", "cast(case event_type when 'view' then 200 when 'click' then 301 when 'purchase' then 200 "
                    "when 'signup' then 404 else -4 end as int)"),
    ("size", "cast(floor(value * 1000) as bigint)"),
    ("fetch_time_ms", "cast(event_id % 997 as bigint)"),
    ("retries", "cast(event_id % 3 as int)"),
    ("requested_uri", "concat('http://h', user_id % 50, '.example.com/p/', event_id % 2000)"),
    ("response_uri", "concat('http://h', user_id % 50, '.example.com/p/', event_id % 2000)"),
    ("discovery_path", "case event_id % 4 when 0 then 'P' when 1 then 'L' when 2 then 'LR' else 'LRE' end"),
    ("referrer", "concat('http://h', user_id % 50, '.example.com/')"),
    ("content_type", "case event_type when 'view' then 'text/html; charset=utf-8' when 'click' then 'image/png' "
                     "when 'purchase' then 'application/json;v=1' when 'signup' then ';odd' else '' end"),
    ("block_digest", "concat('sha1:', sha1(concat('b', event_id % 900)))"),
    ("payload_digest", "case when event_id % 9 = 0 then '' else concat('sha1:', sha1(concat('p', event_id % 700))) end"),
    ("storage_ref", "concat('warcfile:coll', user_id % 3, '-', cast(floor(event_id / 100) as bigint), '.warc.gz:', "
                    "(event_id % 100) * 1000)"),
    ("record_type", "case when event_type = 'signup' then 'resource' else 'response' end"),
    ("warc_refers_to", "case when event_id % 6 = 0 then concat('w', cast(floor(event_id / 2) as bigint)) else '' end"),
    ("ip_address", "concat(10 + user_id % 4, '.', user_id % 256, '.', event_id % 256, '.', event_id % 7)"),
    ("method", "'GET'"),
    ("time_stamp", _MS),
    ("fetch_time_stamp", _minus(50)),
    ("error_code", "cast(case when event_type = 'error' then -4 else 0 end as int)"),
    ("error_msg", "case when event_type = 'error' then 'HTTP timeout' else '' end"),
    ("error_detail", "case when event_type = 'error' then concat('attempt ', event_id % 3) else '' end"),
])

_PAGE = "cast(floor(event_id / 8) as bigint)"
_SITE = f"concat('http://site', {_PAGE} % 40, '.example.com/')"

REQUEST = ("events", [
    ("page_id", f"concat('p', {_PAGE})"),
    ("idx", "cast(event_id % 8 as int)"),
    ("request_id", "concat('r', event_id)"),
    ("url", f"case when event_id % 8 = 0 then {_SITE} else concat({_SITE}, 'r', event_id % 5, '-', event_id % 8) end"),
    ("redirected", "event_type = 'click' and event_id % 8 > 0"),
    ("redirect_from_url", f"case when event_type = 'click' and event_id % 8 = 1 then {_SITE} "
                          f"when event_type = 'click' and event_id % 8 > 1 then "
                          f"concat({_SITE}, 'r', (event_id - 1) % 5, '-', (event_id - 1) % 8) else '' end"),
    ("referrer", f"case when event_id % 8 = 0 then '' when event_id % 8 < 4 or event_id % 3 = 0 then {_SITE} "
                 f"else concat({_SITE}, 'r', (event_id - 2) % 5, '-', (event_id - 2) % 8) end"),
    ("initiator", "case when event_type = 'view' then 'script' else 'parser' end"),
    ("resource_type", "case when event_id % 8 = 0 then 'Document' when event_type = 'view' then 'Script' "
                      "when event_type = 'click' then 'Image' when event_type = 'purchase' then 'XHR' "
                      "when event_type = 'signup' then 'Ping' else 'Stylesheet' end"),
    ("got_new", "event_type <> 'error' or event_id % 2 = 0"),
    ("got_complete", "event_id % 3 > 0"),
    ("from_cache", "event_id % 4 = 0"),
    ("has_crawl_log", "event_type <> 'signup'"),
    ("warc_id", "case when event_type = 'signup' or event_id % 5 = 0 then '' else concat('w', event_id) end"),
    ("status_code", "cast(case event_type when 'error' then -4 when 'click' then 302 else 200 end as int)"),
    ("size", "cast(floor(value * 1000) as bigint)"),
    ("content_type", "case event_type when 'click' then 'image/png' else 'text/html' end"),
    ("method", "'GET'"),
    ("error_code", "cast(case when event_type = 'error' then -4 else 0 end as int)"),
    ("seq", "event_id"),
])

EXECUTION_CHANGE = ("events", [
    ("execution_id", "concat('ce', user_id, '_', event_id % 10)"),
    ("job_execution_id", "concat('je', user_id % 20)"),
    ("seq", "event_id"),
    ("state", "case when event_type = 'view' then 'FETCHING' when event_type = 'click' then 'SLEEPING' "
              "when event_type = 'error' and event_id % 3 = 0 then 'FINISHED' "
              "when event_type = 'error' and event_id % 3 = 1 then 'ABORTED_MANUAL' "
              "when event_type = 'signup' and event_id % 7 = 0 then 'FAILED' "
              "when event_type = 'signup' and event_id % 7 = 1 then 'CREATED' else 'UNDEFINED' end"),
    ("change_time", "ts"),
    ("end_time", "case when event_type = 'error' and event_id % 3 < 2 and event_id % 5 > 0 then ts "
                 "when event_type = 'purchase' and event_id % 11 = 0 then ts else null end"),
    ("add_documents_crawled", "cast(event_id % 3 as bigint)"),
    ("add_bytes_crawled", "cast(floor(value * 1000) as bigint)"),
    ("add_uris_crawled", "cast(1 + event_id % 2 as bigint)"),
    ("add_documents_failed", "cast(case when event_type = 'error' then 1 else 0 end as bigint)"),
    ("add_documents_out_of_scope", "cast(case when event_id % 5 = 0 then 1 else 0 end as bigint)"),
    ("add_documents_retried", "cast(case when event_id % 11 = 0 then 1 else 0 end as bigint)"),
    ("add_documents_denied", "cast(case when event_id % 13 = 0 then 1 else 0 end as bigint)"),
    ("error_code", "cast(case when event_type = 'error' then -4 - event_id % 3 else null end as int)"),
])

QUEUED_URI = ("events", [
    ("id", "concat('q', event_id)"),
    ("execution_id", "concat('ce', user_id, '_', event_id % 10)"),
    ("job_execution_id", "concat('je', user_id % 20)"),
    ("uri", "concat('http://h', user_id % 50, '.example.com/p/', event_id % 2000)"),
    ("host", "concat('h', user_id % 50, '.example.com')"),
    ("ip", "case when event_id % 10 = 9 then null else concat(10 + user_id % 4, '.', user_id % 256, '.', "
           "user_id % 50, '.', user_id % 7) end"),
    ("discovery_path", "case event_id % 5 when 0 then '' when 1 then 'L' when 2 then 'LL' when 3 then 'LR' else 'RLERLR' end"),
    ("referrer", "concat('http://h', user_id % 50, '.example.com/')"),
    ("crawl_host_group_id", "concat('chg', user_id % 50)"),
    ("sequence", "cast(event_id % 100 as bigint)"),
    ("page_fetch_time_ms", "cast((event_id * 37) % 45000 as bigint)"),
    ("retries", "cast(event_id % 5 as int)"),
    ("earliest_fetch", _MS),
    ("fetch_started", "event_type = 'purchase' and event_id % 9 = 0"),
    ("priority_weight", "cast(1 + event_id % 4 as double)"),
    ("error_code", "cast(case when event_type = 'error' then -1 - event_id % 10 when event_type = 'signup' then -5001 "
                   "when event_type = 'click' and event_id % 4 = 0 then -9998 else 0 end as int)"),
])

SEED = ("customer", [
    ("id", "concat('seed', c_custkey)"),
    ("name", "concat(case when c_custkey % 4 = 0 then 'https' else 'http' end, '://', "
             "case when c_custkey % 2 = 0 then 'WWW.' else 'www.' end, lower(c_mktsegment), c_custkey % 400, "
             "'.example.com', case c_custkey % 3 when 0 then '' when 1 then '/' else '/a?q=1#top' end)"),
    ("description", "case when c_custkey % 5 = 0 then null else concat('seed of ', c_name) end"),
    ("entity_id", "case when c_custkey % 50 = 7 then null else concat('ent', c_custkey % 120) end"),
    ("entity_kind", "case when c_custkey % 50 = 7 then null when c_custkey % 50 = 8 then 'crawlJob' else 'crawlEntity' end"),
    ("job_a", "concat('job', c_nationkey)"),
    ("job_b", "case when c_custkey % 3 = 0 then concat('job', c_custkey % 30) else null end"),
    ("disabled", "case when c_custkey % 10 = 0 then true when c_custkey % 10 = 1 then false else null end"),
    ("segment", "c_mktsegment"),
    ("balance", "case when c_acctbal < 0 then 'debt' else 'credit' end"),
    ("seed_type", "case when c_custkey % 6 = 0 then 'SOCIAL' when c_custkey % 6 = 1 then 'url' else null end"),
])

ENTITY = ("supplier", [
    ("id", "concat('ent', s_suppkey)"),
    ("name", "concat('Entity ', s_suppkey % 60)"),
    ("description", "case when s_suppkey % 4 = 0 then null else concat('nation ', s_nationkey) end"),
    ("job_override", "case when s_suppkey % 3 = 0 then concat('e', s_suppkey % 9) else null end"),
])

JOB = ("nation", [
    ("id", "concat('job', n_nationkey)"),
    ("name", "concat('Job ', n_name)"),
    ("schedule_id", "case when n_nationkey % 6 = 5 then null else concat('sch', n_regionkey) end"),
    ("crawl_config_id", "case when n_nationkey = 11 then null when n_nationkey = 12 then 'cc99' else concat('cc', n_regionkey) end"),
    ("scope_script_id", "concat('scr', n_nationkey % 4)"),
    ("disabled", "n_nationkey % 7 = 0"),
    ("max_duration_s", "cast(case when n_nationkey % 3 = 0 then 0 else 86400 * n_nationkey end as bigint)"),
    ("max_bytes", "cast(case when n_nationkey % 2 = 0 then 0 else 200000 * n_nationkey end as bigint)"),
])

SCHEDULE = ("region", [
    ("id", "concat('sch', r_regionkey)"),
    ("cron", "case when r_regionkey = 3 then '' else concat(r_regionkey, ' * * * *') end"),
    ("valid_from", ("case when r_regionkey = 1 then timestamp_ntz'2024-02-01 00:00:00' else null end",
                    "case when r_regionkey = 1 then timestamp '2024-02-01 00:00:00' else null end")),
    ("valid_to", ("case when r_regionkey = 2 then timestamp_ntz'2024-01-10 00:00:00' else null end",
                  "case when r_regionkey = 2 then timestamp '2024-01-10 00:00:00' else null end")),
])

CRAWL_CONFIG = ("region", [
    ("id", "concat('cc', r_regionkey)"),
    ("name", "concat('Config ', r_name)"),
    ("collection_id", "concat('col', r_regionkey % 3)"),
    ("browser_config_id", "concat('bc', r_regionkey % 2)"),
    ("politeness_id", "case when r_regionkey = 4 then 'pol9' else concat('pol', r_regionkey % 2) end"),
    ("priority_weight", "cast(1 + r_regionkey as double)"),
])

CONFIG_OBJECT = ("part", [
    ("id", "concat('part', p_partkey)"),
    ("kind", "case p_size % 3 when 0 then 'seed' when 1 then 'crawlJob' else 'browserScript' end"),
    ("name", "concat(p_name, ' ', p_partkey)"),
    ("description", "case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then '' else p_type end"),
    ("label_brand", "p_brand"),
    ("label_type", "p_type"),
    ("label_size", "case when p_size % 2 = 0 then concat(p_size, '') else null end"),
    ("disabled", "case p_partkey % 5 when 0 then true when 1 then false else null end"),
    ("size", "p_size"),
    ("created", ("timestampadd(DAY, p_size, timestamp_ntz'2024-01-01 00:00:00')",
                 "timestamp '2024-01-01 00:00:00' + to_days(p_size)")),
])

_H = "concat('h', user_id % 50, '.example.com')"

SCOPE_CHECK = ("events", [
    ("id", "event_id"),
    ("kind", "event_id % 6"),
    ("uri", f"case event_id % 6 when 0 then concat('http://', {_H}, '/p/', event_id % 200) "
            f"when 1 then concat('https://sub.', {_H}, '/a b/', event_id % 200, '?q=2&b=1&sid=', event_id % 7, '#top') "
            f"when 2 then concat('ftp://', {_H}, '/pub') "
            f"when 3 then concat('http://other', user_id % 4, '.example.org/x//', event_id % 9) "
            f"when 4 then concat('HTTP://user@', {_H}, ':80/p/./', event_id % 200) "
            f"else (case when event_id % 12 = 5 then 'http://' else concat('//', {_H}, '/q?z') end) end"),
    ("seed_uri", f"concat('http://www.', {_H}, '/')"),
    ("discovery_path", "case event_id % 5 when 0 then '' when 1 then 'L' when 2 then 'LLR' when 3 then 'LLL' else 'RLERLR' end"),
    ("referrer", "case event_id % 3 when 0 then ' http://ref.example.com/ ' else concat('http://REF', user_id % 3) end"),
    ("p_schemes", "case when event_id % 7 = 0 then 'HTTPS' else 'https HTTP' end"),
    ("p_subs", "case when event_id % 3 = 0 then 'no' when event_id % 3 = 1 then 'Yes' else 'true' end"),
    ("p_alt", "case when event_id % 4 = 3 then concat('http://other', event_id % 2, '.example.org ', 'http://x.org') else '' end"),
    ("p_hops", "case when event_id % 41 = 0 then null when event_id % 43 = 0 then 'many' else '2' end"),
    ("p_redirects", "case when event_id % 2 = 0 then 'ok' else 'false' end"),
    ("p_excluded", "'h3.example.com/p/12 http://h5.example.com/p/../p/105'"),
])

CRAWLED = ("documents", [
    ("record_id", "concat('d', doc_id)"),
    ("collection", "source"),
    ("digest", "case when doc_id % 50 = 0 then '' else concat('sha1:', sha1(text)) end"),
    ("block_digest", "case when doc_id % 100 = 0 then '' else concat('sha1:', sha1(concat('b', text))) end"),
    ("seq", "doc_id"),
    ("uri", "concat('http://docs.example.org/', doc_id)"),
    ("record_type", "case when doc_id % 20 = 3 then 'metadata' when doc_id % 2 = 0 then 'response' else 'resource' end"),
])

ROBOTS_FETCH = ("orders", [
    ("collection", "case when o_orderkey % 5 = 0 then '' else concat('coll', o_orderkey % 3) end"),
    ("scheme", "case when o_orderkey % 4 = 0 then 'https' else 'http' end"),
    ("host", "concat('h', o_custkey % 50, '.example.com')"),
    ("port", "cast(case when o_orderkey % 4 = 0 then 443 else 80 end as int)"),
    ("fetched_at", ("unix_millis(cast(o_orderdate as timestamp)) + o_orderkey % 86400000",
                    "epoch_ms(o_orderdate) + o_orderkey % 86400000")),
    ("http_status", "cast(case o_orderkey % 7 when 0 then 404 when 1 then 503 when 2 then 301 when 3 then -1 else 200 end as int)"),
    ("body", "concat('User-agent: *', chr(10), 'Disallow: /p/', o_orderkey % 10, chr(10), 'Allow: /p/', o_orderkey % 10, "
             "'5$', chr(10), 'Sitemap: https://h.example.com/s', o_orderkey % 10, '.xml', chr(10))"),
    ("seq", "o_orderkey"),
])

DNS_ANSWER = ("orders", [
    ("response_id", "concat('n', cast(floor(o_orderkey / 3) as bigint))"),
    ("name", "concat('h', cast(floor(o_orderkey / 3) as bigint) % 50, '.example.com')"),
    ("section", "case o_orderkey % 3 when 0 then 'answer' when 1 then 'authority' else 'additional' end"),
    ("rr_type", "case o_orderkey % 3 when 0 then 'A' when 1 then 'SOA' else (case when o_orderkey % 4 = 0 then 'OPT' else 'A' end) end"),
    ("rcode", "cast(case cast(floor(o_orderkey / 3) as bigint) % 11 when 0 then 3 when 1 then 2 when 2 then 5 else 0 end as int)"),
    ("ttl", "cast(case when o_orderkey % 17 = 0 then 0 else (o_orderkey * 7919) % 900000 end as bigint)"),
    ("soa_minimum", "cast(case when o_orderkey % 3 = 1 then 30 + o_orderkey % 600 else null end as bigint)"),
    ("truncated", "cast(floor(o_orderkey / 3) as bigint) % 13 = 0"),
    ("stored_at", ("unix_millis(cast(o_orderdate as timestamp))", "epoch_ms(o_orderdate)")),
    ("collection", "concat('coll', o_custkey % 3)"),
    ("data", "concat('10.0.', o_orderkey % 256, '.', o_custkey % 256)"),
])

ROWWISE = {
    "crawl_log": CRAWL_LOG,
    "browser_request": REQUEST,
    "execution_change": EXECUTION_CHANGE,
    "queued_uri": QUEUED_URI,
    "seed": SEED,
    "entity": ENTITY,
    "crawl_job": JOB,
    "schedule": SCHEDULE,
    "crawl_config": CRAWL_CONFIG,
    "config_flat": CONFIG_OBJECT,
    "scope_check": SCOPE_CHECK,
    "crawled": CRAWLED,
    "robots_fetch": ROBOTS_FETCH,
    "dns_answer": DNS_ANSWER,
}


def derive(base: DataFrame, name: str) -> DataFrame:
    """A row-wise table from its base, which may be a stream."""
    return base.selectExpr(*[f"{e[0] if isinstance(e, tuple) else e} AS {c}" for c, e in ROWWISE[name][1]])


def rowwise(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(load(spark, sf_dir, ROWWISE[name][0]), name)


def rowwise_sql(name: str) -> str:
    base, columns = ROWWISE[name]
    exprs = ", ".join(f"{e[1] if isinstance(e, tuple) else e} AS {c}" for c, e in columns)
    return f"SELECT {exprs} FROM {base}"


def scope_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate URLs with their parameters as a map."""
    c = derive(load(spark, sf_dir, "events").select("event_id", "user_id"), "scope_check")
    names = {"scope_allowedSchemes": "p_schemes", "scope_includeSubdomains": "p_subs", "scope_altSeeds": "p_alt",
             "scope_maxHopsFromSeed": "p_hops", "scope_hopsIncludeRedirects": "p_redirects",
             "scope_excludedUris": "p_excluded"}
    entries = F.array_compact(F.array(*[
        F.when(F.col(v).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(v).alias("value"))) for k, v in names.items()]))
    return c.select("id", "kind", "uri", "seed_uri", "discovery_path", "referrer",
                    F.map_from_entries(entries).alias("annotation"))


def crawl_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per execution: states vary by its newest event, counters are sums."""
    e = load(spark, sf_dir, "events")
    k = F.max("event_id")
    grouped = e.groupBy("user_id", (F.col("event_id") % 10).alias("part")).agg(
        k.alias("k"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(F.col("event_id") % 3).alias("documents_crawled"),
        F.sum(F.floor(F.col("value") * 1000).cast("bigint")).alias("bytes_crawled"),
        F.count("*").alias("uris_crawled"),
        F.count_if(F.col("event_type") == "error").alias("documents_failed"),
        F.count_if(F.col("event_id") % 5 == 0).alias("documents_out_of_scope"),
        F.count_if(F.col("event_id") % 11 == 0).alias("documents_retried"),
        F.count_if(F.col("event_id") % 13 == 0).alias("documents_denied"),
    )
    return grouped.selectExpr(*[f"{x} AS {c}" for c, x in EXECUTION_COLUMNS])


EXECUTION_COLUMNS = [
    ("id", "concat('ce', user_id, '_', part)"),
    ("job_execution_id", "concat('je', user_id % 20)"),
    ("job_id", "concat('job', user_id % 5)"),
    ("seed_id", "concat('seed', user_id)"),
    ("state", "case k % 8 when 0 then 'FINISHED' when 1 then 'FETCHING' when 2 then 'SLEEPING' when 3 then 'CREATED' "
              "when 4 then 'ABORTED_MANUAL' when 5 then 'FAILED' when 6 then 'ABORTED_SIZE' else 'UNDEFINED' end"),
    ("desired_state", "case k % 5 when 0 then 'ABORTED_MANUAL' when 1 then 'ABORTED_TIMEOUT' else null end"),
    ("created_time", "first_ts"),
    ("start_time", "case when k % 8 in (3, 7) then null else first_ts end"),
    ("end_time", "case when k % 8 in (0, 4, 5, 6) and k % 3 > 0 then last_ts else null end"),
    ("last_change_time", "last_ts"),
    ("error_code", "cast(case when k % 8 = 5 then -5 else null end as int)"),
    ("documents_crawled", "documents_crawled"),
    ("bytes_crawled", "bytes_crawled"),
    ("uris_crawled", "uris_crawled"),
    ("documents_failed", "documents_failed"),
    ("documents_out_of_scope", "documents_out_of_scope"),
    ("documents_retried", "documents_retried"),
    ("documents_denied", "documents_denied"),
]

JOB_EXECUTION_COLUMNS = [
    ("id", "concat('je', je)"),
    ("job_id", "concat('job', je % 5)"),
    ("state", "case je % 5 when 0 then 'RUNNING' when 1 then 'FINISHED' when 2 then 'ABORTED_MANUAL' "
              "when 3 then 'RUNNING' else 'FAILED' end"),
    ("desired_state", "case when je % 10 = 3 then 'ABORTED_MANUAL' else null end"),
    ("start_time", "first_ts"),
    ("end_time", "case when je % 5 in (1, 4) then last_ts else null end"),
]

# The same aggregates for the checking engine.
AGGREGATED_SQL = {
    "crawl_execution": "SELECT " + ", ".join(f"{x} AS {c}" for c, x in EXECUTION_COLUMNS) + """ FROM (
        SELECT user_id, event_id % 10 AS part, max(event_id) AS k, min(ts) AS first_ts, max(ts) AS last_ts,
          cast(sum(event_id % 3) as bigint) AS documents_crawled,
          cast(sum(cast(floor(value * 1000) as bigint)) as bigint) AS bytes_crawled,
          count(*) AS uris_crawled,
          count(*) FILTER (WHERE event_type = 'error') AS documents_failed,
          count(*) FILTER (WHERE event_id % 5 = 0) AS documents_out_of_scope,
          count(*) FILTER (WHERE event_id % 11 = 0) AS documents_retried,
          count(*) FILTER (WHERE event_id % 13 = 0) AS documents_denied
        FROM events GROUP BY 1, 2)""",
    "job_execution": "SELECT " + ", ".join(f"{x} AS {c}" for c, x in JOB_EXECUTION_COLUMNS) + """ FROM (
        SELECT user_id % 20 AS je, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1)""",
    "link": r"""SELECT page_id, url AS page_url, lang_path, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site,
          unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href
        FROM (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://[^/?#]*(/[a-z]+)/', 1) AS lang_path FROM pages)""",
}


def job_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    grouped = e.groupBy((F.col("user_id") % 20).alias("je")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.selectExpr(*[f"{x} AS {c}" for c, x in JOB_EXECUTION_COLUMNS])


def key_values(*pairs) -> F.Column:
    """Array of key/value structs from (key, value column) pairs, absent values dropped."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.filter(entries, lambda e: e["value"].isNotNull())


def config_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested configuration documents with labels and a one-of spec."""
    f = rowwise(spark, sf_dir, "config_flat")
    return f.select(
        "id",
        F.lit("v1").alias("apiVersion"),
        "kind",
        F.struct(
            "name", "description", "created",
            F.lit("importer").alias("createdBy"),
            F.col("created").alias("lastModified"),
            F.lit("importer").alias("lastModifiedBy"),
            key_values(("Brand", F.col("label_brand")), ("type", F.col("label_type")),
                       ("size", F.col("label_size"))).alias("label"),
            key_values(("scope_maxHopsFromSeed", F.col("size").cast("string"))).alias("annotation"),
        ).alias("meta"),
        F.when(F.col("kind") == "seed", F.struct(
            F.struct(F.lit("crawlEntity").alias("kind"), F.concat(F.lit("ent"), F.col("size")).alias("id")).alias("entityRef"),
            F.array(F.struct(F.lit("crawlJob").alias("kind"), F.concat(F.lit("job"), F.col("size") % 25).alias("id"))).alias("jobRef"),
            F.col("disabled"),
        )).alias("seed"),
        F.when(F.col("kind") == "crawlJob", F.struct(
            F.struct(F.lit("crawlScheduleConfig").alias("kind"), F.concat(F.lit("sch"), F.col("size") % 5).alias("id")).alias("scheduleRef"),
            F.struct((F.col("size") * 100).cast("bigint").alias("maxDurationS"), F.lit(0).cast("bigint").alias("maxBytes")).alias("limits"),
            F.col("disabled"),
        )).alias("crawlJob"),
    )


def seed_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds as nested documents."""
    s = rowwise(spark, sf_dir, "seed")
    job_refs = F.filter(
        F.array(*[F.struct(F.lit("crawlJob").alias("kind"), F.col(c).alias("id")) for c in ("job_a", "job_b")]),
        lambda r: r["id"].isNotNull())
    return s.select(
        "id", F.lit("v1").alias("apiVersion"), F.lit("seed").alias("kind"),
        F.struct("name", "description",
                 key_values(("segment", F.col("segment")), ("balance", F.col("balance")),
                            ("seed-type", F.col("seed_type"))).alias("label")).alias("meta"),
        F.struct(
            F.when(F.col("entity_id").isNotNull(),
                   F.struct(F.col("entity_kind").alias("kind"), F.col("entity_id").alias("id"))).alias("entityRef"),
            job_refs.alias("jobRef"), "disabled").alias("seed"),
    )
