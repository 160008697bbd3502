"""Queries over robots, DNS, failures, retries and limits."""

from pyspark.sql import functions as F

from crawlatlas.functions import robots as RX
from crawlatlas.functions import status as T
from crawlatlas.functions.labels import first_label
from crawlatlas.operators import dns as D
from crawlatlas.operators import robots as B
from crawlatlas.registry.base import query
from crawlatlas.session import materialize
from crawlatlas.sources.derived import crawl_execution, rowwise, seed_object
from crawlatlas.sources.tables import load

FRESH, RETRY = 86_400_000, 3_600_000

_SNAPSHOT = """rf AS (SELECT CASE WHEN collection = '' THEN 'unscoped' ELSE collection END AS collection, * EXCLUDE (collection) FROM robots_fetch),
ru AS (SELECT *, CASE WHEN http_status BETWEEN 200 AND 499 THEN seq END AS useq FROM rf),
snap AS (SELECT *, last_value(useq IGNORE NULLS) OVER (PARTITION BY collection, scheme, host, port ORDER BY fetched_at, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_seq FROM ru),
snapshots AS (SELECT s.collection, s.scheme, s.host, s.port, s.fetched_at, s.seq,
    CASE WHEN k.http_status BETWEEN 200 AND 299 THEN k.body END AS rules, coalesce(k.http_status BETWEEN 200 AND 299, false) AS has_rules,
    CASE WHEN s.http_status BETWEEN 200 AND 499 THEN s.fetched_at + 86400000 END AS fresh_until,
    CASE WHEN NOT s.http_status BETWEEN 200 AND 499 THEN s.fetched_at + 3600000 END AS retry_after
  FROM snap s LEFT JOIN robots_fetch k ON k.seq = s.last_seq)"""


def snapshots(spark, sf_dir):
    """The snapshot table, stored as it would be between runs."""
    return materialize(B.robots_snapshot(rowwise(spark, sf_dir, "robots_fetch"), FRESH, RETRY), "snapshots")


@query("robots_snapshot", f"WITH {_SNAPSHOT} SELECT * FROM snapshots")
def robots_snapshot(spark, sf_dir):
    return B.with_rules(snapshots(spark, sf_dir), rowwise(spark, sf_dir, "robots_fetch")).drop("rules_seq")


_REQUESTS = """rq AS (SELECT concat('r', lpad(cast(l_orderkey * 10 + l_linenumber as varchar), 12, '0'), '-', l_partkey, '-', l_suppkey, '-', cast(l_quantity as int), '-', cast(floor(l_extendedprice) as bigint)) AS request_id,
  CASE WHEN l_orderkey % 5 = 0 THEN 'unscoped' ELSE concat('coll', l_orderkey % 3) END AS collection,
  CASE WHEN l_orderkey % 4 = 0 THEN 'https' ELSE 'http' END AS scheme, concat('h', l_partkey % 60, '.example.com') AS host,
  CASE WHEN l_orderkey % 4 = 0 THEN 443 ELSE 80 END AS port, epoch_ms(l_shipdate) + l_linenumber * 1000 AS at_ms,
  concat('http://h', l_partkey % 60, '.example.com/p/', l_suppkey) AS uri FROM lineitem)"""


def robots_requests(spark, sf_dir):
    """URLs to check, one per line item."""
    order = F.col("l_orderkey")
    secure = order % 4 == 0
    return load(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.concat(F.lit("r"), F.lpad((order * 10 + F.col("l_linenumber")).cast("string"), 12, "0")), "l_partkey",
                    "l_suppkey", F.col("l_quantity").cast("int"), F.floor("l_extendedprice")).alias("request_id"),
        F.when(order % 5 == 0, "").otherwise(F.concat(F.lit("coll"), order % 3)).alias("collection"),
        F.when(secure, "https").otherwise("http").alias("scheme"),
        F.concat(F.lit("h"), F.col("l_partkey") % 60, F.lit(".example.com")).alias("host"),
        F.when(secure, 443).otherwise(80).alias("port"),
        (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 1000).alias("at"),
        F.concat(F.lit("http://h"), F.col("l_partkey") % 60, F.lit(".example.com/p/"), "l_suppkey").alias("uri"))


_ASOF = """found AS (SELECT rq.*, s.rules, s.has_rules, s.fetched_at, CASE WHEN s.fetched_at IS NULL THEN 'missing'
    WHEN at_ms < s.fresh_until THEN 'fresh' WHEN at_ms < s.retry_after THEN 'suppressed' ELSE 'stale' END AS state
  FROM rq ASOF LEFT JOIN (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY collection, scheme, host, port, fetched_at ORDER BY seq DESC) = 1) s
  ON rq.collection = s.collection AND rq.scheme = s.scheme AND rq.host = s.host AND rq.port = s.port AND rq.at_ms >= s.fetched_at)"""


@query("robots_asof", f"""WITH {_SNAPSHOT}, {_REQUESTS}, {_ASOF}
SELECT request_id, host, fetched_at, has_rules, state FROM found""")
def robots_asof(spark, sf_dir):
    return B.robots_asof(robots_requests(spark, sf_dir), snapshots(spark, sf_dir)).select(
        "request_id", "host", "fetched_at", "has_rules", "state")


_POLICY = "CASE hash_n WHEN 0 THEN 'IGNORE_ROBOTS' WHEN 1 THEN 'CUSTOM_ROBOTS' WHEN 2 THEN 'CUSTOM_IF_MISSING' ELSE 'OBEY_ROBOTS' END"


@query("robots_allowed", f"""WITH {_SNAPSHOT}, {_REQUESTS}, {_ASOF},
p AS (SELECT *, length(uri) % 5 AS hash_n, split_part(uri, 'example.com', 2) AS path, regexp_extract(rules, 'Disallow: (/p/[0-9])', 1) AS pre FROM found),
a AS (SELECT *, {_POLICY} AS policy, coalesce(has_rules, false) AS ruled, NOT (starts_with(path, pre) AND path <> concat(pre, '5')) AS by_rules,
  NOT starts_with(path, '/p/2') AS by_custom FROM p)
SELECT request_id, policy, CASE WHEN policy = 'OBEY_ROBOTS' AND state = 'suppressed' AND NOT ruled THEN NULL
  WHEN policy IN ('OBEY_ROBOTS', 'CUSTOM_IF_MISSING') AND ruled THEN by_rules
  WHEN policy IN ('CUSTOM_ROBOTS', 'CUSTOM_IF_MISSING') THEN by_custom ELSE true END AS allowed FROM a""")
def robots_allowed(spark, sf_dir):
    n = F.length("uri") % 5
    found = B.robots_asof(robots_requests(spark, sf_dir), snapshots(spark, sf_dir))
    rows = found.withColumn(
        "policy", F.when(n == 0, "IGNORE_ROBOTS").when(n == 1, "CUSTOM_ROBOTS").when(n == 2, "CUSTOM_IF_MISSING")
        .otherwise("OBEY_ROBOTS"))
    custom = "User-agent: crawler\nDisallow: /p/2*\n"
    return B.robots_allowed(rows, rowwise(spark, sf_dir, "robots_fetch"), "Crawler/1.0", F.col("policy"), custom).select("request_id", "policy", "allowed")


@query("robots_sitemaps", """
SELECT seq, regexp_extract(body, '(?m)^Sitemap: (\\S+)', 1) AS sitemap FROM robots_fetch WHERE http_status = 200""")
def robots_sitemaps(spark, sf_dir):
    f = rowwise(spark, sf_dir, "robots_fetch").where("http_status = 200")
    return f.select("seq", F.explode(RX.sitemaps(F.col("body"))).alias("sitemap"))


_DNS = """per AS (SELECT response_id, name, rcode, truncated, min(stored_at) AS stored_at,
    min(ttl) FILTER (WHERE rr_type <> 'OPT') AS pos,
    min(CASE WHEN rr_type = 'SOA' AND section = 'authority' THEN least(ttl, soa_minimum) ELSE ttl END) FILTER (WHERE rr_type <> 'OPT') AS neg,
    count(*) FILTER (WHERE rr_type = 'SOA' AND section = 'authority') > 0 AS soa, count(*) FILTER (WHERE section = 'answer') AS answers
  FROM dns_answer GROUP BY 1, 2, 3, 4),
life AS (SELECT *, CASE WHEN truncated THEN NULL WHEN rcode IN (2, 4) THEN 5
    WHEN rcode = 3 OR (rcode = 0 AND answers = 0 AND soa) THEN CASE WHEN soa THEN least(neg, 604800) END
    WHEN rcode = 0 THEN least(pos, 604800) END AS t FROM per)"""


def lifetimes(spark, sf_dir):
    return D.dns_expiry(rowwise(spark, sf_dir, "dns_answer"))


@query("dns_expiry", f"""WITH {_DNS}
SELECT response_id, name, rcode, answers, CASE WHEN t > 0 THEN t END AS lifetime_s,
  greatest(CASE WHEN t > 0 THEN t END - (883612800000 - least(stored_at, 883612800000)) // 1000, 0) AS aged_s FROM life""")
def dns_expiry(spark, sf_dir):
    rows = lifetimes(spark, sf_dir)
    aged = F.when(F.col("lifetime_s").isNull(), F.lit(0)).otherwise(
        D.aged_ttl(F.col("lifetime_s"), F.col("stored_at"), F.lit(883_612_800_000)))
    return rows.select("response_id", "name", "rcode", "answers", "lifetime_s", aged.alias("aged_s"))


@query("dns_archive_once", f"""WITH {_DNS}
SELECT DISTINCT a.collection, p.name, p.stored_at FROM per p JOIN dns_answer a ON a.response_id = p.response_id
WHERE p.rcode = 0 AND p.answers > 0""")
def dns_archive_once(spark, sf_dir):
    asked = rowwise(spark, sf_dir, "dns_answer").select("response_id", "collection")
    return D.dns_archive_once(lifetimes(spark, sf_dir).join(asked, "response_id"))


@query("dns_crawl_log", f"""WITH {_DNS}
SELECT DISTINCT concat('dns:', p.name) AS requested_uri, 'P' AS discovery_path, 1 AS status_code, 'text/dns' AS content_type,
  'resource' AS record_type, a.collection AS collection_final_name, p.stored_at AS fetch_time_stamp, 1710000000000 AS time_stamp
FROM per p JOIN dns_answer a ON a.response_id = p.response_id WHERE p.rcode = 0 AND p.answers > 0""")
def dns_crawl_log(spark, sf_dir):
    return D.dns_crawl_log(dns_archive_once(spark, sf_dir), 1_710_000_000_000)


@query("dns_outcome", "SELECT rcode, CASE rcode WHEN 0 THEN -10 WHEN 3 THEN -9 ELSE -1 END AS code, count(*) AS n FROM dns_answer GROUP BY ALL")
def dns_outcome(spark, sf_dir):
    return rowwise(spark, sf_dir, "dns_answer").groupBy("rcode").agg(F.count("*").alias("n")).select(
        "rcode", D.dns_outcome(F.col("rcode")).alias("code"), "n")


_TEXTS = ["dial tcp 10.0.0.1:443: i/o timeout", "lookup x: No such host", "Empty reply from server", "EOF",
          "read: connection reset by peer", "connect: connection refused", "ERR_CONNECT_FAIL 111",
          "ERR_ZERO_SIZE_OBJECT 0", "ERR_DNS_FAIL", "tls: handshake failure", "something else"]
_DETAIL = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS)) + " END"
_PHASE = "CASE user_id % 3 WHEN 0 THEN 'http-round-trip' WHEN 1 THEN 'connect-dial' ELSE 'other' END"


@query("failure_class", f"""
SELECT code, count(*) AS n FROM (SELECT CASE event_id % 11 WHEN 0 THEN -4 WHEN 1 THEN -6 WHEN 2 THEN -404
  WHEN 3 THEN CASE user_id % 3 WHEN 0 THEN -404 WHEN 1 THEN -2 ELSE -5 END WHEN 4 THEN -3 WHEN 5 THEN -2 WHEN 6 THEN -2
  WHEN 7 THEN -404 WHEN 8 THEN -5 ELSE CASE user_id % 3 WHEN 1 THEN -2 ELSE -5 END END AS code FROM events) GROUP BY 1""")
def failure_class(spark, sf_dir):
    rows = load(spark, sf_dir, "events").selectExpr(f"{_DETAIL} AS detail", f"{_PHASE} AS phase")
    return rows.select(T.failure_class(F.col("detail"), F.col("phase")).alias("code")).groupBy("code").agg(
        F.count("*").alias("n"))


_CODES = ", ".join(f"({c}, '{n}', {str(t).lower()})" for c, n, _, t in T.STATUS_CODES)


@query("status_class", f"""
WITH codes(code, name, temporary) AS (VALUES {_CODES})
SELECT id, error_code, name, temporary FROM queued_uri q LEFT JOIN codes c ON c.code = q.error_code""")
def status_class(spark, sf_dir):
    return T.status_class(rowwise(spark, sf_dir, "queued_uri"), "error_code").select("id", "error_code", "name", "temporary")


@query("retry_decision", """
WITH f AS (SELECT *, error_code BETWEEN -6 AND -1 AS temp, error_code BETWEEN -6 AND -1 AND retries + 1 < 3 AS again FROM queued_uri WHERE error_code <> 0)
SELECT id, CASE WHEN again THEN 'RETRY' ELSE 'COMPLETE' END AS outcome, retries + CASE WHEN temp THEN 1 ELSE 0 END AS new_retries,
  CASE WHEN again THEN 1705000060000 END AS earliest_fetch_ms, CASE WHEN again THEN NULL WHEN temp THEN -8 ELSE error_code END AS logged_code,
  CASE WHEN again THEN 0 ELSE 1 END AS documents_failed, CASE WHEN again THEN 1 ELSE 0 END AS documents_retried FROM f""")
def retry_decision(spark, sf_dir):
    failed = rowwise(spark, sf_dir, "queued_uri").where("error_code <> 0")
    return T.retry_decision(failed, F.lit(3), F.lit(60), F.lit(1_705_000_000_000)).select(
        "id", "outcome", "new_retries", "earliest_fetch_ms", "logged_code", "documents_failed", "documents_retried")


_NOW = "timestamp '2024-02-01 00:00:00'"


@query("limit_decision", f"""
SELECT e.id, CASE WHEN e.state NOT IN ('UNDEFINED', 'CREATED', 'FETCHING', 'SLEEPING') THEN e.state
  WHEN max_bytes > 0 AND bytes_crawled > max_bytes THEN 'ABORTED_SIZE'
  WHEN max_duration_s > 0 AND date_diff('second', created_time, {_NOW}) > max_duration_s THEN 'ABORTED_TIMEOUT' ELSE e.state END AS state
FROM crawl_execution e JOIN crawl_job j ON j.id = e.job_id""")
def limit_decision(spark, sf_dir):
    jobs = rowwise(spark, sf_dir, "crawl_job").select(F.col("id").alias("job_id"), "max_bytes", "max_duration_s")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", F.col("created_time"), now)
    return crawl_execution(spark, sf_dir).join(jobs, "job_id").select(
        "id", T.limit_decision(F.col("state"), F.col("bytes_crawled"), age, F.col("max_bytes"),
                               F.col("max_duration_s")).alias("state"))


@query("precondition_outcome", """
WITH r AS (SELECT *, cast(substring(id, 2) as bigint) AS n FROM queued_uri)
SELECT id, CASE WHEN n % 9 = 0 THEN 'COMPLETE' WHEN n % 4 = 0 THEN 'FETCH'
  WHEN n % 7 = 0 THEN CASE WHEN retries + 1 < 3 THEN 'RETRY' ELSE 'COMPLETE' END WHEN n % 11 = 0 THEN 'COMPLETE'
  WHEN n % 5 = 0 THEN 'COMPLETE' WHEN n % 2 = 0 THEN 'MOVE' ELSE 'FETCH' END AS outcome FROM r""")
def precondition_outcome(spark, sf_dir):
    n = F.substring("id", 2, 20).cast("bigint")
    dns = F.when(n % 7 == 0, -1).when(n % 11 == 0, -9).otherwise(0)
    retry = F.when((dns == -1) & (F.col("retries") + 1 < 3), "RETRY").otherwise("COMPLETE")
    allowed = F.when(n % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    allowed = F.when(n % 5 == 0, F.lit(False)).otherwise(allowed)
    return rowwise(spark, sf_dir, "queued_uri").select("id", T.precondition_outcome(
        n % 9 != 0, n % 4 != 0, dns, allowed, retry, n % 2 == 0).alias("outcome"))


@query("seed_outcome", """
SELECT q.id, CASE WHEN error_code <> 0 AND discovery_path = '' AND retries % 2 = 0 THEN CASE WHEN error_code = -9998 THEN 'FINISHED' ELSE 'FAILED' END
  ELSE 'FETCHING' END AS state FROM queued_uri q""")
def seed_outcome(spark, sf_dir):
    outcome = F.when(F.col("retries") % 2 == 0, "COMPLETE").otherwise("RETRY")
    return rowwise(spark, sf_dir, "queued_uri").select("id", T.seed_outcome(
        outcome, F.col("error_code"), F.col("discovery_path"), F.lit("FETCHING")).alias("state"))


@query("execution_timeout_at", """
SELECT e.id, CASE WHEN j.max_duration_s > 0 THEN created_time + to_seconds(j.max_duration_s) END AS timeout_at
FROM crawl_execution e JOIN crawl_job j ON j.id = e.job_id""")
def execution_timeout_at(spark, sf_dir):
    jobs = rowwise(spark, sf_dir, "crawl_job").select(F.col("id").alias("job_id"), "max_duration_s")
    return crawl_execution(spark, sf_dir).join(jobs, "job_id").select(
        "id", T.execution_timeout_at(F.col("created_time"), F.col("max_duration_s")).alias("timeout_at"))


@query("seed_type", "SELECT id, lower(coalesce(seed_type, 'url')) AS seed_type FROM seed")
def seed_type(spark, sf_dir):
    return seed_object(spark, sf_dir).select("id", first_label(F.col("meta.label"), "seed-type", "url").alias("seed_type"))
