"""Queries over scope rules and script parameters."""

from pyspark.sql import functions as F

from crawlatlas.operators import parameters as P
from crawlatlas.operators import scope as S
from crawlatlas.registry.base import query
from crawlatlas.sources.derived import rowwise, scope_candidates

_HOST = "regexp_extract(uri, '^(?:[A-Za-z]+:)?//(?:[^@/]*@)?([^/:?#]*)', 1)"
_F = f"""f AS (SELECT *, kind = 5 AND id % 12 = 5 AS bad,
  CASE WHEN lower(split_part(uri, ':', 1)) IN ('http', 'https', 'ftp') THEN lower(split_part(uri, ':', 1)) ELSE 'http' END AS scheme,
  {_HOST} AS host, regexp_extract(seed_uri, '://www\\.([^/]*)', 1) AS anchor,
  length(CASE WHEN p_redirects = 'ok' THEN discovery_path ELSE replace(discovery_path, 'R', '') END) AS hops FROM scope_check),
g AS (SELECT *, contains(concat(' ', lower(p_schemes), ' '), concat(' ', scheme, ' ')) AS scheme_ok,
  host = concat('www.', anchor) OR (p_subs <> 'no' AND (host = anchor OR ends_with(host, concat('.', anchor))))
   OR (p_alt <> '' AND (host = concat('other', id % 2, '.example.org') OR host = 'x.org')) AS host_ok,
  hops > try_cast(p_hops as bigint) AS too_deep,
  (kind IN (0, 4) AND ((host = 'h3.example.com' AND id % 200 = 12) OR (host = 'h5.example.com' AND id % 200 = 105))) AS excluded
  FROM f)"""


def _match(key, sql, rule):
    @query(key, f"WITH {_F} SELECT id, CASE WHEN NOT bad THEN {sql} END AS match FROM g")
    def run(spark, sf_dir):
        return S.matches(scope_candidates(spark, sf_dir), rule).select("id", "match")
    return run


_match("scope_is_scheme", "scheme_ok", S.is_scheme(S.param("scope_allowedSchemes")))
_match("scope_is_referrer", "trim(referrer) = 'http://ref.example.com/'", S.is_referrer("HTTP://ref.EXAMPLE.com/ http://REF1"))
_match("scope_same_host", "host_ok", S.is_same_host(S.param("scope_includeSubdomains"), S.param("scope_altSeeds")))
_match("scope_max_hops", "CASE WHEN p_hops IS NOT NULL THEN coalesce(too_deep, false) END",
       S.max_hops_from_seed(S.param("scope_maxHopsFromSeed"), S.param("scope_hopsIncludeRedirects")))
_match("scope_is_url", "excluded", S.is_url(S.param("scope_excludedUris")))
_match("scope_path_prefix", "kind IN (0, 1, 4) AND (kind = 1 OR starts_with(cast(id % 200 as varchar), '1'))",
       S.is_path_prefix("/a%20b /p/1"))
_match("scope_test", "p_subs <> 'no'", S.test(S.param("scope_includeSubdomains")))


@query("scope_remove_query", f"""WITH {_F}
SELECT id, kind = 1 AS match, CASE WHEN kind = 1 THEN 'b=1&q=2' WHEN kind = 5 AND NOT bad THEN 'z' WHEN NOT bad THEN '' END AS query FROM g""")
def scope_remove_query(spark, sf_dir):
    rows = S.with_canonical(scope_candidates(spark, sf_dir))
    c = S.Candidate()
    S.remove_query("sid").change(c)
    return rows.select("id", F.coalesce(c.href.endswith("?b=1&q=2"), F.lit(False)).alias("match"), c.query.alias("query"))


_REASON = """CASE WHEN bad THEN -7 WHEN NOT scheme_ok THEN -5001 WHEN NOT host_ok THEN -5001
  WHEN p_hops IS NULL THEN -5 WHEN coalesce(too_deep, false) THEN -4001 WHEN excluded THEN -5001 ELSE 0 END"""


@query("scope_default", f"""WITH {_F}
SELECT id, CASE WHEN {_REASON} = 0 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS evaluation, {_REASON} AS exclude_reason FROM g""")
def scope_default(spark, sf_dir):
    return S.scope_decide(scope_candidates(spark, sf_dir), S.scope_default()).select("id", "evaluation", "exclude_reason")


@query("scope_decide", f"""WITH {_F}
SELECT id, CASE WHEN bad THEN -7 WHEN kind = 2 THEN -4000 WHEN host_ok AND kind = 1 THEN -5002 WHEN host_ok THEN 0
   ELSE -5001 END AS exclude_reason,
  CASE WHEN bad THEN 'error parsing uri' WHEN kind = 2 OR host_ok THEN NULL ELSE 'No scope rules matched' END AS error_msg FROM g""")
def scope_decide(spark, sf_dir):
    rules = [
        S.is_scheme("ftp").then(S.CHAFF_DETECTION),
        S.is_same_host(S.param("scope_includeSubdomains"), S.param("scope_altSeeds")).then(S.INCLUDE, proceed=True),
        S.is_scheme("http").abort(),
        S.when_status(S.INCLUDE).then(S.BLOCKED_BY_CUSTOM_PROCESSOR),
    ]
    return S.scope_decide(scope_candidates(spark, sf_dir), rules).select("id", "exclude_reason", "error_msg")


@query("scope_outcomes", f"WITH {_F} SELECT {_REASON} AS exclude_reason, count(*) AS n FROM g GROUP BY 1")
def scope_outcomes(spark, sf_dir):
    return S.scope_outcomes(S.scope_decide(scope_candidates(spark, sf_dir), S.scope_default()))


@query("scope_log_filter", f"""WITH {_F}, o AS (SELECT id, {_REASON} AS exclude_reason FROM g)
SELECT id, exclude_reason, 'log' AS target FROM o WHERE exclude_reason NOT IN (0, -5001, -4001)
UNION ALL SELECT id, exclude_reason, 'oos' FROM o WHERE exclude_reason <> 0""")
def scope_log_filter(spark, sf_dir):
    log, oos = S.scope_log_filter(S.scope_decide(scope_candidates(spark, sf_dir), S.scope_default()))
    columns = ["id", "exclude_reason"]
    return (log.select(*columns, F.lit("log").alias("target"))
            .unionAll(oos.select(*columns, F.lit("oos").alias("target"))))


@query("udf_scope_rule", f"""WITH {_F}
SELECT id, CASE WHEN bad THEN -7 WHEN host LIKE 'other%' THEN -5002 WHEN kind = 2 THEN -5001 ELSE 0 END AS exclude_reason FROM g""")
def udf_scope_rule(spark, sf_dir):
    def no_other_sites(batch):
        status = batch["host"].str.startswith("other").map({True: S.BLOCKED_BY_CUSTOM_PROCESSOR, False: S.INCLUDE})
        return status.where(batch["path"] != "/pub")  # no rule for these

    return S.scope_user_rule(scope_candidates(spark, sf_dir), no_other_sites).select("id", "exclude_reason")


@query("udf_parameters", f"""WITH {_F}
SELECT id, CASE WHEN bad THEN -7 WHEN try_cast(p_hops as int) IS NULL THEN -5001 WHEN length(discovery_path) > try_cast(p_hops as int) THEN -4001 ELSE 0 END AS exclude_reason FROM g""")
def udf_parameters(spark, sf_dir):
    import pandas as pd

    def by_parameter(batch):
        hops = pd.to_numeric(batch["annotation"].map(lambda a: dict(a).get("scope_maxHopsFromSeed")), errors="coerce")
        deep = batch["discovery_path"].str.len() > hops
        return deep.map({True: S.TOO_MANY_HOPS, False: S.INCLUDE}).where(hops.notna())

    return S.scope_user_rule(scope_candidates(spark, sf_dir), by_parameter).select("id", "exclude_reason")


@query("resolve_parameters", """
WITH ann AS (
  SELECT id AS job_id, 1 AS source, 'scope_a' AS key, scope_script_id AS value FROM crawl_job
  UNION ALL SELECT id, 1, 'scope_b', 'b0' FROM crawl_job UNION ALL SELECT id, 3, 'scope_b', 'b1' FROM crawl_job WHERE schedule_id IS NOT NULL
  UNION ALL SELECT id, 4, 'scope_a', name FROM crawl_job WHERE max_bytes > 0 UNION ALL SELECT id, 4, 'zzz', 'x' FROM crawl_job),
decl AS (SELECT job_id, key, max_by(value, source) AS value FROM ann GROUP BY 1, 2 HAVING min(source) < 4),
sj AS (SELECT id AS seed_id, job_a AS job_id FROM seed UNION SELECT id, job_b FROM seed WHERE job_b IS NOT NULL),
ov AS (
  SELECT s.id AS seed_id, 5 AS source, 'scope_b' AS key, e.job_override AS value FROM seed s JOIN entity e ON e.id = s.entity_id WHERE e.job_override IS NOT NULL
  UNION ALL SELECT id, 6, 'scope_a', balance FROM seed WHERE seed_type IS NULL
  UNION ALL SELECT id, 6, '{job3}scope_a', 'for3' FROM seed WHERE seed_type IS NULL
  UNION ALL SELECT id, 6, '{Job NATION_2}scope_b', 'for2' FROM seed
  UNION ALL SELECT id, 6, 'undeclared', 'u' FROM seed),
o AS (SELECT seed_id, source, value, regexp_extract(key, '^\\{([^}]*)\\}', 1) AS target, regexp_replace(key, '^\\{[^}]*\\}', '') AS key FROM ov),
all_rows AS (
  SELECT sj.job_id, sj.seed_id, d.key, d.value, 0 AS prio FROM sj JOIN decl d ON d.job_id = sj.job_id
  UNION ALL SELECT sj.job_id, sj.seed_id, o.key, o.value, o.source * 2 + CASE WHEN target <> '' THEN 1 ELSE 0 END
  FROM o JOIN sj ON sj.seed_id = o.seed_id JOIN crawl_job j ON j.id = sj.job_id JOIN decl d ON d.job_id = sj.job_id AND d.key = o.key
  WHERE target IN ('', j.id, j.name))
SELECT job_id, seed_id, key, max_by(value, prio) AS value FROM all_rows GROUP BY 1, 2, 3""")
def resolve_parameters(spark, sf_dir):
    jobs = rowwise(spark, sf_dir, "crawl_job")
    seeds = rowwise(spark, sf_dir, "seed")
    entities = rowwise(spark, sf_dir, "entity")

    def annotation(rows, owner, source, key, value):
        return rows.select(F.col(owner).alias("owner"), F.lit(source).alias("source"), F.lit(0).alias("pos"),
                           F.lit(key).alias("key"), (F.lit(value) if isinstance(value, str) else value).alias("value"))

    job_level = [
        annotation(jobs, "id", P.SCOPE_SCRIPT, "scope_a", F.col("scope_script_id")),
        annotation(jobs, "id", P.SCOPE_SCRIPT, "scope_b", "b0"),
        annotation(jobs.where("schedule_id IS NOT NULL"), "id", P.SELECTED_SCRIPT, "scope_b", "b1"),
        annotation(jobs.where("max_bytes > 0"), "id", P.JOB, "scope_a", F.col("name")),
        annotation(jobs, "id", P.JOB, "zzz", "x")]
    overridden = seeds.select("id", "entity_id").join(
        entities.where("job_override IS NOT NULL").select(F.col("id").alias("entity_id"), "job_override"), "entity_id")
    untyped = seeds.where("seed_type IS NULL")
    seed_level = [
        annotation(overridden, "id", P.ENTITY, "scope_b", F.col("job_override")),
        annotation(untyped, "id", P.SEED, "scope_a", F.col("balance")),
        annotation(untyped, "id", P.SEED, "{job3}scope_a", "for3"),
        annotation(seeds, "id", P.SEED, "{Job NATION_2}scope_b", "for2"),
        annotation(seeds, "id", P.SEED, "undeclared", "u")]

    def union(frames, name):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out.withColumnRenamed("owner", name)

    seed_jobs = (seeds.select(F.col("id").alias("seed_id"), F.col("job_a").alias("job_id"))
                 .union(seeds.where("job_b IS NOT NULL").select("id", "job_b")).distinct())
    return P.resolve_parameters(union(job_level, "job_id"), jobs, seed_jobs, union(seed_level, "seed_id"))
