"""Admission of outlinks to the next frontier, as one set-based plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlatlas.functions.robots import text_allows
from crawlatlas.functions.status import RUNNING_STATES, TEMPORARY, limit_decision, precondition_outcome
from crawlatlas.functions.urls import canonical, short_sha1, uri_hash
from crawlatlas.operators.joins import host_groups
from crawlatlas.operators.robots import CUSTOM, CUSTOM_IF_MISSING, KEY, OBEY, judged_by_rules, keyed
from crawlatlas.operators.scope import Rule, scope_decide
from crawlatlas.operators.skew import look_up
from crawlatlas.plans.seen import without_seen
from crawlatlas.session import materialize

ILLEGAL_URI, ALREADY_SEEN, ROBOTS = -7, -4100, -9998


def inherit(outlinks: DataFrame, parents: DataFrame) -> DataFrame:
    """Outlinks with the seed, execution, politeness and parameters of the page they were found on.

    ``parents`` may have a ``collection`` and a ``robots_policy``; without, none and ``OBEY_ROBOTS``.
    """
    given = {"collection": F.lit(None).cast("string"), "robots_policy": F.lit("OBEY_ROBOTS")}
    own = [F.coalesce(F.col(c), none).alias(c) if c in parents.columns else none.alias(c) for c, none in given.items()]
    p = parents.select("page_id", *own, "seed_uri", "execution_id", "job_execution_id", "priority_weight",
                       F.col("sequence").alias("_sequence"), F.col("discovery_path").alias("_path"),
                       F.col("url").alias("referrer"), "annotation", "active")
    return outlinks.join(p, "page_id").select(
        "page_id", F.col("uri").alias("found_uri"), "seed_uri", "execution_id", "job_execution_id", "priority_weight",
        (F.col("_sequence") + 1).alias("sequence"), F.concat("_path", F.lit("L")).alias("discovery_path"),
        "referrer", "annotation", "active", *given)


def still_active(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``active`` only where the execution also runs on after a check of its limits.

    ``limits`` is ``execution_id, state, bytes_crawled, age_s, max_bytes, max_duration_s`` with unique ids.
    """
    state = limit_decision(*[F.col(c) for c in ("state", "bytes_crawled", "age_s", "max_bytes", "max_duration_s")])
    checked = limits.select("execution_id", state.isin(RUNNING_STATES).alias("_runs"))
    known = look_up(rows, checked, {"execution_id": "execution_id"}, ["_runs"])
    return known.withColumn("active", F.col("active") & F.coalesce("_runs", F.lit(True))).drop("_runs")


def judged(rows: DataFrame, robots: DataFrame, agent: str, custom: str, resolved: Column) -> DataFrame:
    """Add ``_allowed`` of resolved URLs by their job's policy; NULL where no rules say anything.

    Rules are looked up by those of collection, scheme, host and port that ``robots`` has.
    """
    on = [c for c in KEY if c in robots.columns]
    ported = F.coalesce("port", F.when(F.col("scheme") == "https", 443).otherwise(80)).cast("int").alias("port")
    texts = keyed(robots) if "collection" in on else robots
    place = {c: ported if c == "port" else F.col(c) for c in on}
    policy = F.col("robots_policy")
    asked = keyed(rows).withColumn("_site", F.when(resolved & policy.isin(OBEY), F.to_json(F.struct(*[c.alias(n) for n, c in place.items()]))))
    texts = texts.select(F.to_json(F.struct(*[F.col(n).cast("int").alias(n) if n == "port" else F.col(n) for n in on])).alias("_site"), "rules")
    said = judged_by_rules(asked, texts, "_site", agent, "_by_rules")
    own = resolved & (policy.isin(CUSTOM) | (policy.isin(CUSTOM_IF_MISSING) & F.col("_by_rules").isNull()))
    by_custom = text_allows(custom, agent)(F.when(own, F.col("uri"))) if custom else F.lit(None).cast("boolean")
    return said.withColumn("_allowed", F.coalesce("_by_rules", by_custom)).drop("_site", "_by_rules")


def admit_outlinks(outlinks: DataFrame, parents: DataFrame, dns: DataFrame, robots: DataFrame,
                   rules: list[Rule], agent: str, seen: DataFrame | None = None, limits: DataFrame | None = None,
                   ranges: DataFrame | None = None, use_hostname: bool = False, custom: str = "") -> DataFrame:
    """Decide on every outlink: ``QUEUED`` (maybe for a retry) or ``REJECTED`` with a reason code.

    ``dns`` is ``host, ip, dns_code`` with unique hosts; ``robots`` is ``host, rules`` and, where rules
    depend on them, ``collection``, ``scheme`` and ``port``, unique together; ``custom`` are the rules of the
    custom policies. Hosts are very uneven, so neither gathers a host's rows, and rules stay out of URL rows.
    ``limits`` are those of ``still_active``, ``ranges`` and ``use_hostname`` those of ``host_groups``. ``seen``
    has the job_execution_id and uri_hash of earlier runs, best as the lasting table of ``plans.seen``.
    """
    rows = inherit(outlinks, parents)
    rows = rows if limits is None else still_active(rows, limits)
    rows = rows.withColumn("_crawl", canonical(F.col("found_uri"))).withColumn("uri", F.col("_crawl.href"))
    rows = rows.withColumn("_illegal", F.col("_crawl.error").isNotNull()).drop("_crawl")
    decided = scope_decide(rows, rules).withColumns({c: F.col(f"include_check_uri.{c}") for c in ("scheme", "host", "port")})
    # Written once: the URL work behind it is not repeated for the counts of the look-up.
    decided = materialize(decided.drop("include_check_uri", "annotation"), "decided")
    known = look_up(decided, dns, {"host": "host"}, ["ip", "dns_code"])
    in_scope = F.col("evaluation") == "INCLUDE"
    dns_code = F.coalesce("dns_code", F.lit(0))
    resolved = in_scope & (dns_code == 0)
    known = judged(known, robots, agent, custom, resolved)
    retry = F.when(dns_code.isin(TEMPORARY), "RETRY").otherwise("COMPLETE")
    checked = known.withColumn("outcome", precondition_outcome(
        in_scope, F.lit(True), dns_code, F.col("_allowed"), retry, F.lit(False)))
    reason = (F.when(F.col("_illegal"), ILLEGAL_URI)
              .when(~in_scope, F.col("exclude_reason"))
              .when((dns_code != 0) & (F.col("outcome") == "COMPLETE"), dns_code)
              .when(F.col("outcome") == "COMPLETE", ROBOTS)
              .when(~F.col("active"), F.lit(0)))
    checked = checked.withColumn("_reason", reason).withColumn("uri_hash", uri_hash(F.col("uri")))
    checked = materialize(checked, "checked")
    grouped = checked.withColumn("host_group_id", _host_group()) if ranges is None and not use_hostname else host_groups(
        checked, ranges, use_hostname)
    return first_sights(grouped, seen)


def first_sights(checked: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Queue the first sight of each admissible URI in its job execution, reject the others."""
    admissible = F.col("_reason").isNull()
    order = F.struct("page_id", "found_uri")
    first = (checked.where(admissible).groupBy("job_execution_id", "uri_hash")
             .agg(F.min(order).alias("first")))
    if seen is not None:
        # Written, so that the anti-join is not pushed below the aggregate, where a hot URI would meet it unreduced.
        first = without_seen(materialize(first, "first"), seen)
    marked = look_up(checked, first, {"job_execution_id": "job_execution_id", "uri_hash": "uri_hash"}, ["first"])
    is_first = admissible & F.col("first").isNotNull() & (F.col("first") == order)
    reason = F.when(is_first, F.lit(None).cast("int")).when(admissible, ALREADY_SEEN).otherwise(F.col("_reason"))
    return marked.select(
        "page_id", "found_uri", "uri", "uri_hash", "execution_id", "job_execution_id", "seed_uri", "discovery_path",
        "referrer", "sequence", F.coalesce("priority_weight", F.lit(1.0)).alias("priority_weight"), "host", "ip",
        F.when(is_first, "QUEUED").otherwise("REJECTED").alias("decision"), reason.alias("reason"),
        F.when(is_first, F.col("outcome") == "RETRY").alias("for_retry"),
        F.when(is_first, F.col("host_group_id")).alias("crawl_host_group_id"))


def _host_group() -> Column:
    """Group of the address, or a temporary one by host until the address is known."""
    return F.when(F.col("ip").isNull(), F.concat(F.lit("TEMP_CHG_"), short_sha1(F.col("host")))).otherwise(
        short_sha1(F.col("ip")))
