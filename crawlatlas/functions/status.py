"""Status codes besides those of HTTP, and the decisions that hang on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlatlas.schemas import RUNNING_STATES

# Code, name, description, and whether the failure is temporary.
STATUS_CODES = [
    (1, "SUCCESSFUL_DNS", "Successful DNS lookup", False),
    (0, "NEVER_TRIED", "Fetch never tried (perhaps protocol unsupported or illegal URI)", False),
    (-1, "FAILED_DNS", "DNS lookup failed", True),
    (-2, "CONNECT_FAILED", "HTTP connect failed", True),
    (-3, "CONNECT_BROKEN", "HTTP connect broken", True),
    (-4, "HTTP_TIMEOUT", "HTTP timeout", True),
    (-5, "RUNTIME_EXCEPTION", "Unexpected runtime exception.  See runtime-errors.log.", True),
    (-6, "DOMAIN_LOOKUP_FAILED", "Prerequisite domain-lookup failed, precluding fetch attempt.", True),
    (-7, "ILLEGAL_URI", "URI recognized as unsupported or illegal.", False),
    (-8, "RETRY_LIMIT_REACHED", "Multiple retries failed, retry limit reached.", False),
    (-9, "DNS_NXDOMAIN", "DNS name does not exist (NXDOMAIN).", False),
    (-10, "DNS_NO_DATA", "DNS name has no usable address record (NODATA).", False),
    (-61, "FAILED_FETCHING_ROBOTS", "Prerequisite robots.txt fetch failed, precluding a fetch attempt.", True),
    (-404, "EMPTY_RESPONSE", "Empty HTTP response interpreted as a 404.", True),
    (-3000, "SEVERE", "Severe Java Error condition occured such as OutOfMemoryError or StackOverflowError "
                      "during URI processing.", True),
    (-4000, "CHAFF_DETECTION", "Chaff detection of traps/content with negligible value applied.", False),
    (-4001, "TOO_MANY_HOPS", "The URI is too many link hops away from the seed.", False),
    (-4002, "TOO_MANY_TRANSITIVE_HOPS", "The URI is too many embed/transitive hops away from the last URI in scope.", False),
    (-4100, "ALREADY_SEEN", "The URI is already fetched. Might happen if two URI's after normalization points to "
                            "the same resource.", False),
    (-5000, "PRECLUDED_BY_SCOPE_CHANGE", "The URI is out of scope upon reexamination.  This only happens if the "
                                         "scope changes during the crawl.", False),
    (-5001, "BLOCKED", "Blocked from fetch by user setting.", False),
    (-5002, "BLOCKED_BY_CUSTOM_PROCESSOR", "Blocked by a custom processor.", False),
    (-5003, "QUOTA_EXCEEDED", "Blocked due to exceeding an established quota.", False),
    (-5004, "RUNTIME_EXCEEDED", "Blocked due to exceeding an established runtime", False),
    (-5010, "BLOCKED_MIXED_CONTENT", "Blocked because insecure content was loaded from secure context.", False),
    (-5011, "CANCELED_BY_BROWSER", "The browser driving the fetch canceled the request.", True),
    (-6000, "DELETED_FROM_FRONTIER", "Deleted from Frontier by user.", False),
    (-9998, "PRECLUDED_BY_ROBOTS", "Robots.txt rules precluded fetch.", False),
]
TEMPORARY = [code for code, _, _, temporary in STATUS_CODES if temporary]
KNOWN = [code for code, _, _, _ in STATUS_CODES]

# Texts of a fetch failure and the code each stands for, first match first.
FAILURE_TEXTS = [
    (-4, ["i/o timeout", "timeout awaiting response", "context deadline exceeded"]),
    (-6, ["no such host", "server misbehaving", "temporary failure in name resolution"]),
    (-404, ["empty reply from server", "server closed idle connection", "unexpected eof"]),
    (-3, ["connection reset by peer", "broken pipe"]),
    (-2, ["connection refused", "network is unreachable", "no route to host"]),
]
CONNECT_PHASES = ["connect-dial", "upstream-proxy-connect", "downstream-tls", "upstream-tls", "tunnel"]
ROUND_TRIP = "http-round-trip"


def status_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUS_CODES, "code int, name string, description string, temporary boolean")


def status_class(rows: DataFrame, code: str) -> DataFrame:
    """Name, description and temporary flag of each row's code, NULL where it is unknown."""
    table = status_table(rows.sparkSession).withColumnRenamed("code", code)
    return rows.join(F.broadcast(table), code, "left")  # 28 fixed rows


def failure_class(detail: Column, phase: Column) -> Column:
    """Code of a fetch failure from its text, else from the phase it happened in."""
    text = F.lower(F.coalesce(detail, F.lit("")))
    squid = detail.startswith("ERR_")
    out = F.when(squid, F.when(detail.rlike(r"^ERR_CONNECT_FAIL \S"), -2)
                 .when(detail.startswith("ERR_ZERO_SIZE_OBJECT"), -404).otherwise(-5))
    for code, texts in FAILURE_TEXTS:
        hit = F.lit(False)
        for t in texts:
            hit = hit | text.contains(t)
        if code == -404:
            hit = hit | ((F.trim(detail) == "EOF") & (phase == ROUND_TRIP))
        out = out.when(hit, code)
    return out.when(phase.isin(CONNECT_PHASES), -2).otherwise(-5)


def retry_decision(rows: DataFrame, max_retries: Column, delay_s: Column, now_ms: Column) -> DataFrame:
    """What becomes of a failed fetch: another try later, or a final failure.

    A temporary failure counts one retry up and is tried again below the limit, else it
    ends as "retry limit reached". A permanent one ends at once; an unknown code is an error.
    """
    code = F.col("error_code")
    known = F.when(code.isin(KNOWN), code).otherwise(
        F.raise_error(F.concat(F.lit("Unknown error code: "), code.cast("string"))).cast("int"))
    temporary = known.isin(TEMPORARY)
    retries = F.when(temporary, F.col("retries") + 1).otherwise(F.col("retries"))
    again = temporary & (retries < max_retries)
    return (rows.withColumn("_again", again).withColumn("new_retries", retries)
            .withColumn("outcome", F.when(F.col("_again"), "RETRY").otherwise("COMPLETE"))
            .withColumn("earliest_fetch_ms", F.when(F.col("_again"), now_ms + delay_s * 1000))
            .withColumn("logged_code", F.when(~F.col("_again"), F.when(temporary, -8).otherwise(code)))
            .withColumn("documents_failed", F.when(F.col("_again"), 0).otherwise(1))
            .withColumn("documents_retried", F.when(F.col("_again"), 1).otherwise(0)).drop("_again"))


def limit_decision(state: Column, bytes_crawled: Column, age_s: Column, max_bytes: Column,
                   max_duration_s: Column) -> Column:
    """State after a check of the crawl limits; only running executions change, 0 is no limit."""
    running = state.isin(RUNNING_STATES)
    return (F.when((max_bytes > 0) & (bytes_crawled > max_bytes), F.when(running, "ABORTED_SIZE").otherwise(state))
            .when((max_duration_s > 0) & (age_s > max_duration_s), F.when(running, "ABORTED_TIMEOUT").otherwise(state))
            .otherwise(state))


def seed_outcome(outcome: Column, error_code: Column, discovery_path: Column, state: Column) -> Column:
    """End state of an execution whose seed URI failed: FINISHED for a robots denial, else FAILED."""
    ends = (outcome == "COMPLETE") & (error_code != 0) & (discovery_path == "") & state.isin(RUNNING_STATES)
    return F.when(ends, F.when(error_code == -9998, "FINISHED").otherwise("FAILED")).otherwise(state)


def execution_timeout_at(created: Column, max_duration_s: Column, requested: Column | None = None) -> Column:
    """When an execution times out: the requested time, else creation plus the longest duration, if any."""
    limit = F.when(max_duration_s > 0, created + F.make_interval(secs=max_duration_s))
    return limit if requested is None else F.coalesce(requested, limit)


def precondition_outcome(in_scope: Column, unresolved: Column, dns_code: Column, allowed: Column,
                         retry_outcome: Column, queued_before: Column) -> Column:
    """FETCH, COMPLETE, RETRY or MOVE from the scope, DNS and robots results.

    A failed robots look-up (NULL) allows. MOVE is for a URI that was queued under
    another host group before its address was known.
    """
    return (F.when(~in_scope, "COMPLETE")
            .when(~unresolved, "FETCH")
            .when(dns_code != 0, retry_outcome)
            .when(~F.coalesce(allowed, F.lit(True)), "COMPLETE")
            .when(queued_before, "MOVE").otherwise("FETCH"))
