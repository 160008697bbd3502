"""Lifetimes, archiving, logging and outcomes of DNS answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TTL = 7 * 24 * 3600
FAILURE_TTL = 5

# Response codes.
NO_ERROR, SERVER_FAILURE, NO_SUCH_NAME, NOT_IMPLEMENTED = 0, 2, 3, 4


def dns_expiry(records: DataFrame) -> DataFrame:
    """Seconds each response may be kept, NULL where it may not.

    Positive answers live as long as their shortest record, at most seven days. Negative
    ones need a SOA record, which counts with the smaller of its TTL and minimum. Server
    failures live five seconds; truncated responses and zero lifetimes are not kept.
    """
    counted = F.col("rr_type") != "OPT"
    is_soa = (F.col("rr_type") == "SOA") & (F.col("section") == "authority")
    negative_ttl = F.when(is_soa, F.least("ttl", "soa_minimum")).otherwise(F.col("ttl"))
    per = records.groupBy("response_id", "name", "rcode", "truncated").agg(
        F.min("stored_at").alias("stored_at"),
        F.min(F.when(counted, F.col("ttl"))).alias("_positive"),
        F.min(F.when(counted, negative_ttl)).alias("_negative"),
        F.coalesce(F.bool_or(is_soa), F.lit(False)).alias("_soa"),
        F.count_if(F.col("section") == "answer").alias("answers"))
    no_data = (F.col("rcode") == NO_ERROR) & (F.col("answers") == 0) & F.col("_soa")
    negative = (F.col("rcode") == NO_SUCH_NAME) | no_data
    ttl = (F.when(F.col("truncated"), None)
           .when(F.col("rcode").isin(SERVER_FAILURE, NOT_IMPLEMENTED), F.lit(FAILURE_TTL))
           .when(negative, F.when(F.col("_soa"), F.least("_negative", F.lit(MAX_TTL))))
           .when(F.col("rcode") == NO_ERROR, F.least("_positive", F.lit(MAX_TTL))))
    return per.select("response_id", "name", "rcode", "answers", "stored_at",
                      F.when(ttl > 0, ttl.cast("bigint")).alias("lifetime_s"))


def aged_ttl(ttl: Column, stored_at_ms: Column, now_ms: Column) -> Column:
    """Remaining TTL of a stored record, never below 0."""
    elapsed = F.floor(F.greatest(now_ms - stored_at_ms, F.lit(0)) / 1000)
    return F.greatest(ttl - elapsed, F.lit(0))


def dns_archive_once(lookups: DataFrame) -> DataFrame:
    """One archive row per collection and stored answer; only positive answers are archived."""
    usable = lookups.where((F.col("rcode") == NO_ERROR) & (F.col("answers") > 0)
                           & (F.coalesce("collection", F.lit("")) != ""))
    return usable.select("collection", "name", "stored_at").distinct()


def dns_crawl_log(archived: DataFrame, now_ms: int) -> DataFrame:
    """Archived answers as crawl-log rows."""
    return archived.select(
        F.concat(F.lit("dns:"), "name").alias("requested_uri"), F.lit("P").alias("discovery_path"),
        F.lit(1).alias("status_code"), F.lit("text/dns").alias("content_type"), F.lit("resource").alias("record_type"),
        F.col("collection").alias("collection_final_name"), F.col("stored_at").alias("fetch_time_stamp"),
        F.lit(now_ms).cast("bigint").alias("time_stamp"))


def dns_outcome(rcode: Column) -> Column:
    """Status of a failed look-up: no data, no such name, or a retryable failure."""
    return F.when(rcode == NO_ERROR, -10).when(rcode == NO_SUCH_NAME, -9).otherwise(-1)
