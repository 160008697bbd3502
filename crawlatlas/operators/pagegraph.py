"""Requests of a page load: merging, redirect and referrer parents, discovery paths.

Parents are pointers between rows of a page. Chains of them are followed by pointer
doubling, each round one join on (page, request), so a page of any size stays spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.operators.skew import look_up
from crawlatlas.session import materialize


def merge_requests(observations: DataFrame) -> DataFrame:
    """One row per request: first non-empty value, last non-empty URL, flags OR-ed."""
    def first(c: str):
        return F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))).alias(c)

    has_url = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.col("seq"))
    return observations.groupBy("page_id", "request_id").agg(
        F.min_by("url", has_url).alias("original_url"), F.max_by("url", has_url).alias("url"),
        first("method"), first("resource_type"), first("referrer"), first("initiator"),
        F.min_by("redirect_from_url", F.when(F.col("redirected"), F.col("seq"))).alias("redirect_from_url"),
        *[F.bool_or(c).alias(c) for c in ("redirected", "got_new", "got_complete", "from_cache")])


def _by_url(requests: DataFrame) -> DataFrame:
    """The last request of each URL on a page."""
    return requests.where("url <> ''").groupBy("page_id", "url").agg(
        F.max("idx").alias("parent_idx"),
        F.max_by("has_crawl_log", "idx").alias("parent_logged"),
        F.max_by("request_id", "idx").alias("parent_id"))


def _parent(requests: DataFrame, url: str, prefix: str) -> DataFrame:
    values = ["parent_idx", "parent_logged", "parent_id"]
    lookup = _by_url(requests).select(
        "page_id", "url", *[F.col(v).alias(f"{prefix}_{v}") for v in values])
    return look_up(requests, lookup, {"page_id": "page_id", url: "url"}, [f"{prefix}_{v}" for v in values])


def redirect_parents(requests: DataFrame) -> DataFrame:
    """Add the request each redirected one came from, never itself."""
    linked = _parent(requests, "redirect_from_url", "redirect")
    valid = F.col("redirected") & (F.col("redirect_from_url") != "") & (F.col("redirect_parent_idx") != F.col("idx"))
    return linked.select(*requests.columns, *[
        F.when(valid, F.col(f"redirect_{v}")).alias(f"redirect_{v}") for v in ("parent_idx", "parent_logged", "parent_id")])


def referrer_parents(requests: DataFrame) -> DataFrame:
    """Add the request whose URL is the referrer."""
    return _parent(requests, "referrer", "referrer")


def follow(nodes: DataFrame) -> DataFrame:
    """Follow ``ptr`` to its end: ``text`` is joined from the end on, ``root`` is the last row reached.

    Each round joins the rows that are still on their way, and only these, with the rows they point at, and
    so doubles how far they have come. A row that has arrived is not written or moved again; it is read as
    far as others point at it. Rows that very many point at are spread by ``look_up``.
    """
    columns = ["page_id", "idx", "ptr", "text", "root"]
    state = materialize(nodes.select("page_id", "idx", "ptr", "text").withColumn("root", F.col("idx")), "follow")
    arrived, active = state.where("ptr IS NULL"), state.where("ptr IS NOT NULL")
    while not active.isEmpty():
        asked = active.select(F.col("page_id").alias("_page"), F.col("ptr").alias("_ask")).distinct()
        met = arrived.unionByName(active).join(asked, (F.col("page_id") == F.col("_page")) & (F.col("idx") == F.col("_ask")), "left_semi")
        target = met.select("page_id", F.col("idx").alias("_to"), F.col("ptr").alias("_ptr"), F.col("text").alias("_text"),
                            F.col("root").alias("_root"))
        step = look_up(active, target, {"page_id": "page_id", "ptr": "_to"}, ["_ptr", "_text", "_root"])
        state = materialize(step.select(
            "page_id", "idx", F.col("_ptr").alias("ptr"),
            F.concat(F.coalesce("_text", F.lit("")), "text").alias("text"),
            F.coalesce("_root", "root").alias("root")).select(columns), "follow")
        arrived, active = arrived.unionByName(state.where("ptr IS NULL")), state.where("ptr IS NOT NULL")
    return arrived.drop("ptr")


def redirect_roots(requests: DataFrame) -> DataFrame:
    """The request each page ends at when redirects are followed from its first request."""
    linked = redirect_parents(requests)
    following = (linked.where(F.col("redirect_parent_idx").isNotNull() & (F.col("idx") > F.col("redirect_parent_idx")))
                 .groupBy("page_id", F.col("redirect_parent_idx").alias("_at"))
                 .agg(F.min("idx").alias("ptr")).withColumnRenamed("_at", "idx"))
    nodes = requests.select("page_id", "idx").join(following, ["page_id", "idx"], "left").withColumn("text", F.lit(""))
    return follow(nodes).where("idx = 0").select("page_id", F.col("root").alias("root_idx"))


def discovery_type(first_path: str = "queue_path"):
    """First request: the queue path; script initiator X; redirect R; else E."""
    return (F.when(F.col("idx") == 0, F.col(first_path))
            .when(F.col("initiator") == "script", "X")
            .when(F.col("redirect_parent_idx").isNotNull() | F.col("redirected"), "R")
            .otherwise("E"))


def discovery_paths(requests: DataFrame, first_path: str = "queue_path") -> DataFrame:
    """Discovery path of every logged request: the parent's path and the request's own type.

    The parent is the redirect parent if it was logged, else the referrer if it was.
    Requests are taken in order, so a parent that comes later has no path yet.
    """
    needed = requests.select("page_id", "idx", "request_id", "url", "referrer", "initiator", "redirected",
                             "redirect_from_url", "has_crawl_log", first_path)
    # Written once, so that the second look-up does not repeat the first for its counts.
    linked = referrer_parents(materialize(redirect_parents(needed), "linked"))
    linked = linked.withColumn("discovery_type", discovery_type(first_path))
    parent = (F.when(F.col("redirect_parent_logged"), F.col("redirect_parent_idx"))
              .when(F.col("referrer_parent_logged"), F.col("referrer_parent_idx")))
    nodes = linked.where("has_crawl_log").select(
        "page_id", "idx", F.when(parent < F.col("idx"), parent).alias("ptr"), F.col("discovery_type").alias("text"))
    return follow(nodes).select("page_id", "idx", F.col("text").alias("discovery_path"))
