"""Page logs from the messages of page loads, nested or as the rows of the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlatlas.operators.skew import look_up

# The columns of an archived resource besides the key of its page.
RESOURCE_FIELDS = {
    "warc_id": "string", "uri": "string", "referrer": "string", "resource_type": "string", "content_type": "string",
    "discovery_path": "string", "method": "string", "status_code": "int", "from_cache": "boolean",
    "renderable": "boolean", "error_code": "int", "error_msg": "string", "error_detail": "string",
}
RESOURCE_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in RESOURCE_FIELDS.items()) + ">"
# What a page takes from its crawl log message.
PAGE_FIELDS = ["uri", "method", "warc_id", "execution_id", "job_execution_id", "referrer", "collection_final_name"]


def page_log_messages(requests: DataFrame) -> DataFrame:
    """Log, resource and outlink messages of page loads, one row each, with their arrival number.

    Columns that the requests do not have are null.
    """
    given = {**{c: c for c in requests.columns}, "uri": "url"}

    def of(name: str, kind: str = "string") -> Column:
        return (F.col(given[name]) if name in given else F.lit(None)).cast(kind)

    resource = F.when((F.col("idx") > 0) & F.col("has_crawl_log"),
                      F.struct(*[of(n, t).alias(n) for n, t in RESOURCE_FIELDS.items()]))
    outlink = F.when((F.col("idx") > 0) & (F.col("resource_type") == "Script"), F.col("url"))
    return requests.select("page_id", "seq", *[F.when(F.col("idx") == 0, of(n)).alias(n) for n in PAGE_FIELDS],
                           resource.alias("resource"), outlink.alias("outlink"))


def _newest(messages: DataFrame) -> list[Column]:
    """What the newest crawl log message of a page says."""
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in PAGE_FIELDS if c in messages.columns]


def _in_order(column: str) -> Column:
    listed = F.collect_list(F.when(F.col(column).isNotNull(), F.struct("seq", F.col(column).alias("v"))))
    return F.transform(F.array_sort(listed), lambda e: e["v"])


def assemble_page_logs(messages: DataFrame) -> DataFrame:
    """Fold the messages of a page, in arrival order, into one nested page log.

    A nested log holds its page whole, so a page has to fit in a row; ``archive_rows`` does not
    nest and takes pages of any size.
    """
    return messages.groupBy("page_id").agg(
        *_newest(messages), _in_order("resource").alias("resource"), _in_order("outlink").alias("outlink"))


def outlinks_text(outlinks: str = "outlink") -> Column:
    return F.when(F.size(outlinks) > 0, F.to_json(outlinks)).otherwise(F.lit(""))


def archive_rows(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One archive row per page and one per resource, each resource with the key of its page.

    Resources stay rows all the way; a page's row holds its outlinks as one text, as the archive does.
    """
    pages = messages.groupBy("page_id").agg(*_newest(messages), _in_order("outlink").alias("outlink"))
    page = pages.select(*[c for c in pages.columns if c not in ("outlink", "page_id")], outlinks_text().alias("outlinks"))
    heads = messages.groupBy("page_id").agg(*[c for c in _newest(messages)]).select(
        "page_id", F.col("warc_id").alias("_page"), F.col("collection_final_name").alias("_collection"))
    rows = messages.where(F.col("resource").isNotNull()).select("page_id", "resource")
    resource = look_up(rows, heads, {"page_id": "page_id"}, ["_page", "_collection"]).select(
        F.col("_page").alias("page_id"), F.col("_collection").alias("collection_final_name"), "resource.*")
    return page, resource


def split_page_logs(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One archive row per nested page log and one per resource."""
    page = pages.select(*[c for c in pages.columns if c not in ("resource", "outlink")], outlinks_text().alias("outlinks"))
    resource = pages.select(
        F.col("warc_id").alias("page_id"), "collection_final_name", F.explode("resource").alias("r")
    ).select("page_id", "collection_final_name", "r.*")
    return page, resource


def decode_outlinks(outlinks: str = "outlinks") -> Column:
    """JSON text of a page's outlinks to an array; '' is the empty list."""
    return F.coalesce(F.from_json(F.nullif(F.col(outlinks), F.lit("")), "array<string>"),
                      F.array().cast("array<string>"))
