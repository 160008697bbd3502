"""Archive tables of crawl, page and resource logs: scans, sinks, manifests.

Tables are Parquet, partitioned by collection, so a filter on ``collection`` prunes
directories. Directory names are escaped by the writer, hence ``a/b`` and ``a_b`` differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlatlas import schemas
from crawlatlas.operators.pagelog import archive_rows, decode_outlinks, split_page_logs

ROWS_PER_FILE = 100_000
TABLES = {"crawl_log": schemas.CRAWL_LOG, "page_log": schemas.PAGE_LOG, "resource": schemas.RESOURCE}


def normal_collection(name: Column) -> Column:
    """Trimmed collection name; blank is ``default``."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return F.when(trimmed == "", "default").otherwise(trimmed)


def collection_dir(name: Column) -> Column:
    """Collection name as one escaped path segment."""
    # Characters a path segment may hold besides letters, digits and "-_.".
    kept = {"%7E": "~", "%24": "$", "%26": "&", "%2B": "+", "%3D": "=", "%3A": ":", "%40": "@"}
    escaped = F.url_encode(normal_collection(name))
    escaped = F.replace(F.replace(escaped, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, character in kept.items():
        escaped = F.replace(escaped, F.lit(code), F.lit(character))
    return escaped


def _path_text(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _scan(spark: SparkSession, base: str, table: str, plain_layout: bool) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", "*.parquet")  # unfinished and index files have other names
    if not plain_layout:
        return reader.schema(TABLES[table] + ", collection string").parquet(f"{base}/{table}")
    directory = F.regexp_extract("_metadata.file_path", f"/{table}/([^/]+)/[^/]*$", 1)
    rows = reader.option("recursiveFileLookup", "true").schema(TABLES[table]).parquet(f"{base}/{table}")
    return rows.select("*", _path_text(_path_text(directory)).alias("collection"))


def millis(column: str) -> Column:
    """Epoch milliseconds to a time; 0 stands for none."""
    return F.timestamp_millis(F.nullif(F.col(column), F.lit(0).cast("bigint")))


def scan_crawl_log(spark: SparkSession, base: str, plain_layout: bool = False) -> DataFrame:
    """Archived crawl logs with their collection; ``plain_layout`` reads ``<table>/<collection>/``."""
    return _scan(spark, base, "crawl_log", plain_layout)


def scan_page_log(spark: SparkSession, base: str, plain_layout: bool = False) -> DataFrame:
    """Archived page logs, outlinks as an array."""
    return _scan(spark, base, "page_log", plain_layout).withColumn("outlinks", decode_outlinks())


def scan_resource(spark: SparkSession, base: str, plain_layout: bool = False) -> DataFrame:
    return _scan(spark, base, "resource", plain_layout)


def write_table(rows: DataFrame, base: str, table: str, collection: str = "collection_final_name",
                rows_per_file: int = ROWS_PER_FILE, mode: str = "append") -> None:
    """Append rows below their collection.

    The rebalance splits a large collection over many tasks and packs small ones, so
    neither one hot collection nor thousands of small ones make bad files.
    """
    placed = rows.withColumn("collection", normal_collection(F.col(collection)))
    (placed.hint("rebalance", "collection").write.mode(mode).partitionBy("collection")
     .option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").parquet(f"{base}/{table}"))


def sink_crawl_log(logs: DataFrame, base: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "append") -> None:
    write_table(logs, base, "crawl_log", rows_per_file=rows_per_file, mode=mode)


def sink_page_logs(pages: DataFrame, base: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "append") -> None:
    """Write nested page logs as page rows and resource rows of the same collection."""
    page, resource = split_page_logs(pages)
    write_table(page, base, "page_log", rows_per_file=rows_per_file, mode=mode)
    write_table(resource, base, "resource", rows_per_file=rows_per_file, mode=mode)


def sink_page_messages(messages: DataFrame, base: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "append") -> None:
    """Write the messages of page loads as page rows and resource rows, without nesting them."""
    page, resource = archive_rows(messages)
    write_table(page, base, "page_log", rows_per_file=rows_per_file, mode=mode)
    write_table(resource, base, "resource", rows_per_file=rows_per_file, mode=mode)


def listing(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Finished files of a table with their row count and modification time."""
    files = _scan(spark, base, table, plain_layout=False)
    return files.groupBy(F.col("_metadata.file_path").alias("path"), F.lit(table).alias("table"), "collection").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("_metadata.file_modification_time").alias("modified"))


def file_manifest(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Files with their finalization time: from the index, else their modification time.

    Index entries whose file is gone do not appear.
    """
    if index is None:
        return files.withColumn("finalized_at", F.col("modified"))
    known = index.select("path", F.col("finalized_at").alias("_at"))
    return files.join(known, "path", "left").withColumn("finalized_at", F.coalesce("_at", "modified")).drop("_at")


def handoff_candidates(manifest: DataFrame, now: Column, delay_seconds: int, prefix: str) -> DataFrame:
    """Files old enough to hand over, with their object key."""
    ready = F.lit(delay_seconds <= 0) | F.col("finalized_at").isNull() | (
        F.col("finalized_at") + F.make_interval(secs=F.lit(delay_seconds)) <= now)
    name = F.substring_index("path", "/", -1)
    key = F.concat_ws("/", F.lit(prefix), "table", collection_dir(F.col("collection")), name)
    return manifest.where(ready).withColumn("object_key", key)
