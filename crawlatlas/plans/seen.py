"""The URIs that job executions have seen, as a lasting bucketed table.

The table is bucketed by (job execution, URI hash), the keys of the anti-join that admission does. Spark
reads its buckets as they lie: only the new rows are shuffled, to as many partitions as there are buckets,
and what earlier runs have seen is never shuffled again, however much it is. A run appends what it has
queued. Job executions that are over leave when the table is compacted, which also makes one file of the
many that a bucket has got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlatlas.session import discard, materialize

KEYS = ["job_execution_id", "uri_hash"]


def seen_table(spark: SparkSession, name: str, path: str, buckets: int = 256) -> DataFrame:
    """The table at ``path``, known as ``name`` in this session; made empty where there is none.

    ``path`` has to be shared and is all that lasts, so that any session with the same number of buckets can go on.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` (job_execution_id STRING, uri_hash STRING) USING parquet "
              f"CLUSTERED BY (job_execution_id, uri_hash) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def remember(admitted: DataFrame, name: str) -> None:
    """Append what was queued, dealt by bucket so that each gets one file. ``admitted`` must be a written table."""
    spark = admitted.sparkSession
    buckets = _buckets(spark, name)
    queued = admitted.where(F.col("decision") == "QUEUED").select(*KEYS).distinct()
    queued.repartition(buckets, *KEYS).write.insertInto(name)


def compact(spark: SparkSession, name: str, ended_jobs: DataFrame | None = None) -> None:
    """Write each bucket anew as one file, without the job executions of ``ended_jobs.job_execution_id``."""
    kept = spark.table(name)
    if ended_jobs is not None:
        kept = kept.join(ended_jobs.select("job_execution_id").distinct(), "job_execution_id", "left_anti").select(*KEYS)
    copy = materialize(kept.distinct(), "seen")
    copy.repartition(_buckets(spark, name), *KEYS).write.insertInto(name, overwrite=True)
    discard(copy)


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED `{name}`").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def without_seen(first: DataFrame, seen: DataFrame) -> DataFrame:
    """``first`` (unique keys) without the keys that ``seen`` has."""
    # Merged by key, so that a large table is not shuffled even where it could be broadcast.
    return first.join(seen.select(*KEYS).hint("merge"), KEYS, "left_anti")
