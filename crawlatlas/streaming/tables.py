"""Running streams to tables in the shared folder.

State that outlives a batch is kept in versioned tables next to the checkpoint: batch
``b`` reads what batches before it wrote and overwrites only its own directory, so a
batch that is tried again after a lost executor or driver writes the same rows once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlatlas.session import scratch


def source(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table's files as a stream, a bounded number of them per batch. The table is one file or a folder of parts."""
    table = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", files_per_trigger)
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(location).isDirectory():
        return stream.parquet(table)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], path: str, mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop."""
    (stream.writeStream.outputMode(mode).foreachBatch(each)
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())


def batch_dir(path: str, table: str, batch: int) -> str:
    return f"{path}/{table}/batch={batch}"


def batches(spark: SparkSession, path: str, table: str) -> list[int]:
    """Batches that have written to a state table."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(location):
        return []
    names = [s.getPath().getName() for s in files.listStatus(location)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))


def version_before(spark: SparkSession, path: str, table: str, batch: int, schema: T.StructType) -> DataFrame:
    """The newest version of a table that was written before this batch."""
    older = [b for b in batches(spark, path, table) if b < batch]
    return spark.read.schema(schema).parquet(batch_dir(path, table, older[-1])) if older else (
        spark.createDataFrame([], schema))


def earlier(spark: SparkSession, path: str, table: str, batch: int, schema: T.StructType) -> DataFrame:
    """What the batches before this one wrote to a state table."""
    folders = f"{path}/{table}"
    if not any(b < batch for b in batches(spark, path, table)):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(T.StructType(schema.fields + [T.StructField("batch", T.LongType())])).parquet(folders)
    return stored.where(F.col("batch") < batch).drop("batch")


def write_batch(rows: DataFrame, path: str, table: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(batch_dir(path, table, batch))


def appended(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream to a table and read it."""
    spark = stream.sparkSession
    path = scratch(spark, label)
    run_available(stream, lambda rows, batch: write_batch(rows, path, "out", batch), path)
    return spark.read.parquet(f"{path}/out").select(*stream.columns)


def updated(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an update-mode stream and keep the newest row of each key."""
    spark = stream.sparkSession
    path = scratch(spark, label)
    run_available(stream, lambda rows, batch: write_batch(rows, path, "out", batch), path, "update")
    schema = T.StructType(stream.schema.fields + [T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/out")
    newest = F.max_by(F.struct(*stream.columns), "batch")
    return rows.groupBy(*keys).agg(newest.alias("_r")).select("_r.*")
