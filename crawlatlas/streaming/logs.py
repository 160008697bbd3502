"""Streams over logs, seen URIs, content digests and hosts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlatlas.operators.recent import replace_rewritten, retain
from crawlatlas.session import remove, scratch
from crawlatlas.streaming.state import first_sights, keyed_state, known_content
from crawlatlas.streaming.tables import batch_dir, batches, run_available, version_before, write_batch


def normalize_logs(logs: DataFrame, now: Column | None = None) -> DataFrame:
    """Stamp logs with the server's time and cut fetch times to milliseconds, unless forwarded."""
    stamp = F.date_trunc("MILLISECOND", F.current_timestamp() if now is None else now)
    fetched = F.date_trunc("MILLISECOND", F.col("fetch_time_stamp").cast("timestamp"))
    forwarded = F.coalesce(F.col("forwarded"), F.lit(False))
    return (logs.withColumn("time_stamp", F.when(forwarded, F.col("time_stamp").cast("timestamp")).otherwise(stamp))
            .withColumn("fetch_time_stamp", F.when(forwarded, F.col("fetch_time_stamp").cast("timestamp")).otherwise(fetched)))


def fanout(archive, recent, on_error=None):
    """Batch function: archive first, then the recent copy, whose failure never fails the batch.

    A failed archive write raises, so the recent copy is skipped and the batch is tried again.
    """
    def each(rows: DataFrame, batch: int) -> None:
        archive(rows, batch)
        try:
            recent(rows, batch)
        except Exception as error:  # noqa: BLE001 - the copy is only a convenience
            if on_error is not None:
                on_error(batch, error)

    return each


def recent_window(stream: DataFrame, crawl: int, page: int) -> DataFrame:
    """Newest rows per log type after every batch; each batch writes the next version of the window.

    Of the versions before it only the last one stays, from which a batch that is tried again starts.
    """
    spark = stream.sparkSession
    path = scratch(spark, "window")

    def each(rows: DataFrame, batch: int) -> None:
        before = version_before(spark, path, "window", batch, rows.schema)
        write_batch(retain(replace_rewritten(before.unionByName(rows)), crawl, page), path, "window", batch)
        for old in batches(spark, path, "window"):
            if old < batch - 1:
                remove(spark, batch_dir(path, "window", old))

    run_available(stream, each, path)
    written = batches(spark, path, "window")
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(batch_dir(path, "window", written[-1]))


def already_seen_stream(stream: DataFrame, order: str, ended_jobs: DataFrame | None = None) -> DataFrame:
    """First sights of URIs per job execution; what an ended job execution (``ended_jobs``) has seen is forgotten.

    See ``state.first_sights``.
    """
    return _stateful(first_sights(stream, order, ended_jobs), "seen")


def revisit_stream(stream: DataFrame, order: list[str], expires: Column, now: Column, time: str | None = None) -> DataFrame:
    """Mark repeated content against first sights whose period has not ended. See ``state.known_content``."""
    return _stateful(known_content(stream, order, expires, now, time), "revisit")


def _stateful(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream with keyed state over what is there and read what it gave."""
    spark = stream.sparkSession
    path = scratch(spark, label)
    with keyed_state(spark):
        run_available(stream, lambda rows, batch: write_batch(rows, path, "out", batch), path)
    if not batches(spark, path, "out"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def oos_stream(stream: DataFrame, existing: DataFrame) -> DataFrame:
    """First sight of each scheme and host that earlier output does not hold, as a stream.

    A host that fills much of a batch is cut down before the shuffle. Only first sights go on to earlier output.
    """
    few = stream.select("scheme", "host").mapInArrow(_distinct_in_batch, stream.select("scheme", "host").schema)
    return few.dropDuplicates(["scheme", "host"]).join(existing.select("scheme", "host"), ["scheme", "host"], "left_anti")


def new_oos_hosts(stream: DataFrame, existing: DataFrame) -> DataFrame:
    """Run ``oos_stream`` over what is there, with the hosts seen in the store on disk, whose files have Bloom filters:
    what a filter does not hold costs no read, and what it wrongly holds costs one look-up."""
    return _stateful(oos_stream(stream, existing), "oos")


def _distinct_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield from table.group_by(table.column_names).aggregate([]).select(table.column_names).to_batches()


def rate(rows: DataFrame, time: str, keys: list[str], window: str = "5 minutes", slide: str = "1 minute",
         seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Events per second over a sliding window. Rows later than ``delay`` are dropped from a stream."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark(time, delay)
    return (timed.groupBy(F.window(time, window, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_millis("w.start").alias("window_start"), *keys, (F.col("n") / seconds).alias("per_second")))


def mean_fetch_time(rows: DataFrame, time: str, millis: str, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Mean page time over a minute: the sum of times by their count."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark(time, delay)
    return (timed.groupBy(F.window(time, window).alias("w"))
            .agg(F.sum(millis).alias("total"), F.count(millis).alias("n"))
            .select(F.unix_millis("w.start").alias("window_start"), (F.col("total") / F.col("n")).alias("mean_ms")))
