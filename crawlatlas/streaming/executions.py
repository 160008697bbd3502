"""Streams over execution changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.operators.rollups import change_sums, counted_changes, with_running
from crawlatlas.schemas import ABORT_STATES, COUNTERS, TERMINAL_STATES
from crawlatlas.session import scratch
from crawlatlas.streaming.tables import batches, earlier, run_available, write_batch

def state_machine(changes: DataFrame) -> DataFrame:
    """Stream of execution rows, one per execution that a batch changed.

    The rules come down to first and last values by sequence number (see ``fold_changes``), so the
    state is a built-in aggregate: changes of one execution are combined before they are shuffled,
    and changes that arrive late, in any batch, take their place by number. Only which end time
    holds depends on the first terminal change; the few changes with an end time are kept for that.
    """
    timed = changes.where(F.col("state") != "CREATED")
    for c in ("change_time", "end_time"):
        timed = timed.withColumn(c, F.col(c).cast("timestamp"))
    terminal, seq = F.col("state").isin(TERMINAL_STATES), F.col("seq")
    moves = F.col("state").isin("FETCHING", "SLEEPING")
    folded = timed.groupBy("execution_id").agg(
        F.coalesce(F.min_by("state", F.when(terminal, seq)), F.max_by("state", F.when(moves, seq)),
                   F.lit("CREATED")).alias("state"),
        F.min(F.when(terminal, seq)).alias("_ended"),
        F.array_sort(F.collect_set(F.when(F.col("end_time").isNotNull(), F.struct("seq", "end_time")))).alias("_ends"),
        F.min_by("change_time", F.when(terminal | (F.col("state") == "FETCHING"), seq)).alias("start_time"),
        F.max_by("change_time", seq).alias("last_change_time"),
        F.max_by("error_code", F.when(F.col("error_code").isNotNull(), seq)).alias("error_code"),
        F.coalesce(F.bool_or(F.col("state").isin(ABORT_STATES)), F.lit(False)).alias("desired_cleared"),
        *[F.sum("add_" + c).alias(c) for c in COUNTERS])
    ended = F.col("_ended")
    in_time = F.filter("_ends", lambda e: ended.isNull() | (e["seq"] <= ended))
    later = F.filter("_ends", lambda e: e["seq"] > ended)
    end = F.coalesce(F.get(in_time, F.size(in_time) - 1), F.get(later, F.lit(0)))["end_time"]
    return folded.select("execution_id", "state", "start_time", end.alias("end_time"), "last_change_time", "error_code",
                         "desired_cleared", *COUNTERS)


def job_totals_stream(changes: DataFrame) -> DataFrame:
    """Counters, state counts and running executions per job execution after the changes there are.

    Changes count from the one on that creates their job execution. Each batch writes its sums and the
    jobs it saw created; a batch knows those that earlier ones wrote.
    """
    spark = changes.sparkSession
    path = scratch(spark, "totals")
    created = changes.select(F.col("job_execution_id").alias("id")).schema

    def each(rows: DataFrame, batch: int) -> None:
        counted = counted_changes(rows, earlier(spark, path, "created", batch, created))
        write_batch(change_sums(counted).drop("running"), path, "sums", batch)
        new = rows.where(F.col("new_state") == "CREATED").select(F.col("job_execution_id").alias("id")).distinct()
        write_batch(new, path, "created", batch)

    run_available(changes, each, path)
    if not batches(spark, path, "sums"):
        return change_sums(spark.createDataFrame([], changes.schema))
    sums = spark.read.parquet(f"{path}/sums").drop("batch")
    names = [c for c in sums.columns if c != "job_execution_id"]
    return with_running(sums.groupBy("job_execution_id").agg(*[F.sum(c).alias(c) for c in names]))


def watch(changes: DataFrame, condition, delay: str = "1 hour") -> DataFrame:
    """New versions that match, exact repeats dropped while they are within ``delay``."""
    seen = [c for c in changes.columns if c not in ("seq", "change_time")]
    return (changes.where(condition).withColumn("change_time", F.col("change_time").cast("timestamp"))
            .withWatermark("change_time", delay).dropDuplicatesWithinWatermark(seen))


def watch_with_initial(changes: DataFrame, current: DataFrame, condition) -> DataFrame:
    """Current matches first, then the matching changes; the snapshot goes out with the first batch."""
    spark = changes.sparkSession
    path = scratch(spark, "watch")
    columns = current.columns

    def each(rows: DataFrame, batch: int) -> None:
        found = rows.where(condition).select(*columns, F.lit(False).alias("initial"))
        if batch == 0:
            found = current.where(condition).withColumn("initial", F.lit(True)).unionByName(found)
        write_batch(found, path, "out", batch)

    run_available(changes, each, path)
    if not batches(spark, path, "out"):  # nothing came in, the snapshot still goes out
        return current.where(condition).withColumn("initial", F.lit(True))
    return spark.read.parquet(f"{path}/out").select(*columns, "initial")
