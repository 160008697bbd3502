"""What streams remember by key, held in Spark's state store.

A batch looks up and changes only the entries that its rows name, so its cost does not depend on how many
batches came before it. Keys that may be hot (a job execution, a collection) are parted into shards by the
hash of what is remembered, so that no task holds all of one. Entries end: those of an ended job execution
when its end arrives, those of a digest when its period is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory of the stores of an executor is shared and bounded, by Spark's default size; the rest of the state is on disk.
BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
#: Keys that a job execution or a collection is parted into.
SHARDS = 16


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that maps and timers need."""
    before, bounded = spark.conf.get(PROVIDER), spark.conf.get(BOUNDED, "false")
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(BOUNDED, "true")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
        spark.conf.set(BOUNDED, bounded)


def _rank(row: Row, order: list[str]) -> tuple:
    """Ascending, nulls first, as Spark orders."""
    return tuple((row[c] is not None, row[c]) for c in order)


class FirstSights(StatefulProcessor):
    """The URIs that a job execution has seen, one shard of them."""

    def __init__(self, names: list[str], order: str):
        self.names, self.order = names, order

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "uri string", "known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - named by Spark
        first: dict[str, Row] = {}
        over, make = False, Row(*self.names)
        for r in rows:
            if r["_ended"]:
                over = True
                continue
            uri = "" if r["uri_hash"] is None else "+" + r["uri_hash"]
            if uri not in first or _rank(r, [self.order]) < _rank(first[uri], [self.order]):
                first[uri] = r
        for uri, r in first.items():
            if r["_forgotten"]:
                yield make(*[r[c] for c in self.names])
            elif not self.seen.containsKey((uri,)):
                self.seen.updateValue((uri,), (True,))
                yield make(*[r[c] for c in self.names])
        if over:
            self.seen.clear()

    def close(self) -> None:
        pass


def _first_in_batch(order: str):
    """Of the rows of a batch with the same URI only the first: a very frequent one is cut down before the shuffle."""

    def run(batches):
        for batch in batches:
            at = pc.sort_indices(batch.select([order]), sort_keys=[(order, "ascending")], null_placement="at_start")
            rows = batch.take(at)
            numbered = pa.table({"job": rows["job_execution_id"], "uri": rows["uri_hash"], "ended": rows["_ended"], "shard": rows["_shard"],
                                 "i": pa.array(np.arange(len(at)))})
            yield rows.take(numbered.group_by(["job", "uri", "ended", "shard"]).aggregate([("i", "min")])["i_min"].combine_chunks())

    return run


def first_sights(stream: DataFrame, order: str, ended_jobs: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """First sights of URIs (job_execution_id, uri_hash) as a stream.

    ``ended_jobs.job_execution_id`` are job executions that are over. As a stream, each end clears what its
    job execution has seen, after the rows of the same batch; as a table, those job executions are never
    remembered from one batch to the next.
    """
    kinds = stream.schema
    shard = F.pmod(F.xxhash64("uri_hash"), F.lit(shards)).cast("int")
    rows = stream.withColumns({"_shard": shard, "_ended": F.lit(False), "_forgotten": F.lit(False)})
    if ended_jobs is not None and ended_jobs.isStreaming:
        ends = ended_jobs.select(
            *[F.col(f.name) if f.name == "job_execution_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields],
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.lit(True).alias("_ended"), F.lit(False).alias("_forgotten"))
        rows = rows.unionByName(ends)
    elif ended_jobs is not None:
        over = ended_jobs.select(F.col("job_execution_id").alias("_over")).distinct()
        rows = rows.join(over, F.col("job_execution_id") == F.col("_over"), "left").withColumn(
            "_forgotten", F.col("_over").isNotNull()).drop("_over")
    few = rows.mapInArrow(_first_in_batch(order), rows.schema)
    return few.groupBy("job_execution_id", "_shard").transformWithState(
        FirstSights(kinds.names, order), kinds, "Append", "None")


class KnownContent(StatefulProcessor):
    """The first record of each content digest of a collection, one shard of them, until its period ends."""

    def __init__(self, names: list[str], order: list[str], record: str, timed: bool):
        self.names, self.order, self.record, self.timed = names, order, record, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "digest string", f"record {self.record}, expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        met: dict[str, tuple | None] = {}
        new, ends, make = {}, set(), Row(*self.names, "is_revisit", "refers_to")
        for r in sorted(rows, key=lambda r: _rank(r, self.order)):
            refers, digest = None, r["_digest"]
            if digest is not None:
                if digest not in met:
                    met[digest] = self.known.getValue((digest,)) if self.known.containsKey((digest,)) else None
                known = met[digest]
                if known is not None and (known[1] is None or known[1] > r["_now"]):
                    refers = known[0] if known[0] != r["record_id"] else None
                else:
                    met[digest] = new[digest] = (r["record_id"], r["_expires"])
            yield make(*[r[c] for c in self.names], refers is not None, refers)
        for digest, value in new.items():
            self.known.updateValue((digest,), value)
            if value[1] is not None:
                ends.add(value[1])
        if self.timed:
            for end in ends:
                self.handle.registerTimer(-(-end // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        over = [digest for digest, value in self.known.iterator() if value[1] is not None and value[1] <= now]
        for digest in over:
            self.known.removeKey(digest)
        return iter(())

    def close(self) -> None:
        pass


def known_content(stream: DataFrame, order: list[str], expires: Column, now: Column, time: str | None = None,
                  delay: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """``stream`` with is_revisit and refers_to, the first record of the same digest in the collection whose period is not over.

    A row compares with what is known at its own ``now``, so results do not depend on how rows fall into
    batches. With ``time``, a timestamp column, what is over is removed from the state when the watermark
    passes it (rows later than ``delay`` are dropped then); without, when its digest is met again.
    Rows that take no part go through by themselves.
    """
    digest = F.coalesce(F.nullif(F.col("digest"), F.lit("")), F.nullif(F.col("block_digest"), F.lit("")))
    names = stream.columns
    micros = {"_expires": F.unix_micros(expires.cast("timestamp")), "_now": F.unix_micros(now.cast("timestamp"))}
    rows = stream if time is None else stream.withWatermark(time, delay)
    rows = rows.withColumns({"_digest": F.when(F.col("record_type").isin("response", "resource"), digest), **micros})
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.coalesce("_digest", F.col("record_id").cast("string"))), F.lit(shards)).cast("int"))
    schema = T.StructType([*stream.schema.fields, T.StructField("is_revisit", T.BooleanType()),
                           T.StructField("refers_to", stream.schema["record_id"].dataType)])
    record = stream.schema["record_id"].dataType.simpleString()
    return rows.groupBy("collection", "_shard").transformWithState(
        KnownContent(names, order, record, time is not None), schema, "Append", "None" if time is None else "EventTime")
