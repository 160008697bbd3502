"""Queue order, execution choice, pacing, first sight and content revisits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlatlas.operators import ordered
from crawlatlas.operators.skew import annotate


def politeness_delay(fetch_ms: Column, factor: Column, min_ms: Column, max_ms: Column) -> Column:
    """Delay after a fetch; the upper bound wins over the lower, bounds of 0 are unset."""
    f = F.when(factor == 0, 1.0).when(factor < 0, 0.0).otherwise(factor)
    delay = (fetch_ms * f).cast("bigint")
    delay = F.when(min_ms > 0, F.greatest(delay, min_ms)).otherwise(delay)
    return F.when(max_ms > 0, F.least(delay, max_ms)).otherwise(delay)


def politeness_slots(queue: DataFrame, slices: int | None = None) -> DataFrame:
    """Start offset of every queued URI: the sum of the delays before it in its host group."""
    order = [F.col("sequence"), F.col("earliest_fetch"), F.col("id")]
    return ordered.running_sum(queue, ["crawl_host_group_id"], order, F.col("delay_ms"), "start_offset_ms", slices)


def next_uri(queue: DataFrame, chosen: DataFrame, now_ms: int) -> DataFrame:
    """First URI per host group in the chosen execution, and whether it is due."""
    rows = queue.join(chosen.select("crawl_host_group_id", "execution_id"), ["crawl_host_group_id", "execution_id"])
    first = rows.groupBy("crawl_host_group_id", "execution_id").agg(
        F.min(F.struct("sequence", "earliest_fetch", "id")).alias("f")).select("crawl_host_group_id", "execution_id", "f.*")
    return first.withColumn("due", F.col("earliest_fetch") <= now_ms).withColumn(
        "due_at", F.when(F.col("earliest_fetch") > now_ms, F.col("earliest_fetch")))


def _draw(seed: str, *columns: str) -> Column:
    """A repeatable number in [0, 1) from a seed and columns, in place of a random generator."""
    text = F.concat_ws("|", F.lit(seed), *columns)
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296)


def weighted_execution_pick(queue: DataFrame, seed: str) -> DataFrame:
    """One execution per host group: uniform among those at or above a random share of the top weight.

    A URI without a discovery path is a seed and weighs 100 more.
    """
    weight = F.col("priority_weight") + F.when(F.col("discovery_path") == "", 100.0).otherwise(0.0)
    weights = queue.groupBy("crawl_host_group_id", "execution_id").agg(F.max(weight).alias("weight"))
    marked = annotate(weights, ["crawl_host_group_id"], {"_top": F.max("weight")})
    eligible = marked.where(F.col("weight") >= _draw(seed, "crawl_host_group_id") * F.col("_top"))
    picked = F.min(F.struct(_draw(seed, "crawl_host_group_id", "execution_id").alias("d"), "execution_id", "weight"))
    return eligible.groupBy("crawl_host_group_id").agg(picked.alias("p")).select(
        "crawl_host_group_id", "p.execution_id", "p.weight")


def revisit_mark(records: DataFrame, order: list[str], write: str | None = None) -> DataFrame:
    """Mark repeated content: the first (collection, digest) stays, later ones refer to it.

    Only responses and resources with a payload or block digest take part. Records of
    the write that brought the content first are not compared with each other.
    """
    digest = F.coalesce(F.nullif(F.col("digest"), F.lit("")), F.nullif(F.col("block_digest"), F.lit("")))
    comparable = F.col("record_type").isin("response", "resource") & digest.isNotNull()
    keyed = records.withColumn("_key", F.when(comparable, digest))
    call = write or "record_id"
    # Rows that take no part share the NULL key, one more group that may be hot.
    marked = annotate(keyed, ["collection", "_key"], {
        "_first": F.min(F.struct(*order, "record_id", call) if write else F.struct(*order, "record_id"))})
    repeat = F.col("_key").isNotNull() & (F.col(call) != F.col("_first")[call])
    return (marked.withColumn("refers_to", F.when(repeat, F.col("_first")["record_id"]))
            .drop("_first", "_key").withColumn("is_revisit", F.col("refers_to").isNotNull()))


def already_seen(uris: DataFrame, order: str, seen: DataFrame | None = None) -> DataFrame:
    """First sight of each URI in a job execution, earlier batches taken into account."""
    first = uris.groupBy("job_execution_id", "uri_hash").agg(
        F.min_by(F.struct(*uris.columns), order).alias("r")).select("r.*")
    return first if seen is None else first.join(seen, ["job_execution_id", "uri_hash"], "left_anti")


def oos_new_hosts(uris: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """First sight of each scheme and host."""
    hosts = uris.select("scheme", "host").distinct()
    return hosts if existing is None else hosts.join(existing, ["scheme", "host"], "left_anti")
