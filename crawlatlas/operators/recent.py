"""The newest-first window over crawl and page logs.

What is kept of a log type are the rows from a cut-off on. The cut-off is selected by its bits, twelve
at a time: a count of the rows by the next twelve bits says which of these values it lies in, so no more
than 4 096 counts a type reach the driver in a round, and no row is sorted, numbered or written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlatlas.operators.listing import newest_first

#: Bits of the cut-off that one round settles.
BITS = 12


def replace_rewritten(rows: DataFrame) -> DataFrame:
    """One row per non-blank warc id and log type, the newest; blank ids are never merged."""
    named = F.coalesce(F.col("warc_id"), F.lit("")) != ""
    newest = (rows.where(named).groupBy("log_type", "warc_id")
              .agg(F.max_by(F.struct(*rows.columns), "ingestion_seq").alias("r")).select("r.*"))
    return newest.unionByName(rows.where(~named))


def cut_offs(rows: DataFrame, value: str, most: dict) -> dict:
    """{type: (cut-off, rows kept of those that are equal to it, rows that are)} of types with more than ``most`` rows.

    ``rows`` have ``log_type`` and a bigint column ``value``, not null.
    """
    ranges = {}
    for r in rows.groupBy("log_type").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect():
        if r["n"] > most[r["log_type"]] > 0:
            shift = 0
            while shift < 64 and r["lo"] >> shift != r["hi"] >> shift:
                shift += BITS
            # All values agree above ``shift``; the cut-off is the ``left``-th largest.
            ranges[r["log_type"]] = (r["hi"] >> shift, shift, most[r["log_type"]], r["n"])
    while any(shift for _, shift, _, _ in ranges.values()):
        open_ = {t: x for t, x in ranges.items() if x[1]}
        of = [F.col("log_type").eqNullSafe(F.lit(t)) & (F.shiftright(value, shift) == head if shift < 64 else F.lit(True))
              for t, (head, shift, _, _) in open_.items()]
        next_bits = F.coalesce(*[F.when(c, F.shiftright(value, x[1] - BITS)) for c, x in zip(of, open_.values(), strict=True)])
        counted = rows.where(reduce(lambda a, b: a | b, of)).groupBy("log_type", next_bits.alias("head")).agg(F.count(F.lit(1)).alias("n"))
        by_type: dict = {}
        for r in counted.collect():
            by_type.setdefault(r["log_type"], []).append((r["head"], r["n"]))
        for t, (_, shift, left, _) in open_.items():
            for head, n in sorted(by_type[t], reverse=True):
                if n >= left:
                    ranges[t] = (head, shift - BITS, left, n)
                    break
                left -= n
    return {t: (head, left, n) for t, (head, _, left, n) in ranges.items()}


def _is(types: list) -> Column:
    return reduce(lambda a, b: a | b, [F.col("log_type").eqNullSafe(F.lit(t)) for t in types], F.lit(False))


def _limits(rows: DataFrame, crawl: int, page: int) -> dict:
    """{type: rows that it may keep}; there are only the types of log that there are."""
    return {r["log_type"]: max(0, crawl if r["log_type"] == "crawl" else page) for r in rows.select("log_type").distinct().collect()}


def retain(rows: DataFrame, crawl: int, page: int) -> DataFrame:
    """The newest rows of each type, as many as its limit says; rows without a number are the oldest.

    Of rows of the same number those of the largest hash stay, and of equal rows any.
    """
    most = _limits(rows, crawl, page)
    seq = F.coalesce(F.col("ingestion_seq"), F.lit(-(1 << 63)).cast("bigint"))
    numbered = rows.withColumn("_seq", seq)
    cuts = cut_offs(numbered.select("log_type", "_seq"), "_seq", most)
    none = [t for t, n in most.items() if n == 0]
    if not cuts:
        return rows.where(~_is(none))
    above = reduce(lambda a, b: a | b, [F.col("log_type").eqNullSafe(F.lit(t)) & (F.col("_seq") > c) for t, (c, _, _) in cuts.items()])
    whole = [F.col("log_type").eqNullSafe(F.lit(t)) & (F.col("_seq") == c) for t, (c, left, n) in cuts.items() if left == n]
    kept = numbered.where(~_is([*cuts, *none]) | above | reduce(lambda a, b: a | b, whole, F.lit(False))).drop("_seq")
    ties = {t: (c, left) for t, (c, left, n) in cuts.items() if left < n}
    if not ties:
        return kept
    at_cut = reduce(lambda a, b: a | b, [F.col("log_type").eqNullSafe(F.lit(t)) & (F.col("_seq") == c) for t, (c, _) in ties.items()])
    tied = numbered.where(at_cut).drop("_seq").withColumn("_hash", F.xxhash64(*rows.columns))
    hashes = cut_offs(tied.select("log_type", "_hash"), "_hash", {t: left for t, (_, left) in ties.items()})
    larger = reduce(lambda a, b: a | b, [F.col("log_type").eqNullSafe(F.lit(t)) & (F.col("_hash") > c) for t, (c, _, _) in hashes.items()])
    equal = tied.where(reduce(lambda a, b: a | b, [F.col("log_type").eqNullSafe(F.lit(t)) & (F.col("_hash") == c) for t, (c, _, _) in hashes.items()]))
    left = F.coalesce(*[F.when(F.col("log_type").eqNullSafe(F.lit(t)), F.lit(n)) for t, (_, n, _) in hashes.items()])
    copies = equal.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).select(
        *rows.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("_n"), left.cast("bigint")))).alias("_copy")).drop("_copy")
    return kept.unionByName(tied.where(larger).drop("_hash")).unionByName(copies)


def window_stats(rows: DataFrame, crawl: int, page: int) -> DataFrame:
    """Rows kept and evicted and payload bytes kept, per type."""
    all_rows = rows.groupBy("log_type").agg(F.count(F.lit(1)).alias("_rows"))
    kept = retain(rows, crawl, page).groupBy(F.col("log_type").alias("_type")).agg(
        F.count(F.lit(1)).alias("_kept"), F.sum(F.length("payload")).alias("payload_bytes"))
    met = all_rows.join(kept, F.col("log_type").eqNullSafe(F.col("_type")), "left")
    n = F.coalesce("_kept", F.lit(0))
    return met.select("log_type", n.alias("kept"), (F.col("_rows") - n).alias("evicted"), "payload_bytes")


def by_execution(rows: DataFrame, execution_id: str, offset: int = 0, page_size: int = 0) -> DataFrame:
    """Newest first within an execution; a page size of 0 is unlimited."""
    return newest_first(rows.where(F.col("execution_id") == execution_id), "ingestion_seq", offset, page_size)
