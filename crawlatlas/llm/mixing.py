"""Mixing sources to target weights.

Words are summed up per source, and the budget is shared out by weight; what a source cannot take, as
its documents may be repeated only so often, goes to the others (the level that the sources share by
weight is found from running sums over the sources in the order in which they fill up). A source's
rate is its target by its size: every document goes out floor(rate) times, and once more by a draw
that comes up with the probability of the fraction.

A document's draw comes from the hash of its key and text, so that reruns agree and nothing is counted
or ordered. One hash gives a family of draws; each source uses the one that comes nearest to its target,
out of a stated number, which takes a single aggregate and evens out what a few long documents do.

Documents are never shuffled by source: sums are combined before they move, and the plan of the sources
is joined by ``skew.attach``, which spreads the rows of a hot source.

Defined results: null text has no words; null is a source of its own, the last; a document without words
is drawn like others and takes nothing; equal rows (of key and text) draw alike; a source without words
has the target 0; an empty table gives no rows; other columns travel inside ``doc``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlatlas.llm.common import materialize, text_or_empty
from crawlatlas.operators import ordered
from crawlatlas.operators.skew import attach

WORD = r"[^\x20\x09-\x0D]+"
#: Draws of which a source uses the one that comes nearest to its target.
DRAWS = 32
TURN = 4294967296  # draws are numbers below 2 ** 32


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc (the row), source, size (words), and a and b, from which the draws of the document follow."""
    seed = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), text_or_empty(text)).cast("binary"))
    number = [F.conv(F.substring(seed, at, 8), 16, 10).cast("long").alias(name) for name, at in (("a", 1), ("b", 9))]
    return docs.select(F.struct(*docs.columns).alias("doc"), F.col(source).alias("source"),
                       F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"), *number)


def targets(rows: DataFrame, cycle: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, rows, source_size and target: ``share`` of all words, dealt by weight, at most ``most`` times the source.

    The sources in order of code points weigh as ``cycle`` says, over and over.
    """
    per = materialize(rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")), "sources")
    ranked = ordered.row_numbers(per, [], [F.col("source").isNull(), F.col("source")], "rank")
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    weighed = ranked.withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(cycle) + 1).cast("int")).cast("long"))
    # A source fills up when the common level reaches ``full``.
    weighed = weighed.withColumn("full", F.lit(most) * F.col("source_size") / F.col("weight"))
    order = [F.col("full"), F.col("rank")]
    filling = ordered.running_sum(weighed, [], order, F.col("source_size"), "size_before")
    filling = ordered.running_sum(filling, [], order, F.col("weight"), "weight_before")
    filling = materialize(filling, "filling")
    total, weight = filling.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (total or 0)) - F.lit(most) * F.col("size_before")) / (F.lit(weight or 0) - F.col("weight_before"))
    # The first source that the level of those behind it does not fill up; none, if all are full.
    found = filling.where(level < F.col("full")).agg(F.min_by(level, F.struct("full", "rank"))).first()[0]
    cap = F.lit(most) * F.col("source_size")
    target = cap if found is None else F.least(cap, F.col("weight") * F.lit(found))
    return filling.select("source", "rows", "source_size", target.alias("target"))


def _copies(draw) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    number = (F.col("a") + draw * F.col("b")) % TURN
    return F.floor(rate) + (number < (rate - F.floor(rate)) * TURN).cast("long")


def planned(rows: DataFrame, shares: DataFrame, draws: int = DRAWS) -> DataFrame:
    """``targets`` with ``draw``, the number of the draw that comes nearest to the target; ties to the smallest."""
    met = attach(rows, shares, ["source"], ["source_size", "target"], rows="rows")
    sums = met.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.first("source_size").alias("source_size"),
                                     F.first("target").alias("target"),
                                     *[F.sum(F.col("size") * _copies(F.lit(k))).alias(f"s{k}") for k in range(draws)])
    off = F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("draw")) for k in range(draws)])
    return materialize(sums.select("source", "rows", "source_size", "target", F.array_min(off)["draw"].alias("draw")), "mix")


def drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target, copies and taken (the words of all copies)."""
    met = attach(rows, plan, ["source"], ["source_size", "target", "draw"], rows="rows")
    return met.withColumn("copies", _copies(F.col("draw"))).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: Sequence[int] = (3, 1, 2),
        share: float = 1.5, most: float = 2.0, draws: int = DRAWS) -> DataFrame:
    """The documents of the mix, each as often as it is taken: the columns of ``docs``, and ``copy`` from 1."""
    rows = measured(docs, key, text, source)
    sizes = materialize(rows.drop("doc"), "sizes")
    plan = planned(sizes, targets(sizes, cycle, share, most), draws)
    copies = drawn(rows, plan).where(F.col("copies") > 0)
    repeated = copies.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c != "copy"]
    return repeated.select(*kept, F.col("_copy").alias("copy"))
