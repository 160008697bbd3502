"""Document fingerprints by SpotSigs.

Wherever a common word (an anchor) stands, the next few content words behind it form a chain; anchor
and chain together are a signature. Stretches without anchors (other languages, code, tables) have a
signature at each of their words and numbers, which stands for an anchor there; a text that still has
none is one such stretch. The set of a document's signatures is its fingerprint. It depends on the
text alone, so an unchanged part of a text keeps its signatures. Sets are compared by Jaccard, and only where their sizes allow the wanted similarity: ``near_pairs`` deals sets
into partitions by size, so that a set meets its own and the next partitions only, and finds partners
by their rarest signatures.

Defined results: null text is the empty text; a text of fewer words than a signature has is one
signature; without letters and digits, what stands between blanks counts as words; a text of blanks
only has an empty set, and its fingerprint is the hash of its whole text, which is like that of an
equal text only; equal texts have equal fingerprints; repeated rows each get a result; extra columns
are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.llm.common import CHUNK, materialize, sha256_hex

# Common words of English, German, French and Spanish, which are anchors.
ANCHORS = frozenset("""
a an and are as at be by for from has he in is it of on or that the this to was were which with
als auf aus bei das dem den der des die ein eine er es für im ist mit nach nicht sich sie und von zu
au aux avec ce dans des du elle en est et il la le les ne ou par pas pour que qui se sur un une
al como con de del el en es esta la las lo los más no o para por que se su un una y
""".split())
#: Content words in a chain; share of hexadecimal digits kept of a signature's hash.
CHAIN, DIGITS = 2, 12
#: Words and numbers without an anchor that make a stretch; in texts of fewer than four times as many, a quarter of the text.
STRETCH = 8
# Letters of scripts that are written without blanks are words by themselves.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W\d_{ALONE}]+|\d+|[{ALONE}]")


def plain(words: list[str], chain: int) -> set[str]:
    """Chains of neighbouring words, each as long as an anchor with its chain."""
    return {" ".join(words[i:i + chain + 1]) for i in range(max(1, len(words) - chain))} if words else set()


def signatures(text: str, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> frozenset[str]:
    """Hashes of the chains behind the anchors of a text and of those in stretches without anchors."""
    words = WORD.findall(text.lower())
    content = [w for w in words if w not in anchors and not w[0].isdecimal()]
    stretch = min(STRETCH, max(chain + 1, len(words) // 4))
    found, seen, start = set(), 0, 0
    for i, w in enumerate(words):
        if w in anchors:
            if seen + chain <= len(content):
                found.add(" ".join((w, *content[seen:seen + chain])))
            if i - start >= stretch:
                found |= plain(words[start:i], chain)
            start = i + 1
        elif not w[0].isdecimal():
            seen += 1
    if len(words) - start >= stretch:
        found |= plain(words[start:], chain)
    found = found or plain(words or text.split(), chain)
    return frozenset(xxhash.xxh64_hexdigest(s)[:DIGITS] for s in found)


def fingerprint(text: str) -> str:
    """Sorted signatures, joined by commas; for a text of blanks only, a mark and the text's hash."""
    found = signatures(text)
    return ",".join(sorted(found)) if found else "=" + hashlib.sha256(text.encode()).hexdigest()[:DIGITS * 2]


def likeness(a: str, b: str, least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; 0 without comparing where sizes keep it below ``least``."""
    if a == b:
        return 1.0
    if a.startswith("=") or b.startswith("="):
        return 0.0
    x, y = a.split(","), b.split(",")
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    common = len(set(x).intersection(y))
    return common / (len(x) + len(y) - common)


def edited(text: str, after: str) -> str:
    """The last half of a text's code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _result(key, text: str, after: str, own: str, other: str) -> tuple:
    new = edited(text, after)
    changed = fingerprint(new)
    return (key, len(text), sha256_hex(new.encode()), own, changed, likeness(own, changed), likeness(own, other))


NAMES = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _ordered(key: str, text: str) -> list:
    """Columns that order rows by descending key, null keys last, equal keys by a hash of the text."""
    return [F.col(key).isNull().alias("o1"), F.coalesce(-F.col(key).cast("long"), F.lit(0)).alias("o2"), F.xxhash64(text).alias("o3")]


def slices_of(rows: DataFrame, slices: int) -> DataFrame:
    """``rows`` (o1, o2, o3, ...) with the number of their slice, slices being ranges of that order.

    Borders come from a sample of about 50 rows a slice; they only decide how even slices are.
    """
    total = rows.count()
    few = rows.select("o1", "o2", "o3").sample(min(1.0, 50 * slices / max(1, total)), seed=1).collect()
    seen = sorted(tuple(r) for r in few)
    borders = sorted({seen[i * len(seen) // slices] for i in range(1, slices)}) if seen else []

    @F.pandas_udf("int")
    def number(o1: pd.Series, o2: pd.Series, o3: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, r) for r in zip(o1, o2, o3, strict=True)], dtype="int32")

    return rows.withColumn("slice", number("o1", "o2", "o3"))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like they are to it and to the next text.

    The next row is that of the next smaller key (equal keys by a hash of the text, null keys last), and
    the first row for the last. Rows are dealt by ranges of that order; the first row of each range, one
    a range, is sent along to the range before it. So every text is shuffled once.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = slices_of(whole.select(*_ordered("key", "text"), "key", "text"), 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    heads = rows.groupBy("slice").agg(F.min(F.struct("o1", "o2", "o3")).alias("first")).collect()  # numbers, one a slice
    numbers = sorted((r["slice"], tuple(r["first"])) for r in heads)
    before = [(numbers[i - 1][0], *first) for i, (_, first) in enumerate(numbers)]
    wanted = spark.createDataFrame(before, "to int, h1 boolean, h2 long, h3 long")
    sent = (rows.join(F.broadcast(wanted), (F.col("o1") == F.col("h1")) & (F.col("o2") == F.col("h2")) & (F.col("o3") == F.col("h3")))
            .select(F.col("to").alias("slice"), F.lit(True).alias("sent"), "o1", "o2", "o3", "key", "text").dropDuplicates(["slice"]))
    every = rows.select("slice", F.lit(False).alias("sent"), "o1", "o2", "o3", "key", "text").unionByName(sent)
    dealt = every.repartition("slice").sortWithinPartitions("slice", "sent", "o1", "o2", "o3").select("slice", "sent", "key", "text")
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        at, waiting = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part, out = batch.slice(start, CHUNK), []
                for slice_no, is_sent, k, t in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    now = (k, t, fingerprint(t))
                    if waiting and slice_no == at:
                        out.append(_result(waiting[0], waiting[1], t, waiting[2], now[2]))
                    at, waiting = slice_no, None if is_sent else now
                columns = list(zip(*out, strict=True)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.column(2).type), *[
                    pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], NAMES)

    return dealt.mapInArrow(run, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("key", key)


def near_pairs(prints: DataFrame, least: float, key: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """a, b (fingerprints, a < b) and likeness of all pairs of different fingerprints that are at least ``least``.

    Sets are dealt by size: partition p holds sizes from least^-p to least^-(p+1), so partners are in the
    same partition or the next. Of a set of n signatures, n - ceil(least*n) + 1 of the rarest ones must
    hold one that the partner's have too. Copies are one fingerprint; join back on it for their rows.
    """
    sets = (prints.where(~F.col(column).startswith("=")).select(F.col(column).alias("print")).distinct()
            .withColumn("sigs", F.split("print", ",")).withColumn("n", F.size("sigs")))
    sets = materialize(sets, "sets")
    each = sets.select("print", "n", F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = (each.join(counts, "sig").groupBy("print", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("by_df")))  # one set's own signatures
    kept = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1
    band = F.floor(F.log("n") / math.log(1 / least) + 1e-9).cast("int")
    prefix = materialize(ranked.select("print", "n", band.alias("band"),
                                       F.explode(F.slice("by_df", F.lit(1), kept)).alias("s"))
                         .select("print", "n", "band", F.col("s.sig").alias("sig")), "prefix")
    left = prefix.select(F.col("print").alias("a"), F.col("n").alias("a_n"), "sig", F.explode(
        F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = prefix.select(F.col("print").alias("b"), F.col("n").alias("b_n"), "sig", "band")
    sizes = F.least("a_n", "b_n") >= F.lit(least) * F.greatest("a_n", "b_n") - 1e-9
    pairs = left.join(right, ["sig", "band"]).where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()
    common = F.size(F.array_intersect(F.split("a", ","), F.split("b", ",")))
    total = F.size(F.split("a", ",")) + F.size(F.split("b", ",")) - common
    return pairs.withColumn("likeness", common / total).where(F.col("likeness") >= least - 1e-9)
