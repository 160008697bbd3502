"""Robots snapshots, their state at a time, and what they allow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlatlas.functions.robots import allows, text_allows
from crawlatlas.operators import ordered
from crawlatlas.operators.skew import look_up
from crawlatlas.session import materialize

KEY = ["collection", "scheme", "host", "port"]
CUSTOM_IF_MISSING = ["CUSTOM_IF_MISSING", "CUSTOM_IF_MISSING_CLASSIC"]
OBEY = ["OBEY_ROBOTS", "OBEY_ROBOTS_CLASSIC"] + CUSTOM_IF_MISSING
CUSTOM = ["CUSTOM_ROBOTS", "CUSTOM_ROBOTS_CLASSIC"]


def keyed(rows: DataFrame) -> DataFrame:
    """Blank collections share one unscoped key."""
    return rows.withColumn("collection", F.when(F.coalesce("collection", F.lit("")) == "", "unscoped")
                           .otherwise(F.col("collection")))


def robots_snapshot(fetches: DataFrame, fresh_ms: int, retry_ms: int) -> DataFrame:
    """Cache row after each fetch of a robots file; ``rules_seq`` is the fetch that gave its rules.

    2xx gives rules and 3xx/4xx gives "no rules", both fresh for a while. Anything else
    keeps the last known rules, not fresh, and suppresses the next try for a while.
    """
    usable = F.col("http_status").between(200, 499)
    ok = F.col("http_status").between(200, 299)
    narrow = keyed(fetches).select(*KEY, "fetched_at", "seq", "http_status", F.when(
        usable, F.struct(F.when(ok, F.col("seq")).alias("rules_seq"), ok.alias("has_rules"))).alias("_known"))
    known = ordered.last_known(narrow, KEY, ["fetched_at", "seq"], "_known", "_last")
    return known.select(
        *KEY, "fetched_at", "seq", F.col("_last.rules_seq").alias("rules_seq"),
        F.coalesce(F.col("_last.has_rules"), F.lit(False)).alias("has_rules"),
        F.when(usable, F.col("fetched_at") + fresh_ms).alias("fresh_until"),
        F.when(~usable, F.col("fetched_at") + retry_ms).alias("retry_after"))


def with_rules(rows: DataFrame, fetches: DataFrame) -> DataFrame:
    """Add the text of the rules that ``rules_seq`` points at.

    Texts are only joined on at the end, they do not travel through the ordering.
    """
    texts = fetches.where(F.col("http_status").between(200, 299)).select("seq", F.col("body").alias("rules"))
    return look_up(rows, texts, {"rules_seq": "seq"}, ["rules"])


def robots_asof(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each request the snapshot in force at its time, and the state it is in.

    Both tables are put in one order per key and the newest snapshot is carried
    forward, instead of comparing times in a join.
    """
    values = F.struct("rules_seq", "has_rules", "fresh_until", "retry_after", "fetched_at")
    left = keyed(requests).select(
        *KEY, F.col("at").alias("_t"), F.lit(1).alias("_side"), F.col("request_id").alias("_tie"),
        F.lit(None).cast("struct<rules_seq:bigint,has_rules:boolean,fresh_until:bigint,retry_after:bigint,fetched_at:bigint>")
        .alias("_snapshot"), "request_id", "uri")
    right = keyed(snapshots).select(
        *KEY, F.col("fetched_at").alias("_t"), F.lit(0).alias("_side"),
        F.lpad(F.col("seq").cast("string"), 20, "0").alias("_tie"), values.alias("_snapshot"),
        F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("uri"))
    both = ordered.last_known(left.unionByName(right), KEY, ["_t", "_side", "_tie"], "_snapshot", "s")
    found = both.where("_side = 1")
    state = (F.when(F.col("s").isNull(), "missing")
             .when(F.col("_t") < F.col("s.fresh_until"), "fresh")
             .when(F.col("_t") < F.col("s.retry_after"), "suppressed").otherwise("stale"))
    return found.select("request_id", "uri", *KEY, F.col("_t").alias("at"), F.col("s.fetched_at").alias("fetched_at"),
                        F.col("s.rules_seq").alias("rules_seq"), F.col("s.has_rules").alias("has_rules"), state.alias("state"))


def judged_by_rules(rows: DataFrame, texts: DataFrame, key: str, agent: str, out: str, uri: str = "uri",
                    together: int = 100_000) -> DataFrame:
    """Add what the rules that ``key`` points at say of each URL; NULL where they do not exist.

    ``texts`` are ``key, rules``; a NULL text is none, and of several under one key the greatest holds. A
    text meets its URLs in a sorted partition, where it is parsed once for up to about ``together`` of
    them: neither is it joined to URL rows, nor broadcast, nor is a host with very many URLs one task.
    Only keys with more URLs than that are counted out and broadcast, at most rows / ``together`` of them.
    """
    columns = rows.columns
    asked = rows.where(F.col(key).isNotNull())
    many = (asked.groupBy(F.col(key).alias("_many")).agg(F.count(F.lit(1)).alias("_urls"))
            .where(F.col("_urls") > together).select("_many", F.ceil(F.col("_urls") / together).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    urls = asked.join(F.broadcast(many), F.col(key) == F.col("_many"), "left").select(
        *columns, F.pmod(F.xxhash64(uri), salts).cast("int").alias("_salt"), F.lit(None).cast("string").alias("_rules"))
    known = texts.where(F.col("rules").isNotNull()).select(F.col(key).alias("_k"), F.col("rules").alias("_rules"))
    heads = known.join(F.broadcast(many), F.col("_k") == F.col("_many"), "left").select(
        *[F.col("_k").alias(c) if c == key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns],
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), "_rules")
    # Heads, which have rules, come before the URLs of their key.
    dealt = urls.unionByName(heads).repartition(key, "_salt").sortWithinPartitions(
        key, "_salt", F.col("_rules").isNull(), "_rules")
    places = {c: i for i, c in enumerate([*columns, "_salt", "_rules"])}

    def run(batches):
        known, rules = None, None
        for batch in batches:
            said = []
            for of, text, url in zip(*(batch.column(places[c]).to_pylist() for c in (key, "_rules", uri)), strict=True):
                if text is not None:
                    known, rules = of, text
                    said.append(None)
                else:
                    said.append(allows(rules, agent, url) if of == known and url is not None else None)
            full = pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(said, pa.bool_())], [*columns, out])
            yield full.filter(batch.column(places["_rules"]).is_null())

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())])
    return dealt.mapInArrow(run, schema).unionByName(
        rows.where(F.col(key).isNull()).withColumn(out, F.lit(None).cast("boolean")))


def robots_allowed(rows: DataFrame, fetches: DataFrame, agent: str, policy: Column, custom: str) -> DataFrame:
    """Add ``allowed``: by policy, from the rules in force; NULL is a service error.

    ``rows`` carry the ``rules_seq`` of their host's rules, not the text. An answer without a body has no rules
    and allows everything.
    """
    ruled = F.coalesce(F.col("has_rules"), F.lit(False))
    unreachable = (F.col("state") == "suppressed") & ~ruled
    own = policy.isin(CUSTOM) | (policy.isin(CUSTOM_IF_MISSING) & ~ruled)
    texts = fetches.where(F.col("http_status").between(200, 299)).select(F.col("seq").alias("_seq"),
                                                                       F.coalesce("body", F.lit("")).alias("rules"))
    # Written once: the ordering behind the rows is not repeated for the counts and for those without rules.
    asked = materialize(rows.withColumn("_seq", F.when(policy.isin(OBEY) & ruled, F.col("rules_seq"))), "asked")
    judged = judged_by_rules(asked, texts, "_seq", agent, "_by_rules")
    by_custom = text_allows(custom, agent)(F.when(own, F.col("uri")))
    error = policy.isin("OBEY_ROBOTS", "OBEY_ROBOTS_CLASSIC") & unreachable
    return judged.withColumn("allowed", F.when(error, F.lit(None).cast("boolean"))
                             .when(F.col("_seq").isNotNull() & F.col("_by_rules").isNotNull(), F.col("_by_rules"))
                             .when(own, by_custom).otherwise(F.lit(True))).drop("_seq", "_by_rules")
