"""Set selections over seeds, jobs, scripts, executions and write requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlatlas.operators.skew import look_up
from crawlatlas.schemas import ABORT_STATES, ACTIVE_STATES, STRINGS
from crawlatlas.session import materialize

# Schemes a browser resolves without the network.
BROWSER_LOCAL_SCHEMES = ["data", "blob", "about", "javascript", "chrome", "devtools"]


def abort_requests(executions: DataFrame) -> DataFrame:
    """Active executions that somebody wants aborted."""
    return executions.where(F.col("state").isin(ACTIVE_STATES) & F.col("desired_state").isin(ABORT_STATES))


def enabled_seeds_for_job(seeds: DataFrame, job_id: str) -> DataFrame:
    """Seeds that name the job and are not disabled."""
    return seeds.where(F.exists("seed.jobRef", lambda r: r["id"] == job_id)
                       & ~F.coalesce(F.col("seed.disabled"), F.lit(False)))


def startable_jobs(jobs: DataFrame, schedules: DataFrame, executions: DataFrame, now: str,
                   paused: bool = False) -> DataFrame:
    """Enabled jobs with a valid, non-empty schedule and no running execution."""
    at = F.lit(now).cast("timestamp_ntz")
    schedule = schedules.select(F.col("id").alias("schedule_id"), "cron", "valid_from", "valid_to")
    running = executions.where(F.col("state") == "RUNNING").select(F.col("job_id").alias("id"))
    ready = (jobs.where(~F.coalesce(F.col("disabled"), F.lit(False)) & F.lit(not paused))
             .join(schedule, "schedule_id")
             .where((F.col("cron") != "")
                    & (F.col("valid_from").isNull() | (F.col("valid_from") < at))
                    & (F.col("valid_to").isNull() | (F.col("valid_to") > at))))
    return ready.join(running, "id", "left_anti")


#: Letters of the piece of text that a pattern is looked up by.
GRAM = 4
_QUANTIFIERS = "*?{"
_NO_GRAM = ""


def required_texts(pattern: str) -> list[tuple[str, list[str]]]:
    """Alternatives of a pattern, each with the texts that stand in whatever it matches.

    Groups, classes and optional letters are left out. A pattern with flags, quotes or escapes that
    are not plain letters or classes is not looked into: it is one alternative without such a text.
    """
    whole = [(pattern, [])]
    parts, texts, text, start, i = [], [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1:i + 2].isalnum() and pattern[i + 1] not in "dDwWsSbB" or i + 1 == len(pattern):
                return whole
            text, i, plain = (text, i + 2, None) if pattern[i + 1].isalnum() else (text, i + 2, pattern[i + 1])
        elif c in "([":
            depth, end = 0, i
            while end < len(pattern):  # to the bracket that ends the outermost group or class
                if pattern[end] == "\\":
                    if pattern[end + 1:end + 2] in ("Q", "E"):
                        return whole
                    end += 1
                elif pattern[end] == "[":
                    close = pattern.find("]", end + 2)
                    inner = pattern[end + 1:close]
                    if close < 0 or "[" in inner or "\\" in inner or "&&" in inner or inner == "^":
                        return whole
                    end = close
                elif pattern[end] in "()":
                    if pattern.startswith("(?", end) and pattern[end + 2:end + 3] not in (":", "=", "!"):
                        return whole
                    depth += 1 if pattern[end] == "(" else -1
                if depth == 0:
                    break
                end += 1
            if end >= len(pattern):
                return whole
            i, plain = end + 1, None
        elif c == "|":
            parts.append((pattern[start:i], [*texts, text]))
            texts, text, start, i = [], "", i + 1, i + 1
            continue
        else:
            i, plain = i + 1, None if c in ".^$" or c in _QUANTIFIERS or c in "+)]}" else c
            if c == ")":
                return whole
        follows = pattern[i:i + 1]
        if plain is None or follows and follows in _QUANTIFIERS:
            texts, text = [*texts, text], ""
            if follows == "{":
                end = pattern.find("}", i)
                if end < 0:
                    return whole
                i = end + 1
        elif follows == "+":
            texts, text = [*texts, text + plain], ""
        else:
            text += plain
    parts.append((pattern[start:], [*texts, text]))
    return [(p, [t for t in own if len(t) >= GRAM]) for p, own in parts]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("grams", STRINGS)])))
def _alternatives(patterns: pd.Series) -> pd.Series:
    """Every alternative of a script's patterns with the pieces of text that it may be looked up by."""
    def pieces(texts: list[str]) -> list[str]:
        return sorted({t[i:i + GRAM] for t in texts for i in range(len(t) - GRAM + 1)})

    return patterns.map(lambda own: [{"pattern": p, "grams": pieces(texts)}
                                     for given in ([] if own is None else own) if given is not None
                                     for p, texts in required_texts(given)])


def _grams(url: Column) -> Column:
    """Different pieces of a URL, and the one that patterns without a required text go by."""
    # A URL without letters is taken as one letter, for which there is no piece either.
    ends = F.sequence(F.lit(1), F.greatest(F.length(url) - GRAM + 1, F.lit(1)))
    own = F.filter(F.transform(ends, lambda i: F.substring(url, i, GRAM)), lambda g: F.length(g) == GRAM)
    return F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array(F.lit(_NO_GRAM))))


def selected_scripts(urls: DataFrame, scripts: DataFrame, script_type: str, url: str = "url",
                     sample: float = 0.01) -> DataFrame:
    """Scripts of a type for each URL: those without patterns, and those with one that matches.

    Each alternative of a pattern is looked up by one piece of a text that it requires, the rarest in a
    share ``sample`` of the URLs (which decides nothing but cost); the pattern itself then decides. The
    scripts stay a table: Spark broadcasts their pieces while these are small and shuffles by piece beyond.
    Patterns without a required text are spread, with the URLs, over salts, so that no key holds all URLs.

    Defined results: a null URL has the scripts without patterns; equal rows each get theirs; a null
    pattern never matches; a script given twice comes twice.
    """
    salts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = scripts.where(F.col("script_type") == script_type).select(
        F.col("script_id").alias("_script"), F.coalesce(F.size("url_regexp"), F.lit(0)) < 1, "url_regexp").toDF(
        "_script", "_all", "_given")
    rules = materialize(rules.select("_script", "_all", _alternatives(F.col("_given")).alias("_alternatives"),
                                     F.monotonically_increasing_id().alias("_rule")), "scripts")
    places = rules.select("_rule", F.posexplode("_alternatives").alias("_at", "_own"))
    offered = places.select("_rule", "_at", F.explode("_own.grams").alias("_gram"))
    common = urls.sample(sample, seed=0).select(F.explode(_grams(F.col(url))).alias("_gram")).groupBy("_gram").agg(
        F.count(F.lit(1)).alias("_n"))
    rarest = offered.join(common, "_gram", "left").groupBy("_rule", "_at").agg(
        F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    keyed = (places.select("_rule", "_at").join(rarest, ["_rule", "_at"], "left")
             .unionByName(rules.where("_all").select("_rule", F.lit(-1).alias("_at"), F.lit(None).cast("string").alias("_gram")))
             .join(rules, "_rule")
             .select("_script", "_alternatives.pattern", "_at", F.coalesce("_gram", F.lit(_NO_GRAM)).alias("_gram"))
             .withColumnRenamed("pattern", "_patterns"))
    keyed = materialize(keyed.withColumn("_salt", F.explode(F.when(
        F.col("_gram") == _NO_GRAM, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))), "keyed")
    # The row travels as one column, so that its names cannot clash with those in use here.
    asked = urls.select(F.struct(*urls.columns).alias("_row"), F.col(url).alias("_url"), F.explode(_grams(F.col(url))).alias("_gram"))
    asked = asked.withColumn("_salt", F.when(
        F.col("_gram") == _NO_GRAM, F.pmod(F.xxhash64("_url"), F.lit(salts))).otherwise(0).cast("int"))
    met = asked.join(keyed, ["_gram", "_salt"])
    # A script comes once a URL: at the first of its alternatives that matches.
    at = F.greatest("_at", F.lit(0))
    first = F.when(F.col("_at") >= 0, F.get("_patterns", at))
    earlier = F.exists(F.slice("_patterns", F.lit(1), at), lambda p: F.rlike(F.col("_url"), p))
    chosen = met.where((F.col("_at") < 0) | (F.rlike(F.col("_url"), first) & ~earlier))
    return chosen.select("_row.*", F.col("_script").alias("script_id"))


def is_browser_local(url: Column) -> Column:
    """The URL has a scheme that never reaches the network."""
    return url.contains(":") & F.lower(F.substring_index(url, ":", 1)).isin(BROWSER_LOCAL_SCHEMES)


def validate_write_requests(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """Add ``reason``, empty where a request may be written; the first failing check names it."""
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    known = collections.select("id").distinct().withColumn("_known", F.lit(True))
    return look_up(requests, known, {"collection_id": "id"}, ["_known"]).withColumn(
        "reason",
        F.when(~F.col("has_meta"), "missing metadata object")
         .when(blank("collection_id"), "missing collection ref")
         .when(blank("ip_address"), "missing IP-address")
         .when(blank("target_uri"), "missing target URI")
         .when(F.col("_known").isNull(), F.concat(F.lit("unknown collection: "), "collection_id"))
         .when(~F.col("has_record_meta"), "missing record metadata")
         .otherwise("")).drop("_known")
