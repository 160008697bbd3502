"""Scope checks: rule lists over a table of candidate URLs.

A rule is a matcher with outcomes. The rules of a list become one array of outcomes
per row, folded in order up to the first that stops, so a list of any length is one
projection. Candidates have ``uri, seed_uri, discovery_path, referrer`` and a map
``annotation`` of parameters.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlatlas.functions.urls import canonical, canonical_list, canonical_text, host_of, scope_anchor

# Scope statuses.
INCLUDE = 0
RUNTIME_EXCEPTION = -5
ILLEGAL_URI = -7
CHAFF_DETECTION = -4000
TOO_MANY_HOPS = -4001
TOO_MANY_TRANSITIVE_HOPS = -4002
BLOCKED = -5001
BLOCKED_BY_CUSTOM_PROCESSOR = -5002
NO_RULE = "No scope rules matched"

# Seeds whose hosts are already in canonical form but for case.
PLAIN_SEEDS = r"^[A-Za-z0-9:/?#.&=_~+, -]*$"



@dataclass(frozen=True)
class Param:
    """A named parameter of the candidate; a missing one is an error."""

    name: str


def param(name: str) -> Param:
    return Param(name)


def value_of(given: str | Param) -> Column:
    return F.try_element_at("annotation", F.lit(given.name)) if isinstance(given, Param) else F.lit(given)


class Candidate:
    """The columns rules look at; a transforming rule changes what later ones see."""

    def __init__(self, parsed: str = "_parsed"):
        self.parsed = F.col(parsed)
        self.href, self.query = F.col(parsed)["href"], F.col(parsed)["query"]

    def value(self, given: str | Param) -> Column:
        return value_of(given)

    def problem(self, *given) -> Column:
        """Message about the first missing parameter."""
        named = [p for p in given if isinstance(p, Param)]
        return F.coalesce(F.lit(None).cast("string"), *[
            F.when(self.value(p).isNull(), F.lit(f"no value with name '{p.name}'")) for p in named])


@dataclass(frozen=True)
class Rule:
    """A test with outcomes of the form (on match, status, goes on)."""

    test: Callable[[Candidate], Column]
    given: tuple = ()
    outcomes: tuple = ()
    problem: Callable[[Candidate], Column] | None = None
    problem_status: int = RUNTIME_EXCEPTION
    change: Callable[[Candidate], None] | None = None
    needs: int | None = None
    #: Lists that Python works out, for all rules in the same pass as the candidate: one worker a task does it all.
    lists: Callable[[], dict[str, Column]] = dict
    #: Columns that the test and the problem share, worked out once per row before them.
    columns: Callable[[], dict[str, Column]] = dict

    def then(self, status: int | None, proceed: bool = False) -> Rule:
        return replace(self, outcomes=self.outcomes + ((True, status, proceed),))

    def otherwise(self, status: int | None, proceed: bool = False) -> Rule:
        return replace(self, outcomes=self.outcomes + ((False, status, proceed),))

    def abort(self) -> Rule:
        """Stop on a match with the status there is."""
        return self.then(None)

    def entries(self, candidate: Candidate) -> list[Column]:
        if self.change is not None:
            self.change(candidate)
        missing = candidate.problem(*self.given)
        entry = F.when(missing.isNotNull(), _entry(RUNTIME_EXCEPTION, True, None, missing))
        if self.problem is not None:
            text = self.problem(candidate)
            entry = entry.when(text.isNotNull(), _entry(self.problem_status, True, None, text))
        match = F.coalesce(self.test(candidate), F.lit(False))
        # One entry holds both sides of the test, so that it is worked out once; errors stop before the others.
        entries = []
        for yes, no in zip_longest(*[[o for o in self.outcomes if o[0] is on] for on in (True, False)]):
            for on, outcome in ((match, yes), (~match, no)):
                if outcome is not None:
                    _, status, proceed = outcome
                    entry = entry.when(F.lit(True) if on is not match and yes else on, _entry(status, not proceed, self.needs, None))
            entries.append(entry)
            entry = F
        return entries or [entry]


def _entry(status: int | None, stop: bool, needs: int | None, error: Column | None) -> Column:
    return F.struct(
        F.lit(status).cast("int").alias("status"), F.lit(stop).alias("stop"),
        F.lit(needs).cast("int").alias("needs"),
        (F.lit(None).cast("string") if error is None else error).alias("error"))


def as_bool(value: Column) -> Column:
    """The parameter texts that mean true."""
    return F.coalesce(F.lower(value).isin("true", "yes", "ok"), F.lit(False))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def test(value: str | Param) -> Rule:
    return Rule(lambda c: as_bool(c.value(value)), (value,))


def is_scheme(schemes: str | Param) -> Rule:
    return Rule(lambda c: F.array_contains(_words(F.lower(c.value(schemes))), c.parsed["scheme"]), (schemes,))


def is_referrer(referrers: str | Param) -> Rule:
    """Only the list is lower-cased, not the referrer."""
    return Rule(lambda c: F.array_contains(
        _words(F.lower(c.value(referrers))), F.trim(F.coalesce(F.col("referrer"), F.lit("")))), (referrers,))


def is_same_host(include_subdomains: str | Param = "", alt_seeds: str | Param = "",
                 suffixes: list[str] | None = None) -> Rule:
    """Host of the seed or of an alternative seed; with sub-domains, hosts below the seed's anchor too.

    ``suffixes`` are rules of a public-suffix list, ``*.`` and ``!`` ones included (``suffix_rules`` reads them).
    """
    number = zlib.crc32(repr((include_subdomains, alt_seeds, suffixes)).encode())
    seeds, tails, odd = f"_seed_hosts_{number:x}", f"_seed_tails_{number:x}", f"_seed_odd_{number:x}"

    def seed_list() -> tuple[Column, Column, Column]:
        given = F.concat(_words(value_of(alt_seeds)), F.array(F.coalesce(F.col("seed_uri"), F.lit(""))))
        text = F.concat_ws(" ", given)
        return given, text, text.rlike(PLAIN_SEEDS)

    def lists() -> dict[str, Column]:
        _, text, plain = seed_list()
        return {odd: canonical_list(F.when(~plain, text))}

    def columns() -> dict[str, Column]:
        """Hosts as the canonicalizer writes them; only seeds that are not plain text take that way."""
        given, _, plain = seed_list()
        hosts = F.transform(F.when(plain, given).otherwise(F.col(odd)), host_of)
        below = F.transform(F.col(seeds), lambda h: F.concat(F.lit("."), scope_anchor(h, suffixes)))
        return {seeds: hosts, tails: F.when(as_bool(value_of(include_subdomains)), below)}

    def same(c: Candidate) -> Column:
        host = c.parsed["host"]
        dotted = F.concat(F.lit("."), host)
        return F.array_contains(seeds, host) | F.coalesce(F.exists(tails, lambda t: dotted.endswith(t)), F.lit(False))

    def unparsable(c: Candidate) -> Column:
        return F.when(F.array_contains(seeds, ""), F.lit("Could not parse seed"))

    return Rule(same, (include_subdomains, alt_seeds), problem=unparsable, problem_status=ILLEGAL_URI,
                lists=lists, columns=columns)


def exceeds_hops(path: Column, hops: Column, include_redirects: Column) -> Column:
    """More discovery steps than allowed, redirects counted only where asked for."""
    return F.length(F.when(include_redirects, path).otherwise(F.replace(path, F.lit("R"), F.lit("")))) > hops


def max_hops_from_seed(hops: str | Param, include_redirects: str | Param = "") -> Rule:
    """A text that is no number never matches; the text None is an error."""
    return Rule(
        lambda c: exceeds_hops(F.coalesce(F.col("discovery_path"), F.lit("")),
                               c.value(hops).try_cast("bigint"), as_bool(c.value(include_redirects))),
        (hops, include_redirects),
        problem=lambda c: F.when(c.value(hops) == "None", F.lit("None")))


def is_url(urls: str | Param) -> Rule:
    """A list given as text is made canonical once, here; one from a parameter, for each different text."""
    if isinstance(urls, Param):
        listed = f"_urls_{zlib.crc32(urls.name.encode()):x}"
        return Rule(lambda c: F.array_contains(listed, c.href), (urls,), lists=lambda: {listed: canonical_list(value_of(urls))})
    known = [canonical_text(u) for u in urls.split()]
    return Rule(lambda c: c.href.isin(known) if known else F.lit(False), (urls,))


def is_path_prefix(prefixes: str | Param) -> Rule:
    return Rule(lambda c: F.exists(_words(c.value(prefixes)), lambda p: c.parsed["path"].startswith(p)), (prefixes,))


def without_query(query: Column, name: str) -> Column:
    """Query text without the parameters of a name."""
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name))
    return F.when(query.isNotNull(), F.concat_ws("&", kept))


def remove_query(name: str) -> Rule:
    """Delete a query parameter from the candidate for the rules that follow."""
    def change(c: Candidate) -> None:
        c.query = without_query(c.query, name)
        base = F.substring_index(c.parsed["href"], "?", 1)
        c.href = F.when(c.query == "", base).otherwise(F.concat(base, F.lit("?"), c.query))

    return Rule(lambda c: F.lit(False), change=change)


def set_status(status: int) -> Rule:
    return Rule(lambda c: F.lit(True)).then(status, proceed=True)


def abort() -> Rule:
    return Rule(lambda c: F.lit(True)).abort()


def when_status(status: int) -> Rule:
    """Applies where the status so far is ``status``."""
    return replace(Rule(lambda c: F.lit(True)), needs=status)


def scope_default() -> list[Rule]:
    """The rules and parameter names that apply where nothing else is configured."""
    return [
        is_scheme(param("scope_allowedSchemes")).otherwise(BLOCKED),
        is_same_host(param("scope_includeSubdomains"), alt_seeds=param("scope_altSeeds"))
        .then(INCLUDE, proceed=True).otherwise(BLOCKED),
        max_hops_from_seed(param("scope_maxHopsFromSeed"), param("scope_hopsIncludeRedirects")).then(TOO_MANY_HOPS),
        is_url(param("scope_excludedUris")).then(BLOCKED),
    ]


def with_canonical(candidates: DataFrame, rules: list[Rule] = ()) -> DataFrame:
    """``_parsed`` and the columns that the rules share."""
    lists = {name: column for rule in rules for name, column in rule.lists().items()}
    rows = candidates.withColumns({"_parsed": canonical(F.col("uri"), fully=True), **lists})
    for rule in rules:
        for name, column in rule.columns().items():
            rows = rows.withColumn(name, column)
    return rows


def matches(candidates: DataFrame, rule: Rule, out: str = "match") -> DataFrame:
    """One matcher as a column; NULL where it cannot be evaluated."""
    rows = with_canonical(candidates, [rule])
    c = Candidate()
    if rule.change is not None:
        rule.change(c)
    bad = c.problem(*rule.given).isNotNull() | F.col("_parsed.error").isNotNull()
    if rule.problem is not None:
        bad = bad | rule.problem(c).isNotNull()
    return rows.withColumn(out, F.when(~bad, F.coalesce(rule.test(c), F.lit(False)))).drop(
        "_parsed", *rule.lists(), *rule.columns())


def _verdict(status: Column, message: Column) -> list[Column]:
    return [F.when(status == 0, "INCLUDE").otherwise("EXCLUDE").alias("evaluation"),
            status.alias("exclude_reason"), message.alias("error_msg")]


def scope_decide(candidates: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``evaluation, exclude_reason, error_msg`` and the parsed candidate as ``include_check_uri``."""
    c = Candidate()
    entries = F.array_compact(F.array(*[e for rule in rules for e in rule.entries(c)]))
    start = F.struct(F.lit(None).cast("int").alias("status"), F.lit(False).alias("stop"),
                     F.lit(None).cast("int").alias("needs"), F.lit(None).cast("string").alias("error"))

    def fold(acc: Column, e: Column) -> Column:
        skip = acc["stop"] | (e["needs"].isNotNull() & ~e["needs"].eqNullSafe(acc["status"]))
        return F.when(skip, acc).otherwise(F.struct(
            F.coalesce(e["status"], acc["status"]).alias("status"), e["stop"].alias("stop"),
            e["needs"].alias("needs"), e["error"].alias("error")))

    rows = with_canonical(candidates, rules).withColumn("_end", F.aggregate(entries, start, fold))
    illegal = F.col("_parsed.error").isNotNull()
    status = F.when(illegal, ILLEGAL_URI).otherwise(F.coalesce("_end.status", F.lit(BLOCKED)))
    message = (F.when(illegal, F.lit("error parsing uri"))
               .when(F.col("_end.status").isNull(), F.lit(NO_RULE)).otherwise(F.col("_end.error")))
    return rows.select(*candidates.columns, *_verdict(status, message), F.col("_parsed").alias("include_check_uri"))


def scope_user_rule(candidates: DataFrame, rule: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Status from a Python callable over Arrow batches of candidates and their parameters.

    The callable gets a frame with ``uri, seed_uri, discovery_path, referrer, annotation,
    host, path, query`` and returns one status per row, None where no rule matched.
    """
    @F.pandas_udf(T.IntegerType())
    def run(row: pd.DataFrame) -> pd.Series:
        return rule(row).astype("Int32")

    fields = F.struct(
        "uri", "seed_uri", "discovery_path", "referrer", "annotation",
        F.col("_parsed.host").alias("host"), F.col("_parsed.path").alias("path"), F.col("_parsed.query").alias("query"))
    rows = with_canonical(candidates).withColumn("_status", run(fields))
    status = F.when(F.col("_parsed.error").isNotNull(), ILLEGAL_URI).otherwise(F.coalesce("_status", F.lit(BLOCKED)))
    message = F.when(F.col("_parsed.error").isNotNull(), F.lit("error parsing uri")).when(
        F.col("_status").isNull(), F.lit(NO_RULE))
    return rows.select(*candidates.columns, *_verdict(status, message), F.col("_parsed").alias("include_check_uri"))


def scope_outcomes(decided: DataFrame) -> DataFrame:
    """Scope checks by exclude code, 0 for included."""
    return decided.groupBy("exclude_reason").agg(F.count(F.lit(1)).alias("n"))


def scope_log_filter(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Out-of-scope rows: those written to the log, and all of them for the out-of-scope job."""
    out = decided.where(F.col("exclude_reason") != INCLUDE)
    return out.where(~F.col("exclude_reason").isin(BLOCKED, TOO_MANY_HOPS)), out
