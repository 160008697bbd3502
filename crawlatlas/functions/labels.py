"""Label selectors and label predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_selector(selector: str) -> tuple[str, str, bool]:
    """Lower-cased key, value and whether the value is a prefix; without ``:`` it is a value."""
    key, separator, value = selector.partition(":")
    if not separator:
        key, value = "", key
    key, value = key.lower(), value.lower()
    return (key, value[:-1], True) if value.endswith("*") else (key, value, False)


def matches_selector(labels: Column, selector: str) -> Column:
    """At least one label matches; an empty key or value matches any."""
    key, value, prefix = parse_selector(selector)

    def one(label: Column) -> Column:
        tests = []
        if key:
            tests.append(F.lower(label["key"]) == key)
        if value:
            tests.append(F.lower(label["value"]).startswith(value) if prefix
                         else F.lower(label["value"]) == value)
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    return F.coalesce(F.exists(labels, one), F.lit(False))


def matches_all(labels: Column, selectors: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [matches_selector(labels, s) for s in selectors], F.lit(True))


def has_all_labels(labels: Column, wanted: list[tuple[str, str]]) -> Column:
    """Every given label is present exactly."""
    lits = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in wanted])
    return F.size(F.array_except(lits, F.coalesce(labels, F.array().cast("array<struct<key:string,value:string>>")))) == 0


def first_label(labels: Column, key: str, default: str) -> Column:
    """Lower-cased value of the first label with a key."""
    found = F.filter(labels, lambda e: e["key"] == key)
    return F.lower(F.coalesce(F.get(found, 0)["value"], F.lit(default)))


def selector_tokens(labels: Column) -> Column:
    """Everything a selector could ask of these labels, so that matching is an equi join.

    A prefix selector asks for a prefix token, so each value contributes one per length.
    """
    def per_label(label: Column) -> Column:
        k, v = F.lower(label["key"]), F.lower(label["value"])
        prefixes = F.transform(F.sequence(F.lit(0), F.length(v)), lambda n: F.substring(v, F.lit(1), n))
        return F.flatten(F.array(
            F.array(F.concat(F.lit("="), k, F.lit("\n"), v), F.concat(F.lit("="), k, F.lit("\n")),
                    F.concat(F.lit("=\n"), v), F.lit("=\n")),
            F.transform(prefixes, lambda p: F.concat(F.lit("*"), k, F.lit("\n"), p)),
            F.transform(prefixes, lambda p: F.concat(F.lit("*\n"), p))))

    return F.array_distinct(F.flatten(F.transform(labels, per_label)))


def selector_token(selector: Column) -> Column:
    """The token that a selector string asks for."""
    s = F.lower(selector)
    has_key = F.instr(s, ":") > 0
    key = F.when(has_key, F.substring_index(s, ":", 1)).otherwise(F.lit(""))
    value = F.when(has_key, F.substring(s, F.instr(s, ":") + 1, F.length(s))).otherwise(s)
    return F.when(value.endswith("*"), F.concat(F.lit("*"), key, F.lit("\n"), F.regexp_replace(value, r"\*$", ""))) \
            .otherwise(F.concat(F.lit("="), key, F.lit("\n"), value))
