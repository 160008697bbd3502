"""Robots exclusion rules: the longest matching pattern of the agent's group decides."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A worker keeps the rules of this many texts of at most this length; of longer ones only the last.
KEPT_TEXTS, KEPT_LENGTH = 512, 4096


def _rules_for(text: str, agent: str) -> tuple:
    """(pattern length, allow, pieces, anchored) of the groups that name the agent, else of ``*``."""
    return (_kept_rules if len(text) <= KEPT_LENGTH else _last_rules)(text, agent)


def _parse_rules(text: str, agent: str) -> tuple:
    named, anyone, found = [], [], False
    active: list[str] = []
    in_head = False
    for line in text.splitlines():
        field, separator, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not separator:
            continue
        if field == "user-agent":
            active = active if in_head else []
            in_head = True
            token = value if value == "*" else re.match(r"[A-Za-z_-]*", value).group(0).lower()
            active.append(token)
            found = found or (token == agent and agent != "")
        elif field in ("allow", "disallow"):
            in_head = False
            if value:
                rule = (len(value), field == "allow", *_pieces(value))
                if agent in active:
                    named.append(rule)
                if "*" in active:
                    anyone.append(rule)
    return tuple(named if found else anyone)


_kept_rules, _last_rules = lru_cache(maxsize=KEPT_TEXTS)(_parse_rules), lru_cache(maxsize=1)(_parse_rules)


def _pieces(value: str) -> tuple[list[str], bool]:
    """The texts between the stars of a pattern, and whether it has to reach the end."""
    end = value.endswith("$")
    return (value[:-1] if end else value).split("*"), end


def pattern_matches(pieces: list[str], end: bool, path: str) -> bool:
    """Each piece at its first place behind the one before, which takes time in proportion to the path."""
    if not path.startswith(pieces[0]):
        return False
    at = len(pieces[0])
    if len(pieces) == 1:
        return not end or at == len(path)
    for piece in pieces[1:-1]:
        at = path.find(piece, at)
        if at < 0:
            return False
        at += len(piece)
    if end:
        return len(path) - at >= len(pieces[-1]) and path.endswith(pieces[-1])
    return path.find(pieces[-1], at) >= 0


def allows(rules: str, agent: str, url: str) -> bool:
    """Whether rules let an agent fetch a URL; without a matching pattern it may."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "", url).partition("#")[0] or "/"
    token = re.match(r"[A-Za-z_-]*", agent).group(0).lower()
    best = max(((n, allow) for n, allow, pieces, end in _rules_for(rules, token) if pattern_matches(pieces, end, path)),
               default=(0, True))
    return best[1]


def text_allows(rules: str, agent: str):
    """A function of URL columns for one text of rules, which goes to the workers with the code."""
    @F.pandas_udf(T.BooleanType())
    def judge(url: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else allows(rules, agent, u) for u in url], dtype="boolean")

    return judge


def sitemaps(rules: Column) -> Column:
    """Sitemap URLs named in rules."""
    return F.regexp_extract_all(rules, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
