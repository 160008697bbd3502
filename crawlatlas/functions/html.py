"""Outlinks of HTML pages.

Tags are found and attributes cut out by JVM expressions. Python sees only the links
that need entity decoding or full URL resolution, never the page.
"""

from __future__ import annotations

import html
import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every repetition is possessive: no attribute is tried twice, and the JVM does not recurse into a
# repeated group. A tag matches with or without the link, so what was read is not read again.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
_ATTRIBUTES = r"""(?:[\s/]++(?!href[\s=])[^\s=>"'/]++(?:\s*+=\s*+""" + _VALUE + r")?+)*+"
_HREF = r"(?:[\s/]++href\s*+=\s*+(" + _VALUE + "))?+"
LINK = r"(?is)<a(?:rea)?(?=[\s/])" + _ATTRIBUTES + _HREF
BASE = r"(?is)<base(?=[\s/])" + _ATTRIBUTES + _HREF
# What is not closed goes on to the end of the page, so each place is looked at once.
INERT = r"(?is)<!--.*?(?:-->|\z)" + "".join(
    rf"|<{tag}\b.*?(?:</{tag}\s*+>|\z)" for tag in ("script", "style", "template", "textarea", "title"))

_SIMPLE_SITE = r"^(https?://(?:[a-z0-9-]+\.)+[a-z]+)(?:[/?#].*)?$"
_SIMPLE_HREF = r"^(/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)+/?$"

# Characters left as they are in a path, a query and a fragment of a link.
_PATH, _QUERY = "!$%&'()*+,-./:;=@[\\]^_|~", "!$%&()*+,-./:;=?@[\\]^_`{|}~"


def absolute_url(base: str, href: str) -> str | None:
    """A link as a browser shows it: joined to its base, host in ASCII, text percent-encoded."""
    try:
        parts = urlsplit(urljoin(base, re.sub(r"[\t\r\n]", "", href.strip())))
        if not parts.scheme:
            return None
        if not parts.netloc:
            return parts.geturl()
        host = (parts.hostname or "")
        host = host if host.isascii() else ".".join(x.encode("idna").decode("ascii") for x in host.split("."))
        host = f"[{host}]" if ":" in host else host
        default = {"http": 80, "https": 443, "ftp": 21}.get(parts.scheme)
        port = "" if parts.port in (None, default) else f":{parts.port}"
        return urlunsplit((parts.scheme, host + port, quote(parts.path or "/", safe=_PATH),
                           quote(parts.query, safe=_QUERY), quote(parts.fragment, safe=_QUERY)))
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(T.StringType())
def _resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else absolute_url(b, html.unescape(h)) for b, h in zip(base, href)],
                     dtype="object")


# Spark would copy a deterministic call into every filter above it.
_resolve = _resolve.asNondeterministic()


def raw_links(page: Column) -> Column:
    """Values of every ``a[href]`` and ``area[href]``, comments and scripts left out."""
    live = F.regexp_replace(page, INERT, " ")
    return F.transform(_values(live, LINK), _unquoted)


def _values(text: Column, tag: str) -> Column:
    """The link of each tag that has one."""
    return F.filter(F.regexp_extract_all(text, F.lit(tag), F.lit(1)), lambda v: v != "")


def _unquoted(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def extract_outlinks(pages: DataFrame) -> DataFrame:
    """Distinct absolute outlinks of each page (``page_id, url, html``), the page itself left out."""
    # The page itself ends here: only links and the base address go on. The outer form
    # of explode keeps Spark from testing the size of the list by finding the links twice.
    cut = pages.select(
        "page_id", F.col("url").alias("page_url"), _unquoted(F.coalesce(F.get(_values(F.col("html"), BASE), 0), F.lit(""))).alias("_base"),
        F.array_distinct(raw_links(F.col("html"))).alias("_links"))
    found = cut.select("page_id", "page_url", "_base", F.explode_outer("_links").alias("_href"))
    href = F.trim(F.col("_href"))
    found = found.where((href != "") & (href != "#") & ~F.lower(href).rlike("^(tel|mailto):"))
    site = F.when(F.col("_base") == "", F.regexp_extract("page_url", _SIMPLE_SITE, 1)).otherwise("")
    simple = (site != "") & href.rlike(_SIMPLE_HREF)
    given_base = F.when(F.col("_base") == "", F.col("page_url")).otherwise(F.col("_base"))
    resolved = F.coalesce(F.when(simple, F.concat(site, href)),
                          _resolve(given_base, F.when(~simple, F.col("_href"))))
    cleaned = F.regexp_replace(F.trim(resolved), r'^["\\]+|["\\]+$', "")
    return (found.select("page_id", "page_url", cleaned.alias("uri"))
            .where("uri IS NOT NULL AND uri <> '' AND uri <> page_url").distinct())


def outlink_rows(outlinks: DataFrame, roots: DataFrame) -> DataFrame:
    """Queue rows of outlinks: path of the page's root request and L, referrer its URL."""
    root = roots.select("page_id", F.col("url").alias("referrer"), F.col("discovery_path").alias("_path"))
    return outlinks.join(root, "page_id").select(
        "page_id", "uri", F.concat("_path", F.lit("L")).alias("discovery_path"), "referrer")
