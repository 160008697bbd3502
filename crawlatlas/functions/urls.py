"""URL, host and address work on columns.

What SQL can say stays in the JVM. Full canonicalization runs in Arrow batches, and
URLs that already have their canonical form never reach Python.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterable
from functools import lru_cache
from urllib.parse import quote, quote_plus, unquote, unquote_plus, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlatlas.schemas import PARSED_URI, PARSED_URI_FIELDS, STRINGS

# Schemes with an authority, and their default ports.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}

# Characters that stay as they are in a path, a query value and a fragment.
PATH_SAFE = "!$%&'()*+,-./:;=@[\\]^_|~"
FORM_SAFE = "*-._"

# Multi-label public suffixes known by default; replace them with a full list.
PUBLIC_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
    "or.jp", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr", "priv.no", "kommune.no",
    "github.io", "blogspot.com", "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg",
]

COUNTRY_SUFFIX = r"^(?:ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org|sch)\.[a-z]{2}$"

WWW = r"(?i)^www[0-9]*\.."

_SIMPLE = r"^https?://[a-z0-9]([a-z0-9-]*\.)+[a-z]+(/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)*/?$"
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


def _decode_fully(text: str) -> str:
    """Percent-decode until nothing changes."""
    while True:
        decoded = unquote(text, errors="surrogateescape")
        if decoded == text:
            return text
        text = decoded


def _encode_path(path: str, fully: bool) -> str:
    if fully:
        path = _decode_fully(path).replace("%", "%25").replace("?", "%3F").replace("#", "%23")
    return quote(path, safe=PATH_SAFE, errors="surrogateescape")


def _normal_path(path: str, fully: bool) -> str:
    kept: list[str] = []
    segments = path.replace("\\", "/").lstrip("/").split("/")
    for i, segment in enumerate(segments):
        dots = segment.lower().replace("%2e", ".")
        last = i == len(segments) - 1
        if dots == "..":
            if kept:
                kept.pop()
            if last:
                kept.append("")
        elif dots == ".":
            if last:
                kept.append("")
        elif segment or last:
            kept.append(segment)
    return "/" + "/".join(_encode_path(s, fully) for s in kept)


def _sorted_query(query: str, fully: bool) -> str:
    """Parameters by key, stable, without ``=`` where the value is empty."""
    pairs = []
    for part in query.split("&"):
        if part:
            name, _, value = part.partition("=")
            name, value = (unquote_plus(x, errors="surrogateescape") for x in (name, value))
            pairs.append((_decode_fully(name), _decode_fully(value)) if fully else (name, value))
    pairs.sort(key=lambda p: p[0])

    def form(text: str) -> str:
        return quote_plus(text, safe=FORM_SAFE, errors="surrogateescape")

    return "&".join(form(n) + ("=" + form(v) if v else "") for n, v in pairs)


def _ascii_host(host: str) -> str:
    host = unquote_to_bytes(host).decode("utf-8", "strict").lower()
    if host.startswith("["):
        return "[" + ipaddress.IPv6Address(host.strip("[]")).compressed + "]"
    if not host.isascii():
        host = ".".join(label.encode("idna").decode("ascii") for label in host.split("."))
    if not host or _BAD_HOST.search(host):
        raise ValueError("invalid host")
    return host


#: A worker remembers parts of this many URLs, none of them longer than this: some 20 MB, whatever the table.
KEPT_URLS, KEPT_LENGTH = 8192, 512


def parse_uri(text: str, fully: bool = False, keep_fragment: bool = False) -> tuple:
    """href, scheme, host, port, username, password, path, query, fragment, error of one URL."""
    return (_kept_uri if len(text) <= KEPT_LENGTH else _parse_uri)(text, fully, keep_fragment)


def _parse_uri(text: str, fully: bool, keep_fragment: bool) -> tuple:
    try:
        cleaned = re.sub(r"[\t\r\n]", "", text.strip("".join(map(chr, range(33)))))
        if not cleaned:
            raise ValueError("empty url")
        match = _SCHEME.match(cleaned)
        scheme, rest = (match.group(1).lower(), cleaned[match.end():]) if match else ("http", cleaned)
        rest, mark, fragment = rest.partition("#")
        tail = "#" + fragment if mark and keep_fragment else ""
        if scheme not in DEFAULT_PORTS:
            path, mark, query = rest.partition("?")
            return (f"{scheme}:{rest}{tail}", scheme, "", 0, "", "", path, query, tail[1:], None)
        rest, _, query = rest.partition("?")
        authority, path = re.match(r"^[/\\]*([^/\\]*)(.*)$", rest, re.S).groups()
        authority = authority.rpartition("@")[2]
        port_match = re.search(r":(\d*)$", authority)
        host = _ascii_host(authority[:port_match.start()] if port_match else authority)
        port = int(port_match.group(1)) if port_match and port_match.group(1) else DEFAULT_PORTS[scheme]
        if port > 65535:
            raise ValueError("invalid port")
        path, query = _normal_path(path, fully), _sorted_query(query, fully)
        shown = "" if port == DEFAULT_PORTS[scheme] else f":{port}"
        href = f"{scheme}://{host}{shown}{path}{'?' + query if query else ''}{tail}"
        return (href, scheme, host, port, "", "", path, query, tail[1:], None)
    except (ValueError, UnicodeError) as error:
        return (text, None, None, None, None, None, None, None, None, str(error) or "invalid url")


_kept_uri = lru_cache(maxsize=KEPT_URLS)(_parse_uri)


def _parser(fully: bool, keep_fragment: bool):
    @F.pandas_udf(PARSED_URI)
    def parse(urls: pd.Series) -> pd.DataFrame:
        empty = (None,) * len(PARSED_URI_FIELDS)
        rows = [empty if u is None else parse_uri(u, fully, keep_fragment) for u in urls]
        frame = pd.DataFrame(rows, columns=PARSED_URI_FIELDS)
        return frame.astype({"port": "Int32"})

    # Spark would copy a deterministic call into every filter above it.
    return parse.asNondeterministic()


_PARSERS = {(a, b): _parser(a, b) for a in (False, True) for b in (False, True)}


def canonical(url: Column, fully: bool = False, keep_fragment: bool = False) -> Column:
    """Parsed and canonical URL as a struct; one that cannot be parsed keeps its text and an error."""
    simple = url.rlike(_SIMPLE)
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+(/.*)$", 1)
    blank = F.lit("")
    ready = F.struct(
        F.when(path == "", F.concat(url, F.lit("/"))).otherwise(url).alias("href"),
        F.substring_index(url, ":", 1).alias("scheme"),
        F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host"),
        F.when(url.startswith("https"), F.lit(443)).otherwise(F.lit(80)).alias("port"),
        blank.alias("username"), blank.alias("password"),
        F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
        blank.alias("query"), blank.alias("fragment"), F.lit(None).cast("string").alias("error"))
    parsed = _PARSERS[(fully, keep_fragment)](F.when(~simple, url))
    return F.when(simple, ready).otherwise(parsed)


@F.pandas_udf(STRINGS)
def _canonical_list(texts: pd.Series) -> pd.Series:
    @lru_cache(maxsize=4096)
    def one(text: str) -> list:
        return [parse_uri(u, True)[0] for u in text.split()]

    return texts.map(lambda t: [] if t is None else one(t))


# Spark would copy a deterministic call into every place that reads its result.
_CANONICAL_LIST = _canonical_list.asNondeterministic()


def canonical_text(url: str) -> str:
    """One URL in canonical form."""
    return parse_uri(url, True)[0]


def canonical_list(urls: Column) -> Column:
    """Space-separated URLs to an array of canonical ones; the same text is parsed once."""
    return _CANONICAL_LIST(urls)


def with_site(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the scheme and host of simple absolute URLs."""
    return (df.withColumn("scheme", F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)))
            .withColumn("host", F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)))


def host_of(url: Column) -> Column:
    """Lower-case host name without user info and port; http is assumed without a scheme."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)", 1))


_KEY_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_key(url: Column, top_level: bool = False, ignore_scheme: bool = False) -> Column:
    """Deduplication key of a URL, NULL where it has no host."""
    def part(n: int) -> Column:
        return F.coalesce(F.regexp_extract(url, _KEY_PARTS, n), F.lit(""))

    path = F.lit("/") if top_level else F.when(part(4) == "", "/").otherwise(part(4))
    query = F.lit("") if top_level else part(5)
    scheme = F.lit("") if ignore_scheme else F.concat(F.lower(part(1)), F.lit(":"))
    named = F.regexp_replace(part(3), r":\d*$", "") != ""
    return F.when(named, F.concat(scheme, F.lit("//"), part(2), F.lower(part(3)), path, query))


def uri_hash(url: Column) -> Column:
    """SHA-256 of the UTF-16LE characters."""
    return F.sha2(F.encode(url, "UTF-16LE"), 256)


def short_sha1(text: Column) -> Column:
    """SHA-1 in hex without leading zeros, as ids are written."""
    return F.regexp_replace(F.sha1(text), "^0+", "")


def address_key(ip: Column) -> Column:
    """An address as text of fixed width that sorts as its number: a letter for the family, then 8 or 32 hex digits.

    Null for what is no address. An IPv6 address may be shortened or end with an IPv4 address.
    """
    def quad(text: Column) -> Column:
        parts = F.transform(F.split(text, r"\."), lambda b: b.try_cast("bigint"))
        fits = text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(parts, lambda b: b <= 255)
        return F.when(fits, F.concat_ws("", F.transform(parts, lambda b: F.lpad(F.hex(b), 2, "0"))))

    tail = F.regexp_extract(ip, r":([0-9]+(?:\.[0-9]+)+)$", 1)
    hexed = F.concat(F.regexp_extract(ip, r"^(.*:)", 1),
                     F.substring(quad(tail), 1, 4), F.lit(":"), F.substring(quad(tail), 5, 4))
    text = F.lower(F.when(tail != "", hexed).otherwise(ip))
    halves = F.split(text, "::")
    left = F.filter(F.split(F.get(halves, 0), ":"), lambda g: g != "")
    right = F.filter(F.split(F.coalesce(F.get(halves, 1), F.lit("")), ":"), lambda g: g != "")
    gap = F.when(F.size(halves) == 2, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))).otherwise(
        F.array().cast("array<string>"))
    groups = F.concat(left, gap, right)
    formed = (text.rlike("^([0-9a-f]{0,4}:){2,8}[0-9a-f]{0,4}$") & ~text.rlike("^:[^:]|[^:]:$|:::") & (F.size(halves) <= 2)
              & (F.size(groups) == 8) & (F.size(left) + F.size(right) <= F.when(F.size(halves) == 2, 7).otherwise(8)))
    wide = F.when(formed, F.upper(F.concat_ws("", F.transform(groups, lambda g: F.lpad(g, 4, "0")))))
    return F.when(ip.contains(":"), F.concat(F.lit("s"), wide)).otherwise(F.concat(F.lit("f"), quad(ip)))


def suffix_rules(lines: Iterable[str]) -> list[str]:
    """Rules of a public-suffix list in its usual text form, as ``suffixes=`` takes them.

    A rule ends at the first blank; empty lines and those that begin with two slashes say nothing.
    Names beyond ASCII are written as hosts are.
    """
    rules = set()
    for line in lines:
        rule = line.split(maxsplit=1)[0].lower() if line.strip() else ""
        if rule and not rule.startswith("//"):
            rules.add(".".join(label if label.isascii() else label.encode("idna").decode("ascii")
                               for label in rule.removeprefix(".").split(".")))
    return sorted(rules)


def is_public_suffix(host: Column, suffixes: list[str] | None = None) -> Column:
    """The host is one label, a rule, or one label under a ``*.`` rule without a ``!`` rule of its own."""
    known = PUBLIC_SUFFIXES if suffixes is None else suffixes
    exact = [r for r in known if r[0] not in "*!"]
    wild, spared = ([r.removeprefix(mark) for r in known if r.startswith(mark)] for mark in ("*.", "!"))
    parent = F.substring(host, F.instr(host, ".") + 1, F.length(host))
    listed = host.isin(exact) | (parent.isin(wild) & ~host.isin(spared))
    # Without a full list, a generic label under a country's domain is taken for a suffix too.
    generic = F.lit(False) if suffixes is not None else host.rlike(COUNTRY_SUFFIX)
    return ~host.contains(".") | listed | generic


def scope_anchor(host: Column, suffixes: list[str] | None = None) -> Column:
    """Host without one www label, unless what is left is itself a public suffix or no proper name."""
    rest = F.when(host.rlike(WWW), F.substring(host, F.instr(host, ".") + 1, F.length(host)))
    proper = ~(rest.startswith(".") | rest.endswith(".") | rest.contains(".."))
    return F.when(proper & ~is_public_suffix(rest, suffixes), rest).otherwise(host)


# How accented letters are spelled in a host shard name.
ACCENTS = {
    "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "ae", "å": "aa", "æ": "ae", "ç": "c",
    "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ð": "d", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "oe", "ø": "oe",
    "ù": "u", "ú": "u", "û": "u", "ü": "ue", "ý": "y", "ÿ": "y", "þ": "th", "ß": "ss",
}


def oos_shard(host: Column) -> Column:
    """Top-level label and the first two characters of the label before it."""
    plain = F.lower(F.regexp_replace(host, r":\d*$", ""))
    single = {k: v for k, v in ACCENTS.items() if len(v) == 1}
    spelled = F.translate(plain, "".join(single), "".join(single.values()))
    for letter, letters in ACCENTS.items():
        if len(letters) > 1:
            spelled = F.replace(spelled, F.lit(letter), F.lit(letters))
    clean = F.regexp_replace(spelled, r"[^a-z0-9.\-_]", "")
    labels = F.split(clean, r"\.")
    return F.when(F.size(labels) >= 2, F.concat(
        F.element_at(labels, -1), F.lit("_"), F.substring(F.element_at(labels, -2), 1, 2))).otherwise(host)
