"""Scripts by URL patterns, against a plain search of every pattern in every URL."""

import random
import re

import pytest

from crawlatlas.operators import selection as S

PATTERNS = [
    r"^https://blog\.", r"/item/[0-9]+(\.html)?$", r"(?i)SHOP", r"news|blog", r"a(bc|de)f/", r"colou?r/red", r"x{2}yzzy",
    r"www\.site+s\.org", r".*", r"^$", r"\Qa.b\E", r"[a-z]+/deep/er", r"[^/]+\.pdf", r"abcd|", r"\x41bcd", r"(?:long)?text/",
    r"end$", r"/p/\d+/photo", r"(a(b)c)+defg", r"lit\.eral\/path", r"café", "größe", r"q[]]uote", r"wxyz*", r"wxyz{0,1}end",
]


def test_required_texts_stand_in_every_match():
    got = {p: S.required_texts(p) for p in PATTERNS}
    assert got[r"^https://blog\."] == [(r"^https://blog\.", ["https://blog."])]
    assert got["news|blog"] == [("news", ["news"]), ("blog", ["blog"])]
    assert got[r"(?i)SHOP"] == [(r"(?i)SHOP", [])]
    assert got[r"colou?r/red"] == [(r"colou?r/red", ["colo", "r/red"])]
    assert got[r"\x41bcd"] == [(r"\x41bcd", [])] and got[r"\Qa.b\E"] == [(r"\Qa.b\E", [])]
    assert got["wxyz*"] == [("wxyz*", [])] and got[r"[a-z]+/deep/er"][0][1] == ["/deep/er"]
    assert got["abcd|"] == [("abcd", ["abcd"]), ("", [])]
    assert got["(a(b)c)+defg"][0][1] == ["defg"] and got["(?:long)?text/"][0][1] == ["text/"]


def urls_for(rnd, n):
    words = ["blog.", "www.", "item/", "12", ".html", "shop", "SHOP", "news", "abcf/", "adef/", "color/red", "colour/red",
             "xxyzzy", "www.sitesss.org", "a.b", "/deep/er", "x.pdf", "abcd", "Abcd", "longtext/", "text/", "end", "/p/7/photo",
             "abcabcdefg", "lit.eral/path", "café", "größe", "q]uote", "wxy", "wxyend", "wxyzend", "/", "https://"]
    return ["https://" * rnd.randint(0, 1) + "".join(rnd.choices(words, k=rnd.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_selected_scripts_equal_a_plain_search(spark, threshold):
    rnd = random.Random(7)
    usable = [p for p in PATTERNS if p not in (r"\Qa.b\E", "q[]]uote")]
    given = [("none", "T", []), ("null", "T", None), ("nulls", "T", [None]), ("other", "U", [".*"])]
    given += [(f"s{i}", "T", rnd.sample(usable, rnd.randint(1, 4))) for i in range(60)]
    urls = [*urls_for(rnd, 300), "", None, "a", "https://blog.x", "https://blog.x"]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "_rule long, url string")
    scripts = spark.createDataFrame(given, "script_id string, script_type string, url_regexp array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = sorted(tuple(r) for r in S.selected_scripts(table, scripts, "T").select("_rule", "script_id").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted((i, s) for i, u in enumerate(urls) for s, kind, patterns in given if kind == "T" and (
        not patterns or (u is not None and any(p is not None and re.search(p, u) for p in patterns))))
    assert got == want


def test_ten_thousand_scripts_meet_urls_by_their_own_piece(spark):
    scripts = spark.range(10_000).selectExpr("concat('s', id) script_id", "'T' script_type",
                                             "array(concat('^https://h[0-9]+\\\\.org/u', id, '/')) url_regexp")
    urls = spark.range(2_000).selectExpr("id", "concat('https://h', id % 9, '.org/u', id * 7, '/p') url")
    got = S.selected_scripts(urls, scripts, "T")
    assert {r["script_id"] for r in got.collect()} == {f"s{i * 7}" for i in range(2_000) if i * 7 < 10_000}
    assert S.selected_scripts(urls, scripts, "U").count() == 0 and S.selected_scripts(urls.limit(0), scripts, "T").count() == 0
