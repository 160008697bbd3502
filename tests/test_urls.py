"""Golden cases for URLs, hosts, shards and periods."""

import hashlib

import pytest
from pyspark.sql import functions as F

from crawlatlas.functions import archive as X
from crawlatlas.functions import html as H
from crawlatlas.functions import urls as U
from crawlatlas.operators import scope as S
from crawlatlas.operators.joins import host_groups


def column(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_canonical_golden(spark):
    want = ("http://foo.bar/aa%20bb/cc?foo&jsessionid=1", "http", "foo.bar", 80, "/aa%20bb/cc", "foo&jsessionid=1")
    for text in ("http://foo.bar/aa bb/cc?jsessionid=1&foo#bar", "foo.bar/aa bb/cc?jsessionid=1&foo#bar"):
        for fully in (False, True):
            c = column(spark, [text], lambda v: U.canonical(v, fully))[0]
            assert (c["href"], c["scheme"], c["host"], c["port"], c["path"], c["query"]) == want


def test_canonical_cases(spark):
    cases = {
        "foo.bar/aa/ff/../bb/cc?foo&a=c&jsessionid=1&a=b": "http://foo.bar/aa/bb/cc?a=c&a=b&foo&jsessionid=1",
        "HTTP://User:pw@EXAMPLE.com:80//a///b": "http://example.com/a/b",
        "https://example.com:8443": "https://example.com:8443/",
        "http://bücher.example/ü": "http://xn--bcher-kva.example/%C3%BC",
        "http://example.com/%2561": "http://example.com/a",
        "http://example.com/plain/path": "http://example.com/plain/path",
    }
    got = column(spark, list(cases), lambda v: U.canonical(v, True)["href"])
    assert got == list(cases.values())
    bad = column(spark, ["http://", "http://exa mple.com/"], lambda v: U.canonical(v)["error"].isNotNull())
    assert bad == [True, True]
    assert column(spark, ["http://e.com/#x"], lambda v: U.canonical(v, keep_fragment=True)["href"]) == ["http://e.com/#x"]


def test_fast_path_agrees_with_parser(spark):
    texts = ["http://example.com", "https://a.b-c.org/x/y/", "http://h1.example.com/p/12", "http://e.com/a.b~c_d"]
    got = column(spark, texts, lambda v: U.canonical(v))
    for text, c in zip(texts, got):
        assert tuple(c) == U.parse_uri(text)


@pytest.mark.parametrize("text, plain, top, any_scheme", [
    ("http://www.example.com?query#hash", "http://www.example.com/?query", "http://www.example.com/", "//www.example.com/?query"),
    ("HTTPS://www.example.com/foo/bar#hash", "https://www.example.com/foo/bar", "https://www.example.com/", "//www.example.com/foo/bar"),
    ("http://www.example.com/foo/", "http://www.example.com/foo/", "http://www.example.com/", "//www.example.com/foo/"),
    ("no host", None, None, None),
])
def test_url_keys(spark, text, plain, top, any_scheme):
    assert column(spark, [text], U.url_key) == [plain]
    assert column(spark, [text], lambda v: U.url_key(v, top_level=True)) == [top]
    assert column(spark, [text], lambda v: U.url_key(v, ignore_scheme=True)) == [any_scheme]


def test_scope_anchor(spark):
    cases = {"www.example.com": "example.com", "www2.example.com": "example.com", "www.co.uk": "www.co.uk",
             "wwwx.example.com": "wwwx.example.com", "www.com": "www.com", "example.com": "example.com"}
    assert column(spark, list(cases), U.scope_anchor) == list(cases.values())


def test_hops(spark):
    path = F.lit("RLERLR")
    got = spark.range(1).select(
        S.exceeds_hops(path, F.lit(2), F.lit(False)).alias("a"), S.exceeds_hops(path, F.lit(4), F.lit(False)).alias("b"),
        S.exceeds_hops(path, F.lit(4), F.lit(True)).alias("c")).first()
    assert tuple(got) == (True, False, True)


def test_oos_shards(spark):
    hosts = ["example1.com", "bølle.no", "bolle.no", "bømållag.no", "localhost", "127.0.0.1"]
    assert column(spark, hosts, U.oos_shard) == ["com_ex", "no_bo", "no_bo", "no_bo", "localhost", "1_0"]


def test_uri_hash(spark):
    text = "http://example.com/ø"
    assert column(spark, [text], U.uri_hash) == [hashlib.sha256(text.encode("utf-16-le")).hexdigest()]


def test_rotation_keys(spark):
    df = spark.sql("SELECT timestamp_ntz'2021-11-20 11:29:59' AS t UNION ALL SELECT timestamp_ntz'2021-01-01 00:00:00'")
    out = df.select(*[X.rotation_key(F.col("t"), F.lit(p)).alias(p) for p in ("NONE", "HOURLY", "DAILY", "MONTHLY", "YEARLY")])
    rows = sorted(map(tuple, out.collect()))
    assert rows[1] == ("", "2021112011", "20211120", "202111", "2021")
    assert rows[0][4] == "2021"
    ends = df.select(X.period_end(F.col("t"), F.lit("MONTHLY")).alias("e")).collect()
    assert {str(r["e"]) for r in ends} == {"2021-12-01 00:00:00", "2021-02-01 00:00:00"}


def test_address_blocks(spark):
    rows = spark.createDataFrame([
        ("a", "10.0.1.7"), ("b", "10.0.2.0"), ("c", "200.1.1.1"), ("d", "2001:db8::5"), ("e", None), ("f", "10.0.0.255"),
    ], "host string, ip string")
    ranges = spark.createDataFrame([
        ("g1", "10.0.1.0", "10.0.1.255"), ("g2", "10.0.0.250", "10.0.2.0"), ("g3", "2001:db8::1", "2001:db8::ffff"),
        ("g4", "199.0.0.0", "201.0.0.0")], "config_id string, ip_from string, ip_to string")
    got = {r["host"]: r["host_group_id"] for r in host_groups(rows, ranges).collect()}
    assert got["a"] == "g1" and got["b"] == "g2" and got["c"] == "g4" and got["d"] == "g3" and got["f"] == "g2"
    assert got["e"] == "TEMP_CHG_" + hashlib.sha1(b"e").hexdigest().lstrip("0")


def test_outlinks_of_awkward_html(spark):
    html = """<html><head><title><a href="/no">x</a></title><base href="http://Base.example.org/dir/"></head>
      <!-- <a href="/comment"> --><script>var s = '<a href="/script">';</script>
      <a class="x" href='one.html'>1</a><A HREF=two?q=1&amp;r=2#f>2</A><a href="#">n</a><a href="">n</a>
      <a href="mailto:x@y">m</a><area shape=rect href="//other.org/ü x"><abbr href="/z"></abbr><a name="q">no</a>"""
    pages = spark.createDataFrame([(1, "http://site.example.com/p", html)], "page_id int, url string, html string")
    got = {r["uri"] for r in H.extract_outlinks(pages).collect()}
    assert got == {"http://base.example.org/dir/one.html", "http://base.example.org/dir/two?q=1&r=2#f",
                   "http://other.org/%C3%BC%20x"}


def test_block_digest(spark):
    got = spark.createDataFrame([("h", "p")], "h string, p string").select(
        X.block_digest(F.col("h"), F.col("p"), F.lit(False)).alias("d")).first()["d"]
    assert got == "sha1:" + hashlib.sha1(b"hp").hexdigest()
