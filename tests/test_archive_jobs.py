"""Sinks, imports, page graphs, robots, DNS and decisions on small fixtures."""

import pytest
from pyspark.sql import functions as F

from crawlatlas.functions import robots as RX
from crawlatlas.functions import status as ST
from crawlatlas.operators import dns as D
from crawlatlas.operators import joins as J
from crawlatlas.operators import pagegraph as G
from crawlatlas.operators import pagelog as PL
from crawlatlas.operators.frontier import oos_new_hosts, politeness_delay
from crawlatlas.schemas import CRAWL_LOG
from crawlatlas.session import scratch
from crawlatlas.sources import logs as L
from crawlatlas.sources import records as R

NAMES = [c.strip().split()[0] for c in CRAWL_LOG.split(",")]


def logs(spark, collections):
    rows = spark.createDataFrame([(f"crawl-{i}", c) for i, c in enumerate(collections)], "warc_id string, collection_final_name string")
    return rows.selectExpr(*[c if c in rows.columns else f"cast(null as {t}) AS {c}"
                             for c, t in (f.strip().split() for f in CRAWL_LOG.split(","))])


def test_files_rotate_and_collections_stay_apart(spark):
    base = scratch(spark, "t")
    L.sink_crawl_log(logs(spark, ["x"] * 3).coalesce(1), base, rows_per_file=2)
    assert L.listing(spark, base, "crawl_log").count() == 2
    other = scratch(spark, "t")
    L.sink_crawl_log(logs(spark, ["a/b", "a_b", "  ", "a/b"]), other)
    got = {r["collection"]: r["count"] for r in L.scan_crawl_log(spark, other).groupBy("collection").count().collect()}
    assert got == {"a/b": 2, "a_b": 1, "default": 1}
    pruned = L.scan_crawl_log(spark, other).where("collection = 'a/b'")
    assert pruned.count() == 2


def test_plain_layout(spark):
    base = scratch(spark, "t")
    for name in ("a%2Fb", "a_b"):
        logs(spark, ["x"]).write.parquet(f"{base}/crawl_log/{name}")
    got = {r["collection"] for r in L.scan_crawl_log(spark, base, plain_layout=True).select("collection").collect()}
    assert got == {"a/b", "a_b"}


def test_outlinks_round_trip(spark):
    pages = spark.createDataFrame([("p", "c", ["https://a.example/x,y", "", "https://b.example"]), ("q", "c", [])],
                                  "warc_id string, collection_final_name string, outlink array<string>")
    pages = pages.withColumn("resource", F.array().cast("array<" + PL.RESOURCE_TYPE + ">"))
    page, _ = PL.split_page_logs(pages)
    got = {r["warc_id"]: (r["outlinks"], r["o"]) for r in page.withColumn("o", PL.decode_outlinks()).collect()}
    assert got["p"][1] == ["https://a.example/x,y", "", "https://b.example"]
    assert got["q"] == ("", [])


def page_requests(spark, n):
    """A page with n requests, of which the first is the page itself."""
    i = F.col("id")
    return spark.range(n).select(
        F.lit("p").alias("page_id"), i.alias("seq"), i.cast("int").alias("idx"), F.concat(F.lit("u"), i).alias("url"),
        F.lit("GET").alias("method"), F.concat(F.lit("w"), i).alias("warc_id"), F.lit(True).alias("has_crawl_log"),
        F.when(i % 2 == 0, "Script").otherwise("Image").alias("resource_type"), F.lit(False).alias("from_cache"),
        F.lit("e").alias("execution_id"), F.lit("j").alias("job_execution_id"), F.lit("r").alias("referrer"),
        F.lit("c").alias("collection_final_name"), F.lit(404).alias("status_code"), F.lit("image/png").alias("content_type"),
        F.lit("L").alias("discovery_path"), F.lit(True).alias("renderable"), F.lit(-5).alias("error_code"),
        F.lit("m").alias("error_msg"), F.lit("d").alias("error_detail"))


def test_long_pages_keep_every_resource(spark):
    n = 60_001
    messages = PL.page_log_messages(page_requests(spark, n))
    page, resource = PL.archive_rows(messages)
    row = page.first()
    assert page.count() == 1 and len(parsed(row["outlinks"])) == n // 2
    assert (row["uri"], row["warc_id"], row["execution_id"], row["job_execution_id"], row["referrer"],
            row["collection_final_name"]) == ("u0", "w0", "e", "j", "r", "c")
    assert resource.count() == n - 1
    assert resource.select("page_id", "collection_final_name").distinct().collect() == [("w0", "c")]
    nested = PL.assemble_page_logs(PL.page_log_messages(page_requests(spark, 25))).first()
    assert [r["uri"] for r in nested["resource"]] == [f"u{i}" for i in range(1, 25)]
    assert tuple(nested["resource"][0]) == ("w1", "u1", "r", "Image", "image/png", "L", "GET", 404, False, True, -5, "m", "d")


def parsed(text):
    import json

    return json.loads(text)


def test_yaml_import(spark):
    path = scratch(spark, "t") + ".yaml"
    from pathlib import Path
    local = Path(path.removeprefix("file:"))
    local.parent.mkdir(parents=True, exist_ok=True)
    local.write_text("entityName: A\nuri: http://a.org/\n---\nuri: http://b.org/\nnope: 1\n---\n- just\n- a list\n")
    good, bad = R.read_seed_import(spark, path, yaml=True)
    assert [r["uri"] for r in good.collect()] == ["http://a.org/"]
    assert sorted((r["record_no"], r["reason"]) for r in bad.collect()) == [(2, "unknown field: nope"), (3, "not a record")]


def test_seed_import_of_every_form(spark):
    from pathlib import Path
    folder = scratch(spark, "t")
    local = Path(folder.removeprefix("file:"))
    local.mkdir(parents=True, exist_ok=True)
    files = {
        "a.json": '{\n"uri": "a1",\n"seedLabel": [\n{\n"key": "k", "value": "v"}\n]\n}\n{"uri": "a2"} {"uri": "a3"}\n\n'
                  '{broken\n{"uri": "lost"\n{"uri": "a4"}\n  {"uri": "a5", "nope": 1}\n{"uri":\n  "a6"} {"uri": "a7"}',
        "b.json": '{"uri": "b1"}\n[1]\n{"uri": "b2"}\n{"uri": "unended\n{"uri": "b3"}\n',
        "c.yaml": "# head\r\n---\r\nuri: c1\r\n--- # comment\r\nuri: c2\r\n---  \r\n\r\nuri: c3\r\n...\r\n---\r\nuri: c4\r\n",
        "d.yml": "%YAML 1.1\n---\nuri: d1\nseedDescription: |\n  text\n  --- no mark\n---\n[bad\n---\n{uri: d2}\n---\n",
        "e.json": '{"uri": "never ends",\n"uri": "x",\n' + '"a": [\n' * 40 + '{"uri": "e1"}\n',
    }
    for name, text in files.items():
        (local / name).write_bytes(text.encode())
    good, bad = R.read_seed_import(spark, folder)
    of = sorted((r["file"][-6:].strip("/"), r["record_no"], r["uri"]) for r in good.collect())
    assert [u for f, _, u in of if f != "e.json"] == ["a1", "a2", "a3", "a4", "a6", "a7", "b1", "b2", "b3", "c1", "c2", "c3", "c4", "d1", "d2"]
    assert [n for f, n, _ in of if f == "a.json"] == [1, 2, 3, 6, 8, 9] and ("e1" in {u for _, _, u in of})
    wrong = sorted((r["file"][-6:].strip("/"), r["record_no"], r["reason"]) for r in bad.collect())
    assert [w for w in wrong if w[0] != "e.json"] == [
        ("a.json", 4, "not a record"), ("a.json", 5, "not a record"), ("a.json", 7, "unknown field: nope"),
        ("b.json", 2, "not a record"), ("b.json", 4, "not a record"), ("d.yml", 2, "not a record")]


REQUEST = ("page_id string, idx int, request_id string, url string, redirected boolean, redirect_from_url string, referrer string, "
           "initiator string, has_crawl_log boolean, queue_path string")


def test_request_graph(spark):
    rows = spark.createDataFrame([
        ("p", 0, "a", "http://x/", False, "", "", "", True, "L"),
        ("p", 1, "b", "http://x/1", True, "http://x/", "http://x/", "", True, "L"),
        ("p", 2, "c", "http://x/2", True, "http://x/1", "", "", True, "L"),
        ("p", 3, "d", "http://x/i.png", False, "", "http://x/2", "parser", True, "L"),
        ("p", 4, "e", "http://x/s.js", False, "", "http://x/9", "script", True, "L"),
        ("p", 5, "f", "http://x/9", False, "", "http://x/i.png", "parser", False, "L"),
        ("p", 6, "g", "http://x/z", False, "", "http://x/z", "parser", True, "L")], REQUEST)
    paths = {r["idx"]: r["discovery_path"] for r in G.discovery_paths(rows).collect()}
    assert paths == {0: "L", 1: "LR", 2: "LRR", 3: "LRRE", 4: "X", 6: "E"}
    assert G.redirect_roots(rows).first()["root_idx"] == 2


def test_long_redirect_chain(spark):
    n = 200
    rows = spark.createDataFrame([("p", i, f"r{i}", f"http://x/{i}", i > 0, f"http://x/{i - 1}" if i else "", "", "", True, "L")
                                  for i in range(n)], REQUEST)
    assert G.redirect_roots(rows).first()["root_idx"] == n - 1
    longest = G.discovery_paths(rows).where(F.col("idx") == n - 1).first()["discovery_path"]
    assert longest == "L" + "R" * (n - 1)


@pytest.mark.parametrize("rules, agent, url, allowed", [
    ("User-agent: *\nDisallow: /blocked\n", "bot", "http://e.com/blocked/x", False),
    ("User-agent: *\nAllow: /\n", "bot", "http://e.com/blocked", True),
    ("User-agent: *\nDisallow: /\nAllow: /open\n", "bot", "http://e.com/open/1", True),
    ("User-agent: *\nDisallow: /*.gif$\n", "bot", "http://e.com/a.gif", False),
    ("User-agent: *\nDisallow: /*.gif$\n", "bot", "http://e.com/a.gif?x", True),
    ("User-agent: other\nUser-agent: Bot\nDisallow: /a\n\nUser-agent: *\nDisallow: /\n", "bot/2.0", "http://e.com/b", True),
    ("User-agent: other\nDisallow: /\n", "bot", "http://e.com/b", True),
    ("", "bot", "http://e.com", True),
])
def test_robots_rules(rules, agent, url, allowed):
    assert RX.allows(rules, agent, url) is allowed


def test_dns_lifetimes(spark):
    rows = spark.createDataFrame([
        ("ok", "n", "answer", "A", 0, 120, None, False, 0), ("ok", "n", "additional", "OPT", 0, 1, None, False, 0),
        ("long", "n", "answer", "A", 0, 9999999, None, False, 0), ("zero", "n", "answer", "A", 0, 0, None, False, 0),
        ("nx", "n", "authority", "SOA", 3, 300, 60, False, 0), ("nosoa", "n", "authority", "NS", 3, 300, None, False, 0),
        ("fail", "n", "answer", "A", 2, 1, None, False, 0), ("cut", "n", "answer", "A", 0, 9, None, True, 0)],
        "response_id string, name string, section string, rr_type string, rcode int, ttl bigint, soa_minimum bigint, truncated boolean, stored_at bigint")
    got = {r["response_id"]: r["lifetime_s"] for r in D.dns_expiry(rows).collect()}
    assert got == {"ok": 120, "long": 604800, "zero": None, "nx": 60, "nosoa": None, "fail": 5, "cut": None}
    aged = spark.range(1).select(D.aged_ttl(F.lit(120), F.lit(0), F.lit(30_900)).alias("a"),
                                 D.aged_ttl(F.lit(120), F.lit(0), F.lit(121_000)).alias("b")).first()
    assert tuple(aged) == (90, 0)


def test_politeness_bounds(spark):
    def delay(fetch, factor, low, high):
        return spark.range(1).select(politeness_delay(F.lit(fetch), F.lit(factor), F.lit(low), F.lit(high)).alias("d")).first()["d"]

    assert delay(7000, 0.0, 5000, 30000) == 7000
    assert delay(7000, -1.0, 0, 0) == 0
    assert delay(90000, 1.0, 5000, 30000) == 30000
    assert delay(100, 1.0, 5000, 3000) == 3000


def test_retry_of_unknown_code_is_an_error(spark):
    rows = spark.createDataFrame([(-77, 0)], "error_code int, retries int")
    with pytest.raises(Exception, match="Unknown error code"):
        ST.retry_decision(rows, F.lit(3), F.lit(60), F.lit(0)).collect()


def test_oos_hosts(spark):
    rows = spark.createDataFrame([("http", f"example{i}.com") for i in (1, 2, 3, 2, 1, 3)], "scheme string, host string")
    assert oos_new_hosts(rows).count() == 3
    assert oos_new_hosts(rows, rows.where("host = 'example1.com'")).count() == 2


def test_import_keeps_the_first_of_a_key(spark):
    rows = spark.createDataFrame([(1, "http://A.org"), (2, "http://a.org/"), (3, "http://b.org/#x"), (4, "http://c.org")], "pos int, uri string")
    known = spark.createDataFrame([("http://c.org/",)], "key string")
    assert sorted(r["pos"] for r in J.import_new_seeds(rows, known, "pos").collect()) == [1, 3]


def test_selector_join_matches_predicate(spark):
    from crawlatlas.functions.labels import matches_all
    scripts = spark.createDataFrame([("s1", [("Scope", "Default"), ("x", "1")]), ("s2", [("scope", "other")]), ("s3", [])],
                                    "script_id string, label array<struct<key:string,value:string>>")
    asked = {"c1": ["scope:default"], "c2": ["scope:"], "c3": ["de*", "x:"], "c4": [":"], "c5": [":other"], "c6": ["scope:o*"], "c7": ["y:"]}
    configs = spark.createDataFrame(list(asked.items()), "config_id string, script_selector array<string>")
    got = {(r["config_id"], r["script_id"]) for r in J.script_selector_match(configs, scripts).collect()}
    want = {(c, r["script_id"]) for c, s in asked.items()
            for r in scripts.where(matches_all(F.col("label"), s)).collect()}
    assert got == want


def test_script_selectors_gather_nothing_by_script(spark):
    """All selectors of a configuration hold for one row of a script, so no row of scripts is kept for a count."""
    rows = [(f"s{i}", [("kind", f"v{i % 4}"), ("site", f"h{i % 3}.example")]) for i in range(60)]
    scripts = spark.createDataFrame(rows, "script_id string, label array<struct<key:string,value:string>>")
    asked = [("a", ["kind:v1", "SITE:h2*"]), ("b", [":", "kind:v3"]), ("c", [":"]), ("d", ["h0*", "v0", "v0"]), ("e", ["kind:v1", None]),
             ("f", ["kind:v1", "kind:v2"]), ("g", ["kind:"]), ("h", [None])]
    configs = spark.createDataFrame(asked, "config_id string, script_selector array<string>")
    met = J.script_selector_match(configs, scripts)
    want = {"a": lambda i: i % 4 == 1 and i % 3 == 2, "b": lambda i: i % 4 == 3, "c": lambda i: True, "d": lambda i: i % 12 == 0,
            "e": lambda i: i % 4 == 1, "g": lambda i: True}
    assert sorted((r["config_id"], r["script_id"]) for r in met.collect()) == sorted(
        (c, f"s{i}") for c, holds in want.items() for i in range(60) if holds(i))
    assert "Aggregate" not in met._jdf.queryExecution().optimizedPlan().toString()
