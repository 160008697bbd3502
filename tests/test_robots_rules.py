"""URLs judged by rules: missing bodies, repeated texts and hot hosts give one row for each URL."""

import pytest
from pyspark.sql import functions as F

from crawlatlas.operators.robots import judged_by_rules, robots_allowed

DENY = "User-agent: *\nDisallow: /deny\n"


@pytest.mark.parametrize("together", [1, 3, 100_000])
def test_one_row_for_each_url(spark, together):
    urls = [(i, k, f"http://h/{p}{i}") for i, (k, p) in enumerate((k, p) for k in ("a", "b", "c", "d", None) for p in ("deny", "free") * 5)]
    rows = spark.createDataFrame(urls, "id int, k string, uri string").repartition(3)
    texts = spark.createDataFrame([("a", DENY), ("b", None), ("c", ""), ("c", DENY), ("unused", DENY), (None, DENY)], "k string, rules string")
    got = judged_by_rules(rows, texts, "k", "crawler", "said", together=together).collect()
    assert sorted(r["id"] for r in got) == list(range(len(urls)))
    for r in got:
        assert r["said"] == ((not r["uri"].startswith("http://h/deny")) if r["k"] in ("a", "c") else None)


def test_an_answer_without_a_body_allows(spark):
    fetches = spark.createDataFrame([(1, 200, None), (2, 200, ""), (3, 200, DENY), (4, 404, None)], "seq bigint, http_status int, body string")
    rows = spark.createDataFrame([(s, "http://h/deny", "fresh", s < 4) for s in (1, 2, 3, 4)], "rules_seq bigint, uri string, state string, has_rules boolean")
    got = robots_allowed(rows, fetches, "crawler", F.lit("OBEY_ROBOTS"), "").collect()
    assert sorted((r["rules_seq"], r["allowed"]) for r in got) == [(1, True), (2, True), (3, False), (4, True)]


def test_no_urls_or_no_texts(spark):
    rows, texts = spark.createDataFrame([], "k string, uri string"), spark.createDataFrame([("a", DENY)], "k string, rules string")
    assert judged_by_rules(rows, texts, "k", "crawler", "said").collect() == []
    one = spark.createDataFrame([("a", None), ("a", "http://h/deny")], "k string, uri string")
    assert sorted(map(tuple, judged_by_rules(one, texts.limit(0), "k", "crawler", "said").collect()), key=repr) == [
        ("a", "http://h/deny", None), ("a", None, None)]


def test_allowed_orders_the_requests_once(spark):
    """What is judged is read several times, but the ordering behind it is not repeated."""
    from crawlatlas.operators import robots as B
    fetches = spark.createDataFrame([("c", "http", "h", 80, 10, 1, 200, "User-agent: *\nDisallow: /p")],
                                    "collection string, scheme string, host string, port int, fetched_at bigint, seq bigint, http_status int, body string")
    requests = spark.createDataFrame([(f"r{i}", "c", "http", h, 80, i, f"http://{h}/{p}") for i, (h, p) in enumerate(
        [("h", "p"), ("h", "p"), ("g", "p")] + [("h", p) for p in "pqpqpqpqpq"])],
                                     "request_id string, collection string, scheme string, host string, port int, at bigint, uri string")
    found = B.robots_asof(requests, B.robots_snapshot(fetches, 100, 10))
    got = B.robots_allowed(found, fetches, "crawler", F.lit("OBEY_ROBOTS"), "")
    denied = sorted(r["request_id"] for r in got.collect() if not r["allowed"])
    assert denied == ["r11"] and got.count() == 13
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
