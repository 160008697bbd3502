"""Inputs that a crawl meets: huge tags, open elements, stars in robots rules, absent parents, odd hosts."""

import time

import pytest
from pyspark.sql import functions as F

from crawlatlas.functions.html import extract_outlinks
from crawlatlas.functions.robots import allows
from crawlatlas.operators.joins import dangling_refs, join_seed_entity
from crawlatlas.operators.listing import order_by_path
from crawlatlas.operators.robots import judged_by_rules
from crawlatlas.operators.scope import is_same_host, scope_decide
from crawlatlas.operators.updates import execution_timeouts, fail_if_empty, masked_update, new_executions


def links(spark, html):
    pages = spark.createDataFrame([(1, "http://a.example/", html)], "page_id long, url string, html string")
    return sorted(r["uri"] for r in extract_outlinks(pages).collect())


@pytest.mark.parametrize("html", [
    "<a " + " ".join(f"x{i}=1" for i in range(100_000)) + ' href="/b">', "<script " * 100_000, "<!--" * 100_000,
    "<a x=<a " * 100_000, '<a href="/b">' + "<textarea>" * 50_000, "<a " * 100_000, "</script " * 100_000])
def test_links_of_hostile_pages(spark, html):
    started = time.time()
    assert links(spark, html) in ([], ["http://a.example/b"])
    assert time.time() - started < 20


def test_links_of_plain_pages(spark):
    html = ("<base target=x><base href='http://b.example/d/'><a class=c\nhref=one>1</a><area href='/two' alt=x><a>no</a>"
            "<!-- <a href=/hidden> --><script>'<a href=/no>'</script><A HREF = \"three\">3</A><abbr href=/four><a/href=five>")
    assert links(spark, html) == [f"http://b.example/{p}" for p in ("d/five", "d/one", "d/three", "two")]


def test_robots_patterns_are_linear():
    rules = "User-agent: *\nDisallow: /*a*a*a*a*a*a*b\nAllow: /ok$\nDisallow: /*.gif$\nDisallow: /x*y*z"
    started = time.time()
    assert allows(rules, "bot", "http://h/" + "a" * 10_000)
    assert not allows(rules, "bot", "http://h/" + "a" * 10_000 + "b")
    assert time.time() - started < 2
    assert not allows(rules, "bot", "http://h/p.gif") and allows(rules, "bot", "http://h/p.gif?q")
    assert not allows(rules, "bot", "http://h/xAyBz!") and allows(rules, "bot", "http://h/xAzBy")


def test_masked_update_builds_absent_parents(spark):
    rows = spark.createDataFrame(
        [("a", None, ("n",)), ("b", ((1,),), ("n",)), ("c", (None,), ("n",))],
        "id string, crawlJob struct<limits:struct<maxBytes:bigint>>, meta struct<name:string>")
    got = masked_update(rows, F.lit(True), {"crawlJob": {"limits": {"maxBytes": 7}}}, ["crawlJob.limits.maxBytes"], "u",
                        F.current_timestamp())
    assert [(r["crawlJob"]["limits"]["maxBytes"], r["updated"]) for r in got.orderBy("id").collect()] == [(7, True)] * 3
    none = masked_update(rows, F.lit(True), {}, ["crawlJob.limits.maxBytes"], "u", F.current_timestamp())
    assert [(r["crawlJob"], r["updated"]) for r in none.where("id = 'a'").collect()] == [(None, False)]


def test_fail_if_empty_keeps_other_errors(spark):
    jobs = spark.createDataFrame([("a", "RUNNING", None, "old"), ("b", "RUNNING", None, "old")],
                                 "id string, state string, end_time timestamp_ntz, error_msg string")
    executions = spark.createDataFrame([("a",)], "job_execution_id string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    got = {r["id"]: (r["state"], r["error_msg"]) for r in fail_if_empty(jobs, executions, "no seeds", now).collect()}
    assert got == {"a": ("RUNNING", "old"), "b": ("FAILED", "no seeds")}


def test_order_by_label_value(spark):
    rows = spark.createDataFrame(
        [("1", ([("k", "B")],)), ("2", ([("k", "a"), ("l", "x")],)), ("3", ([("k", "A")],))],
        "id string, meta struct<label:array<struct<key:string,value:string>>>")
    assert [r["id"] for r in rows.orderBy(*order_by_path(rows, "meta.label.value")).collect()] == ["3", "2", "1"]


@pytest.mark.parametrize(("seed", "uri", "inside"), [
    ("http://bücher.example/", "http://bücher.example/x", True), ("http://bücher.example/", "http://xn--bcher-kva.example/x", True),
    ("http://www.com.sg/", "http://other.com.sg/x", False), ("http://www.example.sg/", "http://shop.example.sg/x", True),
    ("http://A.Example/", "http://a.example/", True)])
def test_same_host(spark, seed, uri, inside):
    rows = spark.createDataFrame([(uri, seed, "", "")], "uri string, seed_uri string, discovery_path string, referrer string")
    rows = rows.withColumn("annotation", F.create_map().cast("map<string,string>"))
    got = scope_decide(rows, [is_same_host("true").then(0).otherwise(-5001)]).first()
    assert (got["evaluation"] == "INCLUDE") == inside


def test_look_ups_with_one_hot_key(spark):
    """One entity, job or reference holds most of the rows, and nulls are many."""
    seeds = spark.range(2000).select(
        F.col("id").cast("string").alias("id"),
        F.struct(F.struct(F.when(F.col("id") % 3 > 0, "e1").alias("id")).alias("entityRef")).alias("seed"))
    entities = spark.createDataFrame([("e1", "n", "d"), ("e2", "m", "d")], "id string, name string, description string")
    got = join_seed_entity(seeds, entities)
    assert got.count() == 2000 and got.where("entity_name = 'n'").count() == seeds.where("id % 3 > 0").count()
    refs = spark.range(1000).select(F.col("id").cast("string").alias("source_id"), F.lit("f").alias("field"),
                                    F.lit("k").alias("kind"), F.lit("k").alias("expected"), F.lit(True).alias("required"),
                                    F.when(F.col("id") == 0, "gone").otherwise("here").alias("id"))
    objects = spark.createDataFrame([("k", "here")], "kind string, id string")
    assert [(r["source_id"], r["reason"]) for r in dangling_refs(refs, objects).collect()] == [("0", "not found")]
    pairs = spark.range(500).select(F.lit("je").alias("job_execution_id"), F.col("id").cast("string").alias("seed_id"))
    jobs = spark.createDataFrame([("je", "j", "ABORTED_MANUAL")], "id string, job_id string, desired_state string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    made = new_executions(pairs, jobs, now)
    assert made.where("job_id = 'j' AND desired_state = 'ABORTED_MANUAL'").count() == 500
    executions = made.withColumn("end_time", F.lit(None).cast("timestamp_ntz"))
    limits = spark.createDataFrame([("j", 10)], "id string, max_duration_s long")
    late = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert execution_timeouts(executions, limits, late).count() == 500


def test_rules_meet_urls_without_a_join(spark):
    """One host has most URLs, some have no rules, and each URL is judged by its own host's text."""
    urls = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("h"), F.col("id") % 50)).alias("host"),
        F.concat(F.lit("http://x/"), F.col("id") % 4).alias("uri"), F.col("id").alias("slice"))
    texts = spark.createDataFrame(
        [("hot", "User-agent: *\nDisallow: /1"), ("h8", "User-agent: *\nDisallow: /2"), ("other", "Disallow: /")], "host string, rules string")
    got = judged_by_rules(urls, texts, "host", "bot", "allowed", together=100).collect()
    assert len(got) == 3000
    for r in got:
        want = {"hot": not r["uri"].endswith("/1"), "h8": not r["uri"].endswith("/2")}.get(r["host"])
        assert r["allowed"] == want
