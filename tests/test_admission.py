"""Admission of outlinks by limits, robots policy and key, and host groups."""

from pyspark.sql import functions as F

from crawlatlas.functions.urls import short_sha1
from crawlatlas.operators.scope import scope_default
from crawlatlas.plans.admission import admit_outlinks

JOBS = ["OBEY_ROBOTS", "IGNORE_ROBOTS", "CUSTOM_ROBOTS", "CUSTOM_IF_MISSING"]
PATHS = ["/deny", "/own", "/free"]


def admitted(spark, robots, robots_schema, **more):
    """Decisions by (page, uri): page p is of policy p, and of an execution and job execution of its own."""
    parameters = {"scope_allowedSchemes": "https http", "scope_includeSubdomains": "true", "scope_altSeeds": "http://a.org http://b.org:8080 http://b.org",
                  "scope_maxHopsFromSeed": "2", "scope_hopsIncludeRedirects": "no", "scope_excludedUris": "http://none.example.com/"}
    parents = spark.createDataFrame(
        [(p, "http://a.org/", "http://a.org/", f"e{p}", f"j{p}", 1.0, 1, "", parameters, True, policy, f"c{p}") for p, policy in enumerate(JOBS)],
        "page_id long, url string, seed_uri string, execution_id string, job_execution_id string, priority_weight double, "
        "sequence long, discovery_path string, annotation map<string,string>, active boolean, robots_policy string, collection string")
    hosts = ["http://a.org", "http://b.org", "http://b.org:8080"]
    outlinks = spark.createDataFrame([(p, h + path) for p in range(len(JOBS)) for h in hosts for path in PATHS], "page_id long, uri string")
    dns = spark.createDataFrame([("a.org", "10.0.0.7", 0), ("b.org", "10.0.1.7", 0)], "host string, ip string, dns_code int")
    got = admit_outlinks(outlinks, parents, dns, spark.createDataFrame(robots, robots_schema), scope_default(), "crawler", **more).collect()
    return {(r["page_id"], r["found_uri"].removeprefix("http://")): r for r in got}


def refused(got):
    return {k for k, r in got.items() if r["reason"] == -9998}


DENY, OWN = "User-agent: *\nDisallow: /deny\n", "User-agent: *\nDisallow: /own\n"


def test_robots_policy_and_key(spark):
    got = admitted(spark, [("a.org", DENY)], "host string, rules string", custom=OWN)
    everywhere = {f"{h}/own" for h in ("a.org", "b.org", "b.org:8080")}
    assert refused(got) == {(0, "a.org/deny"), (3, "a.org/deny"), (3, "b.org/own"), (3, "b.org:8080/own")} | {(2, u) for u in everywhere}
    got = admitted(spark, [("c0", "http", "b.org", 8080, DENY), ("c3", "http", "b.org", 80, DENY), ("c3", "https", "a.org", 443, DENY)],
                   "collection string, scheme string, host string, port int, rules string")
    assert refused(got) == {(0, "b.org:8080/deny"), (3, "b.org/deny")}


def test_limits(spark):
    limits = spark.createDataFrame([("e0", "FETCHING", 11, 5, 10, 0), ("e1", "FETCHING", 9, 5, 10, 5), ("e2", "FETCHING", 9, 6, 0, 5),
                                    ("e3", "FINISHED", 0, 0, 0, 0)],
                                   "execution_id string, state string, bytes_crawled long, age_s long, max_bytes long, max_duration_s long")
    got = admitted(spark, [], "host string, rules string", limits=limits)
    assert {p for (p, _), r in got.items() if r["decision"] == "QUEUED"} == {1}
    assert {r["reason"] for (p, _), r in got.items() if p != 1} == {0}


def test_host_groups(spark):
    ranges = spark.createDataFrame([("group", "10.0.0.0", "10.0.0.255")], "config_id string, ip_from string, ip_to string")
    sha = {x: spark.range(1).select(short_sha1(F.lit(x))).first()[0] for x in ("10.0.0.7", "10.0.1.7", "a.org", "b.org")}
    for more, want in (({}, (sha["10.0.0.7"], sha["10.0.1.7"])), ({"ranges": ranges}, ("group", sha["10.0.1.7"])),
                       ({"use_hostname": True}, (sha["a.org"], sha["b.org"]))):
        got = admitted(spark, [], "host string, rules string", **more)
        assert {u.split("/")[0]: r["crawl_host_group_id"] for (_, u), r in got.items()} == {"a.org": want[0], "b.org": want[1], "b.org:8080": want[1]}


def test_hosts_without_a_rules_text(spark):
    """A NULL text is no text and adds no row; a blank one allows all."""
    whole = admitted(spark, [("a.org", None), ("b.org", "")], "host string, rules string", custom=OWN)
    assert len(whole) == 36 and all(page is not None for page, _ in whole)
    assert refused(whole) == {(2, f"{h}/own") for h in ("a.org", "b.org", "b.org:8080")} | {(3, "a.org/own")}
