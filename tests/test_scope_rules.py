"""Golden cases of the scope rules."""

from pyspark.sql import functions as F

from crawlatlas.functions import urls as U
from crawlatlas.operators import scope as S

URL = "http://foo.bar/aa bb/cc?jsessionid=1&foo#bar"


def decide(spark, uri, seed, rules, path="", params=None, referrer=""):
    df = spark.createDataFrame([(uri, seed, path, referrer, params or {})],
                               "uri string, seed_uri string, discovery_path string, referrer string, annotation map<string,string>")
    return S.scope_decide(df, rules).first()


def test_same_host(spark):
    inside = decide(spark, URL, "http://foo.bar", [S.is_same_host().then(S.INCLUDE, proceed=True)])
    assert (inside["evaluation"], inside["exclude_reason"]) == ("INCLUDE", 0)
    assert inside["include_check_uri"]["href"] == "http://foo.bar/aa%20bb/cc?foo&jsessionid=1"
    sub = URL.replace("foo.bar", "sub.foo.bar")
    outside = decide(spark, sub, "http://foo.bar", [S.is_same_host().then(S.INCLUDE)])
    assert (outside["evaluation"], outside["exclude_reason"], outside["error_msg"]) == (
        "EXCLUDE", -5001, "No scope rules matched")
    assert decide(spark, sub, "http://foo.bar", [S.is_same_host("true").then(S.INCLUDE)])["evaluation"] == "INCLUDE"
    assert decide(spark, sub, "http://x.org", [S.is_same_host("true", "foo.bar http://y.org").then(S.INCLUDE)])["evaluation"] == "INCLUDE"


def test_missing_parameter_and_bad_url(spark):
    missing = decide(spark, URL, "http://foo.bar", [S.is_scheme(S.param("scheme")).then(S.INCLUDE)])
    assert (missing["evaluation"], missing["exclude_reason"]) == ("EXCLUDE", -5)
    assert missing["error_msg"] == "no value with name 'scheme'"
    assert decide(spark, "http://", "http://foo.bar", S.scope_default())["exclude_reason"] == -7


def test_lists_and_paths(spark):
    assert decide(spark, URL, "", [S.is_url("http://a.b/ foo.bar/aa%20bb/cc?foo&jsessionid=1").then(S.BLOCKED)])["exclude_reason"] == -5001
    assert decide(spark, URL, "", [S.is_path_prefix("/zz /aa%20bb").then(S.CHAFF_DETECTION)])["exclude_reason"] == -4000
    assert decide(spark, URL, "", [S.is_path_prefix("/zz /bb").then(S.CHAFF_DETECTION)])["error_msg"] == S.NO_RULE
    assert decide(spark, URL, "", [S.is_referrer("HTTP://R.ORG").then(S.INCLUDE)], referrer=" http://r.org ")["exclude_reason"] == 0


def test_order_of_rules(spark):
    rules = [S.set_status(S.TOO_MANY_HOPS), S.test("yes").then(S.INCLUDE, proceed=True), S.test("no").then(S.BLOCKED),
             S.abort(), S.set_status(S.BLOCKED)]
    assert decide(spark, URL, "", rules)["exclude_reason"] == 0
    removed = [S.remove_query("jsessionid"), S.is_url("http://foo.bar/aa%20bb/cc?foo").then(S.INCLUDE)]
    assert decide(spark, URL, "", removed)["exclude_reason"] == 0
    both = S.is_scheme("ftp").then(S.INCLUDE).otherwise(S.CHAFF_DETECTION)
    assert decide(spark, URL, "", [both])["exclude_reason"] == -4000


def test_hops_parameter_texts(spark):
    def hops(text):
        return decide(spark, URL, "", [S.max_hops_from_seed(text).then(S.TOO_MANY_HOPS), S.set_status(S.INCLUDE)], path="LRL")["exclude_reason"]

    assert [hops("1"), hops("2"), hops("many"), hops("None")] == [-4001, 0, 0, -5]


def test_user_rule_gets_parameters(spark):
    df = spark.createDataFrame([(URL, "", "", "", {"deny": "foo.bar"}), (URL, "", "", "", {"deny": "x"})],
                               "uri string, seed_uri string, discovery_path string, referrer string, annotation map<string,string>")

    def rule(batch):
        denied = batch["annotation"].map(lambda a: dict(a)["deny"]) == batch["host"]
        return denied.map({True: S.BLOCKED, False: S.INCLUDE})

    assert sorted(r["exclude_reason"] for r in S.scope_user_rule(df, rule).collect()) == [-5001, 0]
    assert S.scope_outcomes(S.scope_user_rule(df, rule)).where(F.col("n") == 1).count() == 2


def test_suffix_rules_with_wildcards_and_exceptions(spark):
    rules = U.suffix_rules(["// ICANN", "", "ck", "*.ck", "!www.ck", "com.sg  // note", "SG", "kobe.jp", "公司.cn", "*.kobe.jp"])
    assert rules == sorted(["ck", "*.ck", "!www.ck", "com.sg", "sg", "kobe.jp", "xn--55qx5d.cn", "*.kobe.jp"])
    want = {
        "www.foo.ck": "www.foo.ck", "www.a.foo.ck": "a.foo.ck", "www.www.ck": "www.ck", "www2.com.sg": "www2.com.sg",
        "www.shop.com.sg": "shop.com.sg", "www.a.sg": "a.sg", "www.city.kobe.jp": "www.city.kobe.jp",
        "www.b.city.kobe.jp": "b.city.kobe.jp", "www.sg": "www.sg", "www.xn--55qx5d.cn": "www.xn--55qx5d.cn",
        "www..a.sg": "www..a.sg", "www.a..sg": "www.a..sg", "shop.com.sg": "shop.com.sg", "": "",
    }
    hosts = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r["h"]: r["a"] for r in hosts.select("h", U.scope_anchor(F.col("h"), rules).alias("a")).collect()} == want
    # By default too, no seed is widened to a suffix that a wildcard rule makes.
    assert hosts.where("h = 'www.foo.ck'").select(U.scope_anchor(F.col("h"))).first()[0] == "www.foo.ck"
    same = S.is_same_host("true", suffixes=rules).then(S.INCLUDE)
    assert decide(spark, "http://x.foo.ck/", "http://www.foo.ck/", [same])["exclude_reason"] == S.BLOCKED
    assert decide(spark, "http://x.a.foo.ck/", "http://www.a.foo.ck/", [same])["exclude_reason"] == S.INCLUDE
    assert decide(spark, "http://x.www.ck/", "http://www.www.ck/", [same])["exclude_reason"] == S.INCLUDE


def test_same_host_rules_with_different_arguments_in_one_list(spark):
    rules = [S.is_same_host().then(S.INCLUDE), S.is_same_host("true", "a.org").then(S.CHAFF_DETECTION)]
    assert decide(spark, "http://b.a.org/", "http://s.org/", rules)["exclude_reason"] == S.CHAFF_DETECTION
    assert decide(spark, "http://s.org/", "http://s.org/", rules)["exclude_reason"] == S.INCLUDE
    assert "_seed" not in " ".join(S.scope_decide(spark.createDataFrame(
        [("http://s.org/", "http://s.org/", "", "", {})], "uri string, seed_uri string, discovery_path string, "
        "referrer string, annotation map<string,string>"), rules).columns)


def test_scope_rules_share_one_pass_through_python(spark):
    """Each further pass is a Python worker more in every task."""
    rows = spark.createDataFrame([("http://a.example.com/x?b=1&a=2", "http://Ø.example.com/", "L", "", {
        "scope_allowedSchemes": "http", "scope_includeSubdomains": "true", "scope_altSeeds": "http://a.example.com/",
        "scope_maxHopsFromSeed": "2", "scope_hopsIncludeRedirects": "", "scope_excludedUris": "http://a.example.com/./y"})],
        "uri string, seed_uri string, discovery_path string, referrer string, annotation map<string,string>")
    decided = S.scope_decide(rows, S.scope_default())
    assert decided.collect()[0]["evaluation"] == "INCLUDE"
    assert decided._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_what_workers_remember_is_bounded_by_length():
    from crawlatlas.functions import robots as R
    from crawlatlas.functions import urls as U
    kept, rules = U._kept_uri.cache_info().currsize, R._kept_rules.cache_info().currsize
    for i in range(5):
        assert U.parse_uri(f"http://a.org/{i}/" + "x" * 5000)[2] == "a.org"
        assert not R.allows(f"User-agent: *\nDisallow: /p{i}\n" + "# long\n" * 2000, "crawler", f"http://a.org/p{i}")
    assert (U._kept_uri.cache_info().currsize, R._kept_rules.cache_info().currsize) == (kept, rules)
    assert U._kept_uri.cache_info().maxsize * U.KEPT_LENGTH <= 1 << 22
    assert R._kept_rules.cache_info().maxsize * R.KEPT_LENGTH <= 1 << 22 and R._last_rules.cache_info().currsize == 1
