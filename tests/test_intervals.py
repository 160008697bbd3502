"""The sweep over ranges gives what looking at every range of every point gives."""

import hashlib
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from crawlatlas.functions.urls import address_key
from crawlatlas.operators.intervals import changes, least_cover
from crawlatlas.operators.joins import host_groups


def brute(points, spans):
    return {p: min((v for f, t, v in spans if f is not None and t is not None and v is not None and f <= p <= t), default=None)
            for p in points}


@pytest.mark.parametrize("slices", [None, 1, 7, 40])
def test_random_ranges(spark, slices):
    rng = random.Random(11)
    spans = []
    for i in range(600):
        first = rng.randrange(2000)
        last = min(1999, first + rng.choice([0, 0, 3, 40, 400, 2000]))
        spans.append((f"{first:04d}", f"{last:04d}", f"v{rng.randrange(400):03d}"))
    spans += [("0900", "0100", "a"), (None, "1000", "a"), ("0000", None, "a"), ("0000", "1999", None)] + spans[:20]
    points = [f"{rng.randrange(2000):04d}" for _ in range(1500)]
    table = spark.createDataFrame(spans, "first string, last string, value string").repartition(5)
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id int, _p string")
    got = least_cover(asked, "_p", table, "cover", slices, swept=50 if slices is None else 1).collect()
    want = brute(points, spans)
    assert len(got) == len(points)
    assert all(r["cover"] == want[r["_p"]] for r in got)


def test_no_ranges_and_no_points(spark):
    none = spark.createDataFrame([], "first string, last string, value string")
    asked = spark.createDataFrame([("a",)], "p string")
    assert [tuple(r) for r in least_cover(asked, "p", none, "cover").collect()] == [("a", None)]
    assert least_cover(asked.where("false"), "p", none, "cover").count() == 0


def test_nested_ranges_keep_only_changes(spark):
    """Of 100 000 ranges under one that covers all and has the smallest value, nothing but that one is noted."""
    spans = spark.range(100_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("first"), F.lit("500000").alias("last"),
                                        F.concat(F.lit("v"), F.lpad((100_000 - F.col("id")).cast("string"), 6, "0")).alias("value"))
    wide = spans.unionByName(spark.createDataFrame([("000000", "999999", "a")], "first string, last string, value string"))
    noted = changes(wide, swept=5_000).groupBy("_value").count().collect()
    assert {r["_value"] for r in noted} == {"a", None}
    asked = spark.createDataFrame([("000000",), ("050000",), ("400000",), ("500001",)], "p string")
    got = {r["p"]: r["cover"] for r in least_cover(asked, "p", spans, "cover", swept=5_000).collect()}
    assert got == {"000000": "v100000", "050000": "v050000", "400000": "v000001", "500001": None}


def test_host_groups_of_wide_and_many_ranges(spark):
    rng = random.Random(3)
    ips = [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(400)] + ["0.0.0.0", "255.255.255.255", "10.0.0.1"]
    ips += [str(ipaddress.ip_address(rng.randrange(2**128))) for _ in range(50)] + ["::", "::1", "1:2:3:4:5:6:7::"]
    spans = [("z", "0.0.0.0", "255.255.255.255"), ("y", "::", "8000::"), ("bad", "10.0.0.9", "10.0.0.1"),
             ("mixed", "10.0.0.1", "::ffff"), ("none", "10.0.0.999", "10.0.0.9"), ("null", None, "10.0.0.9")]
    for i in range(300):
        low, width = rng.randrange(2**32), rng.choice([0, 300, 2**20, 2**30])
        spans.append((f"g{i:03d}", str(ipaddress.ip_address(low)), str(ipaddress.ip_address(min(2**32 - 1, low + width)))))
    rows = spark.createDataFrame([(f"h{i}", ip, i) for i, ip in enumerate([*ips, "10.0.0.1", "10.0.0.1", None, None, "", "1.2.3", "1.2.3.400"])],
                                 "host string, ip string, _place int")
    got = {r["host"]: r for r in host_groups(rows.drop("_place"), spark.createDataFrame(spans, "config_id string, ip_from string, ip_to string")).collect()}
    assert len(got) == rows.count()

    def number(text):
        try:
            a = ipaddress.ip_address(text or "")
            return a.version, int(a)
        except ValueError:
            return None

    ends = [(g, number(f), number(t)) for g, f, t in spans]
    for host, r in got.items():
        at = number(r["ip"])
        inside = [g for g, f, t in ends if at and f and t and f[0] == t[0] == at[0] and f <= at <= t]
        text = r["ip"] if r["ip"] is not None else host
        hashed = hashlib.sha1(text.encode()).hexdigest().lstrip("0")
        assert r["host_group_id"] == (min(inside) if inside else hashed if r["ip"] is not None else "TEMP_CHG_" + hashed)


def test_address_keys(spark):
    texts = ["1.2.3.4", "255.255.255.255", "1.2.3", "1.2.3.4.5", "256.1.1.1", "", None, "x", "::", "::1", "1::", "2001:DB8::5", ":::", "1::2::3",
             "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "64:ff9b::10.0.0.255", "12345::", "g::", "1:2:3:4:5:6:7::",
             "1:2:3:4::5:6:7:8", "::1.2.3", "1.2.3.4:5", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:", ":1::2"]

    def want(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return f"f{int(a):08X}" if a.version == 4 else f"s{int(a):032X}"

    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", address_key(F.col("ip")).alias("k")).collect()
    assert {r["ip"]: r["k"] for r in rows} == {t: want(t) for t in texts}
