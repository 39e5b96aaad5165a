"""URL reputation: posteriors by hand, rules, lookups with hot keys, edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from tabeval.llm import common, urls
from tabeval.llm.common import lookup


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def outcomes_of(spark, rows):
    return spark.createDataFrame(rows, "url string, bad int")


def strength(groups):
    groups = [(n, k) for n, k in groups if n]
    g, n, k = len(groups), sum(x for x, _ in groups), sum(y for _, y in groups)
    rho = 0.9
    if g and 0 < k < n:
        p = k / n
        rest = n - g - (sum(x * x for x, _ in groups) - n) / n
        if rest > 0:
            rho = min(max((sum(x * (y / x - p) ** 2 for x, y in groups) / (p * (1 - p)) - (g - 1)) / rest, 1e-4), 0.9)
    return 1 / rho - 1


def brute(counts, limit, z):
    """counts: host -> (n, k); suffix and domain by the last labels."""
    def up(level):
        out = {}
        for h, (n, k) in counts.items():
            key = ".".join(h.split(".")[-level:])
            a, b = out.get(key, (0, 0))
            out[key] = a + n, b + k
        return out
    suf, dom = up(1), up(2)
    n, k = map(sum, zip(*counts.values()))
    root = (1 + k) / (2 + n)
    s1, s2, s3 = strength(suf.values()), strength(dom.values()), strength(counts.values())
    m1 = {x: (root * s1 + k) / (s1 + n) for x, (n, k) in suf.items()}
    m2 = {x: (m1[x.split(".")[-1]] * s2 + k) / (s2 + n) for x, (n, k) in dom.items()}
    out = {}
    for h, (n, k) in counts.items():
        m = (m2[".".join(h.split(".")[-2:])] * s3 + k) / (s3 + n)
        low = m - z * math.sqrt(m * (1 - m) / (n + s3 + 1))
        out[h] = m, low, "block" if low > limit else "allow"
    return out


def test_posteriors_match_brute_force(spark):
    counts = {"a.x.com": (40, 38), "b.x.com": (10, 1), "c.y.com": (0, 0), "d.y.net": (200, 10), "z.net": (3, 3),
              "w.v.z.net": (7, 0), "q.org": (60, 59), "only": (5, 2)}
    df = spark.createDataFrame([(h, n, k) for h, (n, k) in counts.items()], "host string, n int, k int")
    got = {r["host"]: r for r in urls.reputations(df).collect()}
    for h, (m, low, verdict) in brute(counts, 0.3, 1.645).items():
        assert got[h]["bad_share"] == pytest.approx(m) and got[h]["lower_bound"] == pytest.approx(low)
        assert got[h]["verdict"] == verdict
    assert got["a.x.com"]["verdict"] == "block" and got["c.y.com"]["verdict"] == "allow"


def test_hosts_paths_and_rules(spark):
    rows = [("HTTP://A.Example.ORG/es/1?q#f", "a.example.org", "/es/1", "example.org/es/", "block"),
            ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
            ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
            ("https://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
            ("x://shop.com/fr/x", "shop.com", "/fr/x", "com/fr/", "allow"),
            ("x://shop.com/de/?a=/fr/", "shop.com", "/de/", "com/de/", "block"),
            ("x://shop.com?u=http://b.org/es/", "shop.com", "", None, "allow"),
            ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://", "", "", None, "allow"),
            ("a://h#x/y", "h", "", None, "allow")]
    out = urls.judge(pages_of(spark, [(i, r[0], None) for i, r in enumerate(rows)]), outcomes_of(spark, []))
    got = {r["page_id"]: tuple(r)[1:] for r in out.collect()}
    assert [got[i] for i in range(len(rows))] == [r[1:] for r in rows]


def test_bad_hosts_are_blocked_unless_a_rule_allows(spark):
    pages = [(i, f"http://bad.shop.net/p/{i}", "") for i in range(30)] + [(99, "http://good.net/p/1", ""),
                                                                         (100, "http://bad.org/p", "")]
    seen = [(u, 1) for _, u, _ in pages[:30]] + [("http://bad.org/q", 1)] * 50 + [("http://good.net/x", 0)] * 40
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages_of(spark, pages), outcomes_of(spark, seen)).collect()}
    assert got[0] == "block" and got[99] == "allow" and got[100] == "allow"


@pytest.mark.parametrize("small", [0, 200_000])
def test_lookup_keeps_every_row(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    left = spark.range(6000).select(F.col("id"), F.when(F.col("id") < 3000, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 1500).cast("string"))).alias("key"))
    right = left.select("key").distinct().where("key <> 'k7'").withColumn("v", F.length("key"))
    out = lookup(left, right, "key")
    assert out.count() == 6000 and out.where("key = 'hot' AND v = 3").count() == 3000
    assert out.where("v IS NULL").select("key").distinct().count() == 1


def test_empty_tables_nulls_and_repeats(spark):
    none = urls.judge(pages_of(spark, []), outcomes_of(spark, []))
    assert none.count() == 0 and none.columns == ["page_id", "host", "path", "rule", "verdict"]
    pages = pages_of(spark, [(None, "http://a.com/p/5", None), (1, "http://a.com/p/5", None), (1, "http://a.com/p/5", None)])
    pages = pages.withColumn("host", F.lit("mine")).withColumn("verdict", F.lit("mine"))
    labels = spark.createDataFrame([(5, 0, None), (5, None, None), (None, 0, 1), (6, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    seen = urls.page_outcomes(pages, labels)
    assert [tuple(r) for r in seen.collect()] == [("http://a.com/p/5", 1)] * 3
    assert urls.judge(pages, seen).where("host = 'a.com'").count() == 3
