"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix.
At each level a beta-binomial prior is centred on the parent's posterior mean; how strongly
it pulls is estimated from the spread among the groups of that level (moments).  A host is
blocked when even the lower posterior bound of its bad share exceeds the limit.  Explicit
rules go first.

A null url, or one without ``://``, has an empty host and path.  Null outcomes and outcomes
of unknown pages add nothing; with no outcomes at all every share is the uniform prior's.
Repeated rows count as often as they occur.  A host, domain or suffix may hold any share of
the rows: counts are combined before each shuffle, and lookups of frequent keys are
broadcast from a list whose length is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import lookup, lower_ascii, saved

MAX_RULES = 1000
# Common two-label public suffixes.
TWO_LABEL_SUFFIXES = ["ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                      "com.cn", "com.mx", "com.tr", "com.tw", "edu.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au",
                      "org.uk"]
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block")]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host (or a parent of it) and starts the path."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def strength(groups: DataFrame) -> float:
    """Prior strength (pseudo-observations) from groups (n, k) with n > 0: the moment estimate of
    the beta-binomial's intra-class correlation, kept between 0.0001 and 0.9."""
    r = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    rho = 0.9
    if r["g"] and 0 < r["k"] < r["n"]:
        p = r["k"] / r["n"]
        rest = r["n"] - r["g"] - (r["nn"] - r["n"]) / r["n"]
        if rest > 0:
            rho = min(max(((r["kk"] - r["n"] * p * p) / (p * (1 - p)) - (r["g"] - 1)) / rest, 0.0001), 0.9)
    return 1 / rho - 1


def reputations(hosts: DataFrame, limit: float = 0.3, z: float = 1.645) -> DataFrame:
    """From host counts (host, n labelled outcomes, k bad ones; n may be 0): per host the posterior
    mean ``bad_share``, its lower bound (normal approximation) and ``verdict``."""
    hosts = hosts.select("host", F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"),
                         domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    hosts = saved(hosts, "hosts")
    total = F.sum("n").alias("n"), F.sum("k").alias("k")
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = hosts.groupBy("suffix").agg(*total)
    all_ = suffixes.agg(*total).first()
    root = (1 + (all_["k"] or 0)) / (2 + (all_["n"] or 0))

    def mean(parent: Column, s: float) -> Column:
        return (parent * s + F.col("k")) / (s + F.col("n"))

    suffixes = suffixes.select("suffix", mean(F.lit(root), strength(suffixes)).alias("suffix_share"))
    s_domain, s_host = strength(domains), strength(hosts)
    domains = lookup(domains, suffixes, "suffix").select(
        "domain", mean(F.col("suffix_share"), s_domain).alias("domain_share"))
    out = lookup(hosts, domains, "domain").withColumn("bad_share", mean(F.col("domain_share"), s_host))
    spread = F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / (F.col("n") + s_host + 1))
    out = out.withColumn("lower_bound", F.col("bad_share") - z * spread)
    return out.select("host", "bad_share", "lower_bound",
                      F.when(F.col("lower_bound") > limit, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] | None = None, limit: float = 0.3,
          z: float = 1.645) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule and verdict.  ``outcomes`` has rows
    (url, bad): labelled pages, bad 0 or 1."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, says = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    seen = saved(pages.select("page_id", host.alias("host"), path.alias("path")), "pages")
    counts = outcomes.where("bad IS NOT NULL").select(host.alias("host"), F.lit(1).alias("n"), F.col("bad").alias("k"))
    hosts = seen.select("host", F.lit(0).alias("n"), F.lit(0).alias("k")).unionByName(counts).groupBy("host").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"))
    found = reputations(hosts, limit, z).select("host", F.col("verdict").alias("_method"))
    return lookup(seen, found, "host").select("page_id", "host", "path", rule.alias("rule"),
                                              F.coalesce(says, F.col("_method")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled outcomes of pages whose path carries the number of a labelled document: bad when
    the label says low quality or toxic."""
    page = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#0-9]*/([0-9]+)', 1) AS bigint)")
                        .alias("doc")).where("doc IS NOT NULL")
    bad = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").select(
        F.col("doc_id").alias("doc"),
        ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad"))
    return page.join(bad, "doc").select("url", "bad")
