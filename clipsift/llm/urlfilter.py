"""Operator 4: URL filters by an empirical-Bayes reputation of hosts.

Rules of (host, path) decide first: a rule fits its host and all subdomains when the path starts with the rule's, and the
longest fitting rule wins. Pages that a rule decides are the labelled outcomes. Outcomes are summed by host; the share of
blocked pages of a host is shrunk by a beta-binomial prior towards that of its registered domain, that towards its suffix
(top-level part), and that towards all pages. The prior's strength at each level is fitted by moments. A page without a
rule is blocked when the lower bound of its host's posterior, mean - z * sd, exceeds `threshold`.

DataFrame functions only. Pages are reduced to hosts by a partial aggregation before anything is shuffled; levels above
are sums of host rows. The reputation joins back on the host, where adaptive execution splits a hot host; five fitted
scalars are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which a country suffix registers names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: (rule, verdict); a rule is host and path, as in net/es/.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where a two-letter suffix follows a usual second level (co.uk)."""
    two = F.regexp_extract(host, rf"(?:\A|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})\z", 1)
    return F.when(two != "", two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The label before the suffix, with the suffix; the host itself if it has no more."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) <= labels, host).otherwise(F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), "."))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null. Rules are few and compiled into one expression."""
    found = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        h, slash, rest = rule.partition("/")
        found.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def strength(units: DataFrame, lo: float = 1.0, hi: float = 1000.0) -> tuple[float, float]:
    """(mean, prior strength) of (n, bad) rows by moments: the variance of shares between units beyond the binomial one."""
    rate = F.col("bad") / F.col("n")
    r = units.where("n > 0").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("inv")).first()
    if not r["n"]:
        return 0.5, lo
    mean = r["bad"] / r["n"]
    spread, noise = mean * (1 - mean), r["v"] - mean * (1 - mean) * r["inv"]
    return mean, (min(hi, max(lo, (spread - r["v"]) / noise)) if noise > 0 else hi)


def reputation(outcomes: DataFrame, z: float = 1.64) -> DataFrame:
    """From (host, n, bad) rows, one per host: host, domain, suffix, mean and bound (lower) of the posterior share of bad."""
    hosts = outcomes.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("d_n"), F.sum("bad").alias("d_bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_n").alias("s_n"), F.sum("d_bad").alias("s_bad"))
    mean, k_suffix = strength(suffixes.select(F.col("s_n").alias("n"), F.col("s_bad").alias("bad")))
    _, k_domain = strength(domains.select(F.col("d_n").alias("n"), F.col("d_bad").alias("bad")))
    _, k_host = strength(hosts)
    shrunk = lambda bad, n, k, prior: (F.col(bad) + F.lit(k) * prior) / (F.col(n) + F.lit(k))
    suffixes = suffixes.withColumn("s_mean", shrunk("s_bad", "s_n", k_suffix, F.lit(mean)))
    domains = domains.join(suffixes.select("suffix", "s_mean"), "suffix").withColumn("d_mean", shrunk("d_bad", "d_n", k_domain, F.col("s_mean")))
    hosts = hosts.join(domains.select("suffix", "domain", "d_mean"), ["suffix", "domain"]).withColumn("mean", shrunk("bad", "n", k_host, F.col("d_mean")))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(k_host + 1.0)))
    return hosts.select("host", "domain", "suffix", "mean", (F.col("mean") - F.lit(z) * sd).alias("bound"))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, z: float = 1.64, threshold: float = 0.9) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), bound.

    Null urls and urls without :// have an empty host and path, fit no rule and share the reputation of the empty host,
    which has no outcomes of its own. Repeated rows count as often as they occur. Empty tables give no rows; other
    columns are ignored.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = dict(rules)
    said = F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv])[F.col("rule")] if rules else F.lit(None).cast("string")
    ruled = ruled.withColumn("_said", said)
    outcomes = cut(ruled.groupBy("host").agg(F.count("_said").alias("n"), F.count_if(F.col("_said") == "block").alias("bad")))
    hosts = reputation(outcomes, z).select("host", "bound")
    verdict = F.coalesce(F.col("_said"), F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(hosts, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bound")
