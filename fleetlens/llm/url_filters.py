"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted by host. A beta-binomial prior goes down the
levels: suffix rates shrink to the overall rate, registered domains to their
suffix's posterior, hosts to their domain's posterior. The strength of each
prior is estimated from the spread of the rates at its level (method of
moments). A host is blocked when the upper posterior bound of its rate of good
pages is under a floor, so that few labels never block.

Everything is DataFrame expressions; counts are pre-aggregated by host before
any join, and the page side of the join can be split by AQE where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm._common import ascii_lower

#: Parts of the URL: host up to / ? # or the end, path up to ? # or the end.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Suffixes of two labels under which names are registered; others are the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "co.in", "co.kr")
#: (host, path, verdict)
Rules = list[tuple[str, str, str]]
RULES: Rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a text without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix. A host without a dot, an empty one too, is its own domain and suffix."""
    suffix = F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    labels = F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return labels, suffix


def _strength(groups: DataFrame, prior: Column, low: float, high: float) -> DataFrame:
    """One row: prior strength of a level by moments: within-group binomial variance against the observed spread. No groups: the high end."""
    n, m = F.col("n"), prior
    spread = F.sum(n * F.pow(F.col("k") / n - m, 2))
    inner = F.sum(m * (1 - m))
    outer = F.sum((n - 1) * m * (1 - m))
    # E[spread] = inner + outer / (s + 1)
    return groups.where(n > 0).agg((outer / F.greatest(spread - inner, F.lit(1e-9)) - 1).alias("s")).select(F.least(F.greatest(F.coalesce("s", F.lit(high)), F.lit(low)), F.lit(high)).alias("s"))


def host_reputation(hosts: DataFrame, z: float = 1.64, low: float = 2.0, high: float = 200.0) -> DataFrame:
    """From (host, n, k), labelled and good pages by host, to (host, n, k, rate, upper).

    n may be 0: the posterior is then the prior of the registered domain.
    Without any label the overall rate is 0.5. ``low`` and ``high`` bound each
    level's estimated strength, ``z`` is the width of the bound.
    """
    domain, suffix = domain_of(F.col("host"))
    hosts = hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("top"))
    post = lambda m: (F.col("k") + F.col("s") * m) / (F.col("n") + F.col("s"))

    def shrink(groups: DataFrame, m: str, name: str) -> DataFrame:
        s = _strength(groups, F.col(m), low, high)
        return groups.join(F.broadcast(s)).withColumn(name, post(F.col(m)))  # s is one row

    suffixes = shrink(suffixes.join(F.broadcast(total)), "top", "suffix_rate")
    domains = shrink(domains.join(suffixes.select("suffix", "suffix_rate"), "suffix"), "suffix_rate", "domain_rate")
    scored = shrink(hosts.join(domains.select("domain", "domain_rate"), "domain"), "domain_rate", "rate")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("s") + 1))
    return scored.select("host", "n", "k", "rate", (F.col("rate") + z * sd).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Rules = RULES, floor: float = 0.5, z: float = 1.64) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation) for each row of ``pages`` (page_id, url).

    ``outcomes`` (page_id, good) labels pages 1 or 0; rows with a null in either
    column don't count, and repeated rows of a page count by their mean. A null
    url and one without ``://`` have an empty host and path, which no rule fits;
    their host has a reputation as any other. Repeated pages come back as often.
    Extra columns are left aside. Without labels the method allows all.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    good = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.avg("good").alias("good"))
    labelled = parts.select("page_id", "host").join(good, "page_id", "left")
    counts = labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("k"))
    known = host_reputation(counts, z).select("host", F.col("rate").alias("reputation"), "upper")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("upper") < floor, "block").otherwise("allow")
    return parts.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("reputation", 6).alias("reputation"))
