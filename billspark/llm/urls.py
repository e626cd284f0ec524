"""Page filtering by URL: fixed rules first, else the reputation of the host by empirical Bayes.

Page outcomes (good or not) are counted by host, registered domain, suffix and over all. At each level
the rate of a child is shrunk towards its parent: a beta prior with the parent's shrunk rate as its mean, and
a strength estimated from how much the children of the level differ (method of moments). A page
is allowed unless even the upper bound of its host's posterior rate stays under the least rate.

Built from column functions and joins only. Outcomes are counted before they are shuffled, so a large
host is one row from then on. The table of hosts is counted: a short one is broadcast, a long one is
joined by shuffle, where Spark splits the partitions of large hosts.

Defined cases: a missing url, or one without ``://``, has an empty host and path; the empty host is a host of
its own with an empty domain and suffix; hosts without outcomes take their domain's posterior, and
so on upwards; without any outcome the rate is one, as nothing speaks against a page; repeated rows are judged once each and
their outcomes all count; pages without an outcome do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import materialize

#: Rules of the query (fixed values): verdict, host with all its subdomains, beginning of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Least posterior rate of good pages, and standard deviations of the bound above the mean.
LEAST_RATE, DEVIATIONS = 0.6, 2.0
#: Limits of the strength of a prior, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Hosts whose verdicts may be broadcast (about 50 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 200_000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """The last two labels; a host of one label is its own domain."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name = F.when(fits, domain + start).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


def _shrunk(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """``children`` (``n``, ``good``) with ``rate`` and ``weight``: their beta posteriors under ``parents``.

    The strength of the prior follows from the moments of the children's rates: their variance is
    p (1 - p) / n by chance, and what goes beyond that is p (1 - p) / (strength + 1).
    """
    joined = children.join(parents.select(parent, F.col("rate").alias("prior")), parent)
    chance = F.col("prior") * (1 - F.col("prior"))
    spread = joined.filter("n > 0").agg(
        F.sum(F.col("n") * chance).alias("chance"),
        F.sum(F.pow(F.col("good") - F.col("n") * F.col("prior"), 2) / F.col("n") - chance).alias("beyond"),
    )
    found = spread.first()  # two numbers
    strength = STRONGEST
    if found.beyond is not None and found.beyond > 0:
        strength = min(max(found.chance / found.beyond - 1, WEAKEST), STRONGEST)
    weight = F.col("n") + F.lit(strength)
    return joined.withColumn("rate", (F.col("good") + F.lit(strength) * F.col("prior")) / weight).withColumn(
        "weight", weight
    ).drop("prior")


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, rate, weight``: posterior rate of good pages and its weight in pages, for every host.

    ``outcomes`` has ``page_id`` and ``good`` (boolean).
    """
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"))
    known = outcomes.filter("good IS NOT NULL").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good")
    )
    counts = hosts.join(known, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    counts = counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    counts = materialize(counts.withColumn("all", F.lit(1)), "hosts")
    totals = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    root = counts.groupBy("all").agg(*totals).withColumn(
        "rate", F.when(F.col("n") > 0, (F.col("good") + 1) / (F.col("n") + 2)).otherwise(1.0)
    )
    suffixes = _shrunk(counts.groupBy("suffix", "all").agg(*totals), root, "all")
    domains = _shrunk(counts.groupBy("domain", "suffix").agg(*totals), suffixes, "suffix")
    return _shrunk(counts.select("host", "domain", "n", "good"), domains, "domain").select("host", "rate", "weight")


def filter_pages(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, least_rate: float = LEAST_RATE, deviations: float = DEVIATIONS
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page; ``rule`` is null where reputation decides."""
    bound = F.col("rate") + deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    hosts = host_reputation(pages, outcomes)
    judged = materialize(
        hosts.select("host", F.when(bound < least_rate, "block").otherwise("allow").alias("by_host")), "reputation"
    )
    few = judged.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    url = F.col("url")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return cut.join(F.broadcast(judged) if few else judged, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host").alias("verdict")
    )
