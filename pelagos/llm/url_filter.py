"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted per host and rolled up to registered domain and public suffix.  At
each level the spread between siblings beyond chance fixes the strength of a beta-binomial prior by the method of
moments, and the posterior mean of the parent is its centre: suffixes shrink to the overall rate, domains to their
suffix, hosts to their domain.  A host passes if the lower posterior bound of its good rate, mean less ``z`` posterior
standard deviations (a normal bound: the beta quantile itself is not computed), reaches ``least_share`` of the good
rate over all outcomes.  The bar follows the labels, so it means the same in a corpus of few and of many good pages.
A host without outcomes is judged by what its domain and suffix say.

Edge cases
    null url, or no ``://``   host and path are empty; judged as the host ""
    no outcomes at all        the overall rate is one half, with the weight of two pages
    repeated rows             each page is judged; repeated outcomes count as often as they appear
    ties                      outcomes of one page that differ count as one good and one bad page
    very long url             parsed whole
    null outcome              ignored
    empty table               empty result of the same columns
    extra columns             ignored by name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.scratch import written

Z = 1.645
#: Share of the overall good rate that the lower bound must reach.
LEAST_SHARE = 0.9
#: Prior strengths, in pages, are kept within these.
WEIGHTS = (1.0, 1000.0)
#: Public suffixes of two labels that are told apart from the last label alone.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "co.za")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/?#``, with A-Z in lower case; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next of ``?#``; empty where the url has no ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    two = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES)
    return F.regexp_extract(name, rf"(?:^|\.)({two}|[^.]*)\.?$", 1)


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and one label before it."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    two = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES)
    return F.regexp_extract(name, rf"(?:^|\.)((?:[^.]*\.)?(?:{two}|[^.]*))\.?$", 1)


def matching_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest of ``rules`` (``host/path``) whose host is ``host`` or a parent and whose path begins ``path``."""
    fits = []
    for rule in sorted(set(rules), key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        under = (host == name) | host.endswith("." + name)
        fits.append(F.when(under & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _weight(children: DataFrame) -> float:
    """Prior strength from columns n, k and mu: the excess spread of k over binomial chance, pooled over children."""
    excess = F.sum(F.pow(F.col("k") - F.col("n") * F.col("mu"), 2) - F.col("n") * F.col("mu") * (1 - F.col("mu")))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * F.col("mu") * (1 - F.col("mu")))
    top, bottom = children.agg(excess, scale).first()
    low, high = WEIGHTS
    rho = top / bottom if bottom else 0.0
    return high if rho <= 0 else min(max(1 / rho - 1, low), high)


def _posterior(weight: float) -> Column:
    return (F.col("mu") * weight + F.col("k")) / (weight + F.col("n"))


def host_reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """host, n, k, mean, lower and the overall rate of every host; ``hosts`` has unique host with n outcomes, k of them good."""
    hosts = hosts.select("host", "n", "k", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    hosts = written(hosts, "hosts")
    domains = written(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    overall = ((k or 0) + 1) / ((n or 0) + 2)
    top = suffixes.withColumn("mu", F.lit(overall))
    above = written(top.select("suffix", _posterior(_weight(top)).alias("mu")), "suffix-means")
    middle = domains.join(above, "suffix")
    above = written(middle.select("suffix", "domain", _posterior(_weight(middle)).alias("mu")), "domain-means")
    low = hosts.join(above, ["suffix", "domain"])
    weight = _weight(low)
    mean, size = _posterior(weight), F.lit(weight) + F.col("n")
    lower = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    made = low.select("host", "n", "k", mean.alias("mean"), size.alias("size"))
    return made.select("host", "n", "k", "mean", lower.alias("lower"), F.lit(overall).alias("overall"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    allow: list[str],
    block: list[str],
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = Z,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and its host's outcomes n, posterior mean and lower bound.

    ``outcomes`` has the columns url and good (1 or 0).
    """
    url = pages[url_col]
    rows = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = outcomes.where(F.col("good").isNotNull()).select(host_of(F.col("url")).alias("host"), F.col("good").alias("k"))
    seen = seen.select("host", F.lit(1).alias("n"), "k")
    named = rows.select("host", F.lit(0).alias("n"), F.lit(0).alias("k"))
    hosts = named.unionByName(seen).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    known = written(host_reputation(hosts, z).withColumnRenamed("host", "known_host"), "reputation")
    judged = rows.join(known, rows["host"] == known["known_host"])
    rule = matching_rule(F.col("host"), F.col("path"), [*allow, *block])
    good = F.col("rule").isin(list(allow)) if allow else F.lit(False)
    verdict = F.when(F.col("rule").isNull(), F.col("lower") >= least_share * F.col("overall")).otherwise(good)
    judged = judged.withColumn("rule", rule)
    verdict = F.when(verdict, "allow").otherwise("block").alias("verdict")
    return judged.select("id", "host", "path", "rule", verdict, "n", "mean", "lower")
