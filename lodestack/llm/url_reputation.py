"""URL filter: rules first, else an empirical-Bayes reputation of the host (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import written

#: (verdict, "host/path prefix"); a longer rule wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Rules travel in the plan, as a map literal.
MOST_RULES = 10_000

#: Public suffixes of two labels; others are one label.
SUFFIXES = tuple("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.cn com.mx co.in co.kr co.za com.tr com.tw github.io blogspot.com".split())

#: Bounds of the prior's weight in pseudo-pages, so that a level without spread stays proper.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; "" without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host as reputation knows it: without user info, port and final dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.+$", "")


def domain_and_suffix(site: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain, a label more than the public suffix, and that suffix: one of ``suffixes`` (of two labels), else the last label.

    A site that is a suffix itself is its own domain. Addresses have the suffix "address", and each is a domain.
    """
    last, two, three = (F.substring_index(site, ".", -k) for k in (1, 2, 3))
    long = two.isin(list(suffixes)) if suffixes else F.lit(False)
    address = F.rlike(site, F.lit(r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"))
    return F.when(address, site).when(long, three).otherwise(two), F.when(address, "address").when(long, two).otherwise(last)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(length, rule, verdict), else null.

    A rule fits its host and all subdomains, if the path starts with the rule's path. The host's own
    suffixes are looked up in a map of the rules, so the work per row doesn't grow with their number.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit into a plan")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((slash + rest, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    entry = lambda x: F.struct(F.lit(x[0]).alias("path"), F.lit(len(x[1])).alias("length"), F.lit(x[1]).alias("rule"), F.lit(x[2]).alias("verdict"))
    table = F.create_map(*[c for name, own in by_host.items() for c in (F.lit(name), F.array(*[entry(x) for x in own]))])
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda x: F.startswith(path, x["path"]))
    return F.array_max(F.transform(fits, lambda x: F.struct(x["length"].alias("length"), x["rule"].alias("rule"), x["verdict"].alias("verdict"))))


def _fitted(mean: Column) -> Column:
    """The weight of a beta prior by the method of moments: what the groups' bad rates spread beyond chance around ``mean``.

    For groups with n pages and k bad ones around a mean m, the expected sum of (k - n m)^2 is
    m (1 - m) sum(n (1 + (n - 1) rho)), and the weight is 1 / rho - 1.
    """
    excess = F.sum(F.pow(F.col("k") - F.col("n") * mean, 2)) - F.sum(F.col("n") * mean * (1 - mean))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * mean * (1 - mean))
    rho = F.when(scale > 0, F.greatest(excess / scale, F.lit(0.0))).otherwise(F.lit(0.0))
    weight = F.when(~F.coalesce(scale > 0, F.lit(False)), LEAST_WEIGHT).when(rho > 0, 1 / rho - 1).otherwise(MOST_WEIGHT)
    return F.least(F.greatest(weight, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))


def beta_quantile(a: Column, b: Column, z: float) -> Column:
    """About the quantile of a beta distribution that a normal one has at -z, by the closed form 26.5.22 of Abramowitz and Stegun's handbook.

    For a and b of at least 1 it is within 0.01 of the quantile. Where b is at most 1 it is that of b = 1, which is exact and never more than the quantile;
    else, where a is at most 1/2, 0 (the quantile is near it).
    """
    below = 0.5 * math.erfc(z / math.sqrt(2))
    x, y = 1 / (2 * a - 1), 1 / (2 * F.greatest(b, F.lit(1.0)) - 1)
    h, lam = 2 / (x + y), (z * z - 3) / 6
    w = z * F.sqrt(h + lam) / h - (y - x) * (lam + 5 / 6 - 2 / (3 * h))
    return F.when(b <= 1, F.pow(F.lit(below), 1 / a)).when(a <= 0.5, 0.0).otherwise(a / (a + b * F.exp(2 * w)))


def host_reputation(outcomes: DataFrame, *, suffixes: Sequence[str] = SUFFIXES, z: float = 1.96) -> DataFrame:
    """One row per site of ``outcomes`` (site string, n long, k long): site, n, k, rate, bound of the posterior of its bad rate.

    ``n`` of a site's pages are labelled and ``k`` of those are bad. The rate is shrunk from host to registered domain to suffix to all pages.
    Each prior is what is known without the group itself, so nothing counts twice: a host's is the posterior mean of its domain's other
    hosts, theirs that of the suffix's other domains, theirs that of the other suffixes' pages. A level's weight is fitted over its groups.
    ``bound`` is the posterior's lower quantile at -z. A site without labels gets what its domain and suffix say.
    """
    domain, suffix = domain_and_suffix(F.col("site"), suffixes)
    hosts = outcomes.withColumns({"domain": domain, "suffix": suffix})
    domains = written(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("nd"), F.sum("k").alias("kd")))
    groups = written(domains.groupBy("suffix").agg(F.sum("nd").alias("ns"), F.sum("kd").alias("ks")))
    n, k = groups.agg(F.coalesce(F.sum("ns"), F.lit(0)), F.coalesce(F.sum("ks"), F.lit(0))).first()

    def weight(level: DataFrame, n: str, k: str, mean: str) -> Column:
        return F.lit(level.select(F.col(n).alias("n"), F.col(k).alias("k"), mean).agg(_fitted(F.col(mean))).first()[0])  # one number

    groups = groups.withColumn("m0", (F.lit(k) - F.col("ks") + 0.5) / (F.lit(n) - F.col("ns") + 1))
    w = weight(groups, "ns", "ks", "m0")
    domains = domains.join(groups, "suffix").withColumn("m1", (F.col("ks") - F.col("kd") + w * F.col("m0")) / (F.col("ns") - F.col("nd") + w))
    w = weight(domains, "nd", "kd", "m1")
    hosts = hosts.join(domains.select("domain", "suffix", "nd", "kd", "m1"), ["domain", "suffix"]).withColumn("m2", (F.col("kd") - F.col("k") + w * F.col("m1")) / (F.col("nd") - F.col("n") + w))
    w = weight(hosts, "n", "k", "m2")
    good, bad = F.col("n") - F.col("k") + w * (1 - F.col("m2")), F.col("k") + w * F.col("m2")
    return hosts.select("site", "n", "k", (bad / (F.col("n") + w)).alias("rate"), beta_quantile(bad, good, z).alias("bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, max_bad_rate: float = 0.25, z: float = 1.96, suffixes: Sequence[str] = SUFFIXES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", bad: Column | None = None) -> DataFrame:
    """A verdict for each row of ``pages``: page_id, host, path, rule, verdict, bad_rate, bad_bound.

    The longest rule that fits decides. Otherwise the host's bad rate does: the page is blocked where
    the posterior's lower bound is above ``max_bad_rate``, i.e. where it is credible (97.5 % one-sided by default)
    that more of the host's pages are bad than that. Ports, user info and final dots don't tell hosts apart.
    ``labels`` has an outcome for some pages; ``bad`` says which outcomes are bad (default: quality 0 or toxic 1).

    Null urls and urls without ``://`` have an empty host and path, and form one host. A null page_id is
    kept and has no label; labels of one id are merged (bad if any is); labels whose outcome is null don't count.
    Repeated rows are each judged. Without labels every host has the rate 1/2 and a wide posterior, so nothing
    but a rule blocks. Other columns of the input are neither read nor returned.
    """
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)) if bad is None else bad
    known = labels.select(F.col(f"`{label_id}`").alias("page_id"), bad.cast("long").alias("is_bad")).where("page_id is not null and is_bad is not null").groupBy("page_id").agg(F.max("is_bad").alias("is_bad"))
    url = F.col(f"`{url_col}`").cast("string")
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("site", site_of(F.col("host")))
    counted = parts.select("page_id", "site").join(known, "page_id", "left")
    outcomes = written(counted.groupBy("site").agg(F.count("is_bad").alias("n"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("k")))
    rates = host_reputation(outcomes, suffixes=suffixes, z=z).select("site", "rate", "bound")
    judged = parts.join(rates, "site", "left").withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") > max_bad_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), own).alias("verdict"), F.round("rate", 6).alias("bad_rate"), F.round("bound", 6).alias("bad_bound"))
