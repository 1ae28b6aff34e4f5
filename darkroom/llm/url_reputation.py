"""URL rules, and for the rest an empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, spread_join, written

#: Labels under which two-letter country suffixes register names.
SECOND_LEVEL = "ac|co|com|edu|gov|net|org"
REGISTERED = rf"([^.]+\.(?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+))$"


def host_of(url: Column) -> Column:
    """Lower-cased, after the first ``://``; empty if there is none or the url is null."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


#: An address of numbers, or one in brackets.
ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$"


def name_of(host: Column) -> Column:
    """The host without user name, port and final dots: what its reputation goes by."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", ""), F.lit("."))


def domain_of(name: Column) -> Column:
    """The registered domain; a name without dots and an address are their own."""
    found = F.regexp_extract(name, REGISTERED, 1)
    return F.when(name.rlike(ADDRESS) | (found == ""), name).otherwise(found)


def suffix_of(domain: Column) -> Column:
    """What follows the first dot; empty if there is none, and for an address."""
    return F.when(domain.rlike(ADDRESS), "").otherwise(F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls. ``rules``: a short list of (action, "host/path")."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def _strength(children: DataFrame) -> float:
    """Pseudo-counts of the prior by the method of moments, from (good, n, prior): how far rates stray from the
    prior's mean beyond chance gives the correlation within a child, which is held to 1/1001 .. 1/2."""
    q, k, m = (
        children.where("n > 0 AND prior > 0 AND prior < 1")
        .agg(F.sum(F.expr("n * pow(good / n - prior, 2) / (prior * (1 - prior))")), F.count(F.lit(1)), F.sum(F.expr("n - 1")))
        .first()
    )
    rho = (q - k) / m if m else 0.0
    return 1 / min(max(rho, 1 / 1001), 0.5) - 1


TERMS, LARGE = 400, 500  # terms of each series, and pseudo-counts from which on the normal law is used


def beta_below(a: Column, b: Column, x: float) -> Column:
    """How likely a rate under the beta law of ``a`` and ``b`` is below ``x``, from the series of the two incomplete integrals,
    whose common factor cancels out. Over LARGE pseudo-counts it is the normal law's, by a logistic fit to within 2e-4."""

    def series(own, by):  # 1 + by (a + b) / (own + 1) + by^2 (a + b) (a + b + 1) / ((own + 1) (own + 2)) + ..
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

        def add(acc, k):
            term = acc["term"] * F.lit(by) * (a + b + k) / (own + 1 + k)
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, add)["sum"] / own

    below, above = series(a, x), series(b, 1 - x)
    z = (F.lit(x) - a / (a + b)) / F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return F.when(a + b <= LARGE, below / (below + above)).otherwise(1 / (1 + F.exp(-(1.5976 * z + 0.07056 * F.pow(z, F.lit(3))))))


def host_reputation(pages: DataFrame, outcomes: DataFrame, min_rate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(name, rate, p_low): the posterior mean of the rate of good pages of each host name, and how likely it is below ``min_rate``;
    and (name, n): how many pages each has.

    ``pages`` is (page_id, name), ``outcomes`` (page_id, good, n): good ones among n counted. Rates shrink from the name to its
    registered domain, to the suffix, to all: each level's posterior mean is the prior mean of the level below. A name
    without outcomes takes its domain's prior, and if there are no outcomes at all the rate is one half. Pages are counted by id and name before
    they meet their outcomes, and ids that many names share are dealt over salts.
    """
    counted = written(pages.groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("pages")), "pages")
    known = spread_join(counted.where("page_id IS NOT NULL"), outcomes, "page_id", "name")
    known = known.select("name", F.lit(0).cast("long").alias("pages"), (F.col("pages") * F.col("good")).alias("good"), (F.col("pages") * F.col("n")).alias("n"))
    nothing = F.lit(0).cast("long")
    both = counted.select("name", "pages", nothing.alias("good"), nothing.alias("n")).unionByName(known)
    hosts = both.groupBy("name").agg(F.sum("pages").alias("pages"), F.sum("good").cast("double").alias("good"), F.sum("n").cast("double").alias("n"))
    hosts = written(hosts.withColumn("domain", domain_of(F.col("name"))).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    sums = F.sum("good").alias("good"), F.sum("n").alias("n")
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    good, n = suffixes.agg(*sums).first()
    nodes = suffixes.withColumn("prior", F.lit(((good or 0.0) + 1) / ((n or 0.0) + 2)))
    for level, children in (("suffix", domains), ("domain", hosts)):
        strength = _strength(nodes)
        parents = nodes.select(level, F.expr(f"({strength!r}D * prior + good) / ({strength!r}D + n)").alias("prior"))
        nodes = children.join(parents, level)
    strength = _strength(nodes)
    a, b = F.expr(f"{strength!r}D * prior + good"), F.expr(f"{strength!r}D * (1 - prior) + n - good")
    out = nodes.select("name", a.alias("a"), b.alias("b"))
    rated = out.select("name", F.expr("a / (a + b)").alias("rate"), beta_below(F.col("a"), F.col("b"), min_rate).alias("p_low"))
    return rated, hosts.select("name", F.col("pages").alias("n"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], min_rate: float = 0.5, level: float = 0.95, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, p_low) of every row.

    The longest rule that fits decides; else a host is blocked if its rate of good pages is below ``min_rate`` with a
    posterior probability of over ``level``, so that the upper bound of the rate at that level is below it; a host exactly at ``level`` is allowed.
    Hosts that differ in user name, port or final dots alone share one reputation; addresses have no domain but themselves. Null
    urls have empty host and path and share the reputation of the empty host; null and repeated ids stay as they are, a repeated row
    counts each time, and an id with several outcomes counts each. Urls of any length are read whole. An empty table gives no rows.
    """
    counted = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    host = host_of(F.col(url_col))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("name", name_of(F.col("host")))
    reputation, sizes = host_reputation(parts.select("page_id", "name"), counted, min_rate)
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    judged = spread_join(parts.withColumns({"rule": rule, "action": action}), reputation, "name", "path", "left", sizes=sizes)
    verdict = F.coalesce("action", F.when(F.col("p_low") > level, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "rate", "p_low")
