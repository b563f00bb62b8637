"""URL filter: rules on hosts and paths, then empirical-Bayes host reputation.

Native: DataFrame functions alone. The outcome of a labelled page (bad or not) is shrunk through
beta-binomial priors: the suffix towards all pages, the registered domain towards its suffix, the host
towards its domain. A host is blocked when the lower bound of its posterior bad rate exceeds a limit.

The registered domain is the label before the public suffix, with it. Suffixes are the last label, or two labels where a table
given as a parameter has them (``SUFFIXES`` holds common ones; a host may bring the published list). An IP literal is a domain
and a suffix of its own. A port or user is part of the host, not of its domain.

Defined cases: a null url, or one without ``://``, has an empty host and path; it is judged like any
host, by the labelled pages with an empty host. No labelled pages at all: everything is allowed.
Repeated pages count as often as they occur. Null labels are no outcomes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Common public suffixes of two labels.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "go.jp", "gov.au", "gov.uk",
    "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class Reputation:
    """z: normal quantile of the one-sided bound; limit: bad rate above which a host is blocked."""

    z: float = 1.645
    limit: float = 0.2
    least_rho: float = 0.001
    most_rho: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    plain = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    slash = F.instr(plain, "/")
    host = F.when(slash > 0, F.substring(plain, F.lit(1), slash - 1)).otherwise(plain)
    path = F.when(slash > 0, F.substring(plain, slash, F.length(plain))).otherwise(F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, whose user and port don't count. ``suffixes``: those of two labels."""
    plain = F.substring_index(host, "@", -1)
    literal = F.startswith(plain, F.lit("["))  # of IP version 6
    name = F.when(literal, F.concat(F.substring_index(plain, "]", 1), F.lit("]"))).otherwise(F.substring_index(plain, ":", 1))
    number = literal | F.rlike(name, F.lit("^[0-9]+(?:[.][0-9]+){3}$"))
    two = F.substring_index(name, ".", -2)
    double = two.isin(*suffixes) if suffixes else F.lit(False)
    domain = F.when(number, name).when(double, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(number, name).when(double, two).otherwise(F.substring_index(name, ".", -1))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):  # a longer rule is asked before the shorter ones
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _rho(x: str, n: str, keys: DataFrame, total: DataFrame, name: str, how: Reputation) -> DataFrame:
    """One row: prior strength of a level, by moments of the beta-binomial. Sums are of integers, so reruns agree."""
    sums = keys.agg(
        F.coalesce(F.sum(F.col(x) * F.col(x)), F.lit(0)).alias("xx"),
        F.coalesce(F.sum(F.col(x) * F.col(n)), F.lit(0)).alias("xn"),
        F.coalesce(F.sum(F.col(n) * F.col(n)), F.lit(0)).alias("nn"),
    ).crossJoin(total)  # one row each
    p, nn, big = F.col("p"), F.col("nn").cast("double"), F.col("n_all").cast("double")
    spread = F.col("xx").cast("double") - 2 * p * F.col("xn").cast("double") + p * p * nn
    rho = F.when((p > 0) & (p < 1) & (nn > big), (spread / (p * (1 - p)) - big) / (nn - big)).otherwise(F.lit(how.least_rho))
    rho = F.least(F.greatest(rho, F.lit(how.least_rho)), F.lit(how.most_rho))
    return sums.select((1 / rho - 1).alias(name))


def _salted(rows: DataFrame, few: DataFrame, on: list[str], by: str, salts: int) -> DataFrame:
    """An inner join in which every row of ``few`` goes out ``salts`` times, so that no key of ``rows`` is one task's."""
    spread = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return spread.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "salt"]).drop("salt")


def host_reputation(hosts: DataFrame, how: Reputation = Reputation(), suffixes: Sequence[str] = SUFFIXES, scratch: Scratch | None = None, salts: int = 16) -> DataFrame:
    """hosts(host, n, x): labelled and bad pages of every host, once each -> host, mean, lower, blocked.

    Domains and suffixes are counted from hosts, not from pages, so a host with a third of the pages is one row here. Joins up the
    levels are salted, as one suffix may hold most domains. With ``scratch`` each level is written once, not made anew for each sum.
    """
    kept = scratch.write if scratch else lambda rows, name: rows
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = kept(hosts.select("host", "n", "x", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = kept(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("x").alias("dx")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dx").alias("sx"))
    total = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n_all"), F.coalesce(F.sum("sx"), F.lit(0)).alias("x_all"))
    total = total.withColumn("p", F.when(F.col("n_all") > 0, F.col("x_all").cast("double") / F.col("n_all").cast("double")).otherwise(0.0))
    priors = (
        total.crossJoin(_rho("sx", "sn", suffixes, total, "k_suffix", how))
        .crossJoin(_rho("dx", "dn", domains, total, "k_domain", how))
        .crossJoin(_rho("x", "n", hosts, total, "k_host", how))
    )  # one row each
    real = lambda c: F.col(c).cast("double")
    m_suffix = (real("sx") + F.col("k_suffix") * F.col("p")) / (real("sn") + F.col("k_suffix"))
    m_domain = (real("dx") + F.col("k_domain") * F.col("m_suffix")) / (real("dn") + F.col("k_domain"))
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return (
        _salted(hosts, _salted(domains, suffixes, ["suffix"], "domain", salts), ["domain", "suffix"], "host", salts)
        .crossJoin(F.broadcast(priors))
        .withColumn("m_suffix", m_suffix)
        .withColumn("m_domain", m_domain)
        .withColumn("a", real("x") + F.col("k_host") * F.col("m_domain"))
        .withColumn("b", real("n") - real("x") + F.col("k_host") * (1 - F.col("m_domain")))
        .select("host", mean.alias("mean"), (mean - how.z * sd).alias("lower"))
        .withColumn("blocked", F.col("lower") > how.limit)
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], how: Reputation = Reputation(), salts: int = 16, suffixes: Sequence[str] = SUFFIXES, scratch: Scratch | None = None) -> DataFrame:
    """pages(page_id, url), outcomes(ref, bad 0/1 or null) -> page_id, host, path, rule, verdict, bad_rate, bad_rate_lower.

    A page's outcome is found by the number that ends its path. Pages are counted by (host, number)
    before the join with outcomes, and the join that brings verdicts back to pages is salted: every
    host's row goes out ``salts`` times, so a host with a third of all pages is spread over as many tasks.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    ref = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})([.]html)?/?$', 1), '') as bigint)")
    by_ref = seen.select("host", ref.alias("ref")).groupBy("host", "ref").agg(F.count("*").alias("c"))
    marks = outcomes.select("ref", "bad").filter("ref is not null and bad is not null").groupBy("ref").agg(F.max("bad").alias("bad"))
    counted = (
        by_ref.filter("ref is not null")
        .join(marks, "ref")
        .groupBy("host")
        .agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("bad")).alias("x"))
    )
    hosts = by_ref.select("host").distinct().join(counted, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", F.lit(0)).alias("x"))
    known = host_reputation(hosts, how, suffixes, scratch, salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
        .join(known, ["host", "salt"])
        .select(
            "page_id",
            "host",
            "path",
            name.alias("rule"),
            F.coalesce(verdict, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            F.col("mean").alias("bad_rate"),
            F.col("lower").alias("bad_rate_lower"),
        )
    )
