"""URL filter: Empirical-Bayes host reputation under explicit rules.

Each host's rate of bad pages has a beta prior whose mean is its registered domain's posterior
mean; the domain's prior comes from its suffix, the suffix's from the whole table. How strongly a
level is drawn to the one above is estimated from the data by the method of moments. A host is
blocked when the lower bound of its posterior is over the limit.

Pages are counted by host before anything moves. Rules and reputation are looked up once for each host; the hosts are sent to
all tasks if their measured size allows, else the pages are shuffled to them, those of hosts with very many pages to several tasks.

Defined results: a null url or one without ``://`` has an empty host and an empty path, and the
empty host has a reputation like any other. Urls and hosts of any length are read whole. Repeated rows are judged alike. A host without
labelled pages gets its prior. Of rules of one length the first by text holds, of equal rules the last one given. An empty table gives an
empty result. Input columns named like a result column are replaced, columns of other names pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import ascii_lower, durable, hot_keys, small_or_plain, spread_join, unused
from seqloom.shipping import ship

#: Suffixes of two labels that count as one, a small part of the public list. Pass a fuller list where it matters.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za", "com.cn")
RESULTS = ("host", "path", "rule", "verdict", "n_labelled", "bad_mean", "bad_lower")


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a prefix of the path."""

    action: str
    host: str
    path: str

    @classmethod
    def parse(cls, action: str, text: str) -> Rule:
        host, slash, rest = text.partition("/")
        return cls(action, host, slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name_of(host: Column) -> Column:
    """The host without a user before it or a port after it."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _is_number(name: Column) -> Column:
    return name.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$")


def _tails(name: Column, known: Sequence[str], more: int, default: Column) -> Column:
    """The longest known suffix of a name with so many labels before it."""
    by_labels: dict[int, list[str]] = {}
    for s in known:
        by_labels.setdefault(s.count(".") + 1, []).append(s)
    out = default
    for k in sorted(by_labels):
        out = F.when(F.substring_index(name, ".", -k).isin(*by_labels[k]), F.substring_index(name, ".", -k - more)).otherwise(out)
    return out


def suffix_of(host: Column, known: Sequence[str] = SUFFIXES) -> Column:
    """The longest known suffix, else the last label; addresses in numbers have none."""
    name = _name_of(host)
    return F.when(_is_number(name), "").otherwise(_tails(name, known, 0, F.substring_index(name, ".", -1)))


def domain_of(host: Column, known: Sequence[str] = SUFFIXES) -> Column:
    """The suffix with one label more; of addresses in numbers all."""
    name = _name_of(host)
    return F.when(_is_number(name), name).otherwise(_tails(name, known, 1, F.substring_index(name, ".", -2)))


def rules_by_host(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each host that a rule names, itself or a subdomain of it, with rules: structs of path, text and action, the longest text first.

    A host is cut to as many labels as any rule's host has and looked up; only the hosts meet the rules, not the pages.
    """
    spark = hosts.sparkSession
    kind = "at string, path string, text string, action string"
    last = {r.text: r for r in rules}
    table = spark.createDataFrame([(r.host, r.path, r.text, r.action) for r in last.values()], kind)
    labels = sorted({r.host.count(".") + 1 for r in rules})
    cuts = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in labels])) if labels else F.array().cast("array<string>")
    small, _ = small_or_plain(table, F.octet_length("text") + F.octet_length("path") + F.octet_length("at"))
    found = hosts.select("host", F.explode(cuts).alias("at")).join(small, "at")
    order = F.struct((-F.length("text")).alias("n"), "text", "path", "action")
    return found.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("rules"))


def _strength(children: DataFrame, n: str, k: str, mean: str) -> float:
    """Prior strength of a level: how far its units stray from their parents' means beyond chance."""
    c = children.filter(F.col(n) > 0).select(
        F.col(n).cast("double").alias("n"), (F.col(k) / F.col(n)).alias("p"), F.col(mean).alias("m")
    )
    r = c.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("p") - F.col("m"), 2)).alias("s"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("m") * (1 - F.col("m")) * F.col("n")).alias("v"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("v1"),
    ).first()
    if not r["n"] or not r["v"]:
        return 1e4
    over = (r["s"] - r["v1"]) / r["n"]
    room = (r["v"] - r["v1"]) / r["n"]
    rho = min(0.99, max(1e-4, over / room if room > 0 else 1e-4))
    return 1 / rho - 1


def _beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    gamma = np.vectorize(math.lgamma, otypes=[float])
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 1e-300, 1 - 1e-16)
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 200):
        for t in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    return np.where(flip, 1 - front * f, front * f)


def beta_quantile(a: np.ndarray, b: np.ndarray, level: float) -> np.ndarray:
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(40):
        mid = (low + high) / 2
        below = _beta_cdf(a, b, mid) < level
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def host_reputation(counts: DataFrame, level: float = 0.05, known: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per host: n_labelled, bad_mean and bad_lower.

    counts has host, n (labelled pages) and k (bad ones), one row for each host.
    """
    ship(counts.sparkSession)
    hosts = durable(
        counts.select("host", "n", "k", domain_of(F.col("host"), known).alias("domain"), suffix_of(F.col("host"), known).alias("suffix")), "hosts"
    )
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = ((whole["k"] or 0) + 0.5) / ((whole["n"] or 0) + 1)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("ns"), F.sum("k").alias("ks"), F.count("*").alias("rows")).withColumn("root", F.lit(root))
    s = _strength(suffixes, "ns", "ks", "root")
    suffixes = suffixes.select("suffix", "rows", ((F.col("ks") + s * root) / (F.col("ns") + s)).alias("ms"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("nd"), F.sum("k").alias("kd"), F.count("*").alias("rows"))
    domains = spread_join(domains, suffixes.drop("rows"), ["suffix"], hot_keys(suffixes, ["suffix"], "rows"))
    s = _strength(domains, "nd", "kd", "ms")
    domains = domains.select("domain", "suffix", "rows", ((F.col("kd") + s * F.col("ms")) / (F.col("nd") + s)).alias("md"))
    known_hosts = spread_join(hosts, domains.drop("rows"), ["domain", "suffix"], hot_keys(domains, ["domain", "suffix"], "rows"))
    s = _strength(known_hosts, "n", "k", "md")
    known_hosts = known_hosts.select(
        "host", F.col("n").alias("n_labelled"), (F.col("k") + s * F.col("md")).alias("a"),
        (F.col("n") - F.col("k") + s * (1 - F.col("md"))).alias("b"),
    )

    def bound(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            a, b = p.pop("a").to_numpy(float), p.pop("b").to_numpy(float)
            yield p.assign(bad_mean=a / (a + b), bad_lower=beta_quantile(a, b, level))

    return known_hosts.mapInPandas(bound, "host string, n_labelled long, bad_mean double, bad_lower double")


def count_hosts(pages: DataFrame, bad: str = "bad", weight: str | None = None) -> DataFrame:
    """host, pages, n and k of pages with a host; bad is 1 or 0 for labelled pages and null for others. weight: pages that a row stands for."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counted = pages.groupBy("host").agg(
        total(w).alias("pages"), total(F.when(F.col(bad).isNotNull(), w)).alias("n"), total(F.when(F.col(bad) == 1, w)).alias("k")
    )
    return durable(counted, "host-counts")


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], max_bad: float = 0.5, level: float = 0.05, url: str = "url", bad: str = "bad",
    counts: DataFrame | None = None, known: Sequence[str] = SUFFIXES, broadcast_bytes: int | None = None,
) -> DataFrame:
    """Add host, path, rule, verdict and the host's reputation to every page.

    Labels are in the column bad, or were counted by host before (count_hosts). known: suffixes that names are registered under.
    """
    base = pages.drop(*[r for r in RESULTS if r != url])
    base = base.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    counts = count_hosts(base, bad) if counts is None else counts
    (own,) = unused(base, "_rules")
    reputation = host_reputation(counts.select("host", "n", "k"), level, known)
    hosts = durable(reputation.join(rules_by_host(counts.select("host"), rules), "host", "left").withColumnRenamed("rules", own), "judged-hosts")
    size = F.octet_length("host") + 24 + F.coalesce(F.aggregate(own, F.lit(0), lambda n, r: n + 2 * F.octet_length(r["text"]) + 40), F.lit(0))
    small, fits = small_or_plain(hosts, size, broadcast_bytes)
    found = base.join(small, "host", "left") if fits else spread_join(base, hosts, ["host"], hot_keys(counts, ["host"], "pages"), "left")
    fits_path = F.filter(F.coalesce(own, F.array()), lambda r: F.startswith(F.col("path"), r["path"]))
    by_method = F.when(F.col("bad_lower") > max_bad, "block").otherwise("allow")
    (rule,) = unused(found, "_rule")
    found = found.withColumn(rule, F.get(fits_path, F.lit(0)))
    found = found.withColumns({"rule": F.col(f"{rule}.text"), "verdict": F.coalesce(F.col(f"{rule}.action"), by_method)})
    return found.select(*[c for c in base.columns if c not in ("host", "path")], "host", "path", "rule", "verdict", "n_labelled", "bad_mean", "bad_lower")
