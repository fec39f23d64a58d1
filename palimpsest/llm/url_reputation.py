"""URL filter by the reputation of hosts: empirical Bayes from suffix over registered domain to host.

Labelled outcomes (bad or not) are counted by host; counts of domains and suffixes are sums of those.  At each level the rate
of a unit is shrunk towards the rate of its parent by a beta-binomial prior whose strength comes from the spread of the rates
at that level (method of moments), so a host with few labels follows its domain, and a domain with few follows its suffix.  A
host is blocked if the lower bound of its posterior rate of bad pages is over a threshold.  Explicit rules come first.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small

#: Labels below a country's under which names are registered, and services that give names to others.
SECOND_LEVEL = ("ac", "co", "com", "ed", "edu", "gob", "gouv", "gov", "go", "govt", "id", "ltd", "me", "mil", "ne", "net", "nic", "nom", "or", "org", "plc", "sch")
SERVICES = (
    "appspot.com", "blogspot.com", "cloudfront.net", "firebaseapp.com", "github.io", "gitlab.io", "herokuapp.com", "myshopify.com", "netlify.app", "pages.dev", "readthedocs.io", "tumblr.com", "vercel.app", "web.app", "weebly.com",
    "wixsite.com", "wordpress.com",
)
#: The bounds between which a prior's strength is kept (in pages).
STRENGTH = (1.0, 1000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lowered.  Path: then up to ``?`` or ``#``.  Else both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does.  A rule is ``host/path-prefix``."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # the longest is asked first; block wins a tie
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(kind)).otherwise(verdict)
    return which, verdict


def _plain(host: Column) -> Column:
    """A host without its port, user and dots at the end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.+$", "")


def suffix_rules(spark: SparkSession, lines: Iterable[str] = SERVICES) -> DataFrame:
    """``(name, kind, labels)`` from rules as public suffix lists write them: ``x.y``; ``*.x``: any name below x; ``!x.y``: but not that."""
    rows = []
    for line in lines:
        rule = line.strip().lower()
        if rule and not rule.startswith("//"):
            kind = {"*": 1, "!": 2}.get(rule[0], 0)
            name = rule.removeprefix("*.").removeprefix("!")
            rows.append((name, kind, name.count(".") + 1))
    return spark.createDataFrame(rows, "name string, kind int, labels int")


def with_suffix(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` with ``suffix``: by the longest rule that fits, an exception before any; else the last two labels where names are registered
    below two, else the last one.  A host of numbers is its own."""
    most = rules.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]
    labels = F.split(_plain(F.col("host")), r"\.")
    last = lambda n: F.array_join(F.slice("l", F.greatest(F.size("l") - n + 1, F.lit(1)), n), ".")
    df = hosts.withColumn("l", labels)
    if most:
        each = df.select("host", "l", F.explode(F.sequence(F.lit(1), F.least(F.size("l"), F.lit(most)))).alias("n")).select("host", F.size("l").alias("size"), "n", last(F.col("n")).alias("name"))
        fits = each.join(small(rules.select("name", "kind")), "name").groupBy(F.col("host").alias("__of")).agg(
            F.min(F.when(F.col("kind") == 2, F.col("n") - 1)).alias("but"), F.max(F.when(F.col("kind") == 0, F.col("n")).when((F.col("kind") == 1) & (F.col("size") > F.col("n")), F.col("n") + 1)).alias("long")
        )
        df = df.join(fits, F.col("host").eqNullSafe(F.col("__of")), "left").withColumn("listed", F.coalesce("but", "long")).drop("__of", "but", "long")
    else:
        df = df.withColumn("listed", F.lit(None).cast("int"))
    country = (F.length(F.element_at("l", -1)) == 2) & (F.size("l") > 1) & F.coalesce(F.get("l", F.size("l") - 2).isin(*SECOND_LEVEL), F.lit(False))
    n = F.coalesce("listed", F.when(country, 2).otherwise(1))
    return df.withColumn("suffix", F.when(_plain(F.col("host")).rlike(r"^[0-9.]+$"), _plain(F.col("host"))).otherwise(last(n))).drop("l", "listed")


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    plain = _plain(host)
    head = F.substring(plain, F.lit(1), F.greatest(F.length(plain) - F.length(suffix) - 1, F.lit(0)))
    label = F.regexp_extract(head, r"([^.]*)$", 1)
    return F.when(label == "", suffix).otherwise(F.concat(label, F.lit("."), suffix))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges quickly."""
    x, a, b = (np.asarray(v, np.float64) for v in (x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (a + b) * y / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        step = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 + step * d
        c = 1 + step / c
        c, d = np.where(np.abs(c) < tiny, tiny, c), 1 / np.where(np.abs(d) < tiny, tiny, d)
        out *= c * d
        step = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        c = 1 + step / c
        c, d = np.where(np.abs(c) < tiny, tiny, c), 1 / np.where(np.abs(d) < tiny, tiny, d)
        out *= c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((gamma(a + b) - gamma(a) - gamma(b)).astype(np.float64) + a * np.log(y) + b * np.log1p(-y)) / a
    value = np.where(inside, front * out, np.where(x <= 0, 0.0, 1.0))
    return np.where(turn, 1 - value, value)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rate below which a share ``p`` of Beta(a, b) lies, by bisection."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(50):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _bounds(p: float):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in ("a", "b"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beta_quantile(p, a, b)), pa.array(beta_quantile(1 - p, a, b))], [*batch.schema.names, "low", "high"])

    return run


def _strength(units: DataFrame, prior: str) -> DataFrame:
    """One row: the strength s of Beta(prior * s, (1 - prior) * s) by the method of moments over units with two labels or more.

    With r the rate of a unit of n labels, E[(r - m)^2] = m (1 - m) (1/n + (1 - 1/n) / (s + 1)).
    """
    m, n, r = F.col(prior), F.col("n"), F.col("bad") / F.col("n")
    use = units.where((n >= 2) & (m > 0) & (m < 1))
    spread = F.sum(n * (F.pow(r - m, 2) - m * (1 - m) / n))
    room = F.sum(n * m * (1 - m) * (1 - 1 / n))
    rho = F.greatest(F.lit(1e-6), spread / F.greatest(room, F.lit(1e-12)))
    s = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), 1 / rho - 1))
    return use.agg(F.coalesce(s, F.lit(STRENGTH[1])).alias("s"))


def reputation(hosts: DataFrame, rules: DataFrame | None = None, p: float = 0.05) -> DataFrame:
    """From ``(host, n, bad)``, one row for each host, to the posterior: ``(host, domain, suffix, n, bad, rate, low, high)``.

    low and high are the quantiles ``p`` and 1 - p of the beta posterior, exact for few labels too.  rules: see :func:`suffix_rules`.
    """
    hosts = with_suffix(hosts, suffix_rules(hosts.sparkSession) if rules is None else rules)
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = saved(hosts, "hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("prior"))
    shrunk = (F.col("bad") + F.col("prior") * F.col("s")) / (F.col("n") + F.col("s"))
    level = saved(suffixes.crossJoin(F.broadcast(total)), "suffixes")  # one row
    level = level.crossJoin(F.broadcast(_strength(level, "prior"))).select("suffix", shrunk.alias("prior"))
    for name, units in (("domain", domains), ("host", hosts)):
        level = saved(units.join(level, "suffix" if name == "domain" else "domain"), name)
        level = level.crossJoin(F.broadcast(_strength(level, "prior")))
        if name == "domain":
            level = level.select("domain", shrunk.alias("prior"))
    a, b = F.col("bad") + F.col("prior") * F.col("s"), F.col("n") - F.col("bad") + (1 - F.col("prior")) * F.col("s")
    level = level.select("host", "domain", "suffix", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), (a / (a + b)).alias("rate"), a.alias("a"), b.alias("b"))
    kinds = "host string, domain string, suffix string, n long, bad long, rate double, a double, b double, low double, high double"
    return level.mapInArrow(_bounds(p), kinds).drop("a", "b")


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = (), threshold: float = 0.5, page_id: str = "page_id", url: str = "url", outcome_id: str = "page_id", bad: str = "bad",
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, rate, low, high)`` for each row of ``pages``.

    outcomes: labelled pages, ``bad`` true or false; rows with a null in either column don't count, and a page labelled more
    than once counts with each label.  A null url has an empty host and path, fits no rule, and is judged as the host ''.
    Hosts without labels are judged by what their domain, suffix or all labels say, since every host of ``pages`` is a unit.
    Repeated rows and null ids stay as they are; extra columns are not read; without labels everything is allowed; of rules equally
    long a block wins.  suffixes: what :func:`suffix_rules` makes of a list of public suffixes, for a list other than the short one here.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = outcomes.select(F.col(outcome_id).alias("page_id"), F.col(bad).cast("int").alias("bad")).where(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
    # Labels are summed by page first, so that the join adds no rows and the counts by host are exact.
    labels = labels.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = seen.join(labels, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = reputation(hosts, suffixes).select("host", "rate", "low", "high")
    rule, verdict = rule_of(F.col("host"), F.col("path"), list(rules))
    by_rate = F.when(F.col("low") > threshold, "block").otherwise("allow")
    return seen.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_rate).alias("verdict"), "rate", "low", "high")
