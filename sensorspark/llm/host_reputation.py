"""URL filters: allow/block rules and empirical-Bayes host reputation.

Native: DataFrame expressions only.  Outcomes of labelled pages are counted
per host; each level's bad rate is shrunk towards its parent (host ->
registered domain -> public suffix -> all pages) through a beta-binomial prior
whose concentration is fitted by the method of moments from the spread of the
children around their parents.  A host is blocked when the lower bound of its
posterior bad rate lies above ``max_bad``.

Cases: a NULL url or one without ``://`` has empty host and path and is judged
as the host ``''``; repeated pages and labels count once per row; labels with
a NULL quality are no outcome and a NULL ``toxic`` counts as 0; with no
outcome at all every page without a rule is allowed; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import ascii_lower

#: Public suffixes of two labels (fixed values); any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp",
                      "co.nz", "com.br", "co.in", "com.cn", "co.za", "com.mx", "com.tr")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host after the first ``://`` up to ``/ ? #``,
    A-Z lower-cased; path from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; of two as long, the
    longer host, then the first by name.  A rule fits its host and all
    subdomains if the path starts with the rule's path."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host (a host of one label is its own domain)."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(list(TWO_LABEL_SUFFIXES))
    domain = F.when(long, F.substring_index(host, ".", -3)).otherwise(two)
    suffix = F.when(long, two).otherwise(F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise(""))
    return domain, suffix


def _spread(level: DataFrame, parent: str, mean: float) -> float:
    """Concentration of the beta prior of the children of ``parent``: from the
    weighted squared distance of their rates to the parent's rate, less what
    binomial noise alone makes."""
    if not 0.0 < mean < 1.0:
        return 1000.0
    p = level.filter("n > 0").groupBy(parent).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("g"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2"))
    r = p.agg(F.sum(F.col("k2") - F.col("k") * F.col("k") / F.col("n")).alias("ss"),
              F.sum(F.col("g") - 1).alias("df"), F.sum(F.col("n") - F.col("n2") / F.col("n")).alias("w")).first()
    if r.ss is None or not r.w or r.w - r.df <= 0:
        return 1000.0
    rho = (r.ss / (mean * (1 - mean)) - r.df) / (r.w - r.df)
    return 1.0 / min(max(rho, 0.001), 0.5) - 1.0       # the prior weighs 1 to 999 outcomes


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host of ``pages``: n labelled outcomes, k bad ones, the
    posterior mean ``bad_rate`` and its lower bound ``bad_lower``.

    Outcomes are the ``labels`` rows whose doc_id is the page_id; bad is
    quality 0 or toxic 1.  The counts are pre-aggregated per host before
    anything else, so a host with a third of all pages is one row here.
    """
    out = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1), 1).otherwise(0)).alias("_k"))
    host, _ = url_parts(F.col("url"))
    hosts = (pages.select("page_id", host.alias("host"))
             .join(out, F.col("page_id") == F.col("_id"), "left")
             .groupBy("host").agg(F.sum(F.coalesce("_n", F.lit(0))).cast("double").alias("n"),
                                  F.sum(F.coalesce("_k", F.lit(0))).cast("double").alias("k")))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = total.k / total.n if total.n else 0.0
    m_host, m_domain = _spread(hosts, "domain", mean), _spread(domains, "suffix", mean)
    m_suffix = _spread(suffixes.withColumn("all", F.lit(1)), "all", mean)

    shrunk = lambda m, prior: (F.col("k") + F.lit(m) * prior) / (F.col("n") + F.lit(m))
    s = suffixes.select("suffix", shrunk(m_suffix, F.lit(mean)).alias("suffix_rate"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrunk(m_domain, F.col("suffix_rate")).alias("domain_rate"))
    h = hosts.join(d, ["domain", "suffix"]).withColumns({
        "a": F.col("k") + F.lit(m_host) * F.col("domain_rate"),
        "b": F.col("n") - F.col("k") + F.lit(m_host) * (1 - F.col("domain_rate"))})
    rate = F.col("a") / (F.col("a") + F.col("b"))
    return h.select("host", "domain", "suffix", "n", "k", rate.alias("bad_rate"),
                    (rate - F.lit(z) * F.sqrt(rate * (1 - rate) / (F.col("a") + F.col("b") + 1))).alias("bad_lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules, max_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior for every page.

    The verdict is that of the longest fitting rule, else ``block`` when the
    host's bad rate exceeds ``max_bad`` with the posterior bound ``z``.
    """
    rep = host_reputation(pages, labels, z).select("host", "n", "k", "bad_rate", "bad_lower")
    host, path = url_parts(F.col("url"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    p = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "_v": verdict})
    own = F.when(F.col("bad_lower") > F.lit(max_bad), F.lit("block")).otherwise(F.lit("allow"))
    return p.join(rep, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_v", own).alias("verdict"), "bad_rate", "bad_lower")
