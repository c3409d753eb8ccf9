"""URL filters: host reputation by empirical Bayes, under explicit allow and block rules.

Labelled page outcomes are counted per host and shrunk through a chain of beta-binomial priors
(all pages -> public suffix -> registered domain -> host). The concentration of each level is
estimated by moments from the spread of its children. A page is blocked where the upper posterior
bound of its host's share of good pages stays under a threshold. Rules come before the method.

Defined results: a null url, or one without ``://``, has an empty host and path and can match no
rule; null outcomes don't count; repeated pages each get a row; an empty label table leaves the
prior mean 0.5 with the least certainty, which blocks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, settle

#: Suffixes of two labels under which names are registered (an excerpt of public knowledge; a parameter).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the url's path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column, two_label=TWO_LABEL_SUFFIXES) -> Column:
    parts = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), n), ".")
    return F.when(last(2).isin(*two_label), last(3)).otherwise(last(2))


def public_suffix(host: Column, two_label=TWO_LABEL_SUFFIXES) -> Column:
    parts = F.split(host, r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    return F.when(two.isin(*two_label), two).otherwise(F.element_at(parts, -1))


def match_rule(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """The name or action of the longest rule that fits (of equals the first given); null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):  # the last one laid on top is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def _concentration(children: DataFrame) -> float:
    """Beta-binomial concentration from (n, k, prior): moment estimate of the intra-class correlation."""
    m = F.col("prior")
    v = m * (1 - m)
    row = children.agg(
        F.sum((F.col("k") - F.col("n") * m) ** 2).alias("spread"), F.sum(F.col("n") * v).alias("binomial"), F.sum(F.col("n") * (F.col("n") - 1) * v).alias("pairs")
    ).first()
    if not row["pairs"]:
        return 2.0
    rho = min(0.5, max(1e-4, (row["spread"] - row["binomial"]) / row["pairs"]))
    return (1 - rho) / rho


def reputations(outcomes: DataFrame, z: float = 1.645, two_label=TWO_LABEL_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """outcomes(host, good 0/1) -> (host, n, k, mean, upper) of every labelled host, (domain, upper) and (suffix, upper)
    for a host without labels in a known domain or suffix, and the bound of any other host.

    A level without labels has n = 0: its share spreads about its parent's mean by its concentration c, which leaves c / (c + 1) of mean (1 - mean).
    Counting is the only pass over the pages; map-side combining leaves one row for each host and task."""
    hosts = outcomes.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    hosts = hosts.withColumns({"domain": registered_domain(F.col("host"), two_label), "suffix": public_suffix(F.col("host"), two_label)})
    hosts = settle(hosts, "host-counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    base = (total[1] + 0.5) / (total[0] + 1) if total[0] else 0.5

    def shrink(children: DataFrame) -> tuple[DataFrame, float]:
        c = _concentration(children)
        return children.withColumn("mean", (F.col("k") + c * F.col("prior")) / (F.col("n") + c)), c

    suffixes, c_suffix = shrink(suffixes.withColumn("prior", F.lit(base)))
    domains, c_domain = shrink(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"))
    hosts, c = shrink(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + c + 1))

    def unseen(mean: Column, *levels: float) -> Column:
        left = 1.0
        for level in levels:
            left *= level / (level + 1)
        return mean + z * F.sqrt(mean * (1 - mean) * (1 - left))

    left = c / (c + 1) * c_domain / (c_domain + 1) * c_suffix / (c_suffix + 1)
    return (
        hosts.select("host", "n", "k", "mean", (F.col("mean") + z * sd).alias("upper")),
        domains.select("domain", unseen(F.col("mean"), c).alias("upper")),
        suffixes.select("suffix", unseen(F.col("mean"), c, c_domain).alias("upper")),
        base + z * (base * (1 - base) * (1 - left)) ** 0.5,
    )


def host_reputation(outcomes: DataFrame, z: float = 1.645, two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """outcomes(host, good 0/1) -> (host, n, k, mean, upper): the posterior of every labelled host."""
    return reputations(outcomes, z, two_label)[0]


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col="page_id", url_col="url", min_good: float = 0.5, z: float = 1.645, two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """pages(id, url), outcomes(id, good 0/1) -> (id, host, path, rule, verdict, reputation).

    The reputation is the upper posterior bound; a host without labelled pages has that of a new host of its registered
    domain, else of its suffix, else of all. The empty host has none and is allowed. Of repeated outcomes of an id the worst counts.
    The hot host is counted with map-side combining; the join of pages with settled host rows is one that Spark
    can split where a host holds much of the pages."""
    split = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    marks = outcomes.select(F.col(id_col).alias("_id"), F.col("good").cast("int").alias("good")).where("_id is not null and good is not null").groupBy("_id").agg(F.min("good").alias("good"))
    hosts, domains, suffixes, other = reputations(split.join(marks, "_id").select("host", "good"), z, two_label)
    named = split.select("host").where("host <> ''").distinct()
    named = named.select("host", registered_domain(F.col("host"), two_label).alias("domain"), public_suffix(F.col("host"), two_label).alias("suffix"))
    h, d, s = hosts.select("host", F.col("upper").alias("of_host")), domains.withColumnRenamed("upper", "of_domain"), suffixes.withColumnRenamed("upper", "of_suffix")
    known = named.join(h, "host", "left").join(d, "domain", "left").join(s, "suffix", "left")
    known = known.select("host", F.coalesce("of_host", "of_domain", "of_suffix", F.lit(other)).alias("upper"))
    reputation = settle(known.unionByName(hosts.where("host = ''").select("host", "upper")), "host-reputation")
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(match_rule(host, path, rules, "action"), F.when(F.col("upper") < min_good, "block").otherwise("allow"))
    return split.join(reputation, "host", "left").select(
        F.col("_id").alias(id_col), "host", "path", match_rule(host, path, rules, "name").alias("rule"), verdict.alias("verdict"), F.round("upper", 6).alias("reputation")
    )
