"""Quality classifier by hierarchical empirical Bayes.

A linear classifier gives each document's own evidence. Labelled outcomes are counted per host and per path of a host and
shrunk: paths towards their host, hosts towards the global share, each level by a concentration estimated from the
spread of its groups, so that sparse sites stay near what is known above them. A document's log odds are its own
evidence plus the log odds by which its path's posterior differs from the global share.

Texts are only mapped over; what is grouped and joined are ids, hosts and counts.

Defined results: a null host or path is the empty one; null and empty texts have no evidence of their own but the
classifier's bias; unlabelled sites get their parent's posterior; without labels all probabilities are a half;
repeated rows are scored each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import settle
from textloom.llm.text_features import fit_chain, with_logits
from textloom.llm.url_filter import _concentration


def site_posteriors(outcomes: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """outcomes(host, path, good) -> the global share, hosts(host, host_post), paths(host, path, path_post)."""
    paths = settle(outcomes.where("good is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("k")), "path-counts")
    total = paths.agg(F.sum("n"), F.sum("k")).first()
    base = (total[1] + 0.5) / (total[0] + 1) if total[0] else 0.5

    def shrink(rows: DataFrame, name: str) -> DataFrame:
        c = _concentration(rows)
        return rows.withColumn(name, (F.col("k") + c * F.col("prior")) / (F.col("n") + c)).drop("n", "k", "prior")

    hosts = settle(shrink(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(base)), "host_post"), "host-posteriors")
    paths = settle(shrink(paths.join(hosts.select("host", F.col("host_post").alias("prior")), "host"), "path_post"), "path-posteriors")
    return base, hosts, paths


def score_quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", host_col="source", path_col="lang", good_col="good", max_rows: int = 20_000) -> DataFrame:
    """(id, host, path, p_document, host_posterior, path_posterior, p_quality, keep) of every document.

    Of several labels of an id the worst counts, for the classifier and for the sites."""
    chain = fit_chain(docs, labels.select(id_col, good_col), [good_col], id_col, text_col, max_rows, repeated=F.min)
    site = [F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path")]
    marks = labels.select(id_col, F.col(good_col).cast("int").alias("good")).dropna().groupBy(id_col).agg(F.min("good").alias("good"))
    base, hosts, paths = site_posteriors(docs.select(id_col, *site).join(marks, id_col).select("host", "path", "good"))
    scored = with_logits(docs.select(F.col(id_col).alias(id_col), *site, F.col(text_col).alias("text")), chain).select(f"row.{id_col}", "row.host", "row.path", F.col("logits")[0].alias("logit"))
    met = scored.join(hosts, "host", "left").join(paths, ["host", "path"], "left")
    host_post = F.coalesce("host_post", F.lit(base))
    path_post = F.coalesce("path_post", host_post)
    odds = F.col("logit") + F.log(path_post / (1 - path_post)) - F.log(F.lit(base / (1 - base)))
    p = 1 / (1 + F.exp(-odds))
    return met.select(id_col, "host", "path", F.round(1 / (1 + F.exp(-F.col("logit"))), 6).alias("p_document"), F.round(host_post, 6).alias("host_posterior"), F.round(path_post, 6).alias("path_posterior"), F.round(p, 6).alias("p_quality"), (p >= 0.5).alias("keep"))
