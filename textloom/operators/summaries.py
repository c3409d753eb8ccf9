"""Summaries of linked entities, depths and compared cases: the data behind reports and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.lexical import hedge_density, phrase_rate


def coverage(entities: DataFrame) -> DataFrame:
    """entities(corpus, entity, concept, depth): types, those with a concept and with a depth, and their shares."""
    g = entities.groupBy("corpus").agg(F.count("*").alias("types"), F.count("concept").alias("with_concept"), F.count("depth").alias("with_depth"))
    share = lambda c: F.round(100.0 * F.col(c) / F.col("types"), 2)
    return g.select("*", share("with_concept").alias("pct_concept"), share("with_depth").alias("pct_depth"))


def mean_depths(entities: DataFrame) -> DataFrame:
    """The mean over types with a depth, and over their mentions."""
    known = entities.where("depth is not null")
    return known.groupBy("corpus").agg(F.count("*").alias("n"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.sum("frequency").alias("mentions"), F.round(F.sum(F.col("depth") * F.col("frequency")) / F.sum("frequency"), 6).alias("weighted_depth"))


def depth_extremes(entities: DataFrame, k: int = 5) -> DataFrame:
    """(corpus, end, rank, entity, depth): the k deepest and the k shallowest entities."""
    known = entities.where("depth is not null")
    one = lambda end, order: known.withColumn("rank", F.row_number().over(Window.partitionBy("corpus").orderBy(order, "entity"))).where(F.col("rank") <= k).select("corpus", F.lit(end).alias("end"), "rank", "entity", "depth")
    return one("deepest", F.desc("depth")).unionByName(one("shallowest", F.asc("depth")))


def diff_summary(pairs: DataFrame) -> DataFrame:
    d = F.col("depth_diff")
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_diff"), F.count_if(d < 0).alias("n_a_deeper"), F.count_if(d > 0).alias("n_b_deeper"), F.count_if(d == 0).alias("n_equal"))


def mean_composition(cases: DataFrame) -> DataFrame:
    """Mean parts A only, shared and B only of the cases' concept sets, as shares of their sum."""
    m = cases.agg(*(F.avg(c).alias(c) for c in ("a_only", "intersection", "b_only")))
    total = F.col("a_only") + F.col("intersection") + F.col("b_only")
    return m.select(*(F.round(F.when(total > 0, F.col(c) / total), 6).alias(f"share_{c}") for c in ("a_only", "intersection", "b_only")))


def top_linked(entities: DataFrame, k: int = 20, min_depth: int = 0) -> DataFrame:
    """The most frequent entities of each corpus with a concept at least so deep."""
    known = entities.where(F.col("concept").isNotNull() & (F.col("depth") >= min_depth))
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("frequency"), "entity"))
    return known.withColumn("rank", rank).where(F.col("rank") <= k).select("corpus", "rank", "entity", "concept", "depth", "frequency")


def node_weights(entities: DataFrame) -> DataFrame:
    """(concept, weight, sides): the largest frequency of a concept's entities, and the corpora that hold it."""
    known = entities.where("concept is not null")
    return known.groupBy("concept").agg(F.max("frequency").alias("weight"), F.array_join(F.sort_array(F.collect_set("corpus")), ",").alias("sides"))


def term_depths(ranked: DataFrame, terms: DataFrame, depth: DataFrame, top: int = 20) -> DataFrame:
    """ranked(corpus, rank, term), terms(term, concept): the first terms of each corpus with concept and depth, unmatched ones too."""
    met = ranked.where(F.col("rank") <= top).join(terms, "term", "left")
    return met.join(depth.withColumnRenamed("c", "concept"), "concept", "left").select("term", "corpus", "concept", "depth")


def subset_rates(docs: DataFrame, cases: DataFrame, lexicon: list[str], pattern: str) -> DataFrame:
    """Rates of hedges and of a phrase of every corpus on the listed cases only."""
    own = docs.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    hedges = hedge_density(own, lexicon).select("corpus", F.col("per_1000_tokens").alias("hedge_per_1000"))
    return hedges.join(phrase_rate(own, pattern).select("corpus", F.col("per_1000").alias("phrase_per_1000")), "corpus")


def side_deltas(rows: DataFrame, base: str, other: str, columns: list[str]) -> DataFrame:
    """rows(corpus, columns) -> one row with ``delta_`` of each column: the value of ``other`` less that of ``base``; null without one of them."""
    of = lambda c, side: F.max(F.when(F.col("corpus") == side, F.col(c)))
    return rows.agg(*(F.round(of(c, other) - of(c, base), 6).alias(f"delta_{c}") for c in columns))
