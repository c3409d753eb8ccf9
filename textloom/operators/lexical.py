"""Lexical statistics of corpora docs(corpus, case_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicons
from textloom.functions.text import letter_tokens, per_thousand, phrase_count, round4, stem_tokens, term_tokens, vector_tokens, word_count
from textloom.plans.scratch import settled


def terms(docs: DataFrame, tokens: Column | None = None, stop_words=()) -> DataFrame:
    """(corpus, case_id, term), one row for each token that is no stop word."""
    listed = term_tokens(F.col("text")) if tokens is None else tokens
    rows = docs.select("corpus", "case_id", F.explode(listed).alias("term"))
    return rows.where(~F.col("term").isin(*stop_words)) if stop_words else rows


def term_frequencies(docs: DataFrame, stop_words=(), top: int | None = None, tokens: Column | None = None) -> DataFrame:
    """(corpus, rank, term, frequency) by falling frequency, then term. Counting combines on the map side."""
    counts = terms(docs, tokens, stop_words).groupBy("corpus", "term").agg(F.count("*").alias("frequency"))
    order = [F.desc("frequency"), F.asc("term")]
    if top:  # a limit that Spark applies to each task before it shuffles
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("corpus").orderBy(*order))).where(F.col("rank") <= top)
    else:
        ranked = fully_ranked(counts, "corpus", order, "rank")
    return ranked.select("corpus", "rank", "term", "frequency")


def fully_ranked(rows: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """The rank of every row of large groups: sorted ranges are numbered apart, after the number of rows in the ranges before."""
    ranged = settled(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = ranged.join(F.broadcast(sizes.select(group, "_range", before.alias("_before"))), [group, "_range"])  # a row for each range
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return met.withColumn(out, (F.col("_before") + own).cast("int")).drop("_range", "_before")


def zipf_series(docs: DataFrame, stop_words=()) -> DataFrame:
    ranked = term_frequencies(docs, stop_words)
    return ranked.select("corpus", "rank", "term", "frequency", F.round(F.ln("rank"), 6).alias("ln_rank"), F.round(F.ln("frequency"), 6).alias("ln_frequency"))


def known_term_frequencies(docs: DataFrame, dictionary: DataFrame, top: int = 50) -> DataFrame:
    """Frequencies of the terms in dictionary(term) only, restricted before counting."""
    rows = terms(docs).join(dictionary.select(F.lower("term").alias("term")).distinct(), "term", "left_semi")
    counts = rows.groupBy("corpus", "term").agg(F.count("*").alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("frequency"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("corpus", "rank", "term", "frequency")


def hedge_counts(docs: DataFrame, lexicon=lexicons.HEDGES) -> DataFrame:
    """docs and (hits, tokens) of each text; nothing is exploded or shuffled."""
    words = letter_tokens(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("_w", words).withColumns({"hits": F.size(F.filter("_w", lambda w: w.isin(*lexicon))).cast("long"), "tokens": F.size("_w").cast("long")}).drop("_w")


def hedge_density(docs: DataFrame, lexicon=lexicons.HEDGES) -> DataFrame:
    """(corpus, hedge_hits, total_tokens, per_1000_tokens), pooled."""
    sums = hedge_counts(docs, lexicon).groupBy("corpus").agg(F.sum("hits").alias("hedge_hits"), F.sum("tokens").alias("total_tokens"))
    return sums.select("corpus", "hedge_hits", "total_tokens", per_thousand(F.col("hedge_hits"), F.col("total_tokens")).alias("per_1000_tokens"))


def paired(docs: DataFrame) -> DataFrame:
    """(case_id, text_a, text_b) of the cases with both sides present and not blank: one shuffle, no self-join."""
    side = lambda c: F.max(F.when((F.col("corpus") == c) & (F.trim(F.regexp_replace("text", r"\s", "")) != ""), F.col("text")))
    return docs.groupBy("case_id").agg(side("A").alias("text_a"), side("B").alias("text_b")).where("text_a is not null and text_b is not null")


def hedge_per_case(docs: DataFrame, lexicon=lexicons.HEDGES) -> DataFrame:
    rows = hedge_counts(docs.where(F.regexp_replace("text", r"\s", "") != ""), lexicon).groupBy("case_id").pivot("corpus", ["A", "B"]).agg(F.max("hits").alias("h"), F.max("tokens").alias("t"))
    rows = rows.where("A_t is not null and B_t is not null")
    raw = lambda s: F.when(F.col(f"{s}_t") > 0, 1000.0 * F.col(f"{s}_h") / F.col(f"{s}_t")).otherwise(0.0)
    return rows.select(
        "case_id", F.col("A_h").alias("a_hedge_hits"), F.col("A_t").alias("a_tokens"), round4(raw("A")).alias("a_per_1000"),
        F.col("B_h").alias("b_hedge_hits"), F.col("B_t").alias("b_tokens"), round4(raw("B")).alias("b_per_1000"), round4(raw("B") - raw("A")).alias("delta_b_minus_a"),
    )


def classify_area(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """docs(case_id, text), lexicon(area, term) -> (case_id, area): the area with the most distinct words, if two at least.

    Ties are mixed; less is general. The lexicon is joined by term, so it may be large; hot terms split in the join."""
    words = docs.select("case_id", F.explode(stem_tokens(F.col("text"))).alias("term")).distinct()
    scores = words.join(lexicon.select("area", "term").distinct(), "term").groupBy("case_id", "area").agg(F.count("*").alias("n"))
    best = scores.groupBy("case_id").agg(F.max(F.struct("n", "area")).alias("top"), F.sort_array(F.collect_list("n"), asc=False).alias("all"))
    area = F.when(F.col("top.n") < 2, lexicons.GENERAL).when(F.get("all", F.lit(1)) == F.col("top.n"), lexicons.MIXED).otherwise(F.col("top.area"))
    return docs.select("case_id").distinct().join(best.select("case_id", area.alias("area")), "case_id", "left").select("case_id", F.coalesce("area", F.lit(lexicons.GENERAL)).alias("area"))


def hedge_by_area(per_case: DataFrame, areas: DataFrame, min_cases: int = 1) -> DataFrame:
    rows = per_case.join(areas, "case_id").groupBy("area").agg(
        F.count("*").alias("n_cases"), round4(F.avg("a_per_1000")).alias("a_mean_per_1000"), round4(F.avg("b_per_1000")).alias("b_mean_per_1000"), round4(F.avg("delta_b_minus_a")).alias("mean_delta_b_minus_a"),
        F.sum("a_tokens").alias("a_tokens_sum"), F.sum("b_tokens").alias("b_tokens_sum"),
    )
    return rows.where(F.col("n_cases") >= min_cases)


def macro_means(per_case: DataFrame) -> DataFrame:
    """One row: the means over cases of the sides' rates and of their difference."""
    return per_case.agg(F.count("*").alias("n_cases"), *(round4(F.avg(c)).alias(f"mean_{c}") for c in ("a_per_1000", "b_per_1000", "delta_b_minus_a")))


def phrase_rate(docs: DataFrame, pattern: str = r"\bmost\s+likely\b") -> DataFrame:
    sums = docs.select("corpus", phrase_count(F.coalesce("text", F.lit("")), pattern).alias("h"), F.size(letter_tokens(F.coalesce("text", F.lit("")))).alias("t")).groupBy("corpus").agg(F.sum("h").alias("hits"), F.sum("t").alias("tokens"))
    return sums.select("corpus", "hits", "tokens", per_thousand(F.col("hits"), F.col("tokens")).alias("per_1000"))


def length_stats(docs: DataFrame) -> DataFrame:
    n = docs.select("corpus", word_count(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return n.groupBy("corpus").agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.min("n").alias("min"), F.max("n").alias("max"), F.sum("n").alias("total"))


def length_delta(docs: DataFrame) -> DataFrame:
    d = paired(docs).select((word_count(F.col("text_b")) - word_count(F.col("text_a"))).alias("d"))
    return d.agg(F.count("*").alias("n_pairs"), F.round(F.avg("d"), 6).alias("mean_delta"), F.median("d").alias("median_delta"))


def tfidf_gap(docs: DataFrame) -> DataFrame:
    """(term, mean_a, mean_b, gap): means over all documents of a side of the L2-normalised tf * (ln((1+N)/(1+df)) + 1)."""
    tf = docs.select("corpus", "case_id", F.explode(vector_tokens(F.col("text"))).alias("term")).groupBy("corpus", "case_id", "term").agg(F.count("*").alias("tf"))
    n = docs.groupBy("corpus").agg(F.count("*").alias("n"))
    df = tf.groupBy("corpus", "term").agg(F.count("*").alias("df")).join(F.broadcast(n), "corpus")
    w = tf.join(df, ["corpus", "term"]).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("corpus", "case_id"))))
    means = w.groupBy("term").pivot("corpus", ["A", "B"]).agg(F.sum(F.col("w") / F.col("n"))).where("A is not null and B is not null")
    return means.select("term", F.round("A", 6).alias("mean_a"), F.round("B", 6).alias("mean_b"), F.round(F.col("A") - F.col("B"), 6).alias("gap"))


def top_gaps(gaps: DataFrame, k: int = 10) -> DataFrame:
    """The k largest gaps either way."""
    a = gaps.orderBy(F.desc("gap"), "term").limit(k).withColumn("side", F.lit("A"))
    return a.unionByName(gaps.orderBy("gap", "term").limit(k).withColumn("side", F.lit("B"))).select("side", "term", "gap")
