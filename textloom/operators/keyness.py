"""Keywords, collocates and concordance lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import cased_tokens, per_thousand
from textloom.operators.lexical import fully_ranked
from textloom.plans.scratch import settled


def g2(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Log-likelihood over the four cells of a 2 x 2 table of counts."""
    total = na + nb
    cells = [(a, na, a + b), (b, nb, a + b), (na - a, na, total - a - b), (nb - b, nb, total - a - b)]
    part = lambda o, row, col: F.when(o > 0, o * F.ln(o * total / (row * col))).otherwise(0.0)
    return 2 * sum((part(o.cast("double"), r, c) for o, r, c in cells[1:]), part(cells[0][0].cast("double"), cells[0][1], cells[0][2]))


def keyness(docs: DataFrame, target: str = "A", reference: str = "B", top: int | None = 500, tokens: Column | None = None) -> DataFrame:
    """Over-represented types of the target corpus with log-likelihood, Dice effect, normalised frequencies, ranges, competition rank."""
    listed = cased_tokens(F.col("text")) if tokens is None else tokens
    rows = docs.where(F.col("corpus").isin(target, reference)).select("corpus", "case_id", F.explode(listed).alias("term"))
    one = lambda c: (F.col("corpus") == c)
    per_case = rows.groupBy("term", "corpus", "case_id").agg(F.count("*").alias("n"))
    counts = per_case.groupBy("term").agg(
        F.sum(F.when(one(target), F.col("n")).otherwise(0)).alias("freq_tar"), F.sum(F.when(one(reference), F.col("n")).otherwise(0)).alias("freq_ref"),
        F.count(F.when(one(target), 1)).alias("range_tar"), F.count(F.when(one(reference), 1)).alias("range_ref"),
    )
    totals = rows.agg(F.count(F.when(one(target), 1)).alias("na"), F.count(F.when(one(reference), 1)).alias("nb"))
    met = counts.join(F.broadcast(totals))  # one row of two sums
    a, b, na, nb = (F.col(c).cast("double") for c in ("freq_tar", "freq_ref", "na", "nb"))
    made = met.where((na > 0) & (nb > 0) & (a / na > b / nb)).select(
        "term", "freq_tar", "freq_ref", "range_tar", "range_ref", F.round(1e6 * a / na, 3).alias("norm_tar"), F.round(1e6 * b / nb, 3).alias("norm_ref"),
        F.round(g2(a, b, na, nb), 6).alias("likelihood"), F.round(2 * a / (na + a + b), 6).alias("effect"),
    )
    if top:  # the rank is global, so only what can reach it goes to the one window
        made = settled(made, "keyness")
        least = made.orderBy(F.desc("likelihood")).limit(top).agg(F.min("likelihood").alias("least"))
        made = made.join(F.broadcast(least), F.col("likelihood") >= F.col("least")).drop("least")
        ranked = made.withColumn("rank", F.rank().over(Window.orderBy(F.desc("likelihood"))))
        return ranked.where(F.col("rank") <= top)
    rows = settled(fully_ranked(made.withColumn("_all", F.lit(0)), "_all", [F.desc("likelihood"), F.col("term")], "_row").drop("_all"), "keyness")
    first = rows.groupBy("likelihood").agg(F.min("_row").alias("rank"))  # ties share the first one's rank; half of all types may tie
    return rows.join(first, "likelihood").drop("_row").select(*made.columns, "rank")


def normalised_ranges(keywords: DataFrame, docs: DataFrame, target: str = "A", reference: str = "B") -> DataFrame:
    """``keywords`` with the shares of the corpora's cases that hold each term."""
    n = docs.groupBy().agg(*(F.count_distinct(F.when(F.col("corpus") == c, F.col("case_id"))).alias(a) for c, a in ((target, "_t"), (reference, "_r"))))
    share = lambda x, n: F.round(F.when(F.col(n) > 0, F.col(x) / F.col(n)), 6)
    return keywords.join(F.broadcast(n)).select(*keywords.columns, share("range_tar", "_t").alias("norm_range_tar"), share("range_ref", "_r").alias("norm_range_ref"))  # one row of two counts


def node_frequency(docs: DataFrame, node: str) -> DataFrame:
    """(corpus, n, tokens, per_1000) of a word."""
    words = docs.select("corpus", F.transform(cased_tokens(F.coalesce("text", F.lit(""))), lambda t: F.lower(t)).alias("w"))
    sums = words.groupBy("corpus").agg(F.sum(F.size(F.filter("w", lambda t: t == node))).alias("n"), F.sum(F.size("w")).alias("tokens"))
    return sums.select("corpus", "n", "tokens", per_thousand(F.col("n"), F.col("tokens")).alias("per_1000"))


def positions(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    return docs.select("corpus", "case_id", F.posexplode(F.transform(cased_tokens(F.col("text")), lambda t: F.lower(t)) if tokens is None else tokens).alias("pos", "term"))


def collocates(docs: DataFrame, node: str, span: int = 5, min_freq: int = 1) -> DataFrame:
    """Words within ``span`` tokens of the node, with MI and log-likelihood.

    A node looks at its neighbours in the text's own array, so nothing is joined on position."""
    words = docs.select("case_id", F.transform(cased_tokens(F.col("text")), lambda t: F.lower(t)).alias("w"))
    near = words.select("case_id", "w", F.posexplode("w").alias("pos", "node")).where(F.col("node") == node)
    left = F.transform(F.slice("w", F.greatest(F.col("pos") - span + 1, F.lit(1)), F.least(F.col("pos"), F.lit(span))), lambda t: F.struct(t.alias("term"), F.lit(1).alias("l")))
    right = F.transform(F.slice("w", F.col("pos") + 2, span), lambda t: F.struct(t.alias("term"), F.lit(0).alias("l")))
    hits = near.select("case_id", F.explode(F.concat(left, right)).alias("c")).groupBy("c.term").agg(F.count("*").alias("freq_lr"), F.sum("c.l").alias("freq_l"), F.count_distinct("case_id").alias("range"))
    all_ = words.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("f"))
    totals = words.agg(F.sum(F.size("w")).alias("n"), F.sum(F.size(F.filter("w", lambda t: t == node))).alias("fn"))
    met = hits.join(all_, "term").join(F.broadcast(totals)).where(F.col("freq_lr") >= min_freq)
    o, n, fn = (F.col(c).cast("double") for c in ("freq_lr", "n", "fn"))
    width = 2.0 * span
    scaled, r, t = width * F.col("f"), width * fn, width * n
    # cells from the margins R, C and T
    part = lambda x, row, col: F.when(x > 0, x * F.ln(x * t / (row * col))).otherwise(0.0)
    ll = 2 * (part(o, r, scaled) + part(r - o, r, t - scaled) + part(scaled - o, t - r, scaled) + part(t - r - scaled + o, t - r, t - scaled))
    return met.select("term", scaled.cast("long").alias("freq_scaled"), "freq_lr", "freq_l", (F.col("freq_lr") - F.col("freq_l")).alias("freq_r"), "range", F.round(F.log2(o * n / (fn * scaled)), 6).alias("mi"), F.round(ll, 6).alias("likelihood"))


def kwic(docs: DataFrame, phrase: list[str], width: int = 7, pattern: int = 1) -> DataFrame:
    """Concordance lines of a phrase, with the frequency of the first ``pattern`` words to the right as pattern frequency."""
    words = docs.select("corpus", "case_id", cased_tokens(F.col("text")).alias("w"))
    rows = words.select("corpus", "case_id", "w", F.posexplode("w").alias("pos", "t"))
    hit = F.lit(True)
    for k, word in enumerate(phrase):
        hit = hit & (F.lower(F.get("w", F.col("pos") + k)) == word)
    n = len(phrase)
    made = rows.where((F.lower("t") == phrase[0]) & F.coalesce(hit, F.lit(False))).select(
        "corpus", "case_id", "pos", F.array_join(F.slice("w", F.greatest(F.col("pos") - width + 1, F.lit(1)), F.least(F.col("pos"), F.lit(width))), " ").alias("left_context"),
        F.array_join(F.slice("w", F.col("pos") + 1, n), " ").alias("hit"), F.array_join(F.slice("w", F.col("pos") + 1 + n, width), " ").alias("right_context"), F.lower(F.array_join(F.slice("w", F.col("pos") + 1 + n, pattern), " ")).alias("_next"),
    )
    kpf = made.groupBy("_next").agg(F.count("*").alias("kpf"))
    return made.join(kpf, "_next").select("corpus", "case_id", "pos", "kpf", "left_context", "hit", "right_context")
