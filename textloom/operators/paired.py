"""Comparison of two sides case by case: mentions(case_id, side, entity, n, concept, depth)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.linking import with_pair_contexts
from textloom.plans.scratch import settled, spread


def concept_sets(mentions: DataFrame) -> DataFrame:
    """One row for each case: types, mentions, concepts, overlap, Jaccard, mention-weighted depths. Counted by flags, without sets."""
    side = lambda s: (F.col("side") == s)
    ent = mentions.groupBy("case_id", "entity").agg(F.max(side("A")).alias("a"), F.max(side("B")).alias("b"))
    ent = ent.groupBy("case_id").agg(F.count_if(F.col("a")).alias("types_a"), F.count_if(F.col("b")).alias("types_b"), F.count_if(F.col("a") & F.col("b")).alias("string_intersection"))
    con = mentions.where("concept is not null").groupBy("case_id", "concept").agg(F.max(side("A")).alias("a"), F.max(side("B")).alias("b"))
    con = con.groupBy("case_id").agg(F.count_if(F.col("a") & F.col("b")).alias("intersection"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"))
    w = lambda s: F.sum(F.when(side(s) & F.col("depth").isNotNull(), F.col("depth") * F.col("n"))) / F.sum(F.when(side(s) & F.col("depth").isNotNull(), F.col("n")))
    dep = mentions.groupBy("case_id").agg(F.coalesce(F.sum(F.when(side("A"), F.col("n"))), F.lit(0)).alias("mentions_a"), F.coalesce(F.sum(F.when(side("B"), F.col("n"))), F.lit(0)).alias("mentions_b"), F.round(w("A"), 6).alias("weighted_depth_a"), F.round(w("B"), 6).alias("weighted_depth_b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    met = ent.join(dep, "case_id").join(con, "case_id", "left").select("case_id", "types_a", "types_b", "string_intersection", "mentions_a", "mentions_b", zero("intersection"), zero("a_only"), zero("b_only"), "weighted_depth_a", "weighted_depth_b")
    union = F.col("intersection") + F.col("a_only") + F.col("b_only")
    return met.withColumn("jaccard", F.round(F.when(union > 0, F.col("intersection") / union), 6))


def inventory(mentions: DataFrame) -> DataFrame:
    mapped = F.col("concept").isNotNull() & F.col("depth").isNotNull()
    return mentions.select("case_id", "side", "entity", "n", "concept", "depth", F.when(mapped, "mapped").otherwise("unmapped").alias("mapping_status"))


def same_string(mentions: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Entities on both sides of a case with their counts, and with ``docs`` (corpus, case_id, text) the sentences around them."""
    a = mentions.where("side = 'A'").select("case_id", "entity", "concept", "depth", F.col("n").alias("count_a"))
    met = a.join(mentions.where("side = 'B'").select("case_id", "entity", F.col("n").alias("count_b")), ["case_id", "entity"]).where("concept is not null")
    return met if docs is None else with_pair_contexts(met, docs, "entity", "entity")


def pooled_same_string(entities: DataFrame) -> DataFrame:
    """entities(corpus, entity, concept, depth): strings of both corpora and their difference of depth."""
    known = entities.where("concept is not null and depth is not null")
    a = known.where("corpus = 'A'").select("entity", F.col("concept").alias("ca"), F.col("depth").alias("depth_a"))
    met = a.join(known.where("corpus = 'B'").select("entity", F.col("concept").alias("cb"), F.col("depth").alias("depth_b")), "entity")
    return met.select("entity", F.when(F.col("ca") == F.col("cb"), F.col("ca")).otherwise(F.concat_ws(";", "ca", "cb")).alias("concept"), "depth_a", "depth_b", (F.col("depth_b") - F.col("depth_a")).alias("depth_diff"))


def related_pairs(mentions: DataFrame, up: DataFrame, min_gap: int = 0, most: int = 10_000) -> DataFrame:
    """Per case the pairs across sides where one concept is a proper ancestor of the other and depths differ by ``min_gap`` at least.

    A case's concepts with ancestors among all mentions meet those that are such ancestors, and the pairs meet the closure. Cases in which
    that would make more than ``most`` pairs take the way over the closure instead, where no pairs are made that aren't related."""
    known = settled(mentions.where("concept is not null and depth is not null").select("case_id", "side", "entity", "concept", "depth", "n"), "mentions")
    above = up.where("min_hops >= 1").select("c", "anc")
    heads = settled(above.select(F.col("anc").alias("concept")).distinct(), "heads")
    tops = settled(known.select("concept").join(heads, "concept", "left_semi").distinct(), "tops")
    rel = settled(above.join(tops.withColumnRenamed("concept", "anc"), "anc", "left_semi"), "related-concepts")
    idle = settled(up.select("c").distinct().join(rel.select("c").distinct(), "c", "left_anti").withColumnRenamed("c", "concept"), "idle")
    part = lambda d, s: d.select("case_id", *(F.col(c).alias(f"{c}_{s}") for c in ("side", "entity", "concept", "depth", "n")))
    low, high = part(known.join(idle, "concept", "left_anti"), "low"), part(known.join(tops, "concept", "left_semi"), "high")
    sizes = known.groupBy("case_id").agg(F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "B").alias("b"))
    wide = settled(sizes.where(F.col("a") * F.col("b") > most).select("case_id"), "wide-cases")
    n, apart = known.count(), (F.col("side_low") != F.col("side_high")) & (F.abs(F.col("depth_low") - F.col("depth_high")) >= min_gap)
    dealt = lambda d: spread(d.join(wide, "case_id", "left_anti"), ["case_id"], n)
    pairs = dealt(low).join(dealt(high), "case_id").where(apart)
    ends = rel.select(F.col("c").alias("concept_low"), F.col("anc").alias("concept_high"))
    met = spread(pairs, ["concept_low", "concept_high"], n).join(spread(ends, ["concept_low", "concept_high"], n), ["concept_low", "concept_high"])
    if not wide.isEmpty():
        far = low.join(wide, "case_id", "left_semi").join(ends, "concept_low").join(high.join(wide, "case_id", "left_semi"), ["case_id", "concept_high"]).where(apart)
        met = met.unionByName(far)
    of = lambda c, s, name: F.when(F.col("side_low") == s, F.col(f"{c}_low")).otherwise(F.col(f"{c}_high")).alias(name)
    sides = [of(c, s, f"{name}{s.lower()}") for s in "AB" for c, name in (("entity", "entity_"), ("concept", "c"), ("depth", "depth_"), ("n", "count_"))]
    return met.select("case_id", *sides, F.col("side_high").alias("broader"), F.abs(F.col("depth_low") - F.col("depth_high")).alias("gap"))


def hierarchical_pairs(mentions: DataFrame, up: DataFrame, min_gap: int = 3, cap: int = 20, docs: DataFrame | None = None) -> DataFrame:
    """Per case the related entity pairs across sides whose depths differ by ``min_gap`` at least, largest gaps first; with ``docs``
    (corpus, case_id, text) the sentences around both entities of the pairs that stay."""
    met = related_pairs(mentions, up, min_gap).where(F.col("entity_a") != F.col("entity_b"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gap"), F.substring("entity_a", 1, 40), F.substring("entity_b", 1, 40), "ca", "cb"))
    kept = met.withColumn("r", rank).where(F.col("r") <= cap).select("case_id", "entity_a", "entity_b", F.col("ca").alias("concept_a"), F.col("cb").alias("concept_b"), "depth_a", "depth_b", "gap", "broader", "count_a", "count_b")
    return kept if docs is None else with_pair_contexts(settled(kept, "hierarchical-pairs"), docs)


def cross_concepts(mentions: DataFrame, up: DataFrame, cap: int = 40) -> DataFrame:
    """Per case the concept pairs across sides in an ancestor relation, each with its smallest entity."""
    one = mentions.where("concept is not null and depth is not null").groupBy("case_id", "side", "concept").agg(F.min("entity").alias("entity"), F.max("depth").alias("depth")).withColumn("n", F.lit(1).cast("long"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gap"), "ca", "cb"))
    return related_pairs(one, up).withColumn("r", rank).where(F.col("r") <= cap).select("case_id", F.col("ca").alias("concept_a"), F.col("cb").alias("concept_b"), "depth_a", "depth_b", "gap", "broader", "entity_a", "entity_b")


def triple_intersection(depths: DataFrame) -> DataFrame:
    """depths(corpus, entity, depth): entities of all three corpora and the mean depths over them."""
    both = depths.groupBy("entity").agg(F.count_distinct("corpus").alias("k")).where("k = 3")
    return depths.join(both, "entity", "left_semi").groupBy("corpus").agg(F.count("*").alias("n"), F.round(F.avg("depth"), 6).alias("mean_depth"))
