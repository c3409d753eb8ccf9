"""Model review of entity pairs, decision counts, re-linking of the reviewed strings, figures' data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicons
from textloom.functions.model_json import parse_verdict
from textloom.functions.text import excerpt
from textloom.operators.linking import first_case, first_shared_case, link_best
from textloom.operators.ontology import lowest_common_ancestors
from textloom.plans.scratch import settled


def decision_counts(reviewed: DataFrame) -> DataFrame:
    d = F.upper(F.trim("decision"))
    return reviewed.select(d.alias("decision")).where("decision <> ''").groupBy("decision").agg(F.count("*").alias("n"))


def review_prompts(seeds: DataFrame, template: str) -> DataFrame:
    """seeds(case_id, entity_a, entity_b, excerpt_a, excerpt_b) and ``prompt``: the template with the columns' names in braces filled."""
    text = F.lit(template)
    for c in ("case_id", "entity_a", "entity_b", "excerpt_a", "excerpt_b"):
        text = F.replace(text, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return seeds.withColumn("prompt", text)


def review(seeds: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """seeds with ``prompt`` -> decision and final strings. A failed call is INCOMPARABLE, a missing decision KEEP, an empty replacement the old string."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prompt in batch["prompt"]:
                try:
                    out.append(provider(prompt))
                except Exception as e:
                    out.append('{"decision": "INCOMPARABLE", "rationale": "%s"}' % type(e).__name__)
            yield batch.assign(raw=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeds.schema) + ", raw string"
    v = seeds.mapInPandas(call, schema).withColumn("v", parse_verdict(F.col("raw")))
    final = lambda c: F.when(F.trim(F.coalesce(F.col(f"v.{c}"), F.lit(""))) != "", F.trim(F.col(f"v.{c}"))).otherwise(F.col(c))
    return v.select(*(c for c in seeds.columns if c != "prompt"), F.coalesce(F.upper("v.decision"), F.lit("KEEP")).alias("decision"), final("entity_a").alias("final_entity_a"), final("entity_b").alias("final_entity_b"), "v.rationale")


def reviewed_depths(reviewed: DataFrame, descriptions: DataFrame, depth: DataFrame) -> DataFrame:
    """The final strings linked and measured again, without the model."""
    asked = reviewed.select(F.col("final_entity_a").alias("entity")).union(reviewed.select("final_entity_b"))
    found = link_best(asked, descriptions).join(depth.withColumnRenamed("c", "concept"), "concept", "left")
    side = lambda s: found.select(F.col("entity").alias(f"_e{s}"), F.col("concept").alias(f"concept_{s}"), F.col("depth").alias(f"depth_{s}"))
    met = reviewed.join(side("a"), F.lower("final_entity_a") == F.col("_ea"), "left").join(side("b"), F.lower("final_entity_b") == F.col("_eb"), "left")
    return met.drop("_ea", "_eb").withColumn("depth_diff", F.col("depth_b") - F.col("depth_a"))


def capped_by_decision(rows: DataFrame, caps: dict[str, int], order: list[str], key: list[str] | None = None) -> DataFrame:
    """The first rows of each decision, as a figure shows them; of rows with the same ``key`` the first only."""
    if key:
        first = F.min(F.struct(*dict.fromkeys([*order, *rows.columns])))
        rows = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in key), F.col("decision").alias("_decision")).agg(first.alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in rows.columns))
    cap = F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))[F.col("decision")]
    r = F.row_number().over(Window.partitionBy("decision").orderBy(*order))
    # the largest cap as a literal lets each task drop what can't be among the first
    return rows.where(F.col("decision").isin(*caps)).withColumn("r", r).where(F.col("r") <= max(caps.values(), default=0)).where(F.col("r") <= cap).drop("r")


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) over equal bins from least to most; the most is in the last bin."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    met = rows.select(F.col(value).cast("double").alias("v")).where("v is not null").join(F.broadcast(ends))
    at = F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    return met.select(F.when(F.col("hi") > F.col("lo"), at).otherwise(0).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def review_excerpts(seeds: DataFrame, docs: DataFrame, case_chars: int = 1200, any_chars: int = 900) -> DataFrame:
    """seeds(case_id, entity_a, entity_b, excerpt_a, excerpt_b) with case and excerpts filled in: the seed's own excerpts if both are there; else
    the texts of its case; else of the first case that holds both entities; else each side's first text that holds its entity.

    A case with a bar in its name is several cases and has no text."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    rows = settled(seeds.withColumn("_seed", F.monotonically_increasing_id()), "seeds")
    given = ~blank("excerpt_a") & ~blank("excerpt_b")
    side = lambda s: docs.where(F.col("corpus") == s).select("case_id", "text")
    open_ = rows.where(~given & blank("case_id"))
    shared = first_shared_case(open_.select("_seed", "entity_a", "entity_b"), side("A"), side("B")).select("_seed", F.col("case_id").alias("_shared"))
    met = rows.join(shared, "_seed", "left").withColumn("_case", F.when(~blank("case_id"), F.col("case_id")).otherwise(F.col("_shared")))
    for s, entity in (("A", "entity_a"), ("B", "entity_b")):
        own = side(s).select(F.col("case_id").alias("_case"), F.col("text").alias(f"_text_{s}"))
        left = open_.join(shared, "_seed").where("_shared is null").select("_seed", F.lower(F.trim(entity)).alias("entity"))
        first = left.join(first_case(side(s), left.select("entity")), "entity").join(side(s).withColumnRenamed("text", f"_first_{s}"), "case_id").select("_seed", f"_first_{s}")
        met = met.join(own, "_case", "left").join(first, "_seed", "left")

    def filled(s: str, c: str) -> Column:
        whole = F.when(F.col("_case").cast("string").contains("|"), lexicons.NO_SHARED_CASE).otherwise(excerpt(F.col(f"_text_{s}"), case_chars))
        return F.when(given, F.trim(c)).when(F.col("_case").isNotNull(), F.coalesce(whole, F.lit(""))).otherwise(F.coalesce(excerpt(F.col(f"_first_{s}"), any_chars), F.lit(""))).alias(c)

    new = {"case_id": F.col("_case").alias("case_id"), "excerpt_a": filled("A", "excerpt_a"), "excerpt_b": filled("B", "excerpt_b")}
    return met.select(*(new.get(c, F.col(c)) for c in seeds.columns))


def prompts_by_kind(seeds: DataFrame, template: str, hierarchical_template: str) -> DataFrame:
    """seeds with a column ``kind``: hierarchical ones take their own template."""
    hier = F.lower(F.coalesce("kind", F.lit(""))).contains("hierarchical")
    made = review_prompts(seeds, template).withColumnRenamed("prompt", "_plain")
    return review_prompts(made, hierarchical_template).withColumn("prompt", F.when(hier, F.col("prompt")).otherwise(F.col("_plain"))).drop("_plain")


def drawable_pairs(measured: DataFrame, up: DataFrame, depth: DataFrame) -> DataFrame:
    """Reviewed rows whose two concepts are known, differ, have depths and a common ancestor: with the deepest one. Missing depths are looked up."""
    rows = measured.where("concept_a is not null and concept_b is not null and concept_a <> concept_b")
    for s in "ab":
        known = depth.select(F.col("c").alias(f"concept_{s}"), F.col("depth").alias(f"_{s}"))
        rows = rows.join(known, f"concept_{s}", "left").withColumn(f"depth_{s}", F.coalesce(f"depth_{s}", f"_{s}")).drop(f"_{s}")
    rows = rows.where("depth_a is not null and depth_b is not null")
    found = lowest_common_ancestors(rows.select(F.col("concept_a").alias("ca"), F.col("concept_b").alias("cb")), up, depth, None)
    return rows.join(found.select(F.col("ca").alias("concept_a"), F.col("cb").alias("concept_b"), F.col("lca").alias("lca_concept")), ["concept_a", "concept_b"])


def judge_bundle(cases: DataFrame, edges: DataFrame, prose_chars: int = 1800) -> DataFrame:
    """(case_id, record): a JSON record of each case's prose and graph, as given to a judge. cases(case_id, text)."""
    links = edges.groupBy("case_id").agg(F.count("*").alias("n_edges"), F.sort_array(F.collect_list(F.struct("src", "dst", "rel"))).alias("links"))
    prose = F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, prose_chars)
    return cases.join(links, "case_id", "left").select("case_id", F.to_json(F.struct("case_id", prose.alias("prose"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "links")).alias("record"))


def judge(bundles: DataFrame, provider: Callable[[str], str] | None, instruction: str = "", model: str = "") -> DataFrame:
    """(case_id, record, raw, judgement): the model's answer to each record, parsed. Without a provider a dry run: the answer says that it was skipped."""
    prompts = bundles.select("case_id", "record", F.concat_ws("\n\n", "record", F.lit(instruction) if instruction else F.lit(None)).alias("prompt"))
    if provider is None:
        raw = prompts.withColumn("raw", F.lit('{"skipped": "dry_run"}'))
    else:

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import json

            for batch in batches:
                out = []
                for prompt in batch["prompt"]:
                    try:
                        out.append(provider(prompt))
                    except Exception as e:
                        out.append(json.dumps({"error": str(e), "verdict": "error"}))
                yield batch.assign(raw=out)

        raw = prompts.mapInPandas(call, f"case_id {bundles.schema['case_id'].dataType.simpleString()}, record string, prompt string, raw string")
    blob = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    return raw.select("case_id", "record", F.lit(model).alias("model"), "raw", F.from_json(blob, lexicons.JUDGEMENT).alias("judgement"))
