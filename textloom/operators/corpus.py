"""Corpus building: nested token lists, marker sentences, prompts, strict pairs, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCES = "array<array<string>>"
MARKER = r"(?i)\bCORRECT\s+ANSWER\s*:"


def parse_sentences(text: Column) -> Column:
    """struct(sentences, reason): a list of token lists written as JSON or with single quotes; null with a reason otherwise."""
    raw = F.trim(text)
    as_json = F.from_json(raw, SENTENCES)
    # a quote that opens or closes an item stands next to a bracket, comma or blank
    swapped = F.regexp_replace(F.regexp_replace(raw, r'"', r'\\"'), r"(?<=[\[,]\s{0,3})'|'(?=\s*[,\]])", '"')
    parsed = F.coalesce(as_json, F.from_json(swapped, SENTENCES))
    reason = F.when(text.isNull() | (raw == "") | F.lower(raw).isin("none", "null"), "empty").when(parsed.isNull(), "not a list")
    return F.struct(F.when(reason.isNull(), parsed).alias("sentences"), reason.alias("reason"))


def join_sentences(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda t: F.array_join(t, " ")), "\n\n")


def marker_index(s: Column) -> Column:
    """1-based place of the first marker sentence; null without one."""
    at = F.array_position(F.transform(s, lambda t: F.array_join(t, " ").rlike(MARKER)), True)
    return F.when(at > 0, at.cast("int"))


def stem(s: Column) -> Column:
    return join_sentences(F.slice(s, F.lit(1), marker_index(s) - 1))


def justification(s: Column) -> Column:
    return join_sentences(F.slice(s, marker_index(s) + 1, F.size(s)))


def option_number(s: Column) -> Column:
    line = F.array_join(F.get(s, marker_index(s) - 1), " ")
    n = F.expr("1") * F.regexp_extract(line, MARKER + r"\s*(\d+)", 1).try_cast("int")
    return F.when((n >= 1) & (n <= 5), n)


def option_label(s: Column) -> Column:
    lines = F.transform(F.slice(s, F.lit(1), marker_index(s) - 1), lambda t: F.trim(F.array_join(t, " ")))
    number = F.concat(F.lit("^"), option_number(s).cast("string"), F.lit(r"\s*-\s*(.+)$"))
    hits = F.filter(lines, lambda x: F.regexp_like(x, number))
    return F.coalesce(F.trim(F.regexp_replace(F.get(hits, F.lit(0)), r"^\d\s*-\s*", "")), F.lit(""))


def length_budget(reference: Column) -> Column:
    """struct(words, max_words, num_predict) for a generation as long as the reference."""
    w = F.size(F.regexp_extract_all(F.coalesce(reference, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    predict = F.greatest(F.lit(180), F.least(F.floor(w * 1.22 * 1.35).cast("int") + 48, F.lit(1536)))
    return F.struct(w.alias("words"), F.when(w >= 1, F.greatest(w + 8, F.floor(w * 1.28).cast("int"))).alias("max_words"), F.when(w < 1, 384).otherwise(predict).alias("num_predict"))


def prompts(rows: DataFrame, instruction: str, unkeyed_instruction: str, keyed: bool = True) -> DataFrame:
    """rows(case_id, sentences, reference) -> (case_id, prompt, num_predict). ``instruction`` may name {key}, {words} and {max_words}."""
    budget = length_budget(F.col("reference"))
    key = F.concat(F.lit("option "), option_number(F.col("sentences")).cast("string"), F.when(option_label(F.col("sentences")) != "", F.concat(F.lit(" ("), option_label(F.col("sentences")), F.lit(")"))).otherwise(""))
    text = F.lit(instruction if keyed else unkeyed_instruction)
    for name, value in (("{key}", key), ("{words}", budget["words"].cast("string")), ("{max_words}", budget["max_words"].cast("string"))):
        text = F.replace(text, F.lit(name), F.coalesce(value, F.lit("")))
    return rows.select("case_id", F.concat(text, F.lit("\n\n"), stem(F.col("sentences"))).alias("prompt"), budget["num_predict"].alias("num_predict"))


def generate(rows: DataFrame, provider: Callable[[str, int], str], prompt_col="prompt", attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """rows and ``answer`` of a text model called in the tasks; the provider is any picklable function (prompt, num_predict) -> str."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            out: list[str | None] = []
            for prompt, n in zip(batch[prompt_col], batch["num_predict"]):
                answer = None
                for k in range(attempts):
                    try:
                        answer = provider(prompt, int(n))
                        break
                    except Exception:
                        if k + 1 < attempts:
                            time.sleep(wait * (k + 1))
                out.append(answer)
            yield batch.assign(answer=out)

    return rows.mapInPandas(call, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, answer string")


def not_yet_done(rows: DataFrame, existing: DataFrame, key="case_id") -> DataFrame:
    return rows.join(existing.where(F.trim("text") != "").select(key).distinct(), key, "left_anti")


def pair_audit(docs: DataFrame) -> DataFrame:
    """One row: cases kept with both sides, and cases pruned."""
    filled = lambda c: F.max((F.col("corpus") == c) & (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) > 0))
    cases = docs.groupBy("case_id").agg(filled("A").alias("a"), filled("B").alias("b"))
    return cases.agg(F.count_if(F.col("a") & F.col("b")).alias("kept"), F.count_if(~(F.col("a") & F.col("b"))).alias("pruned"))


def stratified_sample(rows: DataFrame, quotas: dict[str, int], seed: int = 42, key="case_id", stratum="area", top_up: str | None = None, total: int | None = None) -> DataFrame:
    """Up to a quota of rows of each stratum, by the order of md5(key, seed): the same on every run and engine.

    What short strata leave open of ``total`` (the quotas' sum) is taken from the stratum ``top_up``; fewer rows than that raise."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    quota = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))[F.col(stratum)]
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))
    own = rows.where(F.col(stratum).isin(*quotas)).select(key, stratum)
    # the largest quota as a literal lets each task drop what can't be among the first
    picked = own.withColumn("r", r).where(F.col("r") <= max(quotas.values(), default=0)).where(F.col("r") <= quota).select(key, stratum)
    if top_up is None:
        return picked
    total = sum(quotas.values()) if total is None else total
    have = picked.count()
    rest = own.where(F.col(stratum) == top_up).join(picked.select(key), key, "left_anti").orderBy(order, key).limit(max(0, total - have))
    if have + rest.count() < total:
        raise ValueError(f"fewer than {total} rows for the sample")
    return picked.unionByName(rest.select(key, stratum)).orderBy(key).limit(total)


def simple_sample(rows: DataFrame, n: int, seed: int = 42, key="case_id") -> DataFrame:
    """``n`` rows by the order of md5(key, seed); all rows if ``n`` is 0."""
    if n <= 0:
        return rows
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary")), key).limit(n)
