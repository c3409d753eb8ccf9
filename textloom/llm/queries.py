"""The queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, collocations, decontaminate, drake, html_extract, line_dedup, lm_score, ngram_join, oracles, packing, quality, topk, toxicity, url_filter
from textloom.llm.common import read

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select("doc_id", "n_lines", line_dedup.n_removed(F.col("removed_runs")).alias("n_removed"), F.md5("text").alias("text_md5"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).cast("int").alias("good"))
    return quality.score_quality(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), labels)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).cast("int").alias("good"))
    return url_filter.filter_urls(read(spark, sf_dir, "pages", "page_id", "url"), outcomes, URL_RULES)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, toxicity.categories(labels)))
    return scored.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") > 0.5).alias("rejected"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5).drop("read")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents", "lang", "text"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN, back="decoded")
    n = (F.octet_length("tokens") / 4).cast("long").alias("n_tokens")
    return ids.select("doc_id", n, F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.clusters(read(spark, sf_dir, "embeddings", "vec_id", "embedding")).drop("measured")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
