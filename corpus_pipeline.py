"""From raw documents to packed training sequences: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and gives them to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from textloom.llm.common import read, settle
from textloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity the classifier chain puts above a half go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def cut_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; documents that consist of nothing else go."""
    return line_dedup.drop_copied_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard similarity of 0.8, the smallest id stays."""
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_copied_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("pack", pack_sequences),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
