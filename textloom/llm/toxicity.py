"""Toxicity by a classifier chain.

Categories are predicted one after the other; the probabilities of earlier categories are inputs of later linear models,
which are trained with out-of-fold predictions. The labels table knows two: text of low quality, then toxic text. Scoring is a
map over the texts and reads each whole text.

Defined results: null and empty texts have no features and get the models' bias; rows whose labels are null aren't
used; repeated labels of an id count as the worst of them; without any labels nothing is toxic; repeated rows are
scored each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text_features import Chain, fit_chain, with_logits

CATEGORIES = ["low_quality", "toxic"]


def categories(labels: DataFrame, id_col="doc_id") -> DataFrame:
    return labels.select(id_col, (F.col("quality") == 0).cast("int").alias("low_quality"), (F.col("toxic") == 1).cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, order: list[str] = CATEGORIES, id_col="doc_id", text_col="text", max_rows: int = 20_000) -> Chain:
    return fit_chain(docs, labels, order, id_col, text_col, max_rows)


def score(docs: DataFrame, chain: Chain, text_col="text", prefix="p_") -> DataFrame:
    """All rows and columns and a probability for each category (columns of that name are replaced)."""
    new = {f"{prefix}{c}": 1 / (1 + F.exp(-F.col("logits")[i])) for i, c in enumerate(chain.labels)}
    made = with_logits(docs, chain, text_col)
    return made.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in new), *(p.alias(c) for c, p in new.items()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col="doc_id", text_col="text", max_rows: int = 20_000) -> DataFrame:
    """The rows that the chain doesn't put above ``threshold`` in its last category, all their columns."""
    chain = fit(docs, categories(labels, id_col), CATEGORIES, id_col, text_col, max_rows)
    odds = float(np.log(threshold / (1 - threshold)))
    return with_logits(docs, chain, text_col).where(F.col("logits")[len(CATEGORIES) - 1] <= odds).select("row.*")
