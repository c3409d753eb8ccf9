"""Presence features of whole texts and linear models over the most telling of them.

A text's features are its words, the words' first 5 and 7 bytes, and the last 2 bytes of its raw tokens, each as a
64-bit number. Models are fitted on a bounded sample of labelled rows (``max_rows``, by hash order): the sample's features
are counted per label and fold by a grouped sum in Spark, the ``most`` with the largest chi-square are kept, and a logistic
regression with an L2 prior is fitted in numpy on the sample's kept features. Out-of-fold models choose their features without the
rows of the fold, too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import words as W
from textloom.llm.common import discard, freeing, settle

PREFIXES, SUFFIX = (5, 7), 2


def features(texts: pa.Array, size: int = 300_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature), not yet distinct."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(offset, offset[row] + size, "right")) - 1)
        own = offset[row : upto + 1]
        at = np.concatenate([[0], np.cumsum(np.diff(own) + 1)])
        data = np.full(int(at[-1]), 0x20, np.uint8)
        keep = np.ones(len(data), bool)
        keep[at[1:] - 1] = False
        data[keep] = raw[own[0] : own[-1]]
        number, start, end = W.word_numbers(data, W.SIGNS)
        out, rows = [number], [start]
        for p in PREFIXES:
            long = np.flatnonzero(end - start > p)
            s = start[long]
            key = np.full(len(s), p, np.uint64)
            for k in range(p):
                key = key * W.FREE_ODD + W.SIGNS[data[s + k]]
            out.append(W.mix(key))
            rows.append(s)
        _, start, end = W.word_numbers(data, W.SPACES)
        long = np.flatnonzero(end - start > SUFFIX)
        key = np.full(len(long), 1_000_003, np.uint64)
        for k in range(SUFFIX):
            key = key * W.FREE_ODD + W.SPACES[data[end[long] - 1 - k]]
        out.append(W.mix(key))
        rows.append(start[long])
        yield row, upto - row, np.searchsorted(at, np.concatenate(rows), "right") - 1, np.concatenate(out)
        row = upto


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


@freeing
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labels' columns and the distinct features of each row's text (the last column)."""
    for batch in batches:
        for first, n, row, feature in features(batch.column(batch.num_columns - 1)):
            row, feature = _distinct(row, feature)
            bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, n) for i in range(batch.num_columns - 1)), lists], names=[*batch.schema.names[:-1], "features"])


@dataclass
class Linear:
    """Logistic regression over kept features and, in a chain, the probabilities of earlier labels."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logit(self, row: np.ndarray, slot: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.weights[slot], n) + before @ self.earlier + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(row, slot, n, before, y, size: int, l2: float = 1.0, steps: int = 250) -> Linear:
    """Full-batch Adam on the penalised log loss."""
    x, m, v = np.zeros(size + before.shape[1] + 1), 0.0, 0.0
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    x[-1] = np.log(share / (1 - share))
    for k in range(1, steps + 1 if n else 1):
        model = Linear(x[:size], x[size:-1], x[-1])
        g = sigmoid(model.logit(row, slot, n, before)) - y
        grad = np.concatenate([np.bincount(slot, g[row], size), g @ before, [g.sum()]])
        grad[:-1] += l2 * x[:-1]
        grad /= n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x = x - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Linear(x[:size], x[size:-1], float(x[-1]))


@dataclass
class Chain:
    """Linear models in the order of the labels; each later one also reads the probabilities of those before."""

    labels: list[str]
    kept: np.ndarray
    models: list[Linear] = field(default_factory=list)

    def logits(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        if len(self.kept):
            slot = np.minimum(np.searchsorted(self.kept, feature), len(self.kept) - 1)
            hit = self.kept[slot] == feature
            row, slot = _distinct(row[hit], slot[hit].astype(np.uint64))
            slot = slot.astype(np.int64)
        else:
            row, slot = row[:0], row[:0]
        out, before = np.zeros((n, 0)), np.zeros((n, 0))
        for model in self.models:
            own = np.clip(model.logit(row, slot, n, before), -30, 30)[:, None]
            out, before = np.concatenate([out, own], 1), np.concatenate([before, sigmoid(own)], 1)
        return out


def _chosen(rows: DataFrame, ys: list[str], folds: int, most: int, least_rows: int, least_score: float) -> list[np.ndarray]:
    """The kept features, sorted: of all rows first, then without the rows of each fold."""
    n, y = (lambda k: f"n{k}"), (lambda k, c: f"{c}_{k}")
    own = [(k, F.col("fold") == k) for k in range(folds)]
    sums = [s for k, inside in own for s in (F.count_if(inside).alias(n(k)), *(F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(y(k, c)) for c in ys))]
    total = rows.agg(*sums).first()
    counts = rows.select("fold", *ys, F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least_rows)
    counts = settle(counts, "feature-counts")
    out = []
    for left in (None, *range(folds)):
        used = [k for k in range(folds) if k != left]
        score, seen, every = F.lit(0.0), sum(F.col(n(k)) for k in used), sum(total[n(k)] or 0 for k in used)
        for c in ys:
            share = sum(total[y(k, c)] or 0 for k in used) / every if every else 0
            if 0 < share < 1:
                score = F.greatest(score, (sum(F.col(y(k, c)) for k in used) - seen * share) ** 2 / (seen * share * (1 - share)))
        best = counts.where(seen >= least_rows).withColumn("score", score).where(F.col("score") >= least_score).orderBy(F.desc("score"), "feature").limit(most)
        out.append(np.sort(np.array([r.feature for r in best.select("feature").collect()], np.int64).view(np.uint64)))  # ``most`` at most
        if len(ys) == 1:  # nothing reads out-of-fold predictions
            break
    discard(counts)
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, columns: list[str], id_col="doc_id", text_col="text", max_rows: int = 20_000, most: int = 2048, least_rows: int = 3, least_score: float = 15.0, folds: int = 5, repeated=F.max) -> Chain:
    """labels(id, columns 0/1): fit the chain on at most ``max_rows`` labelled rows; of several labels of an id ``repeated`` chooses one.

    Later models are trained with out-of-fold probabilities of the earlier labels, so they see earlier errors as they will be."""
    ys = [f"y{i}" for i in range(len(columns))]
    known = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("int").alias(y) for c, y in zip(columns, ys))).dropna().groupBy("id").agg(*(repeated(y).alias(y) for y in ys))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")  # max_rows bounds its size
    rows = met.select(F.xxhash64("id").alias("key"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(folds)).cast("int").alias("fold"), *ys, "text")
    rows = settle(rows.mapInArrow(_featured, ", ".join(["key long", "fold int", *(f"{y} int" for y in ys), "features array<long>"])), "labelled-features")
    n = rows.count()
    if n > max_rows:  # many rows may share a labelled id
        rows, n = settle(rows.orderBy("key", F.xxhash64("features")).limit(max_rows), "labelled-features"), max_rows
    chosen = _chosen(rows, ys, folds, most, least_rows, least_score)
    union = np.unique(np.concatenate(chosen))
    kept = chosen[0]
    got = rows.select(F.monotonically_increasing_id().alias("row"), "key", "fold", *ys, "features")
    if len(union):  # at most ``most`` features for each fold
        # as Arrow: a list of rows would start Python workers of its own on every executor, and they stay
        slots = pa.table({"feature": pa.array(union.view(np.int64)), "slot": pa.array(np.arange(len(union), dtype=np.int32))})
        listed = F.broadcast(rows.sparkSession.createDataFrame(slots))
        pairs = got.select("row", F.explode("features").alias("feature")).join(listed, "feature").groupBy("row").agg(F.collect_list("slot").alias("slots"))
        got = got.drop("features").join(pairs, "row", "left")
    else:
        got = got.drop("features").withColumn("slots", F.array().cast("array<int>"))
    # at most max_rows short lists, as Arrow: no Python object for each of their numbers
    table = got.withColumn("slots", F.coalesce("slots", F.array().cast("array<int>"))).orderBy("key", "row").select("fold", *ys, "slots").toArrow()
    discard(rows)
    lists = table["slots"].combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    slot = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def part(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows and places in ``features``."""
        place = np.searchsorted(features, union)
        inside = np.isin(union, features)
        own = inside[slot] if len(union) else np.zeros(0, bool)
        return row[own], place[slot[own]]

    fold = table["fold"].to_numpy().astype(np.int64)
    before, chain = np.zeros((n, 0)), Chain(columns, kept)
    for i, y in enumerate(ys):
        target = table[y].to_numpy().astype(float)
        chain.models.append(fit_linear(*part(kept), n, before, target, len(kept)))
        if i + 1 < len(ys):
            out = np.zeros(n)
            for k, features in enumerate(chosen[1:]):
                own_row, own_slot = part(features)
                used = fold != k
                place, learn = np.cumsum(used) - 1, used[own_row]
                model = fit_linear(place[own_row[learn]], own_slot[learn], int(used.sum()), before[used], target[used], len(features))
                out = np.where(used, out, model.logit(own_row, own_slot, n, before))
            before = np.concatenate([before, sigmoid(out)[:, None]], 1)
    return chain


def with_logits(docs: DataFrame, chain: Chain, text_col="text") -> DataFrame:
    """(row, logits): each row whole, as a struct, and the logit of each label. A map over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    return docs.select(F.struct("*").alias("row"), _scorer(shared)(F.col(text_col).cast("string")).alias("logits"))


def _scorer(shared):
    @F.arrow_udf("array<double>")
    @freeing
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chain = shared.value
        width = len(chain.labels)
        for texts in batches:
            made = np.concatenate([np.zeros((0, width)), *(chain.logits(row, feature, n) for _, n, row, feature in features(texts))])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * width), pa.array(made.ravel()))

    return score
