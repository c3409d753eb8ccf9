"""Exact top-k inner products by sorted lists without random access (NRA).

A score is the sum of the partial scores of ``LISTS`` runs of dimensions; for a query each run is a list of a block's
rows in the order of their partial scores. Few lists of many dimensions are strong: a row near the top of one can't be far down in all
others. A query reads its lists to the same depth, which doubles. A row's upper bound takes the list's frontier for what is
unread, its lower bound the list's end. Reading stops when all rows but a few are below the k-th best lower bound; only the rows in
doubt are resolved to their scores. Where the query has k rows from earlier blocks, it reads each list down to an equal share of
the k-th best score, as rows unread in all lists are below that score, and resolves those that reach it. A block whose box of values
can't reach that score isn't read at all. Blocks begin small and double, so that nearly all are read with a score to reach.

Spark deals the work: rows and queries are dealt into runs of bounded size, and each run of queries meets each run of rows in a cogroup.
The runs are as large as a task's memory allows and no more than the session's cores ask for, as rows are shuffled once for each run of
queries and queries once for each run of rows; a window per query merges the runs' k best.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, nor do null ids, nor vectors
with a component of 2^62 or more when scaled; vectors of another length than the query's don't meet it; ties go to the
smaller id; a repeated id is a row of its own, and a query never meets rows with its own id; scores beyond a long are its
ends; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import settle

LISTS = 2
#: Integers below are exact in doubles.
EXACT = 1 << 53
#: The values of a run's rows (32 MB of them), whatever their dimensions.
RUN_VALUES = 1 << 22


def nra_block(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None, first_depth: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, row id, score) of the rows of this block that are among each query's k best; and the share of its lists that each query read.

    ``least``: scores that the k best have to reach, for each query."""
    n, d = values.shape
    least = np.full(len(queries), -np.inf) if least is None else least
    read = np.zeros(len(queries))
    if d * float(np.abs(values).max(initial=0)) * float(np.abs(queries).max(initial=0)) >= EXACT:
        return *_plain(ids, values, query_ids, queries, k), np.ones(len(queries))
    values, queries = values.astype(float), queries.astype(float)
    high, low = values.max(0), values.min(0)
    # no row is outside of the block's box
    open_ = np.flatnonzero(np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low >= least)
    runs = [r for r in np.array_split(np.arange(d), LISTS) if len(r)]
    lists = [values[:, r] @ queries[open_][:, r].T for r in runs]
    found, led = [], np.isfinite(least[open_])
    if led.any():
        some, bounded = (open_, lists) if led.all() else (open_[led], [x[:, led] for x in lists])
        # a row below its share of the score in each list is below the score
        seen = [x >= least[some] / len(runs) for x in bounded]
        read[some] = sum(np.count_nonzero(x, axis=0) for x in seen) / (n * len(runs))
        row, query = np.nonzero(np.logical_or.reduce(seen))
        score = sum(x[row, query] for x in bounded)
        reached = score >= least[some[query]]
        found.append((some[query[reached]], row[reached], score[reached]))
        open_, lists = open_[~led], [x[:, ~led] for x in lists]
    ends = [x.min(0) for x in lists]
    keep, depth = min(k + 1, n), min(n, max(k + 1, n // first_depth))  # one more, as the query's own row may be among them
    while len(open_):
        frontier = [np.partition(x, n - depth, axis=0)[n - depth] for x in lists]
        upper = sum(np.maximum(x, f) for x, f in zip(lists, frontier))
        lower = sum(np.where(x >= f, x, e) for x, f, e in zip(lists, frontier, ends))
        able = upper >= np.partition(lower, n - keep, axis=0)[n - keep]
        done = (able.sum(0) <= 4 * keep + n // 256) | (depth == n)
        read[open_] = depth / n
        row, query = np.nonzero(able & done)
        found.append((open_[query], row, sum(x[row, query] for x in lists)))
        open_, depth = open_[~done], min(n, 2 * depth)
        lists, ends = [x[:, ~done] for x in lists], [e[~done] for e in ends]
    query, row, score = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
    query, row = query.astype(np.int64), row.astype(np.int64)
    other = (ids[row] != query_ids[query]) & (score >= least[query])
    return *_best(query[other], ids[row[other]], score[other].astype(np.int64), k), read


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], ids[place < k], score[place < k]


def _plain(ids, values, query_ids, queries, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by integers of any size, for values beyond what doubles hold exactly."""
    values, out = values.astype(object), []
    for q, query in enumerate(queries.astype(object)):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, int(s))), int(i)) for s, i in zip(values @ query, ids) if i != query_ids[q])
        out += [(q, i, -s) for s, i in scores[:k]]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every sound vector."""
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(1 << 62)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(sound)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(rows: pa.Table, d: int) -> np.ndarray:
    return rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _join_runs(rows: pa.Table, asked: pa.Table, k: int, block_rows: int, together: int = 512) -> pa.Table:
    """The k best rows of the run for each query: ``together`` queries at a time pass its blocks and carry their k best so far along."""
    n, m, out = len(rows), len(asked), []
    d = rows["dim"][0].as_py() if n and m else 0
    if d:
        ids, values, all_ids, all_queries = rows["vec_id"].to_numpy(), _matrix(rows, d), asked["vec_id"].to_numpy(), _matrix(asked, d)
        for i in range(0, m, together):
            q_ids, queries = all_ids[i : i + together], all_queries[i : i + together]
            held, read, at, step = (np.zeros(0, np.int64),) * 3, np.zeros(len(q_ids)), 0, max(k + 1, block_rows // 8)
            while at < n:
                query, _, score = held
                count = np.bincount(query, minlength=len(q_ids))
                # the least of k carried scores; fewer don't bound anything
                least = np.where(count == k, score[np.maximum(np.cumsum(count) - 1, 0)] if len(score) else 0, -np.inf).astype(float)
                block = slice(at, at + step)
                *found, share = nra_block(ids[block], values[block], q_ids, queries, k, least)
                held = _best(*(np.concatenate(x) for x in zip(held, found)), k)
                read += share * len(ids[block])
                at, step = at + step, min(block_rows, 2 * step)
            query, found_ids, score = held
            out.append(pa.table({"query_id": q_ids[query], "vec_id": found_ids, "score": score, "read": read[query] / n}))
    return pa.concat_tables(out) if out else pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("read", pa.float64())]).empty_table()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col="vec_id", vec_col="embedding", scale: int = 256, block_rows: int = 2048, chain: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score, read): each query's k best rows of ``vectors``, its own id excepted; ``read`` is
    the share of the sorted lists that was read for the query in the run where the row was found.

    Blocks hold ``block_rows`` rows. A run has about ``chain`` blocks or more, up to ``RUN_VALUES`` values, so a task's memory doesn't
    grow with the tables."""
    rows = settle(quantised(vectors, id_col, vec_col, scale), "vectors")
    asked = settle(quantised(queries, id_col, vec_col, scale), "queries")
    size = lambda d: d.agg(F.count("*"), F.max(F.size("v"))).first()
    (n, d), (m, _) = size(rows), size(asked)
    most = max(chain * block_rows, RUN_VALUES // max(1, d or 1))
    query_runs = -(-m // most) or 1
    row_runs = max(-(-n // most), min(-(-n // (chain * block_rows)), -(-4 * rows.sparkSession.sparkContext.defaultParallelism // query_runs))) or 1
    tasks = min(10_000, row_runs * query_runs)

    def dealt(vectors_: DataFrame, own: str, runs: int, other: str, others: int) -> DataFrame:
        """Each vector in its own run, once for each run of the other side."""
        placed = vectors_.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(runs)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        # one key, else the groups are shuffled again
        run = F.concat_ws(":", F.col("query_run") * row_runs + F.col("row_run"), F.size("v")).alias("run")
        return placed.select(run, F.size("v").alias("dim"), "vec_id", "v").repartition(tasks, "run")

    left, right = dealt(rows, "row_run", row_runs, "query_run", query_runs), dealt(asked, "query_run", query_runs, "row_run", row_runs)
    found = left.groupBy("run").cogroup(right.groupBy("run")).applyInArrow(lambda x, y: _join_runs(x, y, k, block_rows), "query_id long, vec_id long, score long, read double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "read")
