"""Model calls that a lost task or a second run doesn't repeat: each finished batch is in a log before the next one begins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import settled
from textloom.sources.files import opened

LOG = "key string, answer string"


def call_key(prompt: Column, num_predict: Column, model: str) -> Column:
    """The same call has the same key in every run."""
    return F.sha2(F.concat_ws("\u0001", F.lit(model), num_predict.cast("string"), prompt), 256)


def _read(files: fs.FileSystem, path: str) -> dict[str, str]:
    if files.get_file_info(path).type != fs.FileType.File:
        return {}
    with files.open_input_file(path) as source:
        rows = pq.read_table(source).to_pydict()
    return dict(zip(rows["key"], rows["answer"]))


def _write(files: fs.FileSystem, path: str, answers: dict[str, str]) -> None:
    """Under its name only when whole."""
    part = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        pq.write_table(pa.table({"key": pa.array(list(answers), pa.string()), "answer": pa.array(list(answers.values()), pa.string())}), out)
    files.move(part, path)


def answered(key: str, prompt: str, n: int, provider: Callable[[str, int], str], attempts: int, wait: float) -> str | None:
    import time

    for k in range(attempts):
        try:
            return provider(prompt, n)
        except Exception:
            if k + 1 < attempts:
                time.sleep(wait * (k + 1))
    return None


def call_batch(files: fs.FileSystem, path: str, rows: list[tuple[str, str, int]], call: Callable[[str, str, int], str | None], pace: float = 0.0) -> int:
    """Answer (key, prompt, num_predict) and log them under ``path``; what is logged there is not asked again. The number of calls."""
    import time

    known, made = _read(files, path), 0
    answers = {key: known[key] for key, _, _ in rows if key in known}
    for key, prompt, n in rows:
        if key in answers:
            continue
        if made and pace:
            time.sleep(pace)
        made += 1
        answer = call(key, prompt, n)
        if answer is not None:
            answers[key] = answer
    if made:
        _write(files, path, answers)
    return made


def logged_calls(rows: DataFrame, provider: Callable[[str, int], str], log: str, model: str = "", batch: int = 8, attempts: int = 3, wait: float = 2.0, pace: float = 0.0) -> DataFrame:
    """rows(prompt, num_predict, ...) and ``answer``; calls are made now, and only those that the folder ``log`` doesn't hold.

    A call is known by its prompt, its limit and the model; the same one in several rows is made once. Each task logs after ``batch``
    calls, with ``pace`` seconds between them. A task that is run again finds its batches by their place; a later run leaves out all
    logged calls. Calls that fail ``attempts`` times have a null answer and are made again by the next run, as has a null prompt, which
    is never asked. ``log`` must be a folder that all machines share."""
    spark = rows.sparkSession
    files, root = opened(log)
    files.create_dir(root)
    key = call_key(F.col("prompt"), F.col("num_predict"), model)
    history = lambda: spark.read.schema(LOG).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(log)
    asked = rows.where("prompt is not null").groupBy(key.alias("key")).agg(F.any_value("prompt").alias("prompt"), F.any_value("num_predict").alias("num_predict"))
    # a table of files: a task that is run again gets the same rows in the same order
    pending = settled(asked.join(history().select("key").distinct(), "key", "left_anti"), "calls")
    run = f"{root}/{uuid.uuid4().hex}"
    files.create_dir(run)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, _ = opened(log)
        part, k, waiting, made = TaskContext.get().partitionId(), 0, [], 0
        call = lambda key, prompt, n: answered(key, prompt, n, provider, attempts, wait)
        for frame in batches:
            for row in frame.itertuples(index=False):
                waiting.append((row.key, row.prompt, int(row.num_predict)))
                if len(waiting) == batch:
                    made, k, waiting = made + call_batch(target, f"{run}/{part:06d}-{k:06d}.parquet", waiting, call, pace), k + 1, []
        if waiting:
            made += call_batch(target, f"{run}/{part:06d}-{k:06d}.parquet", waiting, call, pace)
        yield pd.DataFrame({"made": [made]})

    pending.mapInPandas(work, "made long").agg(F.sum("made")).collect()
    answers = history().groupBy("key").agg(F.min("answer").alias("answer"))
    return rows.withColumn("_key", key).join(answers.withColumnRenamed("key", "_key"), "_key", "left").select(*[F.col(f"`{c}`") for c in rows.columns], "answer")
