"""Model calls that aren't repeated."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.operators import calls, linking
from textloom.sources.files import opened


def counting(folder, dies=None):
    """A provider that leaves a file for each call, and ends its process at one prompt, once."""

    def provider(prompt, n):
        with open(f"{folder}/calls", "a") as out:
            out.write(prompt + "\n")
        if prompt == dies and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        if prompt == "never":
            raise ValueError("no answer")
        return f"{prompt}/{n}"

    return provider


def asked(folder):
    return sorted(open(f"{folder}/calls").read().split())


def test_a_lost_task_repeats_its_open_batch_only(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("key"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit(7).alias("num_predict"), F.lit("old").alias("made"))
    log = str(tmp_path / "log")
    with pytest.raises(Exception):  # noqa: B017
        calls.logged_calls(rows, counting(tmp_path, "p31"), log, batch=4, wait=0).collect()
    before = asked(tmp_path)
    got = calls.logged_calls(rows, counting(tmp_path), log, batch=4, wait=0)
    assert {r.prompt: r.answer for r in got.collect()} == {f"p{k}": f"p{k}/7" for k in range(60)} and got.columns == [*rows.columns, "answer"]
    again = len(asked(tmp_path)) - 60
    assert 1 <= again <= 4 * 4 and again < len(before)  # the open batches of four tasks at most
    total = len(asked(tmp_path))
    calls.logged_calls(rows, counting(tmp_path), log, batch=4, wait=0).collect()
    assert len(asked(tmp_path)) == total
    calls.logged_calls(rows.limit(3), counting(tmp_path), log, model="another", batch=4, wait=0).collect()
    assert len(asked(tmp_path)) == total + 3


def test_failed_null_and_repeated_prompts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("never", 1), (None, 1), ("", 1)], "prompt string, num_predict int")
    log = str(tmp_path / "log")
    for k in (1, 2):
        got = [tuple(r) for r in calls.logged_calls(rows, counting(tmp_path), log, attempts=2, wait=0).collect()]
        assert sorted(got, key=str) == sorted([("a", 1, "a/1"), ("a", 1, "a/1"), ("a", 2, "a/2"), ("never", 1, None), (None, 1, None), ("", 1, "/1")], key=str)
        assert asked(tmp_path) == sorted(["a", "a", *["never"] * 2 * k])
    assert calls.logged_calls(rows.limit(0), counting(tmp_path), log).count() == 0


def test_a_batch_is_found_by_its_place(tmp_path):
    files, root = opened(f"file:{tmp_path}")
    rows = [(f"k{i}", f"p{i}", 1) for i in range(5)]
    assert calls.call_batch(files, f"{root}/x.parquet", rows[:3], lambda k, p, n: None if k == "k1" else p) == 3
    assert calls.call_batch(files, f"{root}/x.parquet", rows[:3], lambda k, p, n: p) == 1
    assert calls.call_batch(files, f"{root}/x.parquet", rows[:3], lambda k, p, n: 1 / 0) == 0


def test_spans_of_one_model_pass(spark, tmp_path):
    text = "Al is here. bo\nsaw Cy! "
    rows = [("A", 1, text), ("A", 2, None), ("B", 1, ""), ("A", 3, "no Names without a stop"), *[("B", k, "Xy. " * 20) for k in range(10, 30)]]

    def load():
        import re

        def model(texts):
            with open(f"{tmp_path}/runs", "a") as out:
                out.write(f"{sum(map(len, texts))} {len(texts)}\n")
            # the last text's entity lies outside of its sentences
            return [([(*m.span(), "NAME") for m in re.finditer("[A-Z][a-z]+", t)], [m.span() for m in re.finditer("[^.!?]+[.!?]", t)]) for t in texts]

        return model

    docs = spark.createDataFrame(rows, "corpus string, case_id int, text string").coalesce(1)
    spans = linking.recognised_spans(docs, load, batch_chars=200).cache()
    got = {(r.kind, r.i, r.start, r.end, r.text, r.label) for r in spans.where("corpus = 'A'").collect()}
    assert got == {
        ("sentence", 0, 0, 11, "Al is here.", None), ("sentence", 1, 11, 22, " bo\nsaw Cy!", None), ("entity", 0, 0, 2, "Al", "NAME"), ("entity", 1, 19, 21, "Cy", "NAME"), ("entity", None, 3, 8, "Names", "NAME"),
    }
    runs = [tuple(map(int, line.split())) for line in open(f"{tmp_path}/runs")]
    assert sum(n for _, n in runs) == len(rows) and max(size for size, _ in runs) <= 200
    assert {(r.prefix, r.i, r.text) for r in linking.sentences_of(spans, "A").collect()} == {(1, 0, "Al is here."), (1, 1, "bo\nsaw Cy!")}
    held = {(r.case_id, r.entity, r.i, r.sentence, r.n) for r in linking.entities_of(spans).where("corpus = 'A'").collect()}
    assert held == {(1, "al", 0, "Al is here.", 1), (1, "cy", 1, " bo\nsaw Cy!", 1), (3, "names", None, None, 1)}
    assert linking.entities_of(spans).where("corpus = 'B'").agg(F.sum("n")).first()[0] == 400


def test_tasks_hold_bounded_parts_of_a_batch(spark, monkeypatch):
    """However many spans the texts of a batch have, a frame holds few of them, and the rows are the same."""
    rows = [("A", k, "Xy Zz. " * 400) for k in range(60)]
    docs = spark.createDataFrame(rows, "corpus string, case_id int, text string").coalesce(1)

    def load():
        import re

        return lambda texts: [([(*m.span(), "NAME") for m in re.finditer("[A-Z][a-z]+", t)], [m.span() for m in re.finditer("[^.]+[.]", t)]) for t in texts]

    def names():
        return lambda texts: [["Xy", "Zz"] * 400 for _ in texts]

    frames, made = [], type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, find, schema: frames.append(find) or made(self, find, schema))
    linking.recognised_spans(docs, load), linking.recognised_entities(docs, names)
    for find, want in zip(frames, (60 * 1200, 60 * 800)):
        sizes = [len(f) for f in find(iter([docs.toPandas()]))]
        assert sum(sizes) == want and max(sizes) <= 10_000
    monkeypatch.undo()
    assert {(r.kind, r["count"]) for r in linking.recognised_spans(docs, load).groupBy("kind").count().collect()} == {("entity", 48_000), ("sentence", 24_000)}
    assert {(r.entity, r.n) for r in linking.recognised_entities(docs, names).select("entity", "n").collect()} == {("xy", 400), ("zz", 400)}
