"""Line dedup: repeated runs of lines by a suffix array over line ids, DataFrame functions only.

Every document is a sequence of line ids (128-bit hashes), one row for each position. Prefix doubling over these rows names the 2^j-line
prefixes of all suffixes: the name for twice the length is the pair of a row's name and of that 2^j rows on. Suffixes with the same name of
depth m form an interval of the suffix array whose longest common prefix is at least m lines; any order of the ids gives the same
intervals, so they are found by grouping and no global sort is needed. In each interval the first suffix (by document,
then line) is the original and the others start later copies.

A repeated run counts where it holds at least ``min_words`` words. Which lines such runs cover is decided at the
shortest windows that reach ``min_words``: those that start at a line, and those that end at it. A window lies
in an interval with an earlier suffix exactly if some countable run of a later copy holds it, and the union of the
windows is the union of these maximal runs. The later copies' runs are cut from the text.

Doubling goes as deep as the longest such window, in the documents that have windows of several lines; rows of a document stay rows, so
its length bounds nothing in memory. Shuffled are only ids, names and positions, and the texts once at
the end to meet their runs. Grouping combines on the map side; the join back to the windows is one that Spark can split.

Defined results: a null text stays null and has no lines; an empty text is one empty line; lines are compared
as they are; rows that repeat both id and text are one document, so they come out alike; a null id sorts first;
columns of any other name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, settle

RUNS = "array<struct<start:int,end:int>>"


def _key(id_col: str, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"_k1": F.xxhash64(id_col, text), "_k2": F.xxhash64(F.lit(11), id_col, text)}


def _words(line: Column) -> Column:
    """Words parted by white space; a line of a script without blanks has one for each twenty characters at least."""
    return F.greatest(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), F.floor(F.length(line) / 20).cast("int"))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, pos, h1, h2, words): one row for each line of each distinct document."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), *(c.alias(n) for n, c in _key(id_col, text_col).items()), F.split(F.col(text_col), "\n").alias("lines"))
    rows = rows.select("_id", "_k1", "_k2", F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("_id", "_k1", "_k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), _words(F.col("line")).alias("words"))
    return rows.repartition("_k1", "_k2").dropDuplicates(["_k1", "_k2", "pos"])


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(k1, k2, start, size) of the shortest windows with ``min_words`` words, from each line on and up to each line."""
    own = Window.partitionBy("_k1", "_k2")
    upto = F.sum("words").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    sums = lines.select("_k1", "_k2", "pos", upto.alias("upto"), (upto - F.col("words")).alias("before"))

    def nearest(value: Column, asked: Column, order: list[Column]) -> DataFrame:
        """For each line the last position met before its question, in the order of the values."""
        events = F.array(F.struct(value.alias("v"), F.lit(1).alias("given"), F.col("pos").alias("at")), F.struct(asked.alias("v"), F.lit(0).alias("given"), F.col("pos").alias("at")))
        rows = sums.select("_k1", "_k2", F.explode(events).alias("e")).select("_k1", "_k2", "e.*")
        last = F.last(F.when(F.col("given") == 1, F.col("at")), ignorenulls=True).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("found", last).where("given = 0 and found is not null")

    # from the largest sum down: the last line end at or above the question is the first that reaches min_words
    ahead = nearest(F.col("upto"), F.col("before") + min_words, [F.desc("v"), F.desc("given"), F.desc("at")])
    back = nearest(F.col("before"), F.col("upto") - min_words, [F.asc("v"), F.desc("given"), F.asc("at")])
    ahead = ahead.select("_k1", "_k2", F.col("at").alias("start"), (F.col("found") - F.col("at") + 1).alias("size"))
    back = back.select("_k1", "_k2", F.col("found").alias("start"), (F.col("at") - F.col("found") + 1).alias("size"))
    return ahead.unionByName(back).where("size > 0").distinct()


def _pair(a: Column, b: Column, extra: Column) -> Column:
    return F.struct(F.xxhash64(extra, a["h1"], b["h1"], a["h2"], b["h2"]).alias("h1"), F.xxhash64(F.lit(13), extra, a["h2"], b["h2"], a["h1"], b["h1"]).alias("h2"))


def _named(lines: DataFrame, windows: DataFrame, levels: int) -> DataFrame:
    """The windows with the names of what they hold: two names of 2^j lines, from its start and up to its end, cover a window of up to 2^(j + 1) lines."""
    doc = ["_k1", "_k2"]
    at = lambda rows, place: rows.withColumnRenamed("pos", place)
    single = windows.where("size = 1").join(at(lines, "start"), [*doc, "start"])
    single = single.select("_id", *doc, "start", "size", "h1", "h2")
    if not levels:
        return single
    several = windows.where("size > 1")
    own = Window.partitionBy(*doc).orderBy("pos")
    rows = lines.join(several.select(*doc).distinct(), doc, "left_semi").select("_id", *doc, "pos", F.struct("h1", "h2").alias("n0"))
    for j in range(levels):
        ahead = F.lead(f"n{j}", 1 << j).over(own)
        rows = rows.withColumn(f"n{j + 1}", F.when(ahead.isNotNull(), _pair(F.col(f"n{j}"), ahead, F.lit(0))))
    rows = settle(rows.select("_id", *doc, "pos", F.array(*(f"n{j}" for j in range(levels + 1))).alias("names")), "suffix-names")
    level = F.floor(F.log2("size")).cast("int")
    asked = several.withColumn("level", level).withColumn("last", F.expr("cast(start + size - shiftleft(1, level) as int)"))
    met = asked.join(at(rows, "start"), [*doc, "start"]).join(at(rows, "last").select(*doc, "last", F.col("names").alias("ends")), [*doc, "last"])
    name = _pair(F.get("names", F.col("level")), F.get("ends", F.col("level")), F.col("size"))
    return single.unionByName(met.select("_id", *doc, "start", "size", name.alias("n")).select("_id", *doc, "start", "size", "n.h1", "n.h2"))


def repeated_runs(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 5) -> DataFrame:
    """(k1, k2, runs): the maximal runs of lines of each document that are later copies."""
    lines = settle(line_table(docs, id_col, text_col), "lines")
    windows = settle(_windows(lines.repartition("_k1", "_k2"), min_words), "line-windows")
    longest = windows.agg(F.max("size")).first()[0] or 1
    named = settle(_named(lines, windows, longest.bit_length() - 1), "named-windows")
    first = named.groupBy("h1", "h2", "size").agg(F.min(F.struct("_id", "_k1", "_k2", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = settle(first.select("h1", "h2", "size", F.col("first._k1").alias("f1"), F.col("first._k2").alias("f2"), F.col("first.start").alias("f3")), "intervals")
    original = (F.col("_k1") == F.col("f1")) & (F.col("_k2") == F.col("f2")) & (F.col("start") == F.col("f3"))
    later = named.join(first, ["h1", "h2", "size"]).where(~original).select("_k1", "_k2", "start", (F.col("start") + F.col("size")).alias("end"))
    later = later.groupBy("_k1", "_k2", "start").agg(F.max("end").alias("end"))
    own = Window.partitionBy("_k1", "_k2").orderBy("start")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", (reached.isNull() | (reached < F.col("start"))).cast("int")).withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("_k1", "_k2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = settle(runs.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).cast(RUNS).alias("runs")), "runs")
    discard(lines, windows, named, first)
    return runs


def _cut(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(row, text, runs, lines): each row whole, as a struct, the text without the later copies, the runs cut from it, the lines it had."""
    found = repeated_runs(docs, id_col, text_col, min_words)
    keyed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in _key(id_col, text_col).items()))
    met = keyed.join(found, ["_k1", "_k2"], "left").withColumn("lines", F.split("text", "\n"))
    runs, lines = F.col("runs"), F.col("lines")
    start = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    stop = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(start.alias("a"), stop.alias("b")), lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))
    text = F.when(runs.isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    nothing = F.array().cast(RUNS)
    # a null array has size -1 or null, as the session is set
    return met.select("row", text.alias("text"), F.when(F.col("text").isNotNull(), F.coalesce(runs, nothing)).otherwise(nothing).alias("runs"), F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)).alias("lines"))


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 5, out="removed_runs", count="n_lines") -> DataFrame:
    """All rows of ``docs``; the text without the later copies, the runs cut from it (start, end before), the lines it had.

    Columns named ``out`` or ``count`` are replaced, all others are kept."""
    made = _cut(docs, id_col, text_col, min_words)
    kept = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in (out, count)]
    return made.select(*kept, F.col("runs").alias(out), F.col("lines").alias(count))


def n_removed(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0), lambda a, r: a + r["end"] - r["start"])


def drop_copied_lines(docs: DataFrame, min_words: int = 5, id_col="doc_id", text_col="text", chars_col="n_chars") -> DataFrame:
    """The documents' columns with the later copies cut; documents of which nothing is left go."""
    made = _cut(docs, id_col, text_col, min_words).where((n_removed(F.col("runs")) < F.col("lines")) | (F.col("lines") == 0))
    new = {text_col: F.col("text")}
    if chars_col in docs.columns:
        new[chars_col] = F.length("text").cast(docs.schema[chars_col].dataType)
    return made.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


#: The same in DuckDB: windows by a self-join, held against each other as texts.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(list_transform(lines, lambda x: greatest(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')), length(x) // 20))) AS words FROM d),
s AS (SELECT doc_id, pos, sum(words) OVER w AS upto, sum(words) OVER w - words AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
w AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.upto >= a.before + 5 AND b.pos >= a.pos GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.before <= b.upto - 5 AND b.pos >= a.pos GROUP BY b.doc_id, b.pos),
c AS (SELECT w.doc_id, s, e, array_to_string(lines[s + 1:e + 1], chr(10)) AS body FROM w JOIN d USING (doc_id)),
r AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY body, e - s ORDER BY doc_id, s) AS nth FROM c),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM r WHERE nth > 1),
kept AS (SELECT d.doc_id, x.pos, lines[x.pos + 1] AS line FROM d, (SELECT doc_id, pos FROM l EXCEPT SELECT doc_id, pos FROM gone) x WHERE d.doc_id = x.doc_id),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(lines)::INTEGER AS n_lines, (len(lines) - coalesce(n, 0))::INTEGER AS n_removed, md5(coalesce(body, '')) AS text_md5 FROM d LEFT JOIN t USING (doc_id)
"""
