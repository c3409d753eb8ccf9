"""Phrases whose words go together more often than their parts do, by language.

All 1 to max_n grams are counted within tasks, some megabytes of text at a time, and the tasks' counts are summed by hash aggregation:
first by a hash of each gram, dealt over groups that mark the frequent ones, then by the phrases themselves, of frequent hashes only. A
phrase scores by the cut that explains it best: counts of the parts are joined on, and arithmetic is in Decimal. A phrase that mostly
occurs inside of one that is longer by a word goes by an anti-join; windows rank the rest."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import UPPER, freeing, settle

#: 1: blanks between words; 2: marks and line ends between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b"\x20\x09")] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Bytes of a language's texts that are counted together in a task.
TOGETHER = 1 << 23
#: Groups that hashes are dealt over by their first 10 bits, and the bits below of a hash that counts leave out.
GROUPS, COUNT_BITS = 1 << 10, 22
#: Counts as whole numbers whose products stay exact: below 10^15 each, and 10^38 at most together.
COUNT = "decimal(15,0)"


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def _hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word, none of them empty."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    size = np.diff(offsets)
    powers = np.cumprod(np.full(size.max(), 0x9E3779B97F4A7C15, np.uint64))
    terms = BYTES[np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]] * powers[np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)]
    return _mixed(np.add.reduceat(terms, offsets[:-1]) + size.astype(np.uint64))


def _words(text: bytes) -> tuple[pa.StringArray, np.ndarray]:
    """The words in lower case (A-Z), and whether each but the last is followed by the next within its piece."""
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    kind = KIND[data]
    inside = kind == 0
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    marks = np.cumsum(kind == 2, dtype=np.int32)[starts]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])), marks[1:] == marks[:-1]


def _grams(lang: str, text: bytes, max_n: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """For 1 to ``max_n`` words: the distinct grams as columns of places among the names of words, their exact counts and hashes of (lang, gram)."""
    words, follows = _words(text)
    if not len(words):
        return
    coded = words.dictionary_encode()
    ids, names = coded.indices.to_numpy().astype(np.uint64), coded.dictionary
    own = _hashes(names)
    # a key is the place of a first part among its columns, and the words after it in ``width`` bits each
    width, at, keys = np.uint64(max(1, (len(names) - 1).bit_length())), np.arange(len(ids)), ids
    part, part_hashes, part_bits, after = [np.arange(len(names))], _mixed(own + _hashes(pa.array([f"{lang} "]))[0]), int(width), 0
    for n in range(1, max_n + 1):
        if n > 1:
            if part_bits + (after + 1) * int(width) > 64:
                coded = pa.array(keys).dictionary_encode()
                keys, part, part_hashes = coded.indices.to_numpy().astype(np.uint64), *unpacked(coded.dictionary.to_numpy())
                part_bits, after = max(1, (len(part_hashes) - 1).bit_length()), 0
            fits = at < len(ids) - n + 1
            fits[fits] = follows[at[fits] + n - 2]
            at = at[fits]
            keys, after = keys[fits] << width | ids[at + n - 1], after + 1

        def unpacked(keys: np.ndarray, after: int = after, part: list = part, part_hashes: np.ndarray = part_hashes) -> tuple[list, np.ndarray]:
            first = keys >> np.uint64(after) * width
            columns, hashes = [c[first] for c in part], part_hashes[first]
            for k in range(after - 1, -1, -1):
                columns.append((keys >> np.uint64(k) * width & (np.uint64(1) << width) - np.uint64(1)).astype(np.int64))
                hashes = _mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + own[columns[-1]])
            return columns, hashes

        ordered = np.sort(keys)
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
        columns, hashes = unpacked(ordered[begins])
        yield [(names, c) for c in columns], np.diff(begins, append=len(ordered)), hashes


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """The texts of each language, ``TOGETHER`` bytes or a text at a time, as lines."""
    held, size = defaultdict(list), Counter()

    def taken(lang: str) -> tuple[str, bytes]:
        del size[lang]
        return lang, b"\n".join(held.pop(lang))

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            held[lang].append(text)
            size[lang] += len(text) + 1
            if size[lang] >= TOGETHER:
                yield taken(lang)
        while sum(size.values()) >= 2 * TOGETHER:
            yield taken(max(size, key=size.get))
    while size:
        yield taken(next(iter(size)))


@freeing
def _dealt(batches: Iterator[pa.RecordBatch], max_n: int, least: int) -> Iterator[pa.RecordBatch]:
    """(slot, packed): hashes and counts (up to ``least``) of a task's grams in ascending order, a row for each group."""
    for lang, text in _texts(batches):
        packed = [h & ~np.uint64((1 << COUNT_BITS) - 1) | np.minimum(count, least).astype(np.uint64) for _, count, h in _grams(lang, text, max_n)]
        if packed:
            packed = np.sort(np.concatenate(packed))
            ends = np.searchsorted(packed, np.arange(1, GROUPS, dtype=np.uint64) << np.uint64(54))
            offsets = 8 * np.concatenate([[0], ends, [len(packed)]]).astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), GROUPS, [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            yield pa.record_batch({"slot": np.arange(GROUPS, dtype=np.int32), "packed": values}).filter(pa.array(np.diff(offsets) > 0))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a hash's group among ``bits``, from its bits that counts leave in."""
    own, mask = hashes >> np.uint64(54), np.uint64(bits // GROUPS - 1)
    first, second = hashes >> np.uint64(36) & mask, hashes >> np.uint64(COUNT_BITS) & mask
    return own * np.uint64(bits // GROUPS) + first, own * np.uint64(bits // GROUPS) + second


def _marked(rows: pa.Table, least: int, bits: int) -> pa.Table:
    """(slot, bits) of one group: the bits of the hashes that count ``least`` or more."""
    packed = np.sort(np.frombuffer(b"".join(rows["packed"].to_pylist()), np.uint64))
    hashes = packed >> np.uint64(COUNT_BITS)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    often = packed[first][np.add.reduceat(packed & np.uint64((1 << COUNT_BITS) - 1), first) >= least]
    marks = np.zeros(bits // GROUPS, np.uint8)
    for place in _places(often, bits):
        marks[place & np.uint64(bits // GROUPS - 1)] = 1
    return pa.table({"slot": rows["slot"][:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()])})


@freeing
def _counted(batches: Iterator[pa.RecordBatch], max_n: int, shared, bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, f): a task's counts of the grams whose hashes are marked, and of all words under the empty phrase."""
    marks = np.frombuffer(shared.value, np.uint8) if shared else None
    for lang, text in _texts(batches):
        for n, (columns, count, h) in enumerate(_grams(lang, text, max_n), 1):
            if n == 1:
                yield pa.record_batch({"lang": [lang], "phrase": [""], "size": pa.array([0], pa.int32()), "f": [int(count.sum())]})
            often = np.arange(len(h))
            for place in _places(h, bits) if shared else ():
                often = often[marks[place[often] >> np.uint64(3)] >> (place[often] & np.uint64(7)).astype(np.uint8) & 1 == 1]
            for i in range(0, len(often), 1 << 16):
                some = often[i : i + (1 << 16)]
                phrase = pc.binary_join_element_wise(*(names.take(pa.array(c[some])) for names, c in columns), " ")
                yield pa.record_batch({"lang": pa.array([lang] * len(some)), "phrase": phrase, "size": np.full(len(some), n, np.int32), "f": count[some]})


def phrase_counts(docs: DataFrame, max_n: int, min_count: int, bits: int = 1 << 28) -> DataFrame:
    """(lang, phrase, size, f): all grams that occur ``min_count`` times or more, with their exact counts, and the empty one for all words.

    Counts by hash come first: most grams are rare, and a number takes a fraction of a phrase's place in the shuffle. A hash counts
    at least what each of its phrases does, so none is lost; phrases under frequent hashes are then counted by themselves. Frequent
    hashes are marked among ``bits`` bits that are sent to all tasks; rare ones that share their bits cost time only. Without bits all
    phrases are counted by themselves."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    shared, least = None, min(min_count, (1 << COUNT_BITS) - 1)
    if bits:
        marked = rows.mapInArrow(lambda x: _dealt(x, max_n, least), "slot int, packed binary").groupBy("slot").applyInArrow(lambda x: _marked(x, least, bits), "slot int, bits binary")
        marks = bytearray(bits // 8)
        for r in marked.collect():
            marks[r.slot * len(marks) // GROUPS : (r.slot + 1) * len(marks) // GROUPS] = r.bits
        shared = rows.sparkSession.sparkContext.broadcast(bytes(marks))
    counted = rows.mapInArrow(lambda x: _counted(x, max_n, shared, bits), "lang string, phrase string, size int, f long")
    out = settle(counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "phrase-counts")
    if shared:
        shared.unpersist()
    return out


def _part(words: str, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def best_cuts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, k, l, r, score) of phrases of two words or more: the cut after k words with the lowest score.

    Parts occur as often as the phrase or more, so they are among ``counts``."""
    split = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", "size", "f", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", F.col("f").alias("a"), "k", _part("w", F.lit(1), F.col("k")).alias("left"), _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = lambda part, out: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(out))
    met = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    d = {c: F.col(c).cast(COUNT) for c in "alr"}
    met = met.withColumns({"_up": (d["a"] * d["a"]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), "_down": d["l"] * d["r"]})
    best = F.min(F.struct(F.expr("_up div _down").alias("score"), "k", "l", "r")).alias("best")
    return met.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.k", "best.l", "best.r", "best.score")


def uncovered(scored: DataFrame, covered: int = 50) -> DataFrame:
    """``scored`` without phrases of which ``covered`` percent or more lie inside of one longer phrase.

    A phrase inside of a much longer one lies in its one-word extension, which is at least as frequent; so extensions are enough."""
    long_ = scored.where("size > 2").select("lang", F.col("a").alias("longer"), "size", F.split("phrase", " ").alias("w"))
    inner = long_.select("lang", "longer", F.explode(F.array(_part("w", F.lit(1), F.col("size") - 1), _part("w", F.lit(2), F.col("size") - 1))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return scored.join(most, (scored["lang"] == most["lang"]) & (scored["phrase"] == most["phrase"]) & (100 * most["longer"] >= covered * scored["a"]), "left_anti")


def first_by_lang(rows: DataFrame, order: list[Column], top: int, together: int = 16) -> DataFrame:
    """The first ``top`` rows of each lang and their ``rank``. Parts of a lang are ranked apart, and the best of ``together`` parts meet
    until one is left, so that no task gets more of a lang than a part or ``together`` times ``top`` rows."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int"))
    while True:
        rank = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= top)
        if parts == 1:
            return rows.drop("_part")
        parts = -(-parts // together)
        rows = rows.drop("rank").withColumn("_part", F.pmod("_part", F.lit(parts)))


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """docs(lang, text) -> (lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut at punctuation marks and line ends, and pieces at blanks and tabs. A phrase of 2 to ``max_n`` words
    that occurs a >= ``min_count`` times scores floor(1000000 * a * a / (l * r)) by its lowest cut into parts that occur l and r times; n is
    the language's number of words. Order: score and a falling, then the phrase by its bytes.

    A null lang is ``und``; a null text is empty. Empty texts, empty tables and texts of punctuation give no phrases. Repeated rows
    count each time. Other columns, whatever their names, are left aside. Counts must stay below 10^15 (else it raises)."""
    counts = phrase_counts(docs.select("lang", "text"), max_n, min_count)
    kept = uncovered(settle(best_cuts(counts), "phrase-scores"), covered)
    ranked = first_by_lang(kept, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
