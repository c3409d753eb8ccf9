"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and benchmark items are sequences of lower-cased words. A document is contaminated where a stretch of it
is within ``max_rate`` word edits per item word of an item. Windows as long as the item are taken at every word of
the whole text; the q-gram lemma first discards, without loss, windows with too few of the items' word pairs. The CGK
random walk (Chakraborty, Goldenberg, Koucky 2016) maps a window to three times its length, so that few edits
become few differing places; ``samples`` sampled places are an LSH key, and as many repetitions are drawn as the
target recall needs. Windows and items that share a key in any repetition are verified by a banded edit distance
with a free end. A window walks only as long as an item is open to it: one whose pairs it has enough of (the lemma
again, item by item), that it has not met, and of which no exact copy overlaps it.

The items are broadcast in blocks of bounded size; every block meets every document in a map over the documents, which
needs no shuffle and no state.

Defined results: null or empty texts have no spans; null or empty items match nothing; items of fewer than ``min_words``
words, which ordinary text holds by chance, match the texts that consist of their words and nothing else; repeated documents
and items give a span each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import freeing

NOT_WORD = re.compile(r"\W+")
SPAN = "array<struct<item_id:long,start_word:int,end_word:int,edits:int>>"
#: Words of all windows that are looked at together.
CELLS = 2_000_000
FREE = np.uint64(0x9E3779B97F4A7C15)


def repetitions(max_rate: float, samples: int, recall: float) -> int:
    """So many draws that a pair at the largest distance meets in one of them with probability ``recall``.

    After an edit the two pointers drift until they meet again; on random strings with the most edits the walks agree at
    about 1 / (1 + 6 max_rate) of the places."""
    agree = (1 / (1 + 6 * max_rate)) ** samples
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def words_of(text: str | None) -> list[str]:
    """Lower-cased words at white space, without their signs; what is only signs is no word."""
    return [w for w in (NOT_WORD.sub("", w) for w in (text or "").lower().split()) if w]


class Numbers(dict):
    """Raw word -> number in the vocabulary, 0 for words of no item, -1 for mere signs. Forgets when it grows large."""

    def __init__(self, vocabulary: dict[str, int], most: int = 200_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word = raw if raw.isalnum() else NOT_WORD.sub("", raw)
        self[raw] = number = self.vocabulary.get(word, 0) if word else -1
        return number

    def of(self, text: str | None) -> np.ndarray:
        raw = (text or "").lower().split()
        ids = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        return ids[ids >= 0]


class ItemIndex:
    """The items of a block, grouped by their number of words, with their LSH keys."""

    def __init__(self, items: list[tuple[int, str]], max_rate: float, min_words: int, samples: int, recall: float, seed: int = 7):
        self.vocabulary: dict[str, int] = {}
        rows = [(i, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64)) for i, t in items if i is not None and t]
        #: the words of a short item -> its ids
        self.short: dict[tuple[int, ...], list[int]] = {}
        for i, w in rows:
            if 0 < len(w) < min_words:
                self.short.setdefault(tuple(w.tolist()), []).append(i)
        rows = [(i, w) for i, w in rows if len(w) >= min_words]
        self.size, self.max_rate = len(self.vocabulary) + 1, max_rate
        pairs = [w[:-1] * self.size + w[1:] for _, w in rows]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.most_short = max((len(w) for w in self.short), default=0)
        self.groups, self.reach = [], 0
        for n in sorted({len(w) for _, w in rows}):
            own = [(i, w) for i, w in rows if len(w) == n]
            words = np.stack([w for _, w in own])
            rng = np.random.default_rng([seed, n])
            places = [np.sort(rng.choice(3 * n, min(samples, 3 * n), replace=False)) for _ in range(repetitions(max_rate, samples, recall))]
            salts = rng.integers(1, 2**63, (len(places), 3 * n), dtype=np.int64).astype(np.uint64) | np.uint64(1)
            tables = []
            # short walks first: what they find needs no long ones
            for p, s in sorted(zip(places, salts), key=lambda x: int(x[0][-1])):
                keys = embed(words, p, s)
                order = np.argsort(keys, kind="stable")
                tables.append((p, s, keys[order], order))
            slots = np.searchsorted(self.pairs, words[:, :-1] * self.size + words[:, 1:])
            #: each pair of the group once for each item that has it
            held = np.unique(slots * len(own) + np.arange(len(own))[:, None])
            #: longest window: what lies between two texts
            self.reach = n + int(max_rate * n)
            self.groups.append((n, int(max_rate * n), np.array([i for i, _ in own]), words, tables, held))


def embed(words: np.ndarray, places: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A key of each row: its CGK walk at the sampled places. Past its end a row reads 0."""
    rows, n = words.shape
    flat = np.concatenate([words, np.zeros((rows, 1), words.dtype)], 1).astype(np.uint64).ravel()
    at, end, key = np.arange(rows) * (n + 1), np.arange(rows) * (n + 1) + n, np.zeros(rows, np.uint64)
    sampled = set(places.tolist())
    for j in range(int(places[-1]) + 1 if len(places) else 0):
        symbol = flat.take(at)
        if j in sampled:
            key = (key ^ symbol) * FREE + np.uint64(j)
        symbol += np.uint64(1)
        symbol *= salts[j]
        symbol >>= np.uint64(63)
        at += symbol.view(np.int64)
        np.minimum(at, end, out=at)
    return key


def edit_distance(items: np.ndarray, windows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the least edits from an item to a prefix of a window of n + most words, and that prefix's length."""
    rows, n = items.shape
    item, window = np.ascontiguousarray(items.T.astype(np.int32)), np.ascontiguousarray(windows.T.astype(np.int32))
    big, width = np.int16(min(n + most + 1, 30_000)), 2 * most + 1  # in row d is the column of window word i + d - most
    before = np.full((width, rows), big, np.int16)
    before[most:] = np.arange(most + 1, dtype=np.int16)[:, None]
    for i in range(1, n + 1):
        now = np.full((width, rows), big, np.int16)
        for d in range(max(0, most - i), width):
            j, best = i + d - most, now[d]
            if d + 1 < width:
                np.add(before[d + 1], 1, out=best)
            if j >= 1:
                np.minimum(best, before[d] + (item[i - 1] != window[j - 1]), out=best)
                if d:
                    np.minimum(best, now[d - 1] + np.int16(1), out=best)
            np.minimum(best, big, out=best)
        before = now
    ends = n + np.arange(width) - most
    pick = before.argmin(0)
    return before[pick, np.arange(rows)].astype(np.int64), ends[pick]


def spans(texts: list[str | None], index: ItemIndex, numbers: Numbers | None = None) -> list[list[dict]]:
    """For each text all its stretches near an item; of overlapping ones for the same item, the closest.

    The words of the texts lie in one array, with so many zeros between two texts that no window spans both."""
    out: list[list[dict]] = [[] for _ in texts]
    if not texts:
        return out
    numbers, reach = Numbers(index.vocabulary) if numbers is None else numbers, index.reach
    gap, parts, bounds, at = np.zeros(reach, np.int64), [], [], 0
    for d, t in enumerate(texts):
        own = numbers.of(t)
        if index.short:
            out[d] = [{"item_id": i, "start_word": 0, "end_word": len(own), "edits": 0} for i in index.short.get(tuple(own.tolist()) if len(own) <= index.most_short else (), [])]
        parts += [own, gap]
        bounds.append((at, at + len(own)))
        at += len(own) + reach
    if not index.groups:
        return out
    words, bounds = np.concatenate(parts), np.array(bounds)
    both = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
    pair = words[both] * index.size + words[both + 1]
    slot = np.minimum(np.searchsorted(index.pairs, pair), len(index.pairs) - 1)
    real = index.pairs[slot] == pair
    both, slot = both[real], slot[real]
    slots = np.full(len(words), len(index.pairs), np.int64)
    slots[both] = slot
    found = []
    for n, most, ids, items, tables, held in index.groups:
        # the items that have a pair: who[first[slot]:first[slot + 1]]; of the last slot, no pair of the index, none
        who, first = held % len(items), np.searchsorted(held, np.arange(len(index.pairs) + 2) * len(items))
        own = np.diff(first) > 0
        # more edits than pairs can tell of: every place is asked
        starts = _starts(both[own[slot]], n, most) if n - 1 - 2 * most > 0 else np.arange(len(words) - n - most + 1)
        starts = starts[starts >= 0]
        doc = np.searchsorted(bounds[:, 0], starts, "right") - 1
        inside = starts + (n - most) <= bounds[doc, 1]
        starts, doc = starts[inside], doc[inside]
        step = max(1, CELLS // max(n + most, len(items)))
        for c in range(0, len(starts), step):
            at = starts[c : c + step]
            open_ = _enough(slots[at[:, None] + np.arange(n + most - 1)], who, first, len(items), n - 1 - 2 * most)
            found += _verified(words, at, bounds[doc[c : c + step], 1], doc[c : c + step], n, most, ids, items, tables, open_, int(starts[c - 1]) if c else -n)
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, item, a, b, e in sorted(found, key=lambda x: (x[0], x[4], x[1], x[2], x[3])):
        if all(b <= x or y <= a for x, y in taken.setdefault((d, item), [])):
            taken[d, item].append((a, b))
            out[d].append({"item_id": item, "start_word": a - int(bounds[d, 0]), "end_word": b - int(bounds[d, 0]), "edits": e})
    return [sorted(x, key=lambda s: (s["start_word"], s["item_id"], s["end_word"])) for x in out]


def _starts(at: np.ndarray, n: int, most: int) -> np.ndarray:
    """The starts of all windows of n + most words that hold as many of the pairs ``at`` as the most edits leave (q-gram lemma)."""
    need = n - 1 - 2 * most
    if len(at) < need:
        return at[:0]
    first, final = at[: len(at) - need + 1], at[need - 1 :]
    close = final - first <= n + most - 2
    lo, hi = final[close] + 2 - (n + most), first[close]
    if not len(lo):
        return lo
    lo = np.maximum(lo, np.concatenate([[lo[0]], np.maximum.accumulate(hi)[:-1] + 1]))  # each start once
    count = np.maximum(hi - lo + 1, 0)
    return np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())


def _enough(slots: np.ndarray, who: np.ndarray, first: np.ndarray, items: int, need: int) -> np.ndarray:
    """Whether a window (row) has ``need`` places or more with pairs of an item (column): fewer are more than the most edits away."""
    if need <= 0:
        return np.ones((len(slots), items), bool)
    slot = slots.ravel()
    count = first[slot + 1] - first[slot]
    window = np.repeat(np.arange(len(slots)), count.reshape(slots.shape).sum(1))
    item = who[np.repeat(first[slot] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    return np.bincount(window * items + item, minlength=len(slots) * items).reshape(-1, items) >= need


def _verified(words, starts, ends, doc, n, most, ids, items, tables, open_, before) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the windows of n words that share a key with an item open to them and are near it. Windows up to ``before`` were asked already."""
    windows = words[starts[:, None] + np.arange(n + most)]
    out, meet = [], [np.zeros(0, np.int64)]
    for k, (p, s, keys, order) in enumerate(tables):
        asked = np.flatnonzero(open_.any(1))
        if not len(asked):
            break
        key = embed(windows[asked, :n], p, s)
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        count = hi - lo
        window, item = np.repeat(asked, count), order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
        new = open_[window, item]
        window, item = window[new], item[new]
        open_[window, item] = False
        if not k:  # exact copies share every key
            exact = (windows[window, :n] == items[item]).all(1) & (starts[window] + n <= ends[window])
            copy = starts[window[exact]]
            out += zip(doc[window[exact]].tolist(), ids[item[exact]].tolist(), copy.tolist(), (copy + n).tolist(), [0] * len(copy))
            step = len(words) + n
            copies = np.sort(item[exact][copy >= before + n] * step + copy[copy >= before + n])
            copies = copies[np.diff(copies, prepend=-n) >= n]  # others may give way to the copy before them
            away = _away(copies, item * step + starts[window], n - most)
            window, item = window[away], item[away]
            w, i = np.nonzero(open_)
            near = ~_away(copies, i * step + starts[w], n - most)
            open_[w[near], i[near]] = False
        meet.append(window * len(items) + item)
    window, item = np.divmod(np.concatenate(meet), len(items))
    step = max(1, CELLS // (n + 2 * most))
    for k in range(0, len(window), step):
        w, i = window[k : k + step], item[k : k + step]
        edits, length = edit_distance(items[i], windows[w], most)
        good = (edits <= most) & (starts[w] + length <= ends[w]) & (length > 0)
        w, i, edits, length = w[good], i[good], edits[good], length[good]
        out += zip(doc[w].tolist(), ids[i].tolist(), starts[w].tolist(), (starts[w] + length).tolist(), edits.tolist())
    return out


def _away(copies: np.ndarray, at: np.ndarray, shortest: int) -> np.ndarray:
    """Whether no exact copy that stays starts within so many words: stretches of ``shortest`` words or more would overlap it, with more edits."""
    if not len(copies):
        return np.ones(len(at), bool)
    after = np.minimum(np.searchsorted(copies, at), len(copies) - 1)
    return np.minimum(np.abs(copies[after] - at), np.abs(copies[np.maximum(after - 1, 0)] - at)) >= shortest


def _parts(texts: list[str | None], gap: int, chars: int = 8_000_000) -> Iterator[list[str | None]]:
    """Consecutive texts of about so many characters, gaps of so many words included: bounds a task's memory, whatever the batch holds."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "") + 4 * gap
        if size >= chars:
            yield part
            part, size = [], 0
    yield part


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The stated query set in blocks of about ``block_chars``, dealt by a hash; each is small enough to be broadcast, and one is held at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and length(t) > 0")
    blocks = max(1, math.ceil((rows.agg(F.sum(F.length("t"))).first()[0] or 0) / block_chars))
    for b in range(blocks):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()]


def _scanner(shared):
    @F.pandas_udf(SPAN)
    @freeing
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        numbers = Numbers(index.vocabulary)
        for texts in batches:
            out: list[list[dict]] = []
            for part in _parts(texts.tolist(), index.reach):
                out += spans(part, index, numbers)
            yield pd.Series(out)

    return scan


def _with_spans(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text", max_rate=0.2, min_words=5, samples=2, recall=0.99, block_chars=8_000_000) -> DataFrame:
    """(row, spans): each row whole, as a struct, and its spans."""
    spark = docs.sparkSession
    found = F.array().cast(SPAN)
    for block in item_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(ItemIndex(block, max_rate, min_words, samples, recall))
        found = F.concat(found, _scanner(shared)(F.col(text_col)))
    return docs.select(F.struct("*").alias("row"), found.alias("spans"))


def with_spans(docs: DataFrame, benchmark: DataFrame, out="spans", **options) -> DataFrame:
    """All rows and columns of ``docs``, and ``out`` (replaced if it is there): an array of (item_id, start_word, end_word, edits)."""
    made = _with_spans(docs, benchmark, **options)
    return made.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != out), F.col("spans").alias(out))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """(id, item_id, start_word, end_word, edits): one row for each stretch."""
    text_col = options.pop("text_col", "text")
    marked = _with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, **options)
    return marked.select(F.col("row.id").alias(id_col), F.explode("spans").alias("s")).select(id_col, "s.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without such a stretch, all their columns."""
    return _with_spans(docs, benchmark, **options).where(F.size("spans") == 0).select("row.*")
