"""Best-fit packing with certified bin counts.

Documents are tokenised in a map over the texts (one end token after each), cut into pieces of at most ``capacity``
tokens, and only the pieces' lengths travel from there. Pieces are dealt to groups of bounded size; each group packs
best-fit decreasing and certifies its number of bins by the strongest of a family of dual feasible functions
(Fekete and Schepers). Groups whose count exceeds their bound have gaps: all their bins that aren't full give up their
documents, as does the emptiest bin of every certified group; these are dealt anew, mixed across groups, and packed again, as
long as that takes fewer bins than before. ``certificate`` holds the outcome against the bound of the whole table.

Defined results: a null or empty text is its end token alone; repeated documents are packed each (with their ids);
null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import freeing, settle

PIECES = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long"
PIECES_SCHEMA = pa.schema([(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in (c.split() for c in PIECES.split(", "))])
#: A word of plain letters, then signs: no normal form, case or pattern of a tokenizer reaches across the two.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00fe]+)([!-/:-@\[-`{-~]*)")


#: A part that is one word to any tokenizer of words: lower-case letters that have one form only.
LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00fe]+")


class _Numbered(dict):
    """Word -> its number; a new word gets the next one and is put on the list of those to learn."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class _Ids:
    """Runs of token ids in one array: run i is ids[start[i]:start[i + 1]]."""

    def __init__(self):
        self.ids, self.start, self.used, self.runs = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while self.runs + len(size) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.runs + 1 : self.runs + 1 + len(size)] = self.used + np.cumsum(size)
        self.used, self.runs = self.used + len(ids), self.runs + len(size)

    def of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the runs' ids one after the other, their sizes)"""
        start = self.start[runs]
        size = self.start[runs + 1] - start
        end = np.cumsum(size)
        return self.ids[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)], size


class WordTokenizer:
    """Token ids of whole texts by a tokenizer whose tokens never span white space.

    Each distinct word is put together once from its parts' ids and remembered, as are the parts; a text's ids are
    gathered from there. Both memories are dropped beyond their limits, words sooner, as they are cheap to put together."""

    def __init__(self, path: str, most_words: int = 400_000, most_parts: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words, self.most_parts = Tokenizer.from_file(path), most_words, most_parts
        self._forget_parts()
        vocabulary = self.tokenizer.get_vocab()
        #: by id whether it ends a word
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def _forget_parts(self) -> None:
        self.parts, self.part_ids = _Numbered(), _Ids()
        #: by part the run of its ids
        self.run = np.zeros(0, np.int64)

    def clear(self) -> None:
        self.number, self.word_ids = _Numbered(), _Ids()
        if len(self.parts) > self.most_parts:
            self._forget_parts()

    def _learn(self, words: list[str]) -> None:
        """Letters and the signs after them are pieces apart for the tokenizer, so they are remembered apart."""
        get, pairs = self.parts.__getitem__, []
        nothing = get("")
        for w in words:
            m = PLAIN.fullmatch(w)
            pairs += (get(m[1].lower()), get(m[2])) if m else (get(w), nothing)
        self._learn_parts(self.parts.new)
        self.parts.new.clear()
        pairs = np.array(pairs, np.int64)
        ids, size = self.part_ids.of(self.run[pairs])
        self.word_ids.add(ids, size.reshape(-1, 2).sum(1))

    def _learn_parts(self, parts: list[str], together: int = 500) -> None:
        """Parts of letters go in one text, told apart by the ids that end a word; all others alone."""
        run, rest = np.zeros(len(parts), np.int64), []
        letters = [i for i, p in enumerate(parts) if LETTERS.fullmatch(p)]
        for k in range(0, len(letters), together):
            own = letters[k : k + together]
            ids = np.array(self.tokenizer.encode(" ".join([parts[i] for i in own]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(own):
                run[own] = self.part_ids.runs + np.arange(len(own))
                self.part_ids.add(ids, np.diff(ends, prepend=0))
            else:  # the tokenizer marks no ends
                rest += own
        rest += sorted(set(range(len(parts))) - set(letters))
        for k in range(0, len(rest), together):
            own = rest[k : k + together]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([parts[i] for i in own], add_special_tokens=False)]
            run[own] = self.part_ids.runs + np.arange(len(own))
            self.part_ids.add(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        self.run = np.concatenate([self.run, run])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # only plain blanks and line ends split: every other white space stays for the tokenizer to judge
        if len(self.number) > self.most_words:
            self.clear()
        get, numbers = self.number.__getitem__, []
        for t in texts:
            words = t.replace("\n", " ").split(" ")
            numbers.append(np.fromiter(map(get, words), np.int64, len(words)))
        self._learn(self.number.new)
        self.number.new.clear()
        return [self.word_ids.of(n)[0] for n in numbers]


@freeing
def _tokenise(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokenizer = WordTokenizer(path)  # for this task only: workers live on and would keep its memory
    end = np.array([end_id], np.uint32)
    for batch in batches:
        end_at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < batch.num_rows:  # parts of bounded size: a batch may hold many long texts, and only a part's are made Python's
            upto = max(k + 1, int(np.searchsorted(end_at, (end_at[k - 1] if k else 0) + 4_000_000, "right")))
            docs, rows, texts = (batch.column(i).slice(k, upto - k).to_pylist() for i in range(3))
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, row, ids in zip(docs, rows, tokenizer.encode(["" if t is None else t for t in texts])):
                ids = np.concatenate([ids, end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    for c, v in zip(cols, (doc, row, piece, start, len(own), zlib.crc32(own.astype("<u4").tobytes()))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES_SCHEMA)], schema=PIECES_SCHEMA)
            k = upto


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col="doc_id", text_col="text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda x: _tokenise(x, tokenizer_path, capacity, end_id), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64))


def bound_of(count: np.ndarray) -> int:
    """The largest bound of the dual feasible functions f_e for so many pieces of each length: over capacity - e counts as a whole bin, under e as nothing."""
    capacity = len(count) - 1
    many, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    best = -(-int(mass[-1]) // capacity)
    for e in range(1, capacity // 2 + 1):
        large = int(many[-1] - many[capacity - e + 1])
        middle = int(mass[capacity - e + 1] - mass[e])
        best = max(best, large - (-middle // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each piece, fill of each bin). The set of residual capacities in use is kept as bits of an integer."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual capacity
    bits, fill = 0, []
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        able = bits >> length
        if able:
            left = length + (able & -able).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                bits ^= 1 << left
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += length
        rest = left - length
        if rest:
            open_[rest].append(b)
            bits |= 1 << rest
    return bins, offset, np.array(fill, np.int64)


def _pack(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """``settled``: pieces of bins that stay. With a gap between bins and bound the bins that aren't full give up their pieces, else the emptiest."""
    lengths = group["length"].to_numpy()
    bins, offset, fill = best_fit_decreasing(lengths, capacity)
    stays = fill == capacity
    if len(fill) == lower_bound(lengths, capacity):
        stays[:] = True
        stays[fill.argmin()] = fill.min() == capacity
    return group.assign(bin=bins, offset=offset, settled=stays[bins])[["row_id", "piece", "length", "grp", "bin", "offset", "settled"]]


def _packer(capacity: int):
    return lambda group: _pack(group, capacity)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group_rows: int = 20_000, **columns) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    pieces = settle(pieces_of(docs, tokenizer_path, capacity, end_id, **columns), "pieces")
    place = ["row_id", "piece", "round", "grp", "bin", "offset"]
    full = pieces.where(F.col("length") == capacity).select("row_id", "piece", F.lit(0).alias("round"), F.lit(0).cast("long").alias("grp"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("row_id", "piece", "length")
    done, rows, bins, k = [full], rest.count(), None, 0
    schema = "row_id long, piece int, length long, grp long, bin long, offset long, settled boolean"
    while rows:
        groups, k = -(-rows // group_rows), k + 1
        dealt = rest.select("row_id", "piece", "length", F.pmod(F.xxhash64("row_id", "piece", F.lit(k)), F.lit(groups)).alias("grp"))
        packed = settle(dealt.repartition(groups, "grp").groupBy("grp").applyInPandas(_packer(capacity), schema), "packed").withColumn("round", F.lit(k))
        made, left, left_rows = packed.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & ~F.col("settled")), F.count_if(~F.col("settled"))).first()
        if bins is not None and made >= bins:  # the earlier places stay
            done.append(rest.select(place))
            break
        if groups == 1:
            done.append(packed.select(place))
            break
        done.append(packed.where("settled").select(place))
        rest, bins, rows = packed.where("not settled"), left, left_rows
    placed = reduce(DataFrame.unionByName, done)
    # a bin's number: its round, group and place there; a full piece is a bin of its own
    number = F.when(F.col("round") == 0, -1 - F.col("bin")).otherwise((F.col("round") * (1 << 34) + F.col("grp")) * (1 << 20) + F.col("bin"))
    placed = placed.select("row_id", "piece", number.alias("sequence_id"), "offset")
    return pieces.join(placed, ["row_id", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """(sequences made, the dual feasible functions' lower bound for all pieces): equal if no packing needs fewer.

    Only the number of pieces of each length reaches the driver."""
    counts = packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("first")).collect()
    many = np.zeros(capacity + 1, np.int64)
    for r in counts:
        many[r["length"]] = r["n"]
    return sum(r["first"] for r in counts), bound_of(many)
