"""Byte-level BPE: whole texts to token ids, and back, by a vocabulary of ranked byte strings.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over all tokens finds the longest match at each
byte. An encoding is the one row of tokens in which every two neighbours are compatible: merging their bytes alone gives
these two. A piece is walked from its longest matches; where no token fits, the last one is taken back for a shorter
one, and the place is never tried again, so the time is linear. The merges themselves are never run."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

NO_LIMIT = 1 << 62
#: Rows whose ids are held at once in a task.
TOGETHER = 200


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines: token in base 64, blank, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encoder of one vocabulary, whose ranks are the order in which merges were learnt. What is remembered of pairs and pieces is dropped beyond its limit."""

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = 400_000, most_pieces: int = 300_000, longest_remembered: int = 48):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no tokens for the bytes {missing}")
        import ahocorasick

        self.rank, self.most_pairs = ranks, most_pairs
        self.token = {i: t for t, i in ranks.items()}
        #: id -> (left, right), the last merge that makes it; single bytes have none
        self.made_of: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(t)):
                left, right = ranks.get(t[:cut], i), ranks.get(t[cut:], i)
                if left < i and right < i and self._is_made(left) and self._is_made(right) and self._border_stays(left, right, i):
                    self.made_of[i] = left, right
                    break
        made = {i: t for i, t in self.token.items() if self._is_made(i)}
        self.size = {i: len(t) for i, t in made.items()}
        #: id -> the longest token that it begins with, -1 for none
        self.shorter = {i: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if ranks.get(t[:n]) in made), -1) for i, t in made.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in made.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = _Pieces(self, most_pieces, longest_remembered)
    def _is_made(self, i: int) -> bool:
        """Whether merges lead to the token at all; a vocabulary may hold others, which only stand for whole pieces."""
        return i in self.made_of or len(self.token[i]) == 1

    def _border_stays(self, left: int, right: int, before: int = NO_LIMIT) -> bool:
        """Whether no merge below rank ``before`` crosses the border between the bytes of ``left`` and of ``right``.

        The merges of both sides are undone from the last: two neighbours at the border were there until the later of their own
        parts' merges, so a merge of both is in the way if its rank is lower. Of equal ranks the left one goes first."""
        rank, token, parts = self.rank, self.token, self.made_of
        while True:
            across = rank.get(token[left] + token[right])
            if across is not None and across < before:
                return False
            l_parts, r_parts = parts.get(left), parts.get(right)
            if l_parts is None and r_parts is None:
                return True
            if r_parts is None or (l_parts is not None and left > right):
                before, left = left, l_parts[1]
            else:
                before, right = right + 1, r_parts[0]

    def forget(self) -> None:
        """Drop what is remembered, so that a worker at rest holds the vocabulary's tables only."""
        self.pieces.clear()
        self.pairs.clear()

    def compatible(self, left: int, right: int) -> bool:
        """Remembered for each pair of ids."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[pair] = self._border_stays(left, right)
        return known

    def walk(self, piece: bytes) -> list[int]:
        """The ids of a piece."""
        n = len(piece)
        longest = [0] * n
        size, shorter, compatible = self.size, self.shorter, self.compatible
        for last, i in self.automaton.iter(piece.decode("latin-1")):
            longest[last + 1 - size[i]] = i  # ends come in order: the longest of each start is the last
        alive, out, at, left = bytearray(b"\1") * (n + 1), [], 0, -1
        i = longest[0] if n else -1
        while at < n:
            while i >= 0 and not (alive[at + size[i]] and (left < 0 or compatible(left, i))):
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, left = at + size[i], i
                if at < n:
                    i = longest[at]
            elif not out:
                raise ValueError(f"no merges of this vocabulary give {piece!r}")
            else:
                alive[at] = 0
                i = out.pop()
                at, left = at - size[i], out[-1] if out else -1
        return out

    def encode(self, pieces: list[str]) -> bytes:
        """The pieces' ids as little-endian unsigned 32-bit numbers, one after the other."""
        return b"".join(map(self.pieces.__getitem__, pieces))


class Decoder:
    """The bytes of packed ids: gathered from one array that holds all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        token = {i: t for t, i in ranks.items()}
        top = max(token) + 1
        self._sizes = np.zeros(top, np.int64)
        self._sizes[list(token)] = [len(t) for t in token.values()]
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._bytes = np.frombuffer(b"".join(token.get(i, b"") for i in range(top)), np.uint8)

    def decode(self, tokens: bytes) -> bytes:
        ids = np.frombuffer(tokens, "<u4").astype(np.int64)
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self._bytes[np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


class _Pieces(dict):
    """Packed ids by piece; long pieces are encoded each time."""

    def __init__(self, bpe: ByteBpe, most: int, longest: int):
        self.bpe, self.most, self.longest = bpe, most, longest

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.bpe.rank.get(raw)
        ids = self.bpe.walk(raw) if whole is None else [whole]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=1)
def encoder(path: str) -> ByteBpe:
    """Built once in each Python worker."""
    return ByteBpe(read_ranks(path))


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "tokens", back: str | None = None) -> DataFrame:
    """``docs`` with ``out`` (binary): the text's token ids as little-endian unsigned 32-bit numbers; ``text`` itself is left out.

    Each match of ``pattern`` is encoded by itself, without special tokens; what the pattern doesn't match has no tokens. A null or
    empty text has none either. Texts are encoded whole, in time linear in their length. Repeated rows stay; an earlier column
    ``out`` is replaced. With ``back``, also the bytes that the ids decode to (binary), made in the same pass. ``path`` must exist on all
    machines. Letters, numbers and blanks of the pattern are those of the regex library's Unicode version; characters assigned since
    another library's version may be cut apart differently there."""
    made = [out] if back is None else [out, back]
    kept = [f for f in docs.schema.fields if f.name not in (text, *made)]
    schema = StructType([*kept, *(StructField(c, BinaryType()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, bpe = regex.compile(pattern).findall, encoder(path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    rows = batch.slice(at, TOGETHER)
                    tokens = [b"" if t is None else bpe.encode(find(t)) for t in (x.as_py() for x in rows.column(rows.num_columns - 1))]
                    columns = [pa.array(tokens, pa.binary())]
                    if back is not None:
                        columns.append(pa.array(map(decoder(path).decode, tokens), pa.binary()))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names=[*rows.schema.names[:-1], *made])
        finally:
            bpe.forget()

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias("_text")).mapInArrow(run, schema)


def decoded(tokens: Column, path: str) -> Column:
    """The bytes of packed ids (binary); null for null. An id that the vocabulary doesn't have raises or stands for no bytes."""

    @F.arrow_udf("binary")
    def run(packed: pa.Array) -> pa.Array:
        known = decoder(path)
        return pa.array([None if t is None else known.decode(t) for t in (x.as_py() for x in packed)], pa.binary())

    return run(tokens)


def unpacked(tokens: Column) -> Column:
    """Packed ids as array<int>; null for null."""

    @F.arrow_udf("array<int>")
    def run(packed: pa.Array) -> pa.Array:
        return pa.array([None if t is None else np.frombuffer(t, "<i4") for t in (x.as_py() for x in packed)], pa.list_(pa.int32()))

    return run(tokens)
