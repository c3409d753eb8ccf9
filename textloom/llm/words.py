"""Words of whole texts as 64-bit numbers, by numpy over the bytes of an Arrow column.

A word is a run of bytes that are no separators; its number is a polynomial over random bytes' values, mixed. Word
numbers of the same text are the same on every machine and in every run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20_240_229)
_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: An odd multiplier for short keys.
FREE_ODD = np.uint64(0x9E3779B97F4A7C15)


def lookup(separators: bytes, lower: bool = True) -> np.ndarray:
    """A value for each byte: 0 for separators, else a random number; A-Z like a-z if ``lower``."""
    values = _VALUES.copy()
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[list(separators)] = 0
    return values


SPACE = bytes([0x20, *range(0x09, 0x0E)])
SPACES = lookup(SPACE)
#: All of ASCII but letters, digits and the underscore.
SIGNS = lookup(bytes(c for c in range(128) if not (chr(c).isalnum() or c == 95)))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: each bit of the result depends on all of ``x``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_numbers(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, start byte, end byte) of each word in ``data``."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty
    value = values.take(data)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], value != 0, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(data) + 1)
    value *= power[: len(data)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    number = (total[end] - total[start]) * inverse[start]
    return mix(number + (end - start).astype(np.uint64)), start, end


def batches_of_words(texts: pa.Array, values: np.ndarray, size: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, numbers) for consecutive rows of about ``size`` bytes: row i has the words bounds[i] to bounds[i + 1].

    A null text has no words."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(offset, offset[row] + size, "right")) - 1)
        own = offset[row : upto + 1]
        lengths = np.diff(own)
        # a separator after each text: no word spans two of them
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        data = np.full(int(at[-1]), 0x20, np.uint8)
        keep = np.ones(len(data), bool)
        keep[at[1:] - 1] = False
        data[keep] = raw[own[0] : own[-1]]
        number, start, _ = word_numbers(data, values)
        yield row, np.searchsorted(start, at), number
        row = upto


def numbers_of(words: list[str], values: np.ndarray = SPACES) -> np.ndarray:
    """The number of each word of a list; of none if a word holds separators."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    number, *_ = word_numbers(data, values)
    if len(number) != len(words):
        raise ValueError("a word is empty or holds a separator")
    return number
