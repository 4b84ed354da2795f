"""Words and word n-grams of whole text columns, as numpy arrays over UTF-8 bytes.

The functions work on one Arrow batch at a time inside a task. Words never cross
documents, separators are ASCII bytes (which never occur inside a multi-byte character),
and only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20  # text handled at once; one longer document is hashed in such steps

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)  # a random value for each byte
_BASE = U64(0x9E3779B97F4A7C15 | 3)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)  # one odd factor per n-gram position
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def word_bytes(separators: str) -> np.ndarray:
    """Table of the bytes that words are made of.

    ``space``: all but white space (``[^\\x20\\x09-\\x0D]``); ``alnum``: digits, lower-case
    letters and every byte of non-ASCII characters.
    """
    table = np.ones(256, bool)
    if separators == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif separators == "alnum":
        table[:128] = False
        table[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
    else:
        raise ValueError(separators)
    return table


SPACE, ALNUM = word_bytes("space"), word_bytes("alnum")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that high bits depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of the documents of one chunk; ``at[d]:at[d + 1]`` are those of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), U64)
        i = 0
        while i < len(out):
            lo = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.starts, lo + CHUNK_BYTES)))
            hi = self.ends[j - 1]
            up, down = _places(int(hi - lo) + 1)
            total = np.zeros(hi - lo + 1, U64)
            np.cumsum(_BYTE[self.data[lo:hi]] * up[: hi - lo], out=total[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = mix((total[e] - total[s]) * down[s])
            i = j
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Words of the documents ``data[offsets[d]:offsets[d + 1]]``."""
    data = data[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def column_words(column: pa.Array, word: np.ndarray = SPACE, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first document, document after the last, their words) for bounded chunks of a column."""
    data, offsets = text_buffers(column)
    for i, j in chunks(offsets):
        yield i, j, split(data, offsets[i: j + 1], word, lower)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, as if the array were one document."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    total = np.zeros(len(hashes) - n + 1, U64)
    for j in range(n):
        total += hashes[j: len(hashes) - n + 1 + j] * _PLACE[j]
    return mix(total + U64(n))


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each document: its whole word sequence when it
    has fewer words, none when it has none."""
    hashes = words.hashes()
    every, out = grams(hashes, n), []
    for lo, hi in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(every[lo: hi - n + 1]))
        elif hi > lo:
            out.append(grams(hashes[lo:hi], hi - lo))
        else:
            out.append(every[:0])
    return out
