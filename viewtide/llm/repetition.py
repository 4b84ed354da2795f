"""Repetition coverage: how much of a text lies in duplicated n-grams and lines.

Word hashes of the whole text are rolled into n-grams of several lengths in numpy. All words
inside a repeated n-gram count, its first occurrence too: for the base rule as words, for
the method's verdict as characters. Duplicate lines are those that equal an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from viewtide.llm import words
from viewtide.llm.scratch import map_text

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@dataclass(frozen=True)
class RepetitionRules:
    """Limits in percent. Base: a text fails with fewer than ``min_words`` words or with
    more than ``repeat`` percent of its words inside repeated 5-word windows. The method's
    verdict uses shares of word characters: inside n-grams found twice or more
    (``duplicated``: length and limit), in duplicate lines (``lines``), and symbols per word
    character (``symbols``).

    The n-gram limits hold from ``gram_words`` words on: a sentence of ten words that is said
    twice covers 20 words, a tenth of 200, so that in shorter texts one quoted sentence or
    licence line would reach a limit by itself. Shorter texts are left to the other rules."""

    min_words: int = 10
    repeat: int = 20
    window: int = 5
    duplicated: tuple[tuple[int, int], ...] = ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10))
    gram_words: int = 200
    lines: int = 20
    symbols: int = 10


def covered_words(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words of one document lie in an n-gram found twice or more."""
    inside = np.zeros(len(hashes) + 1, np.int64)
    every = words.grams(hashes, n)
    order = np.argsort(every, kind="stable")
    again = every[order[1:]] == every[order[:-1]]
    starts = np.unique(np.concatenate([order[1:][again], order[:-1][again]]))
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + n, -1)
    return np.cumsum(inside[:-1]) > 0


def _measure(data: np.ndarray, hashes: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray,
             rules: RepetitionRules) -> tuple:
    """Measures of one document: its bytes, and hash, characters and place of each word."""
    total = int(chars.sum())
    symbols = int(_SYMBOL[data].sum())
    repeated = int(covered_words(hashes, rules.window).sum())
    shares = [int(chars[covered_words(hashes, n)].sum()) for n, _ in rules.duplicated]
    seen, dup_lines, dup_chars, raw = set(), 0, 0, data.tobytes()
    if len(starts):
        place = np.searchsorted(starts, np.flatnonzero(data == 10)).tolist()
        bounds, first = [0, *place, len(starts)], 0
        for line, lo, hi in zip(raw.split(b"\n"), bounds, bounds[1:]):
            if hi == lo:
                continue
            first += 1
            if line in seen:
                dup_lines += 1
                dup_chars += int(chars[lo:hi].sum())
            else:
                seen.add(line)
    n = len(hashes)
    failed = n < rules.min_words or 100 * repeated > rules.repeat * n
    within = n < rules.gram_words or all(100 * s <= most * total for s, (_, most) in zip(shares, rules.duplicated))
    good = not failed and within \
        and 100 * dup_chars <= rules.lines * total and 100 * symbols <= rules.symbols * total
    return n, total, symbols, dup_lines, repeated, failed, dup_chars, shares, good


def repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text",
               carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) plus ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, dup_line_chars, dup_gram_chars, kept``.

    Words are runs without white space; characters are code points. ``dup_gram_chars`` has
    one number for each length of ``rules.duplicated``. Lines without a word never count
    as duplicates. One row in, one row out, no shuffle; a null or empty text has no words
    and so fails the base rules. Columns of ``docs`` named like a result are replaced.
    """
    results = [*BASE, "dup_line_chars", "dup_gram_chars", "kept"]
    columns = [c for c in carry or docs.columns if c.lower() not in results]
    passed = columns if text in columns else [*columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            data, offsets = words.text_buffers(batch.column(text))
            for i, j in words.chunks(offsets):
                found = words.split(data, offsets[i: j + 1], lower=False)
                hashes = found.hashes()
                # A code point has one byte that is no continuation byte.
                lead = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80, dtype=np.int64)])
                chars = lead[found.ends] - lead[found.starts]
                at = offsets[i: j + 1] - offsets[i]
                for d in range(j - i):
                    w = slice(found.at[d], found.at[d + 1])
                    rows.append(_measure(found.data[at[d]: at[d + 1]], hashes[w], chars[w], found.starts[w] - at[d],
                                         found.ends[w] - at[d], rules))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=[*columns, *results])

    schema = T.StructType([*docs.select(*columns).schema.fields, *T._parse_datatype_string(
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, dup_line_chars bigint, dup_gram_chars array<bigint>, kept boolean").fields])
    return map_text(docs.select(*passed), run, schema)
