"""Benchmark passages inside documents: a prefix-filtered containment join.

Each item gives windows of consecutive words. A window is the set of its three-word
shingles with their offsets; shingles are ordered by how often the corpus holds them. A
document can hold a window only if it holds the window's rarest shingle (the prefix for
full containment has length one), at a position that leaves room for the words before and
after it (length and positional bounds). What passes is verified word for word.

The benchmark side is the stated query set. It is cut into blocks of at most
``block_windows`` windows; each block is a broadcast of bounded size, documents are passed
along once per block and never shuffled, so a passage that a third of the documents share
costs no more than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.llm import words
from viewtide.llm.scratch import keep, map_text

U64 = words.U64
SHINGLE = 3
HITS = "array<struct<start: int, end: int, item: string>>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))


#: Windows of one block. Word hashes and item of each window; then, sorted by hash, the
#: rarest shingle of each window, the window, and the shingle's offset in it.
Block = tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]


def _parts(seq: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a word sequence; of the whole when it is shorter."""
    return words.grams(seq, min(SHINGLE, len(seq)))


def _items(window: int):
    """One row per distinct window of an item: its word hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in words.column_words(batch.column("__text"), words.ALNUM):
                hashes, out = found.hashes(), {}
                for d in range(j - i):
                    seq = hashes[found.at[d]: found.at[d + 1]]
                    item = batch.column("__item")[i + d].as_py()
                    for k in range(max(1, len(seq) - window + 1) if len(seq) else 0):
                        out[item, seq[k: k + window].tobytes()] = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.binary())],
                    names=["item", "seq"])
    return run


def _counts(tokens):
    """Occurrences in a task's documents of each wanted shingle, by the shingle's number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, wanted = tokens.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, _, found in words.column_words(batch.column("__text"), words.ALNUM):
                hashes = found.hashes()
                for n in short:
                    every = words.grams(hashes, n)
                    at = np.minimum(np.searchsorted(wanted, every), len(wanted) - 1)
                    total += np.bincount(at[wanted[at] == every], minlength=len(wanted))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["k", "n"])
    return run


def _matches(shared, columns: list[str], text: str, first: bool, carry: list[str] | None):
    """Append each document's hits with the windows of one block. The last block gives the
    ``carry`` columns and the digest of all hits instead, in the same pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, items, all_rare, windows, offsets = shared.value
        by_length: dict[int, np.ndarray] = {}
        for n in sorted({min(SHINGLE, len(s)) for s in seqs}):
            by_length[n] = np.array([min(SHINGLE, len(seqs[w])) == n for w in windows])
        for batch in batches:
            sizes, hits = [], []
            for i, j, found in words.column_words(batch.column(text), words.ALNUM):
                hashes, doc = found.hashes(), found.doc_of()
                rows: list[list] = [[] for _ in range(j - i)]
                for n, mask in by_length.items():
                    rare, entry = all_rare[mask], np.flatnonzero(mask)
                    every = words.grams(hashes, n)
                    lo, hi = np.searchsorted(rare, every), np.searchsorted(rare, every, "right")
                    for p in np.flatnonzero(hi > lo):
                        for e in entry[lo[p]: hi[p]]:
                            seq = seqs[windows[e]]
                            start, d = p - offsets[e], doc[p]
                            if start < found.at[d] or start + len(seq) > found.at[d + 1]:
                                continue  # no room for the window here
                            if np.array_equal(hashes[start: start + len(seq)], seq):
                                at = int(start - found.at[d])
                                rows[d].append({"start": at, "end": at + len(seq), "item": items[windows[e]]})
                sizes += np.diff(found.at).tolist()
                hits += rows
            if not first:
                hits = [(b or []) + h for b, h in zip(batch.column("__hits").to_pylist(), hits)]
            if carry is None:
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in columns], pa.array(hits, _HITS)], names=[*columns, "__hits"])
            else:
                yield _digest(batch, carry, sizes, hits)
    return run


def _digest(batch: pa.RecordBatch, columns: list[str], sizes: list[int], found: list[list]) -> pa.RecordBatch:
    """Hit words, items and spans of the collected hits."""
    n_hit, items, spans = [], [], []
    for hits in found:
        merged: list[list[int]] = []
        for start, end in sorted({(h["start"], h["end"]) for h in hits}):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        n_hit.append(sum(e - s for s, e in merged))
        items.append(sorted({h["item"] for h in hits}))
        spans.append([{"start": s, "end": e} for s, e in merged])
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in columns], pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()),
         pa.array(items, pa.list_(pa.string())),
         pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
        names=[*columns, "n_words", "n_hit", "items", "items_sha256", "hit_words"])


RESULTS = ("n_words", "n_hit", "n_items", "items", "items_sha256", "hit_words", "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", carry: list[str] | None = None, block_windows: int = 200_000) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) plus ``n_words, n_hit, n_items, items, items_sha256, hit_words,
    contaminated``, one row per row of ``docs``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. An item's
    windows are its runs of ``window`` words, or all its words if it has fewer. ``n_hit``
    counts document words inside any occurrence; ``items`` are the sorted ids (as strings)
    of items with an occurring window, ``hit_words`` the merged ranges of hit words.

    Null or empty text has no words and no hits; so do items without words. Repeated rows
    and repeated items give the same answer each time; a null item id is the string
    ``null``. Columns of ``docs`` named like a result (in any case) are replaced by it.
    """
    spark = docs.sparkSession
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("__item"),
                        F.col(item_text).alias("__text"))
    windows = keep(map_text(rows, _items(window), "item string, seq binary").distinct().withColumn(
        "block", F.lit(0)), "windows")
    blocks = -(-windows.count() // block_windows)
    columns = [c for c in carry or docs.columns if c.lower() not in RESULTS]
    passed = columns if text in columns else [*columns, text]
    between = T.StructType([*docs.select(*passed).schema.fields, T.StructField("__hits", T._parse_datatype_string(HITS))])
    final = T.StructType([*docs.select(*columns).schema.fields, *T._parse_datatype_string(
        "n_words bigint, n_hit bigint, items array<string>, items_sha256 string, "
        "hit_words array<struct<start: int, end: int>>").fields])
    out, texts = docs.select(*passed), docs.select(F.col(text).alias("__text"))
    for b in range(max(blocks, 1)):
        some = windows.filter(F.pmod(F.xxhash64("item", "seq"), F.lit(blocks)) == b) if blocks > 1 else windows
        shared = spark.sparkContext.broadcast(_block(texts, some))
        last = b + 1 >= blocks
        out = map_text(out, _matches(shared, passed, text, b == 0, columns if last else None), final if last else between)
    return out.select(*columns, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
                      "items_sha256", "hit_words", (F.col("n_hit") > 0).alias("contaminated"))


def _block(texts: DataFrame, windows: DataFrame) -> Block:
    """The windows of one block, with the corpus counts of their shingles."""
    rows = windows.select("item", "seq").toArrow()  # at most block_windows rows of window words
    items = rows.column("item").to_pylist()
    seqs = [np.frombuffer(s, U64) for s in rows.column("seq").to_pylist()]
    parts = [_parts(s) for s in seqs]
    wanted = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U64)
    count = np.zeros(len(wanted), np.int64)
    if len(wanted):
        short = sorted({min(SHINGLE, len(s)) for s in seqs})
        tokens = texts.sparkSession.sparkContext.broadcast((short, wanted))
        for r in map_text(texts, _counts(tokens), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
            count[r.k] = r.n
    best = [int(np.argmin(count[np.searchsorted(wanted, p)])) for p in parts]
    rare = np.array([p[b] for p, b in zip(parts, best)], U64)
    order = np.argsort(rare, kind="stable")
    return seqs, items, rare[order], order, np.array(best, np.int64)[order]
