"""Removal of long repeated byte strings, by blockwise suffix sorting over a difference cover.

A text's suffixes at the places of a difference cover modulo v are a sample: two suffixes
anywhere meet the sample together at one common distance below v, whatever their places.
So a string of ``length`` bytes that stands at two places has a sample block of
``length - v + 1`` bytes in common there, and only sample suffixes need be ranked against
the whole corpus. They are cut into buckets by their key, each bucket is sorted by itself,
and equal keys get a common rank. Suffixes between the sample are then judged through it:

* all blocks of a rank have the same surroundings as far as a window can reach: every window
  around them is repeated, however long the tie is, and no byte of it is compared again;
* their surroundings differ: the windows around such blocks, the ends of repeats, are
  sorted in buckets of their own.

Blocks and windows are known by 64 and 96 bits of polynomial hashes over byte prefix sums;
the surroundings of a block by 128. Documents are dealt to chunks by digest. A chunk sends
each key once and gets one answer for it, so that a passage which stands in a third of all
documents costs a bucket one row per chunk, and memory is bounded by chunk and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.llm.scratch import keep

U64 = np.uint64
STEP = 1 << 20  # bytes of text whose prefix sums are held at once
_rng = np.random.default_rng(20250131)
_BYTES = _rng.integers(0, 2**64, (2, 256), dtype=U64)
_BASES = [int(b) | 3 for b in _rng.integers(0, 2**64, 2, dtype=U64)]
_EDGE = _rng.integers(0, 2**64, 2, dtype=U64) | U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_PAYLOAD = "bucket int, chunk bigint, start bigint, first binary, second binary, flags binary"
_ANSWER = "chunk bigint, kind int, place binary, status binary"
BLOCKS, WINDOWS = 0, 1
WHOLE, MIXED = 1, 2  # ranks: every surrounding equal, or not


@dataclass(frozen=True)
class Repeats:
    """Strings of ``length`` bytes; chunks of about ``chunk_bytes`` of text, and buckets of
    about ``bucket_bytes`` of keys, are sorted at once. With chunks of c bytes, corpora of n
    bytes need about n * n / (50 * c * bucket_bytes) bucket rows: raise both with n."""

    length: int = 400
    chunk_bytes: int = 8 << 20
    bucket_bytes: int = 8 << 20


def singer(p: int) -> tuple[int, list[int]]:
    """v = p * p + p + 1 and the p + 1 residues, p prime, whose differences are all residues
    once: a line of the projective plane, as powers of an element of GF(p ** 3)."""
    v = p * p + p + 1
    for a, b, c in product(range(p), range(p), range(1, p)):
        power, line = (0, 0, 1), []
        for i in range(v):
            if not power[0]:
                line.append(i)
            top = power[0]
            power = ((power[1] + top * a) % p, (power[2] + top * b) % p, top * c % p)
        if len(line) == p + 1 and len({(i - j) % v for i in line for j in line}) == v:
            return v, line
    raise ValueError(f"{p} is not prime")


def difference_cover(length: int) -> tuple[int, list[int]]:
    """The largest such cover with v up to half of ``length``; every place if none is."""
    p = max((p for p in range(2, int(length**0.5) + 2) if p * p + p + 1 <= length // 2
             and all(p % k for k in range(2, p))), default=None)
    return singer(p) if p else (1, [0])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        pair = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            p = np.full(n, base, U64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _powers[which] = tuple(pair)
    return _powers[which]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of each ``data[start:end]``; starts ascend, spans are short against ``STEP``."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(out):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + STEP))
        hi = int(ends[i:j].max())
        up, down = _power(which, max(hi - lo, STEP + 4096) + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTES[which][data[lo:hi]] * up[: hi - lo], out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = _mix((total[ends[i:j] - lo] - total[s]) * down[s])
        i = j
    return out


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls are empty."""
    column = pa.concat_arrays(column.cast(pa.large_binary()).chunks) if len(column) else pa.array([], pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges ``low..high``, both included, once and ascending."""
    sizes = np.maximum(high - low + 1, 0)
    ends = np.cumsum(sizes)
    every = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(low, sizes)
    return np.unique(every)


class Chunk:
    """Sample blocks of the documents of one chunk, their keys and surroundings.

    ``keys`` are the distinct block keys in order: their place in it names a block in
    answers, and does not depend on the order of the documents.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.length = data, length
        self.v, cover = difference_cover(length)
        self.flag = np.uint8 if len(cover) < 32 else np.uint16
        block = length - self.v + 1
        sizes = np.diff(offsets)
        long = np.flatnonzero(sizes >= length)
        begin, end = offsets[long], offsets[long + 1]
        periods = (end - begin - block) // self.v + 1
        doc = np.repeat(np.arange(len(long)), periods)
        period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods)
        at = (begin[doc] + period * self.v)[:, None] + np.array(cover)
        inside = at + block <= end[doc][:, None]
        self.at = at[inside]
        self.residue = np.broadcast_to(np.arange(len(cover), dtype=np.uint16), at.shape)[inside]
        doc = np.broadcast_to(doc[:, None], at.shape)[inside]
        begin, end = begin[doc], end[doc]
        left, right = np.maximum(self.at - self.v + 1, begin), np.minimum(self.at + length, end)
        #: Starts of the windows around a block that hold it whole.
        self.low, self.high = left, np.minimum(self.at, end - length)
        block_key = span_hashes(data, self.at, self.at + block, 0)
        edges = (self.at - left).astype(U64) * _EDGE[0] + (right - self.at).astype(U64) * _EDGE[1]
        # ``left`` ascends as ``at`` does within a document and documents follow each other.
        self.around = _mix(span_hashes(data, left, right, 1) ^ edges)
        order = np.argsort(block_key, kind="stable")
        ordered = block_key[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
        self.keys, self.order, self.first = ordered[first], order, first
        self.counts = np.diff(np.append(first, len(order)))

    def payload(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, one of its surroundings and flags of each distinct block: found twice,
        several surroundings, several residues, and above these three bits its residue."""
        if not len(self.keys):
            return self.keys, self.keys, np.zeros(0, self.flag)
        around, residue = self.around[self.order], self.residue[self.order]
        low, high = np.minimum.reduceat(around, self.first), np.maximum.reduceat(around, self.first)
        least, most = np.minimum.reduceat(residue, self.first), np.maximum.reduceat(residue, self.first)
        flags = (self.counts > 1) | (low != high).astype(np.uint16) << 1 | (least != most).astype(np.uint16) << 2 | least << 3
        return self.keys, low, flags.astype(self.flag)

    def judged(self, status: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``at`` of the blocks whose every window is repeated, and of those whose
        windows must be sorted, given the rank's status of each key."""
        of = np.empty(len(self.order), np.uint8)
        of[self.order] = np.repeat(status, self.counts)
        mixed = np.flatnonzero(of == MIXED)
        whole = np.flatnonzero(of == WHOLE)
        if not len(mixed):
            return whole, mixed
        name = np.empty(len(self.order), np.int64)
        name[self.order] = np.repeat(np.arange(len(self.keys)), self.counts)
        mixed = mixed[np.lexsort((self.around[mixed], name[mixed]))]
        around, name = self.around[mixed], name[mixed]
        new = np.concatenate([[True], (around[1:] != around[:-1]) | (name[1:] != name[:-1])])
        group = np.cumsum(new) - 1
        twice = np.bincount(group)[group] > 1
        # Blocks with equal surroundings settle here; the first of them stands for all elsewhere.
        return np.concatenate([whole, mixed[twice]]), mixed[new]

    def windows(self, blocks: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
        """Starts of the windows around these blocks, their distinct keys as a payload, and
        the place of each window's key among them."""
        starts = _spread(self.low[blocks], self.high[blocks])
        one = span_hashes(self.data, starts, starts + self.length, 0)
        two = (span_hashes(self.data, starts, starts + self.length, 1) >> U64(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        twice = (np.diff(np.append(first, len(a))) > 1).astype(np.uint8)
        return starts, (a[first], b[first], twice), place


def _packed(chunk: int, payload: tuple, buckets: int) -> pa.Table:
    """A chunk's ordered keys, cut into buckets: the key range is cut evenly."""
    keys = payload[0]
    edges = [-(-(b << 64) // buckets) for b in range(1, buckets)]
    cuts = [0, *np.searchsorted(keys, np.array(edges, U64)).tolist(), len(keys)]
    some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
    columns = [[p[cuts[b]: cuts[b + 1]].tobytes() for b in some] for p in payload]
    return pa.table({"bucket": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int64()),
                     "start": pa.array([cuts[b] for b in some], pa.int64()),
                     **{n: pa.array(c, pa.binary()) for n, c in zip(("first", "second", "flags"), columns)}})


def _ranked(table: pa.Table, kind: int) -> pa.Table:
    """Sort one bucket and answer every chunk that sent keys to it."""
    parts = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()]
             for c, t in (("first", U64), ("second", U64 if kind == BLOCKS else np.uint32), ("flags", np.uint8))]
    sizes = np.array([len(x) for x in parts[0]])
    if sizes.sum() < sum(map(len, parts[2])):
        parts[2] = [x.view(np.uint16) for x in parts[2]]
    key, second, flags = (np.concatenate(p) for p in parts)
    status = np.zeros(len(key), np.uint8)
    order = np.argsort(key, kind="stable") if kind == BLOCKS else np.lexsort((second, key))
    k, s, f = key[order], second[order], flags[order]
    other = k[1:] != k[:-1] if kind == BLOCKS else (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(np.concatenate([[True], other]))
    counts = np.diff(np.append(first, len(k)))
    bits = np.bitwise_or.reduceat(f, first)
    repeated = (counts > 1) | (bits & 1 > 0)
    if kind == WINDOWS:
        rank = repeated.astype(np.uint8)
    else:
        residue = f >> 3
        low, high = np.minimum.reduceat(residue, first), np.maximum.reduceat(residue, first)
        # Suffixes that are equal and meet the cover at one residue only also meet it at the first one.
        needed = repeated & ((bits & 4 > 0) | (low != high) | (low == 0))
        mixed = (bits & 2 > 0) | (np.minimum.reduceat(s, first) != np.maximum.reduceat(s, first))
        rank = np.where(needed, np.where(mixed, MIXED, WHOLE), 0).astype(np.uint8)
    status[order] = np.repeat(rank, counts)
    rows, lo = {"chunk": [], "place": [], "status": []}, 0
    for chunk, start, n in zip(table.column("chunk").to_pylist(), table.column("start").to_pylist(), sizes.tolist()):
        hit = np.flatnonzero(status[lo: lo + n])
        if len(hit):
            rows["chunk"].append(chunk)
            rows["place"].append((start + hit).astype(np.int64).tobytes())
            rows["status"].append(status[lo: lo + n][hit].tobytes())
        lo += n
    return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "kind": pa.array([kind] * len(rows["chunk"]), pa.int32()),
                     "place": pa.array(rows["place"], pa.binary()), "status": pa.array(rows["status"], pa.binary())})


def _status(answers: pa.Table, kind: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint8)
    for k, place, status in zip(*(answers.column(c).to_pylist() for c in ("kind", "place", "status"))):
        if k == kind:
            out[np.frombuffer(place, np.int64)] = np.frombuffer(status, np.uint8)
    return out


def _covered(chunk: Chunk, answers: pa.Table) -> np.ndarray:
    """Which bytes of the chunk lie in a repeated string."""
    change = np.zeros(len(chunk.data) + 1, np.int32)
    whole, mixed = chunk.judged(_status(answers, BLOCKS, len(chunk.keys)))
    low, high = chunk.low[whole], chunk.high[whole]
    np.add.at(change, low[low <= high], 1)
    np.add.at(change, high[low <= high] + chunk.length, -1)
    if len(mixed):
        starts, payload, place = chunk.windows(mixed)
        again = starts[_status(answers, WINDOWS, len(payload[0]))[place] > 0]
        np.add.at(change, again, 1)
        np.add.at(change, again + chunk.length, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(table: pa.Table, carry: Sequence[str], data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
    """One row per document: its bytes, removed spans and what is left."""
    n, edges = table.num_rows, offsets[offsets < len(data)]
    before, after = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
    before[1:], after[:-1] = gone[:-1], gone[1:]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    at = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n), np.diff(at))
    spans = pa.StructArray.from_arrays([pa.array(starts - offsets[doc], pa.int64()), pa.array(ends - offsets[doc], pa.int64())],
                                       names=["start", "end"])
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])])
    return pa.table({**{c: table.column(c) for c in carry}, "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                     "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans), "kept_bytes": kept.cast(pa.binary())})


def remove_repeats(docs: DataFrame, cfg: Repeats = Repeats(), text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) plus ``n_bytes`` (of the UTF-8 text),
    ``spans`` (start and end of each maximal removed run of bytes) and ``kept_bytes``.

    A byte is removed if a string of ``cfg.length`` bytes around it also starts at any other
    place, in the same or another document; strings never cross documents, and are judged on
    the input. All copies go, also the first. A null text is empty; a text shorter than
    ``cfg.length`` stays whole. Copies and repeated rows are repeats of each other. What is
    kept may end inside a character. Columns of ``docs`` named like a result are replaced.

    Texts are dealt to chunks by a digest of their row, once to rank the sample and once for
    the rest; keys go from chunks to buckets and answers back. Answers name keys by their place in
    a chunk, so the digest is of the row alone: what splits or cores a scan has may change between jobs.
    A document is never cut: one text is in one task.
    """
    spark = docs.sparkSession
    names = ["n_bytes", "spans", "kept_bytes"]
    columns = [c for c in carry or docs.columns if c.lower() not in names]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(-(-size // cfg.chunk_bytes), least)
    v, cover = difference_cover(cfg.length)
    buckets = {BLOCKS: max(-(-size * len(cover) * 17 // (v * cfg.bucket_bytes)), least),
               WINDOWS: max(-(-size * 13 // (4 * cfg.bucket_bytes)), least)}
    digest = F.xxhash64(*[F.col(c).cast("string") if c == text else F.col(c) for c in docs.columns if c == text or c in columns])
    parts = docs.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(columns)], F.col(text).cast("binary").alias("__bytes"),
                        F.pmod(digest, F.lit(chunks)).cast("bigint").alias("__chunk")).repartition(chunks, "__chunk")
    # Equal rows are in one chunk: two stand for any number of them, the first of these for all but one.
    equal = parts.groupBy(*parts.columns).agg(F.count(F.lit(1)).alias("__rows"))
    parts = equal.withColumn("__rows", F.explode(F.when(F.col("__rows") > 1, F.array(F.col("__rows") - 1, F.lit(1).cast("bigint")))
                                                 .otherwise(F.array("__rows"))))
    length, held = cfg.length, [f"__{k}" for k in range(len(columns))] + ["__rows"]

    def read(table):
        data, offsets = _bytes_of(table.column("__bytes"))
        return data, offsets, Chunk(data, offsets, length)

    def sample(key, table):
        return _packed(key[0].as_py(), read(table)[2].payload(), buckets[BLOCKS])

    def rank(table):
        return _ranked(table, BLOCKS)

    def ends(key, table, answers):
        if not table.num_rows or not answers.num_rows:
            return _packed(0, (np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)), 1)
        chunk = read(table)[2]
        return _packed(key[0].as_py(), chunk.windows(chunk.judged(_status(answers, BLOCKS, len(chunk.keys)))[1])[1], buckets[WINDOWS])

    def sort(table):
        return _ranked(table, WINDOWS)

    def cut(table, answers):
        data, offsets = _bytes_of(table.column("__bytes"))
        gone = _covered(Chunk(data, offsets, length), answers) if answers.num_rows else np.zeros(len(data), bool)
        return _cut(table, held, data, offsets, gone)

    ranks = parts.groupBy("__chunk").applyInArrow(sample, _PAYLOAD).groupBy("bucket").applyInArrow(rank, _ANSWER)
    # The keys' shuffle is the largest: it goes before the windows' begins. Both steps below read the answers.
    ranks = keep(ranks, "ranks", free=True).repartition(chunks, "chunk")
    windows = parts.groupBy("__chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(ends, _PAYLOAD)
    sorted_ = windows.groupBy("bucket").applyInArrow(sort, _ANSWER).repartition(chunks, "chunk")
    schema = T.StructType([T.StructField(h, docs.schema[c].dataType) for h, c in zip(held, columns)] + T._parse_datatype_string(
        "__rows bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept_bytes binary").fields)
    out = parts.groupBy("__chunk").cogroup(ranks.unionByName(sorted_).groupBy("chunk")).applyInArrow(cut, schema)
    out = out.withColumn("__rows", F.explode(F.sequence(F.lit(1).cast("bigint"), "__rows")))
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, columns)], *names)
