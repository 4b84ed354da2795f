"""Near-duplicate documents: SetSketch registers, banded, estimated by likelihood, verified.

A document's word shingles are one set. Each of ``m`` registers keeps the least of the
set's exponentially distributed hash values, written as a truncated power of a base near
one. Registers of two sets merge by maximum and agree about as often as the sets' Jaccard
similarity, so equal runs of registers (bands) bring likely pairs together. For a pair the
counts of greater, smaller and equal registers give a joint likelihood of the similarity,
given both set sizes; pairs far below the threshold are left, all others are compared on
their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewtide.llm import words
from viewtide.llm.graph import connected_components
from viewtide.llm.scratch import keep, map_text

U64 = words.U64


@dataclass(frozen=True)
class Sketch:
    """Register layout. Registers are ``floor(1 - log_base(x))`` of the least value ``x``
    with rate ``rate``, truncated to 16 bits."""

    threshold: float
    rows: int = 4            # registers in a band
    miss: float = 1e-7       # chance that a pair at the threshold shares no band
    base: float = 1.001
    rate: float = 20.0
    slack: float = 6.0       # standard deviations below the threshold that are still verified

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-self.threshold**self.rows))

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        odd = rng.integers(0, 2**64, self.size, dtype=U64) | U64(1)
        add = rng.integers(0, 2**64, self.size, dtype=U64)
        least = np.full(self.size, U64(2**64 - 1))
        for i in range(0, len(shingles), 8192):
            part = odd[:, None] * shingles[None, i: i + 8192] + add[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-53)) / self.rate
        return np.clip(np.floor(1 - np.log(x) / math.log(self.base)), 0, 65535).astype("<u2")

    def estimate(self, ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Most likely similarity of each pair from register rows and set sizes."""
        up, down = (ka > kb).sum(1), (ka < kb).sum(1)
        same = self.size - up - down
        u, v = na / (na + nb), nb / (na + nb)

        def p(x):
            x = np.clip(x, 0, 1)
            return np.clip(-np.log1p(-x * (self.base - 1) / self.base) / math.log(self.base), 1e-12, 1 - 1e-12)

        def likelihood(j):
            more, less = p(u - v * j), p(v - u * j)
            return up * np.log(more) + down * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

        low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
        for _ in range(30):  # the likelihood is concave: narrow by thirds
            third = (high - low) / 3
            right = likelihood(low + third) < likelihood(high - third)
            low, high = np.where(right, low + third, low), np.where(right, high, high - third)
        return (low + high) / 2

    def floor(self) -> float:
        t = self.threshold
        return t - self.slack * math.sqrt(t * (1 - t) / self.size)


def _fingerprints(sketch: Sketch, ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in words.column_words(batch.column("__text")):
                sizes, classes, registers = [], [], []
                for s in words.shingles(found, ngram):
                    sizes.append(len(s))
                    classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    registers.append(sketch.registers(s).tobytes() if len(s) else None)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), part.column("__tkey"), pa.array(sizes, pa.int64()),
                     pa.array(classes, pa.binary()), pa.array(registers, pa.binary())],
                    names=["__id", "__tkey", "n_shingles", "cls", "registers"])
    return run


def _verified(sketch: Sketch, ngram: int, percent: tuple[int, int]):
    """Keep the pairs whose full sets reach ``percent[0] / percent[1]``."""
    need, of = percent
    floor = sketch.floor()

    def sets(column: pa.Array, wanted: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, _, found in words.column_words(column.filter(pa.array(wanted))):
            out += words.shingles(found, ngram)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, sketch.size) for c in ("ra", "rb")]
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            likely = sketch.estimate(regs[0], regs[1], na, nb) >= floor
            for lo in range(0, batch.num_rows, 256):  # sets of few pairs are held at once
                part, some = batch.slice(lo, 256), likely[lo: lo + 256]
                if not some.any():
                    continue
                linked = np.zeros(part.num_rows, bool)
                for k, a, b in zip(np.flatnonzero(some), sets(part.column("ta"), some), sets(part.column("tb"), some)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked[k] = of * both >= need * (len(a) + len(b) - both)
                yield part.select(["a", "b"]).filter(pa.array(linked))
    return run


def near_duplicates(docs: DataFrame, ngram: int = 3, percent: tuple[int, int] = (85, 100), id: str = "doc_id",
                    text: str = "text", growth: int = 16) -> DataFrame:
    """``id, __tkey, n_shingles, group, component_id, kept`` for each row of ``docs``.

    Rows whose ``ngram``-word shingle sets have at least ``percent`` Jaccard similarity are
    linked; ``component_id`` is the least id reachable over links, ``kept`` marks the row
    that carries it. ``group`` names the component (null without words); ``__tkey`` is
    ``xxhash64(text)``: with the id it names a row's content.
    Other columns of ``docs`` are not read, whatever their names.

    Rows with equal sets are one class from the start, so exact copies never form pairs.
    Classes meet in buckets of equal bands, where all are compared with one representative.
    The classes of buckets that still hold several components then meet again in exact
    buckets: two sets at the threshold must share one of their rarest shingles. Such a
    bucket is worked in rounds: its least member is compared with all others, then 16 more
    members, then 256, until each pair has been compared or joined through others. So one
    group of near copies costs its size, not its square, and no link is lost: a pair is
    only skipped when both are in one component already.

    Null or empty text, or text of white space: no shingles, linked with nothing. A null id
    takes part like any other and counts as greatest; a component of null ids alone has a
    null ``component_id``. Repeated rows give repeated result rows. An empty table gives an
    empty result.
    """
    need, of = percent
    sketch = Sketch(need / of)
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__tkey"))
    id_type = rows.schema["__id"].dataType.simpleString()
    prints = keep(map_text(rows, _fingerprints(sketch, ngram),
                          f"__id {id_type}, __tkey bigint, n_shingles bigint, cls binary, registers binary"))
    classes = prints.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.first("n_shingles").alias("n"), F.first("registers").alias("registers"),
        F.min(F.struct("__id", "__tkey")).alias("at"), F.min("__id").alias("least_id"))
    comps = _components(classes, rows, sketch, ngram, percent, growth)
    known = prints.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("__id").alias("least_id"))
    if comps is None:
        least = known.select("cls", F.col("cls").alias("group"), F.col("least_id").alias("component_id"))
    else:
        rooted = known.join(comps, "cls", "left").withColumn("group", F.coalesce("root", "cls"))
        merged = rooted.groupBy("group").agg(F.min("least_id").alias("component_id"))
        least = rooted.join(merged, "group").select("cls", "group", "component_id")
    out = prints.drop("registers").join(least, "cls", "left").withColumn(
        "component_id", F.when(F.col("cls").isNull(), F.col("__id")).otherwise(F.col("component_id")))
    return out.select(F.col("__id").alias(id), "__tkey", "n_shingles", "group", "component_id",
                      F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: that of the least id, and
    of the least ``xxhash64(text)`` if a group has several texts of that id. Rows without
    words stay, repeated rows of one id and text are one row. All columns are kept."""
    found = near_duplicates(docs, id=id, text=text, **options).filter("kept")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    grouped = found.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(name(id).alias("i"), "__tkey")).alias("m"))
    chosen = grouped.select("m.i", "m.__tkey").unionByName(
        found.filter("group IS NULL").select(name(id).alias("i"), "__tkey").distinct())
    chosen = keep(chosen.withColumnsRenamed({"i": "__i", "__tkey": "__t"}), "chosen")
    held = {f"__c{k}": c for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(h) for h, c in held.items()], name(id).alias("__i"), F.xxhash64(text).alias("__t"))
    return rows.join(chosen, ["__i", "__t"]).dropDuplicates(["__i", "__t"]).select(
        *[F.col(h).alias(c) for h, c in held.items()])


def _components(classes: DataFrame, rows: DataFrame, sketch: Sketch, ngram: int, percent: tuple[int, int],
                growth: int) -> DataFrame | None:
    """``cls, root`` of the classes linked with another, or None when there are none."""
    width = 2 * sketch.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(sketch.bands - 1)),
                       lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))))
    members = _members(classes.select("cls", "n", F.lit(1).cast("bigint").alias("place"), F.explode(keys).alias("bucket")))
    at_band = members.select("cls").distinct()
    wanted = classes.join(at_band, "cls", "left_semi")
    found = wanted.join(rows, F.col("at.__id").eqNullSafe(F.col("__id")) & (F.col("at.__tkey") == F.col("__tkey")))
    data = keep(found.select("cls", "n", "registers", F.col("__text").alias("text")).dropDuplicates(["cls"]))
    if data.isEmpty():
        return None
    compare = _Compare(data, sketch, ngram, percent)
    comps = compare.merged(None, compare.links(_with_roots(members, None), F.col("u") == F.col("first")))

    still = _mixed(_with_roots(members, comps)).select("cls").distinct()
    members = _members(_prefixes(data.join(still, "cls", "left_semi"), ngram, percent))
    live, low, high = _with_roots(members, comps), 0, 1
    share = (F.col("u").cast("double") / 2.0**64 + 0.5) * F.col("size")  # uniform in [0, size)
    while True:
        live = keep(_mixed(live))
        largest = live.agg(F.max("size")).first()[0]
        if largest is None:
            return comps
        reps = F.col("u") == F.col("first") if not low else (share >= (low if low > 1 else 0)) & (share < high)
        links = compare.links(live, reps)
        comps = compare.merged(comps, links)
        if low and high >= largest:
            return comps
        low, high = high, high * growth
        live = _with_roots(live.drop("root"), comps)


def _members(keyed: DataFrame) -> DataFrame:
    """The keyed rows plus ``u, size, first``: the members of each bucket that has several."""
    keyed = keyed.withColumn("u", F.xxhash64("cls"))
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("u").alias("first")).filter("size > 1")
    return keep(keyed.join(buckets, "bucket"))


def _with_roots(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("root", F.col("cls"))
    return members.join(comps, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _mixed(live: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components."""
    mixed = live.withColumn("h", F.xxhash64("root")).groupBy("bucket").agg(
        F.min("h").alias("x"), F.max("h").alias("y")).filter("x <> y").select("bucket")
    return live.join(mixed, "bucket", "left_semi")


def _prefixes(data: DataFrame, ngram: int, percent: tuple[int, int]) -> DataFrame:
    """``cls, n, place, bucket``: the shingles one of which a class shares with any other at the
    threshold: its ``n - ceil(n * threshold) + 1`` rarest. Shingles of one class only come
    first in that order and meet nobody, so edited copies keep few or none."""
    need, of = percent

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in words.column_words(batch.column("text")):
                sets = words.shingles(found, ngram)
                of_set = pa.array(np.repeat(np.arange(i, j), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls").take(of_set), batch.column("n").take(of_set),
                     pa.array(np.concatenate(sets).view(np.int64))], names=["cls", "n", "bucket"])

    every = map_text(data.select("cls", "n", "text"), explode, "cls binary, n bigint, bucket bigint")
    shared = every.groupBy("bucket").agg(F.count("*").alias("df")).filter("df > 1")
    common = every.join(shared, "bucket").withColumn("had", F.count("*").over(W.partitionBy("cls")))
    prefix = F.expr(f"n - cast(ceil(n * {need} / {of}) as bigint) + 1 - (n - had)")
    place = F.row_number().over(W.partitionBy("cls").orderBy("df", "bucket"))
    prefixes = common.withColumn("place", place).filter(F.col("place") <= prefix)
    return prefixes.select("cls", "n", (F.expr("n - had") + F.col("place")).alias("place"), "bucket")


class _Compare:
    """Finds the links between representatives and the members of their buckets."""

    def __init__(self, data: DataFrame, sketch: Sketch, ngram: int, percent: tuple[int, int]):
        need, of = percent
        self.sides = [data.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("registers").alias(f"r{s}"),
                                  F.col("text").alias(f"t{s}")) for s in "ab"]
        self.verified = _verified(sketch, ngram, percent)
        # The sets' lengths must allow the threshold, and so must what can still be common
        # from the bucket's shingle on, as it does at the first shingle that two sets share.
        rest = 1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
        self.fits = (F.least("n", "other_n") * of >= F.greatest("n", "other_n") * need) & (
            rest * (of + need) >= (F.col("n") + F.col("other_n")) * need)

    def links(self, live: DataFrame, is_rep) -> DataFrame:
        reps = live.filter(is_rep).select("bucket", F.col("u").alias("v"), F.col("cls").alias("other"),
                                          F.col("n").alias("other_n"), F.col("place").alias("other_place"),
                                          F.col("root").alias("other_root"))
        pairs = live.join(reps, "bucket").filter((F.col("u") > F.col("v")) & (F.col("root") != F.col("other_root"))
                                                 & self.fits)
        pairs = pairs.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()
        full = pairs.join(self.sides[0], "a").join(self.sides[1], "b")
        return keep(map_text(full.select("a", "b", "na", "nb", "ra", "rb", "ta", "tb"), self.verified,
                             "a binary, b binary"))

    def merged(self, comps: DataFrame | None, links: DataFrame) -> DataFrame | None:
        """The components after adding links."""
        if links.isEmpty():
            return comps
        if comps is None:
            return connected_components(links).withColumnRenamed("node", "cls")
        edges = links.join(comps.withColumnsRenamed({"cls": "a", "root": "x"}), "a", "left").join(
            comps.withColumnsRenamed({"cls": "b", "root": "y"}), "b", "left").select(
                F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
        joined = connected_components(edges, "x", "y").withColumnRenamed("root", "new")
        moved = comps.join(joined.withColumnRenamed("node", "root"), "root", "left").select(
            "cls", F.coalesce("new", "root").alias("root"))
        fresh = joined.join(comps.select(F.col("cls").alias("node")), "node", "left_anti").select(
            F.col("node").alias("cls"), F.col("new").alias("root"))
        return keep(moved.unionByName(fresh))
