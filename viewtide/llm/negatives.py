"""Hard negatives by rotated one-bit codes with a deterministic bound.

A vector is scaled to length one, rotated, and stored as the signs of its components. With
the code's own unit vector c and the stored alignment a = <o, c>, the vector is
``a c + e`` where e is orthogonal to c and has the stored length. What e leaves is coded
again by the next rotation, and so on for a few levels, each one word of bits per 64
components. A query is rounded to small integers once per rotation, so that its product
with a code is a sum of popcounts; the rounding error is kept too. By Cauchy-Schwarz the
last remainder and the rounding change the product by no more than a known amount, so
every score lies in a certain interval. Rows whose interval cannot matter any more are
skipped, the others are scored in integers. Nothing is approximate in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewtide.llm.scratch import folder, keep, map_text

SLACK = 1e-6  # of the product of the lengths: more than double rounding can add


@dataclass(frozen=True)
class Mining:
    """``positives`` per anchor and ``negatives`` per positive. A negative's score lies
    between ``band`` percent of the positive's. Codes have ``levels`` words per 64
    components, queries ``query_bits`` bits. ``block`` anchors are searched at once, over
    ``batch`` rows at a time."""

    positives: int = 5
    negatives: int = 10
    band: tuple[int, int] = (30, 90)
    levels: int = 4
    query_bits: int = 8
    block: int = 1024
    batch: int = 2048
    seed: int = 7


def integer_rows(df: DataFrame, label: Column, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, label, v`` of the rows that take part: ``v`` is ``floor(scale * x)`` of each
    component, x as double.

    Rows with a null id, label or vector, or with a null or non-finite component take no
    part. Products are exact while they stay below 2 ** 63 (components below 2 ** 20 or so).
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.filter(F.col(id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull()).filter(good)
    return rows.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                       F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros, which change no product."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width), np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    inside = np.arange(width) < sizes[:, None]
    out[inside] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Codes:
    """Rotations of one width, and the codes and bounds they give."""

    def __init__(self, width: int, cfg: Mining):
        self.width, self.cfg, self.size = width, cfg, -(-max(width, 1) // 64) * 64
        rng = np.random.default_rng(cfg.seed)
        self.rotations = [np.linalg.qr(rng.standard_normal((self.size, self.size)))[0] for _ in range(cfg.levels)]

    def _unit(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = np.zeros((len(v), self.size))
        long[:, : self.width] = v
        length = np.linalg.norm(long, axis=1)
        return long / np.maximum(length, 1e-300)[:, None], length

    def encode(self, v: np.ndarray) -> dict:
        """Codes of rows: bits of every level, alignments, length of the last remainder."""
        rest, length = self._unit(v)
        bits, align = [], []
        for turn in self.rotations:
            turned = rest @ turn
            sign = turned >= 0
            code = np.where(sign, 1.0, -1.0) / np.sqrt(self.size)
            a = (turned * code).sum(1)
            bits.append(np.packbits(sign, axis=1, bitorder="little").view(np.uint64))
            align.append(a)
            rest = (turned - a[:, None] * code) @ turn.T
        return {"bits": bits, "align": np.stack(align), "rest": np.linalg.norm(rest, axis=1), "length": length}

    def query(self, v: np.ndarray) -> dict:
        """Rounded rotated queries as bit planes, their steps, and the rounding error."""
        unit, length = self._unit(v)
        top = 2 ** (self.cfg.query_bits - 1) - 1
        planes, steps, sums, errors = [], [], [], []
        for turn in self.rotations:
            turned = unit @ turn
            step = np.maximum(np.abs(turned).max(1, initial=0.0), 1e-300) / top
            whole = np.rint(turned / step[:, None])
            errors.append(np.linalg.norm(turned - whole * step[:, None], axis=1))
            shifted = (whole + top + 1).astype(np.uint16)
            planes.append([np.packbits((shifted >> b & 1).astype(bool), axis=1, bitorder="little").view(np.uint64)
                           for b in range(self.cfg.query_bits)])
            steps.append(step)
            sums.append(shifted.sum(1).astype(np.int64))
        return {"planes": planes, "step": steps, "sum": sums, "error": errors, "length": length}

    def bounds(self, q: dict, r: dict) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every query's product with every row."""
        nq, nr, top = len(q["length"]), len(r["length"]), 2 ** (self.cfg.query_bits - 1)
        value, room = np.zeros((nq, nr)), np.zeros((nq, nr))
        for level, bits in enumerate(r["bits"]):
            ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
            both = np.zeros((nq, nr), np.int64)
            for b, plane in enumerate(q["planes"][level]):
                for w in range(bits.shape[1]):
                    both += np.bitwise_count(plane[:, w, None] & bits[None, :, w]).astype(np.int64) << b
            # Signs are 2 * bit - 1, query components are shifted by ``top``.
            product = 2 * both - q["sum"][level][:, None] - top * (2 * ones - self.size)[None, :]
            unit = product * (q["step"][level] / np.sqrt(self.size))[:, None]
            value += r["align"][level] * unit
            room += np.abs(r["align"][level]) * q["error"][level][:, None]
        room += r["rest"]
        scale = q["length"][:, None] * r["length"]
        room = (room + SLACK) * scale
        return value * scale - room, value * scale + room


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, smaller id first among equals."""
    return np.lexsort((ids, -scores))[:n]


class _Lists:
    """The best ``n`` rows seen for each list, with the score that a new row must reach."""

    def __init__(self, count: int, n: int):
        self.n, self.ids, self.scores = n, [np.zeros(0, np.int64)] * count, [np.zeros(0, np.int64)] * count
        self.least = np.full(count, -np.inf)

    def add(self, k: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[k], ids]), np.concatenate([self.scores[k], scores])
        order = _best(ids, scores, self.n)
        self.ids[k], self.scores[k] = ids[order], scores[order]
        if len(order) == self.n:
            self.least[k] = self.scores[k][-1]

    def rows(self) -> list[np.ndarray]:
        sizes = [len(i) for i in self.ids]
        return [np.repeat(np.arange(len(sizes)), sizes), *(np.concatenate(x) if len(x) else np.zeros(0, np.int64)
                                                           for x in (self.ids, self.scores))]


def _found(rows: DataFrame, width: int, cfg: Mining, anchors: dict, lists: dict | None) -> DataFrame:
    """``slot, id, score``: each task's best rows of every anchor (``lists`` None: others of
    its label) or of every positive (``lists``: anchor, lower and upper score; other labels)."""
    n = cfg.positives if lists is None else cfg.negatives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(width, cfg)
        asked = codes.query(anchors["v"])
        count = len(anchors["id"]) if lists is None else len(lists["anchor"])
        best = _Lists(count, n)
        for whole in batches:
            for lo in range(0, whole.num_rows, cfg.batch):
                batch = whole.slice(lo, cfg.batch)
                ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
                v = as_matrix(batch.column("v"), width)
                low, high = codes.bounds(asked, codes.encode(v))
                same = labels[None, :] == anchors["label"][:, None]
                if lists is None:
                    may = same & (ids[None, :] != anchors["id"][:, None]) & (high >= best.least[:, None])
                    for k in np.flatnonzero(may.any(1)):
                        at = np.flatnonzero(may[k])
                        best.add(k, ids[at], v[at] @ anchors["v"][k])
                else:
                    for a in np.unique(lists["anchor"]):
                        mine = np.flatnonzero(lists["anchor"] == a)
                        # A row matters if its interval meets the band of some positive and can enter that list.
                        floor = np.maximum(lists["low"][mine], best.least[mine])
                        reach = (high[a] >= floor.min()) & (low[a] <= lists["high"][mine].max()) & ~same[a]
                        at = np.flatnonzero(reach)
                        if not len(at):
                            continue
                        scores = v[at] @ anchors["v"][a]
                        for k, f in zip(mine, floor):
                            inside = (scores >= f) & (scores <= lists["high"][k])
                            if inside.any():
                                best.add(k, ids[at[inside]], scores[inside])
        slots, ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (slots, ids, scores)], names=["slot", "id", "score"])

    found = map_text(rows.select("id", "label", "v"), run, "slot bigint, id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("slot").orderBy(F.col("score").desc(), "id")))
    return ranked.filter(F.col("rank") <= n)


def mine(rows: DataFrame, is_anchor: Column, cfg: Mining = Mining()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``id, label, v`` (``integer_rows``). The score of a row is its integer
    inner product with the anchor; higher scores come first, ties by smaller id. An
    anchor's positives are its first rows of the same label and another id; a positive's
    negatives the first rows of another label whose score times 100 lies within the band
    times the positive's score (so a negative positive score has none). All of them, if
    there are fewer. Rows that occur twice count twice, and an anchor that does has its
    lists twice. Vectors of unlike length are taken as ending in zeros. No anchors or no
    rows: an empty result.

    The anchors are the stated query set. They are worked in blocks of ``cfg.block``, one
    after the other, whatever their number: a block with its codes goes to every task, a
    task returns its best few rows for each list, and those meet per list. No row is moved.
    """
    spark = rows.sparkSession
    rows = keep(rows, "vectors")
    place = folder(spark, "negatives")
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
              "negative_score bigint")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    asked = rows.filter(is_anchor)
    numbered = keep(asked.withColumn("at", F.monotonically_increasing_id()), "anchors")
    last, blocks = None, 0
    while True:
        # The next block in the order of the running number; at most ``block`` rows come here.
        rest = numbered if last is None else numbered.filter(F.col("at") > last)
        some = rest.orderBy("at").limit(cfg.block).toArrow()
        if not some.num_rows:
            break
        last, blocks = some.column("at")[-1].as_py(), blocks + 1
        anchors = {"id": some.column("id").to_numpy(), "label": some.column("label").to_numpy(),
                   "v": as_matrix(some.column("v"), width)}
        near = _found(rows, width, cfg, anchors, None).select("slot", "id", "score", "rank").toArrow()
        slot, score = near.column("slot").to_numpy(), near.column("score").to_numpy()
        # In integers, so that a score on the edge of the band is on the right side of it.
        lists = {"anchor": slot, "low": -(-cfg.band[0] * score // 100), "high": cfg.band[1] * score // 100}
        if not len(slot):
            continue
        names = spark.createDataFrame(pa.table({
            "slot": pa.array(np.arange(len(slot))), "anchor_id": pa.array(anchors["id"][slot]),
            "positive_id": near.column("id"), "positive_score": near.column("score")}))
        found = _found(rows, width, cfg, anchors, lists).join(F.broadcast(names), "slot")
        found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                     F.col("score").alias("negative_score")).write.mode("append").parquet(place)
    if not blocks or last is None:
        return spark.createDataFrame([], schema)
    spark.createDataFrame([], schema).write.mode("append").parquet(place)
    return spark.read.schema(schema).parquet(place)
