"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time. Its integral, scaled to the
source's target, is the cumulative demand for the source's words. The words a document
brings occupy an interval of its source's supply; inverting the demand at the middle of
that interval gives the training position of the document's use, and a range sort by
position gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewtide.llm.scratch import keep

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Curriculum:
    """``weights`` repeat over the sources in code-point order, null last. A target stops
    at ``most`` times its source's size. ``ramps`` repeat likewise: a source's weight moves
    linearly from ``1 - ramp`` to ``1 + ramp`` of its mean over the training run."""

    weights: Sequence[int] = (5, 2, 1)
    most: int = 3
    ramps: Sequence[float] = (-0.5, 0.25, 0.5)
    slice_docs: int = 2_000


def source_targets(sources: DataFrame, cfg: Curriculum = Curriculum()) -> DataFrame:
    """``source, source_size, docs, place, target`` from one row ``source, source_size, docs``
    per source.

    Targets are ``least(level * weight, most * size)`` with the level that shares the sum of
    all sizes: sources stop at their limit in the order of limit per weight, and the level
    is that of the first rest which stays below its limits. The windows run over one row
    per source, not over documents.
    """
    n = len(cfg.weights)
    weight = F.element_at(F.array(*map(F.lit, cfg.weights)), (F.col("place") % n + 1).cast("int"))
    placed = sources.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.withColumns({"weight": weight.cast("bigint"), "limit": F.col("source_size") * cfg.most})
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), "place")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = placed.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "share": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # Above its limit if the level of the rest that starts here exceeds it.
    stops = rest.withColumn("stops", F.col("left") * F.col("weight") > F.col("limit") * F.col("share"))
    free = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), "place", "left", "share"))).over(every)
    level = stops.withColumn("free", free)
    fair = F.col("free.left") * F.col("weight") / F.col("free.share")
    return level.select("source", "source_size", "docs", "place", F.when(
        F.col("stops") | F.col("free").isNull(), F.col("limit").cast("double")).otherwise(
            F.least(fair, F.col("limit").cast("double"))).alias("target"))


def sized(docs: DataFrame, text: str = "text") -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _floor_power(x: Column) -> Column:
    """The greatest power of two up to ``x``, exactly; 0 below 1."""
    return F.when(x >= 1, F.pow(F.lit(2.0), F.length(F.bin(F.floor(x))) - 1)).otherwise(0).cast("bigint")


def _fill(rest: pd.DataFrame) -> pd.DataFrame:
    """Which documents of one source close the gap that its first round left: in every round
    those up to the greatest power of two in the gap, in order, until one is too long."""
    rest = rest.sort_values("supply")
    size, used = rest["size"].to_numpy(), np.zeros(len(rest), bool)
    part, first = float(rest["part"].iloc[0]), int(rest["words"].iloc[0])
    while (gap := part - (first + int(size[used].sum()))) >= 1:
        at = np.flatnonzero(~used & (size <= 1 << (int(gap).bit_length() - 1)))
        fits = at[np.cumsum(size[at]) <= gap]
        if not len(fits):
            break
        used[fits] = True
    return rest.loc[used, ["place", "supply", "size"]]


def mix(docs: DataFrame, cfg: Curriculum = Curriculum(), id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """``__id, __tkey, source, place, size, source_size, target, uses, taken, supply, passes,
    last`` for each row.

    A source's documents stand in the order of the MD5 of their id, then id, then text.
    The source's supply is that order repeated as often as the target holds it whole, then
    a last pass over some of it. The last pass is filled in rounds: of the unused documents
    up to the greatest power of two that is no larger than what is left, those in order until
    one is too long. Each round at least halves what is left, or leaves no document of that
    size, so that no long document keeps shorter ones out. Then the one unused document that
    brings the taken words nearest to the target is added, if one does. Documents are used
    whole, at most ``most`` times, and reruns agree. ``taken`` is uses times size; ``supply``
    counts the words before the document in one full pass, ``last`` those in the last one.

    A null text has size 0, and so has one without words: it is never taken. Documents of
    null source form a source of their own. Repeated rows count each time. An empty table
    gives an empty result. Other columns are not read.

    A source may hold any share of the rows: its documents are cut into slices of about
    ``slice_docs`` by the digest, prefix sums run within a slice, and slices are shifted by
    the sums of earlier ones. After the first round less than its longest document is left;
    later rounds need only the first documents of each size, fewer than four times as many
    as words are left and one slice, and run in one task for each source.
    """
    key = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")))
    rows = keep(docs.select(F.col(id).alias("__id"), F.xxhash64(text).alias("__tkey"), F.col(source).alias("source"),
                            sized(docs, text).alias("size"), key.alias("key")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = keep(source_targets(totals, cfg), "targets")
    parts = F.ceil(F.col("docs") / cfg.slice_docs)
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    joined = rows.withColumnRenamed("source", "s").join(
        targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).withColumnRenamed("s", "source")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sliced = joined.withColumn("slice", F.floor(spot * parts)).withColumn("passes", passes.cast("bigint")).withColumn(
        "part", F.col("target") - F.col("passes") * F.col("source_size"))
    sliced = sliced.withColumn("fit", F.when(F.col("size") <= _floor_power(F.col("part")), F.col("size")).otherwise(0))
    inner = W.partitionBy("place", "slice").orderBy("key", F.col("__id").asc_nulls_last(), "__tkey").rowsBetween(
        W.unboundedPreceding, -1)
    sums = sliced.groupBy("place", "slice").agg(F.sum("size").alias("size"), F.sum("fit").alias("fit"))
    before = W.partitionBy("place").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    earlier = sums.select("place", "slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_earlier") for c in ("size", "fit")])
    placed = sliced.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in ("size", "fit")}).join(
        earlier, ["place", "slice"])
    placed = placed.withColumns({"supply": F.col("size_inside") + F.col("size_earlier"), "last": F.col("fit_inside") + F.col("fit_earlier")})
    placed = placed.withColumn("whole", (F.col("fit") > 0) & (F.col("last") + F.col("fit") <= F.col("part")))
    part = keep(placed.select("__id", "__tkey", "source", "place", "slice", "key", "size", "source_size", "target", "passes",
                              "part", "supply", "last", "whole"), "placed")
    words = keep(part.groupBy("place").agg(F.sum(F.when(F.col("whole"), F.col("size")).otherwise(0)).alias("words"),
                                           F.first("part").alias("part")), "words")
    open_ = part.drop("part").filter("NOT whole AND size > 0").join(words.filter("part > 0"), "place").withColumn(
        "gap", F.col("part") - F.col("words"))
    # The later rounds: documents by size class, as many of each in order as could be taken.
    small = open_.filter(F.col("size") <= _floor_power(F.col("gap"))).withColumn(
        "class", F.when(F.col("size") == 1, 0).otherwise(F.length(F.bin(F.col("size") - 1))))
    per_class = W.partitionBy("place", "class").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    enough = 2 * F.col("gap") / F.pow(F.lit(2.0), F.col("class")) + 2
    slices = small.groupBy("place", "class", "slice", "gap").agg(F.count("*").alias("n")).withColumn(
        "sooner", F.coalesce(F.sum("n").over(per_class), F.lit(0))).filter(F.col("sooner") < enough).select("place", "class", "slice")
    rest = small.join(slices, ["place", "class", "slice"]).select("place", "supply", "size", "part", "words")
    more = keep(rest.groupBy("place").applyInPandas(_fill, "place bigint, supply bigint, size bigint"), "more")
    closed = more.groupBy("place").agg(F.sum("size").alias("closed"))
    chosen = more.select("place", "supply", F.lit(True).alias("chosen"))
    # What is still open is filled by the one document that comes nearest, if any does.
    left = open_.join(chosen, ["place", "supply"], "left").filter("chosen IS NULL").join(closed, "place", "left").withColumn(
        "miss", F.col("gap") - F.coalesce(F.col("closed"), F.lit(0)))
    best = left.filter(F.abs(F.col("miss") - F.col("size")) < F.col("miss")).groupBy("place").agg(F.min(F.struct(
        F.abs(F.col("miss") - F.col("size")), "key", F.col("__id").isNull(), "__id", "__tkey", "supply")).alias("best"))
    extra = chosen.unionByName(best.select("place", F.col("best.supply").alias("supply"), F.lit(True).alias("chosen")))
    # A document with words is known by its place in the supply.
    out = part.join(extra.withColumnRenamed("supply", "at"), [part["place"] == extra["place"], F.col("supply") == F.col("at"),
                                                              F.col("size") > 0], "left").drop(extra["place"]).join(
        words.select("place", "words"), "place")
    uses = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("whole") | F.col("chosen"), 1).otherwise(0))
    uses = F.coalesce(uses, F.lit(0)).cast("bigint")
    return out.select("__id", "__tkey", "source", "place", "size", "source_size", "target", uses.alias("uses"),
                      (uses * F.col("size")).alias("taken"), "supply", "passes",
                      F.when(F.col("whole"), F.col("last")).otherwise(F.col("words")).alias("last"))


def position(cfg: Curriculum, demand: Column, place: Column) -> Column:
    """Training time in [0, 1] at which a source has been asked for the share ``demand`` of
    its target: the inverse of the integral of ``1 - ramp + 2 * ramp * t``."""
    ramp = F.element_at(F.array(*map(F.lit, map(float, cfg.ramps))), (place % len(cfg.ramps) + 1).cast("int"))
    y = F.least(F.greatest(demand, F.lit(0.0)), F.lit(1.0))
    # ramp * t^2 + (1 - ramp) * t = y, in the form that holds for ramp 0 too.
    below = (1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * y)
    return F.coalesce(F.try_divide(2 * y, below), F.lit(0.0))


def uses(mixed: DataFrame, cfg: Curriculum = Curriculum()) -> DataFrame:
    """One row per use of the rows of ``mix``: their columns plus ``use_no`` (0, 1, ..) and
    ``train_position``. Unused documents have no row."""
    used = mixed.filter("uses > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int"))).alias("use_no"))
    # Words of the source that are asked for before this use: the last pass holds only some documents.
    sooner = F.when(F.col("use_no") < F.col("passes"), F.col("supply")).otherwise(F.col("last"))
    middle = sooner + F.col("size") / 2 + F.col("use_no") * F.col("source_size")
    return used.withColumn("train_position", position(cfg, middle / F.col("target"), F.col("place")))


def in_order(uses: DataFrame) -> DataFrame:
    """The uses in training order: range-sorted by position."""
    return uses.repartitionByRange("train_position").sortWithinPartitions("train_position")


def curriculum(docs: DataFrame, cfg: Curriculum = Curriculum(), id: str = "doc_id", text: str = "text",
               source: str = "source") -> DataFrame:
    """One row per use of a document: its columns plus ``use_no`` (0, 1, ..) and
    ``train_position``, range-sorted by position. Unused documents have no row. Columns of
    ``docs`` with these names are replaced. Repeated rows are one document used as often as
    each of them is."""
    at = uses(mix(docs, cfg, id, text, source), cfg)
    # Copies of one row (same id and text) are told apart by number, so that the join
    # neither multiplies nor loses them.
    copy = W.partitionBy("__id", "__tkey", "use_no").orderBy("train_position")
    wanted = at.withColumn("__nth", F.row_number().over(copy)).select("__id", "__tkey", "__nth", "use_no", "train_position")
    columns = [c for c in docs.columns if c.lower() not in ("use_no", "train_position")]
    numbered = docs.select(*[F.col(c).alias(f"__c{k}") for k, c in enumerate(columns)], F.col(id).alias("__i"),
                           F.xxhash64(text).alias("__t"))
    numbered = numbered.withColumn("__copy", F.row_number().over(W.partitionBy("__i", "__t").orderBy(F.lit(1))))
    joined = numbered.join(wanted, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__tkey"))
                           & (F.col("__copy") == F.col("__nth")))
    out = joined.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(columns)], "use_no", "train_position")
    return in_order(out)
