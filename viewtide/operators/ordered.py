"""Order-dependent work over keys that may be far larger than one task.

``positions`` numbers rows within a key. ``ordered_fold`` runs a small sequential state
machine along each key's rows. Both give the same result as one pass over each key in
order, without ever needing a whole key in one task.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewtide.functions.transport import ddl, pack_times, unpack_times
from viewtide.session import cut


# --- running positions -------------------------------------------------------------------

SMALL = 1_000_000  # rows of a hot-key table that may be broadcast


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame | None, int, int]:
    """Keys with more than ``limit`` rows (at most |df| / limit of them), how many there
    are, and the rows of the largest. One pass over the key columns alone."""
    sizes = cut(df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit))
    worst, n = sizes.agg(F.max("__n"), F.count("*")).first()
    return (sizes.select(*keys), n, worst) if n else (None, 0, 0)


def running_positions(df: DataFrame, keys: list[str], ts: str, tiebreak: str, frames: dict[str, str | None],
                      counted: str = "true", seconds: int = 60, hot_rows: int = 1_000_000) -> DataFrame:
    """Running count of ``counted`` rows in time order within the key, once per frame.

    A frame names a column that only moves forward in time (a day, a week), or None for the
    whole key. Keys of up to ``hot_rows`` rows are counted whole: one shuffle, one sort. A
    larger key is cut into time slices that are counted apart and shifted by the counts of
    its earlier slices, so it is spread over as many tasks as it has slices, and only slice
    counts meet at the key.
    """
    hot, n_hot, _ = hot_keys(df, keys, hot_rows)
    rows = df.withColumn("__one", F.expr(f"CASE WHEN {counted} THEN 1 ELSE 0 END"))
    slice_no = f"CAST(floor(unix_micros({ts}) / {seconds * 1_000_000}L) AS BIGINT)"
    if hot is None:
        rows = rows.withColumn("__slice", F.lit(0).cast("bigint"))
    else:
        flag = hot.withColumn("__hot", F.lit(True))
        rows = rows.join(F.broadcast(flag) if n_hot <= SMALL else flag, keys, "left") \
            .withColumn("__slice", F.expr(f"CASE WHEN __hot THEN {slice_no} END")).drop("__hot")
    marks = [c for c in frames.values() if c]
    order = W.partitionBy(*keys, "__slice").orderBy(ts, tiebreak)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumns({"__in": F.sum("__one").over(so_far), **{
        f"__new_{c}": ~F.col(c).eqNullSafe(F.lag(c).over(order)) for c in marks}})
    # What was counted in the slice before the current day, week, ... began in it.
    out = out.withColumns({f"__base_{c}": F.last(F.expr(f"CASE WHEN __new_{c} THEN __in - __one END"), True).over(so_far)
                           for c in marks})
    before = {name: F.lit(0) for name in frames}
    if hot is not None:
        part = [*keys, "__slice", *marks]
        sizes = rows.filter("__slice IS NOT NULL").groupBy(*part).agg(F.sum("__one").alias("__n"))

        def earlier(mark):
            # All of the frame's rows in lower slices; rows of the own slice are in ``__in``.
            w = W.partitionBy(*keys, *([mark] if mark else [])).orderBy("__slice")
            return F.coalesce(F.sum("__n").over(w.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))

        offsets = sizes.select(*part, *[earlier(m).alias(f"__before_{n}") for n, m in frames.items()])
        out = out.join(offsets, part, "left")
        before = {name: F.coalesce(F.col(f"__before_{name}"), F.lit(0)) for name in frames}
    inside = {name: F.col("__in") - F.col(f"__base_{c}") if c else F.col("__in") for name, c in frames.items()}
    return out.select(*df.columns, *[(inside[n] + before[n]).alias(n) for n in frames])


def positions(df: DataFrame, keys: list[str], ts: str, tiebreak: str, name: str = "n", **options) -> DataFrame:
    return running_positions(df, keys, ts, tiebreak, {name: None}, **options)


# --- ordered folds ------------------------------------------------------------------------

@dataclass(frozen=True)
class RecentFold:
    """First-in first-out list of recent visitors with a lifetime renewed by inserts."""

    slots: int = 75
    ttl_us: int = 14 * 86_400_000_000
    out_type = "boolean"

    def start(self, items, at):
        kept = deque(items or ())
        return [kept, set(kept), at]

    def run(self, state, values, times):
        """True for each value that is still listed when it comes."""
        kept, listed, at = state
        slots, ttl, out = self.slots, self.ttl_us, []
        for value, t in zip(values, times):
            if value is None:
                out.append(None)
                continue
            if at is not None and t - at > ttl:
                kept.clear()
                listed.clear()
            if value in listed:
                out.append(True)
                continue
            kept.append(value)
            listed.add(value)
            if len(kept) > slots:
                listed.discard(kept.popleft())
            at = t
            out.append(False)
        state[2] = at
        return out

    def snapshot(self, state):
        return list(state[0]), state[2]


@dataclass(frozen=True)
class FlushFold:
    """Client queue of distinct posts, sent whole when it reaches ``batch``."""

    batch: int
    out_type = "array<string>"

    def start(self, items, at):
        return [list(items or ()), at]

    def run(self, state, values, times):
        """The whole queue at each send, None in between."""
        queue, out = state[0], []
        for value in values:
            if value is not None and value not in queue:
                queue.append(value)
            sends = len(queue) >= self.batch
            out.append(queue if sends else None)
            if sends:
                queue = []
        state[0] = queue
        return out

    def snapshot(self, state):
        return list(state[0]), state[1]


# A state's items travel as one text: null array columns are slow to hand to Python.
_SEP = "\x1f"
_ARROW = {"boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _walk(fold, batches, emit):
    """Run the fold along rows sorted by (key, chunk, seed first, time). Only the current
    Arrow batch and one fold state are in memory, whatever the size of a key."""
    current, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        for name in ("__chunk", "__t"):
            if batch.column(name).null_count:
                raise ValueError("an ordered fold needs a time on every row")
        # Codes, not values: a NULL key is a key like any other, and 64-bit ids stay exact.
        key = batch.column("__key")
        codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        chunks, values, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__chunk", "__value", "__t"))
        seeds = batch.column("__seed").to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (chunks[1:] != chunks[:-1])) + 1).tolist(), len(codes)]
        values, times, results = values.tolist(), times.tolist(), []
        for lo, hi in zip(starts, starts[1:]):
            run = (key[lo].as_py(), int(chunks[lo]))
            if run != current:
                if current is not None:
                    emit.done(current, fold.snapshot(state))
                current = run
                seeded = bool(seeds[lo])
                items, at = (batch.column(c)[lo].as_py() if seeded else None for c in ("__items", "__at"))
                state = fold.start(items.split(_SEP) if items else (), at)
                if seeded:
                    results.append(None)
                    lo += 1
            results += fold.run(state, values[lo:hi], times[lo:hi])
        yield from emit.batch(batch, seeds, results)
    if current is not None:
        emit.done(current, fold.snapshot(state))
    yield from emit.rest()


class _Tags:
    """Emit the input rows with each step's result."""

    def __init__(self, columns, out, out_type):
        self.columns, self.out, self.type = columns, out, _ARROW[out_type]

    def done(self, current, snapshot):
        pass

    def batch(self, batch, seeds, results):
        tagged = batch.select(self.columns).append_column(self.out, pa.array(results, self.type))
        yield tagged.filter(pa.array(~seeds)) if seeds.any() else tagged

    def rest(self):
        return ()


class _Ends:
    """Emit one end state per (key, chunk), flushed once per input batch."""

    def __init__(self, key_type):
        self.key_type, self.ended = key_type, []

    def done(self, current, snapshot):
        items, at = snapshot
        self.ended.append((*current, _SEP.join(items), at))

    def batch(self, batch, seeds, results):
        return self.rest()

    def rest(self):
        if self.ended:
            key, chunk, items, at = zip(*self.ended)
            self.ended = []
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, self.key_type), pa.array(chunk, pa.int64()),
                 pa.array(items, pa.string()), pa.array(at, pa.int64())],
                names=["__key", "__chunk", "__items", "__at"])


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("__key", "__chunk").sortWithinPartitions(
        "__key", "__chunk", F.col("__seed").desc(), "__t", "__tie").drop("__tie")


def _with_seeds(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Add one leading row per chunk that carries the state the chunk starts from."""
    lead = seeds.withColumns({"__seed": F.lit(True), "__t": F.lit(0).cast("bigint")})
    return rows.unionByName(lead, allowMissingColumns=True)


def _end_states(rows: DataFrame, fold, key_type: str) -> DataFrame:
    arrow_key = pa.int64() if key_type == "bigint" else pa.string()
    slim = rows.select("__key", "__chunk", "__value", "__t", "__tie", "__items", "__at", "__seed")

    def run(batches):
        return _walk(fold, batches, _Ends(arrow_key))

    return _in_order(slim).mapInArrow(
        run, f"__key {key_type}, __chunk bigint, __items string, __at bigint")


def _tags(rows: DataFrame, fold, like: DataFrame, out: str) -> DataFrame:
    columns = like.columns

    def run(batches):
        return _walk(fold, batches, _Tags(columns, out, fold.out_type))

    tagged = _in_order(rows).mapInArrow(run, f"{ddl(pack_times(like))}, `{out}` {fold.out_type}")
    return unpack_times(tagged, like)


def _chunked(rows: DataFrame, chunk_rows: int, max_chunks: int) -> tuple[DataFrame, DataFrame | None]:
    """Cut the keys that hold more than ``chunk_rows`` rows into runs of time.

    Returns the rows with their chunk and the chunked rows alone, or None when no key is
    that large. Cuts are quantiles of the key's own times, so bursts are cut finer than
    quiet spells.
    """
    hot, hot_count, worst = hot_keys(rows, ["__key"], chunk_rows)
    if hot is None:
        return rows, None
    pieces = min(max_chunks, -(-worst // chunk_rows) + 1)
    shares = [i / pieces for i in range(1, pieces)]
    small = hot_count * pieces <= SMALL
    hot_list = F.broadcast(hot) if small else hot
    cuts = rows.join(hot_list, "__key", "left_semi").groupBy("__key").agg(
        F.percentile_approx("__t", shares).alias("__cuts"))
    cuts = cut(cuts)
    chunk = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__t"))), F.lit(0))
    joined = rows.drop("__chunk").join(F.broadcast(cuts) if small else cuts, "__key", "left")
    cut_rows = joined.withColumn("__chunk", F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(chunk).cast("bigint"))
    return cut_rows.drop("__cuts"), cut_rows.filter(F.col("__cuts").isNotNull()).drop("__cuts")


def ordered_fold(df: DataFrame, key: str, ts: str, tiebreak: str, value: str, fold, out: str,
                 chunk_rows: int = 1_000_000, max_chunks: int = 2000, max_rounds: int = 8,
                 slow: float = 0.7) -> DataFrame:
    """Run ``fold`` along each key's rows in (time, tiebreak) order; add its result as ``out``.
    Rows whose ``value`` is NULL pass through untouched, with a NULL result.

    A key with more than ``chunk_rows`` rows is cut into chunks that run in parallel. Each
    chunk is first run from an empty state; then every chunk whose predecessor ended in a
    state other than the one the chunk started from is run again from that state, until
    none differs. At that point each chunk has started from its predecessor's true end, so
    the result equals the sequential run. A list of many distinct recent items settles in
    two or three rounds because a chunk's end depends little on its start.

    A few more recurring visitors than slots never settle: lists that start apart stay
    apart, and no summary of a chunk is smaller than what it does to every list. Then a
    round puts only one more chunk of a key right. As soon as a round leaves more than
    ``slow`` of the last one's chunks wrong, or after ``max_rounds``, the rest of such a key,
    from its first wrong chunk on, is run in one pass along its sorted rows, with one Arrow
    batch and one state in memory. So the number of passes is bounded, and small.
    """
    key_type = "bigint" if dict(df.dtypes)[key] == "bigint" else "string"
    rows = pack_times(df).select(
        "*",
        F.col(key).cast(key_type).alias("__key"),
        F.lit(0).cast("bigint").alias("__chunk"),
        F.col(value).cast("string").alias("__value"),  # without the item separator
        F.col(ts).alias("__t"),
        F.col(tiebreak).alias("__tie"),
        F.lit(None).cast("string").alias("__items"),
        F.lit(None).cast("bigint").alias("__at"),
        F.lit(False).alias("__seed"),
    )
    rows, hot = _chunked(rows, chunk_rows, max_chunks)
    if hot is None:
        return _tags(rows, fold, df, out)

    # The rounds reread the slim hot rows, not the input's scan and joins.
    hot = cut(hot.select("__key", "__chunk", "__value", "__t", "__tie", "__items", "__at", "__seed"))
    ends = cut(_end_states(hot, fold, key_type))
    starts, rounds, before = None, 0, None
    while True:
        order = W.partitionBy("__key").orderBy("__chunk")
        state = F.lag(F.struct("__items", "__at")).over(order)
        fresh = cut(ends.select("__key", "__chunk", state.alias("__s"))
                    .filter(F.col("__s").isNotNull() & ((F.col("__s.__items") != "") | F.col("__s.__at").isNotNull()))
                    .select("__key", "__chunk", "__s.__items", "__s.__at"))
        if starts is None:
            changed = fresh
        else:
            # A chunk is wrong when its start changed, including to or from "empty".
            old = starts.select("__key", "__chunk", F.col("__items").alias("__i"), F.col("__at").alias("__a"))
            both = fresh.join(old, ["__key", "__chunk"], "full")
            same = F.col("__items").eqNullSafe(F.col("__i")) & F.col("__at").eqNullSafe(F.col("__a"))
            changed = both.filter(~same).select("__key", "__chunk", "__items", "__at")
        starts = fresh
        if changed.isEmpty():
            break
        todo = cut(changed)
        wrong, rounds = todo.count(), rounds + 1
        if rounds > max_rounds or before is not None and wrong > slow * before:
            # The first wrong chunk of a key starts from a true end; it takes in all that follow.
            late = todo.groupBy("__key").agg(F.min("__chunk").alias("__from"))
            rows = rows.join(late, "__key", "left").withColumn("__chunk", F.when(
                F.col("__chunk") >= F.col("__from"), F.col("__from")).otherwise(F.col("__chunk"))).select(*rows.columns)
            starts = starts.join(late, "__key", "left").filter("__from IS NULL OR __chunk <= __from").drop("__from")
            break
        before = wrong
        again = _with_seeds(hot.join(todo.select("__key", "__chunk"), ["__key", "__chunk"], "left_semi"), todo)
        redone = _end_states(again, fold, key_type)
        ends = cut(ends.join(todo.select("__key", "__chunk"), ["__key", "__chunk"], "left_anti").unionByName(redone))
    return _tags(_with_seeds(rows, starts), fold, df, out)
