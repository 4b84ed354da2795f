"""How filters overlap: every subset of them in one Gray-code walk over mask cells.

Rows are counted once by the set of filters that they fail, a mask. All that order can
change follows from those counts: the walk visits the subsets of active filters so that
one filter is toggled at a time. Each mask cell holds a counter of the active filters it
fails; a cell leaves the running survivors when its counter rises from 0 and returns when
it falls back to 0. The survivors of every subset are stored, and what a step of an order
removes is the difference of two stored states.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.llm.scratch import keep

WORD = r"[^\x20\x09-\x0D]+"
MEASURES = ("docs", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides; null is empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    n, capitals = F.size(words), F.regexp_count(t, F.lit("[A-Z]"))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
            "C": 100 * capitals > 2 * F.length(t), "D": t.rlike(r"[#$%&*|]")}


def failure_masks(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
                  source: str = "source") -> DataFrame:
    """``part, mask, docs, good, toxic``: rows of each part and set of failed filters, bit k
    for the k-th of ABCDE; ``good`` has quality 1 in a row of ``labels``, ``toxic`` toxic 1.

    E fails a row if any row of smaller id has the same text (by SHA-256). A null id is
    neither smaller nor larger than another: such a row passes E, and has no label. Rows of
    one id and text pass E together or fail it together. Null parts are empty strings.

    Texts are read once. The least id of a text is found from partial minima, and rows meet
    it by text *and* id, so that a text which a third of the rows share is no hot key; nor
    is the null id, which is spread by the text's digest.
    """
    bits = text_filters(F.col(text))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(bits.values())), F.lit(0))
    rows = keep(docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"),
        mask.cast("int").alias("low")), "masks")
    rows = rows.groupBy("digest", "id", "part", "low").agg(F.count("*").alias("n"))
    first = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    first = first.withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    known = known.filter("id IS NOT NULL AND (good = 1 OR toxic = 1)").withColumn("spread", F.lit(0).cast("bigint"))
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    marked = rows.join(first, ["digest", "id"], "left").withColumn("spread", spread).join(known, ["id", "spread"], "left")
    again = F.col("id").isNotNull() & F.col("first").isNull()
    counted = {m: F.sum(F.col("n") * F.coalesce(F.col(m), F.lit(0))) for m in ("good", "toxic")}
    return marked.groupBy("part", (F.col("low") + F.when(again, 1 << len(bits)).otherwise(0)).alias("mask")).agg(
        F.sum("n").alias("docs"), *[c.alias(m) for m, c in counted.items()])


def subset_survivors(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of active filters: ``cells`` has a row for each mask, and
    so has the result for each subset. Further axes are parts and measures."""
    masks = np.arange(len(cells))
    failed, running = np.zeros(len(cells), np.int64), cells.sum(0)
    states = np.empty_like(cells)
    states[0], active = running, 0
    for step in range(1, len(cells)):
        bit = step & -step  # the one filter in which this code word differs from the last
        hit = (masks & bit) != 0
        active ^= bit
        if active & bit:
            running = running - cells[hit & (failed == 0)].sum(0)
            failed[hit] += 1
        else:
            failed[hit] -= 1
            running = running + cells[hit & (failed == 0)].sum(0)
        states[active] = running
    return states


def _steps(parts: list[str], cells: np.ndarray, letters: str) -> pa.RecordBatch:
    """All rows of the given parts; ``cells`` is (mask, part, measure)."""
    k, n = len(letters), len(parts)
    states, masks = subset_survivors(cells), np.arange(len(cells))
    fails = [cells[(masks >> f & 1) == 1][..., 0].sum(0) for f in range(k)]
    unique = [cells[1 << f, :, 0] for f in range(k)]
    orders = list(permutations(range(k)))
    made = {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
    share, names, numbers, places = np.zeros((k, n), np.int64), [], [], []
    for order in orders:
        active = 0
        for step, f in enumerate(order, 1):
            before, after = states[active], states[active | 1 << f]
            lost, active = before - after, active | 1 << f
            share[f] += lost[:, 0]
            for c, v in zip(made, (after[:, 0], lost[:, 0], fails[f] - lost[:, 0], unique[f], lost[:, 1], lost[:, 2])):
                made[c].append(v)
            names.append("".join(letters[g] for g in order))
            numbers.append(step)
            places.append(f)
    made["shapley"] = [share[f] for f in places]
    columns = [pa.array(np.repeat(parts, len(names)).tolist(), pa.string()), pa.array(names * n, pa.string()),
               pa.array(numbers * n, pa.int32()), *[pa.array(np.stack(v, 1).ravel(), pa.int64()) for v in made.values()]]
    return pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *made])


def audit(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley`` for every order of the filters ``letters`` and each of its steps.

    ``cells`` has ``part, mask, docs, good, toxic``, one row for each part and mask that
    occurs (see ``failure_masks``). A step's filter is that letter of the order; ``removed``
    are the rows it takes from those kept so far, ``redundant`` those that fail it and are
    gone already, ``unique_fails`` those that fail no other, ``shapley`` its removals
    summed over all orders. No part, no row. A part is one row of at most
    ``2 ** len(letters)`` cells here, so any number of parts is spread over tasks.
    """
    size = 2 ** len(letters)
    held = F.map_from_entries(F.collect_list(F.struct("mask", F.array(*MEASURES))))
    wide = cells.groupBy("part").agg(held.alias("held"))
    at = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(
        F.try_element_at("held", m), F.array_repeat(F.lit(0).cast("bigint"), len(MEASURES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # 64 parts make 38,400 rows of five filters
                some = batch.slice(lo, 64)
                flat = some.column("cells").flatten().flatten().to_numpy(zero_copy_only=False)
                yield _steps(some.column("part").to_pylist(),
                             flat.reshape(some.num_rows, size, len(MEASURES)).transpose(1, 0, 2), letters)

    return wide.select("part", at.alias("cells")).mapInArrow(
        run, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
             "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def order_summary(steps: DataFrame, part: Sequence[str] | None = None) -> DataFrame:
    """Which filter to apply first: for each part and filter the rows it fails, how many
    only it fails, and its share of all removals over the orders."""
    chosen = steps if part is None else steps.filter(F.col("part").isin(*part))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return chosen.groupBy("part", letter.alias("filter")).agg(
        F.max(F.col("removed") + F.col("redundant")).alias("fails"), F.max("unique_fails").alias("unique_fails"),
        F.max("shapley").alias("shapley"), F.max("redundant").alias("most_redundant"))
