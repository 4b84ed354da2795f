"""Quality by importance resampling.

Two generative models of hashed n-grams are counted, one on target text and one on all raw
text. A document's importance weight is the ratio of its probabilities under them; adding
Gumbel noise to the log weights and keeping the greatest sums is a draw without replacement
in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.llm import words
from viewtide.llm.scratch import keep, map_text


@dataclass(frozen=True)
class Resampling:
    """``target_rows`` bounds the labelled rows that stand for the target; the raw model
    counts every row. ``buckets`` is the size of both models, ``prior`` their smoothing."""

    buckets: int = 16384
    target_rows: int = 20_000
    prior: float = 1.0
    keep_share: float | None = None
    seed: int = 5


def _features(words_of: words.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each word and each pair of neighbours within a document."""
    hashes, doc = words_of.hashes(), words_of.doc_of()
    pairs = words.grams(hashes, 2)
    inside = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    every = np.concatenate([hashes, pairs[inside[: len(pairs)]]])
    return (every >> words.U64(32)).astype(np.int64) % buckets, np.concatenate([doc, doc[:-1][inside]])


def _counts(buckets: int):
    """Bucket counts of a task's documents: all of them, and those marked as target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            marks = np.array(batch.column("__target").to_pylist(), bool)
            for i, j, found in words.column_words(batch.column("__text")):
                bucket, doc = _features(found, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[marks[i:j][doc]], minlength=buckets)
        hit = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(raw[hit]), pa.array(target[hit])],
                                         names=["bucket", "raw", "target"])
    return run


def _weights(shared, buckets: int, columns: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            sums, sizes = [], []
            for i, j, found in words.column_words(batch.column(text)):
                bucket, doc = _features(found, buckets)
                sums.append(np.bincount(doc, ratio[bucket], j - i))
                sizes.append(np.diff(found.at))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)),
                 pa.array(np.concatenate([np.zeros(0), *sums]))], names=[*columns, "n_words", "log_weight"])
    return run


def largest(df: DataFrame, column: str, k: int, bins: int = 1024) -> tuple[float, int]:
    """The value v and the count m such that exactly k rows are the rows above v and m rows
    equal to v: the k-th greatest by narrowing histograms, no sort."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        step = (high - low) / bins
        if step == 0 or low + step == low:
            break
        bucket = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1))
        rows = df.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(bucket.alias("b")).agg(
            F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()  # <= bins rows
        for r in sorted(rows, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
        else:
            break
    return high, k - above


def resample(docs: DataFrame, labels: DataFrame, cfg: Resampling = Resampling(), id: str = "doc_id", text: str = "text",
             good: str = "quality", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) plus ``n_words, log_weight,
    gumbel_key, kept``.

    Target rows are a bounded sample of the documents labelled good. ``kept`` marks the
    rows with the greatest ``gumbel_key``: ``keep_share`` of all rows, or, by default, the
    share of good ones among the labelled. The noise is a hash of the id and the text, so
    reruns agree. Equal keys at the limit are told apart by id and text; rows equal in
    both, repeated rows, are kept or left together.

    A null or empty text has no n-grams and weight 0. Rows without a label only take part
    in the raw model. Without good labels the weights are all equal. Repeated labels of a
    document count once if any is good. Columns named like a result are replaced.
    """
    columns = [c for c in carry or docs.columns if c.lower() not in ("n_words", "log_weight", "gumbel_key", "kept")]
    marks = labels.groupBy(F.col(id).alias("i")).agg(F.max(F.col(good).cast("int")).alias("good")).filter("i IS NOT NULL AND good IS NOT NULL")
    of_labels = marks.agg(F.avg("good")).first()[0]
    share = cfg.keep_share if cfg.keep_share is not None else (1.0 if of_labels is None else float(of_labels))
    ids = keep(marks.filter("good = 1").select("i").orderBy(F.md5(F.col("i").cast("string")), "i").limit(cfg.target_rows), "target")
    flagged = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(
        F.broadcast(ids.withColumn("t", F.lit(True))), F.col("__id") == F.col("i"), "left")  # target_rows ids at most
    counted = map_text(flagged.select("__text", F.coalesce("t", F.lit(False)).alias("__target")), _counts(cfg.buckets),
                       "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(
            F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(cfg.buckets, cfg.prior), np.full(cfg.buckets, cfg.prior)
    for r in counted.collect():  # cfg.buckets rows at most
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    passed = columns if text in columns else [*columns, text]
    schema = T.StructType([*docs.select(*columns).schema.fields, *T._parse_datatype_string(
        "n_words bigint, log_weight double, __i string, __h bigint").fields])
    rows = docs.select(*passed, F.coalesce(F.col(id).cast("string"), F.lit("")).alias("__i"), F.xxhash64(text).alias("__h"))
    plain = T.StructType([f for f in schema.fields if f.name not in ("n_words", "log_weight")] + schema.fields[len(columns):len(columns) + 2])
    weighed = map_text(rows, _weights(shared, cfg.buckets, [*columns, "__i", "__h"], text), plain)
    spot = (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(cfg.seed), "__i", "__h")), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    scored = keep(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(spot))), "weights")
    n = scored.count()
    k = math.floor(share * n + 0.5)
    if n == 0 or k == 0:
        return scored.select(*columns, "n_words", "log_weight", "gumbel_key", F.lit(False).alias("kept"))
    limit, ties = largest(scored, "gumbel_key", k)
    tied = scored.filter(F.col("gumbel_key") == limit)
    last = None
    if tied.count() > ties:
        last = tied.select("__i", "__h").orderBy("__i", "__h").offset(ties - 1).limit(1).first()
    at_limit = F.lit(True) if last is None else (F.col("__i") < last[0]) | ((F.col("__i") == last[0]) & (F.col("__h") <= last[1]))
    kept = (F.col("gumbel_key") > limit) | ((F.col("gumbel_key") == limit) & at_limit)
    return scored.select(*columns, "n_words", "log_weight", "gumbel_key", kept.alias("kept"))
