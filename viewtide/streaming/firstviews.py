"""First views of every client and post, for good, without stream state.

The keys seen so far lie in an index on the shared store, in buckets by client. Each bucket
has a Bloom filter: a key sets four bits of one 64-bit word. A micro-batch is held against
the filters of the buckets that it touches; a key that misses is new, and only for buckets
with possible hits are keys read and compared. So the answer is exact, buckets without a
possible hit are not opened, and memory does not grow with the number of clients.

``current`` names each bucket's parts. It is replaced last, so a lost attempt leaves nothing
that is read. There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from viewtide.config import CountingConfig
from viewtide.operators.qualify import dedup_viewer
from viewtide.sources.tables import list_names, read_pointer, remove, write_pointer

KEYS = ["client_id", "post_id"]
MASK = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64(post_id, client_id, 'bits'), {6 * k}) & 63 AS INT))"
                  for k in range(4))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int")


def _cell(words: dict[int, int]) -> Column:
    """The filter word of a key: its bucket and, below, its place among the bucket's words.
    NULL in a bucket without a filter."""
    if not words:
        return F.lit(None).cast("bigint")
    sizes = ", ".join(f"{b}, {n}L" for b, n in sorted(words.items()))
    return F.expr(f"shiftleft(CAST(__bucket AS BIGINT), 40) + pmod(xxhash64(client_id, post_id), map({sizes})[__bucket])")


def _filters(keys: DataFrame, words: dict[int, int]) -> DataFrame:
    """One row for each word in use. Words combine before the shuffle."""
    cells = keys.withColumn("cell", _cell(words))
    return cells.groupBy("__bucket", "cell").agg(F.expr(f"bit_or({MASK})").alias("bits"))


def _parts(spark: SparkSession, index: str, now: dict, buckets, what: str, ddl: str) -> DataFrame:
    folders = [f"{index}/version={v}/{what}/__bucket={b}" for b in buckets for v in now["buckets"].get(str(b), {"parts": []})["parts"]]
    return spark.read.schema(ddl).parquet(*folders) if folders else spark.createDataFrame([], ddl)


def _listed(spark: SparkSession, path: str) -> list[int]:
    """The buckets that a table partitioned by bucket has rows of."""
    names = list_names(spark, path)
    return sorted(int(n.removeprefix("__bucket=")) for n in names if n.startswith("__bucket="))


def admit_first_views(batch: DataFrame, index: str, out: str, version: int, buckets: int = 64,
                      most_parts: int = 8, bits_per_key: int = 16) -> dict[str, list[int]]:
    """Write the views of ``batch`` that are their client's first of the post, over all batches so
    far, to ``out/batch_id=<version>``, and add their keys to ``index``.

    Within the batch the first is taken by ``ts`` and ``event_id``, across batches by arrival.
    A NULL client or post is a key like others, as in ``dedup_viewer``. A version that has
    been admitted is left as it is. ``buckets`` holds for a new index. A bucket is written
    anew, with a larger filter, once its keys have less than ``bits_per_key`` bits each, and as
    one part once it has ``most_parts``: both cost a bounded number of rewrites per key.

    Returns which buckets the batch touched and of which keys were opened.
    """
    spark = batch.sparkSession
    now = read_pointer(spark, f"{index}/current") or {"version": -1, "count": buckets, "buckets": {}, "old": []}
    if version <= now["version"]:
        return {"touched": [], "opened": []}
    kinds = {f.name: f.dataType.simpleString() for f in batch.schema}
    ddl = ", ".join(f"{k} {kinds[k]}" for k in KEYS)
    work, target, written = f"{index}/work={version}", f"{index}/version={version}", f"{out}/batch_id={version}"

    first = dedup_viewer(batch, CountingConfig(storage="local")).withColumn("__bucket", _bucket(now["count"]))
    first.write.mode("overwrite").partitionBy("__bucket").parquet(f"{work}/first")
    touched = _listed(spark, f"{work}/first")
    rows = spark.read.schema(first.schema).parquet(f"{work}/first")

    known = {b: now["buckets"][str(b)]["words"] for b in touched if str(b) in now["buckets"]}
    filters = _parts(spark, index, now, known, "filters", "cell bigint, bits bigint").groupBy("cell").agg(
        F.expr("bit_or(bits)").alias("__bits"))
    held = rows.withColumn("cell", _cell(known)).join(filters, "cell", "left").drop("cell")
    held = held.withColumn("__maybe", F.expr(f"coalesce((__bits & ({MASK})) = ({MASK}), false)")).drop("__bits")
    held.write.mode("overwrite").partitionBy("__maybe", "__bucket").parquet(f"{work}/held")
    opened = _listed(spark, f"{work}/held/__maybe=true")
    held = spark.read.schema(held.schema).parquet(f"{work}/held")
    seen = _parts(spark, index, now, opened, "keys", ddl).withColumnsRenamed({k: f"__{k}" for k in KEYS})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]
    fresh = held.filter("NOT __maybe").unionByName(held.filter("__maybe").join(seen, same, "left_anti"))
    fresh.select(*batch.columns).write.mode("overwrite").parquet(written)

    new = spark.read.schema(batch.schema).parquet(written).select(*KEYS).withColumn("__bucket", _bucket(now["count"]))
    added = {r[0]: r[1] for r in new.groupBy("__bucket").count().collect()}  # at most one row per bucket
    named, whole, replaced = dict(now["buckets"]), [], []
    for b, n in added.items():
        old = named.get(str(b), {"parts": [], "words": 0, "keys": 0})
        size, words = old["keys"] + n, old["words"]
        grows = size * bits_per_key > words * 64
        if grows:
            words = 1 << (size * bits_per_key * 2 // 64).bit_length()
        if old["parts"] and (grows or len(old["parts"]) + 1 >= most_parts):
            whole.append(b)
            replaced += [f"{index}/version={v}/{what}/__bucket={b}" for v in old["parts"] for what in ("keys", "filters")]
            old = {"parts": []}
        named[str(b)] = {"parts": [*old["parts"], version], "words": words, "keys": size}
    if added:
        again = _parts(spark, index, now, whole, "keys", ddl).withColumn("__bucket", _bucket(now["count"]))
        new.unionByName(again).hint("rebalance", F.col("__bucket")).write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/keys")
        keys = spark.read.schema(f"{ddl}, __bucket int").parquet(f"{target}/keys")
        _filters(keys, {b: named[str(b)]["words"] for b in added}).hint("rebalance", F.col("__bucket")) \
            .write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/filters")
    write_pointer(spark, f"{index}/current", {"version": version, "count": now["count"], "buckets": named, "old": replaced})
    for gone in [*now["old"], work]:
        remove(spark, gone)
    return {"touched": touched, "opened": opened}


def dedup_viewer_indexed(views: DataFrame, index: str, out: str, checkpoint: str, buckets: int = 64,
                         **trigger) -> StreamingQuery:
    """The client-scope de-duplication of a stream against a stored index: each micro-batch's
    first views go to their own folder of ``out``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        admit_first_views(batch, index, out, batch_id, buckets)

    return (views.writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
