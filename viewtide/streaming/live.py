"""Live counters, hour bins and de-duplication on unbounded view feeds.

Sinks write one folder per micro-batch, overwritten when a batch is retried, so output is
exactly-once. Readers keep each key's last value.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from viewtide.config import CountingConfig, ShapeConfig
from viewtide.functions.calendar import period
from viewtide.functions.transport import ddl
from viewtide.operators.ordered import RecentFold
from viewtide.operators.qualify import eligibility, request_views
from viewtide.operators.shape import in_bins
from viewtide.sources.tables import read_pointer, remove, write_pointer

LATE = "2 hours"
#: Rows that wait in one entry of a state list.
CHUNK = 10_000


def live_counters(views: DataFrame, unit: str, late: str = LATE, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """Views per post and day or week (event time), for update mode.

    Windows start when the rollover does: ``rollover_minutes`` past midnight, weeks on
    Monday (the epoch was a Thursday, hence four days). Months have no fixed length; they
    are grouped by calendar month in ``live_months``.
    """
    n = cfg.rollover_minutes
    window = {
        "day": F.window("ts", "1 day", "1 day", f"{n} minutes"),
        "week": F.window("ts", "7 days", "7 days", f"4 days {n} minutes"),
    }[unit]
    counted = views.withWatermark("ts", late).groupBy(window.alias("w"), "post_id").agg(F.count("*").alias("views"))
    return counted.select(F.lit(unit).alias("range"), F.to_date("w.start").alias("period"), "post_id", "views")


def live_months(views: DataFrame, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """Views per post and calendar month. A month key is no event-time window, so its
    state is not dropped by the watermark; it holds one row per post and month."""
    month = F.expr(period("ts", "month", cfg.rollover_minutes))
    counted = views.groupBy(month.alias("period"), "post_id").agg(F.count("*").alias("views"))
    return counted.select(F.lit("month").alias("range"), "period", "post_id", "views")


def from_days(days: DataFrame, unit: str) -> DataFrame:
    """Week or month counters summed from the day counters a stream has written: one
    stateful stream then serves all three ranges."""
    first = F.to_date(F.date_trunc(unit, "period"))
    return days.groupBy(first.alias("period"), "post_id").agg(F.sum("views").alias("views")) \
        .select(F.lit(unit).alias("range"), "period", "post_id", "views")


def live_totals(views: DataFrame) -> DataFrame:
    return views.groupBy("post_id").agg(F.count("*").alias("views"))


def live_hours(views: DataFrame, late: str = LATE, cfg: ShapeConfig | None = None) -> DataFrame:
    """Views per site hour: all of them or, given the shape's settings, those that
    ``hour_bins`` holds, from which ``bins_of_hours`` makes the same bins."""
    kept = views.filter(in_bins(cfg)) if cfg else views
    counted = kept.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("views"))
    return counted.select(F.col("w.start").alias("hour_start"), "views")


def bins_of_hours(hours: DataFrame) -> DataFrame:
    """The last values of ``live_hours`` as ``daily_bins``, ready for ``learn_shape``."""
    bins = [F.coalesce(F.sum(F.when(F.hour("hour_start") == h, F.col("views"))), F.lit(0)) for h in range(24)]
    return hours.groupBy(F.to_date("hour_start").alias("site_day")).agg(
        F.array(*bins).alias("hour_bins"), F.sum("views").alias("total"))


def dedup_viewer_stream(views: DataFrame, cfg: CountingConfig = CountingConfig(), late: str = "1 day") -> DataFrame:
    """One view per session and post while the session's keys are held, or one per client
    and post for good."""
    if cfg.storage == "local":
        return views.dropDuplicates(["client_id", "post_id"])
    return views.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "post_id"])


def dedup_ip_stream(views: DataFrame, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """Recent-visitor check with per-post state of at most ``ip_slots`` hashes. Every column
    of ``views`` is kept.

    Rows of a micro-batch are taken in time order; across micro-batches the order is that
    of arrival. Bound the micro-batch at the source (files or offsets per trigger): the
    check of one post is sequential by definition.
    """
    fold = RecentFold(cfg.ip_slots, cfg.ip_ttl_days * 86_400_000_000)

    def step(key, parts, state: GroupState):
        items, at = state.get if state.exists else ((), None)
        rows = pd.concat(list(parts)).sort_values(["__t", "event_id"], kind="stable")
        held = fold.start(items, at)
        rows["ip_duplicate"] = fold.run(held, [None if v is None or v != v else v for v in rows["ip_hash"]],
                                        rows["__t"].tolist())
        state.update(fold.snapshot(held))
        yield rows[[*names, "ip_duplicate"]]

    packed = views.withColumn("__t", F.unix_micros("ts")).drop("ts")
    names = packed.columns
    tagged = packed.groupBy("post_id").applyInPandasWithState(
        step, f"{ddl(packed)}, ip_duplicate boolean", "items array<string>, at bigint", "append",
        GroupStateTimeout.NoTimeout)
    return tagged.withColumn("ts", F.timestamp_micros("__t")).select(*views.columns, "ip_duplicate")


class _InEventOrder(StatefulProcessor):
    """Recent-visitor check of one post in event order, whatever order rows arrive in.

    Rows wait in a list until the watermark has passed them; an event-time timer then runs
    the fold over them in time order. An entry of the list holds an array for each column of
    up to ``CHUNK`` rows, because every entry is sent to the store and back on its own. A second
    timer drops the list of visitors when its lifetime has passed without a view, so quiet
    posts hold no state.
    """

    def __init__(self, fold: RecentFold, given: list[str], rows: T.StructType):
        self.fold, self.given, self.names = fold, given, rows.names
        self.chunk = T.StructType([T.StructField(f"c{k}", T.ArrayType(f.dataType)) for k, f in enumerate(rows.fields)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.chunk)
        self.recent = handle.getValueState("recent", "items array<string>, at bigint")

    def _wait(self, columns: list[list]) -> None:
        for k in range(0, len(columns[0]), CHUNK):
            self.waiting.appendValue(tuple(c[k:k + CHUNK] for c in columns))

    def handleInputRows(self, key, rows, timerValues):
        least = None
        for part in rows:
            part = part.set_axis(self.given, axis=1)[self.names]  # names with a leading underscore come changed
            self._wait([[None if v is None or v != v else v for v in part[c].tolist()] for c in self.names])
            first = int(part["__t"].min())
            least = first if least is None else min(least, first)
        if least is not None:
            self.handle.registerTimer(_after(least))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        names = self.names
        held = [[] for _ in names]
        for chunk in self.waiting.get() if self.waiting.exists() else ():
            for column, values in zip(held, chunk):
                column += values
        at, order, hashes = (held[names.index(c)] for c in ("__t", "event_id", "ip_hash"))
        due = sorted((k for k, t in enumerate(at) if t < now), key=lambda k: (at[k], order[k]))
        rest = [k for k, t in enumerate(at) if t >= now]
        items, last = self.recent.get() if self.recent.exists() else ((), None)
        if due:
            state = self.fold.start(items, last)
            tags = self.fold.run(state, [hashes[k] for k in due], [at[k] for k in due])
            items, last = self.fold.snapshot(state)
            self.recent.update((items, last))
            self.waiting.clear()
            if rest:
                self._wait([[c[k] for k in rest] for c in held])
            out = pd.DataFrame({name: pd.Series([c[k] for k in due], dtype=object) for name, c in zip(names, held)})
            out["ip_duplicate"] = pd.array(tags, dtype=object)
            yield out
        if rest:
            self.handle.registerTimer(_after(min(at[k] for k in rest)))
        elif last is not None and last + self.fold.ttl_us < now:
            self.recent.clear()
        elif last is not None:
            self.handle.registerTimer(_after(last + self.fold.ttl_us))

    def close(self) -> None:
        pass


def _after(micros: int) -> int:
    """The first millisecond at which a row of this time is over."""
    return micros // 1000 + 1


def dedup_ip_in_order(views: DataFrame, late: str = LATE, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """``dedup_ip_stream`` with the order of event time instead of that of arrival: the tags of
    the batch job, also for rows that come up to ``late`` behind others, in whatever
    micro-batches. Later ones are dropped. A row is tagged once the watermark has passed it.

    Needs the RocksDB state store (``session.STREAM_DEFAULTS``). State of a post: the rows of
    the last ``late``, and at most ``ip_slots`` hashes until their lifetime has passed.
    """
    fold = RecentFold(cfg.ip_slots, cfg.ip_ttl_days * 86_400_000_000)
    packed = views.withColumn("__t", F.unix_micros("ts")).withWatermark("ts", late)
    rows = packed.drop("ts").schema
    tagged = packed.groupBy("post_id").transformWithStateInPandas(
        _InEventOrder(fold, packed.columns, rows), T.StructType([*rows.fields, T.StructField("ip_duplicate", T.BooleanType())]), "append", "EventTime")
    return tagged.withColumn("ts", F.timestamp_micros("__t")).select(*views.columns, "ip_duplicate")


def ingest_stream(requests: DataFrame, posts: DataFrame, cfg: CountingConfig = CountingConfig(),
                  should_count: Column | None = None) -> DataFrame:
    """Accepted views of a request feed (stream-static join with the post dimension).

    Gates in the order of the batch job: cap, published, allowed type, then with
    ``cfg.strict_ip`` the recent-address check, then the site's own rule, whose refusals
    have already taken a slot in the address list. Requests need a ``bigint event_id``
    when the address check is on.
    """
    rows = eligibility(request_views(requests, cfg), posts, cfg).filter(F.col("reason").isNull()).drop("reason")
    if cfg.strict_ip:
        seq = (F.col("request_no") * F.lit(max(1, cfg.batch)) + F.col("slot")).cast("bigint")
        numbered = rows.withColumnRenamed("event_id", "request_no").withColumn("event_id", seq)
        fresh = dedup_ip_stream(numbered, cfg).filter(~F.col("ip_duplicate")).drop("ip_duplicate", "event_id")
        rows = fresh.withColumnRenamed("request_no", "event_id")
    if should_count is not None:
        rows = rows.filter(F.coalesce(should_count, F.lit(False)))
    return rows.drop("ip")


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "update",
                 after: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Write each micro-batch to its own folder; ``after`` sees the batch as written."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        if after:
            after(batch.sparkSession.read.parquet(target), batch_id)

    return (df.writeStream.outputMode(mode).foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def read_latest(spark: SparkSession, path: str, keys: list[str], value: str = "views") -> DataFrame:
    """Each key's last written value."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


# --- keyed snapshots ------------------------------------------------------------------------

def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_snapshot(batch: DataFrame, path: str, version: int, keys: list[str], buckets: int = 16) -> None:
    """Put a batch of new key values into the snapshot at ``path`` as ``version``.

    The snapshot is cut into ``buckets`` by a hash of the key. Only buckets that the batch
    touches are written anew, each with its other keys; then one small file that names the
    version of every bucket is replaced as a whole. Readers see the old snapshot or the new
    one. The versions that the previous one named stay until the next merge, for readers
    that had just looked. Merging a version again (a micro-batch tried twice) changes nothing.
    """
    spark = batch.sparkSession
    now = read_pointer(spark, f"{path}/current") or {"version": -1, "buckets": {}, "count": buckets, "old": []}
    if version <= now["version"]:
        return
    buckets = now["count"]
    rows = batch.withColumn("bucket", _bucket(keys, buckets))
    target = f"{path}/version={version}"
    batch_path = f"{path}/batch={version}"
    rows.write.mode("overwrite").parquet(batch_path)  # read twice below
    rows = spark.read.schema(rows.schema).parquet(batch_path)
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
    held = [f"{path}/version={v}/bucket={b}" for b, v in now["buckets"].items() if int(b) in touched]
    merged = rows
    if held:
        old = spark.read.schema(batch.schema).parquet(*held).withColumn("bucket", _bucket(keys, buckets))
        merged = rows.unionByName(old.join(rows.select(*keys), keys, "left_anti"))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    named = {**now["buckets"], **{str(b): version for b in touched}}
    replaced = [f"{path}/version={v}/bucket={b}" for b, v in now["buckets"].items() if named[b] != v]
    write_pointer(spark, f"{path}/current", {"version": version, "buckets": named, "count": buckets, "old": replaced})
    for gone in [*now["old"], batch_path]:
        remove(spark, gone)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current value of every key: one folder per bucket, however many batches came."""
    now = read_pointer(spark, f"{path}/current")
    held = [f"{path}/version={v}/bucket={b}" for b, v in (now or {"buckets": {}})["buckets"].items()]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, path: str, checkpoint: str, keys: list[str], buckets: int = 16, **trigger) -> StreamingQuery:
    """Keep a snapshot of an updating stream (see ``merge_snapshot``)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        merge_snapshot(batch, path, batch_id, keys, buckets)

    return (df.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
