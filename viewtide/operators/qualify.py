"""From raw engagement and requests to accepted views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewtide.config import CountingConfig
from viewtide.functions.net import client_ip, ip_hash
from viewtide.operators.ordered import FlushFold, ordered_fold, positions


def qualify_views(engagement: DataFrame, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """Page visits with enough dwell time and scroll depth. A page without height has a
    NaN percent, which never passes (NaN compares as the largest value in Spark)."""
    ok = F.col("dwell_ms") >= cfg.delay_ms
    if cfg.scroll_enabled:
        ok = ok & ~F.isnan("scroll_pct") & (F.col("scroll_pct") >= cfg.scroll_pct)
    return engagement.filter(ok)


def dedup_viewer(views: DataFrame, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """First view per (session or client, post).

    The rank-1 filter becomes a group limit below the shuffle: each task sends at most one
    row per key, so a client that reloads one post a billion times costs nothing there.
    """
    scope = "client_id" if cfg.storage == "local" else "session_id"
    first = W.partitionBy(scope, "post_id").orderBy("ts", "event_id")
    return views.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")


def batch_flush(views: DataFrame, batch: int, cfg: CountingConfig = CountingConfig(),
                **fold_options) -> DataFrame:
    """Views sent in client batches: a client queues distinct posts and sends the queue
    when it holds ``batch``. Unsent leftovers are never counted; a sent view counts at the
    time of the send. Input is the de-duplicated view stream."""
    if batch <= 1:
        return views.select("client_id", "post_id", F.col("ts").alias("counted_at"),
                            F.lit(0).cast("bigint").alias("slot"))
    if cfg.storage == "local":
        # Every post enters a client's queue once, so batches are runs of ``batch`` rows.
        numbered = positions(views, ["client_id"], "ts", "event_id", name="n", **fold_options)
        run = W.partitionBy("client_id", "batch_no")
        return (
            numbered.withColumn("batch_no", F.expr(f"(n - 1) div {batch}"))
            .withColumn("__sent", F.count("*").over(run) == batch)
            .withColumn("counted_at", F.max("ts").over(run))
            .filter("__sent")
            .select("client_id", "post_id", "counted_at", F.expr(f"(n - 1) % {batch}").alias("slot"))
        )
    sends = ordered_fold(
        views.select("client_id", "ts", "event_id", F.col("post_id").cast("string").alias("queued")),
        key="client_id", ts="ts", tiebreak="event_id", value="queued",
        fold=FlushFold(batch), out="sent", **fold_options,
    )
    return sends.filter(F.size("sent") > 0).select(
        "client_id", F.col("ts").alias("counted_at"), F.posexplode("sent").alias("slot", "post")
    ).select("client_id", F.col("post").cast("bigint").alias("post_id"), "counted_at",
             F.col("slot").cast("bigint").alias("slot"))


def positive_id(raw: str, numeric: bool) -> str:
    """An id without its sign; text counts up to its leading integer, else 0."""
    n = raw if numeric else f"try_cast(regexp_extract({raw}, '^[ \\\\t]*[+-]?([0-9]+)', 1) AS BIGINT)"
    return f"coalesce(CASE WHEN {n} > -9223372036854775808L THEN abs({n}) END, 0L)"


def request_views(requests: DataFrame, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """One row per requested id: capped first, then made absolute; garbage becomes 0, and
    so does a request without ids."""
    numeric = requests.schema["post_ids"].dataType.elementType.typeName() != "string"
    given = f"coalesce(post_ids, array(CAST(NULL AS {'BIGINT' if numeric else 'STRING'})))"
    ids = F.expr(f"transform(slice({given}, 1, {max(1, cfg.batch)}), x -> {positive_id('x', numeric)})")
    rest = [c for c in requests.columns if c not in ("post_ids", "headers")]
    # The address is worked out once per request, before its ids are spread over rows.
    rows = requests.select(*rest, client_ip("headers").alias("ip"), ids.alias("__ids"))
    rows = rows.withColumn("ip_hash", ip_hash(F.col("ip")))
    return rows.select(*rest, "ip", "ip_hash", F.posexplode("__ids").alias("slot", "post_id"))


def eligibility(views: DataFrame, posts: DataFrame, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """Views with a ``reason`` column: NULL when the post may be counted.

    The post side is narrow. Spark broadcasts it when its size allows; otherwise AQE splits
    the skewed partitions of a hot post on the view side.
    """
    dim = posts.select("post_id", F.col("status").alias("__status"), F.col("post_type").alias("__type"))
    joined = views.join(dim, "post_id", "left")
    published = F.coalesce(F.col("__status") == "publish", F.lit(False)) & (F.col("post_id") != 0)
    reason = F.when(~published, "invalid").when(~F.col("__type").isin(*cfg.post_types), "not enabled")
    return joined.withColumn("reason", reason).drop("__status", "__type")


def veto(views: DataFrame, should_count: Column) -> DataFrame:
    """Split off views a site's own rule refuses: ``reason`` becomes ``skipped``."""
    keep = F.coalesce(should_count, F.lit(False))
    return views.withColumn("reason", F.when(F.col("reason").isNull() & ~keep, "skipped")
                            .otherwise(F.col("reason")))
