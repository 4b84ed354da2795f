"""The counting job: view requests in, accepted views and per-id results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.config import LIVE_RANGES, CountingConfig
from viewtide.functions.text import grouped_count, short_count
from viewtide.operators.counters import running_counts
from viewtide.operators.ipdedup import dedup_recent_ip
from viewtide.operators.qualify import eligibility, request_views, veto
from viewtide.session import cut


def gate_requests(requests: DataFrame, posts: DataFrame, cfg: CountingConfig = CountingConfig(),
                  should_count: Column | None = None, **fold_options) -> DataFrame:
    """Every requested id with the first gate that refused it in ``reason`` (NULL: counted).

    Gates in order: batch cap, published, allowed type, recent address, the site's own
    rule. A view refused by that last rule has already taken a slot in the address list.
    Requests need a ``bigint event_id``; ids of one request follow each other.
    """
    rows = request_views(requests, cfg)
    seq = F.col("event_id") * F.lit(max(1, cfg.batch)) + F.col("slot")
    rows = eligibility(rows.withColumn("seq", seq.cast("bigint")), posts, cfg)
    if cfg.strict_ip:
        # Rows refused so far carry no address, so the check passes over them.
        asked = rows.withColumnsRenamed({"event_id": "request_no", "seq": "event_id", "ip_hash": "all_hash"}) \
            .withColumn("ip_hash", F.expr("CASE WHEN reason IS NULL THEN all_hash END"))
        rows = dedup_recent_ip(asked, cfg, **fold_options).drop("ip_hash") \
            .withColumnsRenamed({"event_id": "seq", "request_no": "event_id", "all_hash": "ip_hash"}) \
            .withColumn("reason", F.expr("CASE WHEN ip_duplicate THEN 'ip_duplicate' ELSE reason END")).drop("ip_duplicate")
    return veto(rows, should_count) if should_count is not None else rows


def count_requests(requests: DataFrame, posts: DataFrame, cfg: CountingConfig = CountingConfig(),
                   should_count: Column | None = None, **fold_options) -> DataFrame:
    """Per requested id: the reason it was refused, or its counters after counting it."""
    rows = gate_requests(requests, posts, cfg, should_count, **fold_options)
    if cfg.strict_ip:
        rows = cut(rows)  # read twice below; the address check should run once
    out = running_counts(rows, cfg, tiebreak="seq", counted="reason IS NULL")
    live = [r for r in LIVE_RANGES if cfg.enabled(r)]
    return out.select(
        "request_id", "slot", "post_id", "reason", *live,
        grouped_count(F.col("total")).alias("total_formatted"), short_count(F.col("total")).alias("total_short"))


def accepted_views(requests: DataFrame, posts: DataFrame, cfg: CountingConfig = CountingConfig(),
                   should_count: Column | None = None, **fold_options) -> DataFrame:
    """The rows to append to the view log."""
    rows = gate_requests(requests, posts, cfg, should_count, **fold_options)
    return rows.filter(F.col("reason").isNull()).select(F.col("seq").alias("event_id"), "post_id", "ts", "ip_hash")
