"""Per-post recent-visitor check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.config import CountingConfig
from viewtide.operators.ordered import RecentFold, ordered_fold


def dedup_recent_ip(views: DataFrame, cfg: CountingConfig = CountingConfig(), **fold_options) -> DataFrame:
    """Tag views whose address hash is still in the post's recent list (``ip_duplicate``)."""
    fold = RecentFold(cfg.ip_slots, cfg.ip_ttl_days * 86_400_000_000)
    return ordered_fold(views, key="post_id", ts="ts", tiebreak="event_id", value="ip_hash",
                        fold=fold, out="ip_duplicate", **fold_options)


def accepted_by_ip(views: DataFrame, cfg: CountingConfig = CountingConfig(), **fold_options) -> DataFrame:
    return dedup_recent_ip(views, cfg, **fold_options).filter(~F.col("ip_duplicate")).drop("ip_duplicate")
