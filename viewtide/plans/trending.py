"""The hourly trending job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewtide.config import TrendingConfig
from viewtide.functions.calendar import instant
from viewtide.operators import trend
from viewtide.operators.rank import describe
from viewtide.operators.rerank import rerank
from viewtide.session import cut
from viewtide.sources.tables import read_version, write_trending, write_version

# Columns of a run, and the digits its display values are rounded to.
DISPLAY_DIGITS = {
    "velocity": 4, "time_decay": 4, "engagement": 4, "freshness": 4, "momentum": 4, "uplift": 4,
    "uplift_raw": 4, "expected": 2, "ewma": 4, "ewma_val": 4, "acc": 4, "fatigue": 4,
}


def score_run(counters: DataFrame, posts: DataFrame, post_terms: DataFrame, engagement: DataFrame | None, as_of,
              cfg: TrendingConfig = TrendingConfig(), shape: DataFrame | None = None,
              state: DataFrame | None = None, segment_cols=()) -> DataFrame:
    """Candidates, scored and ranked before and after fatigue.

    The candidates (at most ``limit`` rows per segment) are checkpointed: three joins read
    them. ``counters`` should be a stored table, since candidates and hot topics both scan it.
    """
    cands = trend.candidates(counters, posts, cfg, segment_cols)
    cands = cut(cands if cfg.enabled else cands.limit(0))
    heat = trend.hot_topics(counters, posts, post_terms, as_of, cfg, segment_cols)
    feats = trend.features(cands, post_terms, engagement, heat, as_of, cfg, shape, state, segment_cols)
    return trend.rank_twice(trend.score(feats, cfg), cfg)


def trending_run(counters: DataFrame, posts: DataFrame, post_terms: DataFrame, engagement: DataFrame | None, as_of,
                 cfg: TrendingConfig = TrendingConfig(), shape: DataFrame | None = None,
                 state: DataFrame | None = None, segment_cols=()) -> DataFrame:
    """One whole run: every scored post with its components and list positions."""
    scored = score_run(counters, posts, post_terms, engagement, as_of, cfg, shape, state, segment_cols)
    return rerank(scored, as_of, cfg)


def trending_rows(run: DataFrame, as_of) -> DataFrame:
    """A run in its stored form: rounded components in one struct."""
    parts = [F.round(F.col(c), n).alias(c) for c, n in DISPLAY_DIGITS.items()]
    return run.select(
        "segment", "post_id", "score",
        F.col("day").alias("views_day"), F.col("week").alias("views_week"), F.col("month").alias("views_month"),
        F.col("total").alias("views_total"), F.col("day_used").alias("views_day_used"),
        (F.col("day") == 0).cast("int").alias("used_day_fallback"),
        F.round("age", 2).alias("age_hours"), instant(as_of).alias("as_of"), "author_id", "categories", "tags",
        F.struct(*parts, F.col("streak").alias("fatigue_streak")).alias("components"),
        "score_rank", "mmr_position", "explore_position", "position",
    )


def top_trending(trending: DataFrame, counters: DataFrame, posts: DataFrame, number: int = 5, page: int = 1,
                 post_types=("post", "page"), post_terms: DataFrame | None = None, fields: str = "full",
                 segment_cols=(), item: Callable | None = None) -> DataFrame:
    """A page of the stored list by score. The page is cut before posts are filtered by
    type and status, so it can come back short. ``item`` sees the page."""
    number, page = abs(number) or 5, max(1, abs(page))
    keys = ["segment"] if segment_cols else [F.lit(0)]
    by_score = W.partitionBy(*keys).orderBy(F.desc("score"), "position")
    held = trending.filter(F.col("position").isNotNull()).select(
        "segment", "post_id", "score", "views_day", "position")
    sliced = held.withColumn("rank", F.row_number().over(by_score)) \
        .filter((F.col("rank") > (page - 1) * number) & (F.col("rank") <= page * number))
    allowed = posts.filter((F.col("status") == "publish") & F.col("post_type").isin(list(post_types)))
    rows = sliced.join(allowed.select("post_id"), "post_id").join(
        counters.select("post_id", F.coalesce("total", F.lit(0)).alias("views")), "post_id", "left")
    rows = rows.select(
        "segment", "post_id", "rank", F.coalesce("views", F.lit(0)).alias("views"), F.lit(True).alias("trending"),
        F.col("rank").alias("trending_position"), F.col("score").alias("trending_score"),
        F.col("views_day").alias("trending_views"))
    full = describe(rows, posts, post_terms, fields).withColumnRenamed("post_id", "id")
    if fields == "minimal":
        return full.select("id", "title", "link", "rank")
    return item(full) if item else full


def refresh_trending(spark: SparkSession, path: str, as_of: str, counters: DataFrame, posts: DataFrame,
                     post_terms: DataFrame, engagement: DataFrame | None, cfg: TrendingConfig = TrendingConfig(),
                     shape: DataFrame | None = None, previous: str | None = None, segment_cols=()) -> DataFrame:
    """Run at ``as_of`` from the state of run ``previous`` and write list, debug rows and
    state, each under its ``as_of``; a rerun replaces its own output only.

    The run itself is written once (at most ``limit`` rows per segment) and everything else
    is derived from that table.
    """
    state = read_version(spark, f"{path}/state", previous) if previous else None
    run = trending_run(counters, posts, post_terms, engagement, as_of, cfg, shape, state, segment_cols)
    write_version(run, f"{path}/run", as_of)
    run = read_version(spark, f"{path}/run", as_of)
    write_version(trend.next_state(run, state, as_of, cfg), f"{path}/state", as_of)
    write_trending(trending_rows(run, as_of), path, as_of, cfg.debug_size)
    return read_version(spark, f"{path}/trending", as_of)
