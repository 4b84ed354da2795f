"""Trending: hot topics, candidates, scores, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.config import LIVE_RANGES, TrendingConfig
from viewtide.functions import formulas as fx
from viewtide.functions.calendar import at, hours_between
from viewtide.session import cut
from viewtide.sources.tables import live_state

TAXONOMIES = ("category", "post_tag")
LISTS = ("day", "week", "month", "total")  # by priority


def segment(cols) -> Column:
    """One text key for any number of segment columns; '' when there are none."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols]) if cols else F.lit("")


def bounded(df: DataFrame, rows: int, segment_cols) -> DataFrame:
    """Broadcast a table that holds at most ``rows`` rows by construction. With segments
    the number of rows is not known up front, so Spark decides from measured sizes."""
    return F.broadcast(df) if not segment_cols and rows <= 100_000 else df


def known_terms(post_terms: DataFrame) -> DataFrame:
    return post_terms.filter(F.col("taxonomy").isin(*TAXONOMIES)).select("post_id", "taxonomy", "term_id")


def hot_topics(counters: DataFrame, posts: DataFrame, post_terms: DataFrame, as_of,
               cfg: TrendingConfig = TrendingConfig(), segment_cols=()) -> DataFrame:
    """Heat 0..1 of categories and tags among the most viewed fresh posts."""
    fresh = posts.filter(f"status = 'publish' AND published_at >= {at(as_of)} - INTERVAL {cfg.hot_hours} HOUR") \
        .select("post_id", segment(segment_cols).alias("segment"))
    seen = counters.filter("day > 0").select("post_id", "day")
    top = fresh.join(seen, "post_id").selectExpr(
        "*", "row_number() OVER (PARTITION BY segment ORDER BY day DESC, post_id DESC) AS __rn") \
        .filter(f"__rn <= {cfg.hot_posts}").drop("__rn")
    views = known_terms(post_terms).join(bounded(top, cfg.hot_posts, segment_cols), "post_id") \
        .dropDuplicates(["post_id", "taxonomy", "term_id"]) \
        .groupBy("segment", "taxonomy", "term_id").agg(F.sum("day").alias("views"))
    return views.selectExpr("*", "views / max(views) OVER (PARTITION BY segment, taxonomy) AS heat")


def _leading(counters: DataFrame, dim: DataFrame, carried, limit: int) -> DataFrame:
    """``post_id, list, value``, the carried columns: at least the first ``limit`` posts of ``dim`` in
    each list, or all of them, without joining the others.

    Of each list the first ``2 * limit`` counters are taken from a heap a task, whatever posts
    they are of. If too few of those posts may be listed, the list goes on four times as deep.
    A list ends when it is long enough or its counters are used up, so the rounds are as many
    as the logarithm of the deepest place looked at.
    """
    order, depth, left, rounds, sizes = [F.desc("value"), F.desc("post_id")], 2 * max(1, limit), list(LISTS), [], None
    while left:
        heads = None
        for r in left:
            head = counters.filter(F.col(r).isNotNull()).select(
                "post_id", *LIVE_RANGES, F.lit(LISTS.index(r)).alias("list"), F.col(r).alias("value"))
            head = head.orderBy(*order).limit(depth)
            heads = head if heads is None else heads.unionByName(head)
        found = cut(dim.join(bounded(heads, len(left) * depth, ()), "post_id"))
        rows = {LISTS[n]: k for n, k in found.groupBy("list").count().collect()}  # one row a list
        more = [r for r in left if rows.get(r, 0) < limit]
        if more and sizes is None:
            sizes = counters.agg(*[F.count(r).alias(r) for r in LISTS]).first().asDict()
        more = [r for r in more if sizes[r] > depth]
        rounds.append(found.filter(F.col("list").isin([LISTS.index(r) for r in left if r not in more])))
        left, depth = more, depth * 4
    whole = rounds[0]
    for other in rounds[1:]:
        whole = whole.unionByName(other)
    return whole.select("segment", "post_id", *carried, "list", "value")


def candidates(counters: DataFrame, posts: DataFrame, cfg: TrendingConfig = TrendingConfig(),
               segment_cols=(), run_cols=()) -> DataFrame:
    """Posts to score, in order. The day list alone when it is long enough, otherwise a
    rank fusion of the day, week, month and total lists.

    A single run looks at sorted prefixes of the counters and joins only the posts found there
    (``_leading``). With segments, which are known by post, each list is cut to ``limit`` rows
    per segment by a group limit in every task before anything is shuffled. All later steps
    see at most four lists per segment. The counters and post columns the score needs ride
    along, so they are not joined again.

    ``run_cols`` are columns of ``counters`` that tell runs apart, such as the ``as_of`` of
    ``counters_at``: they come first in ``segment``, and each run has lists of its own.
    """
    carried = ["author_id", "published_at", *LIVE_RANGES]
    dim = posts.filter((F.col("status") == "publish") & F.col("post_type").isin(list(cfg.types()))) \
        .select("post_id", segment(segment_cols).alias("segment"), "author_id", "published_at")
    if segment_cols or run_cols:
        runs = counters.select("post_id", *LIVE_RANGES, segment(run_cols).alias("__run"))
        name = F.concat_ws("|", *["__run"] * bool(run_cols), *["segment"] * bool(segment_cols))
        long = runs.join(dim, "post_id").withColumn("segment", name).selectExpr(
            "segment", "post_id", *carried,
            f"stack({len(LISTS)}, {', '.join(f'{i}, {r}' for i, r in enumerate(LISTS))}) AS (list, value)",
        ).filter("value IS NOT NULL")
    else:
        long = _leading(counters.select("post_id", *LIVE_RANGES), dim, carried, cfg.limit)
    kept = long.selectExpr(
        "*", "row_number() OVER (PARTITION BY segment, list ORDER BY value DESC, post_id DESC) AS __rank",
    ).filter(f"__rank <= {cfg.limit}")
    one = kept.groupBy("segment", "post_id").agg(
        *[F.expr(f"max(CASE WHEN list = {i} THEN __rank - 1 END) AS {r}_rank") for i, r in enumerate(LISTS)],
        *[F.max(c).alias(c) for c in carried],
    )
    ranks = [f"{r}_rank" for r in LISTS]
    parts = [f"coalesce({fx.num(cfg.list_weights[r])} * (1D - {r}_rank / {fx.num(max(1, cfg.limit))}), 0D)" for r in LISTS]
    bonus = f"CASE WHEN day_rank IS NOT NULL THEN {fx.num(cfg.day_bonus)} ELSE 0D END"
    first_list = "CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN {i}" for i, c in enumerate(ranks)) + " END"
    fused = one.selectExpr(
        "*", f"{' + '.join(parts)} + {bonus} AS fusion_score",
        f"count(day_rank) OVER (PARTITION BY segment) >= {cfg.min_count} AS by_day",
        f"row_number() OVER (PARTITION BY segment ORDER BY {first_list}, coalesce({', '.join(ranks)})) AS list_pos",
    ).filter(f"CASE WHEN by_day THEN day_rank IS NOT NULL ELSE list_pos <= {max(cfg.limit, cfg.min_count)} END")
    # Posts past ``limit`` only pad a list shorter than ``min_count``: they stay last.
    return fused.selectExpr("*", f"""row_number() OVER (PARTITION BY segment ORDER BY
        CASE WHEN list_pos > {cfg.limit} THEN list_pos ELSE 0 END,
        CASE WHEN by_day THEN CAST(day_rank AS DOUBLE) ELSE -fusion_score END,
        day_rank ASC NULLS LAST, week_rank ASC NULLS LAST, post_id DESC) AS cand_rank""").drop("list_pos")


def term_features(cands: DataFrame, post_terms: DataFrame, heat: DataFrame, cfg: TrendingConfig,
                  segment_cols=()) -> DataFrame:
    """Per candidate: its term ids, topic momentum, and hottest category."""
    ids = bounded(cands.select("segment", "post_id"), max(cfg.limit, cfg.min_count), segment_cols)
    terms = known_terms(post_terms).join(ids, "post_id").dropDuplicates(["segment", "post_id", "taxonomy", "term_id"])
    known = terms.join(heat.select("segment", "taxonomy", "term_id", "heat"), ["segment", "taxonomy", "term_id"], "left")
    boost = "1D + coalesce(heat, 0D) * CASE taxonomy WHEN 'category' THEN 0.1D ELSE 0.05D END"
    return known.groupBy("segment", "post_id").agg(
        F.expr("sort_array(collect_set(CASE taxonomy WHEN 'category' THEN term_id END)) AS categories"),
        F.expr("sort_array(collect_set(CASE taxonomy WHEN 'post_tag' THEN term_id END)) AS tags"),
        F.least(F.product(F.expr(boost)), F.lit(1.5)).alias("momentum"),
        F.expr("coalesce(max(CASE taxonomy WHEN 'category' THEN heat END), 0D) AS category_heat"),
    )


def features(cands: DataFrame, post_terms: DataFrame, engagement: DataFrame | None, heat: DataFrame, as_of,
             cfg: TrendingConfig = TrendingConfig(), shape: DataFrame | None = None,
             state: DataFrame | None = None, segment_cols=()) -> DataFrame:
    """Candidates with everything a score is made of. ``shape`` holds ``hour_factor`` and
    ``wday_factor`` (per ``segment`` when there are segments)."""
    out = cands.filter("unix_seconds(published_at) > 0") \
        .join(term_features(cands, post_terms, heat, cfg, segment_cols), ["segment", "post_id"], "left")
    actions, factor, previous = "0L", F.lit(1.0), ["CAST(NULL AS DOUBLE) AS prev_ewma",
                                                  "CAST(NULL AS DOUBLE) AS prev_score", "CAST(NULL AS INT) AS prev_streak"]
    if engagement is not None:
        ids = bounded(cands.select("post_id"), max(cfg.limit, cfg.min_count), segment_cols)
        actions = "coalesce(__actions, 0L)"
        summed = "coalesce(comments, 0L) + coalesce(likes, 0L) + coalesce(shares, 0L) AS __actions"
        out = out.join(engagement.join(ids, "post_id", "left_semi").selectExpr("post_id", summed), "post_id", "left")
    if shape is not None:
        both = shape.withColumn("__shape", F.expr("hour_factor * wday_factor"))
        if "segment" in shape.columns:
            out = out.join(both.select("segment", "__shape"), "segment", "left")
            factor = F.expr("coalesce(__shape, 1D)")
        else:
            factor = F.coalesce(both.select("__shape").limit(1).scalar(), factor)
    if state is not None:
        alive = live_state(state, as_of, cfg.ewma_ttl_hours, cfg.score_ttl_hours, cfg.streak_ttl_hours).selectExpr(
            "segment", "post_id", "ewma AS prev_ewma", "last_score AS prev_score", "streak AS prev_streak")
        out = out.join(alive, ["segment", "post_id"], "left")
        previous = ["prev_ewma", "prev_score", "prev_streak"]
    return out.select(*map(F.expr, [
        "segment", "post_id", "author_id", "published_at", "cand_rank", "fusion_score", "by_day",
        *[f"{r}_rank" for r in LISTS],
        *[f"coalesce({r}, 0L) AS {r}" for r in LIVE_RANGES],
        f"greatest(0.5D, {hours_between(at(as_of), 'published_at')}) AS age",
        "coalesce(categories, CAST(array() AS array<bigint>)) AS categories",
        "coalesce(tags, CAST(array() AS array<bigint>)) AS tags",
        "coalesce(momentum, 1D) AS momentum", "coalesce(category_heat, 0D) AS category_heat",
        f"{actions} AS actions", *previous,
    ]), factor.alias("shape_factor"))


def score(feats: DataFrame, cfg: TrendingConfig = TrendingConfig()) -> DataFrame:
    """Every component and the capped score, before ranking. One projection; each
    expression uses the names of the ones before it."""
    return feats.selectExpr(
        "*", *[f"{sql} AS {name}" for name, sql in fx.COMPONENTS.items()],
        f"{fx.raw_score(cfg.weight)} AS raw_score", f"{fx.CAPPED} AS capped")


def rank_twice(scored: DataFrame, cfg: TrendingConfig = TrendingConfig()) -> DataFrame:
    """Rank on the rounded score, apply exposure fatigue, rank again. Equal scores keep
    their earlier order."""
    first = scored.withColumn("base_score", F.round("capped", 4)).selectExpr(
        "*", "row_number() OVER (PARTITION BY segment ORDER BY base_score DESC, cand_rank) AS pre_rank")
    tired = first.selectExpr(
        "*", f"CASE WHEN pre_rank <= {cfg.top_size} THEN coalesce(prev_streak, 0) + 1 ELSE 0 END AS streak",
        f"{fx.FATIGUE} AS fatigue", f"base_score * pow(fatigue, {fx.num(cfg.weight('fatigue'))}) AS score")
    return tired.selectExpr("*", "row_number() OVER (PARTITION BY segment ORDER BY score DESC, pre_rank) AS score_rank")


def next_state(run: DataFrame, state: DataFrame | None, as_of, cfg: TrendingConfig = TrendingConfig()) -> DataFrame:
    """State after a run: scored posts are renewed, others keep what is still alive."""
    now = at(as_of)
    new = run.selectExpr(
        "segment", "post_id", "ewma_val AS ewma", f"{now} AS ewma_at", "capped AS last_score", f"{now} AS score_at",
        "CASE WHEN streak > 0 THEN streak END AS streak", f"CASE WHEN streak > 0 THEN {now} END AS streak_at")
    if state is None:
        return new
    old = live_state(state, as_of, cfg.ewma_ttl_hours, cfg.score_ttl_hours, cfg.streak_ttl_hours)
    kept = old.join(new.select("segment", "post_id"), ["segment", "post_id"], "left_anti") \
        .filter("coalesce(ewma_at, score_at, streak_at) IS NOT NULL")
    return kept.unionByName(new)


def streaks(history: DataFrame, cfg: TrendingConfig = TrendingConfig()) -> DataFrame:
    """Back-fill of top-list streaks over past runs ``(segment, post_id, run_at, in_top)``.

    A streak breaks when a run leaves the post out of the top, or when its last top run is
    older than the state's lifetime.
    """
    per = "PARTITION BY segment, post_id ORDER BY run_at"
    gap = hours_between("run_at", f"lag(run_at) OVER ({per})")
    marked = history.selectExpr("*", f"NOT in_top OR coalesce({gap} > {fx.num(cfg.streak_ttl_hours)}, false) AS __broke")
    island = marked.selectExpr("*", f"sum(CASE WHEN __broke THEN 1 ELSE 0 END) OVER ({per}) AS __island")
    run = "PARTITION BY segment, post_id, __island ORDER BY run_at"
    counted = island.selectExpr(
        "*", f"CAST(sum(CASE WHEN in_top THEN 1 ELSE 0 END) OVER ({run}) AS INT) AS streak")
    return counted.selectExpr("*", f"{fx.FATIGUE} AS fatigue").drop("__broke", "__island")
