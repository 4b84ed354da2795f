"""Registered queries: ``(spark, sf_dir) -> DataFrame`` over whole tables.

Doubles are shown through ``fixed`` so two engines agree on the last digit.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewtide.config import CountingConfig, ShapeConfig, TrendingConfig
from viewtide.functions import formulas as fx
from viewtide.functions import text
from viewtide.functions.calendar import instant
from viewtide.functions.net import client_ip, ip_hash
from viewtide.functions.text import fixed
from viewtide.operators import counters as c
from viewtide.operators import ipdedup, qualify, rank, rerank, shape, trend
from viewtide.plans import counting, daily, partials, trending
from viewtide.session import STREAM_DEFAULTS, cut, shared_dir
from viewtide.sources import adapters as a
from viewtide.sources import tables
from viewtide.streaming import firstviews, live

# The event log starts with the month; sf0.001 has too few views a day for the default floor.
SHAPE = ShapeConfig(min_daily=20)
BEFORE = "2024-01-30 22:00:00"
NOW = a.EVENTS_AS_OF
DAWN = "2024-01-30 00:40:00"
PAST = ("2024-01-10 13:00:00", "2024-01-17 00:00:30", NOW)
#: Arrivals of a stream are files of about this many rows.
FILE_ROWS = 250_000


def _event_counters(spark, d, as_of=NOW, **kw) -> DataFrame:
    return c.counters_as_of(a.event_views(spark, d), as_of, a.document_posts(spark, d), **kw)


def _part_counters(spark, d, as_of=a.PARTS_AS_OF, **kw) -> DataFrame:
    return c.counters_as_of(a.part_views(spark, d), as_of, a.part_posts(spark, d), **kw)


# --- counting -------------------------------------------------------------------------

def client_address(spark, d):
    r = a.requests(spark, d)
    ip = client_ip("headers")
    return r.select("event_id", ip.alias("ip"), ip_hash(ip).alias("ip_hash"))


def requested_ids(spark, d):
    rows = qualify.request_views(a.requests(spark, d), CountingConfig(batch=3))
    return rows.select("event_id", F.col("slot").cast("bigint").alias("slot"), "post_id")


def request_feed(spark, d):
    """A JSON feed whose requests give one id, a list, or a list of texts, read back."""
    path, r = f"{shared_dir(spark)}/viewtide-feed-{uuid.uuid4().hex}", a.requests(spark, d)
    def line(ids):
        return F.to_json(F.struct("request_id", "ts", ids.alias("post_id"), "headers"))
    kind = F.col("event_id") % 3
    r.select(F.when(kind == 0, line(F.element_at("post_ids", 1))).when(kind == 1, line(F.col("post_ids")))
             .otherwise(line(F.col("post_ids").cast("array<string>")))).write.text(path)
    rows = qualify.request_views(tables.read_view_requests(spark, path), CountingConfig(batch=3))
    return rows.select(F.col("request_id").cast("bigint").alias("event_id"), F.col("slot").cast("bigint").alias("slot"), "post_id")


def eligible(spark, d):
    cfg = CountingConfig(batch=2)
    rows = qualify.eligibility(qualify.request_views(a.requests(spark, d), cfg), a.document_posts(spark, d), cfg)
    return rows.select("event_id", F.col("slot").cast("bigint").alias("slot"), "post_id", "reason")


def _site_rule():
    return ~F.col("ip").startswith("198.")


def counted_requests(spark, d):
    """All gates: cap, status, type, recent address, and a site rule that refuses proxies."""
    cfg = CountingConfig(batch=2, strict_ip=True, post_types=("post", "page"))
    rows = counting.count_requests(a.requests(spark, d), a.document_posts(spark, d), cfg, should_count=_site_rule())
    return rows.select("request_id", F.col("slot").cast("bigint").alias("slot"), "post_id", "reason",
                       "total", "day", "week", "month")


def qualified(spark, d):
    return qualify.qualify_views(a.event_views(spark, d)).select("event_id", "post_id", "dwell_ms", "scroll_pct")


def _dedup(storage):
    def query(spark, d):
        views = qualify.dedup_viewer(a.event_views(spark, d), CountingConfig(storage=storage))
        return views.select("event_id", "client_id", "session_id", "post_id")
    return query


def _flush(storage):
    def query(spark, d):
        cfg = CountingConfig(storage=storage)
        views = qualify.dedup_viewer(a.event_views(spark, d), cfg)
        return qualify.batch_flush(views, 3, cfg)
    return query


def strict_ip(spark, d):
    views = a.event_views(spark, d).select("event_id", "post_id", "ts", ip_hash(F.col("client_id")).alias("ip_hash"))
    tagged = ipdedup.dedup_recent_ip(views)
    return tagged.select("event_id", "post_id", "ip_duplicate")


# --- counters -------------------------------------------------------------------------

def counters_long(spark, d):
    return c.to_long(_event_counters(spark, d))


KEYS = {"total": "views_all", "yesterday": "views_before"}


def counters_renamed(spark, d):
    """Counters through a store that has its own key names."""
    return c.to_wide(c.to_long(_event_counters(spark, d), KEYS), KEYS)


def rollover_forced(spark, d):
    """A reset in the middle of a week that rolls the month but not the week, over counters that
    one hook trims and another marks."""
    before = c.counters_as_of(a.event_views(spark, d), NOW, a.document_posts(spark, d))
    rows = c.rollover(before, a.document_posts(spark, d), "2024-01-31 00:01:00", reset_week=False, reset_month=True,
                      before=lambda df: df.filter("total > 1"), after=lambda df: df.withColumn("moved", F.col("day").isNull()))
    return rows.select("post_id", *c.RANGES, "moved")


def counters_wide(spark, d):
    return c.to_wide(c.to_long(_event_counters(spark, d)))


def advanced(spark, d):
    """Counters stored on a Sunday at noon, from a log that lacks a tenth of its rows so far, and
    one batch over two resets that brings the rest: late views of closed days and new ones."""
    since, views = "2024-01-28 12:00:00", a.event_views(spark, d)
    posts, known = a.document_posts(spark, d), (F.col("ts") <= instant(since)) & (F.col("event_id") % 10 != 3)
    path = f"{shared_dir(spark)}/viewtide-counters-{uuid.uuid4().hex}"
    tables.write_version(c.counters_as_of(views.filter(known), since, posts), path, since)
    return c.advance(tables.read_version(spark, path, since), views.filter(~known), since, NOW, posts)


def _chain(spark, d):
    """A daily job that ran on 27 January, then not for two nights, then again on the 30th."""
    base = f"{shared_dir(spark)}/viewtide-daily-{uuid.uuid4().hex}"
    tables.write_views(a.event_views(spark, d).select("event_id", "post_id", "ts"), f"{base}/log")
    for until in ("2024-01-27", "2024-01-30", "2024-01-30"):
        daily.run_days(spark, base, f"{base}/log", a.document_posts(spark, d), until, shape_cfg=SHAPE)
    return base


def daily_chain(spark, d):
    """Counters after a chain of daily runs with a gap."""
    return tables.read_version(spark, f"{_chain(spark, d)}/counters", "2024-01-30 00:01:00")


def daily_chain_shape(spark, d):
    """The hour shape after the same chain."""
    shape_ = tables.read_version(spark, f"{_chain(spark, d)}/shape", "2024-01-30 00:01:00")
    return shape_.select(F.posexplode("hour").alias("slot", "m")).select(
        F.col("slot").cast("bigint").alias("slot"), fixed(F.col("m")).alias("multiplier"))


def _late_chain(spark, d):
    """Daily runs up to the 29th over a log that lacks a tenth of its rows of four days, which come
    late in a batch given twice, and then the next run."""
    base, views = f"{shared_dir(spark)}/viewtide-daily-{uuid.uuid4().hex}", a.event_views(spark, d).select("event_id", "post_id", "ts")
    posts, log = a.document_posts(spark, d), f"{base}/log"
    late = (F.col("event_id") % 10 == 3) & F.col("ts").between(instant("2024-01-25 00:00:00"), instant("2024-01-28 20:00:00"))
    tables.write_views(views.filter(~late), log)
    for until in ("2024-01-25", "2024-01-29"):
        daily.run_days(spark, base, log, posts, until, shape_cfg=SHAPE)
    tables.write_views(views.filter(late), log)
    for _ in range(2):
        daily.add_late_views(spark, base, log, views.filter(late), posts, "late-rows", shape_cfg=SHAPE)
    daily.run_days(spark, base, log, posts, "2024-01-30", shape_cfg=SHAPE)
    return base


def late_counters(spark, d):
    """Counters of a corrected reset and of the run that goes on from it."""
    base = _late_chain(spark, d)
    resets = [f"2024-01-{day} 00:01:00" for day in (29, 30)]
    return reduce(DataFrame.unionByName, [daily.read_day(spark, base, "counters", t).withColumn("as_of", instant(t)) for t in resets])


def late_shape(spark, d):
    """The hour shape after the same."""
    shape_ = daily.read_day(spark, _late_chain(spark, d), "shape", "2024-01-30 00:01:00")
    return shape_.select(F.posexplode("hour").alias("slot", "m")).select(
        F.col("slot").cast("bigint").alias("slot"), fixed(F.col("m")).alias("multiplier"))


def counters_partials(spark, d):
    """Counters at past instants and now from dyadic day partials: stored in two runs from a log
    that lacks a tenth of its rows before 20 January, which come late, in a batch given twice."""
    base, views = f"{shared_dir(spark)}/viewtide-partials-{uuid.uuid4().hex}", a.event_views(spark, d).select("event_id", "post_id", "ts")
    late = (F.col("event_id") % 10 == 3) & (F.col("ts") < instant("2024-01-20 00:00:00"))
    tables.write_views(views.filter(~late), f"{base}/log")
    for until in ("2024-01-15 06:00:00", "2024-01-29 12:00:00"):
        partials.extend_partials(spark, f"{base}/partials", f"{base}/log", until)
    tables.write_views(views.filter(late), f"{base}/log")
    for _ in range(2):
        partials.add_late(spark, f"{base}/partials", views.filter(late), "late-rows")
    found = [partials.counters_from_partials(spark, f"{base}/partials", f"{base}/log", t, a.document_posts(spark, d))
             .withColumn("as_of", instant(t)) for t in PAST]
    return reduce(DataFrame.unionByName, found)


def running(spark, d):
    views = a.event_views(spark, d).select("event_id", "post_id", "ts")
    return c.running_counts(views).select("event_id", "post_id", "total", "day", "week", "month")


def applied(spark, d):
    """Stored counters at a rollover plus the day's views: the incremental way to the same numbers."""
    start = "2024-01-30 00:01:00"
    views = a.event_views(spark, d)
    closed = c.counters_as_of(views.filter(F.col("ts") < instant(start)), start, a.document_posts(spark, d))
    today = views.filter((F.col("ts") >= instant(start)) & (F.col("ts") <= instant(NOW)))
    return c.apply_views(closed, today)


def rolled(spark, d):
    """Monday rollover of the counters as they stood just before it."""
    before = c.counters_as_of(a.event_views(spark, d), "2024-01-29 00:00:59", a.document_posts(spark, d))
    return c.rollover(before, a.document_posts(spark, d), "2024-01-29 00:01:00")


def rolled_summary(spark, d):
    return c.rollover_summary(a.document_posts(spark, d), "2024-01-29 00:01:00")


# --- rankings -------------------------------------------------------------------------

TOP_COLUMNS = ["rank", "id", "title", "link", "views", "post_type", "type", "category", "thumbnail", "date"]


def _top(rng, make=_event_counters, posts=a.document_posts, **kw):
    def query(spark, d):
        full = rank.top_posts(make(spark, d, ranges=(rng,)), posts(spark, d), rng,
                              post_terms=a.document_terms(spark, d) if posts is a.document_posts else None, **kw)
        return full.select(*TOP_COLUMNS)
    return query


def top_excerpts(spark, d):
    full = rank.top_posts(_event_counters(spark, d, ranges=("total",)), a.document_posts(spark, d), number=10)
    return full.select("rank", "id", "excerpt", text.trim_words(F.col("excerpt")).alias("short_excerpt"))


def top_by_terms(spark, d):
    full = rank.top_posts(_event_counters(spark, d, ranges=("month",)), a.document_posts(spark, d), "month",
                          tax="category", terms="topic-3,topic-5", post_terms=a.document_terms(spark, d),
                          number=4, page=2)
    return full.select(*TOP_COLUMNS)


def top_by_segment(spark, d):
    posts = a.part_posts(spark, d)
    rows = rank.top_posts(_part_counters(spark, d, ranges=("month",)), posts, "month", fields="minimal",
                          segment_cols=["segment"], number=10)
    return rows.select("segment", "rank", "id", "title")


def view_list(spark, d):
    rows = rank.view_list(_event_counters(spark, d, ranges=("week",)), a.document_posts(spark, d), rng="week",
                          category="en", order="ASC", post_terms=a.document_terms(spark, d))
    return rows.select("rank", "id", "title", "views", "category")


def view_list_by_date(spark, d):
    rows = rank.view_list(_event_counters(spark, d, ranges=("total",)), a.document_posts(spark, d), rng="trending",
                          orderby="date", page=2, category="en", tag="tag-4",
                          post_terms=a.document_terms(spark, d), number=1)
    return rows.select("rank", "id", "title", "views", "date")


def view_list_by_title(spark, d):
    rows = rank.view_list(_event_counters(spark, d, ranges=("day",)), a.document_posts(spark, d), rng="day",
                          orderby="title", order="ASC", number=7, page=2)
    return rows.select("rank", "id", "title", "views")


def ranking_tabs(spark, d):
    return rank.ranking_tabs(_part_counters(spark, d), a.part_posts(spark, d),
                             "total,day,week,month,last_month,yesterday,last_week,unknown", 10)


def post_count(spark, d):
    return rank.post_count(_part_counters(spark, d, ranges=("total",)), a.part_posts(spark, d), "total", "short") \
        .select("post_id", "views", "view_text")


def format_counts(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    n = F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), F.pmod("o_custkey", F.lit(9)) - 4)).cast("bigint")
    now = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", n.alias("n"), text.short_count(n).alias("short"),
                    text.short_count(n, "vi").alias("short_vi"), text.grouped_count(n).alias("grouped"),
                    text.age_text(now, instant("2001-12-31 00:00:00")).alias("age"))


# --- traffic shape --------------------------------------------------------------------

def hour_bins(spark, d):
    bins = shape.hour_bins(a.event_views(spark, d))
    return bins.select("site_day", "total", F.posexplode("hour_bins").alias("hour", "views")) \
        .withColumn("hour", F.col("hour").cast("bigint"))


def _learned(spark, d, cfg=SHAPE):
    return shape.learn_shape(shape.hour_bins(a.event_views(spark, d), cfg), cfg, NOW)


def _shape(name):
    def query(spark, d):
        return _learned(spark, d).select(F.posexplode(name).alias("slot", "m")).select(
            F.col("slot").cast("bigint").alias("slot"), fixed(F.col("m")).alias("multiplier"))
    return query


def shape_resumed(spark, d):
    """The hour shape learned in two runs: half of the days, stored, then the others."""
    bins = shape.hour_bins(a.event_views(spark, d), SHAPE)
    stored = cut(shape.learn_shape(bins, SHAPE, "2024-01-15 00:01:00"))
    later = shape.learn_shape(bins.filter("site_day >= DATE '2024-01-15'"), SHAPE, NOW, start=stored)
    return later.select(F.posexplode("hour").alias("slot", "m")).select(
        F.col("slot").cast("bigint").alias("slot"), fixed(F.col("m")).alias("multiplier"))


def shape_skipping(spark, d):
    """The hour shape with the log's mean day as traffic floor, so quiet days are skipped."""
    bins = shape.hour_bins(a.event_views(spark, d), SHAPE)
    floor = bins.agg(F.floor(F.avg("total")).cast("int")).first()[0]
    cfg = ShapeConfig(min_daily=floor)
    return shape.learn_shape(bins, cfg, NOW).select("days_learned", F.posexplode("hour").alias("slot", "m")).select(
        "days_learned", F.col("slot").cast("bigint").alias("slot"), fixed(F.col("m")).alias("multiplier"))


def shape_factors(spark, d):
    f = shape.factors(_learned(spark, d), NOW)
    return f.select(*[fixed(F.col(n)).alias(n) for n in f.columns])


def merged_bins(spark, d):
    """Bins of two collectors (by event kind) added up."""
    v = a.event_views(spark, d)
    both = shape.merge_bins(shape.hour_bins(v.filter("event_type = 'view'")),
                            shape.hour_bins(v.filter("event_type <> 'view'")))
    return both.select("site_day", "total", F.posexplode("hour_bins").alias("hour", "views")) \
        .withColumn("hour", F.col("hour").cast("bigint"))


# --- trending -------------------------------------------------------------------------

def _tables(spark, d, as_of):
    """Inputs of a trending run. Counters are a stored table in that job, read many times."""
    counters = cut(c.counters_at(a.event_views(spark, d), [as_of]).drop("as_of"))
    return counters, a.document_posts(spark, d), a.document_terms(spark, d), a.event_engagement(spark, d, as_of)


def _scored(spark, d, as_of=NOW, cfg=TrendingConfig()):
    factors = shape.factors(_learned(spark, d), as_of)
    return trending.score_run(*_tables(spark, d, as_of), as_of, cfg, factors)


def _two_runs(spark, d, cfg=TrendingConfig()):
    """The state left by the run one hour earlier, a stored table, and the run from it. Both
    see counters of one pass over the log, and the shape learned up to the day before."""
    counters = cut(c.counters_at(a.event_views(spark, d), [BEFORE, NOW]))
    learned, posts, terms = cut(_learned(spark, d)), a.document_posts(spark, d), a.document_terms(spark, d)

    def run(as_of, state):
        at_run = counters.filter(F.col("as_of") == instant(as_of)).drop("as_of")
        return trending.score_run(at_run, posts, terms, a.event_engagement(spark, d, as_of), as_of, cfg,
                                  shape.factors(learned, as_of), state)

    state = cut(trend.next_state(run(BEFORE, None), None, BEFORE, cfg))
    return state, run(NOW, state)


def _second(spark, d, cfg=TrendingConfig()):
    return _two_runs(spark, d, cfg)[1]


def _run(spark, d, cfg=TrendingConfig()):
    return rerank.rerank(_second(spark, d, cfg), NOW, cfg)


def term_sets(spark, d):
    sets = tables.term_sets(a.document_terms(spark, d))
    return sets.select("post_id", F.array_join("categories", ",").alias("categories"),
                       F.array_join("tags", ",").alias("tags"))


def engagement_metrics(spark, d):
    posts = a.document_posts(spark, d).select("post_id")
    return tables.engagement_metrics(posts.join(a.event_engagement(spark, d), "post_id", "left"))


def hot_topics(spark, d):
    counters, posts, terms, _ = _tables(spark, d, NOW)
    cfg = TrendingConfig(hot_hours=24 * 14)
    heat = trend.hot_topics(counters, posts, terms, NOW, cfg)
    return heat.select("taxonomy", "term_id", "views", fixed(F.col("heat")).alias("heat"))


def category_momentum(spark, d):
    counters, posts, terms, _ = _tables(spark, d, NOW)
    cfg = TrendingConfig()
    cands = trend.candidates(counters, posts, cfg)
    heat = trend.hot_topics(counters, posts, terms, NOW, cfg)
    f = trend.term_features(cands, terms, heat, cfg)
    return f.select("post_id", F.array_join("categories", ",").alias("categories"),
                    F.array_join("tags", ",").alias("tags"), fixed(F.col("momentum")).alias("momentum"),
                    fixed(F.col("category_heat")).alias("category_heat"))


CANDIDATE_COLUMNS = ["post_id", "cand_rank", "day_rank", "week_rank", "month_rank", "total_rank"]


def candidates(spark, d):
    return trend.candidates(*_tables(spark, d, NOW)[:2]).select(*CANDIDATE_COLUMNS)


def rank_fusion(spark, d):
    """Just after the daily reset, when few posts have day views yet."""
    cands = trend.candidates(*_tables(spark, d, DAWN)[:2], TrendingConfig(min_count=60, limit=50))
    return cands.select(*CANDIDATE_COLUMNS, fixed(F.col("fusion_score")).alias("fusion_score"))


def candidates_by_segment(spark, d):
    counters = _part_counters(spark, d, ranges=("total", "day", "week", "month"))
    cands = trend.candidates(counters, a.part_posts(spark, d), TrendingConfig(limit=30), ["segment"])
    return cands.select("segment", *CANDIDATE_COLUMNS, fixed(F.col("fusion_score")).alias("fusion_score"))


def _week_hours() -> list[str]:
    return [f"2024-01-{day:02d} {hour:02d}:00:00" for day in range(24, 31) for hour in range(24)]


def counters_sweep(spark, d):
    """Live counters at every hour of a week, in one pass over the log."""
    return c.counters_at(a.event_views(spark, d), _week_hours())


def counters_sweep_archives(spark, d):
    """All ranges with a view, at instants just before and after resets and far apart."""
    return c.counters_at(a.event_views(spark, d), [BEFORE, NOW, DAWN, "2024-01-30 00:01:00", "2024-01-29 00:00:59"], c.RANGES)


def hourly_candidates(spark, d):
    """Candidate lists of every hour of a week in one job."""
    counters = c.counters_at(a.event_views(spark, d), _week_hours())
    cands = trend.candidates(counters, a.document_posts(spark, d), TrendingConfig(limit=30, min_count=25), run_cols=["as_of"])
    return cands.select("segment", *CANDIDATE_COLUMNS, fixed(F.col("fusion_score")).alias("fusion_score"))


def _parts(*names, make=_scored):
    def query(spark, d):
        return make(spark, d).select("post_id", *[fixed(F.col(n)).alias(n) for n in names])
    return query


def dawn_fallback(spark, d):
    """Estimated day views of posts that have none yet."""
    cfg = TrendingConfig(min_count=60)
    rows = _scored(spark, d, DAWN, cfg)
    return rows.select("post_id", "day", "week", "month", "day_used", fixed(F.col("velocity")).alias("velocity"),
                       fixed(F.col("engagement")).alias("engagement"))


def fatigue(spark, d):
    rows = _second(spark, d)
    return rows.select("post_id", "pre_rank", "streak", fixed(F.col("fatigue")).alias("fatigue"), "score_rank")


def fatigue_history(spark, d):
    """Streaks over the hourly runs of every day of the log; a run ranks posts by their
    views of the day so far, from one minute past midnight, at 01:00 to 23:00."""
    v = a.event_views(spark, d).filter("hour(ts) * 60 + minute(ts) >= 1 AND hour(ts) < 23")
    hourly = v.groupBy(F.to_date("ts").alias("site_day"), "post_id", (F.hour("ts") + 1).alias("h")).agg(F.count("*").alias("n"))
    # From a post's first hour of a day on, one row for each later run of that day.
    own = W.partitionBy("site_day", "post_id").orderBy("h")
    so_far = hourly.withColumns({"views": F.sum("n").over(own), "until": F.coalesce(F.lead("h").over(own), F.lit(24)) - 1})
    seen = so_far.withColumn("h", F.explode(F.sequence("h", "until"))).withColumn(
        "run_at", F.timestamp_seconds(F.unix_seconds(F.col("site_day").cast("timestamp")) + F.col("h") * 3600))
    best = W.partitionBy("run_at").orderBy(F.desc("views"), F.desc("post_id"))
    # The rank limit is applied in each task before the shuffle: 20 rows per run and task.
    top = seen.withColumn("r", F.row_number().over(best)).filter("r <= 20").select("run_at", "post_id", F.lit(True).alias("in_top"))
    history = seen.join(top, ["run_at", "post_id"], "left").select(
        F.lit("").alias("segment"), "post_id", "run_at", F.coalesce("in_top", F.lit(False)).alias("in_top"))
    out = trend.streaks(history)
    return out.select("post_id", "run_at", "in_top", "streak", fixed(F.col("fatigue")).alias("fatigue"))


def similarity(spark, d):
    """Overlap of every post's terms with those of its author's most viewed post."""
    counters = _event_counters(spark, d, ranges=("total",))
    posts = a.document_posts(spark, d).select("post_id", "author_id")
    rows = posts.join(counters, "post_id").filter("total IS NOT NULL").join(tables.term_sets(a.document_terms(spark, d)), "post_id")
    rows = rows.withColumn("terms", F.array_union("categories", "tags"))
    lead = rows.groupBy("author_id").agg(F.max_by("terms", F.struct("total", "post_id")).alias("lead"))
    rows = rows.join(lead, "author_id")
    return rows.select("post_id", "author_id", fixed(F.expr(fx.jaccard("terms", "lead"))).alias("similarity"))


def mmr(spark, d):
    return _run(spark, d).filter("mmr_position IS NOT NULL").select("post_id", "mmr_position")


EXPLORING = TrendingConfig(explore_draw=0.0, explore_pos=7)


def explore(spark, d):
    return _run(spark, d, EXPLORING).filter("explore_position IS NOT NULL").select("post_id", "explore_position")


def diversity(spark, d):
    return _run(spark, d, EXPLORING).filter("position IS NOT NULL").select("post_id", "position")


NO_EXPLORE = TrendingConfig(explore_draw=1.0)


def trending_full(spark, d):
    rows = trending.trending_rows(_run(spark, d, NO_EXPLORE), NOW).filter("position IS NOT NULL")
    return rows.select(
        "position", "post_id", fixed(F.col("score"), 3).alias("score"), "views_day", "views_week", "views_month",
        "views_total", "views_day_used", "used_day_fallback", "author_id",
        F.array_join("categories", ",").alias("categories"), F.array_join("tags", ",").alias("tags"))


def trending_debug(spark, d):
    rows = trending.trending_rows(_run(spark, d, NO_EXPLORE), NOW).filter("score_rank <= 50")
    return rows.select("post_id", "score_rank", "age_hours", "components.*")


def trending_by_segment(spark, d):
    """Many independent lists at once: one per part type, with group folds in parallel."""
    counters = _part_counters(spark, d, ranges=("total", "day", "week", "month"))
    posts = a.part_posts(spark, d)
    words = posts.select("post_id", F.explode(F.split("title", " ")).alias("slug"))
    terms = words.select("post_id", F.lit("post_tag").alias("taxonomy"),
                         F.xxhash64("slug").alias("term_id"), "slug", F.col("slug").alias("name"))
    run = trending.trending_run(counters, posts, terms, None, a.PARTS_AS_OF, NO_EXPLORE, segment_cols=["segment"])
    return run.filter("position IS NOT NULL").select("segment", "position", "post_id", fixed(F.col("score"), 3).alias("score"))


def trend_state(spark, d):
    before, run = _two_runs(spark, d)
    state = trend.next_state(run, before, NOW)
    return state.select("post_id", fixed(F.col("ewma")).alias("ewma"), "ewma_at",
                        fixed(F.col("last_score")).alias("last_score"), "streak")


def _stored_list(spark, d):
    return trending.trending_rows(_run(spark, d, NO_EXPLORE), NOW).filter("position IS NOT NULL")


def trending_refreshed(spark, d):
    """Two scheduled runs, the second from the state that the first one stored, as written."""
    path, views = f"{shared_dir(spark)}/viewtide-trending-{uuid.uuid4().hex}", a.event_views(spark, d)
    counters = cut(c.counters_at(views, [BEFORE, NOW]))
    learned, posts, terms = cut(_learned(spark, d)), a.document_posts(spark, d), a.document_terms(spark, d)
    for as_of, previous in ((BEFORE, None), (NOW, BEFORE)):
        trending.refresh_trending(spark, path, as_of, counters.filter(F.col("as_of") == instant(as_of)).drop("as_of"), posts, terms,
                                  a.event_engagement(spark, d, as_of), NO_EXPLORE, shape.factors(learned, as_of), previous)
    rows = tables.read_version(spark, f"{path}/trending_debug", NOW)
    return rows.select("post_id", "score_rank", "age_hours", "components.*")


def top_trending(spark, d):
    rows = trending.top_trending(_stored_list(spark, d), _event_counters(spark, d, ranges=("total",)),
                                 a.document_posts(spark, d), number=8, page=2, post_types=("post",),
                                 post_terms=a.document_terms(spark, d))
    return rows.select("rank", "id", "title", "views", "trending_position",
                       fixed(F.col("trending_score"), 3).alias("trending_score"), "trending_views", "category")


def trending_overlay(spark, d):
    rows = rank.top_posts(_event_counters(spark, d, ranges=("day",)), a.document_posts(spark, d), "day", number=20,
                          post_terms=a.document_terms(spark, d), trending=_stored_list(spark, d))
    return rows.select("rank", "id", "views", "trending", "trending_position", "trending_views")


# --- streaming ------------------------------------------------------------------------

def _paths(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/viewtide-stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    ddl = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(ddl).option("pathGlobFilter", "events.parquet").parquet(d)


def _finish(spark, df, keys, mode="update"):
    out, checkpoint = _paths(spark)
    live.write_stream(df, out, checkpoint, mode).awaitTermination()
    return live.read_latest(spark, out, keys) if keys else spark.read.parquet(out).drop("batch_id")


def stream_counters(spark, d):
    """Day counters kept by a stream, and the week and month counters read off them."""
    views = a.event_rows(_event_stream(spark, d)).select("post_id", "ts")
    days = _finish(spark, live.live_counters(views, "day"), ["range", "period", "post_id"])
    return days.unionByName(live.from_days(days, "week")).unionByName(live.from_days(days, "month"))


def stream_weeks(spark, d):
    """Week counters kept by their own stream."""
    views = a.event_rows(_event_stream(spark, d)).select("post_id", "ts")
    return _finish(spark, live.live_counters(views, "week"), ["range", "period", "post_id"])


def stream_months(spark, d):
    views = a.event_rows(_event_stream(spark, d)).select("post_id", "ts")
    return _finish(spark, live.live_months(views), ["range", "period", "post_id"])


def stream_totals(spark, d):
    return _finish(spark, live.live_totals(a.event_rows(_event_stream(spark, d)).select("post_id")), ["post_id"])


def stream_hours(spark, d):
    return _finish(spark, live.live_hours(a.event_rows(_event_stream(spark, d)).select("ts")), ["hour_start"])


def stream_bins(spark, d):
    """Hour bins of a stream; equal to those of the log."""
    hours = _finish(spark, live.live_hours(a.event_rows(_event_stream(spark, d)).select("ts"), cfg=SHAPE), ["hour_start"])
    return live.bins_of_hours(hours).select("site_day", "total", F.posexplode("hour_bins").alias("hour", "views")) \
        .withColumn("hour", F.col("hour").cast("bigint"))


def pruned_counters(spark, d):
    """Day and yesterday counters read from a written log, of which only two days are opened."""
    path = f"{shared_dir(spark)}/viewtide-log-{uuid.uuid4().hex}"
    tables.write_views(a.event_views(spark, d).select("event_id", "post_id", "ts"), path)
    log = tables.read_views(spark, path, "2024-01-29 00:01:00")
    return c.counters_as_of(log, NOW, a.document_posts(spark, d), ranges=("day", "yesterday"))


def _stream_dedup(storage):
    def query(spark, d):
        views = a.event_rows(_event_stream(spark, d)).select("client_id", "session_id", "post_id", "ts")
        once = live.dedup_viewer_stream(views, CountingConfig(storage=storage))
        keys = ["client_id", "post_id"] if storage == "local" else ["session_id", "post_id"]
        return _finish(spark, once, None, "append").select(*keys)
    return query


def stream_ip(spark, d):
    views = a.event_rows(_event_stream(spark, d)).select(
        "event_id", "post_id", "ts", ip_hash(F.col("client_id")).alias("ip_hash"))
    return _finish(spark, live.dedup_ip_stream(views), None, "append").select("event_id", "post_id", "ip_duplicate")


def _arrivals(spark, d, columns: list[str], late_rows: bool = False) -> DataFrame:
    """The event views as four parts in time order, read one per micro-batch; with
    ``late_rows`` every fiftieth row comes up to four hours behind, and a last file with a
    row a year on closes the stream. Each part is as many files as the greatest one needs."""
    path, views = f"{shared_dir(spark)}/viewtide-arrivals-{uuid.uuid4().hex}", a.event_views(spark, d)
    seen = F.unix_micros("ts") + F.when(F.lit(late_rows) & (F.col("event_id") % 50 == 7), 4 * 3_600_000_000).otherwise(0)
    cuts = [F.expr(f"unix_micros(TIMESTAMP '2024-01-{day}')") for day in ("08", "16", "24")]
    part = sum((F.when(seen >= c_, 1).otherwise(0) for c_ in cuts), F.lit(0))
    rows = views.select(*columns, part.alias("__part"))
    rows.write.partitionBy("__part").parquet(f"{path}-parts")
    parts = spark.read.schema(rows.schema).parquet(f"{path}-parts")
    most = parts.groupBy("__part").count().agg(F.max("count")).first()[0] or 0
    files = 1 + most // FILE_ROWS
    for k in range(4):
        some = parts.filter(F.col("__part") == k).drop("__part")
        (some.repartition(files) if files > 1 else some.coalesce(1)).write.mode("append").parquet(path)
        # Partitions without rows leave no file; empty ones keep the parts apart.
        written = len(spark.read.schema(some.schema).parquet(path).inputFiles())
        for _ in range(files * (k + 1) - written):
            some.limit(0).coalesce(1).write.mode("append").parquet(path)
    tables.remove(spark, f"{path}-parts")
    if late_rows:
        end = spark.range(1).select(*[F.expr("TIMESTAMP '2025-01-30 00:00:00'").alias(c_) if c_ == "ts" else
                                      F.lit(None).cast(rows.schema[c_].dataType).alias(c_) for c_ in columns])
        end.withColumn("post_id", F.lit(-1).cast("bigint")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("__part").schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_ip_in_order(spark, d):
    """The recent-address check in event order over several micro-batches, some rows late."""
    before = {k: spark.conf.get(k) for k in STREAM_DEFAULTS}
    views = _arrivals(spark, d, ["event_id", "post_id", "ts", "client_id"], late_rows=True)
    tagged = live.dedup_ip_in_order(views.withColumn("ip_hash", ip_hash(F.col("client_id"))).drop("client_id"), "6 hours")
    try:
        for k, v in STREAM_DEFAULTS.items():
            spark.conf.set(k, v)
        rows = _finish(spark, tagged, None, "append")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return rows.filter("post_id <> -1").select("event_id", "post_id", "ip_duplicate")


def stream_snapshot(spark, d):
    """Totals kept as a keyed snapshot that four micro-batches were merged into."""
    out, checkpoint = _paths(spark)
    totals = live.live_totals(_arrivals(spark, d, ["post_id"]))
    live.write_snapshot(totals, out, checkpoint, ["post_id"], buckets=4).awaitTermination()
    return live.read_snapshot(spark, out, "post_id bigint, views bigint")


def stream_viewer_index(spark, d):
    """First views by client over four micro-batches, held against a stored index of keys."""
    out, checkpoint = _paths(spark)
    views = _arrivals(spark, d, ["event_id", "client_id", "session_id", "post_id", "ts"])
    firstviews.dedup_viewer_indexed(views, f"{out}-index", out, checkpoint, buckets=4).awaitTermination()
    return spark.read.parquet(out).select("event_id", "client_id", "session_id", "post_id")


def stream_ingest(spark, d):
    cfg = CountingConfig(batch=2)
    requests = a.event_requests(_event_stream(spark, d))
    rows = live.ingest_stream(requests, a.document_posts(spark, d), cfg)
    return _finish(spark, rows.select("event_id", F.col("slot").cast("bigint").alias("slot"), "post_id", "ip_hash"),
                   None, "append")


def stream_ingest_strict(spark, d):
    """The address check and the site's own rule on a stream: the views that the batch job counts."""
    cfg = CountingConfig(batch=2, post_types=("post", "page"), strict_ip=True)
    rows = live.ingest_stream(a.event_requests(_event_stream(spark, d)), a.document_posts(spark, d), cfg, _site_rule())
    return _finish(spark, rows.select("event_id", F.col("slot").cast("bigint").alias("slot"), "post_id"), None, "append")


QUERIES = {
    "client_ip": client_address,
    "request_views": requested_ids,
    "eligibility": eligible,
    "count_requests": counted_requests,
    "qualified_views": qualified,
    "viewer_dedup": _dedup("session"),
    "viewer_dedup_client": _dedup("local"),
    "batch_flush": _flush("local"),
    "batch_flush_session": _flush("session"),
    "strict_ip_dedup": strict_ip,
    "counters_all_ranges": _part_counters,
    "counters_events": _event_counters,
    "counters_long": counters_long,
    "counters_wide": counters_wide,
    "counters_applied": applied,
    "running_counts": running,
    "rollover_snapshot": rolled,
    "rollover_summary": rolled_summary,
    "top_total": _top("total"),
    "top_day": _top("day"),
    "top_week": _top("week"),
    "top_month": _top("month"),
    "top_yesterday": _top("yesterday", number=20, page=2),
    "top_last_week": _top("last_week"),
    "top_last_month": _top("last_month", _part_counters, a.part_posts),
    "top_excerpts": top_excerpts,
    "top_by_terms": top_by_terms,
    "top_by_segment": top_by_segment,
    "view_list": view_list,
    "view_list_by_date": view_list_by_date,
    "view_list_by_title": view_list_by_title,
    "ranking_tabs": ranking_tabs,
    "post_count": post_count,
    "format_counts": format_counts,
    "hour_bins": hour_bins,
    "merged_bins": merged_bins,
    "hour_shape": _shape("hour"),
    "wday_shape": _shape("wday"),
    "shape_resumed": shape_resumed,
    "shape_skipping": shape_skipping,
    "shape_factors": shape_factors,
    "term_sets": term_sets,
    "engagement_metrics": engagement_metrics,
    "hot_topics": hot_topics,
    "category_momentum": category_momentum,
    "candidates": candidates,
    "rank_fusion": rank_fusion,
    "candidates_by_segment": candidates_by_segment,
    "counters_sweep": counters_sweep,
    "counters_sweep_archives": counters_sweep_archives,
    "hourly_candidates": hourly_candidates,
    "velocity": _parts("velocity", "time_decay", "engagement", "freshness", "age"),
    "day_fallback": dawn_fallback,
    "uplift": _parts("expected", "uplift_raw", "uplift"),
    "ewma": _parts("ewma_val", "acc", "ewma", make=_second),
    "anti_gaming": _parts("penalty"),
    "trend_score": _parts("raw_score", "capped", make=_second),
    "fatigue": fatigue,
    "fatigue_history": fatigue_history,
    "similarity": similarity,
    "mmr": mmr,
    "explore": explore,
    "diversity": diversity,
    "trending_full": trending_full,
    "trending_debug": trending_debug,
    "trending_by_segment": trending_by_segment,
    "trend_state": trend_state,
    "top_trending": top_trending,
    "trending_overlay": trending_overlay,
    "stream_counters": stream_counters,
    "stream_weeks": stream_weeks,
    "stream_months": stream_months,
    "stream_totals": stream_totals,
    "stream_hours": stream_hours,
    "stream_viewer_dedup": _stream_dedup("session"),
    "stream_viewer_dedup_client": _stream_dedup("local"),
    "stream_ip_dedup": stream_ip,
    "stream_ip_in_order": stream_ip_in_order,
    "stream_snapshot": stream_snapshot,
    "stream_viewer_index": stream_viewer_index,
    "stream_ingest": stream_ingest,
    "stream_ingest_strict": stream_ingest_strict,
    "stream_bins": stream_bins,
    "pruned_counters": pruned_counters,
    "counters_advanced": advanced,
    "counters_partials": counters_partials,
    "daily_late": late_counters,
    "daily_late_shape": late_shape,
    "request_feed": request_feed,
    "counters_renamed": counters_renamed,
    "rollover_forced": rollover_forced,
    "trending_refreshed": trending_refreshed,
    "daily_chain": daily_chain,
    "daily_chain_shape": daily_chain_shape,
}
