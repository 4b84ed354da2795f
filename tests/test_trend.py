import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.util import counters_df, dicts, posts_df, terms_df
from viewtide.config import TrendingConfig
from viewtide.operators import rerank as rr
from viewtide.operators import trend
from viewtide.plans import trending
from viewtide.sources.tables import read_version

NOW = "2024-01-30 12:00:00"


def simple_posts(spark, n, **extra):
    return posts_df(spark, [{"post_id": p, **{k: f(p) for k, f in extra.items()}} for p in range(1, n + 1)])


# --- candidates ------------------------------------------------------------------------

def fuse_model(counters, limit, min_count):
    lists = [[p for p, *_ in sorted(((p, v[i]) for p, v in counters.items() if v[i] is not None), key=lambda x: (-x[1], -x[0]))][:limit]
             for i in range(4)]  # day, week, month, total
    if len(lists[0]) >= min_count:
        return lists[0]
    cands = []
    for lst in lists:
        cands += [p for p in lst if p not in cands]
    cands, rest = cands[:limit], cands[limit:]
    rank = [{p: i for i, p in enumerate(lst)} for lst in lists]
    score = {p: sum(w * (1 - r[p] / max(1, limit)) for w, r in zip((1.0, 0.6, 0.3, 0.15), rank) if p in r) + 0.02 * (p in rank[0])
             for p in cands}
    cands.sort(key=lambda p: (-score[p], rank[0].get(p, 1e9), rank[1].get(p, 1e9), -p))
    return cands + rest[: max(0, min_count - len(cands))]


@pytest.mark.parametrize("limit,min_count", [(100, 20), (10, 5), (6, 9), (100, 1), (8, 30)])
def test_candidates_equal_model(spark, limit, min_count):
    rnd = random.Random(limit * 31 + min_count)
    counters = {}
    for p in range(1, 41):
        total = rnd.randrange(1, 30)
        month = rnd.randrange(1, total + 1) if rnd.random() < .8 else None
        week = rnd.randrange(1, month + 1) if month and rnd.random() < .6 else None
        day = rnd.randrange(1, week + 1) if week and rnd.random() < .3 else None
        counters[p] = (day, week, month, total)
    df = counters_df(spark, [(p, t, d, w, m) for p, (d, w, m, t) in counters.items()])
    got = trend.candidates(df, simple_posts(spark, 40), TrendingConfig(limit=limit, min_count=min_count))
    assert [r["post_id"] for r in dicts(got, "cand_rank")] == fuse_model(counters, limit, min_count)


def test_prefixes_go_deeper_past_posts_that_may_not_be_listed(spark):
    """The first 300 posts of the lists are drafts: the prefixes grow until the lists are full,
    and one list with few counters ends where they do."""
    posts = posts_df(spark, [{"post_id": i, "status": "draft" if i > 100 else "publish"} for i in range(1, 401)])
    counters = counters_df(spark, [(i, i, i if i % 50 == 0 else None, i // 7, None) for i in range(1, 401)])
    cfg = TrendingConfig(limit=10, min_count=5)
    single = trend.candidates(counters, posts, cfg)
    runs = trend.candidates(counters.withColumn("run", F.lit("a")).unionByName(counters.withColumn("run", F.lit("b"))),
                            posts, cfg, run_cols=["run"])
    want = {tuple(r) for r in single.drop("segment").collect()}
    assert len(want) == 10 and {r[0] for r in want} >= {50, 100}
    for name in "ab":
        assert {tuple(r) for r in runs.filter(F.col("segment") == name).drop("segment").collect()} == want


def test_no_candidates_of_empty_tables(spark):
    posts, counters = posts_df(spark, [{"post_id": 1}]), counters_df(spark, [(1, 5, 5, 5, 5)])
    assert trend.candidates(counters.limit(0), posts).count() == 0
    assert trend.candidates(counters, posts.limit(0)).count() == 0


def test_fusion_value_and_group_limit(spark):
    df = counters_df(spark, [(1, 1, 9, 1, None), (2, 9, None, 9, None), (3, 8, None, 8, None), (4, 7), (5, 6), (6, 5)])
    got = trend.candidates(df, simple_posts(spark, 6), TrendingConfig(min_count=20))
    row = dicts(got.filter("post_id = 1"))[0]
    assert (row["day_rank"], row["week_rank"], row["total_rank"]) == (0, 2, 5)
    assert row["fusion_score"] == pytest.approx(1.7505)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_types_status_and_switch(spark):
    posts = posts_df(spark, [{"post_id": 1}, {"post_id": 2, "post_type": "page"}, {"post_id": 3, "status": "draft"},
                             {"post_id": 4, "post_type": "attachment"}])
    counters = counters_df(spark, [(p, 1, 1, 1, 1) for p in range(1, 5)])
    ids = lambda cfg: sorted(r["post_id"] for r in dicts(trend.candidates(counters, posts, cfg)))
    assert ids(TrendingConfig()) == [1]
    assert ids(TrendingConfig(post_types=("post", "page", "attachment"))) == [1, 2]
    assert ids(TrendingConfig(post_types=("attachment",))) == [1]
    run = trending.trending_run(counters, posts, terms_df(spark, [(1, "category", 1, "a", "A")]), None, NOW, TrendingConfig(enabled=False))
    assert run.count() == 0


# --- hot topics ------------------------------------------------------------------------

def test_hot_topics(spark):
    fresh, old = datetime(2024, 1, 30), datetime(2024, 1, 29, 11)
    posts = posts_df(spark, [{"post_id": 1, "published_at": fresh}, {"post_id": 2, "published_at": fresh, "post_type": "page"},
                             {"post_id": 3, "published_at": old}, {"post_id": 4, "published_at": fresh, "status": "draft"},
                             {"post_id": 5, "published_at": fresh}])
    counters = counters_df(spark, [(1, 9, 6), (2, 9, 2), (3, 9, 50), (4, 9, 50), (5, 9, 0)])
    terms = terms_df(spark, [(1, "category", 1, "", ""), (1, "category", 1, "", ""), (1, "post_tag", 9, "", ""), (2, "category", 1, "", ""),
                             (2, "category", 2, "", ""), (3, "category", 3, "", ""), (1, "series", 4, "", ""), (4, "category", 4, "", "")])
    got = {(r["taxonomy"], r["term_id"]): (r["views"], r["heat"]) for r in dicts(trend.hot_topics(counters, posts, terms, NOW))}
    assert got == {("category", 1): (8, 1.0), ("category", 2): (2, 0.25), ("post_tag", 9): (6, 1.0)}
    capped = trend.hot_topics(counters, posts, terms, NOW, TrendingConfig(hot_posts=1))
    assert {(r["taxonomy"], r["term_id"]) for r in dicts(capped)} == {("category", 1), ("post_tag", 9)}


def test_momentum_product_and_cap(spark):
    cands = spark.createDataFrame([("", 1), ("", 2), ("", 3)], "segment string, post_id bigint")
    terms = terms_df(spark, [(1, "category", 1, "", ""), (1, "post_tag", 9, "", ""), (3, "category", 7, "", "")]
                     + [(2, "category", i, "", "") for i in range(1, 7)])
    heat = spark.createDataFrame([("", "category", i, 1.0) for i in range(1, 7)] + [("", "post_tag", 9, 0.5)],
                                 "segment string, taxonomy string, term_id bigint, heat double")
    rows = {r["post_id"]: r for r in dicts(trend.term_features(cands, terms, heat, TrendingConfig()))}
    assert rows[1]["momentum"] == pytest.approx(1.1 * 1.025) and rows[1]["category_heat"] == 1.0
    assert rows[2]["momentum"] == 1.5 and rows[2]["categories"] == [1, 2, 3, 4, 5, 6]
    assert (rows[3]["momentum"], rows[3]["category_heat"]) == (1.0, 0.0)


# --- state -----------------------------------------------------------------------------

def state_df(spark, rows):
    ddl = "segment string, post_id bigint, ewma double, ewma_at string, last_score double, score_at string, streak int, streak_at string"
    return spark.createDataFrame(rows, ddl).selectExpr(
        "segment", "post_id", "ewma", "CAST(ewma_at AS TIMESTAMP) AS ewma_at", "last_score",
        "CAST(score_at AS TIMESTAMP) AS score_at", "streak", "CAST(streak_at AS TIMESTAMP) AS streak_at")


def test_state_lifetimes(spark):
    posts = simple_posts(spark, 3, published_at=lambda p: datetime(2024, 1, 30))
    counters = counters_df(spark, [(p, 60, 60, 60, 60) for p in (1, 2, 3)])
    terms = terms_df(spark, [(1, "category", 1, "", "")])
    state = state_df(spark, [
        ("", 1, 1.0, "2024-01-30 00:00:00", 0.5, "2024-01-30 06:00:00", 9, "2024-01-30 04:00:00"),   # all exactly at their limit
        ("", 2, 1.0, "2024-01-29 23:59:59", 0.5, "2024-01-30 05:59:59", 9, "2024-01-30 03:59:59"),   # all just expired
        ("", 7, 2.0, "2024-01-30 11:00:00", None, None, None, None)])                                # not scored now: kept
    run = trending.score_run(counters, posts, terms, None, NOW, TrendingConfig(), state=state)
    rows = {r["post_id"]: r for r in dicts(run)}
    assert rows[1]["prev_ewma"] == 1.0 and rows[1]["capped"] == pytest.approx(10.9) and rows[1]["streak"] == 10
    assert rows[2]["prev_ewma"] is None and rows[2]["capped"] > 11 and rows[2]["streak"] == 1
    assert rows[1]["fatigue"] == pytest.approx(0.88)
    assert rows[1]["score"] == pytest.approx(10.9 * 0.88)
    after = {r["post_id"]: r for r in dicts(trend.next_state(run, state, NOW))}
    assert set(after) == {1, 2, 3, 7} and after[7]["ewma"] == 2.0
    assert after[1]["streak"] == 10 and after[1]["ewma_at"] == datetime(2024, 1, 30, 12)


def test_streaks_break(spark):
    def row(h, top):
        return ("", 1, datetime(2024, 1, 1) + timedelta(hours=h), top)
    hist = [row(0, True), row(1, True), row(2, False), row(3, True), row(4, True), row(12, True), row(21, True)]
    df = spark.createDataFrame(hist, "segment string, post_id bigint, run_at timestamp_ntz, in_top boolean") \
        .withColumn("run_at", F.col("run_at").cast("timestamp"))
    assert [r["streak"] for r in dicts(trend.streaks(df), "run_at")] == [1, 2, 0, 1, 2, 3, 1]


# --- re-ranking ------------------------------------------------------------------------

def brute_mmr(scores, terms, lam, size):
    left, out = list(range(len(scores))), []
    while left and len(out) < size:
        def value(i):
            sims = [len(terms[i] & terms[j]) / len(terms[i] | terms[j]) if terms[i] | terms[j] else 0.0 for j in out]
            return lam * scores[i] - (1 - lam) * max(sims, default=0.0) * scores[i]
        best = max(left, key=lambda i: (value(i), -i))
        out.append(best)
        left.remove(best)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_mmr_equals_brute_force(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 40)
    scores = sorted((rnd.choice([1.0, 2.0, rnd.random() * 10]) for _ in range(n)), reverse=True)
    terms = [frozenset(rnd.sample(range(6), rnd.randrange(0, 4))) for _ in range(n)]
    assert rr.mmr(scores, terms, 0.75, 20) == brute_mmr(scores, terms, 0.75, 20)


@pytest.mark.parametrize("seed", range(20))
def test_diversity_is_a_stable_partition(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 21)
    authors = [rnd.randrange(rnd.choice([3, 15])) for _ in range(n)]
    cats = [rnd.sample(range(9), rnd.randrange(0, 3)) for _ in range(n)]
    order = list(range(n))
    rnd.shuffle(order)
    out = rr.diversify(order, authors, cats, TrendingConfig())
    assert sorted(out) == sorted(order)
    per_author = 2 if len(set(authors)) * 2 >= 20 else 20
    per_cat = 3 if len({c for x in cats for c in x}) * 3 >= 20 else 20
    used_a, used_c, within, over = {}, {}, [], []
    for i in order:
        if used_a.get(authors[i], 0) < per_author and all(used_c.get(c, 0) < per_cat for c in cats[i]):
            within.append(i)
            used_a[authors[i]] = used_a.get(authors[i], 0) + 1
            for c in cats[i]:
                used_c[c] = used_c.get(c, 0) + 1
        else:
            over.append(i)
    assert out == within + over


def test_explore():
    cfg = TrendingConfig()
    order, promise = list(range(20)), [0.0] * 30
    promise[25], promise[3] = 2.0, 1.0
    assert rr.explore(order, promise, cfg, 0.06, 7) == order
    got = rr.explore(order, promise, cfg, 0.05, 7)
    assert got == [*range(7), 25, *range(7, 19)]
    assert rr.explore([0, 1], promise, cfg, 0.0, 7) == [0, 1, 25, 3]
    assert rr.explore(order, promise, TrendingConfig(weights={"explore": 0.0}), 0.001, 7) == order
    assert TrendingConfig(weights={"explore": 9.0}).epsilon == 0.25


def test_explore_draw_is_repeatable(spark):
    rows = [(f"s{s}", p, p, 10.0 - p, [p], [], p, 1.0, 1.0 + p) for s in range(60) for p in range(1, 9)]
    df = spark.createDataFrame(rows, "segment string, post_id bigint, score_rank int, score double, categories array<bigint>, "
                                     "tags array<bigint>, author_id bigint, uplift double, ewma double")
    draws = lambda seed: {r.segment: (r.explore_draw, r.explore_place) for r in rr.rerank(df, NOW, TrendingConfig(seed=seed)).collect()}
    one = draws(1)
    assert one == draws(1) != draws(2)
    assert all(0 <= d <= 1 and 5 <= p <= 10 for d, p in one.values()) and len({p for _, p in one.values()}) > 2


# --- whole job -------------------------------------------------------------------------

def site_data(spark, n=60):
    rnd = random.Random(4)
    posts = simple_posts(spark, n, site=lambda p: "ab"[p % 2], author_id=lambda p: p % 7,
                         published_at=lambda p: datetime(2024, 1, 30, 12) - timedelta(hours=p))
    counters = counters_df(spark, [(p, 900 + p, rnd.randrange(1, 90), 100 + p, 400 + p) for p in range(1, n + 1)])
    terms = terms_df(spark, [(p, "category", p % 9, "", "") for p in range(1, n + 1)] + [(p, "post_tag", 100 + p % 4, "", "") for p in range(1, n + 1)])
    return counters, posts, terms


def test_segments_equal_separate_runs(spark):
    counters, posts, terms = site_data(spark)
    cfg = TrendingConfig(min_count=5, explore_draw=1.0)
    both = trending.trending_run(counters, posts, terms, None, NOW, cfg, segment_cols=["site"]).filter("position IS NOT NULL")
    got = {(r["segment"], r["position"]): (r["post_id"], r["score"]) for r in dicts(both)}
    want = {}
    for site in "ab":
        mine = posts.filter(F.col("site") == site)
        run = trending.trending_run(counters.join(mine, "post_id", "left_semi"), mine, terms, None, NOW, cfg).filter("position IS NOT NULL")
        want |= {(site, r["position"]): (r["post_id"], r["score"]) for r in dicts(run)}
    assert got == want and len(got) == 40


def test_weights_and_shape_change_scores(spark):
    counters, posts, terms = site_data(spark, 30)
    base = {r["post_id"]: r for r in dicts(trending.score_run(counters, posts, terms, None, NOW))}
    cfg = TrendingConfig(weights={**TrendingConfig().weights, "uplift": 0.0, "ewma": 2.0})
    other = {r["post_id"]: r for r in dicts(trending.score_run(counters, posts, terms, None, NOW, cfg))}
    r, o = base[3], other[3]
    assert o["raw_score"] == pytest.approx(r["raw_score"] / r["uplift"] * r["ewma"])
    shape = spark.createDataFrame([(2.0, 1.5)], "hour_factor double, wday_factor double")
    shaped = {x["post_id"]: x for x in dicts(trending.score_run(counters, posts, terms, None, NOW, shape=shape))}
    assert shaped[3]["expected"] == pytest.approx(3 * r["expected"])
    metrics = spark.createDataFrame([(3, 100, 0, None)], "post_id bigint, comments bigint, likes bigint, shares bigint")
    liked = {x["post_id"]: x for x in dicts(trending.score_run(counters, posts, terms, metrics, NOW))}
    assert liked[3]["engagement"] == 2.0 and liked[4]["engagement"] == 1.0


def test_refresh_writes_versions_and_is_repeatable(spark, tmp_path):
    counters, posts, terms = site_data(spark)
    path, first, cfg = str(tmp_path), "2024-01-30 11:00:00", TrendingConfig(seed=3)

    def refresh(as_of, previous=None):
        return dicts(trending.refresh_trending(spark, path, as_of, counters, posts, terms, None, cfg, previous=previous), "position")

    refresh(first)
    a = refresh(NOW, first)
    assert [r["position"] for r in a] == list(range(1, 21)) and a == refresh(NOW, first)
    assert {r["components"]["fatigue_streak"] for r in a} <= {0, 1, 2} and any(r["components"]["fatigue_streak"] == 2 for r in a)
    debug = dicts(read_version(spark, f"{path}/trending_debug", NOW), "score_rank")
    assert [r["score_rank"] for r in debug] == list(range(1, 51))
    stored = read_version(spark, f"{path}/trending", NOW)
    page = dicts(trending.top_trending(stored, counters, posts, number=8, page=2, post_terms=terms), "rank")
    by_score = sorted(a, key=lambda r: (-r["score"], r["position"]))
    assert [r["id"] for r in page] == [r["post_id"] for r in by_score[8:16]]
    assert [r["trending_position"] for r in page] == list(range(9, 17))
    assert page[0]["views"] == 900 + page[0]["id"]


def test_page_is_cut_before_posts_are_filtered(spark):
    counters, posts, _ = site_data(spark, 6)
    posts = posts.withColumn("post_type", F.when(F.col("post_id") == 2, "page").otherwise("post"))
    stored = spark.createDataFrame([("", p, 10.0 - p, 1, p) for p in range(1, 5)],
                                   "segment string, post_id bigint, score double, views_day bigint, position int")
    marked = trending.top_trending(stored, counters, posts, number=2, item=lambda d: d.withColumn("mark", F.lit(1)))
    assert "mark" in marked.columns
    got = dicts(trending.top_trending(stored, counters, posts, number=2, post_types=("post",), fields="minimal"), "rank")
    assert [r["id"] for r in got] == [1]
