import random
from datetime import datetime, timedelta

import pytest

from tests.util import at, counters_df, dicts, posts_df, views_df
from viewtide.config import RANGES, CountingConfig
from viewtide.operators import counters as c
from viewtide.plans.daily import daily_reset


def table(df):
    return {r["post_id"]: tuple(r[x] for x in RANGES) for r in dicts(df)}


def test_absent_and_zero(spark):
    posts = posts_df(spark, [{"post_id": 1}, {"post_id": 2}, {"post_id": 3, "published_at": datetime(2024, 1, 16, 12)},
                             {"post_id": 4, "status": "draft"}])
    views = views_df(spark, [(1, 1, at(days=15, hours=5)), (2, 1, at(days=14)), (3, 1, at(days=14, minutes=1)), (4, 3, at(days=15, hours=13))])
    got = table(c.counters_as_of(views, "2024-01-16 23:00:00", posts))  # a Tuesday
    assert got[1] == (3, 1, 2, 3, 1, 1, 0)  # Monday 00:00 still counts to last week
    assert got[2] == (None, None, None, None, 0, 0, 0)
    assert got[3] == (1, 1, 1, 1, None, None, None)  # published after every rollover
    assert got[4] == (None,) * 7


def test_range_subset_limits_the_scan(spark, sf):
    from viewtide.sources import adapters as a
    df = c.counters_as_of(a.event_views(spark, sf), a.EVENTS_AS_OF, ranges=("day", "yesterday"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-29T00:01)" in plan and "LessThanOrEqual(ts,2024-01-30T23:00)" in plan
    assert df.columns == ["post_id", "day", "yesterday"]


@pytest.mark.parametrize("offset", [1, 30])
def test_many_instants_equal_single_runs(spark, offset):
    """Random views, some on the limits themselves, one post with a third of them, and rows
    without a post or a time."""
    rnd, cfg = random.Random(offset), CountingConfig(rollover_minutes=offset)
    edges = [at(days=d, minutes=m) + timedelta(microseconds=u) for d in (0, 14, 30, 31, 45) for m in (0, offset) for u in (-1, 0, 1)]
    rows = [(i, 1 if i % 3 == 0 else rnd.randrange(2, 9), rnd.choice(edges) if i % 4 == 0 else at(minutes=rnd.randrange(80_000)))
            for i in range(600)]
    views = views_df(spark, [*rows, (601, None, at(days=3)), (602, 5, None)])
    instants = ["2024-01-31 00:01:00", "2024-02-01 00:00:59.999999", "2024-02-01 00:30:00", "2024-01-02 12:00:00",
                "2024-03-04 00:01:00", "2024-02-15 10:00:00", "2024-02-15 10:00:00", "2023-12-31 00:00:00"]
    for ranges in (RANGES, ("day", "yesterday")):
        got = {(r["as_of"], r["post_id"], *[r[x] for x in ranges]) for r in dicts(c.counters_at(views, instants, ranges, cfg))}
        want = set()
        for t in set(instants):
            for r in dicts(c.counters_as_of(views.filter("post_id IS NOT NULL"), t, ranges=ranges, cfg=cfg)):
                if any(r[x] for x in ranges):
                    want.add((datetime.fromisoformat(t), r["post_id"], *[r[x] for x in ranges]))
        assert got == want and got


def test_many_instants_of_nothing(spark):
    views = views_df(spark, [(1, 1, at(days=1))])
    assert c.counters_at(views, []).collect() == []
    assert c.counters_at(views.limit(0), ["2024-01-05 00:00:00"]).collect() == []
    assert c.counters_at(views, ["2024-01-05 00:00:00"], ("day",)).collect() == []


def test_many_instants_read_the_log_once(spark, sf):
    from viewtide.sources import adapters as a
    hours = [f"2024-01-30 {h:02d}:00:00" for h in range(24)]
    plan = c.counters_at(a.event_views(spark, sf), hours, ("day",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "GreaterThanOrEqual(ts,2024-01-29T00:01)" in plan


def test_daily_fold_equals_log(spark):
    """Rolling stored counters over day by day gives the counters of the log at the end."""
    rnd = random.Random(3)
    posts = [{"post_id": p, "published_at": datetime(2024, 1, 20) + timedelta(days=3 * p)} for p in range(6)]
    posts.append({"post_id": 9, "status": "draft"})
    rows = []
    for i in range(400):
        p = rnd.randrange(6)
        ts = at(days=25, minutes=rnd.randrange(60 * 24 * 12))
        if ts >= posts[p]["published_at"]:
            rows.append((i, p, ts))
    dim, log = posts_df(spark, posts).cache(), views_df(spark, rows).cache()
    start = datetime(2024, 1, 26, 0, 1)
    state = c.counters_as_of(log.filter("ts < timestamp'2024-01-26 00:01'"), start, dim)
    for day in range(11):
        lo, hi = start + timedelta(days=day), start + timedelta(days=day + 1)
        state = c.apply_views(state, log.filter(f"ts >= timestamp'{lo}' AND ts < timestamp'{hi}'"))
        state = spark.createDataFrame(c.rollover(state, dim, hi).collect(), state.schema)
    assert table(state) == table(c.counters_as_of(log.filter("ts < timestamp'2024-02-06 00:01'"), "2024-02-06 00:01:00", dim))


def test_rollover_conditions(spark):
    posts = posts_df(spark, [{"post_id": 1}, {"post_id": 2, "status": "draft"}, {"post_id": 3, "post_type": "attachment"}])
    stored = counters_df(spark, [(1, 9, 2, 3, 4), (2, 9, 2, 3, 4), (3, 9, 2, 3, 4)])
    kept = (9, 2, 3, 4, None, None, None)
    tue = table(c.rollover(stored, posts, "2024-01-16 00:01:00"))
    assert tue == {1: (9, None, 3, 4, 2, None, None), 2: kept, 3: kept}
    first_monday = table(c.rollover(stored, posts, "2024-04-01 00:01:00"))
    assert first_monday[1] == (9, None, None, None, 2, 3, 4)
    forced = table(c.rollover(stored, posts, "2024-01-16 00:01:00", reset_week=True, reset_month=False))
    assert forced[1] == (9, None, None, 4, 2, 3, None)
    off = table(c.rollover(stored, posts, "2024-04-01 00:01:00", CountingConfig(enable_day=False)))
    assert off[1] == (9, 2, None, None, None, 3, 4)
    s = c.rollover_summary(posts, "2024-04-01 00:01:00", CountingConfig(enable_day=False)).first()
    assert s.asDict() == {"total_posts": 1, "reset_day": False, "reset_week": True, "reset_month": True, "affected_posts": 1}


def test_key_names(spark):
    stored = counters_df(spark, [(1, 9, 2), (2, 0)])
    long = c.to_long(stored, {"day": "my_day"})
    assert {(r.post_id, r.meta_key, r.meta_value) for r in long.collect()} == {
        (1, "total", 9), (1, "my_day", 2), (2, "total", 0)}
    assert table(c.to_wide(long, {"day": "my_day"})) == table(stored)


def test_daily_reset_runs_shape_first_and_hooks(spark):
    posts = posts_df(spark, [{"post_id": 1}])
    views = views_df(spark, [(i, 1, at(hours=3, seconds=i)) for i in range(240)])
    seen = []
    out = daily_reset(views, counters_df(spark, [(1, 240, 240, 240, 240)]), posts, "2024-01-02 00:01:00",
                      before=lambda df: seen.append("before") or df, after=lambda df: seen.append("after") or df,
                      trending=lambda rolled: rolled.filter("yesterday > 0"))
    assert table(out.counters)[1] == (240, None, 240, 240, 240, None, None)
    assert out.shape.first().days_learned == 1 and out.shape.first().hour[3] > 2
    assert out.summary.first().affected_posts == 1 and out.trending.count() == 1 and seen == ["before", "after"]


def test_advance_equals_a_full_count(spark):
    """Stored counters plus any batch: across days, a Monday, a month's end, and with late views."""
    rnd = random.Random(12)
    posts = posts_df(spark, [{"post_id": 1}, {"post_id": 2, "status": "draft"}, {"post_id": 3, "published_at": datetime(2024, 1, 29, 12)},
                             {"post_id": 4, "post_type": "attachment"}, {"post_id": 5}])
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, 4, 99]), at(minutes=rnd.randrange(70 * 1440))) for i in range(900)]
    rows += [(2000 + k, 1, t) for k, t in enumerate([at(days=31), at(days=31, minutes=1), at(days=30, minutes=1), at(days=28)])]
    views = views_df(spark, rows).cache()
    late = "event_id % 7 = 0"
    for since, as_of in (("2024-01-30 12:00:00", "2024-01-30 13:00:00"), ("2024-01-28 23:50:00", "2024-01-29 00:01:00"),
                         ("2024-01-31 23:00:00", "2024-02-01 00:00:59"), ("2024-01-31 23:00:00", "2024-02-01 00:01:00"),
                         ("2024-01-03 09:00:00", "2024-03-02 00:01:00"), ("2024-01-29 00:01:00", "2024-02-05 08:00:00")):
        held = f"ts <= TIMESTAMP '{since}' AND NOT {late}"
        for dim in (posts, None):
            old = c.counters_as_of(views.filter(held), since, dim)
            got = c.advance(old, views.filter(f"NOT ({held})"), since, as_of, dim)
            want = {k: v for k, v in table(c.counters_as_of(views, as_of, dim)).items()}
            assert table(got) == want, (since, as_of)
    some = c.advance(c.counters_as_of(views, "2024-01-30 12:00:00", ranges=("total", "day")), views.limit(0),
                     "2024-01-30 12:00:00", "2024-01-31 12:00:00")
    assert some.columns == ["post_id", "total", "day"] and some.filter("day IS NOT NULL").count() == 0


def test_daily_runs_resume_after_a_failure_and_a_gap(spark, tmp_path):
    import pytest

    from viewtide.config import ShapeConfig
    from viewtide.operators.shape import hour_bins, learn_shape
    from viewtide.plans.daily import missed_days, run_days
    from viewtide.sources.tables import read_version, write_views

    rnd, cfg = random.Random(3), ShapeConfig(min_daily=5)
    views = views_df(spark, [(i, rnd.randrange(1, 4), at(minutes=rnd.randrange(12 * 1440))) for i in range(600)])
    posts = posts_df(spark, [{"post_id": k} for k in (1, 2, 3)])
    log, state, seen = str(tmp_path / "log"), str(tmp_path / "state"), []
    write_views(views, log)

    def fails(counters, shape, as_of):
        seen.append(as_of)
        if as_of.startswith("2024-01-08"):
            raise RuntimeError("lost")

    run = lambda until, each=None: run_days(spark, state, log, posts, until, shape_cfg=cfg, each=each)
    assert run("2024-01-05") == ["2024-01-05"] and run("2024-01-05") == []
    with pytest.raises(RuntimeError):
        run("2024-01-09", fails)
    assert seen == [f"2024-01-0{k} 00:01:00" for k in (6, 7, 8)]
    assert run("2024-01-10") == ["2024-01-08", "2024-01-09", "2024-01-10"]
    as_of = "2024-01-10 00:01:00"
    assert table(read_version(spark, f"{state}/counters", as_of)) == table(c.counters_as_of(views, as_of, posts))
    want = learn_shape(hour_bins(views.filter(f"ts < TIMESTAMP '{as_of}'"), cfg), cfg, as_of).first()
    got = read_version(spark, f"{state}/shape", as_of).first()
    assert all(abs(x - y) < 1e-12 for x, y in zip([*got.hour, *got.wday], [*want.hour, *want.wday]))
    assert missed_days(None, "2024-03-01") == ["2024-03-01"] and missed_days("2024-02-28", "2024-03-01") == ["2024-02-29", "2024-03-01"]
