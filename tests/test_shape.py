import pytest

from tests.util import at, counters_df, dicts, posts_df, views_df
from viewtide.config import ShapeConfig
from viewtide.operators.shape import factors, hour_bins, learn_shape, merge_bins
from viewtide.sources.tables import neutral_shape


def bins_df(spark, days):
    rows = [(f"2024-01-{d:02d}", b, sum(b)) for d, b in days]
    return spark.createDataFrame(rows, "d string, hour_bins array<bigint>, total bigint") \
        .selectExpr("CAST(d AS DATE) AS site_day", "hour_bins", "total")


SPIKE = [240] + [0] * 23
HALVES = [100] * 12 + [20] * 12


def model(days, alpha_h=0.25, kappa_h=48, alpha_w=0.2, kappa_w=14, min_daily=200, weekday0=1):
    hour, wday = [1.0] * 24, [1.0] * 7

    def norm(a):
        m = sum(a) / len(a)
        return [x / m for x in a] if m > 0 else a

    for d, b in sorted(days):
        total = sum(b)
        if total < min_daily:
            continue
        mult = [max(0.2, min(5.0, (x + kappa_h / 24) / (total + kappa_h) * 24)) for x in b]
        hour = norm([(1 - alpha_h) * p + alpha_h * m for p, m in zip(hour, mult)])
        w = (d - 1 + weekday0) % 7  # 2024-01-01 is a Monday; 0 = Sunday
        target = max(0.2, min(5.0, (total + kappa_w) / (1 + kappa_w) / (sum(wday) / 7)))
        wday[w] = (1 - alpha_w) * wday[w] + alpha_w * target
        wday = norm(wday)
    return hour, wday


def test_golden(spark):
    r = learn_shape(bins_df(spark, [(1, SPIKE)])).first()
    assert r.hour[0] == pytest.approx(2.352941, abs=1e-6) and r.hour[5] == pytest.approx(0.941176, abs=1e-6)
    r = learn_shape(bins_df(spark, [(1, HALVES)])).first()
    assert r.hour[0] == pytest.approx(1.161290, abs=1e-6) and r.hour[23] == pytest.approx(0.838710, abs=1e-6)
    even = [500 // 24 + (h < 500 % 24) for h in range(24)]
    w = learn_shape(bins_df(spark, [(1, even), (2, even)])).first().wday
    assert w == pytest.approx([0.803279, 1.445902, 1.537705] + [0.803279] * 4, abs=1e-6)


def test_many_days_equal_the_model_and_can_resume(spark):
    import random
    rnd = random.Random(1)
    days = [(d, [rnd.randrange(0, 40) * (h > 6) for h in range(24)]) for d in range(1, 29)]
    days[4] = (5, [1] * 24)  # below the floor
    hour, wday = model(days)
    r = learn_shape(bins_df(spark, days)).first()
    assert r.hour == pytest.approx(hour) and r.wday == pytest.approx(wday) and r.days_learned == 27
    assert sum(r.hour) / 24 == pytest.approx(1) and sum(r.wday) / 7 == pytest.approx(1)
    half = learn_shape(bins_df(spark, days[:14]))
    rest = learn_shape(bins_df(spark, days[14:]), start=half).first()
    assert rest.hour == pytest.approx(hour) and rest.wday == pytest.approx(wday)
    early = learn_shape(bins_df(spark, days), as_of="2024-01-15 00:01:00").first()
    assert early.hour == pytest.approx(half.first().hour)
    cfg = ShapeConfig(min_daily=10**6)
    assert learn_shape(bins_df(spark, days), cfg).first().hour == [1.0] * 24
    assert learn_shape(bins_df(spark, days), cfg, start=half).first().hour == pytest.approx(half.first().hour)


def test_sites_in_parallel(spark):
    a = bins_df(spark, [(1, SPIKE)]).selectExpr("'a' AS site", "*")
    b = bins_df(spark, [(1, HALVES)]).selectExpr("'b' AS site", "*")
    start = neutral_shape(spark).selectExpr("'c' AS site", "*")
    rows = {r.site: r for r in learn_shape(a.unionByName(b), site_cols=["site"], start=start).collect()}
    assert rows["a"].hour[0] == pytest.approx(2.352941, abs=1e-6)
    assert rows["b"].hour[0] == pytest.approx(1.161290, abs=1e-6)
    assert rows["c"].hour == [1.0] * 24 and rows["c"].days_learned == 0


def test_bins_skip_views_before_the_reset(spark):
    v = views_df(spark, [(1, 1, at(seconds=30)), (2, 1, at(minutes=1)), (3, 1, at(hours=23)), (4, 1, at(days=1, hours=5))])
    rows = dicts(hour_bins(v), "site_day")
    assert [(r["total"], r["hour_bins"][0], r["hour_bins"][5], r["hour_bins"][23]) for r in rows] == [(2, 1, 0, 1), (1, 0, 1, 0)]
    assert dicts(hour_bins(v, ShapeConfig(skip_minutes=0)), "site_day")[0]["total"] == 3
    assert hour_bins(v, ShapeConfig(collect=False)).count() == 0
    twice = dicts(merge_bins(hour_bins(v), hour_bins(v)), "site_day")
    assert twice[0]["total"] == 4 and twice[0]["hour_bins"][23] == 2


def test_factors(spark):
    f = factors(learn_shape(bins_df(spark, [(1, SPIKE)])), "2024-01-02 00:30:00").first()
    assert f.hour_factor == pytest.approx(2.352941, abs=1e-6)
    bad = spark.createDataFrame([([1.0, 2.0], [2.0] * 7)], "hour array<double>, wday array<double>")
    f = factors(bad, "2024-01-02 00:30:00").first()
    assert (f.hour_factor, f.wday_factor) == (1.0, 1.0)
    f = factors(neutral_shape(spark), "2024-01-02 00:30:00").first()
    assert (f.hour_factor, f.wday_factor) == (1.0, 1.0)


def test_daily_job_resumes_from_the_stored_shape(spark):
    from viewtide.plans.daily import daily_reset

    rows = [(i, 1, at(hours=5 * i, minutes=2)) for i in range(30)]
    views, cfg = views_df(spark, rows), ShapeConfig(min_daily=1)
    posts, counters = posts_df(spark, [{"post_id": 1}]), counters_df(spark, [(1, 5, 5, 5, 5)])
    stored = neutral_shape(spark)
    for day in range(2, 6):
        stored = daily_reset(views, counters, posts, f"2024-01-{day:02d} 00:01:00", shape_cfg=cfg, stored_shape=stored).shape
    whole = daily_reset(views, counters, posts, "2024-01-05 00:01:00", shape_cfg=cfg).shape
    assert stored.first().hour == pytest.approx(whole.first().hour) and stored.first().wday == pytest.approx(whole.first().wday)
    assert stored.first().days_learned == 1 and whole.first().days_learned == 4
