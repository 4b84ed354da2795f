import random

import pytest

from tests.util import at, dicts, posts_df, views_df
from viewtide.config import RANGES, CountingConfig, ShapeConfig
from viewtide.operators.counters import counters_as_of
from viewtide.operators.shape import hour_bins, learn_shape
from viewtide.plans import daily
from viewtide.sources.tables import write_views


def shape_of(df):
    row = df.first()
    return [round(x, 9) for x in [*row["hour"], *row["wday"]]]


@pytest.mark.parametrize("minutes, skip", [(1, 1), (30, 0)])
def test_every_kept_reset_equals_a_recount(spark, tmp_path, monkeypatch, minutes, skip):
    """Two late batches, the second earlier than the first, one lost on the way, one with views
    of the open day; then the next run."""
    rnd, cfg, shape_cfg = random.Random(skip), CountingConfig(rollover_minutes=minutes), ShapeConfig(min_daily=12, skip_minutes=skip)
    path, log = str(tmp_path / "chain"), str(tmp_path / "log")
    posts = posts_df(spark, [{"post_id": p, "status": "draft" if p == 3 else "publish"} for p in range(1, 6)])

    def some(first, n, days):
        return [(first + i, rnd.randrange(1, 6), at(days=rnd.choice(days), minutes=rnd.choice([0, minutes, rnd.randrange(1440)]))) for i in range(n)]

    def log_more(rows):
        write_views(views_df(spark, rows).coalesce(1), log, minutes)
        return views_df(spark, rows)

    def check(days):
        for day in days:
            as_of = daily._reset_at(day, cfg)
            full = views_df(spark, rows)
            assert dicts(daily.read_day(spark, path, "counters", as_of).select("post_id", *RANGES), "post_id") == \
                dicts(counters_as_of(full, as_of, posts, cfg=cfg), "post_id"), day
            assert shape_of(daily.read_day(spark, path, "shape", as_of)) == \
                shape_of(learn_shape(hour_bins(full, shape_cfg), shape_cfg, as_of)), day

    rows = some(0, 200, range(12))
    log_more(rows)
    with pytest.raises(ValueError, match="no daily run"):
        daily.add_late_views(spark, path, log, views_df(spark, rows), posts, "x", cfg, shape_cfg)
    for until in ("2024-01-09", "2024-01-12"):
        daily.run_days(spark, path, log, posts, until, cfg, shape_cfg)

    late = some(1000, 20, [9, 10, 12])
    rows += late
    batch = log_more(late)

    def lost(*_):
        raise RuntimeError("lost")

    def correct():
        return daily.add_late_views(spark, path, log, batch, posts, "one", cfg, shape_cfg)

    with monkeypatch.context() as m:
        m.setattr(daily, "write_pointer", lost)
        with pytest.raises(RuntimeError):
            correct()
    redone = correct()
    assert redone[-2:] == ["2024-01-11", "2024-01-12"] and "2024-01-09" not in redone and correct() == []
    late = some(2000, 20, [2, 11])
    rows += late
    assert daily.add_late_views(spark, path, log, log_more(late), posts, "two", cfg, shape_cfg) == [f"2024-01-{d:02d}" for d in range(9, 13)]
    check(["2024-01-09", "2024-01-11", "2024-01-12"])
    assert daily.add_late_views(spark, path, log, batch.limit(0), posts, "none", cfg, shape_cfg) == []
    assert daily.run_days(spark, path, log, posts, "2024-01-13", cfg, shape_cfg) == ["2024-01-13"]
    check(["2024-01-13"])
