import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.util import at, dicts, posts_df, views_df
from viewtide.config import RANGES, CountingConfig
from viewtide.operators.counters import counters_as_of
from viewtide.plans import partials
from viewtide.sources.tables import list_names, read_pointer, write_views


def log_of(spark, base, rows, offset=1):
    write_views(views_df(spark, rows).coalesce(1), f"{base}/log", offset)
    return f"{base}/blocks", f"{base}/log"


def same(spark, path, log, views, instants, posts=None, ranges=RANGES, cfg=CountingConfig()):
    for t in instants:
        got = partials.counters_from_partials(spark, path, log, t, posts, ranges, cfg)
        want = counters_as_of(views.filter("post_id IS NOT NULL"), t, posts, ranges, cfg)
        if posts is None:
            want = want.filter(f"coalesce({', '.join(ranges)}) IS NOT NULL")
        assert got.columns == want.columns
        assert dicts(got, "post_id") == dicts(want, "post_id"), t


def test_cover_tiles_days():
    rnd = random.Random(1)
    for _ in range(300):
        lo, hi = sorted(rnd.randrange(40_000) for _ in range(2))
        blocks = partials.cover(lo, hi)
        days = [d for level, block in blocks for d in (block << level, (block + 1) << level)]
        assert not blocks and lo == hi or (days[0], days[-1]) == (lo, hi) and days[1:-1:2] == days[2::2]
        assert len(blocks) <= 2 * max(1, (hi - lo).bit_length())
    assert len(partials.cover(0, 19_745)) == bin(19_745).count("1")


@pytest.mark.parametrize("offset", [1, 30])
def test_any_instant_equals_a_full_count(spark, tmp_path, offset):
    """Random views over 40 days, some at the rollovers, one post with a third of them, rows
    without a post, and a view before 1970; blocks stored in uneven runs, the last days not."""
    rnd, cfg = random.Random(offset), CountingConfig(rollover_minutes=offset)
    times = [at(days=rnd.randrange(40), minutes=rnd.choice([0, offset, rnd.randrange(1440)])) for _ in range(300)]
    rows = [(i, 1 if i % 3 == 0 else rnd.randrange(2, 9), t) for i, t in enumerate(times)]
    rows += [(900, None, at(days=3)), (901, 5, datetime(1969, 5, 5)), (902, 6, datetime(2023, 2, 2))]
    path, log = log_of(spark, str(tmp_path), rows, offset)
    views = views_df(spark, rows)
    added = [partials.extend_partials(spark, path, log, t, cfg) for t in (
        "2024-01-07 12:00:00", "2024-01-07 23:00:00", "2024-01-08 12:00:00", "2024-01-25 00:00:10", "2024-02-17 09:00:00")]
    assert added[1:] == [0, 1, 16, 24]
    posts = posts_df(spark, [{"post_id": p, "status": "draft" if p == 4 else "publish"} for p in range(1, 11)])
    same(spark, path, log, views, ["2024-02-01 00:30:00", "2024-03-04 00:31:00"], posts, cfg=cfg)
    same(spark, path, log, views, ["2024-01-25 00:00:30"], ranges=("day", "yesterday", "last_week"), cfg=cfg)
    same(spark, path, log, views, ["1969-06-01 00:00:00", "2025-06-01 00:00:00"], cfg=cfg)
    with pytest.raises(ValueError, match="minutes past"):
        partials.counters_from_partials(spark, path, log, "2024-02-05 11:00:00", cfg=CountingConfig(rollover_minutes=offset + 1))


def test_few_blocks_are_opened(spark, tmp_path):
    rows = [(d, 1 + d % 2, at(days=d, hours=5)) for d in range(0, 130, 3)]
    path, log = log_of(spark, str(tmp_path), rows)
    partials.extend_partials(spark, path, log, "2024-05-09 12:00:00")
    df = partials.counters_from_partials(spark, path, log, "2024-05-09 12:00:00", ranges=("total", "month", "last_month"))
    files = df.inputFiles()
    opened = {f.split("/batch=")[0].split("/blocks/blocks/")[1] for f in files if "/blocks/blocks/" in f}
    days = {f.split("site_day=")[1][:10] for f in files if "/site_day=" in f}
    assert len(opened) <= 20 and any("level=6" in b or "level=7" in b for b in opened)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "site_day" in plan and len(days) >= 1
    # Archives of closed days need no view of the log.
    only = partials.counters_from_partials(spark, path, log, "2024-05-09 12:00:00", ranges=("yesterday", "last_month"))
    assert not any("/site_day=" in f for f in only.inputFiles())
    same(spark, path, log, views_df(spark, rows), ["2024-05-09 12:00:00", "2024-03-31 23:59:00"])


def test_late_batches_count_once_and_parts_are_merged(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, rnd.randrange(5), at(days=rnd.randrange(20), minutes=rnd.randrange(1440))) for i in range(200)]
    path, log = log_of(spark, str(tmp_path), rows)
    partials.extend_partials(spark, path, log, "2024-01-13 08:00:00")
    for k in range(5):
        late = [(1000 + 10 * k + i, rnd.randrange(7), at(days=rnd.choice([2, 3, 15]), minutes=i)) for i in range(10)]
        rows += late
        write_views(views_df(spark, late).coalesce(1), log)
        said = [partials.add_late(spark, path, views_df(spark, late), f"late-{k}", most_parts=3) for _ in range(2)]
        assert said == [True, False]
    position = read_pointer(spark, f"{path}/position")
    for block in [(0, 19725), (1, 9862)]:  # 3 January 2024; 2 and 3 January
        assert 1 <= len(partials._parts(spark, path, position, block)) <= 3
    partials.extend_partials(spark, path, log, "2024-01-19 08:00:00")
    same(spark, path, log, views_df(spark, rows), ["2024-01-03 12:00:00", "2024-01-16 00:00:00", "2024-01-19 08:00:00"])


def test_a_lost_run_is_never_read(spark, tmp_path, monkeypatch):
    rows = [(d, 1, at(days=d, hours=5)) for d in range(12)]
    path, log = log_of(spark, str(tmp_path), rows)
    partials.extend_partials(spark, path, log, "2024-01-04 08:00:00")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(partials, "write_pointer", lost)
        with pytest.raises(RuntimeError):
            partials.extend_partials(spark, path, log, "2024-01-10 08:00:00")
    assert partials.extend_partials(spark, path, log, "2024-01-07 08:00:00") == 3
    assert partials.extend_partials(spark, path, log, "2024-01-11 08:00:00") == 4
    same(spark, path, log, views_df(spark, rows), ["2024-01-06 12:00:00", "2024-01-11 09:00:00"])
    assert list_names(spark, f"{path}/nothing") == []


def test_nothing_stored_and_nothing_logged(spark, tmp_path):
    path, log = log_of(spark, str(tmp_path), [(1, 1, at(days=1, hours=2))])
    views = views_df(spark, [(1, 1, at(days=1, hours=2))])
    same(spark, path, log, views, ["2024-01-02 12:00:00"])  # no blocks yet: all from the log
    with pytest.raises(ValueError, match="no closed days"):
        partials.add_late(spark, path, views, "x")
    partials.extend_partials(spark, path, log, "2024-01-20 00:00:00")
    assert not partials.counters_from_partials(spark, path, log, "2023-01-01 00:00:00").collect()
    assert partials.extend_partials(spark, path, log, "2024-02-20 00:00:00") == 31  # days without a view
    assert partials.add_late(spark, path, views.filter(F.lit(False)), "empty")
    same(spark, path, log, views, ["2024-02-20 10:00:00"])
