"""The daily reset job."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.config import CountingConfig, ShapeConfig
from viewtide.functions.calendar import at, period_start
from viewtide.operators import counters as c
from viewtide.operators.shape import hour_bins, learn_shape
from viewtide.sources.tables import list_names, read_pointer, read_version, read_views, write_pointer, write_version


@dataclass(frozen=True)
class DailyReset:
    counters: DataFrame
    summary: DataFrame
    shape: DataFrame
    trending: DataFrame | None


def daily_reset(views: DataFrame, counters: DataFrame, posts: DataFrame, as_of,
                cfg: CountingConfig = CountingConfig(), shape_cfg: ShapeConfig = ShapeConfig(),
                before: Callable | None = None, after: Callable | None = None,
                trending: Callable[[DataFrame], DataFrame] | None = None,
                stored_shape: DataFrame | None = None) -> DailyReset:
    """Learn the traffic shape first, then roll the counters over, then (optionally) run
    trending on the rolled counters.

    With ``stored_shape``, the shape that the last run left, only the day that has just
    closed is read from the log and folded in; without it, all of the log's days are."""
    if stored_shape is not None:
        first, until = (period_start(as_of, "day", shape_cfg.skip_minutes, back=b) for b in (1, 0))
        views = views.filter(f"ts >= {first} AND ts < {until}")
    shape = learn_shape(hour_bins(views, shape_cfg), shape_cfg, as_of, start=stored_shape)
    rolled = c.rollover(counters, posts, as_of, cfg, before=before, after=after)
    summary = c.rollover_summary(posts, as_of, cfg)
    return DailyReset(rolled, summary, shape, trending(rolled) if trending else None)


def missed_days(position: str | None, until: str) -> list[str]:
    """The days whose reset is due: those after ``position`` up to ``until``, in order; without
    a position ``until`` alone, whose run then covers the whole log."""
    last = date.fromisoformat(until)
    if position is None:
        return [until]
    first = date.fromisoformat(position) + timedelta(days=1)
    return [(first + timedelta(days=k)).isoformat() for k in range((last - first).days + 1)]


def _reset_at(day: str, cfg: CountingConfig) -> str:
    return str(datetime.fromisoformat(day) + timedelta(minutes=cfg.rollover_minutes))


def _closed_day(spark: SparkSession, log: str, as_of: str, cfg: ShapeConfig) -> DataFrame:
    """Hour bins of the last day that has closed at a reset; only its folders are read."""
    skip = timedelta(minutes=cfg.skip_minutes)
    end = datetime.combine((datetime.fromisoformat(as_of) - skip).date(), datetime.min.time()) + skip
    return hour_bins(read_views(spark, log, str(end - timedelta(days=1)), str(end)), cfg)


def read_day(spark: SparkSession, path: str, what: str, as_of: str) -> DataFrame:
    """The ``counters`` or ``shape`` that ``run_days`` stored at a reset, with every late batch
    that was added since."""
    folder = (read_pointer(spark, f"{path}/position") or {}).get("revised", {}).get(as_of)
    return read_version(spark, f"{path}/{folder}/{what}" if folder else f"{path}/{what}", as_of)


def run_days(spark: SparkSession, path: str, log: str, posts: DataFrame, until: str,
             cfg: CountingConfig = CountingConfig(), shape_cfg: ShapeConfig = ShapeConfig(),
             each: Callable[[DataFrame, DataFrame, str], None] | None = None) -> list[str]:
    """The daily resets that are due up to the day ``until`` (a date), each once and in order.

    ``path`` holds the run's position, and counters and traffic shape by version. A day goes
    on from the day before it: its views are read from the stored log at ``log`` (only the
    folders of that day), counters are advanced, the day that has closed is folded into the
    shape, ``each(counters, shape, as_of)`` runs what follows (such as trending), and the position
    is written last. A run that fails or is lost leaves the position where it was; the next
    one does that day again, over its own half-written versions, and then all that were
    missed meanwhile. Returns the days worked; none if nothing is due.
    """
    position = read_pointer(spark, f"{path}/position") or {}
    worked = []
    for day in missed_days(position.get("day"), until):
        as_of = _reset_at(day, cfg)
        if not position:
            views = read_views(spark, log).filter(f"ts <= {at(as_of)}")
            counters = c.counters_as_of(views, as_of, posts, cfg=cfg)
            shape = learn_shape(hour_bins(views, shape_cfg), shape_cfg, as_of)
        else:
            since = _reset_at(position["day"], cfg)
            views = read_views(spark, log, since).filter(f"ts > {at(since)} AND ts <= {at(as_of)}")
            counters = c.advance(read_day(spark, path, "counters", since), views, since, as_of, posts, cfg)
            shape = learn_shape(_closed_day(spark, log, as_of, shape_cfg), shape_cfg, as_of, start=read_day(spark, path, "shape", since))
        write_version(counters, f"{path}/counters", as_of)
        write_version(shape, f"{path}/shape", as_of)
        if each:
            each(read_version(spark, f"{path}/counters", as_of), read_version(spark, f"{path}/shape", as_of), as_of)
        position = {**position, "day": day}
        write_pointer(spark, f"{path}/position", position)
        worked.append(day)
    return worked


def add_late_views(spark: SparkSession, path: str, log: str, late: DataFrame, posts: DataFrame, batch_id: str,
                   cfg: CountingConfig = CountingConfig(), shape_cfg: ShapeConfig = ShapeConfig()) -> list[str]:
    """Correct what ``run_days`` stored for late views of closed days: every kept reset from the
    first late view on. Returns the days corrected; none if ``batch_id`` was added before.

    ``late`` is in the log already. Counters take the batch alone, each view by its own time
    (``advance`` to the same instant). The shape is not additive: it is folded again, day by
    day, from the last shape before the first late view, or from the whole log if none is
    kept. So the cost is the batch once, and the log from that day on, per corrected day one
    day of it. Late views after the last reset are left to the next run.

    Corrected versions are new tables; the position names them and is written last, so
    readers (``read_day``, the next ``run_days``) see all of a batch or nothing.
    """
    position = read_pointer(spark, f"{path}/position")
    if position is None:
        raise ValueError(f"{path} has no daily run yet")
    if batch_id in position.get("late", []):
        return []
    late = late.filter(f"post_id IS NOT NULL AND ts <= {at(_reset_at(position['day'], cfg))}")
    first = late.agg(F.min("ts").cast("string")).first()[0]
    kept = sorted(n.removeprefix("as_of=")[:10] for n in list_names(spark, f"{path}/counters") if n.startswith("as_of="))
    redo = [d for d in kept if first is not None and d <= position["day"] and datetime.fromisoformat(first) <= datetime.fromisoformat(_reset_at(d, cfg))]
    earlier = [d for d in kept if redo and d < redo[0]]
    folder, shape = f"revision={uuid.uuid4().hex}", None
    if earlier:
        shape = read_day(spark, path, "shape", _reset_at(earlier[-1], cfg))
    for day in redo:
        as_of = _reset_at(day, cfg)
        counters = c.advance(read_day(spark, path, "counters", as_of), late.filter(f"ts <= {at(as_of)}"), as_of, as_of, posts, cfg)
        write_version(counters, f"{path}/{folder}/counters", as_of)
        bins = hour_bins(read_views(spark, log, None, as_of), shape_cfg) if shape is None else _closed_day(spark, log, as_of, shape_cfg)
        write_version(learn_shape(bins, shape_cfg, as_of, start=shape), f"{path}/{folder}/shape", as_of)
        shape = read_version(spark, f"{path}/{folder}/shape", as_of)
    revised = {**position.get("revised", {}), **{_reset_at(d, cfg): folder for d in redo}}
    write_pointer(spark, f"{path}/position", {**position, "revised": revised, "late": [*position.get("late", []), batch_id]})
    return redo

