"""Counters from the view log, and their daily rollover."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.config import ARCHIVE_OF, LIVE_RANGES, RANGES, CountingConfig
from viewtide.functions.calendar import at, instant, period, period_start
from viewtide.operators.ordered import running_positions


def limits_of(rng: str, as_of, offset: int) -> tuple[str | None, str | None]:
    """(first instant, first instant after) of a range; None means open."""
    if rng == "total":
        return None, None
    if rng in ARCHIVE_OF:
        unit = ARCHIVE_OF[rng]
        return period_start(as_of, unit, offset, back=1), period_start(as_of, unit, offset)
    return period_start(as_of, rng, offset), None


def counters_as_of(views: DataFrame, as_of, posts: DataFrame | None = None, ranges=RANGES,
                   cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """Every counter of every post at an instant, in one conditional pass over the log.

    Partial counts combine before the shuffle, so a hot post ships one row per task. When
    ``total`` is not asked for, the scan is limited to the periods that are.

    A live counter without views is NULL (no stored key). An archive is 0 for a published
    post that was already out at its rollover, else NULL; that needs ``posts``.
    """
    wanted = [r for r in ranges if cfg.enabled(r)]
    lims = {r: limits_of(r, as_of, cfg.rollover_minutes) for r in wanted}
    log = views.filter(f"ts <= {at(as_of)}")
    if "total" not in wanted:
        first = [lo for lo, _ in lims.values()]
        log = log.filter(f"ts >= {first[0] if len(first) == 1 else f'least({", ".join(first)})'}")

    def counter(rng: str) -> str:
        lo, hi = lims[rng]
        inside = " AND ".join([f"ts >= {lo}"] * bool(lo) + [f"ts < {hi}"] * bool(hi)) or "true"
        return f"nullif(count_if({inside}), 0L) AS {rng}"

    counts = log.groupBy("post_id").agg(*[F.expr(counter(r)) for r in wanted])
    return counts if posts is None else shown_counters(counts, posts, wanted, lims, cfg)


def _binned(ts: str, points: list[int]) -> str:
    """How many of the ascending ``points`` (microseconds) are at or before ``ts``. The span of
    the points is divided into as many cells as there are points, so a row is compared with
    the few points of its own cell only."""
    first, width = points[0], (points[-1] - points[0]) // len(points) + 1
    cells: list[list[int]] = [[] for _ in range((points[-1] - first) // width + 1)]
    for p in points:
        cells[(p - first) // width].append(p)
    before = [bisect_left(points, first + k * width) for k in range(len(cells))]
    literal = ", ".join(f"struct({n}, array({', '.join(f'{p}L' for p in c) or 'CAST(NULL AS BIGINT)'}))"
                        for n, c in zip(before, cells))
    micros = f"unix_micros({ts})"
    cell = f"least(greatest(({micros} - {first}L) div {width}L, 0L), {len(cells) - 1}L)"
    return f"""transform(array(array({literal})[{cell}]),
        c -> c.col1 + size(filter(c.col2, p -> p <= {micros})))[0]"""


def counters_at(views: DataFrame, instants, ranges=LIVE_RANGES, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """``as_of, post_id`` and every counter, for many instants in one pass over the log: for
    each instant the rows of ``counters_as_of`` that hold a view.

    The limits of all ranges at all instants, sorted, divide time into bins. A view falls into
    one bin; counts by post and bin combine before the shuffle, so a hot post ships a row per
    task and bin. A post's bins (never more than limits) are then added up from the left, and
    a counter is the difference of two such sums. So the log is read and shuffled once, not
    once per instant. Without ``total`` the scan starts at the first limit.

    ``instants`` is a list of texts or datetimes; repeated ones count once. Views without a
    post or a time are in no counter. An empty list or log gives no rows.
    """
    spark, offset = views.sparkSession, cfg.rollover_minutes
    wanted = [r for r in ranges if cfg.enabled(r)]
    micros = lambda x: "CAST(NULL AS BIGINT)" if x is None else f"unix_micros({x})"
    asked = [[f"unix_micros({at(t)})", *[micros(x) for r in wanted for x in limits_of(r, t, offset)]] for t in instants]
    shown = ", ".join(["as_of timestamp", "post_id " + views.schema["post_id"].dataType.simpleString(),
                       *[f"{r} bigint" for r in wanted]])
    if not asked or not wanted:
        return spark.createDataFrame([], shown)
    # Literals only: Spark folds this row without a job.
    found = spark.range(1).select(F.expr(f"array({', '.join(f'array({", ".join(row)})' for row in asked)})")).first()[0]
    found = sorted({tuple(row) for row in found})
    # A view at the instant itself is counted, one at an upper limit is not.
    spans = [[(lo, now + 1 if hi is None else min(hi, now + 1)) for lo, hi in zip(row[::2], row[1::2])]
             for now, *row in found]
    points = sorted({x for row in spans for span in row for x in span if x is not None})
    starts = np.array([[0 if lo is None else points.index(lo) + 1 for lo, _ in row] for row in spans])
    ends = np.array([[points.index(hi) + 1 for _, hi in row] for row in spans])
    times = np.array([row[0] for row in found])

    log = views.filter(f"post_id IS NOT NULL AND ts < timestamp_micros({points[-1]}L)")
    if "total" not in wanted:
        log = log.filter(f"ts >= timestamp_micros({points[0]}L)")
    sums = log.groupBy("post_id", F.expr(_binned("ts", points)).alias("bin")).agg(F.count("*").alias("n"))
    posts = sums.groupBy("post_id").agg(F.expr("collect_list(struct(bin, n))").alias("bins"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                lists = batch.column("bins")
                held = lists.flatten()
                post = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                below = np.zeros((batch.num_rows, len(points) + 2), np.int64)  # views before each point
                below[post, held.field("bin").to_numpy() + 1] = held.field("n").to_numpy()
                below = below.cumsum(axis=1)
                # ``below[:, k]`` holds the bins under k: the views before point k - 1.
                counts = below[:, ends] - np.where(starts > 0, below[:, starts], 0)
                at_post, at_time = np.nonzero(counts.any(axis=2))
                rows = counts[at_post, at_time]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(times[at_time]), batch.column("post_id").take(pa.array(at_post)),
                     *[pa.array(rows[:, k], mask=rows[:, k] == 0) for k in range(len(wanted))]],
                    names=["as_of", "post_id", *wanted])

    flat = posts.mapInArrow(spread, shown.replace("as_of timestamp", "as_of bigint"))
    return flat.withColumn("as_of", F.timestamp_micros("as_of"))


def shown_counters(counts: DataFrame, posts: DataFrame, ranges, lims: dict, cfg: CountingConfig) -> DataFrame:
    """Counters of every post; an archive is 0 where its rollover found the post out."""
    types = ", ".join(f"'{t}'" for t in cfg.public_types)
    dim = posts.selectExpr(
        "post_id", f"CASE WHEN status = 'publish' AND post_type IN ({types}) THEN published_at END AS __out")

    def shown(rng: str) -> str:
        if rng not in ARCHIVE_OF:
            return rng
        return f"CASE WHEN __out <= {lims[rng][1]} THEN coalesce({rng}, 0L) END AS {rng}"

    return dim.join(counts, "post_id", "left").selectExpr("post_id", *[shown(r) for r in ranges])


def apply_views(counters: DataFrame, views: DataFrame, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """Add a batch of accepted views of the current day to stored counters. For a batch that
    may hold views of other days there is ``advance``."""
    fresh = views.groupBy("post_id").agg(F.count("*").alias("__n"))
    live = [r for r in LIVE_RANGES if cfg.enabled(r)]
    joined = counters.join(fresh, "post_id", "full")

    def added(c: str) -> Column:
        if c not in live:
            return F.col(c)
        both = F.coalesce(F.col(c), F.lit(0)) + F.col("__n")
        return F.when(F.col("__n").isNull(), F.col(c)).otherwise(both).alias(c)

    return joined.select(*[added(c) for c in counters.columns])


def advance(counters: DataFrame, views: DataFrame, since, as_of, posts: DataFrame | None = None,
            cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """Counters stored at ``since``, brought to ``as_of`` by a batch of views that they do not
    hold yet: the same rows as ``counters_as_of`` over all views, without the log.

    The batch may lie across any number of rollovers, and may hold late views of days that
    are closed already. Every view is counted by its own time: into the live counter of a
    period that is open at ``as_of``, into the archive of the one before, else into the
    total alone. A stored live counter stays if its period is still open, becomes the archive
    if it is the one before, and is dropped if it is older. Views after ``as_of`` wait.

    One conditional aggregation over the batch and one join by post.
    """
    offset, held = cfg.rollover_minutes, [r for r in RANGES if cfg.enabled(r) and r in counters.columns]
    limits = {r: limits_of(r, as_of, offset) for r in held}

    def fresh(rng: str) -> str:
        lo, hi = limits[rng]
        inside = " AND ".join([f"ts >= {lo}"] * bool(lo) + [f"ts < {hi}"] * bool(hi)) or "true"
        return f"count_if({inside}) AS __{rng}"

    def moved(rng: str) -> str:
        if rng == "total":
            return "total"
        unit = ARCHIVE_OF.get(rng, rng)
        now, before, then = (period_start(x, unit, offset, back=b) for x, b in ((as_of, 0), (as_of, 1), (since, 0)))
        if rng == unit:
            return f"CASE WHEN {now} = {then} THEN {rng} END"
        return f"CASE WHEN {now} = {then} THEN {rng} WHEN {before} = {then} THEN {unit} END"

    live = {unit for r, unit in ARCHIVE_OF.items() if r in held}
    if missing := live - set(counters.columns):
        raise ValueError(f"archives need the live counters {sorted(missing)}")
    batch = views.filter(f"ts <= {at(as_of)}").groupBy("post_id").agg(*[F.expr(fresh(r)) for r in held])
    sums = counters.join(batch, "post_id", "full").selectExpr(
        "post_id", *[f"nullif(coalesce({moved(r)}, 0L) + coalesce(__{r}, 0L), 0L) AS {r}" for r in held])
    return sums if posts is None else shown_counters(sums, posts, held, limits, cfg)


def running_counts(views: DataFrame, cfg: CountingConfig = CountingConfig(), tiebreak: str = "event_id",
                   counted: str = "true", **options) -> DataFrame:
    """Each row with its post's counters right after it was counted (NULL when ``counted``
    is false for it)."""
    marked = views.selectExpr("*", *[
        f"{period('ts', r, cfg.rollover_minutes)} AS __{r}" for r in ("day", "week", "month")])
    frames = {r: None if r == "total" else f"__{r}" for r in LIVE_RANGES if cfg.enabled(r)}
    rows = running_positions(marked, ["post_id"], "ts", tiebreak, frames, counted, **options)
    return rows.selectExpr(*views.columns, *[f"CASE WHEN {counted} THEN {r} END AS {r}" for r in frames])


def _due(as_of, reset_week, reset_month, cfg: CountingConfig) -> dict[str, Column]:
    now = instant(as_of)
    week = F.dayofweek(now) == 2 if reset_week is None else F.lit(reset_week)
    month = F.dayofmonth(now) == 1 if reset_month is None else F.lit(reset_month)
    return {
        "day": F.lit(cfg.enable_day),
        "week": week & F.lit(cfg.enable_week),
        "month": month & F.lit(cfg.enable_month),
    }


def _resettable(posts: DataFrame, as_of, cfg: CountingConfig) -> DataFrame:
    types = [t for t in cfg.public_types if t != "attachment"] or ["post"]
    return posts.filter((F.col("status") == "publish") & F.col("post_type").isin(types)
                        & (F.col("published_at") <= instant(as_of))).select("post_id")


def rollover(counters: DataFrame, posts: DataFrame, as_of, cfg: CountingConfig = CountingConfig(),
             reset_week=None, reset_month=None, before: Callable | None = None,
             after: Callable | None = None) -> DataFrame:
    """Move due counters into their archives and clear them, for every published post.

    Days always roll, weeks on Monday, months on the first, unless overridden. Posts that
    are not published keep their row as it is. ``before`` and ``after`` are DataFrame hooks.
    """
    due = _due(as_of, reset_week, reset_month, cfg)
    source = before(counters) if before else counters
    target = _resettable(posts, as_of, cfg).withColumn("__target", F.lit(True))
    joined = source.join(target, "post_id", "full")
    out = ["post_id", "total"]
    for unit in ("day", "week", "month"):
        moves = F.coalesce(F.col("__target"), F.lit(False)) & due[unit]
        archive = next(a for a, u in ARCHIVE_OF.items() if u == unit)
        out.append(F.when(~moves, F.col(unit)).alias(unit))
        out.append(F.when(moves, F.coalesce(F.col(unit), F.lit(0))).otherwise(F.col(archive)).alias(archive))
    rolled = joined.select(*out).select("post_id", *RANGES)
    return after(rolled) if after else rolled


def rollover_summary(posts: DataFrame, as_of, cfg: CountingConfig = CountingConfig(),
                     reset_week=None, reset_month=None) -> DataFrame:
    """One row: how many posts a rollover touches and which ranges it resets."""
    due = _due(as_of, reset_week, reset_month, cfg)
    return _resettable(posts, as_of, cfg).agg(
        F.count("*").alias("total_posts"), F.count("*").alias("affected_posts"),
    ).select("total_posts", *[due[u].alias(f"reset_{u}") for u in due], "affected_posts")


def to_long(counters: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Counters as (post, stored key, value) rows; an absent key has no row. Keys are the
    range names unless ``keys`` gives a store's own."""
    names = {**{r: r for r in RANGES}, **(keys or {})}
    held = [r for r in RANGES if r in counters.columns]
    wide = counters.select("post_id", *[F.col(r).alias(names[r]) for r in held])
    return wide.unpivot("post_id", [names[r] for r in held], "meta_key", "meta_value") \
        .filter(F.col("meta_value").isNotNull())


def to_wide(rows: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Inverse of ``to_long``. One conditional aggregate, no distinct-key pass."""
    names = {**{r: r for r in RANGES}, **(keys or {})}
    return rows.groupBy("post_id").agg(*[
        F.max(F.when(F.col("meta_key") == names[r], F.col("meta_value").cast("bigint"))).alias(r) for r in RANGES])
