"""Partial counts on dyadic blocks of days: counters of any past instant from few stored sums.

Day ``n`` counts from 1970-01-01 and begins at its rollover; views before 1970 belong to day
0. Block ``(level, block)`` holds the views by post of the ``2 ** level`` days from
``block << level`` on, and is written once its last day has closed. Any run of closed days
is tiled by at most two blocks of each level, so a counter needs O(log days) blocks and the
log of the open day, however long the log is.

``path`` has ``blocks/level=/block=/batch=`` and the small file ``position``, which names the
committed batches, the rollover minutes and the first day that is still open. It is written
last: what a lost run left behind is never read. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.config import RANGES, CountingConfig
from viewtide.functions.calendar import at, period
from viewtide.operators.counters import limits_of, shown_counters
from viewtide.sources.tables import list_names, read_pointer, read_views, write_pointer

LEVELS = 16  # up to 2 ** 15 days in a block


def cover(first: int, until: int) -> list[tuple[int, int]]:
    """The fewest blocks that tile the days from ``first`` to before ``until``, in order."""
    blocks = []
    while first < until:
        aligned = (first & -first).bit_length() - 1 if first else LEVELS - 1
        level = min(aligned, (until - first).bit_length() - 1, LEVELS - 1)
        blocks.append((level, first >> level))
        first += 1 << level
    return blocks


def _day(ts: str, offset: int) -> str:
    return f"greatest(datediff({period(ts, 'day', offset)}, DATE '1970-01-01'), 0)"


def _start(day: int, offset: int) -> str:
    return str(datetime(1970, 1, 1) + timedelta(days=day, minutes=offset))


def _literals(spark: SparkSession, *columns: str) -> list:
    """Values of expressions over literals, which Spark folds without a job."""
    return list(spark.range(1).select(*[F.expr(c).alias(f"c{i}") for i, c in enumerate(columns)]).first())


def _position(spark: SparkSession, path: str, cfg: CountingConfig) -> dict:
    position = read_pointer(spark, f"{path}/position") or {
        "offset": cfg.rollover_minutes, "until": None, "batches": [], "late": []}
    if position["offset"] != cfg.rollover_minutes:
        raise ValueError(f"the partial counts {path} have days that start {position['offset']} minutes past "
                         f"midnight, not {cfg.rollover_minutes}")
    return position


def _parts(spark: SparkSession, path: str, position: dict, block: tuple[int, int]) -> list[str]:
    """The folders that add up to a block: its committed batches from the last whole one on."""
    order = {name: i for i, name in enumerate(position["batches"])}
    folder = f"{path}/blocks/level={block[0]}/block={block[1]}"
    found = []
    for name in list_names(spark, folder):
        batch, _, kind = name.removeprefix("batch=").rpartition("-")
        if batch in order:
            found.append((order[batch], kind == "all", f"{folder}/{name}"))
    found.sort()
    whole = max((i for i, part in enumerate(found) if part[1]), default=0)
    return [part[2] for part in found[whole:]]


def _read(spark: SparkSession, path: str, folders: list[str], like: DataFrame) -> DataFrame:
    """Rows ``level, block, post_id, views`` of the folders; post ids have the log's type."""
    kind = like.schema["post_id"].dataType.simpleString()
    ddl = f"post_id {kind}, views bigint, level int, block int"
    if not folders:
        return spark.createDataFrame([], ddl)
    stored = spark.read.schema(f"{ddl}, batch string").option("basePath", f"{path}/blocks").parquet(*folders)
    return stored.select("post_id", "views", "level", "block")


def _grown(rows: DataFrame, after: int, until: int) -> DataFrame:
    """Each row in every block around its own that ends after day ``after``, up to ``until``."""
    end = "shiftleft(shiftright(block, l - level) + 1, l)"
    levels = f"filter(sequence(level, {LEVELS - 1}), l -> {end} > {after} AND {end} <= {until})"
    spread = rows.selectExpr("post_id", "views", "level AS __level", "block AS __block", f"explode({levels}) AS level")
    return spread.selectExpr("level", "shiftright(__block, level - __level) AS block", "post_id", "views")


def _days(views: DataFrame, offset: int) -> DataFrame:
    """Day counts as blocks of level 0. A hot post ships one row per task and day."""
    counted = views.filter("post_id IS NOT NULL AND ts IS NOT NULL").selectExpr("post_id", f"{_day('ts', offset)} AS block")
    days = counted.groupBy("post_id", "block").agg(F.count("*").alias("views"))
    return days.selectExpr("post_id", "views", "0 AS level", "block")


def _write(rows: DataFrame, path: str, batch: str, whole: list[tuple[int, int]]) -> None:
    """Add up and write; blocks in ``whole`` replace their earlier parts. Blocks of any size
    end in files of even size: the rebalance splits great ones and joins small ones."""
    sums = rows.groupBy("level", "block", "post_id").agg(F.sum("views").alias("views"))
    named = ", ".join(f"'{level}/{block}'" for level, block in whole)
    kind = f"CASE WHEN concat_ws('/', level, block) IN ({named}) THEN 'all' ELSE 'add' END" if whole else "'add'"
    sums.withColumn("batch", F.expr(f"concat('{batch}-', {kind})")).hint("rebalance", F.col("level"), F.col("block")) \
        .write.mode("append").partitionBy("level", "block", "batch").parquet(f"{path}/blocks")


def extend_partials(spark: SparkSession, path: str, log: str, until, cfg: CountingConfig = CountingConfig()) -> int:
    """Store the blocks of all days that have closed at ``until``; returns how many days that
    adds (0 if none; the first run counts from the first day of the log as one).

    Only the folders of those days are read from the log. A block that began earlier takes
    its first part from stored blocks: they tile the days from the start of the greatest
    new block on, at most one of each level.
    """
    position, offset = _position(spark, path, cfg), cfg.rollover_minutes
    done, (end,) = position["until"], _literals(spark, _day(at(until), offset))
    if done is not None and end <= done:
        return 0
    views = read_views(spark, log, None if done is None else _start(done, offset), _start(end, offset), offset)
    rows, after = _days(views, offset), done or 0
    if done is not None:
        around = [(after >> level) << level for level in range(LEVELS) if ((after >> level) + 1) << level <= end]
        earlier = cover(min(around), after)
        folders = [f for block in earlier for f in _parts(spark, path, position, block)]
        rows = rows.unionByName(_read(spark, path, folders, views))
    batch = uuid.uuid4().hex
    _write(_grown(rows, after, end), path, batch, [])
    position.update(until=end, batches=[*position["batches"], batch])
    write_pointer(spark, f"{path}/position", position)
    return 1 if done is None else end - done


def add_late(spark: SparkSession, path: str, views: DataFrame, batch_id: str,
             cfg: CountingConfig = CountingConfig(), most_parts: int = 8) -> bool:
    """Add late views of closed days to every stored block around them; False, and nothing
    done, if ``batch_id`` was added before. Views of days still open are left to the log.

    The views must be in the log too, where the open day of a past instant is read. A block
    gains one small part per batch; once it has ``most_parts``, the batch rewrites it whole,
    so a read opens fewer folders than that for each block.
    """
    position, offset = _position(spark, path, cfg), cfg.rollover_minutes
    if batch_id in position["late"]:
        return False
    if position["until"] is None:
        raise ValueError(f"{path} holds no closed days yet")
    days = _days(views, offset).filter(F.col("block") < position["until"])
    late = _grown(days, 0, position["until"])
    # One row per day of the batch and level: not a matter of how many views there are.
    touched = [(r["level"], r["block"]) for r in late.select("level", "block").distinct().collect()]
    parts = {block: _parts(spark, path, position, block) for block in touched}
    whole = [block for block in touched if len(parts[block]) >= most_parts]
    batch = uuid.uuid4().hex
    _write(late.unionByName(_read(spark, path, [f for b in whole for f in parts[b]], views)), path, batch, whole)
    position.update(batches=[*position["batches"], batch], late=[*position["late"], batch_id])
    write_pointer(spark, f"{path}/position", position)
    return True


def counters_from_partials(spark: SparkSession, path: str, log: str, as_of, posts: DataFrame | None = None,
                           ranges=RANGES, cfg: CountingConfig = CountingConfig()) -> DataFrame:
    """``counters_as_of`` at an instant, now or past, from stored blocks and the open day.

    The limits of all ranges cut the closed days into spans; each span's blocks are opened
    once, whatever number of ranges they serve. Days that have closed but are not stored yet
    come from the log like the open one. Block sums and views are added up in one shuffle by post.
    Without ``posts``, posts with a view in one of the ranges have a row.
    """
    position, offset = _position(spark, path, cfg), cfg.rollover_minutes
    wanted = [r for r in ranges if cfg.enabled(r)]
    limits = {r: limits_of(r, as_of, offset) for r in wanted}
    today, after, *found = _literals(
        spark, _day(at(as_of), offset), f"CAST({at(as_of)} + INTERVAL 1 MICROSECOND AS STRING)",
        *["0" if x is None else _day(x, offset) for lo_hi in limits.values() for x in lo_hi])
    # Days of a range: the first one and the first one after it.
    spans = {r: (lo, today + 1 if limits[r][1] is None else hi) for r, lo, hi in zip(wanted, found[::2], found[1::2])}
    closed = min(today, position["until"] or 0)
    points = sorted({min(x, closed) for span in spans.values() for x in span})
    blocks = [b for lo, hi in zip(points, points[1:])
              if any(first <= lo and hi <= until for first, until in spans.values()) for b in cover(lo, hi)]
    first = max(closed, min(lo for lo, _ in spans.values()))
    views = read_views(spark, log, _start(first, offset) if first else None, after, offset)
    stored = _read(spark, path, [f for b in blocks for f in _parts(spark, path, position, b)], views)
    rows = stored.selectExpr("post_id", *[
        f"CASE WHEN shiftleft(block, level) >= {lo} AND shiftleft(block, level) < {hi} THEN views ELSE 0L END AS {r}"
        for r, (lo, hi) in spans.items()])
    if any(until > closed for _, until in spans.values()):
        def inside(rng: str) -> str:
            lo, hi = limits[rng]
            held = " AND ".join([f"ts >= {lo}"] * bool(lo) + [f"ts < {hi}"] * bool(hi)) or "true"
            return f"CASE WHEN {held} THEN 1L ELSE 0L END AS {rng}"

        rows = rows.unionByName(views.filter("post_id IS NOT NULL").selectExpr("post_id", *[inside(r) for r in wanted]))
    counts = rows.groupBy("post_id").agg(*[F.expr(f"nullif(sum({r}), 0L)").alias(r) for r in wanted])
    if posts is not None:
        return shown_counters(counts, posts, wanted, limits, cfg)
    return counts.filter(f"coalesce({', '.join(wanted)}) IS NOT NULL")
