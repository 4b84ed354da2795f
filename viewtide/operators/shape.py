"""Hour-of-day and day-of-week traffic shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.config import ShapeConfig
from viewtide.functions.calendar import at, period
from viewtide.functions.formulas import clip, num


def in_bins(cfg: ShapeConfig = ShapeConfig()) -> Column:
    """Views that hour bins hold, in batch and stream: those after the day's reset."""
    return F.expr(f"hour(ts) * 60 + minute(ts) >= {cfg.skip_minutes}") & F.lit(cfg.collect)


def hour_bins(views: DataFrame, cfg: ShapeConfig = ShapeConfig(), site_cols=()) -> DataFrame:
    """Views per site day and hour as a 24-array, with the day's total.

    One aggregation with 24 conditional counts: each task ships one row per day.
    """
    log = views.filter(in_bins(cfg))
    log = log.selectExpr(*site_cols, "to_date(ts) AS site_day", "hour(ts) AS __h")
    bins = ", ".join(f"count_if(__h = {h})" for h in range(24))
    return log.groupBy(*site_cols, "site_day").agg(F.expr(f"array({bins})").alias("hour_bins"),
                                                   F.count("*").alias("total"))


def merge_bins(a: DataFrame, b: DataFrame, site_cols=()) -> DataFrame:
    """Add two sets of bins day by day (late or parallel collectors)."""
    sums = ", ".join(f"sum(hour_bins[{h}])" for h in range(24))
    return a.unionByName(b).groupBy(*site_cols, "site_day").agg(
        F.expr(f"array({sums})").alias("hour_bins"), F.sum("total").alias("total"))


def _let(name: str, value: str, body: str) -> str:
    """Use a value several times in ``body`` while computing it once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _mean(arr: str) -> str:
    return f"(aggregate({arr}, 0D, (x, y) -> x + y) / size({arr}))"


def mean_one(arr: str) -> str:
    """Scale to mean 1; unchanged when empty or when the mean is not positive."""
    scaled = _let("m", _mean("a"), "CASE WHEN m > 0 THEN transform(a, v -> v / m) ELSE a END")
    return _let("a", arr, f"CASE WHEN size(a) > 0 THEN {scaled} ELSE a END")


def _neutral(n: int) -> str:
    return f"array_repeat(1D, {n})"


def _hour_step(cfg: ShapeConfig) -> str:
    prior = num(1.0 / 24.0)
    share = f"((n + {num(cfg.kappa_hour)} * {prior}) / (d.total + {int(cfg.kappa_hour)}))"
    target = clip(f"{share} / {prior}", cfg.low, cfg.high)
    blend = f"{num(1 - cfg.alpha_hour)} * p + {num(cfg.alpha_hour)} * {target}"
    return mean_one(f"zip_with(s, d.hour_bins, (p, n) -> {blend})")


def _wday_step(cfg: ShapeConfig) -> str:
    steady = f"((d.total + {num(cfg.kappa_wday)}) / {num(1.0 + cfg.kappa_wday)})"
    target = clip(f"{steady} / (CASE WHEN avg <= 0 THEN 1D ELSE avg END)", cfg.low, cfg.high)
    blend = f"{num(1 - cfg.alpha_wday)} * p + {num(cfg.alpha_wday)} * {target}"
    moved = f"transform(s, (p, i) -> CASE WHEN i = dayofweek(d.site_day) - 1 THEN {blend} ELSE p END)"
    return mean_one(_let("avg", _mean("s"), moved))


def learn_shape(bins: DataFrame, cfg: ShapeConfig = ShapeConfig(), as_of=None, start: DataFrame | None = None,
                site_cols=()) -> DataFrame:
    """Fold the days' bins, in date order, into smoothed multipliers.

    Days below the traffic floor are skipped; days not closed at ``as_of`` are left out.
    ``start`` is a stored shape to go on from (only newer days should be given then). The
    fold's input is one small row per site and day.
    """
    days = bins.filter(F.col("total") >= cfg.min_daily)
    if as_of is not None:
        days = days.filter(f"site_day < {period(at(as_of), 'day', cfg.skip_minutes)}")
    packed = days.groupBy(*site_cols).agg(
        F.expr("array_sort(collect_list(struct(site_day, hour_bins, total)))").alias("days"))
    if start is None:
        packed = packed.selectExpr("*", f"{_neutral(24)} AS h0", f"{_neutral(7)} AS w0")
    elif site_cols:
        old = start.select(*site_cols, F.col("hour").alias("__h"), F.col("wday").alias("__w"))
        packed = packed.join(old, list(site_cols), "full").selectExpr(
            "*", f"coalesce(__h, {_neutral(24)}) AS h0", f"coalesce(__w, {_neutral(7)}) AS w0")
    else:
        one = start.limit(1)
        packed = packed.select("*", F.coalesce(one.select("hour").scalar(), F.expr(_neutral(24))).alias("h0"),
                               F.coalesce(one.select("wday").scalar(), F.expr(_neutral(7))).alias("w0"))
    return packed.selectExpr(
        *site_cols,
        f"coalesce(aggregate(days, h0, (s, d) -> {_hour_step(cfg)}), h0) AS hour",
        f"coalesce(aggregate(days, w0, (s, d) -> {_wday_step(cfg)}), w0) AS wday",
        "coalesce(size(days), 0) AS days_learned",
    )


def factors(shape: DataFrame, as_of, site_cols=()) -> DataFrame:
    """The shape's hour and weekday multipliers at an instant; neutral when malformed."""
    now = at(as_of)

    def pick(name: str, n: int, index: str) -> str:
        valid = f"CASE WHEN size({name}) = {n} THEN {name} ELSE {_neutral(n)} END"
        return f"element_at({mean_one(valid)}, {index})"

    return shape.selectExpr(*site_cols, f"{pick('hour', 24, f'hour({now}) + 1')} AS hour_factor",
                            f"{pick('wday', 7, f'dayofweek({now})')} AS wday_factor")
