"""The trending score's components as SQL expressions.

Inputs are the columns ``day week month total`` (views), ``age`` (hours), ``actions``,
``momentum``, ``category_heat``, ``shape_factor`` and the state ``prev_ewma prev_score``.
Later expressions use earlier ones by name.
"""

from __future__ import annotations

# Boost by age in hours, first match wins.
FRESHNESS = ((1, 1.8), (3, 1.4), (6, 1.2), (12, 1.1), (24, 1.05))
# Decay rate ln 2 (rounded), half-life and grace in hours.
DECAY_RATE, DECAY_HALF_LIFE, DECAY_GRACE = 0.693, 36.0, 2.0
# Share of a new rate in the smoothed rate, for a half-life of 6 runs.
EWMA_ALPHA = 1.0 - 0.5 ** (1.0 / 6.0)
# Ceiling and scale of the soft cap.
SOFT_CAP, SOFT_SCALE = 10000.0, 5000.0


def num(x: float) -> str:
    return f"{float(x)!r}D"


def clip(x: str, low: float, high: float) -> str:
    return f"greatest({num(low)}, least({num(high)}, {x}))"


WEEKLY, MONTHLY = "(week / 7D)", "(month / 30D)"
_PROGRESS = clip("age / 24D", 0.05, 1.0)

# Day views, or an estimate from longer periods while the day is still empty.
DAY_USED = f"""CASE WHEN day <> 0 THEN day ELSE greatest(1L, CAST(greatest(
    round({WEEKLY} * {_PROGRESS}),
    CASE WHEN month > 0 THEN round(0.3D * {MONTHLY} * {_PROGRESS}) ELSE 0D END) AS BIGINT)) END"""

# Log-scaled views per hour, raised when a period outruns the next longer one.
VELOCITY = f"""ln(1D + day_used / least(age, 24D)) * 10D * (1D
    + CASE WHEN week > 0 AND day_used > {WEEKLY} THEN (day_used / nullif({WEEKLY}, 0D) - 1D) * 0.3D ELSE 0D END
    + CASE WHEN month > 0 AND {WEEKLY} > {MONTHLY} THEN ({WEEKLY} / nullif({MONTHLY}, 0D) - 1D) * 0.2D ELSE 0D END)"""

TIME_DECAY = f"""CASE WHEN age <= {num(DECAY_GRACE)} THEN 1D
    ELSE exp({num(-DECAY_RATE)} * (age - {num(DECAY_GRACE)}) / {num(DECAY_HALF_LIFE)}) END"""

ENGAGEMENT = "1D + least(actions / greatest(5L, day_used) * 10D, 1D)"

FRESHNESS_SQL = "CASE " + " ".join(f"WHEN age <= {a} THEN {num(b)}" for a, b in FRESHNESS) + " ELSE 1D END"

EXPECTED = f"""greatest(0D, {WEEKLY}) * (least(24D, greatest(1D, age)) / 24D) * shape_factor
    * (1D + 0.1D * category_heat)"""

# Variance-stabilised distance of the day's views from what was expected.
UPLIFT_RAW = "sqrt(greatest(0D, CAST(day AS DOUBLE)) + 0.375D) - sqrt(greatest(0D, expected) + 0.375D)"
UPLIFT = f"1D + {clip('uplift_raw * 0.15D', -0.2, 0.5)}"

RATE = "day / greatest(1D, least(age, 24D))"
# The first run starts from the rate itself.
EWMA_VAL = f"{num(EWMA_ALPHA)} * rate + {num(1 - EWMA_ALPHA)} * coalesce(prev_ewma, rate)"
ACC = clip("ewma_val - coalesce(prev_ewma, rate)", -0.5, 0.5)
EWMA = f"1D + {clip('ln(1D + ewma_val) * 0.15D + acc * 0.1D', -0.2, 0.3)}"

PENALTY = """CASE WHEN day / greatest(1D, greatest(1L, month) / 30D) > 20 THEN 0.9D ELSE 1D END
    * CASE WHEN day / greatest(1D, greatest(1L, total) / 90D) > 50 THEN 0.85D ELSE 1D END"""

CAPPED = f"""least({num(SOFT_CAP)} * (1D - exp(-raw_score / {num(SOFT_SCALE)})),
    coalesce(prev_score * 1.8D + 10D, double('infinity')))"""

FATIGUE = "greatest(0.8D, 1D - greatest(0, streak - 6) * 0.03D)"

COMPONENTS = {
    "day_used": DAY_USED,
    "velocity": VELOCITY,
    "time_decay": TIME_DECAY,
    "engagement": ENGAGEMENT,
    "freshness": FRESHNESS_SQL,
    "expected": EXPECTED,
    "uplift_raw": UPLIFT_RAW,
    "uplift": UPLIFT,
    "rate": RATE,
    "ewma_val": EWMA_VAL,
    "acc": ACC,
    "ewma": EWMA,
    "penalty": PENALTY,
}


def raw_score(weight) -> str:
    """Product of the components; ``weight(name)`` is a component's exponent."""
    def powered(name: str) -> str:
        return name if weight(name) == 1.0 else f"pow({name}, {num(weight(name))})"

    return " * ".join(["velocity", "time_decay", *map(powered, (
        "engagement", "freshness", "momentum", "uplift", "ewma")), "penalty"])


def jaccard(a: str, b: str) -> str:
    """Overlap of two id arrays; 0 when both are empty."""
    return f"size(array_intersect({a}, {b})) / greatest(size(array_union({a}, {b})), 1)"
