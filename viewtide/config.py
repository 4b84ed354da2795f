"""Settings for every job. A job takes one frozen dataclass and reads no globals."""

from __future__ import annotations

from dataclasses import dataclass, field

# The counter ranges, in list order.
RANGES = ("total", "day", "week", "month", "yesterday", "last_week", "last_month")
LIVE_RANGES = ("total", "day", "week", "month")
ARCHIVE_OF = {"yesterday": "day", "last_week": "week", "last_month": "month"}

# Request headers that may carry the client address, by priority.
IP_HEADERS = (
    "HTTP_CF_CONNECTING_IP",
    "HTTP_X_FORWARDED_FOR",
    "HTTP_X_FORWARDED",
    "HTTP_X_CLUSTER_CLIENT_IP",
    "HTTP_CLIENT_IP",
    "HTTP_X_REAL_IP",
    "REMOTE_ADDR",
)


@dataclass(frozen=True)
class CountingConfig:
    """How views are qualified, accepted, counted and rolled over."""

    batch: int = 1
    post_types: tuple[str, ...] = ("post",)
    delay_ms: int = 15000
    scroll_pct: float = 75.0
    scroll_enabled: bool = True
    storage: str = "session"  # or "local"
    strict_ip: bool = False
    ip_slots: int = 75
    ip_ttl_days: int = 14
    enable_day: bool = True
    enable_week: bool = True
    enable_month: bool = True
    rollover_minutes: int = 1  # the reset job runs this long after midnight
    public_types: tuple[str, ...] = ("post", "page")

    def enabled(self, rng: str) -> bool:
        base = ARCHIVE_OF.get(rng, rng)
        return base == "total" or getattr(self, f"enable_{base}")


@dataclass(frozen=True)
class ShapeConfig:
    """Constants of the hour-of-day and day-of-week traffic learner."""

    collect: bool = True
    min_daily: int = 200
    alpha_hour: float = 0.25
    kappa_hour: int = 48
    alpha_wday: float = 0.20
    kappa_wday: int = 14
    low: float = 0.2
    high: float = 5.0
    # The reset job empties today's bins when it runs, so views between midnight
    # and the job are not part of any day's bins.
    skip_minutes: int = 1


@dataclass(frozen=True)
class TrendingConfig:
    """Constants of the hourly trending job."""

    enabled: bool = True
    post_types: tuple[str, ...] = ("post",)
    limit: int = 100
    min_count: int = 20
    list_weights: dict = field(
        default_factory=lambda: {"day": 1.0, "week": 0.6, "month": 0.3, "total": 0.15}
    )
    day_bonus: float = 0.02
    weights: dict = field(
        default_factory=lambda: {
            "engagement": 1.0,
            "freshness": 1.0,
            "momentum": 1.0,
            "uplift": 1.0,
            "ewma": 1.0,
            "fatigue": 1.0,
            "explore": 1.0,
        }
    )
    hot_hours: int = 24
    hot_posts: int = 100
    top_size: int = 20
    debug_size: int = 50
    mmr_lambda: float = 0.75
    max_per_author: int = 2
    max_per_category: int = 3
    ewma_ttl_hours: float = 12.0
    score_ttl_hours: float = 6.0
    streak_ttl_hours: float = 8.0
    explore_pool: int = 50
    explore_picks: int = 2
    seed: int = 0
    explore_draw: float | None = None  # fixed draw in [0, 1] instead of the hash draw
    explore_pos: int | None = None  # fixed insert position 5..10

    def types(self) -> tuple[str, ...]:
        kept = tuple(dict.fromkeys(t for t in self.post_types if t and t != "attachment"))
        return kept or ("post",)

    def weight(self, name: str) -> float:
        return float(self.weights.get(name, 1.0))

    @property
    def epsilon(self) -> float:
        return min(0.25, max(0.0, 0.05 * self.weight("explore")))
