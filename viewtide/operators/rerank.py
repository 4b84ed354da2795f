"""Greedy re-ranking of one segment's scored posts.

The steps are sequential by nature and their input is small: at most ``limit`` candidates
per segment leave the group limit upstream. Segments run in parallel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.config import TrendingConfig
from viewtide.functions.calendar import instant
from viewtide.functions.transport import ddl, pack_times, unpack_times


def overlap(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def mmr(scores: list[float], terms: list[frozenset], lam: float, size: int) -> list[int]:
    """Indexes picked by relevance minus similarity to what is already picked. Each
    candidate's worst similarity is kept up to date instead of recomputed."""
    left = list(range(len(scores)))
    nearest = [0.0] * len(scores)
    picked: list[int] = []
    while left and len(picked) < size:
        best = max(left, key=lambda i: lam * scores[i] - (1 - lam) * nearest[i] * scores[i])
        picked.append(best)
        left.remove(best)
        for i in left:
            nearest[i] = max(nearest[i], overlap(terms[i], terms[best]))
    return picked


def explore(order: list[int], promise: list[float], cfg: TrendingConfig, draw: float, place: int) -> list[int]:
    """With probability epsilon, insert the most promising of the leading posts."""
    if draw > cfg.epsilon:
        return order
    pool = range(min(cfg.explore_pool, len(promise)))
    picks = sorted(pool, key=lambda i: -promise[i])[: cfg.explore_picks]
    at = min(len(order), max(5, place))
    return list(dict.fromkeys([*order[:at], *picks, *order[at:]]))[: cfg.top_size]


def diversify(order: list[int], authors: list, categories: list, cfg: TrendingConfig) -> list[int]:
    """Posts within the author and category quotas first, the rest after, in order. A quota
    that could not fill the list is lifted."""
    size = cfg.top_size

    def quota(each: int, distinct: int) -> int:
        return size if distinct * each < size else each

    per_author = quota(cfg.max_per_author, len({authors[i] for i in order}))
    per_category = quota(cfg.max_per_category, len({c for i in order for c in categories[i]}))
    used_author: dict = {}
    used_category: dict = {}
    within = []
    for i in order:
        full = used_author.get(authors[i], 0) >= per_author or \
            any(used_category.get(c, 0) >= per_category for c in categories[i])
        if full or len(within) >= size:
            continue
        within.append(i)
        used_author[authors[i]] = used_author.get(authors[i], 0) + 1
        for c in categories[i]:
            used_category[c] = used_category.get(c, 0) + 1
    held = set(within)
    return [*within, *(i for i in order if i not in held)][:size]


def _positions(order: list[int], n: int) -> pa.Array:
    at = {i: p for p, i in enumerate(order, start=1)}
    return pa.array([at.get(i) for i in range(n)], pa.int32())


def rerank(ranked: DataFrame, as_of, cfg: TrendingConfig = TrendingConfig()) -> DataFrame:
    """Add ``mmr_position``, ``explore_position`` and the final ``position`` (NULL when out).

    The exploration draw is a hash of segment, run and seed, so a rerun repeats it.
    """
    now = instant(as_of)

    def drawn(salt: str, fixed, low: int, modulus: int, scale: float):
        if fixed is not None:
            return F.lit(float(fixed))
        return (F.pmod(F.xxhash64("segment", now, F.lit(cfg.seed), F.lit(salt)), F.lit(modulus)) + low) / F.lit(scale)

    rows = ranked.withColumns({
        "explore_draw": drawn("draw", cfg.explore_draw, 0, 1_000_001, 1_000_000.0),
        "explore_place": drawn("place", cfg.explore_pos, 5, 6, 1.0).cast("int"),
    })
    packed = pack_times(rows)

    def one_segment(table: pa.Table) -> pa.Table:
        table = table.sort_by("score_rank")
        col = {c: table.column(c).to_pylist() for c in (
            "score", "categories", "tags", "author_id", "uplift", "ewma", "explore_draw", "explore_place")}
        n = table.num_rows
        terms = [frozenset(c) | frozenset(t) for c, t in zip(col["categories"], col["tags"])]
        promise = [round(u, 4) * round(e, 4) for u, e in zip(col["uplift"], col["ewma"])]
        by_mmr = mmr(col["score"], terms, cfg.mmr_lambda, cfg.top_size)
        explored = explore(by_mmr, promise, cfg, col["explore_draw"][0], col["explore_place"][0])
        final = diversify(explored, col["author_id"], col["categories"], cfg)
        for name, order in (("mmr_position", by_mmr), ("explore_position", explored), ("position", final)):
            table = table.append_column(name, _positions(order, n))
        return table

    placed = packed.groupBy("segment").applyInArrow(
        one_segment, f"{ddl(packed)}, mmr_position int, explore_position int, position int")
    return unpack_times(placed, rows)
