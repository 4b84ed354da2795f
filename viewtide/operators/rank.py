"""Rankings over counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewtide.config import RANGES
from viewtide.functions.text import count_text

DEFAULT_THUMBNAIL = "/thumbnail"  # for posts that have none


def counter_of(rng: str, allowed=RANGES) -> str:
    """Unknown ranges fall back to the total."""
    return rng if rng in allowed else "total"


def slugify(text: str) -> str:
    return "-".join(text.strip().lower().split())


def in_terms(df: DataFrame, post_terms: DataFrame, taxonomy: str, terms: list[str]) -> DataFrame:
    """Keep posts that have any of the terms. The first term decides whether all of them
    are ids or slugs."""
    wanted = post_terms.filter(F.col("taxonomy") == taxonomy)
    if terms[0].replace(".", "", 1).isdigit():
        ids = [int(float(t)) if t.replace(".", "", 1).isdigit() else 0 for t in terms]
        wanted = wanted.filter(F.col("term_id").isin(ids))
    else:
        wanted = wanted.filter(F.col("slug").isin(terms))
    return df.join(wanted.select("post_id"), "post_id", "left_semi")


def filter_terms(df: DataFrame, post_terms: DataFrame | None, tax: str | None, terms: str | None,
                 taxonomies=("category", "post_tag")) -> DataFrame:
    """Comma-list filter; skipped when the taxonomy is unknown or there are no terms."""
    if post_terms is None or not tax or tax not in taxonomies or not terms:
        return df
    return in_terms(df, post_terms, tax, [slugify(t) for t in terms.split(",")])


def listed(counters: DataFrame, posts: DataFrame, value: str, post_types, more=()) -> DataFrame:
    """Published posts of the given types that hold the counter, with narrow columns only."""
    held = counters.filter(F.col(value).isNotNull()).select("post_id", F.col(value).alias("views"))
    dim = posts.filter((F.col("status") == "publish") & F.col("post_type").isin(list(post_types)))
    return held.join(dim.select("post_id", *more), "post_id")


def page_of(df: DataFrame, order: list[Column], number: int, page: int, segment_cols=()) -> DataFrame:
    """Rows of one page with their 1-based ``rank``, per segment when segments are given.

    Without segments the page is a bounded top-k, so the numbering window sees at most
    ``number * page`` rows.
    """
    skip = (page - 1) * number
    if not segment_cols:
        df = df.orderBy(*order).limit(skip + number)
    # The constant key keeps the window partitioned; its input is already bounded.
    keys = list(segment_cols) or [F.lit(0)]
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter((F.col("rank") > skip) & (F.col("rank") <= skip + number))


def describe(page: DataFrame, posts: DataFrame, post_terms: DataFrame | None, fields: str,
             category_taxonomy: str = "category") -> DataFrame:
    """Attach display columns to a page. Wide post columns are read only here, against the
    few ranked ids."""
    shown = {
        "title": F.col("title"),
        "link": F.col("link"),
    }
    if fields != "minimal":
        shown |= {
            "excerpt": F.col("excerpt"),
            "thumbnail": F.coalesce("thumbnail", F.lit(DEFAULT_THUMBNAIL)),
            "post_type": F.col("post_type"),
            "date": F.to_date("published_at"),
        }
    wide = posts.select("post_id", *[c.alias(f"__{n}") for n, c in shown.items()])
    keep = [c for c in page.columns if c not in shown]
    out = page.select(*keep).join(wide, "post_id").select(*keep, *[F.col(f"__{n}").alias(n) for n in shown])
    if fields == "minimal":
        return out
    out = out.withColumn("type", F.initcap("post_type"))
    if post_terms is None:
        return out.withColumn("category", F.lit(""))
    names = (post_terms.filter(F.col("taxonomy") == category_taxonomy)
             .join(page.select("post_id"), "post_id", "left_semi")
             .groupBy("post_id").agg(F.min("name").alias("category")))
    return out.join(names, "post_id", "left").withColumn("category", F.coalesce("category", F.lit("")))


def overlay_trending(page: DataFrame, trending: DataFrame) -> DataFrame:
    """Mark ranked posts that are in the stored trending list, with its stored order. Rows
    of a run that are not on the list (no position) mark nothing."""
    marks = trending.filter(F.col("position").isNotNull()).select("post_id", F.lit(True).alias("trending"),
                            F.col("position").alias("trending_position"),
                            F.col("score").alias("trending_score"),
                            F.col("views_day").alias("trending_views"))
    return page.join(marks, "post_id", "left").withColumn("trending", F.coalesce("trending", F.lit(False)))


def _minimal(df: DataFrame, keep=()) -> DataFrame:
    return df.select(F.col("post_id").alias("id"), "title", "link", "rank", *keep)


def top_posts(counters: DataFrame, posts: DataFrame, rng: str = "total", number: int = 5, page: int = 1,
              post_types=("post", "page"), tax: str | None = None, terms: str | None = None,
              post_terms: DataFrame | None = None, fields: str = "full", trending: DataFrame | None = None,
              segment_cols=(), before: Callable | None = None, item: Callable | None = None) -> DataFrame:
    """One page of the most viewed posts. ``before`` sees the candidates, ``item`` the page."""
    number, page = abs(number) or 5, max(1, abs(page))
    value = counter_of(rng)
    rows = listed(counters, posts, value, post_types, segment_cols)
    rows = filter_terms(rows, post_terms, tax, terms)
    if before:
        rows = before(rows)
    ranked = page_of(rows, [F.desc("views"), F.desc("post_id")], number, page, segment_cols)
    full = describe(ranked, posts, post_terms, fields)
    if fields == "minimal":
        return _minimal(full, segment_cols)
    if trending is not None:
        full = overlay_trending(full, trending)
    full = full.withColumnRenamed("post_id", "id")
    return item(full) if item else full


def view_list(counters: DataFrame, posts: DataFrame, number: int = 10, post_type: str = "post",
              orderby: str = "meta_value_num", order: str = "DESC", rng: str = "total",
              category: str = "", tag: str = "", page: int = 1, post_terms: DataFrame | None = None,
              seed: int = 0, before: Callable | None = None, item: Callable | None = None) -> DataFrame:
    """Most-viewed list with a choice of order. Only day / week / month pick their own
    counter; every other range lists by total. ``before`` sees the candidates, ``item`` the
    page."""
    value = counter_of(rng, ("day", "week", "month"))
    keys = {"date": "published_at", "title": "title"}
    more = [keys[orderby]] if orderby in keys else []
    rows = listed(counters, posts, value, [post_type], more)
    for taxonomy, slug in (("category", category), ("post_tag", tag)):
        if slug:
            held = post_terms.filter((F.col("taxonomy") == taxonomy) & (F.col("slug") == slugify(slug)))
            rows = rows.join(held.select("post_id"), "post_id", "left_semi")
    if before:
        rows = before(rows)
    if orderby == "rand":
        by = F.xxhash64(F.lit(seed), "post_id")  # a fixed shuffle per seed
    else:
        by = F.col(keys.get(orderby, "views"))
    up = order.upper() == "ASC"
    ranked = page_of(rows, [by.asc() if up else by.desc(), F.desc("post_id")], abs(number), max(1, abs(page)))
    full = describe(ranked, posts, post_terms, "full").withColumnRenamed("post_id", "id")
    return item(full) if item else full


def ranking_tabs(counters: DataFrame, posts: DataFrame, tabs="total,day,week,month", number: int = 5,
                 post_types=("post", "page")) -> DataFrame:
    """Several rankings at once, one per known tab. Group limits keep ``number`` rows per
    tab and task before the shuffle."""
    names = list(dict.fromkeys(t.strip() for t in tabs.split(","))) if isinstance(tabs, str) else list(tabs)
    known = [t for t in names if t in RANGES]
    dim = posts.filter((F.col("status") == "publish") & F.col("post_type").isin(list(post_types)))
    rows = counters.join(dim.select("post_id"), "post_id", "left_semi")
    long = rows.select("post_id", *known).unpivot("post_id", known, "tab", "views").filter("views IS NOT NULL")
    best = W.partitionBy("tab").orderBy(F.desc("views"), F.desc("post_id"))
    top = long.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= (number or 5))
    if len(known) * (number or 5) <= 100_000:
        top = F.broadcast(top)  # that many rows at most
    shown = posts.select("post_id", "title", "link")
    return shown.join(top, "post_id").select("tab", "rank", F.col("post_id").alias("id"), "title", "link", "views")


def post_count(counters: DataFrame, posts: DataFrame, field: str = "total", fmt: str = "formatted",
               ids=None, locale: str = "en_US") -> DataFrame:
    """Counter text of posts; a missing counter shows 0."""
    value = counter_of(field, ("day", "week", "month"))
    dim = posts.select("post_id", "published_at")
    if ids is not None:
        dim = dim.filter(F.col("post_id").isin(list(ids)))
        counters = counters.filter(F.col("post_id").isin(list(ids)))
    n = F.coalesce(F.col(value), F.lit(0))
    return dim.join(counters.select("post_id", value), "post_id", "left").select(
        "post_id", n.alias("views"), count_text(n, fmt, locale).alias("view_text"), "published_at")


