import pytest
from pyspark.sql import functions as F

from tests.util import counters_df, dicts, posts_df, terms_df
from viewtide.operators import rank


@pytest.fixture(scope="module")
def data(spark):
    posts = posts_df(spark, [{"post_id": p, "title": f"T{9 - p}", "post_type": "page" if p == 4 else "post",
                              "status": "draft" if p == 5 else "publish", "site": "ab"[p % 2],
                              "thumbnail": "/x.png" if p == 1 else None} for p in range(1, 9)])
    counters = counters_df(spark, [(1, 50, 5, 9), (2, 40, None, 9), (3, 40, 0, 9), (4, 30, 7), (5, 99, 9), (6, 20), (7, 10)])
    terms = terms_df(spark, [(1, "category", 11, "news", "News"), (1, "category", 12, "art", "Art"), (2, "category", 11, "news", "News"),
                             (3, "post_tag", 21, "hot", "Hot"), (6, "category", 12, "art", "Art"), (2, "post_tag", 21, "hot", "Hot")])
    return counters, posts, terms


def ids(df):
    return [r["id"] for r in dicts(df, "rank")]


def test_order_ties_and_paging(data):
    counters, posts, terms = data
    assert ids(rank.top_posts(counters, posts)) == [1, 3, 2, 4, 6]
    assert ids(rank.top_posts(counters, posts, number=0, page=0)) == [1, 3, 2, 4, 6]
    assert ids(rank.top_posts(counters, posts, number=4, page=2)) == [6, 7]
    assert ids(rank.top_posts(counters, posts, "nonsense", number=1)) == [1]
    # A stored zero ranks, a missing key does not.
    assert ids(rank.top_posts(counters, posts, "day")) == [4, 1, 3]
    assert ids(rank.top_posts(counters, posts, "day", post_types=["post"])) == [1, 3]
    assert ids(rank.top_posts(counters, posts, number=1, segment_cols=["site"])) in ([1, 2], [2, 1], [1, 2])


def test_terms(data):
    counters, posts, terms = data

    def run(tax, text):
        return ids(rank.top_posts(counters, posts, tax=tax, terms=text, post_terms=terms))

    assert run("category", "news,art") == [1, 2, 6]
    assert run("category", "News") == [1, 2]
    assert run("category", "12,11") == [1, 2, 6]
    assert run("category", "12,news") == [1, 6]   # first term numeric: all are ids
    assert run("category", "news,12") == [1, 2]   # first term a slug: all are slugs
    assert run("unknown", "news") == run("category", "") == [1, 3, 2, 4, 6]


def test_fields_and_hooks(data):
    counters, posts, terms = data
    rows = dicts(rank.top_posts(counters, posts, post_terms=terms, number=2), "rank")
    assert rows[0]["category"] == "Art" and rows[1]["category"] == ""
    assert rows[0]["thumbnail"] == "/x.png" and rows[1]["thumbnail"] == rank.DEFAULT_THUMBNAIL
    assert rows[0]["type"] == "Post" and rows[0]["views"] == 50
    small = rank.top_posts(counters, posts, fields="minimal", number=1)
    assert small.columns == ["id", "title", "link", "rank"]
    hooked = rank.top_posts(counters, posts, before=lambda df: df.filter("post_id > 1"),
                            item=lambda df: df.withColumn("extra", F.lit(1)), number=1)
    assert dicts(hooked)[0]["id"] == 3 and dicts(hooked)[0]["extra"] == 1


def test_overlay(spark, data):
    counters, posts, terms = data
    trending = spark.createDataFrame([(3, 1, 2.5, 7), (8, 2, 1.0, 1)], "post_id bigint, position int, score double, views_day bigint")
    rows = {r["id"]: r for r in dicts(rank.top_posts(counters, posts, trending=trending))}
    assert (rows[3]["trending"], rows[3]["trending_position"], rows[3]["trending_score"], rows[3]["trending_views"]) == (True, 1, 2.5, 7)
    assert rows[1]["trending"] is False and rows[1]["trending_position"] is None


def test_view_list(data):
    counters, posts, terms = data
    assert ids(rank.view_list(counters, posts, order="ASC")) == [7, 6, 3, 2, 1]
    assert ids(rank.view_list(counters, posts, rng="day")) == [1, 3]
    for other in ("trending", "yesterday", "last_week"):
        assert ids(rank.view_list(counters, posts, rng=other)) == [1, 3, 2, 6, 7]
    assert ids(rank.view_list(counters, posts, orderby="title", order="ASC")) == [7, 6, 3, 2, 1]
    assert ids(rank.view_list(counters, posts, orderby="date", number=2, page=2)) == [3, 2]
    assert ids(rank.view_list(counters, posts, category="news", tag="hot", post_terms=terms)) == [2]
    a, b = (ids(rank.view_list(counters, posts, orderby="rand", seed=s)) for s in (1, 1))
    assert a == b and sorted(a) == [1, 2, 3, 6, 7]


def test_view_list_hooks(data):
    counters, posts, terms = data
    out = rank.view_list(counters, posts, number=2, before=lambda d: d.filter("post_id <> 1"),
                         item=lambda d: d.withColumn("twice", F.col("views") * 2))
    assert ids(out) == [3, 2] and all(r.twice == 2 * r.views for r in out.collect())


def test_tabs_and_post_count(data):
    counters, posts, _ = data
    rows = dicts(rank.ranking_tabs(counters, posts, "total, day,bogus", 2), "tab", "rank")
    assert [(r["tab"], r["rank"], r["id"]) for r in rows] == [("day", 1, 4), ("day", 2, 1), ("total", 1, 1), ("total", 2, 3)]
    got = {r["post_id"]: r["view_text"] for r in dicts(rank.post_count(counters, posts, "day"))}
    assert got[4] == "7" and got[2] == "0" and got[8] == "0"
    assert [r["views"] for r in dicts(rank.post_count(counters, posts, "yesterday", "raw", ids=[5]))] == [99]


def test_top_k_is_not_a_full_sort(data):
    counters, posts, _ = data
    plan = rank.top_posts(counters, posts, fields="minimal")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    seg = rank.top_posts(counters, posts, fields="minimal", segment_cols=["site"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in seg and "Partial" in seg


def test_overlay_marks_listed_rows_only(spark):
    page = spark.createDataFrame([(1,), (2,)], "post_id bigint")
    run = spark.createDataFrame([(1, 3, 9.0, 5), (2, None, 8.0, 4)], "post_id bigint, position int, score double, views_day bigint")
    got = {r.post_id: (r.trending, r.trending_position) for r in rank.overlay_trending(page, run).collect()}
    assert got == {1: (True, 3), 2: (False, None)}
