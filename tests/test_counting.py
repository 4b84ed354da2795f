import json
import math

from pyspark.sql import functions as F

from tests.util import at, dicts, posts_df
from viewtide.config import CountingConfig
from viewtide.operators import qualify
from viewtide.plans import counting
from viewtide.sources import tables


def requests_df(spark, rows):
    ddl = "event_id bigint, post_ids array<bigint>, minute int, ip string"
    df = spark.createDataFrame(rows, ddl)
    return df.selectExpr("CAST(event_id AS STRING) AS request_id", "event_id",
                         "timestamp'2024-01-01' + make_dt_interval(0, 0, minute) AS ts", "post_ids",
                         "map('REMOTE_ADDR', ip) AS headers")


POSTS = [{"post_id": 1}, {"post_id": 2, "post_type": "page"}, {"post_id": 3, "status": "draft"}, {"post_id": 5}]


def test_gate_order_and_results(spark):
    cfg = CountingConfig(batch=3, strict_ip=True)
    reqs = requests_df(spark, [
        (1, [1, 1, 2, 5], 0, "1.1.1.1"),   # same id twice: second is a recent address; 5 is cut by the cap
        (2, [-5, 0, 3], 1, "1.1.1.1"),     # sign dropped; zero and draft invalid
        (3, [9, 1], 2, "2.2.2.2"),         # unknown post
        (4, [1], 3, "6.6.6.6"),            # refused by the site's rule, but its address is now listed
        (5, [1], 4, "6.6.6.6"),
    ])
    rows = dicts(counting.count_requests(reqs, posts_df(spark, POSTS), cfg,
                                         should_count=~F.col("ip").startswith("6.")), "request_id", "slot")
    got = [(int(r["request_id"]), r["post_id"], r["reason"], r["total"], r["day"]) for r in rows]
    assert got == [
        (1, 1, None, 1, 1), (1, 1, "ip_duplicate", None, None), (1, 2, "not enabled", None, None),
        (2, 5, None, 1, 1), (2, 0, "invalid", None, None), (2, 3, "invalid", None, None),
        (3, 9, "invalid", None, None), (3, 1, None, 2, 1),  # the first view, at 00:00, was on the day before
        (4, 1, "skipped", None, None), (5, 1, "ip_duplicate", None, None),
    ]
    assert rows[0]["total_formatted"] == rows[0]["total_short"] == "1"


def test_no_dedup_without_address_check(spark):
    reqs = requests_df(spark, [(1, [1, 1], 0, "1.1.1.1")])
    rows = dicts(counting.count_requests(reqs, posts_df(spark, POSTS), CountingConfig(batch=2, enable_week=False)), "slot")
    assert [r["total"] for r in rows] == [1, 2]
    assert "week" not in rows[0]
    views = counting.accepted_views(reqs, posts_df(spark, POSTS), CountingConfig(batch=2))
    assert views.columns == ["event_id", "post_id", "ts", "ip_hash"] and views.count() == 2


def test_requests_from_mixed_json(spark, tmp_path):
    lines = [{"request_id": "a", "ts": "2024-01-01T00:00:00Z", "post_id": 7, "headers": {"REMOTE_ADDR": "1.2.3.4"}},
             {"request_id": "b", "ts": "2024-01-01T00:01:00Z", "post_id": [3, "12x", "x", "-4"], "headers": {}},
             {"request_id": "c", "ts": "2024-01-01T00:02:00Z", "post_id": "8", "headers": None}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    reqs = tables.read_view_requests(spark, str(tmp_path))
    rows = qualify.request_views(reqs, CountingConfig(batch=9)).orderBy("request_id", "slot").collect()
    assert [(r.request_id, r.post_id, r.ip) for r in rows] == [
        ("a", 7, "1.2.3.4"), ("b", 3, "127.0.0.1"), ("b", 12, "127.0.0.1"), ("b", 0, "127.0.0.1"),
        ("b", 4, "127.0.0.1"), ("c", 8, "127.0.0.1")]


def test_qualify(spark):
    rows = [(1, 15000, 75.0), (2, 14999, 90.0), (3, 20000, 74.9), (4, 20000, math.nan), (5, 20000, None)]
    df = spark.createDataFrame(rows, "event_id bigint, dwell_ms bigint, scroll_pct double")
    ids = lambda cfg: sorted(r[0] for r in qualify.qualify_views(df, cfg).collect())
    assert ids(CountingConfig()) == [1]
    assert ids(CountingConfig(scroll_enabled=False)) == [1, 3, 4, 5]
    assert ids(CountingConfig(delay_ms=0, scroll_pct=80)) == [2]


def test_viewer_dedup_scopes(spark):
    rows = [(1, "c", "c-1", 9, at()), (2, "c", "c-1", 9, at(minutes=1)), (3, "c", "c-2", 9, at(days=1)),
            (4, "d", "d-1", 9, at()), (5, "c", "c-1", 8, at())]
    df = spark.createDataFrame(rows, "event_id bigint, client_id string, session_id string, post_id bigint, ts timestamp_ntz")
    ids = lambda s: sorted(r.event_id for r in qualify.dedup_viewer(df, CountingConfig(storage=s)).collect())
    assert ids("session") == [1, 3, 4, 5]
    assert ids("local") == [1, 4, 5]


def test_view_log_is_partitioned_by_counting_day(spark, tmp_path):
    reqs = requests_df(spark, [(1, [1], 0, "1.1.1.1"), (2, [1], 1, "1.1.1.1"), (3, [1], 1441, "1.1.1.1")])
    views = counting.accepted_views(reqs, posts_df(spark, POSTS))
    tables.write_views(views, str(tmp_path / "log"))
    days = {str(r.site_day): r["count"] for r in spark.read.parquet(str(tmp_path / "log")).groupBy("site_day").count().collect()}
    assert days == {"2023-12-31": 1, "2024-01-01": 1, "2024-01-02": 1}


def test_a_request_without_ids_is_answered(spark):
    from viewtide.operators.qualify import request_views

    for kind in ("bigint", "string"):
        df = spark.createDataFrame([(1, None, {"REMOTE_ADDR": "1.2.3.4"})], f"event_id bigint, post_ids array<{kind}>, headers map<string,string>")
        assert [(r.slot, r.post_id) for r in request_views(df).collect()] == [(0, 0)]
