"""Streams over several arriving files end at the batch result."""

import json
import random

from pyspark.sql import functions as F

from tests.test_ordered import recent_model
from tests.util import at, posts_df, views_df
from viewtide.config import CountingConfig
from viewtide.operators import qualify
from viewtide.sources import tables
from viewtide.streaming import live

DDL = "event_id bigint, post_id bigint, ts timestamp, ip_hash string, client_id string, session_id string"


def arrivals(spark, tmp_path, files=3, n=300):
    """Files in time order, read one per trigger."""
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(4), at(minutes=i * 37), f"h{rnd.randrange(9)}") for i in range(n)]
    df = views_df(spark, rows).withColumns({
        "client_id": F.concat(F.lit("c"), F.col("ip_hash")),
        "session_id": F.concat("ip_hash", F.to_date("ts").cast("string"))})
    step = n // files
    for k in range(files):
        part = df.filter((F.col("event_id") >= k * step) & (F.col("event_id") < (k + 1) * step))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return rows, df, stream


def finish(df, tmp_path, name, mode="update", after=None):
    out = str(tmp_path / name)
    live.write_stream(df, out, str(tmp_path / f"{name}-cp"), mode, after).awaitTermination()
    return out


def test_counters_equal_batch(spark, tmp_path):
    _, df, stream = arrivals(spark, tmp_path)
    for unit in ("day", "week", "month"):
        counted = live.live_months(stream) if unit == "month" else live.live_counters(stream, unit, late="400 days")
        got = live.read_latest(spark, finish(counted, tmp_path, unit), ["range", "period", "post_id"])
        want = df.groupBy(F.lit(unit).alias("range"), F.expr(f"to_date(date_trunc('{unit}', ts - INTERVAL 1 MINUTE))").alias("period"),
                          "post_id").agg(F.count("*").alias("views"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hours_and_totals(spark, tmp_path):
    _, df, stream = arrivals(spark, tmp_path)
    seen = []
    out = finish(live.live_totals(stream), tmp_path, "t", after=lambda batch, i: seen.append((i, batch.count())))
    got = {r.post_id: r.views for r in live.read_latest(spark, out, ["post_id"]).collect()}
    assert got == {r.post_id: r["count"] for r in df.groupBy("post_id").count().collect()}
    assert [i for i, _ in seen] == [0, 1, 2]
    hours = live.read_latest(spark, finish(live.live_hours(stream, "400 days"), tmp_path, "h"), ["hour_start"])
    assert hours.agg(F.sum("views")).first()[0] == df.count()


def test_ip_state_evicts_across_batches(spark, tmp_path):
    rows, _, stream = arrivals(spark, tmp_path)
    cfg = CountingConfig(ip_slots=5, ip_ttl_days=1)
    out = finish(live.dedup_ip_stream(stream, cfg), tmp_path, "ip", "append")
    got = {r.event_id: r.ip_duplicate for r in spark.read.parquet(out).collect()}
    assert got == recent_model(rows, slots=5, days=1) and any(got.values())


def test_viewer_dedup(spark, tmp_path):
    _, df, stream = arrivals(spark, tmp_path)
    for storage in ("local", "session"):
        cfg = CountingConfig(storage=storage)
        out = finish(live.dedup_viewer_stream(stream, cfg, late="400 days"), tmp_path, storage, "append")
        keys = ["client_id" if storage == "local" else "session_id", "post_id"]
        got = sorted(map(tuple, spark.read.parquet(out).select(*keys).collect()))
        assert got == sorted(map(tuple, qualify.dedup_viewer(df, cfg).select(*keys).collect()))


def test_ingest_json_feed(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    for k in range(3):
        lines = [{"request_id": f"{k}{i}", "ts": f"2024-01-0{k + 1}T00:00:00Z", "post_id": [i, 1], "headers": {"REMOTE_ADDR": "1.2.3.4"}}
                 for i in range(4)]
        (tmp_path / "feed" / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
    reqs = tables.stream_view_requests(spark, str(tmp_path / "feed"), maxFilesPerTrigger="1")
    posts = posts_df(spark, [{"post_id": 1}, {"post_id": 2}, {"post_id": 3, "status": "draft"}])
    out = finish(live.ingest_stream(reqs, posts, CountingConfig(batch=1)), tmp_path, "views", "append")
    rows = spark.read.parquet(out).collect()
    assert sorted((r.request_id, r.post_id) for r in rows) == [(f"{k}{i}", i) for k in range(3) for i in (1, 2)]
    assert {r.ip_hash for r in rows} == {"fwcbc5"}


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    for k, rows in enumerate(([(1, 1, at(days=1, hours=9))], [(2, 1, at(days=3, hours=9))],
                              [(3, 1, at(days=1, hours=9)), (4, 1, at(days=3, hours=9))])):
        views_df(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    schema = views_df(spark, []).schema
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    import shutil
    for k in range(3):  # one file a run, so that the watermark moves between them
        (tmp_path / "all").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("part-*.parquet"):
            shutil.copy(f, tmp_path / "all" / f"{k}-{f.name}")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "all"))
        live.write_stream(live.live_counters(stream, "day", late="1 hour"), out, cp).awaitTermination()
    got = {str(r.period): r.views for r in live.read_latest(spark, out, ["range", "period", "post_id"]).collect()}
    assert got == {"2024-01-02": 1, "2024-01-04": 2}


def test_views_of_some_days_open_only_their_folders(spark, tmp_path):
    rows = [(i, 1, at(hours=7 * i)) for i in range(40)]
    tables.write_views(views_df(spark, rows), str(tmp_path / "log"))
    some = tables.read_views(spark, str(tmp_path / "log"), "2024-01-05 00:00:30", "2024-01-07 00:01:00")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_day" in plan
    want = [i for i, _, t in rows if at(days=4, seconds=30) <= t < at(days=6, minutes=1)]
    assert sorted(r.event_id for r in some.collect()) == want
    assert tables.read_views(spark, str(tmp_path / "log")).count() == 40


def test_ip_check_in_event_order_with_expiry_and_late_rows(spark, tmp_path, monkeypatch):
    """Rows of four files, some behind others: evicted visitors, a list that expires, one row too late."""
    from viewtide.session import STREAM_DEFAULTS

    rnd = random.Random(6)
    rows = [(i, 1, at(minutes=i * 11), f"h{rnd.randrange(9)}") for i in range(200)]
    rows += [(1000 + i, 1, at(days=40, minutes=i * 7), f"h{rnd.randrange(9)}") for i in range(60)]  # the list of post 1 expires
    rows += [(2000 + i, 2, at(minutes=i * 90), f"h{i % 6}") for i in range(300)]  # more visitors than slots, in turn
    behind = {r[0] for r in rows if r[0] % 9 == 4}
    seen = sorted(rows, key=lambda r: r[2] + (at(hours=1) - at(hours=0)) * (r[0] in behind))
    files = [seen[k * 140:(k + 1) * 140] for k in range(4)] + [[(-1, -1, at(days=900), None)]]
    for part in files:
        views_df(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lost = (9999, 2, at(minutes=1), "h0")  # a year behind: dropped
    views_df(spark, [lost, (-2, -1, at(days=901), None)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(views_df(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cfg = CountingConfig(ip_slots=5, ip_ttl_days=10)
    before = {k: spark.conf.get(k) for k in STREAM_DEFAULTS}
    try:
        for k, v in STREAM_DEFAULTS.items():
            spark.conf.set(k, v)
        out = finish(live.dedup_ip_in_order(stream, "3 hours", cfg), tmp_path, "order", "append")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r.event_id: r.ip_duplicate for r in spark.read.parquet(out).collect() if r.event_id >= 0}
    want = recent_model(rows, slots=5, days=10)
    assert got == want and {True, False} == set(want.values())
    arrival = recent_model([(e, p, at(minutes=k), h) for k, (e, p, _, h) in enumerate(seen)], slots=5, days=10)
    assert arrival != want  # the order of arrival gives other tags


def test_rows_wait_in_few_entries_of_the_state(spark):
    """25,000 rows of one post are a few entries in the store, and come out in time order."""
    import pandas as pd
    from pyspark.sql import types as T

    from viewtide.operators.ordered import RecentFold

    class State:
        def __init__(self):
            self.entries = []

        def exists(self):
            return bool(self.entries)

        def get(self):
            return iter(list(self.entries))

        def appendValue(self, value):
            self.entries.append(value)

        def appendList(self, values):
            self.entries += values

        def clear(self):
            self.entries = []

    class Value(State):
        def get(self):
            return self.entries[-1]

        update = State.appendValue

    class Handle:
        timers, lists, values = [], State(), Value()
        getListState = lambda self, name, schema: self.lists
        getValueState = lambda self, name, schema: self.values
        registerTimer = lambda self, at: self.timers.append(at)

    class Watermark:
        getCurrentWatermarkInMs = lambda self: 20_000

    names = ["event_id", "post_id", "ip_hash", "__t"]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "ip_hash" else T.LongType()) for n in names])
    check, handle = live._InEventOrder(RecentFold(5, 10**12), names, schema), Handle()
    check.init(handle)
    rnd = random.Random(3)
    rows = [(i, 1, rnd.choice([None, *"abcdefghij"]), rnd.randrange(25_000) * 1000) for i in range(25_000)]
    parts = [pd.DataFrame(rows[k:k + 10_000], columns=names) for k in range(0, len(rows), 10_000)]
    list(check.handleInputRows((1,), iter(parts), None))
    assert len(handle.lists.entries) <= 5
    out = pd.concat(check.handleExpiredTimer((1,), Watermark(), None))
    due = sorted((r for r in rows if r[3] < 20_000_000), key=lambda r: (r[3], r[0]))
    fold = RecentFold(5, 10**12)
    tags = fold.run(fold.start((), None), [r[2] for r in due], [r[3] for r in due])
    assert [tuple(r) for r in out.itertuples(index=False)] == [(*r, tag) for r, tag in zip(due, tags)]
    assert len(handle.lists.entries) <= 3 and sum(len(c[0]) for c in handle.lists.entries) == len(rows) - len(due)


def test_arrivals_of_many_files_are_the_same_micro_batches(spark, monkeypatch, tmp_path):
    import os

    import pandas as pd

    from catalog import queries

    ts = [pd.Timestamp("2024-01-02"), pd.Timestamp("2024-01-17"), pd.Timestamp("2024-01-25")]  # no row in the second part
    rows = pd.DataFrame([(k, ts[k % 3] + pd.Timedelta(minutes=k), k % 7, "view", 1.0, f'{{"k": {k % 4}}}') for k in range(300)],
                        columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "FILE_ROWS", 20)
    stream = queries._arrivals(spark, str(tmp_path), ["event_id", "post_id"], late_rows=False)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    live.write_stream(stream, out, checkpoint, "append").awaitTermination()
    got = {k: sorted(r.event_id for r in spark.read.parquet(f"{out}/batch_id={k}").collect()) if os.path.exists(
        f"{out}/batch_id={k}") else None for k in range(5)}
    assert got == {0: list(range(0, 300, 3)), 1: [], 2: list(range(1, 300, 3)), 3: list(range(2, 300, 3)), 4: None}
    tagged = queries.stream_ip_in_order(spark, str(tmp_path))
    assert sorted(r.event_id for r in tagged.collect()) == list(range(300))


def test_snapshot_keeps_as_many_folders_as_buckets(spark, tmp_path):
    path, held = str(tmp_path / "snap"), {}
    schema = "post_id bigint, views bigint"
    assert live.read_snapshot(spark, path, schema).count() == 0
    for version in range(7):
        batch = {i: version * 100 + i for i in range(version * 3, version * 3 + 5)}
        df = spark.createDataFrame(list(batch.items()), schema)
        live.merge_snapshot(df, path, version, ["post_id"], buckets=4)
        live.merge_snapshot(spark.createDataFrame([(0, -1)], schema), path, version, ["post_id"], buckets=4)  # tried again
        held.update(batch)
        now = live.read_snapshot(spark, path, schema)
        assert {r.post_id: r.views for r in now.collect()} == held and now.count() == len(held)
        opened = {f.rsplit("/", 1)[0] for f in now.inputFiles()}
        assert len(opened) <= 4
    kept = {str(p) for p in (tmp_path / "snap").glob("version=*/bucket=*")}
    assert len(kept) <= 8 and not list((tmp_path / "snap").glob("batch=*"))  # the last version and the one before


def test_a_log_is_read_by_the_offset_it_was_written_with(spark, tmp_path):
    import pytest

    rows = [(1, 1, at(days=4, minutes=3)), (2, 1, at(days=4, minutes=1)), (3, 1, at(days=4, minutes=7))]
    path = str(tmp_path / "log")
    tables.write_views(views_df(spark, rows), path, offset=5)
    got = tables.read_views(spark, path, "2024-01-05 00:02:00", "2024-01-05 00:08:00")
    assert sorted(r.event_id for r in got.collect()) == [1, 3]
    with pytest.raises(ValueError, match="5 minutes past midnight, not 1"):
        tables.read_views(spark, path, offset=1)
    with pytest.raises(ValueError, match="not 2"):
        tables.write_views(views_df(spark, rows), path, offset=2)
    tables.write_views(views_df(spark, rows), path)  # takes the log's own
    assert tables.read_views(spark, path, "2024-01-05 00:02:00").count() == 4
