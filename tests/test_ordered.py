"""Distributed ordered work against plain sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from tests.util import at, dicts, views_df
from viewtide.config import CountingConfig
from viewtide.operators import ipdedup, qualify
from viewtide.operators.counters import running_counts
from viewtide.operators.ordered import positions


def recent_model(rows, slots=75, days=14):
    lists, out = {}, {}
    for event, post, ts, h in sorted(rows, key=lambda r: (r[2], r[0])):
        held, last = lists.get(post, ([], None))
        if last is not None and (ts - last).total_seconds() > days * 86400:
            held = []
        if h in held:
            out[event] = True
        else:
            held = [h, *held][:slots]
            last = ts
            out[event] = False
        lists[post] = (held, last)
    return out


def flush_model(rows, batch):
    queues, out = {}, []
    for event, client, ts, post in sorted(rows, key=lambda r: (r[2], r[0])):
        q = queues.setdefault(client, [])
        if post not in q:
            q.append(post)
        if len(q) >= batch:
            out += [(client, p, ts, i) for i, p in enumerate(q)]
            queues[client] = []
    return sorted(out)


def tags(spark, rows, cfg=CountingConfig(), **kw):
    return {r.event_id: r.ip_duplicate for r in ipdedup.dedup_recent_ip(views_df(spark, rows), cfg, **kw).collect()}


def test_eviction_after_75_others(spark):
    rows = [(i, 1, at(minutes=i), f"h{i}") for i in range(76)] + [(76, 1, at(minutes=76), "h0")]
    assert not any(tags(spark, rows).values())


def test_duplicate_does_not_refresh_its_place(spark):
    rows = [(i, 1, at(minutes=i), f"h{i}") for i in range(75)]
    rows += [(75, 1, at(minutes=75), "h0"), (76, 1, at(minutes=76), "new"), (77, 1, at(minutes=77), "h0")]
    got = tags(spark, rows)
    assert got[75] and not got[76] and not got[77]


def test_lifetime_is_renewed_by_inserts_only(spark):
    rows = [(0, 1, at(), "a"), (1, 1, at(days=13), "a"), (2, 1, at(days=15), "a"), (3, 1, at(days=28), "b"),
            (4, 1, at(days=42), "a"), (5, 1, at(days=42, minutes=1), "a"), (6, 1, at(days=60), "a")]
    got = tags(spark, rows)
    assert [got[i] for i in range(7)] == [False, True, False, False, True, False, False]
    assert got == recent_model(rows)


def stream_of(kind, seed, n=240):
    """Traffic on few hot posts: random visitors, a cycle just over the list size, bursts, long gaps."""
    rnd = random.Random(seed)
    rows, minute = [], 0
    for i in range(n):
        minute += rnd.choice([0, 0, 1, 3]) if kind != "gaps" else rnd.choice([1, 60, 60 * 24 * 3, 60 * 24 * 9])
        who = {"cycle": i % 7, "few": rnd.randrange(4), "random": rnd.randrange(12), "gaps": rnd.randrange(9),
               "phased": i % 7 if i > n // 2 else i % 3}[kind]
        rows.append((i, rnd.choice([1, 1, 1, 2]) if kind != "cycle" else 1, at(minutes=minute), f"v{who}"))
    return rows


@pytest.mark.parametrize("kind", ["cycle", "few", "random", "gaps", "phased"])
def test_chunked_fold_equals_sequential(spark, kind):
    """Hot posts cut into many chunks give the sequential result, also when a chunk's end
    depends on its start all the way through (a cycle one longer than the list)."""
    rows = stream_of(kind, seed=len(kind))
    cfg = CountingConfig(ip_slots=6)
    want = recent_model(rows, slots=6)
    assert tags(spark, rows, cfg) == want
    assert tags(spark, rows, cfg, chunk_rows=40) == want


def test_fold_keeps_large_ids_and_extra_columns(spark):
    big = 2**60
    df = views_df(spark, [(big + 1, 1, at(), "a"), (big + 2, 1, at(minutes=1), "a")]).withColumn("note", F.lit(None).cast("string"))
    got = dicts(ipdedup.dedup_recent_ip(df), "event_id")
    assert [(r["event_id"], r["ip_duplicate"], r["note"]) for r in got] == [(big + 1, False, None), (big + 2, True, None)]


def test_positions_and_running_counts(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), at(minutes=rnd.randrange(60 * 24 * 40)), None) for i in range(300)]
    rows += [(300 + i, 1, at(hours=3), None) for i in range(20)]  # equal instants
    want, seen = {}, {}
    for e, p, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        from datetime import timedelta
        day = (ts - timedelta(minutes=1)).date()
        keys = {"total": (p,), "day": (p, day), "week": (p, day.isocalendar()[:2]), "month": (p, day.year, day.month)}
        for name, k in keys.items():
            seen[(name, k)] = seen.get((name, k), 0) + 1
        want[e] = tuple(seen[(name, keys[name])] for name in ("total", "day", "week", "month"))
    df = views_df(spark, rows)
    # Whole keys, then one hot key in slices of a minute, of two hours, and of nine days.
    for options in ({}, *({"hot_rows": 70, "seconds": s} for s in (60, 7200, 9 * 86400))):
        got = {r.event_id: (r.total, r.day, r.week, r.month) for r in running_counts(df, **options).collect()}
        assert got == want, options
    some = running_counts(df, counted="event_id % 3 = 0", hot_rows=70)
    counted = {r.event_id: r.total for r in some.collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    totals = {}
    for e, p, _, _ in order:
        totals[p] = totals.get(p, 0) + (e % 3 == 0)
        assert counted[e] == (totals[p] if e % 3 == 0 else None)
    numbered = {r.event_id: r.n for r in positions(df, ["post_id"], "ts", "event_id").collect()}
    assert numbered == {e: w[0] for e, w in want.items()}


def client_views(spark, rows):
    df = spark.createDataFrame(rows, "event_id bigint, client_id string, ts timestamp_ntz, post_id bigint")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("storage", ["local", "session"])
def test_batch_flush(spark, storage):
    rnd = random.Random(9)
    rows = [(i, f"c{rnd.randrange(3)}", at(minutes=i), rnd.randrange(40)) for i in range(150)]
    if storage == "local":  # every post once per client
        rows = list({(r[1], r[3]): r for r in reversed(rows)}.values())
    df, cfg = client_views(spark, rows), CountingConfig(storage=storage)

    def run(**kw):
        out = qualify.batch_flush(df, 3, cfg, **kw)
        return sorted((r.client_id, r.post_id, r.counted_at, r.slot) for r in out.collect())

    want = flush_model(rows, 3)
    assert run() == want
    assert run(**({"chunk_rows": 20} if storage == "session" else {"hot_rows": 20})) == want


def test_batch_flush_leftovers(spark):
    rows = [(i, "c", at(minutes=i), i) for i in range(7)]
    out = qualify.batch_flush(client_views(spark, rows), 3, CountingConfig(storage="local"))
    assert out.count() == 6
    assert qualify.batch_flush(client_views(spark, rows), 1).count() == 7


def test_null_keys_keep_large_ids_apart(spark):
    """A NULL key in a batch must not turn its 64-bit neighbours into doubles."""
    big = 2**60
    rows = [(1, big, at(minutes=1), "h"), (2, big + 1, at(minutes=2), "h"), (3, None, at(minutes=3), "h"),
            (4, None, at(minutes=4), "h"), (5, big, at(minutes=5), "h")]
    out = ipdedup.dedup_recent_ip(views_df(spark, rows).coalesce(1))
    assert {r.event_id: r.ip_duplicate for r in out.collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}


def test_a_row_without_time_is_refused(spark):
    rows = [(1, 1, at(minutes=1), "h"), (2, 1, None, "h")]
    with pytest.raises(Exception, match="needs a time"):
        ipdedup.dedup_recent_ip(views_df(spark, rows)).collect()


def test_rounds_are_bounded_when_no_chunk_settles(spark, monkeypatch):
    """A few more recurring visitors than slots: every chunk depends on the one before."""
    from viewtide.operators import ordered

    rows = [(i, 1, at(minutes=i), f"h{i % 12}" if i % 7 else f"x{i}") for i in range(400)]
    passes, once = [], ordered._end_states
    monkeypatch.setattr(ordered, "_end_states", lambda *a: passes.append(1) or once(*a))
    fold = ordered.RecentFold(slots=9)
    out = ordered.ordered_fold(views_df(spark, rows), "post_id", "ts", "event_id", "ip_hash", fold, "dup",
                               chunk_rows=20, max_rounds=2)
    state = fold.start((), None)
    want = fold.run(state, [r[3] for r in rows], [int(r[2].timestamp() * 1e6) for r in rows])
    assert [r.dup for r in out.orderBy("event_id").collect()] == want
    assert len(passes) <= 3
