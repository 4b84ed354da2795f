"""Hand-computed cases of every score component."""

import pytest

from viewtide.functions import formulas as fx
from viewtide.functions import text
from viewtide.functions.net import clean_header, client_ip, ip_hash, is_ip
from pyspark.sql import functions as F

INPUT = ("day bigint, week bigint, month bigint, total bigint, age double, actions bigint, momentum double, "
         "category_heat double, shape_factor double, prev_ewma double, prev_score double, prev_streak int")


def scored(spark, **over):
    from viewtide.config import TrendingConfig
    from viewtide.operators.trend import score
    row = dict(day=120, week=420, month=900, total=2000, age=10.0, actions=6, momentum=1.0, category_heat=0.0,
               shape_factor=1.0, prev_ewma=None, prev_score=None, prev_streak=None)
    row.update(over)
    df = spark.createDataFrame([tuple(row.values())], INPUT)
    return score(df, TrendingConfig()).first()


def test_full_score(spark):
    r = scored(spark)
    assert r.velocity == pytest.approx(38.474240, abs=1e-6)
    assert r.time_decay == pytest.approx(0.857272, abs=1e-6)
    assert (r.engagement, r.freshness, r.expected) == (1.5, 1.1, 25.0)
    assert r.uplift_raw == pytest.approx(5.934194, abs=1e-6)
    assert (r.uplift, r.ewma_val, r.ewma, r.penalty) == (1.5, 12.0, 1.3, 1.0)
    assert r.raw_score == pytest.approx(106.122448, abs=1e-6)
    assert r.capped == pytest.approx(210.008352, abs=1e-6)


def test_ewma_second_run_and_growth_cap(spark):
    r = scored(spark, prev_ewma=4.0, prev_score=10.0)
    assert r.ewma_val == pytest.approx(4.872810, abs=1e-6)
    assert (r.acc, r.ewma) == (0.5, 1.3)
    assert r.capped == 28.0


@pytest.mark.parametrize("age,decay", [(2.0, 1.0), (20.0, 0.7071588), (38.0, 0.5000736)])
def test_decay(spark, age, decay):
    assert scored(spark, age=age).time_decay == pytest.approx(decay, abs=1e-6)


@pytest.mark.parametrize("week,month,age,day", [(70, 600, 12.0, 5), (0, 0, 100.0, 1), (7, 3000, 0.5, 2)])
def test_day_fallback(spark, week, month, age, day):
    assert scored(spark, day=0, week=week, month=month, age=age).day_used == day


@pytest.mark.parametrize("total,penalty", [(100, 0.765), (10000, 0.9)])
def test_anti_gaming(spark, total, penalty):
    assert scored(spark, day=100, month=30, total=total).penalty == pytest.approx(penalty)


def test_fatigue(spark):
    df = spark.createDataFrame([(s,) for s in (6, 7, 12, 13, 20)], "streak int")
    got = [r[0] for r in df.selectExpr(fx.FATIGUE).collect()]
    assert got == pytest.approx([1.0, 0.97, 0.82, 0.8, 0.8])


def test_jaccard(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.selectExpr(fx.jaccard("a", "b")).collect()] == pytest.approx([1 / 3, 0.0, 1.0])


def test_short_count(spark):
    cases = {999: "999", 1000: "1 K", 1050: "1.1 K", 999950: "1,000.0 K", 1500000: "1.5 M", 0: "0",
             2 * 10**12: "2 T", 5 * 10**15: "5,000 T"}
    df = spark.createDataFrame([(n,) for n in cases], "n bigint").select("n", text.short_count(F.col("n")), text.short_count(F.col("n"), "vi_VN"))
    rows = df.collect()
    assert {r[0]: r[1] for r in rows} == cases
    assert {r[0]: r[2] for r in rows}[1500000] == "1.5 Tr"


def test_text_helpers(spark):
    df = spark.createDataFrame([("a  b\nc d",)], "t string")
    assert df.select(text.trim_words(F.col("t"), 3), text.trim_words(F.col("t"), 4)).first()[:] == ("a b c...", "a b c d")
    one = spark.range(1).selectExpr("timestamp'2024-01-01' AS a", "timestamp'2024-01-04 02:00:00' AS b", "timestamp'2024-01-01 00:00:30' AS c")
    assert one.select(text.age_text(F.col("a"), F.col("b")), text.age_text(F.col("a"), F.col("c"))).first()[:] == ("3 days", "30 seconds")
    assert spark.range(1).select(text.count_text(F.lit(12345)), text.count_text(F.lit(12345), "raw")).first()[:] == ("12,345", "12345")


IPS = {"1.2.3.4": True, "256.1.1.1": False, "01.2.3.4": False, "1.2.3": False, "::": True, "::1": True, "1::": True,
       "2001:db8::8a2e:370:7334": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": False, "1::2::3": False,
       "::ffff:1.2.3.4": True, "1:2:3:4:5:6:1.2.3.4": True, "1:2:3:4:5:6:7:1.2.3.4": False, "g::1": False,
       "1:2:3:4:5:6:7::": True, "1:2:3:4:5:6:7:8::": False, "": False, "unknown": False, "12345::": False}


def test_ip_validity(spark):
    import ipaddress
    df = spark.createDataFrame([(k,) for k in IPS], "ip string").selectExpr("ip", f"{is_ip('ip')} AS ok")
    got = {r.ip: r.ok for r in df.collect()}
    assert got == IPS
    for ip, ok in IPS.items():
        try:
            ipaddress.ip_address(ip)
            assert ok
        except ValueError:
            assert not ok


def test_client_ip(spark):
    cases = [
        ({"REMOTE_ADDR": "10.0.0.1"}, "10.0.0.1"),
        ({"HTTP_CF_CONNECTING_IP": "bad", "HTTP_X_REAL_IP": "8.8.8.8", "REMOTE_ADDR": "10.0.0.1"}, "8.8.8.8"),
        ({"HTTP_X_FORWARDED_FOR": " 9.9.9.9 , 1.1.1.1", "HTTP_X_REAL_IP": "8.8.8.8"}, "9.9.9.9"),
        ({"HTTP_X_FORWARDED_FOR": ",1.1.1.1"}, "127.0.0.1"),
        ({"HTTP_CLIENT_IP": "<b>7.7.7.7</b>"}, "7.7.7.7"),
        ({}, "127.0.0.1"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h map<string,string>")
    rows = df.orderBy("i").select(client_ip("h")).collect()
    assert [r[0] for r in rows] == [e for _, e in cases]
    assert spark.range(1).select(ip_hash(F.lit("1.2.3.4"))).first()[0] == "fwcbc5"
    assert spark.createDataFrame([(" a\t b%20c ",)], "h string").selectExpr(clean_header("h")).first()[0] == "a bc"
