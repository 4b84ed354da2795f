import random

import pytest
from pyspark.sql import functions as F

from tests.util import at
from viewtide.config import CountingConfig
from viewtide.operators.qualify import dedup_viewer
from viewtide.sources.tables import read_pointer
from viewtide.streaming import firstviews as fv

DDL = "event_id bigint, client_id string, post_id bigint, ts timestamp_ntz"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(2)


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


@pytest.mark.parametrize("bits", [16, 1])
def test_batch_after_batch_equals_the_whole(spark, tmp_path, bits):
    """Random views of few clients, one with a third of them, NULL clients and posts, repeated
    rows; with one bit a key nearly every key is a possible hit. A batch comes twice."""
    rnd, out, index = random.Random(bits), str(tmp_path / "out"), str(tmp_path / "index")
    rows = [(i, None if i % 29 == 0 else "c0" if i % 3 == 0 else f"c{rnd.randrange(40)}",
             None if i % 31 == 0 else rnd.randrange(25), at(minutes=i // 2)) for i in range(600)]
    for version, low in enumerate(range(0, 600, 150)):
        batch = frame(spark, rows[low:low + 150])
        said = fv.admit_first_views(batch, index, out, version, buckets=4, most_parts=3, bits_per_key=bits)
        assert said["touched"] == [0, 1, 2, 3] and set(said["opened"]) <= set(said["touched"])
    again = fv.admit_first_views(batch, index, out, version, buckets=4)
    assert again == {"touched": [], "opened": []}
    want = dedup_viewer(frame(spark, rows), CountingConfig(storage="local"))
    assert ids(spark.read.parquet(out)) == ids(want)
    now = read_pointer(spark, f"{index}/current")
    assert all(len(b["parts"]) < 3 for b in now["buckets"].values())
    assert sum(b["keys"] for b in now["buckets"].values()) == want.count()


def test_only_buckets_with_possible_hits_are_opened(spark, tmp_path):
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    rows = [(i, f"c{i % 50}", i // 50, at(minutes=i)) for i in range(500)]
    first = fv.admit_first_views(frame(spark, rows), index, out, 0, buckets=8)
    assert first["opened"] == [] and len(first["touched"]) == 8
    one = fv.admit_first_views(frame(spark, [(900, "c7", 3, at(days=1)), (901, "c7", 77, at(days=1))]), index, out, 1)
    assert len(one["touched"]) == 1 and one["opened"] == one["touched"]
    none = fv.admit_first_views(frame(spark, [(902 + i, f"d{i}", 1, at(days=2)) for i in range(20)]), index, out, 2)
    assert len(none["touched"]) > 3 and len(none["opened"]) <= 1  # a false hit is rare
    assert ids(spark.read.parquet(out)) == [*range(500), *range(901, 922)]


def test_a_lost_attempt_and_an_empty_batch(spark, tmp_path, monkeypatch):
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    rows = [(1, "a", 1, at(minutes=1)), (2, "a", 1, at(minutes=2)), (3, "b", 1, at(minutes=3))]

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(fv, "write_pointer", lost)
        with pytest.raises(RuntimeError):
            fv.admit_first_views(frame(spark, rows), index, out, 0, buckets=2)
    fv.admit_first_views(frame(spark, rows), index, out, 0, buckets=2)
    assert fv.admit_first_views(frame(spark, []), index, out, 1) == {"touched": [], "opened": []}
    fv.admit_first_views(frame(spark, [(4, "b", 1, at(minutes=4)), (5, "b", 2, at(minutes=5))]), index, out, 2)
    assert ids(spark.read.parquet(out)) == [1, 3, 5]
