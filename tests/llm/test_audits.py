"""Filter audit, repeated byte strings and hard negatives: brute force on odd tables."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from viewtide.llm import interaction, negatives, suffixes

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
DOCS = [(1, None, None), (2, "", ""), (3, "a b c", "s"), (3, "a b c", "s"), (3, "a b c", "t"), (4, "a b c", None), (None, "a b c", "s"),
        (None, "a b c", "s"), (5, "AB " * 300, "s"), (6, "word " * 250 + "$", "s"), (7, LONG, "t"), (8, LONG, "t"), (9, "é" * 400, "s"),
        (0, "a b c", "u"), (10, " \n ", "t"), (11, "x y z " * 80, ""), (11, None, "")]
LABELS = [(3, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1), (8, 0, 1), (5, 1, 0), (99, 1, 1), (7, None, None)]


def failed(row, rows):
    i, text, _ = row
    text = text or ""
    words = brute.SPACE.findall(text)
    bits = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            any(c in "#$%&*|" for c in text), i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)]
    return {c for c, b in zip("ABCDE", bits) if b}


def audited(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out, share = [], {}
    for part in {s or "" for *_, s in rows}:
        mine = [(i, failed((i, t, s), rows)) for i, t, s in rows if (s or "") == part]
        for order in permutations("ABCDE"):
            kept = mine
            for step, f in enumerate(order, 1):
                lost, kept = [m for m in kept if f in m[1]], [m for m in kept if f not in m[1]]
                fails = sum(f in m for _, m in mine)
                share[part, f] = share.get((part, f), 0) + len(lost)
                out.append((part, "".join(order), step, len(kept), len(lost), fails - len(lost), sum(m == {f} for _, m in mine),
                            sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost), f))
    return sorted((*r[:-1], share[r[0], r[-1]]) for r in out)


def test_filter_audit(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, source string").withColumns({"part": F.lit(1), "Mask": F.lit(2)})
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(7))
    steps = interaction.audit(interaction.failure_masks(docs.repartition(3), labels))
    assert sorted(tuple(r) for r in steps.collect()) == audited(DOCS, LABELS)
    summary = {(r.part, r["filter"]): r for r in interaction.order_summary(steps, ["s"]).collect()}
    assert set(summary) == {("s", f) for f in "ABCDE"} and summary["s", "D"].fails == 1
    assert interaction.audit(interaction.failure_masks(docs.limit(0), labels)).count() == 0
    none = interaction.audit(interaction.failure_masks(docs, labels.limit(0)))
    assert none.filter("good_lost + toxic_lost > 0").count() == 0 and none.count() == 600 * 4


def test_gray_walk_equals_direct_counts():
    cells = np.random.default_rng(2).integers(0, 50, (32, 3, 3))
    states, masks = interaction.subset_survivors(cells), np.arange(32)
    assert all((states[s] == cells[(masks & s) == 0].sum(0)).all() for s in range(32))


@pytest.mark.parametrize("p", [2, 3, 5, 7, 13])
def test_cover_has_every_difference_once(p):
    v, line = suffixes.singer(p)
    assert sorted((i - j) % v for i in line for j in line if i != j) == list(range(1, v))
    assert suffixes.difference_cover(400)[0] == 183 and suffixes.difference_cover(5) == (1, [0])


def texts_for(length):
    rnd = random.Random(length)
    w = lambda n: "".join(rnd.choice("abcé") for _ in range(n))
    p, q = w(length * 3), w(length + 3)
    texts = [None, "", "a" * (length * 5), w(length * 2), p, p, w(7) + p + w(9), p[:length], p[1:length + 1] + w(3) + q, q[2:] + w(length),
             w(2) + q + p[5:] + q, w(length * 4) + q[:length] + w(5), w(50_000), "x" + q, *[w(11) + p[k:] + w(k) for k in range(9)]]
    for _ in range(12):  # near copies
        t = list(p * 10)
        for _ in range(8):
            t[rnd.randrange(len(t))] = f"z{rnd.randrange(100)}"
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("length", [400, 20, 5])
def test_removed_repeats(spark, length):
    rows = [(k // 2, t) for k, t in enumerate(texts_for(length))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"SPANS": F.lit(1), "__bytes": F.lit(2), "__0": F.lit(3)})
    out = suffixes.remove_repeats(df.repartition(3), suffixes.Repeats(length, 2_000, 500))
    assert out.columns == ["doc_id", "text", "__bytes", "__0", "n_bytes", "spans", "kept_bytes"]
    got = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept_bytes).hexdigest())
                 for r in out.collect())
    assert got == sorted((i, *r) for (i, _), r in zip(rows, brute.removed_repeats([t for _, t in rows], length)))
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_removed_repeats_query(spark, sf):
    import duckdb

    from viewtide.llm.queries import QUERIES

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY 1").fetchall()
    got = [tuple(r) for r in QUERIES["op12_suffix_dedup"](spark, sf).orderBy("doc_id").collect()]
    assert got == [(i, *r) for (i, _), r in zip(docs, brute.removed_repeats([t for _, t in docs]))]


@pytest.mark.parametrize("first,then", [(1, 8), (8, 1)])
def test_removed_repeats_when_scans_change(spark, tmp_path, monkeypatch, first, then):
    """The scan is cut otherwise, as after executors have come or gone, when the ranks are stored."""
    texts = [t for t in texts_for(20) if t is None or len(t) < 5_000]
    rows = [(None if k % 5 == 0 else k, t) for k, t in enumerate(texts)] + [(None, texts[4])] * 7 + [(0, "short")] * 3
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    keep, cores = suffixes.keep, "spark.sql.files.minPartitionNum"

    def kept(*args, **more):
        found = keep(*args, **more)
        spark.conf.set(cores, then)
        return found

    monkeypatch.setattr(suffixes, "keep", kept)
    spark.conf.set(cores, first)
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert docs.rdd.getNumPartitions() == first
        out = suffixes.remove_repeats(docs, suffixes.Repeats(20, 2_000, 500), carry=["doc_id"]).collect()
    finally:
        spark.conf.unset(cores)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans),
            hashlib.sha256(r.kept_bytes).hexdigest()) for r in out]
    assert sorted(got) == sorted((-1 if i is None else i, *r) for (i, _), r in zip(rows, brute.removed_repeats([t for _, t in rows], 20)))


def mined(rows, positives=5, wanted=10):
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        score = lambda r: sum(x * y for x, y in zip(va, r[2]))  # noqa: B023, E731
        ranked = sorted((r for r in rows if r[0] != a), key=lambda r: (-score(r), r[0]))
        for p in [r for r in ranked if r[1] == la][:positives]:
            inside = [r for r in ranked if r[1] != la and 30 * score(p) <= 100 * score(r) <= 90 * score(p)]
            out += [(a, p[0], k, r[0], score(p), score(r)) for k, r in enumerate(inside[:wanted], 1)]
    return sorted(out)


@pytest.mark.parametrize("width,block,batch", [(64, 1024, 2048), (64, 2, 7), (100, 3, 50), (3, 1, 5)])
def test_hard_negatives(spark, width, block, batch):
    rng = np.random.default_rng(width)
    centres = rng.standard_normal((4, width))
    rows = []
    for i in range(260):
        k = int(rng.integers(4))
        v = centres[k] * 0.4 + rng.standard_normal(width) * 0.3
        rows.append((i if i != 33 else 32, int(rng.integers(3)), [float(x) for x in np.float32(v)]))
    rows += [(300, 0, rows[0][2]), (301, 1, rows[0][2]), (302, 1, rows[0][2]), (400, 2, [0.0] * width), (401, 2, rows[5][2][:2]), (500, 9, rows[7][2])]
    odd = [(None, 1, rows[0][2]), (600, None, rows[0][2]), (700, 1, None), (701, 1, [1.0, None]), (702, 1, [float("nan")]), (703, 1, [float("inf")])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, label int, embedding array<float>").withColumns({"id": F.lit(1), "V": F.lit(2)})
    whole = negatives.integer_rows(df.repartition(3), F.col("label"))
    found = negatives.mine(whole, F.col("id") % 100 == 0, negatives.Mining(block=block, batch=batch))
    exact = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows]
    assert sorted(tuple(r) for r in found.collect()) == mined(exact)
    if width == 3:
        assert negatives.mine(whole.limit(0), F.col("id") % 100 == 0).count() == 0
        assert negatives.mine(whole, F.lit(False)).count() == 0


def test_bounds_hold_and_tell_something():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.standard_normal((500, 64)) / 8).astype(np.int64)
    v[0], v[1], v[2] = 0, 5, -5
    codes = negatives.Codes(64, negatives.Mining())
    low, high = codes.bounds(codes.query(v[:40]), codes.encode(v))
    true, scale = v[:40] @ v.T, np.linalg.norm(v[:40], axis=1)[:, None] * np.linalg.norm(v, axis=1)
    assert (low <= true).all() and (true <= high).all() and np.median((high - low)[3:, 3:] / scale[3:, 3:]) < 0.35
