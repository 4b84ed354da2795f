"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from viewtide.llm import (
    decontaminate, dedup, graph, htmltext, language, mixture, quality, repetition, rollup, scratch, secretscan,
    urlfilter, words)

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, SIZE string, kept string, verdict string, __text string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, LONG),
         (7, LONG + " tail"), (8, "a b c d e f g h i j k l"), (9, "ß É x " * 40), (10, "12 34 !?"), (11, "ONE two")]


def frame(spark, pairs=TEXTS):
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, None if i == 4 else "s", None, "x", "y", "z", "q")
                                  for i, t in pairs], DDL)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_words_equal_regular_expressions():
    import pyarrow as pa

    texts = [t for _, t in TEXTS] + ["a\x1cb\x0bc\x85d\u00a0e", "x" * 3_000_000 + " y", "İstanbul ſ K"]
    for table, pattern, lower in ((words.SPACE, brute.SPACE, True), (words.ALNUM, brute.ALNUM, True), (words.SPACE, brute.SPACE, False)):
        got = []
        for _, _, w in words.column_words(pa.array(texts), table, lower):
            spans = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends)]
            got += [spans[a:b] for a, b in zip(w.at, w.at[1:])]
            hashes = dict(zip(spans, w.hashes().tolist()))
            assert len(set(hashes.values())) == len(hashes)
        assert got == [pattern.findall((t or "").translate(brute.UPPER if lower else {})) for t in texts]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(f"p{i:04}", f"p{i + 1:04}") for i in range(300)] + [("hub", f"x{i}") for i in range(200)] + [("a", "a"), (None, "a")]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"p{i:04}"] for i in range(301)} == {"p0000"} and {got[f"x{i}"] for i in range(200)} == {"hub"} and got["a"] == "a"


def test_near_duplicates_edges(spark):
    got = sorted_rows(dedup.near_duplicates(frame(spark)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_duplicates(TEXTS), key=repr)
    assert dedup.near_duplicates(frame(spark).limit(0)).count() == 0
    left = dedup.drop_duplicates(frame(spark), ngram=5, percent=(80, 100))
    assert left.columns == frame(spark).columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 8, 9, 10]


def test_near_duplicates_of_chained_edits(spark):
    """A family in which many members only link through others, and copies of each."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{k}" for k in range(60)], []
    texts = [base]
    for _ in range(120):
        t = list(texts[rng.integers(len(texts))])
        t[rng.integers(len(t))] = f"n{rng.integers(10**9)}"
        texts.append(t)
    for k, t in enumerate(texts * 2):
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted_rows(dedup.near_duplicates(df, growth=4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_duplicates(rows), key=repr)


def test_sketch_estimate():
    sketch, rng = dedup.Sketch(0.85), np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    a, b, c = pool[:1000], pool[100:1100], pool[500:1500]
    regs = [sketch.registers(s) for s in (a, b, c)]
    both = np.maximum(regs[0], regs[1])
    assert (sketch.registers(pool[:1100]) == both).all()  # registers merge by maximum
    n = np.array([1000.0])
    assert sketch.estimate(regs[0][None], regs[1][None], n, n)[0] == pytest.approx(900 / 1100, abs=0.12)
    assert sketch.estimate(regs[0][None], regs[2][None], n, n)[0] == pytest.approx(500 / 1500, abs=0.15)


def test_mix_edges(spark):
    got = sorted_rows(mixture.mix(frame(spark)), "__id", "size", "source", "taken", "uses")
    assert len(got) == len(TEXTS) and all(u == 0 for _, size, _, _, u in got if size == 0) and all(u <= 3 for *_, u in got)
    assert mixture.mix(frame(spark).limit(0)).count() == 0 and mixture.curriculum(frame(spark).limit(0)).count() == 0
    order = mixture.curriculum(frame(spark)).select("doc_id", "use_no", "train_position").collect()
    total = sum(r[4] for r in got)
    assert len(order) == total
    slim = sorted_rows(mixture.mix(frame(spark), mixture.Curriculum(slice_docs=2)), "__id", "size", "source", "taken", "uses")
    assert slim == got  # slices change nothing


def test_mix_fills_the_last_pass_around_long_documents(spark):
    """Word counts in the order of the digests; a giant among short documents, and ever longer ones."""
    ids = sorted(range(1000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    for sizes in ([100_000 if k == 10 else 100 for k in range(1000)], [1 + k % 7 + (k % 13 == 0) * 9_000 for k in range(1000)],
                  [2 ** (k % 15) for k in range(1000)]):
        text = {i: "w " * n for i, n in zip(ids, sizes)}
        rows = [(i, text[i], "a") for i in range(1000)] + [(2000 + k, "v " * 90, s) for k, s in enumerate("bbc")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
        got = {r["__id"]: r for r in mixture.mix(df).collect()}
        assert [(i, got[i]["size"], got[i].source_size, got[i].taken) for i, *_ in rows] == [
            (i, n, total, taken) for i, n, total, _, taken in brute.mixed(rows)]
        mine = [got[i] for i in range(1000)]
        target, taken = mine[0].target, sum(r.taken for r in mine)
        rest = target - (target // sum(sizes)) * sum(sizes)
        assert abs(target - taken) <= max(s for s in sizes if s <= rest) / 2
        again = {r["__id"]: r.taken for r in mixture.mix(df.repartition(5), mixture.Curriculum(slice_docs=50)).collect()}
        assert again == {i: r.taken for i, r in got.items()}


def test_mix_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(500)), "w " * int(rng.integers(1, 2000) if rng.random() < 0.05 else rng.integers(0, 60)),
             [None, "a", "b", "c", "é"][int(rng.integers(5))]) for _ in range(700)]
    rows = list({i: (i, t, s) for i, t, s in rows}.values())
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(((r["__id"], r["size"], r.source_size, r.taken) for r in mixture.mix(df, mixture.Curriculum(slice_docs=20)).collect()))
    assert got == sorted((i, n, total, taken) for i, n, total, _, taken in brute.mixed(rows))


def test_curriculum_keeps_clashing_columns(spark):
    names = ["copy", "size", "place", "target", "last", "__id", "__i", "supply", "USE_NO"]
    df = frame(spark).drop("SIZE").withColumns({c: F.lit(c) for c in names})
    out = mixture.curriculum(df)
    assert out.columns == [*[c for c in df.columns if c != "USE_NO"], "use_no", "train_position"]
    assert all(r.copy == "copy" and r["__id"] == "__id" and 0 <= r.train_position <= 1 for r in out.collect())


def test_targets_reach_every_limit(spark):
    for sizes in ({"a": 10, "b": 500, "c": 3, None: 40}, {"a": 0, "b": 7}, {"a": 1000, "b": 1, "c": 1, "d": 1}, {"a": 0}):
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, docs bigint")
        got = {r.source: r.target for r in mixture.source_targets(df).collect()}
        assert got == pytest.approx(brute.targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_positions_invert_the_schedule(spark):
    cfg = mixture.Curriculum(ramps=(-0.5, 0.0, 0.5, 1.0))
    df = spark.range(4).crossJoin(spark.createDataFrame([(y / 10,) for y in range(11)], "y double"))
    for place, y, t in df.select("id", "y", mixture.position(cfg, F.col("y"), F.col("id"))).collect():
        ramp = cfg.ramps[place]
        assert 0 <= t <= 1 and (1 - ramp) * t + ramp * t * t == pytest.approx(y)


ITEMS = [(1, "a b c d e f g h i j k"), (2, "one two"), (3, None), (4, "!!"), (None, "É x ß"), (2, "one two"), (5, "b c d e f g h i j k zz")]


@pytest.mark.parametrize("block", [200_000, 2])
def test_decontaminate_edges(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = decontaminate.decontaminate(frame(spark), items, block_windows=block)
    got = sorted_rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(TEXTS, ITEMS), key=repr)
    assert set(frame(spark).columns) <= set(out.columns)
    assert decontaminate.decontaminate(frame(spark), items.limit(0)).filter("contaminated OR n_items > 0").count() == 0
    assert decontaminate.decontaminate(frame(spark).limit(0), items).count() == 0


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_secrets_confirmed_by_structure(spark):
    integer = der(2, b"\x11" * 60)
    rsa = der(0x30, der(2, b"\0"), *[integer] * 8)
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48")), der(4, rsa))
    assert secretscan.is_private_key(rsa) and secretscan.is_private_key(pkcs8)
    assert not secretscan.is_private_key(rsa[:-1]) and not secretscan.is_private_key(rsa + b"\0")
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'x'})}.c2lnbmF0dXJl"
    fake = f"{part({'typ': 'x'})}.{part({'sub': 'x'})}.c2lnbmF0dXJl"
    b64 = base64.b64encode(rsa).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b64[i:i + 64] for i in range(0, len(b64), 64)) + "\n-----END RSA PRIVATE KEY-----"
    string = lambda b: len(b).to_bytes(4, "big") + b
    ssh = base64.b64encode(b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big")
                           + string(b"k" * 40) + string(b"s" * 80)).decode()
    random = base64.b64encode(hashlib.sha512(b"x").digest() * 3).decode()
    texts = [(1, f"é {token} x"), (2, fake), (3, f"k {b64} z"), (4, pem), (5, f"x {pkcs8.hex()} y"), (6, ssh), (7, random), (8, None)]
    got = {r.doc_id: r for r in secretscan.scan_secrets(frame(spark, texts), redacted=True).collect()}
    kinds = {i: [s.split(":")[0] for s in r.spans.split(",") if s] for i, r in got.items()}
    assert kinds == {1: ["token"], 2: [], 3: ["der"], 4: ["pem"], 5: ["hex", "der"], 6: ["openssh"], 7: [], 8: []}
    assert got[1].spans == f"token:2:{2 + len(token)}" and got[1].redacted == "é [SECRET] x" and got[8].redacted is None
    assert got[5].redacted == "x [SECRET] y" and got[4].redacted == "[SECRET]"


def test_secrets_in_wrapped_and_escaped_base64(spark):
    rsa = der(0x30, der(2, b"\0"), *[der(2, bytes([k]) + b"\x11" * 59) for k in range(1, 9)])
    pbe = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(4, b"saltsalt")))
    locked, digest = der(0x30, pbe, der(4, b"\x77" * 320)), der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201"))), der(4, b"h" * 64))
    assert secretscan.is_private_key(locked) and not secretscan.is_private_key(digest)
    b64 = lambda x: base64.b64encode(x).decode()
    wrap = lambda x, n=64, end="\n": end.join(x[i:i + n] for i in range(0, len(x), n))
    pem = lambda x, name="": f"-----BEGIN {name}PRIVATE KEY-----\n{x}\n-----END {name}PRIVATE KEY-----\n"
    part = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    string = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b64(b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big") + string(b"k" * 40) + string(b"s" * 80))
    token = f"{part('{ \"alg\": \"HS256\"}')}.{part('{\"sub\": 1}')}.c2ln"
    lines = f"{part('{\n  \"alg\": \"RS256\"}')}.{part('{\"sub\": 1}')}.c2ln"
    random = b"".join(hashlib.sha512(bytes([k])).digest() for k in range(9))
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    whole = {  # text before, secret, text after, kind
        1: ('{"private_key": "', json.dumps(pem(wrap(b64(rsa))).strip())[1:-1], '\\n", "id": 1}', "pem"),
        2: ("KEY='", wrap(b64(rsa), 76, "\\n"), "\\nend'", "der"), 3: ("words before\n", wrap(b64(rsa), 76, "\r\n"), "\r\nand after", "der"),
        4: ("see /keys/", b64(rsa), " x", "der"), 5: ("id-", b64(rsa), "", "der"), 6: ("", pem(wrap(b64(locked)), "ENCRYPTED ").strip(), "\n", "pem"),
        7: ("", pem(headers + wrap(b64(random)), "RSA ").strip(), "\n", "pem"), 8: ("a ", wrap(b64(locked), 40, "\n  "), " b", "der"),
        9: ("bearer ", token, " x", "token"), 10: ("host.name_", lines, "", "token"), 11: ('"', wrap(ssh, 70, "\\n"), '"', "openssh"),
        12: ("a.", token, " x", "token"), 13: ('"\\n', token, '"', "token"), 14: ("php ", b64(rsa).replace("/", "\\/"), " x", "der")}
    texts = [(i, a + b + c) for i, (a, b, c, _) in whole.items()]
    texts += [(30, wrap(b64(digest))), (31, wrap(b64(random))), (32, pem(wrap(b64(random)))), (33, "MII" + "MIIEpAIBAAKC" * 400), (34, "www.example-domains.com " * 9),
              (35, pem(headers + "not a key: at all", "RSA ")), (36, wrap(b64(rsa[:-1])) + "\nM"), (37, b64(rsa)[:-9] + "\r\n" * 400)]
    got = {r.doc_id: r for r in secretscan.scan_secrets(frame(spark, texts), redacted=True).collect()}
    for i, (before, secret, after, kind) in whole.items():
        assert f"{kind}:{len(before)}:{len(before) + len(secret)}" in got[i].spans.split(","), (i, got[i].spans)
        assert got[i].redacted == f"{before}[SECRET]{after}"
    assert all(got[i].n_confirmed == 0 for i, _ in texts if i >= 30)


def test_secret_scan_takes_time_by_length():
    """Texts of 2 MB that are full of places where a key or token could start."""
    import time

    cases = ["b3BlbnNzaC1rZXktdjEA" * 100_000, "MIIEpAIBAAKC" * 170_000, "-eyJhbGciOiJI" * 160_000 + ".e30.x", "eyJh" + "-eyJhYWFh" * 220_000 + ".e30.x",
             "b3BlbnNzaC1rZXktdjEA\n" * 95_000, "-----BEGIN PRIVATE KEY-----MII" * 66_000]
    for text in cases:
        start = time.process_time()
        assert secretscan.confirmed_spans(text) == []
        assert time.process_time() - start < 15
    rsa = der(0x30, der(2, b"\0"), *[der(2, b"\x11" * 60)] * 8)
    late = "MIIEpAIBAAKC" * 1000 + " " + base64.b64encode(rsa).decode()  # found behind many false starts
    assert [s[0] for s in secretscan.confirmed_spans(late)] == ["der"]


def test_base_secrets_edges(spark):
    texts = [(1, None), (2, ""), (3, "Token: 'abcdefgh' PASSWD=\"x\" api_key = ABCDEFGHI"), (4, "AKIA" + "A" * 11), (5, "AKIA" + "A" * 12),
             (6, "0" * 31 + " " + "a" * 33 + "G" + "f" * 32), (7, "toKen=abcdefgh ſecret=abcdefgh passwordpassword:12345678"), (8, LONG)]
    got = sorted_rows(secretscan.scan_secrets(frame(spark, texts)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got == sorted(((i, *brute.base_secrets(t)) for i, t in texts), key=repr)
    assert secretscan.scan_secrets(frame(spark).limit(0)).count() == 0


def test_repetition_edges(spark):
    texts = TEXTS + [(20, "same line here\n" * 9), (21, "x y z\n\n\nx y z\n x y z"), (22, "a b c d e " * 30), (23, "#*$%&|<> " * 5 + "w " * 6)]
    passage = "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16 p17 p18 "
    alone = lambda n, tag: " ".join(f"{tag}{k}" for k in range(n))
    said_twice = f"{alone(80, 'a')} {passage}{alone(84, 'b')} {passage}"  # 200 words, 36 of them in a passage said twice
    texts += [(30, said_twice), (31, said_twice.replace("a0 ", "")), (32, f"{alone(300, 'a')} {passage}{alone(84, 'b')} {passage}")]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in repetition.repetition(frame(spark, texts)).filter("doc_id >= 30").collect()}
    assert kept == {30: (False, False), 31: (False, True), 32: (False, True)}  # rejected; too short to tell; little of the text
    got = sorted_rows(repetition.repetition(frame(spark, texts)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")
    assert got == sorted(((i, *brute.repetition(t)) for i, t in texts), key=repr)
    assert repetition.repetition(frame(spark).limit(0)).count() == 0


def test_quality_edges(spark):
    labels = spark.createDataFrame([(6, 1, 0), (9, 1, 0), (8, 0, 0), (8, 0, 1), (None, 1, 0), (10, None, 0)], "doc_id bigint, quality int, toxic int")
    cfg = quality.Resampling(buckets=512, keep_share=0.5)
    out = quality.resample(frame(spark), labels, cfg)
    rows = out.collect()
    assert len(rows) == len(TEXTS) and sum(r.kept for r in rows) in (6, 7)
    assert all(r.log_weight == 0 for r in rows if not r.n_words)
    again = quality.resample(frame(spark).repartition(3), labels, cfg)
    assert sorted_rows(out, "doc_id", "n_words", "kept") == sorted_rows(again, "doc_id", "n_words", "kept")
    assert quality.resample(frame(spark).limit(0), labels, cfg).count() == 0
    assert quality.resample(frame(spark), labels.limit(0), quality.Resampling(buckets=64)).filter("kept").count() == len(TEXTS)


def test_largest_finds_the_kth_value(spark):
    values = [5.0, 1.0, 1.0, 1.0, -2.0, 7.5, 1.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, 9):
        limit, ties = quality.largest(df, "v", k, bins=3)
        assert limit == sorted(values, reverse=True)[k - 1] and sum(v > limit for v in values) + ties == k


def test_rollup_commits_once_and_signs(spark):
    path = scratch.folder(spark, "t")
    rows = rollup.counted(frame(spark), ("words-1", "pieces-1"))
    assert rollup.commit(rollup.deltas(inserted=rows), path, "a") and not rollup.commit(rollup.deltas(inserted=rows), path, "a")
    once = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals(spark, path, ["a", "a", "missing"]).collect()}
    assert sum(d for (_, _, t), (d, _) in once.items() if t == "words-1") == len(TEXTS)
    assert sum(n for (_, _, t), (_, n) in once.items() if t == "words-1") == sum(len(brute.SPACE.findall(x or "")) for _, x in TEXTS)
    rollup.commit(rollup.deltas(deleted=rows), path, "b")
    assert rollup.totals(spark, path, ["a", "b"]).count() == 0
    revised = rows.withColumns({"old_tokens": F.col("tokens"), "old_chars": F.col("chars")}).withColumn("tokens", F.col("tokens") + 1)
    rollup.commit(rollup.deltas(revised=revised), path, "c")
    more = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals(spark, path, ["a", "c"]).collect()}
    assert all(more[k] == (d, n + d) for k, (d, n) in once.items())
    assert rollup.compact(spark, path, ["a", "c"], "s") and rollup.totals(spark, path, ["s"]).count() == len(more)
    assert rollup.deltas(inserted=rows.limit(0)).count() == 0


def test_tokenizer_file_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    got = {r.doc_id: r.tokens for r in rollup.count_with(frame(spark), "text", str(path)).filter("doc_id IN (1, 2, 4)").collect()}
    assert got == {1: 0, 2: 0, 4: 2}


def test_language_edges(spark):
    model = language.train(frame(spark), language.Training(steps=30))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark), model).collect()}
    assert model.langs == ["en"] and all(got[i] == ("und", 0.0) for i in (1, 2, 3, 10)) and got[9][0] == "en"
    assert language.train(frame(spark).limit(0)) is None
    assert {r.lang_pred for r in language.identify(frame(spark), None).collect()} == {"und"}
    assert language.identify(frame(spark).limit(0), model).count() == 0
    flags = frame(spark).select("doc_id", language.held_out().alias("h")).collect()
    assert all(r.h == brute.held_out(r.doc_id) for r in flags)


def test_unlearned_language_is_unlike(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs.filter("lang <> 'fr'"))
    found = language.identify(docs.withColumn("UNLIKE", F.lit("x")), model, unlike=True)
    rows = [(r.lang == "fr", r.unlike, len(r.text or "")) for r in found.collect()]
    odd = [u for fr, u, n in rows if fr and n > 200]
    assert sum(u > 0.15 for u in odd) >= 0.9 * len(odd) > 0 and all(u <= 0.15 for fr, u, _ in rows if not fr)
    assert found.columns == [*docs.columns, "lang_pred", "score", "unlike"]


def test_url_components_spread_blocks(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [(1, "http://bad.net/es/x", ""), (2, "https://mirror.org/y?utm_source=f#a", link.format("http://bad.net/es/x")),
             (3, "http://far.org/z", '<META http-equiv=refresh content="0; URL=https://mirror.org/y/">'), (4, "http://free.org/q", None),
             (5, None, ""), (6, "no url", ""), (7, "http://www.example.com/en/a", ""), (8, "http://copy.org/b", link.format("http://www.example.com/en/a")),
             (9, "http://copy.org/c", link.format("//copy.org/b") + link.format("http://bad.net/fr/")), (10, "http://A.COM", ""), (10, "http://A.COM", ""),
             (11, "x://com/?a", ""), (12, "http://rel.net/de/p", link.format("/es/q")), (13, "http://rel.net/es/q", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("HOST", F.lit(1))
    rules = spark.createDataFrame(brute.RULES, "rule_host string, rule_path string, rule_verdict string")
    got = {r.page_id: r for r in urlfilter.url_filter(df, rules).collect()}
    for i, url, _ in pages:
        host, path, rule, verdict = brute.url_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or got[i].verdict)
    assert {i: got[i].verdict for i in (2, 3, 4, 5, 6, 8, 9, 12)} == {
        2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 8: "allow", 9: "allow", 12: "block"}
    edges = spark.createDataFrame([("http://free.org/q", "http://bad.net/es/x"), (None, "x")], "a string, b string")
    assert {r.page_id: r.verdict for r in urlfilter.url_filter(df, rules, edges).collect()}[4] == "block"
    assert urlfilter.url_filter(df.limit(0), rules).count() == 0 and urlfilter.url_filter(df, rules.limit(0)).filter("verdict = 'block'").count() == 0


def test_url_ends_that_are_no_pages_are_judged(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [(1, "http://one.org/a", link.format("http://bad.net/es/x")), (2, "http://two.org/b", ""), (3, "http://three.org/c", ""),
             (4, "http://four.org/d", '<meta http-equiv="refresh" content="0; url=http://bad.net/fr/">'),
             (5, "http://bad.net/es", link.format("http://bad.net/es/")), (6, "http://six.org/e", link.format("http://free.org/e")),
             (7, None, link.format("http://bad.net/es/x")), (8, "http://eight.org/", ""), (9, "http://bad.net/es/own", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rules = spark.createDataFrame(brute.RULES, "rule_host string, rule_path string, rule_verdict string")
    edges = [("http://bad.net/es/from", "http://two.org/b"), ("http://three.org/c", "http://mid.org/"),
             ("http://mid.org/", "http://bad.net/fr/z"), ("http://bad.net/es/y", "http://four.org/d"),
             ("http://www.example.com/en/ok", "http://four.org/d"), (None, "http://eight.org/"), ("http://bad.net/es/x", None)]
    moves = spark.createDataFrame(edges, "a string, b string")
    got = {r.page_id: r.verdict for r in urlfilter.url_filter(df, rules, moves).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
    alone = {r.page_id: (r.rule, r.verdict) for r in urlfilter.url_filter(df, rules).collect()}
    assert alone[1] == (None, "block") and alone[4] == (None, "block") and alone[2] == (None, "allow")


def test_taken_words_are_those_of_the_training_order(spark, tmp_path, monkeypatch):
    from viewtide.llm import queries

    rows = [(k % 50 if k % 9 else None, "a b c " * (k % 7), "xyz"[k % 3] if k % 10 else None) for k in range(200)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id bigint, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted_rows(mixture.mix(df).withColumnRenamed("__id", "doc_id"), "doc_id", "size", "source_size", "taken")
    orders, kept = [], mixture.in_order

    def in_order(uses):
        orders.append(kept(uses))
        return orders[-1]

    monkeypatch.setattr(mixture, "in_order", in_order)
    got = sorted_rows(queries.source_mixing(spark, str(tmp_path)), "doc_id", "size", "source_size", "taken")
    assert got == want and any(r[-1] for r in got) and len(got) == 220
    at = [r.train_position for r in orders[0].collect()]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1 and len(orders) == 1
    # Without the uses of the order's first half less is taken.
    monkeypatch.setattr(mixture, "in_order", lambda uses: kept(uses).filter("train_position > 0.5"))
    half = queries.source_mixing(spark, str(tmp_path)).agg(F.sum("taken")).first()[0]
    assert 0 < half < sum(r[-1] for r in want)


def test_deep_pages_and_long_lists_of_siblings(spark):
    import time

    deep = "<html><body><div class='top'>Menu</div><article>" + "<div>" * 1000 + "deep<script>var evil=1;</script><nav>menu</nav>" \
        + "</div>" * 1000 + "<p>last</p></article><footer>end</footer>"
    wide = lambda c, n: "<body><div><p>Top</p></div>" + "".join(f"<p>{c} {i}</p>" for i in range(n)) + "<ul><li>End</ul>"
    rows = "".join(f"<div><b>r{i}</b><i>k</i></div>" for i in range(3000))
    pages = [(0, "http://d.org/", deep), (1, "http://d.org/", deep.replace("last", "end")),
             *[(10 + k, "http://w.org/", wide("abcdefgh"[k], 300 + k)) for k in range(8)]]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns(
        {c: F.lit(c) for c in ("host", "seed", "slot", "constant", "__html", "key")})
    out = htmltext.extract_text(df)
    assert out.columns == [*df.columns, "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert got[0].text == "deep\nlast" and got[1].text == "deep\nend" and got[0].host == "host" and got[0].slot == "slot"
    for k in range(8):
        assert got[10 + k].text == "\n".join(f"{'abcdefgh'[k]} {i}" for i in range(300 + k))
    start = time.process_time()
    assert htmltext.tree_match(htmltext.parse(wide("a", 20_000)), htmltext.parse(wide("b", 20_007)))[0] == 20_006
    assert htmltext.tree_match(htmltext.parse("<body>" + rows), htmltext.parse("<body><hr>" + rows + "<hr>"))[0] == 9002
    assert time.process_time() - start < 30


def test_long_lists_match_as_short_ones(monkeypatch):
    rng = np.random.default_rng(8)
    page = lambda: "<body>" + "".join(f"<{t}>{rng.integers(9)}</{t}>" for t in rng.choice(["p", "h2", "ul"], 40))
    for _ in range(20):
        a, b = page(), page()
        want = htmltext.tree_match(htmltext.parse(a), htmltext.parse(b))[0]
        with monkeypatch.context() as m:
            m.setattr(htmltext, "CELLS", 30)
            size, pairs = htmltext.tree_match(htmltext.parse(a), htmltext.parse(b))
        assert size == want == len(pairs) and all(x.label == y.label for x, y in pairs)


def test_long_lists_of_elements_with_children_match_as_short_ones(monkeypatch):
    """The same pairs whatever is held at a time, and as many as plain tree matching finds."""
    rng = np.random.default_rng(9)

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return str(rng.integers(3))
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choice(["div", "ul", "section"], int(rng.integers(0, 7))))

    def plain(a, b):
        if a.label != b.label:
            return 0
        xs, ys = ([c for c in n.nodes() if not c.noise] for n in (a, b))
        table = np.zeros((len(xs) + 1, len(ys) + 1))
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + plain(x, y))
        return 1 + int(table[-1, -1])

    def matched(a, b):
        a, b = htmltext.parse(f"<body>{a}"), htmltext.parse(f"<body>{b}")
        htmltext.number(a), htmltext.number(b)
        size, pairs = htmltext.tree_match(a, b)
        assert size == len(pairs) == plain(a, b)
        return [(x.number, y.number) for x, y in pairs]

    for _ in range(60):
        a, b = tree(3), tree(3)
        want = matched(a, b)
        for cells in (0, 1, 5, 30):
            with monkeypatch.context() as m:
                m.setattr(htmltext, "CELLS", cells)
                m.setattr(htmltext, "SIZES", cells + 1, raising=False)
                assert matched(a, b) == want
    # Over 65,536 pairs of siblings; the like of a left one is one place on and has one child more.
    inner = lambda k: "".join(f"<i class='c{k % 5}'></i>" for _ in range(2 + k % 7))
    a = "".join(f"<div>{inner(k)}</div>" for k in range(280))
    b = "<div><b></b></div>" + "".join(f"<div>{inner(k)}<b></b></div>" for k in range(279))
    assert len(matched(a, b)) > 1000
    some = lambda n, more: "<section>" + "".join(f"<div>{inner(k)}{more}</div>" for k in range(n)) + "</section>"
    assert len(matched(some(18, "<b></b>") + some(20, ""), some(19, "<b></b>"))) > 60


def test_text_after_url_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rules = spark.createDataFrame(brute.RULES, "rule_host string, rule_path string, rule_verdict string")
    judged = urlfilter.url_filter(pages, rules)  # its result has a column ``host``
    got = {r.page_id: (r.host, r.text) for r in htmltext.extract_text(judged).collect()}
    assert got == {r.page_id: (brute.url_rule(r.url)[0], brute.article(r.html)) for r in pages.collect()}


def test_generated_hosts_without_article_elements(spark):
    """Hosts of one random template each, plain ``div`` pages with host text inside the story too."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], {}
    for h in range(6):
        top, links, foot, box = line(4), [line(2) for _ in range(5)], line(6), line(3)
        for k in range(14):
            paras = [line(int(rng.integers(8, 40))) for _ in range(int(rng.integers(2, 7)))]
            title = line(5)
            inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + (f"<p>{box}</p>" if h % 2 else "")
            story = f"<article>{inner}</article>" if h >= 4 else f"<div id='c'>{inner}</div>"
            pages.append((len(pages), f"http://h{h}.org/{k}", f"<html><body><div id='t'><p>{top}</p></div><div id='l'>" + "".join(
                f"<p>{x}</p>" for x in links) + f"</div>{story}<div id='f'><p>{foot}</p></div></body></html>"))
            want[len(pages) - 1] = "\n".join([title, *paras])
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in htmltext.extract_text(df).collect()} == want


PAGE = """<html><body><div class="top"><p>Our site</p></div><div id="c{n}" class="x"></div><div class="body"><h2>Title {n}</h2>
<p>Text&nbsp;number <i>{n}</i> &amp; more.<br>Next<p>Second {w}</div><div class="comments"><p>nice</p></div><div class="foot">Same end</div></body></html>"""


def test_wrapper_finds_the_varying_slot(spark):
    pages = [(n, "http://h.org/a", PAGE.format(n=n, w="word " * 20 + str(n * n))) for n in range(12)]
    pages += [(20, "http://h.org/b", None), (21, None, "<p>alone"), (22, "http://i.org/", ""), (23, "http://h.org/c", pages[0][2]),
              (24, "http://k.org/", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<script>x</script><p>" + "long " * 50_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("Text", F.lit("old"))
    for limit in (64, 0):  # broadcast and joined
        got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract_text(df, broadcast_mb=limit).collect()}
        for n in range(12):
            text = f"Title {n}\nText number {n} & more. Next\nSecond {'word ' * 20}{n * n}"
            assert got[n] == (text, len(text))
        assert got[20] == ("", 0) and got[21] == ("alone", 5) and got[22] == ("", 0) and got[23] == got[0]
        assert got[24][0] == "deep\n" + ("long " * 50_000).strip()
    assert htmltext.extract_text(df.limit(0)).count() == 0


def test_wrapper_decides_inside_articles(spark):
    page = ("<html><body><div class='top'>Site</div><article><h1>Title {n}</h1>{p}<p>Share this story</p>"
            "<div class='box'><b>Subscribe</b> today</div></article><p>End</p></body></html>")
    text = lambda n: [f"Part {n} {k} " + f"word{n} " * 9 for k in range(1 + n % 4)]
    html = lambda n, more="": page.format(n=n, p="".join(f"<p>{t}</p>" for t in text(n))) + more
    want = lambda n: "\n".join([f"Title {n}", *(t.strip() for t in text(n))])
    pages = [(n, "http://h.org/a", html(n)) for n in range(12)]
    pages += [(100 + n, "http://h.org/b", html(3, f"<!-- {n} -->")) for n in range(30)]  # copies of an article
    pages += [(200 + n, "http://c.org/", html(5, f"<!-- {n} -->")) for n in range(9)]  # a host of copies
    pages += [(300 + n, "http://d.org/", html(6 + n % 2, f"<!-- {n} -->")) for n in range(40)]  # of two
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in htmltext.extract_text(df).collect()}
    share = "\nShare this story\nSubscribe today"
    assert all(got[n] == want(n) for n in range(12)) and all(got[100 + n] == want(3) for n in range(30))
    assert all(got[200 + n] == want(5) + share for n in range(9))  # copies say nothing
    assert all(got[300 + n] == want(6 + n % 2) + share for n in range(40))


def test_class_words_of_containers_hide_nothing():
    side, end = '<div class="sidebar"><p>menu</p></div>', '<div class="comments"><article class="comment"><p>nice</p></article></div>'
    text = "<p>The story.</p>"
    for page in ('<body class="single has-sidebar"><article>{t}</article>{s}{e}', '<html class="no-cookie"><body><main>{t}</main>{s}{e}',
                 '<html class="cookie"><body class="ad"><main class="widget">{t}</main>{s}{e}', '<div id="page" class="content with-sidebar">{t}{s}</div>',
                 '<div class="content-sidebar-wrap"><article>{t}</article>{s}{e}</div>', '<article class="post related">{t}{s}</article>',
                 '<main><div class="story widget">{t}</div></main>{s}{e}', '<div class="story widget">{t}{s}</div>',
                 '<main class="related">{t}</main>{s}{e}', '<article>{t}{s}</article><div class="related"><article>other</article></div>'):
        html = page.format(t=text, s=side, e=end)
        assert htmltext.extract(htmltext.parse(html), None, 0, []) == "The story.", html


def test_tree_match_counts_pairs():
    a = htmltext.parse("<div><p>1</p><ul><li>a<li>b</ul><p>2</p></div>")
    b = htmltext.parse("<div><ul><li>a<li>b<li>c</ul><p>2</p></div>")
    size, pairs = htmltext.tree_match(a, b)
    assert size == len(pairs) == 6  # root, div, ul, two li, one p
