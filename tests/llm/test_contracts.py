"""Registered queries against brute force on the smallest tables, and against their SQL."""

from collections import Counter

import duckdb
import pytest

import check
import corpus_pipeline
from tests.llm import brute
from viewtide.llm.oracle import ORACLE
from viewtide.llm.queries import QUERIES, html_text, url_filter


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def rows(spark, sf, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, sf).select(*columns).orderBy(columns[0]).collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE[name])
    assert check.rows_of(df.columns, df.collect()) == check.rows_of([c[0] for c in cur.description], cur.fetchall())


def test_near_dedup(spark, sf, docs):
    assert rows(spark, sf, "op1_near_dedup", "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(
        [d[:2] for d in docs])


def test_mixing(spark, sf, docs):
    want = {r[0]: r for r in brute.mixed([(i, t, s) for i, t, _, s in docs])}
    assert {r[0]: r[4] for r in rows(spark, sf, "op3_source_mixing", "doc_id", "size", "source_size", "target", "taken")} == {
        i: r[4] for i, r in want.items()}
    sizes, source, taken, longest = Counter(), {}, Counter(), Counter()
    for i, text, _, name in docs:
        n = len(brute.SPACE.findall(text or ""))
        sizes[name] += n
        longest[name] = max(longest[name], n)
        source[i] = name
    want = brute.targets(sizes)
    for i, size, source_size, target, used in rows(
            spark, sf, "op3_source_mixing", "doc_id", "size", "source_size", "target", "taken"):
        assert source_size == sizes[source[i]] and target == pytest.approx(want[source[i]]) and used in (0, size, 2 * size, 3 * size)
        taken[source[i]] += used
    # Whole documents: half of one may be missing or too much.
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 for s in want)


def test_decontamination(spark, sf, con, docs):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert rows(spark, sf, "op4_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                "contaminated") == brute.contamination([d[:2] for d in docs], items)


def test_secrets(spark, sf, docs):
    got = rows(spark, sf, "op5_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == [(i, *brute.base_secrets(t)[:4]) for i, t, *_ in docs]


def test_quality_rules(spark, sf, docs):
    got = rows(spark, sf, "op6_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
               "n_repeat_words", "base_failed", "kept")
    assert got == [(i, *brute.repetition(t)) for i, t, *_ in docs]


def test_quality_sample_follows_labels(spark, sf, con):
    kept = dict(rows(spark, sf, "op2_quality_resampling", "doc_id", "kept"))
    labels = con.execute("SELECT doc_id, quality FROM labels").fetchall()
    assert sum(kept[i] == bool(q) for i, q in labels) / len(labels) > 0.9
    share = sum(q for _, q in labels) / len(labels)
    assert sum(kept.values()) == int(share * len(kept) + 0.5)


def test_language_on_held_out_rows(spark, sf, docs):
    lang = {d[0]: d[2] for d in docs}
    got = rows(spark, sf, "op8_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert all(h == brute.held_out(i) and 0 <= s <= 1 for i, h, _, s in got)
    held = [(i, p) for i, h, p, _ in got if h]
    assert sum(lang[i] == p for i, p in held) / len(held) > 0.95


def test_url_rules(spark, sf, con):
    pages = con.execute("SELECT page_id, url FROM pages ORDER BY 1").fetchall()
    got = [tuple(r) for r in url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    for (i, *g), (j, url) in zip(got, pages, strict=True):
        host, path, rule, verdict = brute.url_rule(url)
        assert (i, *g[:3]) == (j, host, path, rule) and g[3] == (verdict or g[3])


def test_html_text(spark, sf, con):
    pages = con.execute("SELECT page_id, url, html FROM pages ORDER BY 1").fetchall()
    got = [tuple(r) for r in html_text(spark, sf).select("page_id", "url", "text", "n_chars").orderBy("page_id").collect()]
    assert got == [(i, u, brute.article(h), len(brute.article(h))) for i, u, h in pages]


def test_pipeline(spark, sf, con, docs):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "use_no", "train_position"]
    got = out.collect()
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    texts = {i: t for i, t, *_ in docs}
    unique = {i for i, _, least, kept in brute.near_duplicates([d[:2] for d in docs], 5, 80, 100) if kept}
    clean = {r[0] for r in brute.contamination([d[:2] for d in docs], items) if not r[5]}
    used = {r.doc_id for r in got}
    assert used <= unique & clean
    assert len({(r.doc_id, r.use_no) for r in got}) == len(got) and max(r.use_no for r in got) <= 2
    assert all(not any(brute.base_secrets(r.text)[:3]) and r.n_chars == len(r.text) for r in got)
    # Every clean, first document of a source that is short of its target is used.
    sizes, source = Counter(), {d[0]: d[3] for d in docs}
    for i in unique & clean:
        sizes[source[i]] += len(brute.SPACE.findall(texts[i]))
    full = {s for s, t in brute.targets(sizes).items() if t >= 1.05 * sizes[s]}
    assert {i for i in unique & clean if source[i] in full and brute.SPACE.search(texts[i])} <= used
    position = [r.train_position for r in out.select("train_position").collect()]
    assert all(0 <= p <= 1 for p in position)


def test_pipeline_edges(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, ""), (None, "the and of that with from this"), (-1, "\n"), (-2, "q"), (-2, "q")],
                                "doc_id bigint, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    names = ["score", "lang_pred", "unlike", "kept", "size", "n_words", "items", "redacted", "spans", "copy", "__i", "__id"]
    some = docs.filter("doc_id < 60").unionByName(odd, allowMissingColumns=True).withColumns({c: F.concat(F.lit(c), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))) for c in names})
    for name, df in (("odd", some), ("empty", some.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert out.columns == [*some.columns, "use_no", "train_position"]
    got = out.collect()
    assert {r.doc_id for r in got} > {None} and all(r[c] == c + ("" if r.doc_id is None else str(r.doc_id)) for r in got for c in names)
    assert all(r.text for r in got) and -1 not in {r.doc_id for r in got}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
