"""Registered queries of the operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.llm import (
    decontaminate, dedup, htmltext, interaction, language, mixture, negatives, quality, repetition, rollup,
    secretscan, suffixes, urlfilter)
from viewtide.llm.scratch import folder, keep

#: The rules of op9, as host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.near_duplicates(table(spark, sf_dir, "documents"), ngram=3, percent=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training order is written use by use at its position; a document's taken words are
    those of its uses in it."""
    mixed = keep(mixture.mix(table(spark, sf_dir, "documents")), "mixed")
    used = mixture.uses(mixed).select("place", "supply", "size", "use_no", "train_position")
    order = keep(mixture.in_order(used), "order")
    # A document with words is known by its place in the supply.
    taken = order.groupBy(F.col("place").alias("p"), F.col("supply").alias("s")).agg(F.sum("size").alias("words"))
    rows = mixed.join(taken, (F.col("place") == F.col("p")) & (F.col("supply") == F.col("s")) & (F.col("size") > 0), "left")
    return rows.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", F.coalesce("words", F.lit(0).cast("bigint")).alias("taken"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under one tokenizer; a second batch deletes the toxic
    ones and is sent twice, as after a lost answer; a third inserts the others under a
    second tokenizer version with rough counts, a fourth revises those to the true ones."""
    docs, path = table(spark, sf_dir, "documents"), folder(spark, "rollup")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    # Texts are counted once, before anything is joined.
    counts = keep(rollup.counted(docs, ("words-1", "pieces-1")).select("doc_id", *rollup.KEYS, "tokens", "chars"), "counts")
    words = counts.filter("tokenizer = 'words-1'")
    rollup.commit(rollup.deltas(inserted=words), path, "load")
    gone = words.join(toxic, "doc_id", "left_semi")
    for _ in range(2):
        rollup.commit(rollup.deltas(deleted=gone), path, "toxic")
    rough = counts.filter("tokenizer = 'pieces-1'").join(toxic, "doc_id", "left_anti").withColumns(
        {"old_tokens": F.floor(F.col("chars") / 4), "old_chars": F.col("chars")})
    first = rough.drop("tokens").withColumnRenamed("old_tokens", "tokens")
    rollup.commit(rollup.deltas(inserted=first), path, "rough")
    rollup.commit(rollup.deltas(revised=rough), path, "revised")
    return rollup.totals(spark, path, ["load", "toxic", "rough", "revised"])


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out()))
    found = language.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule_host string, rule_path string, rule_verdict string")
    return urlfilter.url_filter(table(spark, sf_dir, "pages"), rules, carry=["page_id"])


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = interaction.failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interaction.audit(cells)


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept_bytes", 256).alias("kept_sha256"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integer_rows(table(spark, sf_dir, "embeddings"), label)
    return negatives.mine(rows, F.col("id") % 100 == 0)


QUERIES = {
    "op1_near_dedup": near_dedup,
    "op2_quality_resampling": quality_resampling,
    "op3_source_mixing": source_mixing,
    "op4_benchmark_decontamination": benchmark_decontamination,
    "op5_secret_scan": secret_scan,
    "op6_quality_rules": quality_rules,
    "op7_token_counts": token_counts,
    "op8_language_id": language_id,
    "op9_url_filter": url_filter,
    "op10_html_text": html_text,
    "op11_filter_audit": filter_audit,
    "op12_suffix_dedup": suffix_dedup,
    "op13_hard_negatives": hard_negatives,
}
