"""Token counts kept up to date by signed deltas.

A batch of changes (documents inserted, deleted, or counted anew) becomes one small table
of signed sums by source, language and tokenizer version. A batch is committed under its
own id: committing it again replaces nothing and adds nothing. Totals are the sums of all
committed batches, and ``compact`` folds them into one snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide.llm.scratch import map_text

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint, chars bigint"

#: Native tokenizer versions: name to the number of tokens of a text column.
NATIVE: dict[str, Callable[[str], Column]] = {
    "words-1": lambda c: F.regexp_count(F.col(c), F.lit(r"[^\x20\x09-\x0D]+")),
    "pieces-1": lambda c: F.regexp_count(F.col(c), F.lit(r"[A-Za-z]+|[0-9]|[^\x00-\x7F]+|[!-/:-@\[-`{-~]")),
}


def count_with(docs: DataFrame, text: str, path: str, name: str = "tokens") -> DataFrame:
    """``docs`` plus the token count by a tokenizer file (``tokenizers`` JSON) at ``path``,
    a place that every executor can read. Null texts have 0 tokens."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True
        for batch in batches:
            texts, counts = batch.column(text), []
            for i in range(0, len(texts), 64):
                part = [t or "" for t in texts.slice(i, 64).to_pylist()]
                counts += [len(e.ids) for e in coder.encode_batch(part, add_special_tokens=False)]
            kept = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(counts, pa.int64())],
                                             names=[*kept, name])

    fields = [f for f in docs.schema.fields if f.name != name]
    return map_text(docs.select(*[f.name for f in fields]), run, T.StructType([*fields, T.StructField(name, T.LongType())]))


def counted(docs: DataFrame, versions: Sequence[str] = ("words-1",), text: str = "text") -> DataFrame:
    """``source, lang, tokenizer, tokens, chars``: one row per document and version."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.coalesce(NATIVE[v](text), F.lit(0)).cast(
        "bigint").alias("tokens")) for v in versions]))
    rows = docs.select("*", each.alias("__c"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("__n"))
    plain = [c for c in docs.columns if c.lower() not in ("tokenizer", "tokens", "chars")]
    return rows.select(*plain, "__c.tokenizer", "__c.tokens", F.col("__n").alias("chars"))


def deltas(inserted: DataFrame | None = None, deleted: DataFrame | None = None,
           revised: DataFrame | None = None) -> DataFrame:
    """Signed sums of one batch. Inserts and deletes have ``source, lang, tokenizer,
    tokens, chars``; revisions have ``old_tokens`` and ``old_chars`` too and move no
    documents. Null keys are groups of their own; null counts are 0. Sums are taken before
    the shuffle, so a source of any share costs one row per task."""
    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*KEYS, F.lit(sign).cast("bigint").alias("docs"),
                         *[(F.coalesce(F.col(c), F.lit(0)) * sign).cast("bigint").alias(c) for c in ("tokens", "chars")])

    parts = [signed(df, sign) for df, sign in ((inserted, 1), (deleted, -1)) if df is not None]
    if revised is not None:
        parts.append(revised.select(*KEYS, F.lit(0).cast("bigint").alias("docs"), *[
            (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"old_{c}"), F.lit(0))).cast("bigint").alias(c)
            for c in ("tokens", "chars")]))
    if not parts:
        raise ValueError("a batch needs inserts, deletes or revisions")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")])


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def commit(batch: DataFrame, path: str, batch_id: str) -> bool:
    """Store a batch of deltas under its id; False if that id is committed already.

    Spark writes the success mark last. A batch that broke off has none and is replaced
    when it is sent again; a batch that has one is never written twice.
    """
    target = f"{path}/batch={batch_id}"
    if _exists(batch.sparkSession, f"{target}/_SUCCESS"):
        return False
    batch.write.mode("overwrite").parquet(target)
    return True


def totals(spark: SparkSession, path: str, batch_ids: Sequence[str]) -> DataFrame:
    """``source, lang, tokenizer, docs, tokens, chars`` over committed batches; groups that
    deletes have emptied are gone."""
    done = [f"{path}/batch={b}" for b in dict.fromkeys(batch_ids) if _exists(spark, f"{path}/batch={b}/_SUCCESS")]
    rows = spark.read.schema(SCHEMA).parquet(*done) if done else spark.createDataFrame([], SCHEMA)
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")]).filter(
        "docs <> 0 OR tokens <> 0 OR chars <> 0")


def compact(spark: SparkSession, path: str, batch_ids: Sequence[str], snapshot_id: str) -> bool:
    """Store the totals of some batches as one batch that stands for them."""
    return commit(totals(spark, path, batch_ids), path, snapshot_id)
