"""Canonical table readers and writers (batch and streaming)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewtide import schema
from viewtide.config import CountingConfig
from viewtide.functions.calendar import at


def read_table(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    """Read with a fixed schema: no inference pass, and pruned to the columns used."""
    return spark.read.schema(ddl).format(fmt).load(path)


def read_view_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Requests whose ids are a scalar, an array, or text. JSON ids are read as text
    first because one feed may mix scalars and arrays."""
    if fmt != "json":
        return read_table(spark, path, schema.VIEW_REQUESTS, fmt)
    raw = spark.read.schema(schema.RAW_REQUESTS).json(path)
    return raw.withColumn("post_ids", ids_from_text("post_id")).drop("post_id")


def ids_from_text(name: str) -> Column:
    """``7``, ``"7"``, ``[7, "8"]`` → array of text ids."""
    text = F.trim(name)
    many = F.from_json(text, "array<string>")
    return F.when(text.startswith("["), many).otherwise(F.array(F.col(name)))


def stream_view_requests(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """The same feed as an unbounded source over arriving files."""
    ddl = schema.RAW_REQUESTS if fmt == "json" else schema.VIEW_REQUESTS
    raw = spark.readStream.schema(ddl).options(**options).format(fmt).load(path)
    if fmt == "json":
        raw = raw.withColumn("post_ids", ids_from_text("post_id")).drop("post_id")
    return raw


def term_sets(post_terms: DataFrame, taxonomies=("category", "post_tag")) -> DataFrame:
    """One row per post with its distinct category ids and tag ids, sorted."""
    category, tag = taxonomies
    def ids(taxonomy):
        return F.sort_array(F.collect_set(F.when(F.col("taxonomy") == taxonomy, F.col("term_id"))))

    return (post_terms.filter(F.col("taxonomy").isin(category, tag))
            .groupBy("post_id").agg(ids(category).alias("categories"), ids(tag).alias("tags")))


def engagement_metrics(df: DataFrame, comments="comments", likes="likes", shares="shares") -> DataFrame:
    """Metrics under configurable column names, missing values as 0."""
    def pick(name, alias):
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(alias)

    return df.select("post_id", pick(comments, "comments"), pick(likes, "likes"), pick(shares, "shares"))


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path, whatever store it is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path), hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration()) \
        if "://" in path else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What ``write_pointer`` last put there; None before the first time."""
    at, files = _files(spark, path)
    if not files.util().exists(at):
        return None
    stream = files.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_pointer(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small file as a whole: readers see the old content or the new one."""
    at, files = _files(spark, path)
    hadoop, jvm = spark._jvm.org.apache.hadoop.fs, spark._jvm
    new = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE)
    options = spark._sc._gateway.new_array(hadoop.Options.CreateOpts, 1)
    options[0] = hadoop.Options.CreateOpts.createParent()
    stream = files.create(new, flags, options)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    rename = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    rename[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(new, at, rename)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none if there is no such folder."""
    at, files = _files(spark, path)
    return [s.getPath().getName() for s in files.util().listStatus(at)] if files.util().exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def _log_offset(spark: SparkSession, path: str, offset: int | None) -> int | None:
    """The rollover minutes that a log is laid out by; another one is refused."""
    stored = (read_pointer(spark, f"{path.rstrip('/')}.layout") or {}).get("offset")
    if None not in (stored, offset) and stored != offset:
        raise ValueError(f"the view log {path} has days that start {stored} minutes past midnight, not {offset}")
    return offset if stored is None else stored


def write_views(views: DataFrame, path: str, offset: int | None = None, mode: str = "append") -> None:
    """Append to the view log, partitioned by counting day so period scans prune.

    ``offset`` is the rollover minute (``CountingConfig.rollover_minutes``, 1 by default). It
    is stored beside the log with its first rows; later writes and reads take it from there,
    and one that names another is refused. Rows keep their input partitioning: a day that holds most of the rows is written by
    every task that has some of it, not by one task.
    """
    spark = views.sparkSession
    known = _log_offset(spark, path, offset)
    if known is None:
        known = CountingConfig.rollover_minutes
    write_pointer(spark, f"{path.rstrip('/')}.layout", {"offset": known})
    day = F.to_date(F.col("ts") - F.expr(f"INTERVAL {known} MINUTE"))
    views.withColumn("site_day", day).write.mode(mode).partitionBy("site_day").parquet(path)


def read_views(spark: SparkSession, path: str, first=None, until=None, offset: int | None = None) -> DataFrame:
    """The view log between two instants (``first`` included, ``until`` not; None is open).

    Limits on ``ts`` come with the limits they imply on ``site_day``, so only the folders of
    those days are listed and opened. The log's own ``offset`` decides which these are."""
    log, offset = spark.read.parquet(path), _log_offset(spark, path, offset)
    offset = CountingConfig.rollover_minutes if offset is None else offset
    day = f"to_date({{}} - INTERVAL {offset} MINUTE)"
    if first is not None:
        log = log.filter(f"ts >= {at(first)} AND site_day >= {day.format(at(first))}")
    if until is not None:
        log = log.filter(f"ts < {at(until)} AND site_day <= {day.format(at(until))}")
    return log.drop("site_day")


def write_version(df: DataFrame, path: str, as_of: str) -> str:
    """Write one run of a table under its ``as_of`` version; a rerun replaces it."""
    target = f"{path}/as_of={as_of.replace(' ', 'T').replace(':', '-')}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_version(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    return spark.read.parquet(f"{path}/as_of={as_of.replace(' ', 'T').replace(':', '-')}")


def write_trending(run: DataFrame, path: str, as_of: str, debug_size: int = 50) -> None:
    """Write a run's list and its debug rows. ``run`` is a written or checkpointed table."""
    write_version(run.filter(F.col("position").isNotNull()), f"{path}/trending", as_of)
    write_version(run.filter(F.col("score_rank") <= debug_size), f"{path}/trending_debug", as_of)


def neutral_shape(spark: SparkSession) -> DataFrame:
    """The reset state of the learned traffic shape."""
    one = F.lit(1.0)
    return spark.range(1).select(F.array_repeat(one, 24).alias("hour"), F.array_repeat(one, 7).alias("wday"))


def live_state(state: DataFrame, as_of, ewma_h: float, score_h: float, streak_h: float) -> DataFrame:
    """State columns that are still inside their time to live at ``as_of``, else NULL."""
    def alive(at_col: str, hours: float, value: str) -> str:
        age = f"unix_micros({at(as_of)}) - unix_micros({at_col})"
        return f"CASE WHEN {age} BETWEEN 0 AND {int(hours * 3_600_000_000)} THEN {value} END AS {value}"

    return state.selectExpr(
        "segment", "post_id",
        *[alive("ewma_at", ewma_h, v) for v in ("ewma", "ewma_at")],
        *[alive("score_at", score_h, v) for v in ("last_score", "score_at")],
        *[alive("streak_at", streak_h, v) for v in ("streak", "streak_at")],
    )
