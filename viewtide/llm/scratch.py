"""Intermediate tables in the shared folder of the cluster.

A loop that reads its own result writes it as Parquet and reads it again: any executor can
reread a lost part, plans stay short, and Spark plans later joins from true file sizes
(the size estimates of a checkpoint multiply with every join of a loop).
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from viewtide.session import shared_dir

FREE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

_roots: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's scratch root, which is removed at normal exit."""
    root = next((r for r, s in _roots.items() if s is spark), None)
    if root is None:
        root = f"{shared_dir(spark).rstrip('/')}/viewtide-{uuid.uuid4().hex}"
        _roots[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table", free: bool = False) -> DataFrame:
    """The rows of ``df``, computed once and stored. With ``free`` the shuffle files that it
    took are deleted as soon as it is stored, not when the driver next collects garbage."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    before = spark.conf.get(FREE_SETTING, "false")
    try:
        if free:
            spark.conf.set(FREE_SETTING, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def map_text(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH_BYTES``, unless the session sets a size.

    Spark's default of 64 MB is held several times at once: in Arrow buffers of the
    executor, beside its heap, and in the Python worker of each running task.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


@atexit.register
def clear() -> None:
    """Remove the scratch folders of sessions that are still running."""
    for root, spark in list(_roots.items()):
        _roots.pop(root)
        if spark.sparkContext._jsc is None:
            continue
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be ending; nothing depends on this
            return
