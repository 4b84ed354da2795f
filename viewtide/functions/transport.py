"""Columns on their way through Python tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_times(df: DataFrame) -> DataFrame:
    """Zoned timestamps as microseconds: Arrow labels them with the session's zone name,
    which need not be the one Spark expects back."""
    return df.select(*[F.unix_micros(n).alias(n) if t == "timestamp" else F.col(n) for n, t in df.dtypes])


def unpack_times(df: DataFrame, like: DataFrame) -> DataFrame:
    """Undo ``pack_times`` for the columns that are timestamps in ``like``."""
    times = {n for n, t in like.dtypes if t == "timestamp"}
    return df.select(*[F.timestamp_micros(n).alias(n) if n in times else F.col(n) for n in df.columns])


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
