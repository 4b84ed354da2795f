from datetime import datetime, timedelta

from pyspark.sql import functions as F

EPOCH = datetime(2024, 1, 1)


def at(**delta):
    return EPOCH + timedelta(**delta)


def views_df(spark, rows):
    """rows: (event_id, post_id, ts[, ip_hash])"""
    rows = [(*r, None)[:4] for r in rows]
    df = spark.createDataFrame(rows, "event_id bigint, post_id bigint, ts timestamp_ntz, ip_hash string")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def posts_df(spark, rows):
    """rows: dicts with at least post_id"""
    base = {"post_type": "post", "status": "publish", "author_id": 1, "published_at": datetime(2023, 1, 1),
            "title": "t", "link": "/l", "excerpt": "e", "thumbnail": None, "site": "a"}
    ddl = ("post_id bigint, post_type string, status string, author_id bigint, published_at timestamp_ntz, "
           "title string, link string, excerpt string, thumbnail string, site string")
    cols = [f.split()[0] for f in ddl.split(", ")]
    full = [{**base, **r} for r in rows]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in full], ddl)
    return df.withColumn("published_at", F.col("published_at").cast("timestamp"))


def terms_df(spark, rows):
    return spark.createDataFrame(rows, "post_id bigint, taxonomy string, term_id bigint, slug string, name string")


def counters_df(spark, rows):
    ddl = ("post_id bigint, total bigint, day bigint, week bigint, month bigint, yesterday bigint, "
           "last_week bigint, last_month bigint")
    return spark.createDataFrame([(*r, *([None] * (8 - len(r)))) for r in rows], ddl)


def dicts(df, *order):
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]
