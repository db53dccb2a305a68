"""Session and file housekeeping, as listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_days, age_hours

#: Hours that files of each class are kept.
KEEP_HOURS = {"debug": 168, "results": 720, "sessions": 168, "tmp": 24}


def session_inventory(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Per session: status, time of creation, chunks there are and chunks in all, bytes; newest first, then one row of totals (null session)."""
    sums = files.groupBy("conv_id").agg(F.sum((F.col("class") == "results").cast("long")).alias("chunks"), F.sum("size").alias("bytes"))
    met = sessions.join(sums, "conv_id", "left").select("session_id", "status", "created", F.coalesce("chunks", F.lit(0)).alias("chunks"), "total_chunks", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    out = met.cube("session_id").agg(F.when(F.grouping("session_id") == 0, F.max("status")).alias("status"), F.when(F.grouping("session_id") == 0, F.max("created")).alias("created"), F.sum("chunks").alias("chunks"), F.sum("total_chunks").alias("total_chunks"), F.sum("bytes").alias("bytes"), F.count("*").alias("sessions"))
    return out.orderBy(F.col("created").desc_nulls_last(), "session_id")


def expired_sessions(sessions: DataFrame, as_of: Column, days: int = 7, at_least: bool = False) -> DataFrame:
    """Sessions to delete: older than `days`, or with at_least that old or older."""
    age = age_days(F.col("created"), as_of)
    return sessions.withColumn("age_days", age).where(age >= days if at_least else age > days)


def expired_files(files: DataFrame, as_of: Column, keep: dict[str, int] | None = None) -> DataFrame:
    """Files at or beyond the age of their class."""
    spark = files.sparkSession
    policy = spark.createDataFrame([*(keep or KEEP_HOURS).items()], "class string, keep_hours long")
    age = age_hours(F.col("modified"), as_of)
    return files.join(F.broadcast(policy), "class").withColumn("age_hours", age).where(F.col("age_hours") >= F.col("keep_hours"))


def freed(files: DataFrame) -> DataFrame:
    """Per class of expired files: how many, and how many bytes their deletion frees."""
    return files.groupBy("class").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def last_touch(files: DataFrame, as_of: Column, ttl_hours: int) -> DataFrame:
    """Per session its last touch, and whether that lies further back than the time to live."""
    last = files.groupBy("conv_id").agg(F.max("modified").alias("last_touch"))
    return last.withColumn("expired", F.timestamp_diff("HOUR", F.col("last_touch"), as_of) >= ttl_hours)


def newest(df: DataFrame, n: int, *by: str) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in by]).limit(n)
