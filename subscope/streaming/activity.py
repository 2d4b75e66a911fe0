"""Structured Streaming forms of the activity metrics.

* ``daily_active_users_stream``: exact DAU per event-time day. (user, day) pairs
  are deduplicated with state bounded by the watermark, then counted per
  1-day window; a day is emitted once the watermark passes its end (append).
* ``inactivity_alerts_stream``: the "no login for N days" alert. A session window
  of N days per user goes on while the user comes back in time; once the
  watermark passes its end, N days after the last session, it is emitted as the
  alert (append). Every idle period gives one alert, whether or not the user
  came back since, so the result does not depend on how the input falls into
  triggers. It is all built-in state, without Python.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope import schema as S

def session_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Sessions arriving as Parquet files in a folder (schema given, never inferred)."""
    r = spark.readStream.schema(S.USER_SESSIONS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def _event_time(sessions: DataFrame) -> DataFrame:
    # DATE (or timestamp_ntz) -> TIMESTAMP: watermarks need a TIMESTAMP column
    return sessions.select(F.col("user_id"), F.col("session_date").cast("timestamp").alias("ts"))


def daily_active_users_stream(sessions: DataFrame, lateness: str = "2 days") -> DataFrame:
    ev = _event_time(sessions).withWatermark("ts", lateness)
    pairs = ev.dropDuplicates(["user_id", "ts"])
    return (pairs.groupBy(F.window("ts", "1 day").alias("day"))
            .agg(F.count(F.lit(1)).alias("dau"))
            .select(F.col("day.start").cast("date").alias("session_date"), "dau"))


def inactivity_alerts_stream(sessions: DataFrame, gap_days: int = 10, lateness: str = "1 day") -> DataFrame:
    ev = _event_time(sessions).withWatermark("ts", lateness)
    # a session exactly gap_days after the last one still continues the window
    gap = F.session_window("ts", f"{gap_days} days 1 microsecond")
    return (ev.groupBy("user_id", gap.alias("active")).agg(F.max("ts").alias("last_session"))
            .select("user_id", "last_session",
                    (F.col("last_session") + F.expr(f"INTERVAL {gap_days} DAYS")).alias("alert_after")))


def batch_inactivity(sessions: DataFrame, watermark: dt.datetime, gap_days: int) -> DataFrame:
    """Batch reference for the stream: users whose last session + gap is before the watermark."""
    last = sessions.groupBy("user_id").agg(F.max(F.col("session_date").cast("timestamp")).alias("last_session"))
    return (last.withColumn("alert_after", F.col("last_session") + F.expr(f"INTERVAL {gap_days} DAYS"))
            .where(F.col("alert_after") < F.lit(watermark)))
