"""Event streams (beyond the batch tables): sessions by gaps, and windowed word counts with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def session_gaps(events: DataFrame, gap_hours: float = 12.0) -> DataFrame:
    """Batch: sessions of a user, split where events lie more than gap_hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce(micros - F.lag(micros).over(w) > int(gap_hours * 3_600_000_000), F.lit(True))
    rows = events.withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))


def streaming_sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Streaming: the same by session windows; ts must be a timestamp."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))


def streaming_word_counts(texts: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Streaming: token counts in tumbling windows of `ts`."""
    words = texts.withWatermark("ts", late).select("ts", F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy(F.window("ts", window), "token").agg(F.count("*").alias("n"))
