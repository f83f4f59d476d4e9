"""The interval operators over streams: windows by event time, and intervals stitched into sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_scores(events: DataFrame, window: str = "10 seconds", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """events (key, ts, score) -> counts, greatest and summed scores per key and window; rows later than `late` are
    dropped. TIMESTAMP_NTZ columns must be cast to TIMESTAMP first."""
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy("key", frame.alias("w")).agg(F.count("*").alias("n_events"), F.max("score").alias("max_score"), F.sum("score").alias("sum_score"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "max_score", "sum_score")


def stitched(events: DataFrame, gap_s: float = 0.0, late: str = "1 minute") -> DataFrame:
    """events (key, ts, duration_s, score) -> sessions of events that overlap or are at most gap_s apart."""
    length = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, CAST(greatest(duration_s + {float(gap_s)}, 0.000001) AS DECIMAL(18,6)))")
    out = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", length).alias("w")).agg(F.max("score").alias("score"), F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), (F.col("w.end") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, CAST({float(gap_s)} AS DECIMAL(18,6)))")).alias("end"), "score", "n")
