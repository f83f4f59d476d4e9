"""Fixed windows over recordings: grid, salience summary, and the most salient fraction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.intervals import segment_id
from tidemark.operators.metrics import running


def grid_windows(recordings: DataFrame, window_s: float = 10.0) -> DataFrame:
    """(wav_id, duration_s) -> (seg_id, wav_id, k, start, end). The tail is dropped; a recording shorter than one window
    is one window as long as itself."""
    d = F.col("duration_s")
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(d / window_s).cast("int") - 1))).alias("k")
    rows = recordings.select("wav_id", "duration_s", k)
    end = F.when(d < window_s, d).otherwise((F.col("k") + 1) * F.lit(float(window_s)))
    return rows.select(segment_id(F.col("wav_id"), F.col("k")).alias("seg_id"), "wav_id", "k", (F.col("k") * F.lit(float(window_s))).alias("start"), end.alias("end"))


def summarise(windows: DataFrame, events: DataFrame) -> DataFrame:
    """windows with n_events, max_score, sum_score of the events (wav_id, k, score) found in each."""
    stats = events.groupBy("wav_id", "k").agg(F.count("*").alias("n_events"), F.max("score").alias("max_score"), F.sum("score").alias("sum_score"))
    return windows.join(stats, ["wav_id", "k"], "left").fillna(0, ["n_events", "max_score", "sum_score"])


def select_top(scored: DataFrame, keep: float, rank_by: str = "sum_score", scope: str = "per_recording") -> DataFrame:
    """Windows with events; of these the best ceil(keep * n), at least one, per recording or of all. Ties keep the
    order (wav_id, start)."""
    rows = scored.where("n_events > 0")
    if scope == "per_recording":
        order = Window.partitionBy("wav_id").orderBy(F.desc(rank_by), "start")
        kept = rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy("wav_id")))
        return kept.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.lit(keep) * F.col("_n")))).drop("_r", "_n")
    if scope != "global":
        raise ValueError(f"scope {scope!r}: per_recording or global")
    # The value at which the count is reached, from running counts per value; only rows of that value are ranked.
    most = max(1, math.ceil(keep * rows.count()))
    values = running(rows.groupBy(F.col(rank_by).cast("double").alias("v")).agg(F.count("*").alias("n")), "v", ["n"])
    limit = values.where(F.col("cum_n") >= most).orderBy(F.desc("v")).first()
    if limit is None:
        return rows
    ties = rows.where(F.col(rank_by) == limit.v).orderBy("wav_id", "start").limit(int(most - (limit.cum_n - limit.n)))
    return rows.where(F.col(rank_by) > limit.v).unionByName(ties)
