"""Gaps and islands: interval unions and the step from a salience curve to scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import session


#: Stretches of time that the events of an overfull key are dealt to.
STRETCHES = 1024


def numbered(events: DataFrame, keys: list[str], starts: Column, end: Column | None = None) -> DataFrame:
    """Numbers islands (column island) within keys by onset; starts(previous greatest end as _end) opens one. end: what
    an event reaches to, its offset if not said.

    A key with more than session.ONE_TASK events is never sorted by one task: events are dealt to stretches of time, each
    gets the greatest end and the number of islands of the stretches before it, and goes on from there."""
    end = F.col("offset_s") if end is None else end
    if session.fullest(events, keys) <= session.ONE_TASK:
        return _numbered(events, keys, starts, end)
    low, high = events.agg(F.min("onset_s"), F.max("onset_s")).first()
    width = max((high - low) / STRETCHES, 1e-9)
    dealt = events.withColumn("_reach", end).withColumn("_cell", F.floor((F.col("onset_s") - low) / width).cast("int"))
    by, wide = [*keys, "_cell"], Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)

    def brought(rows: DataFrame, total: Column, over, name: str) -> DataFrame:
        """rows with what the key's earlier stretches bring: at most STRETCHES rows of a key stand in the window."""
        sums = rows.groupBy(*by).agg(total.alias("_t")).withColumn(name, over("_t").over(wide)).drop("_t")
        return rows.join(sums.select(*(F.col(c).alias(c) for c in (*by, name))), by)

    order = Window.partitionBy(*by).orderBy("onset_s", "offset_s")
    rows = session.cut(brought(dealt, F.max("_reach"), F.max, "_before"))
    rows = rows.withColumn("_end", F.greatest("_before", F.max("_reach").over(order.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.withColumn("_new", F.when(F.col("_end").isNull() | starts, 1).otherwise(0))
    rows = brought(session.cut(rows), F.sum("_new"), F.sum, "_count")
    island = F.coalesce("_count", F.lit(0)) + F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).drop("_end", "_new", "_reach", "_cell", "_before", "_count")


def _numbered(events: DataFrame, keys: list[str], starts: Column, end: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("onset_s", "offset_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("_end", F.max(end).over(before)).withColumn("_new", F.when(F.col("_end").isNull() | starts, 1).otherwise(0))
    return marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_end", "_new")


def stitch(events: DataFrame, keys: list[str], gap_s: float = 0.0) -> DataFrame:
    """Events that overlap, touch or are at most gap_s apart become one, with the greatest score."""
    found = numbered(events, keys, F.col("onset_s") > F.col("_end") + F.lit(gap_s))
    return found.groupBy(*keys, "island").agg(F.min("onset_s").alias("onset_s"), F.max("offset_s").alias("offset_s"), F.max("score").alias("score")).drop("island")


def interval_union(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of intervals; touching ones join."""
    found = numbered(spans, keys, F.col("onset_s") > F.col("_end"))
    return found.groupBy(*keys, "island").agg(F.min("onset_s").alias("onset_s"), F.max("offset_s").alias("offset_s")).drop("island")


def merge_regions(spans: DataFrame, keys: list[str], gap_s: float = 0.05, min_dur_s: float = 0.05) -> DataFrame:
    """Time spans of regions: gaps up to gap_s are bridged, the score is the greatest, short results are dropped."""
    found = numbered(spans, keys, F.col("onset_s") - F.col("_end") > F.lit(gap_s))
    merged = found.groupBy(*keys, "island").agg(F.min("onset_s").alias("onset_s"), F.max("offset_s").alias("offset_s"), F.max("score").alias("score")).drop("island")
    return merged.where(F.col("offset_s") - F.col("onset_s") >= min_dur_s)


def _spaced(curve: DataFrame, keys: list[str]) -> DataFrame:
    """curve with _gap, the distance from the frame before."""
    return curve.withColumn("_gap", F.col("time_s") - F.lag("time_s").over(Window.partitionBy(*keys).orderBy("time_s")))


def _with_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the median of a column over their key. Sorting spills to disk, while Spark's median holds the values of
    many keys in memory; and rows that are sorted within their key need no join."""
    own, v, twice = Window.partitionBy(*keys), F.col(value), 2 * F.col("_k")
    rows = rows.withColumns({"_k": F.row_number().over(own.orderBy(v.asc_nulls_last())), "_n": F.count(value).over(own)})
    share = F.when(twice == F.col("_n") + 1, v).when((twice == F.col("_n")) | (twice == F.col("_n") + 2), v * 0.5)
    return rows.withColumn(name, F.sum(share).over(own)).drop("_k", "_n")


def frame_spacing(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Median distance of successive frames per key; 0 for a single frame."""
    return _with_median(_spaced(curve, keys), keys, "_gap", "dt").groupBy(*keys).agg(F.coalesce(F.first("dt"), F.lit(0.0)).alias("dt"))


def _limits(curve: DataFrame, keys: list[str], k: float) -> DataFrame:
    """curve with med, mad and threshold of the key."""
    rows = _with_median(curve, keys, "value", "med").withColumn("_off", F.abs(F.col("value") - F.col("med")))
    rows = _with_median(rows, keys, "_off", "mad").withColumn("_sd", F.stddev_pop("value").over(Window.partitionBy(*keys)))
    spread = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1e-9))
    return rows.withColumn("threshold", F.col("med") + k * spread).drop("_off", "_sd")


def salience_threshold(curve: DataFrame, keys: list[str], k: float = 1.5) -> DataFrame:
    """median + k * spread; the spread is the median absolute deviation, or the standard deviation where that is 0,
    or 1e-9 where both are."""
    return _limits(curve, keys, k).groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("med", "mad", "threshold")))


def salience_runs(curve: DataFrame, keys: list[str], k: float = 1.5) -> DataFrame:
    """Runs of frames at or above the threshold: onset, offset (half a frame wider on either side) and the area above
    the threshold. Frames are rows (keys, time_s, value); successive rows in time are neighbours."""
    spaced = _with_median(_spaced(curve.select(*keys, "time_s", "value"), keys), keys, "_gap", "_dt").drop("_gap")
    framed = _limits(spaced.withColumn("dt", F.coalesce("_dt", F.lit(0.0))), keys, k)
    order = Window.partitionBy(*keys).orderBy("time_s")
    above = framed.withColumn("_up", F.col("value") >= F.col("threshold"))
    opened = above.withColumn("_new", F.when(F.col("_up") & ~F.coalesce(F.lag("_up").over(order), F.lit(False)), 1).otherwise(0))
    runs = opened.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_up")
    half, width = F.greatest(F.col("dt") / 2, F.lit(0.0)), F.when(F.col("dt") > 0, F.col("dt")).otherwise(F.lit(1.0))
    out = runs.groupBy(*keys, "run").agg(F.min("time_s").alias("_a"), F.max("time_s").alias("_b"), F.sum(F.col("value") - F.col("threshold")).alias("_sum"), F.first("dt").alias("dt"))
    return out.select(*keys, F.greatest(F.lit(0.0), F.col("_a") - half).alias("onset_s"), (F.col("_b") + half).alias("offset_s"), (F.col("_sum") * width).alias("area"))


def salience_events(curve: DataFrame, keys: list[str], k: float = 1.5, min_dur_s: float = 0.05, merge_gap_s: float = 0.05) -> DataFrame:
    """Runs bridged over gaps up to merge_gap_s with their areas added, then those of min_dur_s or more, scored by area."""
    # runs are few, and numbering reads them more than once
    found = numbered(session.cut(salience_runs(curve, keys, k)), keys, F.col("onset_s") - F.col("_end") > F.lit(merge_gap_s))
    merged = found.groupBy(*keys, "island").agg(F.min("onset_s").alias("onset_s"), F.max("offset_s").alias("offset_s"), F.greatest(F.sum("area"), F.lit(1e-12)).alias("score")).drop("island")
    return merged.where(F.col("offset_s") - F.col("onset_s") >= min_dur_s)
