"""Projections of the driver's tables onto the engine's model, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORIGIN = "2024-01-01 00:00:00"
MONTH_S = 31 * 86400.0
KINDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, seconds since the start of 2024."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{ORIGIN}', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("file_id"), "event_type", "value", (micros / 1e6).alias("t"))


TIMED = f"timed AS (SELECT event_id, CAST(user_id AS VARCHAR) AS file_id, event_type, value, date_diff('microsecond', TIMESTAMP '{ORIGIN}', ts) / 1e6 AS t FROM events)"


def intervals(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(file_id, ord, onset_s, offset_s, score): an event lasts ten minutes per unit of value."""
    rows = timed(spark, sf_dir)
    rows = rows.where(F.col("event_type").isin(*kinds)) if kinds else rows
    return rows.select("file_id", F.col("event_id").alias("ord"), F.col("t").alias("onset_s"), (F.col("t") + F.col("value") * 600).alias("offset_s"), F.col("value").alias("score"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir, "click", "view")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir, "purchase")


INTERVALS = f"{TIMED}, iv AS (SELECT file_id, event_id AS ord, t AS onset_s, t + value * 600 AS offset_s, value AS score, event_type FROM timed)"
PAIRS_BASE = f"{INTERVALS}, p AS (SELECT * FROM iv WHERE event_type IN ('click', 'view')), g AS (SELECT * FROM iv WHERE event_type = 'purchase')"


def file_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark, sf_dir).select("file_id").distinct().withColumn("duration_s", F.lit(MONTH_S))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, time_s, value): hourly sums of value per kind of event over January, hours without events 0."""
    hour = F.floor(F.col("t") / 3600).cast("int").alias("h")
    sums = timed(spark, sf_dir).groupBy(F.col("event_type").alias("file_id"), hour).agg(F.sum("value").alias("v"))
    frames = spark.range(744).select(F.col("id").cast("int").alias("h")).crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in KINDS], "file_id string")))
    return frames.join(sums, ["file_id", "h"], "left").select("file_id", (F.col("h") * F.lit(3600.0)).alias("time_s"), F.round(F.coalesce("v", F.lit(0.0)), 2).alias("value"))


CURVE = f"""{TIMED}, sums AS (SELECT event_type AS file_id, CAST(floor(t / 3600) AS INTEGER) AS h, sum(value) AS v FROM timed GROUP BY ALL),
curve AS (SELECT k.file_id, f.h * 3600.0::DOUBLE AS time_s, round(coalesce(v, 0.0), 2) AS value
  FROM (SELECT CAST(range AS INTEGER) AS h FROM range(744)) f CROSS JOIN (SELECT unnest({list(KINDS)}) AS file_id) k LEFT JOIN sums s ON s.file_id = k.file_id AND s.h = f.h)"""


def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel alignment rows from lineitem: a cut is an order, a channel one of its lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.select(
        (F.col("l_orderkey") % 10).cast("string").alias("species"), F.col("l_orderkey").cast("string").alias("cut_file"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") % 37).cast("string").alias("tape_id"),
        F.col("l_suppkey").cast("string").alias("master_file"), F.col("l_quantity").alias("offset_s"), (F.col("l_quantity") + 1).alias("end_s"), F.round(F.col("l_discount") * 10, 4).alias("ncc_peak"), F.lit(1.5).alias("peak_ratio"),
        F.when(F.col("l_linestatus") == "O", "ok").otherwise("no_corr").alias("status"), F.row_number().over(order).cast("long").alias("ord"),
    )


CHANNELS = """ch AS (SELECT CAST(l_orderkey % 10 AS VARCHAR) AS species, CAST(l_orderkey AS VARCHAR) AS cut_file, CAST(l_orderkey % 37 AS VARCHAR) AS tape_id, CAST(l_suppkey AS VARCHAR) AS master_file,
  l_quantity AS offset_s, l_quantity + 1 AS end_s, round(l_discount * 10, 4) AS ncc_peak, CASE WHEN l_linestatus = 'O' THEN 'ok' ELSE 'no_corr' END AS status,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(master, start_s, end_s, code, id)."""
    return timed(spark, sf_dir).select(F.col("file_id").alias("master"), F.col("t").alias("start_s"), (F.col("t") + F.col("value") * 600).alias("end_s"), F.col("event_type").alias("code"), F.col("event_id").alias("id"))


ANNOTATIONS = f"{TIMED}, an AS (SELECT file_id AS master, t AS start_s, t + value * 600 AS end_s, event_type AS code, event_id AS id FROM timed)"

WINDOW_S = 86400.0


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day windows of each file with the clicks in them."""
    from tidemark.operators import grid

    recordings = timed(spark, sf_dir).select(F.col("file_id").alias("wav_id")).distinct().withColumn("duration_s", F.lit(MONTH_S + 7))
    clicks = timed(spark, sf_dir).where("event_type = 'click'").select(F.col("file_id").alias("wav_id"), F.floor(F.col("t") / WINDOW_S).cast("int").alias("k"), F.col("value").alias("score"))
    out = grid.summarise(grid.grid_windows(recordings, WINDOW_S), clicks)
    return out.withColumn("sum_score", F.round("sum_score", 2))


SCORED = f"""{TIMED}, w AS (SELECT wav_id, k, wav_id || '-' || lpad(CAST(k AS VARCHAR), 9, '0') AS seg_id, k * {WINDOW_S}::DOUBLE AS start, (k + 1) * {WINDOW_S}::DOUBLE AS "end"
  FROM (SELECT DISTINCT file_id AS wav_id FROM timed) CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(31))),
sc AS (SELECT w.seg_id, w.wav_id, w.k, w.start, w."end", count(value) AS n_events, coalesce(max(value), 0.0) AS max_score, round(coalesce(sum(value), 0.0), 2) AS sum_score
  FROM w LEFT JOIN timed t ON t.file_id = w.wav_id AND t.event_type = 'click' AND CAST(floor(t.t / {WINDOW_S}) AS INTEGER) = w.k GROUP BY ALL)"""
