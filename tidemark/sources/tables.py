"""Text tables: selection tables, recording lists, scored grids, segments, annotations, results.

Doubles are kept as they are in Parquet; text sinks format them as the interchange formats ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that foreign tables give to the columns of a selection table, lower-cased.
BEGIN = ("begin time (s)", "onset", "onset_s", "start", "start_s", "begin")
END = ("end time (s)", "offset", "offset_s", "end", "end_s", "stop")
FILE = ("file_id", "filename", "file", "fname", "recording", "begin file")
SCORE = ("score", "confidence", "conf", "probability", "prob")


def resolve(header: list[str], names: tuple[str, ...]) -> str | None:
    """The first column whose trimmed lower-case name is one of names."""
    return next((h for h in header if h.strip().lower() in names), None)


def selection_table(spark: SparkSession, path: str, default_file_id: str | None = None) -> DataFrame:
    """(file_id, ord, onset_s, offset_s, score) of tab-separated tables; ord follows the lines of a file.

    A missing or blank score is 1; a missing or blank file is default_file_id or the table's own name. Tables without
    onset or offset column are an error, as is a time that is no number."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    events = selection_columns(rows, F.lit(default_file_id) if default_file_id else F.element_at(F.split(F.input_file_name(), "/"), -1))
    return events.withColumn("ord", F.monotonically_increasing_id()).select("file_id", "ord", "onset_s", "offset_s", "score")


def selection_columns(rows: DataFrame, fallback: Column) -> DataFrame:
    """Canonical columns of a table of strings."""
    begin, end, file, score = (resolve(rows.columns, names) for names in (BEGIN, END, FILE, SCORE))
    if begin is None or end is None:
        raise ValueError(f"no onset or offset column among {rows.columns}")
    col = lambda c: F.col(f"`{c}`")
    named = F.coalesce(F.nullif(F.trim(col(file)), F.lit("")), fallback) if file else fallback
    rated = F.coalesce(F.nullif(F.trim(col(score)), F.lit("")).cast("double"), F.lit(1.0)) if score else F.lit(1.0)
    return rows.select(named.alias("file_id"), col(begin).cast("double").alias("onset_s"), col(end).cast("double").alias("offset_s"), rated.alias("score"))


def fixed(x: Column, digits: int) -> Column:
    """Decimals as text, rounded by the binary value's exact expansion (halves to even, as C's printf does)."""

    @F.pandas_udf("string")
    def form(v):
        return v.map(lambda y: format(y, f".{digits}f"), na_action="ignore")

    return form(x)


def general(digits: int):
    """x -> shortest text with so many significant digits, without trailing zeros."""

    @F.pandas_udf("string")
    def form(x):
        return x.map(lambda v: format(v, f".{digits}g"), na_action="ignore")

    return form


def write_selection_table(events: DataFrame, path: str) -> None:
    """file_id, begin, end, score, detector with six decimals, tab-separated."""
    out = events.select("file_id", fixed(F.col("onset_s"), 6).alias("Begin Time (s)"), fixed(F.col("offset_s"), 6).alias("End Time (s)"), fixed(F.col("score"), 6).alias("score"), "detector")
    out.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def recording_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, wav_id, path) of "<id> <path>" lines, split at the first white space; blank lines are skipped."""
    return recording_lines(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def recording_lines(lines: DataFrame) -> DataFrame:
    parts = F.split(F.ltrim(F.col("value")), r"\s+", 2)
    return lines.where(F.trim("value") != "").select("ord", parts[0].alias("wav_id"), parts[1].alias("path"))


GRID = "seg_id string, wav_id string, start double, `end` double, n_events int, max_score double, sum_score double"


def scored_grid(spark: SparkSession, path: str) -> DataFrame:
    """Rows of scored windows, columns by name; a directory is the union of its files."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    kinds = {"start": "double", "end": "double", "n_events": "int", "max_score": "double", "sum_score": "double"}
    return rows.select(*(F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in ("seg_id", "wav_id", "start", "end", "n_events", "max_score", "sum_score")))


def write_scored_grid(windows: DataFrame, path: str) -> None:
    short = general(6)
    out = windows.select("seg_id", "wav_id", fixed(F.col("start"), 2).alias("start"), fixed(F.col("end"), 2).alias("end"), "n_events", short("max_score").alias("max_score"), short("sum_score").alias("sum_score"))
    out.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def write_segments(windows: DataFrame, path: str) -> None:
    """"seg_id wav_id start end" lines, and a table of scores beside them."""
    short = general(6)
    lines = windows.orderBy("wav_id", "start").select(F.concat_ws(" ", "seg_id", "wav_id", fixed(F.col("start"), 2), fixed(F.col("end"), 2)).alias("value"))
    lines.write.mode("overwrite").text(path)
    windows.select("seg_id", "n_events", short("max_score").alias("max_score"), short("sum_score").alias("sum_score")).write.option("sep", "\t").option("header", True).mode("overwrite").csv(f"{path}.scores.tsv")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(master_id, start_s, end_s, ebird_code); spans that cannot be read or do not end after their start are dropped."""
    return annotation_columns(spark.read.option("sep", "\t").option("header", True).csv(path))


def annotation_columns(rows: DataFrame) -> DataFrame:
    code = F.coalesce("ebird_code", F.lit("")) if "ebird_code" in rows.columns else F.lit("")
    return rows.select("master_id", F.expr("try_cast(start_s AS double)").alias("start_s"), F.expr("try_cast(end_s AS double)").alias("end_s"), code.alias("ebird_code")).where("end_s > start_s")


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Channel rows; numbers that cannot be read count as missing."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("ord", F.monotonically_increasing_id())
    number = ("cut_sr", "cut_dur_s", "master_sr", "corr_sr", "offset_s", "end_s", "ncc_peak", "peak_ratio")
    return rows.select(*(F.expr(f"try_cast({c} AS double)").alias(c) if c in number else F.col(c) for c in rows.columns))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_table(rows: DataFrame, path: str, sep: str = "\t", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Any result as delimited text; with partition_by only the partitions at hand are replaced."""
    out = rows.write.option("sep", sep).option("header", True).mode(mode)
    (out.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic") if partition_by else out).csv(path)


#: The columns of a results table; how those that are no counts are written.
RESULTS = "detector matcher n_pred n_gt ap max_f1 precision_at_max_f1 recall_at_max_f1 threshold_at_max_f1 precision recall f1 macro_f1 tp fp fn selection_rate recall_at_sel_budget auc_recall_sel op_threshold op_recall op_selection".split()
THRESHOLDS = ("threshold_at_max_f1", "op_threshold")
COUNTS = ("detector", "matcher", "n_pred", "n_gt", "tp", "fp", "fn")


def result_text(results: DataFrame) -> DataFrame:
    """Scores with six decimals, thresholds with six significant digits."""
    short = general(6)
    return results.select(*(F.col(c) if c in COUNTS else (short(c) if c in THRESHOLDS else fixed(F.col(c), 6)).alias(c) for c in RESULTS))


def write_truth(spans: DataFrame, path: str) -> None:
    """file_id, begin and end with four decimals."""
    out = spans.select("file_id", fixed(F.col("onset_s"), 4).alias("Begin Time (s)"), fixed(F.col("offset_s"), 4).alias("End Time (s)"))
    out.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def write_card(spark: SparkSession, path: str, title: str, facts: dict[str, object], notes: dict[str, list[str]] | None = None) -> None:
    """A text that says what a data set holds, how it was made and what to mind."""
    lines = [f"# {title}", "", "## Contents", "", *(f"- {k}: {v}" for k, v in facts.items())]
    for heading, items in (notes or {}).items():
        lines += ["", f"## {heading}", "", *(f"- {x}" for x in items)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def merged(tables: list[DataFrame]) -> DataFrame:
    """Shards or per-detector results as one table."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
