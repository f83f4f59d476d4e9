"""Scores of predicted intervals: precision-recall sweep, per-file means, recall against covered time.

All sweeps run over one row per distinct score. Running sums over scores are taken in bands of scores with the totals
of the higher bands added, so that no single task has to see every score; the band limits only deal out the work.
Points are then combined with aggregates; a point's predecessor is its own running sum less its own share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.intervals import prf, ratio
from tidemark.operators.matching import flagged
from tidemark.operators.session import cut

BANDS = 64
ONE_TASK = 100_000


def running(rows: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """rows (one per value of `by`) with cum_<name>: sums over rows of the same or a greater `by`.

    Up to ONE_TASK rows are summed in one window; more are dealt to bands first, with the same result."""
    rows = cut(rows)  # read for the limits and again for the sums
    said = rows.agg(F.percentile_approx(by, [k / BANDS for k in range(1, BANDS)], 1000).alias("q"), F.count("*").alias("n")).first()
    if said.n <= ONE_TASK:
        order = Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *(F.sum(s).over(order).alias(f"cum_{s}") for s in sums))
    limits = sorted(set(said.q or []), reverse=True)
    band = F.size(F.filter(F.lit(limits).cast("array<double>"), lambda x: x > F.col(by))) if limits else F.lit(0)
    rows = rows.withColumn("_band", band)
    totals = rows.groupBy("_band").agg(*(F.sum(s).alias(s) for s in sums))
    # At most BANDS rows stand in this window.
    above = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_band", *(F.coalesce(F.sum(s).over(above), F.lit(0)).alias(f"_{s}") for s in sums))
    order = Window.partitionBy("_band").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(totals), "_band")
    return out.select(*(c for c in rows.columns if c != "_band"), *((F.sum(s).over(order) + F.col(f"_{s}")).alias(f"cum_{s}") for s in sums))


def sweep(flags: DataFrame, n_gt: int) -> DataFrame:
    """One row per distinct score: tp, fp, running sums, precision, recall, f1. Equal scores are one point."""
    points = flags.groupBy("score").agg(F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"))
    out = running(points, "score", ["tp", "fp"])
    p, r, f1 = prf(F.col("cum_tp"), F.col("cum_fp"), F.lit(n_gt) - F.col("cum_tp"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def average_precision(points: DataFrame, n_gt: int) -> DataFrame:
    """Sum of each point's gain in recall times its precision; 0 without truth or predictions."""
    gain = F.col("tp") / F.lit(n_gt) if n_gt else F.lit(0.0)
    return points.agg(F.coalesce(F.sum(gain * F.col("precision")), F.lit(0.0)).alias("ap"))


def max_f1(points: DataFrame, n_gt: int) -> DataFrame:
    """The point of the greatest F1; of equals the highest score; the top score if no F1 is above 0."""
    best = F.max(F.struct("f1", "score", "precision", "recall")).alias("b")
    row = points.agg(best)
    get = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0.0)) if n_gt else F.lit(0.0)
    return row.select(get("f1").alias("max_f1"), get("precision").alias("precision_at_max_f1"), get("recall").alias("recall_at_max_f1"), get("score").alias("threshold_at_max_f1"))


def micro(flags: DataFrame, n_gt: int) -> DataFrame:
    counted = flags.agg(F.count("*").alias("n_pred"), F.count_if("is_tp").alias("tp")).withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.lit(n_gt) - F.col("tp"))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.select("n_pred", F.lit(n_gt).cast("long").alias("n_gt"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def macro_f1(flags: DataFrame, gts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Mean F1 of all files with predictions or truth, or of those in files; a file with neither counts 1."""
    p = flags.groupBy("file_id").agg(F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"))
    g = gts.groupBy("file_id").agg(F.count("*").alias("n"))
    both = p.join(g, "file_id", "full")
    if files is not None:
        both = files.select("file_id").distinct().join(both, "file_id", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = (zero("tp") + zero("fp") + zero("n")) == 0
    f1 = prf(zero("tp"), zero("fp"), zero("n") - zero("tp"))[2]
    return both.agg(F.coalesce(F.avg(F.when(none, F.lit(1.0)).otherwise(f1)), F.lit(0.0)).alias("macro_f1"))


#: Bins of a stretch of a file. A stretch has no more edges than bins, so its work grows with its spans alone.
STRETCH = 256


def covered_bins(preds: DataFrame, durations: DataFrame, grid_s: float = 0.01) -> DataFrame:
    """(score, bins): time bins by the greatest score of the predictions over them, within the files of durations.

    Bins are integers. Predictions are cut at the limits of stretches and, within a stretch, at each other's edges, so
    an hour-long event is one row per elementary part instead of one per bin, and no file is sorted as a whole."""
    n = F.greatest(F.lit(1), F.rint(F.col("duration_s") / grid_s).cast("long"))
    spans = preds.join(durations.withColumn("_n", n), "file_id").select(
        "file_id", F.greatest(F.lit(0), F.floor(F.col("onset_s") / grid_s)).cast("long").alias("a"), F.least(F.col("_n"), F.ceil(F.col("offset_s") / grid_s)).cast("long").alias("b"), "score"
    ).where("b > a")
    spans = spans.groupBy("file_id", "a", "b").agg(F.max("score").alias("score"))
    cell = F.explode(F.sequence(F.floor(F.col("a") / STRETCH), F.floor((F.col("b") - 1) / STRETCH))).alias("cell")
    spans = spans.select("file_id", "a", "b", "score", cell).select("file_id", "cell", F.greatest("a", F.col("cell") * STRETCH).alias("a"), F.least("b", (F.col("cell") + 1) * STRETCH).alias("b"), "score")
    spans = spans.groupBy("file_id", "cell", "a", "b").agg(F.max("score").alias("score"))
    edges = spans.select("file_id", "cell", F.explode(F.array("a", "b")).alias("x")).distinct()
    edges = edges.withColumn("y", F.lead("x").over(Window.partitionBy("file_id", "cell").orderBy("x"))).where("y IS NOT NULL")
    top = edges.join(spans, ["file_id", "cell"]).where("a <= x AND y <= b").groupBy("file_id", "cell", "x", "y").agg(F.max("score").alias("score"))
    return top.groupBy("score").agg(F.sum(F.col("y") - F.col("x")).alias("bins"))


def selection(flags: DataFrame, durations: DataFrame, n_gt: int, budget: float = 0.15, grid_s: float = 0.01) -> DataFrame:
    """selection_rate, recall_at_sel_budget, auc_recall_sel and the point of the greatest recall - selection.

    Without truth all but the rate are 0; without durations everything is 0."""
    total = durations.agg(F.sum(F.greatest(F.lit(1), F.rint(F.col("duration_s") / grid_s))).alias("t")).first().t or 0
    names = ("selection_rate", "recall_at_sel_budget", "auc_recall_sel", "op_threshold", "op_recall", "op_selection")
    if not total:
        return flags.sparkSession.createDataFrame([(0.0,) * 6], ", ".join(f"{n} double" for n in names))
    points = flags.groupBy("score").agg(F.count_if("is_tp").alias("tp"), F.lit(1).alias("_point"))
    both = points.join(covered_bins(flags, durations, grid_s), "score", "full").fillna(0, ["tp", "bins"])
    run = running(both, "score", ["tp", "bins"])
    n = F.lit(float(max(1, n_gt)))
    s1, r1 = F.col("cum_bins") / total, F.col("cum_tp") / n
    s0, r0 = (F.col("cum_bins") - F.col("bins")) / total, (F.col("cum_tp") - F.col("tp")) / n
    run = run.select("score", s1.alias("s1"), r1.alias("r1"), s0.alias("s0"), r0.alias("r0"))
    at = F.when(F.col("s1") >= budget, F.struct(F.col("score").alias("k"), F.when(F.col("s1") > F.col("s0"), F.col("r0") + (budget - F.col("s0")) / (F.col("s1") - F.col("s0")) * (F.col("r1") - F.col("r0"))).otherwise(F.col("r1")).alias("r")))
    best = F.struct((F.col("r1") - F.col("s1")).alias("j"), F.col("score").alias("k"), F.col("r1").alias("r"), F.col("s1").alias("s"))
    out = run.agg(F.coalesce(F.max("s1"), F.lit(0.0)).alias("sm"), F.max("r1").alias("rm"), F.max(at).alias("at"), F.sum((F.col("s1") - F.col("s0")) * (F.col("r0") + F.col("r1")) / 2).alias("area"), F.max(best).alias("best"))
    usable = (F.col("sm") > 0) & F.lit(n_gt > 0)
    beyond = F.col("best.j") > 0
    pick = lambda c, origin: F.when(usable, F.when(beyond, F.col(f"best.{c}")).otherwise(F.lit(origin))).otherwise(F.lit(0.0))
    held = F.when(F.lit(budget) <= 0, F.lit(0.0)).otherwise(F.coalesce(F.col("at.r"), F.col("rm")))
    return out.select(
        F.col("sm").alias("selection_rate"), F.when(usable, held).otherwise(F.lit(0.0)).alias("recall_at_sel_budget"), F.when(usable, F.col("area") + F.col("rm") * (1 - F.col("sm"))).otherwise(F.lit(0.0)).alias("auc_recall_sel"),
        pick("k", float("inf")).alias("op_threshold"), pick("r", 0.0).alias("op_recall"), pick("s", 0.0).alias("op_selection"),
    )


def evaluate(preds: DataFrame, gts: DataFrame, matcher, durations: DataFrame | None = None, budget: float = 0.15, grid_s: float = 0.01) -> DataFrame:
    """One row with every score of preds against gts, both (file_id, ord, onset_s, offset_s, score)."""
    n_gt = gts.count()
    flags = cut(flagged(preds, gts, matcher))  # several sweeps read it
    points = sweep(flags, n_gt)
    row = F.lit(matcher.name).alias("matcher")
    none = preds.sparkSession.createDataFrame([], "file_id string, duration_s double")
    parts = [micro(flags, n_gt), average_precision(points, n_gt), max_f1(points, n_gt), macro_f1(flags, gts), selection(flags, durations if durations is not None else none, n_gt, budget, grid_s)]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    order = ("n_pred", "n_gt", "ap", "max_f1", "precision_at_max_f1", "recall_at_max_f1", "threshold_at_max_f1", "precision", "recall", "f1", "macro_f1", "tp", "fp", "fn", "selection_rate", "recall_at_sel_budget")
    return out.select(row, *order, F.lit(budget).alias("selection_budget"), "auc_recall_sel", "op_threshold", "op_recall", "op_selection")
