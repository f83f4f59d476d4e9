"""Evaluation sets: labels of annotations, stratified anchors, clips, event-free windows.

Draws come from hashes of a seed and the row's own key, so they are the same however rows are dealt to tasks."""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.intervals import clipped, placed, uniform
from tidemark.operators.islands import interval_union


def label_events(examples: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(id, start_time, end_time, ebird_code, ebird_code_multilabel) -> (id, start_s, end_s, code), one row a label.

    Labels are strings; with classes (code_id int, code) integers are looked up, those without a class are dropped;
    without classes integer labels are dropped. Spans that cannot be read or do not end after their start, null
    labels and nocall are dropped."""
    start, end = F.expr("try_cast(start_time AS double)"), F.expr("try_cast(end_time AS double)")
    one = F.nullif("ebird_code", F.lit(""))
    labels = F.when(one.isNotNull(), F.array(one)).otherwise(F.coalesce("ebird_code_multilabel", F.expr("CAST(array() AS array<string>)")))
    rows = examples.select("id", start.alias("start_s"), end.alias("end_s"), F.explode(labels).alias("raw")).where("end_s > start_s AND raw IS NOT NULL AND raw <> ''")
    number = F.expr("try_cast(raw AS int)")
    if classes is None:
        named = rows.where(number.isNull()).withColumn("code", F.col("raw"))
    else:
        known = classes.select(F.col("code_id").alias("_id"), F.col("code").alias("_name"))
        named = rows.join(known, number == F.col("_id"), "left").withColumn("code", F.when(number.isNull(), F.col("raw")).otherwise(F.col("_name")))
    return named.where("code IS NOT NULL AND lower(code) <> 'nocall'").select("id", "start_s", "end_s", "code")


def stratified_cap(rows: DataFrame, per_group: int, overall: int, group: str, key: list[str], seed: int = 0) -> DataFrame:
    """At most per_group rows of each group and overall rows in all, in a shuffled order set by seed and key."""
    mixed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *key)))
    ranked = mixed.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h", *key))).where(F.col("_r") <= per_group)
    return ranked.orderBy("_h", *key).limit(overall).drop("_h", "_r")


def place_clips(anchors: DataFrame, clip_s: float, margin_s: float, key: str, seed: int = 0) -> DataFrame:
    """anchors (key, onset_s, dur_s, total_s) with t0, rel_on and rel_off of a clip around each."""
    t0, rel, d = placed(F.col("onset_s"), F.col("dur_s"), F.col("total_s"), clip_s, margin_s, uniform(seed, F.col(key).cast("string")))
    return anchors.withColumn("t0", t0).withColumn("rel_on", rel).withColumn("rel_off", F.col("rel_on") + d)


def events_in_windows(windows: DataFrame, events: DataFrame, merge: bool = True) -> DataFrame:
    """windows (win_id, master, t0, t1) x events (master, start_s, end_s) -> clip-local spans (win_id, onset_s, offset_s),
    touching ones merged. Windows and events meet in time buckets as long as the longest window, so a master with
    very many events is spread by time."""
    width = float(windows.agg(F.max(F.col("t1") - F.col("t0"))).first()[0] or 1.0) or 1.0
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long")))
    w = windows.select("win_id", "master", "t0", "t1", cells(F.col("t0"), F.col("t1")).alias("cell"))
    # a long event meets a window in the first cell that both have
    e = events.select("master", "start_s", "end_s", F.monotonically_increasing_id().alias("_e"), cells(F.col("start_s"), F.col("end_s")).alias("cell"))
    met = w.join(e, ["master", "cell"]).where("end_s > t0 AND start_s < t1").where(F.col("cell") == F.floor(F.greatest("t0", "start_s") / width))
    on, off, some = clipped(F.col("start_s"), F.col("end_s"), F.col("t0"), F.col("t1") - F.col("t0"))
    local = met.select("win_id", on.alias("onset_s"), off.alias("offset_s"), some.alias("_some")).where("_some").drop("_some")
    return interval_union(local, ["win_id"]) if merge else local


def free_windows(windows: DataFrame, events: DataFrame, margin_s: float = 0.0) -> DataFrame:
    """Windows (master, t0, t1) that, widened by margin_s, no event overlaps; touching is allowed.

    As in events_in_windows, both sides meet in time buckets, so a master with very many events is spread by time."""
    width = float(windows.agg(F.max(F.col("t1") - F.col("t0"))).first()[0] or 0.0) + 2 * margin_s or 1.0
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))).alias("cell")
    own = windows.select("master", "t0", "t1").distinct()
    w = own.select("master", "t0", "t1", cells(F.col("t0") - margin_s, F.col("t1") + margin_s))
    e = events.select(F.col("master").alias("master"), F.col("start_s").alias("start_s"), F.col("end_s").alias("end_s"), cells(F.col("start_s"), F.col("end_s")))
    hit = w.join(e, ["master", "cell"]).where((F.col("end_s") > F.col("t0") - margin_s) & (F.col("start_s") < F.col("t1") + margin_s)).select("master", "t0", "t1").distinct()
    return windows.join(hit, ["master", "t0", "t1"], "left_anti")


def draw_negatives(needs: DataFrame, events: DataFrame, clip_s: float, margin_s: float, seed: int = 0) -> DataFrame:
    """needs (master, total_s, n) -> (master, k, t0): up to n starts of event-free windows per master, a clip length
    apart, by rejection in a sequence seeded by the master's name; at most 400 n draws, so fewer may come out."""
    merged = interval_union(events.select("master", F.col("start_s").alias("onset_s"), F.col("end_s").alias("offset_s")), ["master"])

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[str, int, float]] = []
        busy = sorted(zip(right.column("onset_s").to_pylist(), right.column("offset_s").to_pylist(), strict=True))
        ons, offs = (np.array([b[i] for b in busy]) for i in (0, 1))
        for master, total, n in zip(*(left.column(c).to_pylist() for c in ("master", "total_s", "n")), strict=True):
            if total is None or total <= clip_s:
                continue
            rng = np.random.default_rng([seed, *master.encode()])
            taken: list[float] = []
            near: list[float] = []  # the same in order: only the neighbours of a draw can be too close to it
            for _ in range(400 * n):
                if len(taken) == n:
                    break
                t0 = float(rng.uniform(0, total - clip_s))
                # busy spans are disjoint: the last that begins before the window's end is the only one to look at
                i, j = int(np.searchsorted(ons, t0 + clip_s + margin_s, "left")) - 1, bisect(near, t0)
                if (i >= 0 and offs[i] > t0 - margin_s) or any(abs(t0 - a) < clip_s for a in near[max(0, j - 1) : j + 1]):
                    continue
                taken.append(t0)
                near.insert(j, t0)
            out += [(master, k, t) for k, t in enumerate(taken)]
        m, k, t = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({"master": pa.array(m, pa.string()), "k": pa.array(k, pa.int32()), "t0": pa.array(t, pa.float64())})

    # both sides may come from one table: fresh columns keep their keys apart
    needs = needs.select(F.col("master").alias("master"), F.col("total_s").alias("total_s"), F.col("n").alias("n"))
    merged = merged.select(*(F.col(c).alias(c) for c in ("master", "onset_s", "offset_s")))
    return needs.groupBy("master").cogroup(merged.groupBy("master")).applyInArrow(draw, "master string, k int, t0 double")


def density(spans: DataFrame, clip_s: float) -> DataFrame:
    """Share of each clip (win_id) that its spans cover."""
    return spans.groupBy("win_id").agg((F.sum(F.col("offset_s") - F.col("onset_s")) / clip_s).alias("density"))


def region_pivot(results: DataFrame, regions: list[str]) -> DataFrame:
    """(detector, region, value) -> a column per region and the mean over those present."""
    wide = results.groupBy("detector").pivot("region", regions).agg(F.avg("value"))
    have: Column = sum((F.when(F.col(r).isNotNull(), 1).otherwise(0) for r in regions), F.lit(0))
    total = sum((F.coalesce(F.col(r), F.lit(0.0)) for r in regions), F.lit(0.0))
    return wide.withColumn("mean", F.when(have > 0, total / have))


def self_similarity(vectors: DataFrame, topk: int = 3) -> DataFrame:
    """(clip, ord, vec) -> (clip, ord, score): mean of the top-k products of unit vectors with the clip's other ones;
    1 for a lone one. One clip's vectors are handled together, in blocks."""

    def score(clip: pa.Table) -> pa.Table:
        x = np.array(clip.column("vec").to_pylist(), np.float64)
        n = len(x)
        out = np.ones(n)
        for k in range(0, n if n > 1 else 0, 1024):
            near = x[k : k + 1024] @ x.T
            near[np.arange(len(near)), k + np.arange(len(near))] = -np.inf
            take = min(topk, n - 1)
            out[k : k + 1024] = np.sort(near, axis=1)[:, ::-1][:, :take].mean(1)
        return pa.table({"clip": clip.column("clip"), "ord": clip.column("ord"), "score": pa.array(out)})

    return vectors.select("clip", "ord", "vec").groupBy("clip").applyInArrow(score, "clip string, ord long, score double")
