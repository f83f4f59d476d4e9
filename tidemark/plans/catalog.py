"""Queries over the driver's tables, one or more per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.functions import intervals as iv
from tidemark.operators import alignment, detectors, evalset, grid, islands, metrics, provenance
from tidemark.operators.matching import CollarMatcher, IoUMatcher, candidates, flagged, greedy_matches
from tidemark.operators.session import cut
from tidemark.plans import inputs as src
from tidemark.sources import tables
from tidemark.streaming import windows as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

IOU = IoUMatcher(0.1)
COLLAR = CollarMatcher(3600.0, 7200.0, 0.2)
_IOU_SQL = "greatest(0.0, least(p.offset_s, g.offset_s) - greatest(p.onset_s, g.onset_s))"
_QUALITY = {
    "iou": f"CASE WHEN {_IOU_SQL} > 0 THEN {_IOU_SQL} / ((p.offset_s - p.onset_s) + (g.offset_s - g.onset_s) - {_IOU_SQL}) ELSE 0.0 END",
    "collar": "-abs(p.onset_s - g.onset_s)",
}
_FITS = {
    "iou": f"{_QUALITY['iou']} >= 0.1",
    "collar": "abs(p.onset_s - g.onset_s) <= 3600.0 AND abs(p.offset_s - g.offset_s) <= greatest(7200.0, 0.2 * (g.offset_s - g.onset_s))",
}


def _pairs(kind: str) -> str:
    return f"{src.PAIRS_BASE}, pairs AS (SELECT p.file_id, p.ord AS p_ord, p.score, g.ord AS g_ord, {_QUALITY[kind]} AS quality FROM p JOIN g ON p.file_id = g.file_id AND {_FITS[kind]})"


def _matches(kind: str) -> str:
    """Greedy matching as a recursion over each file's predictions, carrying the taken truths."""
    return f"""WITH RECURSIVE {_pairs(kind)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, ord) AS rn FROM p),
    step(file_id, rn, used, p_ord, g_ord) AS (
      SELECT file_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT file_id FROM p)
      UNION ALL
      SELECT s.file_id, r.rn, CASE WHEN b.g_ord IS NULL THEN s.used ELSE list_append(s.used, b.g_ord) END, r.ord, b.g_ord
      FROM step s JOIN ranked r ON r.file_id = s.file_id AND r.rn = s.rn + 1
      LEFT JOIN LATERAL (SELECT q.g_ord FROM pairs q WHERE q.file_id = s.file_id AND q.p_ord = r.ord AND NOT list_contains(s.used, q.g_ord) ORDER BY q.quality DESC, q.g_ord LIMIT 1) b ON TRUE),
    m AS (SELECT file_id, p_ord, g_ord FROM step WHERE g_ord IS NOT NULL),
    flags AS (SELECT p.*, m.g_ord IS NOT NULL AS is_tp FROM p LEFT JOIN m ON m.file_id = p.file_id AND m.p_ord = p.ord),
    n AS (SELECT count(*) AS n_gt FROM g),
    pts AS (SELECT score, sum(CASE WHEN is_tp THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN is_tp THEN 0 ELSE 1 END) AS fp FROM flags GROUP BY score),
    cum AS (SELECT score, tp, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM pts WINDOW w AS (ORDER BY score DESC)),
    pr AS (SELECT score, tp, ctp / (ctp + cfp) AS precision, ctp / n_gt AS recall, n_gt FROM cum, n)"""


def query(oracle: str | None = None):
    def enter(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return enter


def _r(*columns: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


# --- intervals and matching -------------------------------------------------------------------------------------


@query(f"WITH {src.INTERVALS} SELECT a.ord, round(a.offset_s - a.onset_s, 6) AS duration_s, round(greatest(0.0, least(a.offset_s, b.offset_s) - greatest(a.onset_s, b.onset_s)), 6) AS overlap_s FROM iv a JOIN iv b ON b.ord = a.ord + 1")
def interval_scalars(spark, sf_dir):
    a = src.intervals(spark, sf_dir)
    b = a.select((F.col("ord") - 1).alias("ord"), F.col("onset_s").alias("on2"), F.col("offset_s").alias("off2"))
    on, off = F.col("onset_s"), iv.checked(F.col("onset_s"), F.col("offset_s"))
    return a.join(b, "ord").select("ord", F.round(iv.duration(on, off), 6).alias("duration_s"), F.round(iv.overlap(on, off, F.col("on2"), F.col("off2")), 6).alias("overlap_s"))


@query(f"WITH {_pairs('iou')} SELECT file_id, p_ord, g_ord, round(quality, 6) AS quality FROM pairs")
def interval_iou_candidates(spark, sf_dir):
    return candidates(src.predictions(spark, sf_dir), src.truth(spark, sf_dir), IOU).select("file_id", "p_ord", "g_ord", *_r("quality"))


@query(f"WITH {_pairs('collar')} SELECT file_id, p_ord, g_ord, round(quality, 6) AS quality FROM pairs")
def collar_candidates(spark, sf_dir):
    return candidates(src.predictions(spark, sf_dir), src.truth(spark, sf_dir), COLLAR).select("file_id", "p_ord", "g_ord", *_r("quality"))


@query(_matches("iou") + " SELECT * FROM m")
def greedy_match_iou(spark, sf_dir):
    return greedy_matches(src.predictions(spark, sf_dir), src.truth(spark, sf_dir), IOU)


@query(_matches("collar") + " SELECT * FROM m")
def greedy_match_collar(spark, sf_dir):
    return greedy_matches(src.predictions(spark, sf_dir), src.truth(spark, sf_dir), COLLAR)


# --- metrics ----------------------------------------------------------------------------------------------------


def _flags(spark, sf_dir):
    gts = src.truth(spark, sf_dir)
    # several sweeps read the flags: matched once
    return cut(flagged(src.predictions(spark, sf_dir), gts, IOU)), gts, gts.count()


@query(_matches("iou") + " SELECT round(sum(tp / n_gt * precision), 6) AS ap FROM pr")
def average_precision(spark, sf_dir):
    flags, _, n = _flags(spark, sf_dir)
    return metrics.average_precision(metrics.sweep(flags, n), n).select(*_r("ap"))


@query(_matches("iou") + """ SELECT round(f1, 6) AS max_f1, round(precision, 6) AS precision_at_max_f1, round(recall, 6) AS recall_at_max_f1, score AS threshold_at_max_f1
    FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr) ORDER BY f1 DESC, score DESC LIMIT 1""")
def max_f1(spark, sf_dir):
    flags, _, n = _flags(spark, sf_dir)
    return metrics.max_f1(metrics.sweep(flags, n), n).select(*_r("max_f1", "precision_at_max_f1", "recall_at_max_f1"), "threshold_at_max_f1")


@query(_matches("iou") + """, c AS (SELECT count(*) AS n_pred, sum(CASE WHEN is_tp THEN 1 ELSE 0 END)::BIGINT AS tp FROM flags)
    SELECT n_pred, n_gt, tp, n_pred - tp AS fp, n_gt - tp AS fn, round(tp / n_pred, 6) AS precision, round(tp / n_gt, 6) AS recall, round(2.0 * tp / (n_pred + n_gt), 6) AS f1 FROM c, n""")
def micro_prf(spark, sf_dir):
    flags, _, n = _flags(spark, sf_dir)
    return metrics.micro(flags, n).select("n_pred", "n_gt", "tp", "fp", "fn", *_r("precision", "recall", "f1"))


@query(_matches("iou") + """, a AS (SELECT file_id, count(*) AS np, sum(CASE WHEN is_tp THEN 1 ELSE 0 END) AS tp FROM flags GROUP BY file_id), b AS (SELECT file_id, count(*) AS ng FROM g GROUP BY file_id)
    SELECT round(avg(coalesce(2.0 * tp / (coalesce(np, 0) + coalesce(ng, 0)), 0)), 6) AS macro_f1 FROM a FULL JOIN b USING (file_id)""")
def macro_f1(spark, sf_dir):
    flags, gts, _ = _flags(spark, sf_dir)
    return metrics.macro_f1(flags, gts).select(*_r("macro_f1"))


_SELECTION = _matches("iou") + f""",
    bins AS (SELECT file_id, bin, max(score) AS score FROM (SELECT file_id, score, unnest(range(greatest(0, CAST(floor(onset_s / 600) AS BIGINT)), least({int(src.MONTH_S) // 600}, CAST(ceil(offset_s / 600) AS BIGINT)))) AS bin FROM p) GROUP BY ALL),
    total AS (SELECT count(DISTINCT file_id) * {int(src.MONTH_S) // 600} AS t FROM timed),
    per AS (SELECT score, count(*) AS b FROM bins GROUP BY score),
    joined AS (SELECT score, coalesce(tp, 0) AS tp, coalesce(b, 0) AS b FROM pts FULL JOIN per USING (score)),
    run AS (SELECT score, sum(tp) OVER w / n_gt AS r1, sum(b) OVER w / t AS s1, (sum(tp) OVER w - tp) / n_gt AS r0, (sum(b) OVER w - b) / t AS s0 FROM joined, n, total WINDOW w AS (ORDER BY score DESC))"""


def _selection(spark, sf_dir):
    flags, _, n = _flags(spark, sf_dir)
    return metrics.selection(flags, src.file_durations(spark, sf_dir), n, 0.15, 600.0)


@query(_SELECTION + " SELECT round(max(s1), 6) AS selection_rate FROM run")
def selection_rate(spark, sf_dir):
    return _selection(spark, sf_dir).select(*_r("selection_rate"))


@query(_SELECTION + """ SELECT round(coalesce((SELECT CASE WHEN s1 > s0 THEN r0 + (0.15 - s0) / (s1 - s0) * (r1 - r0) ELSE r1 END FROM run WHERE s1 >= 0.15 ORDER BY score DESC LIMIT 1), (SELECT max(r1) FROM run)), 6) AS recall_at_sel_budget""")
def recall_at_budget(spark, sf_dir):
    return _selection(spark, sf_dir).select(*_r("recall_at_sel_budget"))


@query(_SELECTION + " SELECT round(sum((s1 - s0) * (r0 + r1) / 2) + max(r1) * (1 - max(s1)), 6) AS auc_recall_sel FROM run")
def auc_recall_sel(spark, sf_dir):
    return _selection(spark, sf_dir).select(*_r("auc_recall_sel"))


@query(_SELECTION + " SELECT score AS op_threshold, round(r1, 6) AS op_recall, round(s1, 6) AS op_selection FROM run ORDER BY r1 - s1 DESC, score DESC LIMIT 1")
def j_optimal(spark, sf_dir):
    return _selection(spark, sf_dir).select("op_threshold", *_r("op_recall", "op_selection"))


@query(_SELECTION + """, c AS (SELECT count(*) AS n_pred, sum(CASE WHEN is_tp THEN 1 ELSE 0 END)::BIGINT AS tp FROM flags)
    SELECT n_pred, n_gt, c.tp, round((SELECT sum(tp / n_gt * precision) FROM pr), 6) AS ap, round(2.0 * c.tp / (n_pred + n_gt), 6) AS f1, round((SELECT max(s1) FROM run), 6) AS selection_rate FROM c, n""")
def evaluate_iou(spark, sf_dir):
    out = metrics.evaluate(src.predictions(spark, sf_dir), src.truth(spark, sf_dir), IOU, src.file_durations(spark, sf_dir), 0.15, 600.0)
    return out.select("n_pred", "n_gt", "tp", *_r("ap", "f1", "selection_rate"))


# --- islands ----------------------------------------------------------------------------------------------------


def _stitched(opens: str, source: str, keep: str = "TRUE", score: str = ", max(score) AS score") -> str:
    return f"""WITH {source}, e AS (SELECT *, max(offset_s) OVER (PARTITION BY file_id ORDER BY onset_s, offset_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
    i AS (SELECT *, sum(CASE WHEN pe IS NULL OR {opens} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY onset_s, offset_s ROWS UNBOUNDED PRECEDING) AS island FROM e),
    o AS (SELECT file_id, min(onset_s) AS onset_s, max(offset_s) AS offset_s{score} FROM i GROUP BY file_id, island)
    SELECT file_id, round(onset_s, 6) AS onset_s, round(offset_s, 6) AS offset_s{", score" if score else ""} FROM o WHERE {keep}"""


@query(_stitched("onset_s > pe + 3600.0", src.INTERVALS))
def stitch_events(spark, sf_dir):
    return islands.stitch(src.intervals(spark, sf_dir), ["file_id"], 3600.0).select("file_id", *_r("onset_s", "offset_s"), "score")


@query(_stitched("onset_s > pe", src.INTERVALS, score=""))
def interval_union(spark, sf_dir):
    return islands.interval_union(src.intervals(spark, sf_dir), ["file_id"]).select("file_id", *_r("onset_s", "offset_s"))


@query(_stitched("onset_s - pe > 1800.0", src.INTERVALS, "offset_s - onset_s >= 3600.0"))
def roi_span_merge(spark, sf_dir):
    return islands.merge_regions(src.intervals(spark, sf_dir), ["file_id"], 1800.0, 3600.0).select("file_id", *_r("onset_s", "offset_s"), "score")


_THRESHOLD = f"""{src.CURVE}, med AS (SELECT file_id, median(value) AS med, stddev_pop(value) AS sd FROM curve GROUP BY file_id),
mad AS (SELECT file_id, median(abs(value - med)) AS mad FROM curve JOIN med USING (file_id) GROUP BY file_id),
thr AS (SELECT file_id, med, mad, med + 1.5 * CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1e-9 END AS threshold FROM med JOIN mad USING (file_id))"""
_RUNS = f"""{_THRESHOLD}, up AS (SELECT c.*, threshold, value >= threshold AS up FROM curve c JOIN thr USING (file_id)),
o AS (SELECT *, CASE WHEN up AND NOT coalesce(lag(up) OVER (PARTITION BY file_id ORDER BY time_s), FALSE) THEN 1 ELSE 0 END AS n FROM up),
r AS (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS run FROM o),
runs AS (SELECT file_id, greatest(0.0, min(time_s) - 1800) AS onset_s, max(time_s) + 1800 AS offset_s, sum(value - threshold) * 3600 AS area FROM r WHERE up GROUP BY file_id, run)"""


@query(f"WITH {_THRESHOLD} SELECT file_id, round(med, 6) AS med, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM thr")
def salience_threshold(spark, sf_dir):
    return islands.salience_threshold(src.curve(spark, sf_dir), ["file_id"]).select("file_id", *_r("med", "mad", "threshold"))


@query(f"WITH {src.CURVE}, d AS (SELECT file_id, time_s - lag(time_s) OVER (PARTITION BY file_id ORDER BY time_s) AS d FROM curve) SELECT file_id, median(d) AS dt FROM d GROUP BY file_id")
def frame_spacing(spark, sf_dir):
    return islands.frame_spacing(src.curve(spark, sf_dir), ["file_id"])


@query(f"WITH {_RUNS} SELECT file_id, onset_s, offset_s, round(area, 2) AS area FROM runs")
def salience_runs(spark, sf_dir):
    return islands.salience_runs(src.curve(spark, sf_dir), ["file_id"]).select("file_id", "onset_s", "offset_s", *_r("area", digits=2))


@query(f"""WITH {_RUNS}, e AS (SELECT *, max(offset_s) OVER (PARTITION BY file_id ORDER BY onset_s, offset_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM runs),
    i AS (SELECT *, sum(CASE WHEN pe IS NULL OR onset_s - pe > 3600.0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY onset_s ROWS UNBOUNDED PRECEDING) AS island FROM e)
    SELECT file_id, min(onset_s) AS onset_s, max(offset_s) AS offset_s, round(sum(area), 2) AS score FROM i GROUP BY file_id, island HAVING max(offset_s) - min(onset_s) >= 7200.0""")
def salience_events(spark, sf_dir):
    return islands.salience_events(src.curve(spark, sf_dir), ["file_id"], 1.5, 7200.0, 3600.0).select("file_id", "onset_s", "offset_s", *_r("score", digits=2))


# --- grid -------------------------------------------------------------------------------------------------------


@query(f'WITH {src.SCORED} SELECT seg_id, wav_id, k, start, "end" FROM w')
def grid_windows(spark, sf_dir):
    return src.scored_windows(spark, sf_dir).select("seg_id", "wav_id", "k", "start", "end")


@query(f"WITH {src.SCORED} SELECT seg_id, n_events, max_score, sum_score FROM sc")
def grid_scores(spark, sf_dir):
    return src.scored_windows(spark, sf_dir).select("seg_id", "n_events", "max_score", "sum_score")


@query(f"""WITH {src.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY wav_id ORDER BY sum_score DESC, start) AS r, count(*) OVER (PARTITION BY wav_id) AS n FROM sc WHERE n_events > 0)
    SELECT seg_id, wav_id, start, sum_score FROM r WHERE r <= greatest(1, ceil(0.5 * n))""")
def select_per_recording(spark, sf_dir):
    return grid.select_top(src.scored_windows(spark, sf_dir), 0.5).select("seg_id", "wav_id", "start", "sum_score")


@query(f"""WITH {src.SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY sum_score DESC, wav_id, start) AS r, count(*) OVER () AS n FROM sc WHERE n_events > 0)
    SELECT seg_id, wav_id, start, sum_score FROM r WHERE r <= greatest(1, ceil(0.3 * n))""")
def select_global(spark, sf_dir):
    return grid.select_top(src.scored_windows(spark, sf_dir), 0.3, scope="global").select("seg_id", "wav_id", "start", "sum_score")


# --- provenance -------------------------------------------------------------------------------------------------


def _consensus_sql(floor: str = "0.5", extra: str = "") -> str:
    by = f"species, cut_file{extra}"
    return f"""q AS (SELECT * FROM ch WHERE status = 'ok' AND ncc_peak >= {floor}),
    near AS (SELECT *, count(*) OVER (PARTITION BY {by} ORDER BY offset_s RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS agree FROM q),
    rk AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n_qual, max(agree) OVER (PARTITION BY {by}) AS n_agree, first_value(offset_s) OVER (PARTITION BY {by} ORDER BY agree DESC, ord) AS anchor FROM near),
    rep AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ncc_peak DESC, ord) AS b FROM rk WHERE abs(offset_s - anchor) <= 2),
    good AS (SELECT *, CASE WHEN n_qual = 1 THEN 'ok_single' WHEN n_agree >= 2 THEN 'ok' ELSE 'no_consensus' END AS verdict FROM rep WHERE b = 1),
    per AS (SELECT {by}, count(*) AS n_chan, bool_or(status = 'ok') AS any_ok FROM ch GROUP BY ALL),
    firsts AS (SELECT * FROM ch WHERE ord = 1),
    cons AS (SELECT {", ".join("f." + c.strip() for c in by.split(","))}, coalesce(g.tape_id, f.tape_id) AS tape_id, CASE WHEN g.verdict IS NOT NULL THEN g.master_file ELSE f.master_file END AS master_file,
      CASE WHEN g.verdict IS NOT NULL THEN g.offset_s WHEN any_ok THEN NULL ELSE f.offset_s END AS offset_s, CASE WHEN g.verdict IS NOT NULL THEN g.ncc_peak WHEN any_ok THEN NULL ELSE f.ncc_peak END AS ncc_peak,
      n_chan, coalesce(g.n_qual, 0) AS n_qual, coalesce(g.n_agree, 0) AS n_agree, coalesce(g.verdict, CASE WHEN any_ok THEN 'no_match' ELSE f.status END) AS status
      FROM firsts f JOIN per USING ({by}) LEFT JOIN good g USING ({by}))"""


def _consensus(spark, sf_dir):
    return provenance.consensus(src.channel_rows(spark, sf_dir), 0.5, 2.0)


@query(f"WITH {src.CHANNELS}, {_consensus_sql()} SELECT species, cut_file, tape_id, master_file, offset_s, ncc_peak, n_chan, n_qual, n_agree, status FROM cons")
def consensus_vote(spark, sf_dir):
    return _consensus(spark, sf_dir).select("species", "cut_file", "tape_id", "master_file", "offset_s", "ncc_peak", "n_chan", "n_qual", "n_agree", "status")


@query(f"WITH {src.CHANNELS}, {_consensus_sql()} SELECT status, count(*) AS n FROM cons GROUP BY status")
def status_counts(spark, sf_dir):
    return provenance.status_counts(_consensus(spark, sf_dir))


@query(f"WITH {src.CHANNELS}, {_consensus_sql()} SELECT species, count(*) AS n_cuts, count(*) FILTER (status = 'ok') AS n_ok, count(DISTINCT CASE WHEN status = 'ok' THEN tape_id END) AS n_tapes FROM cons GROUP BY species HAVING count(*) FILTER (status = 'ok') > 0")
def species_summary(spark, sf_dir):
    return provenance.species_summary(_consensus(spark, sf_dir))


@query(f"""WITH base AS (WITH {src.CHANNELS} SELECT * FROM ch), floors AS (SELECT unnest({provenance.FLOORS})::DOUBLE AS floor), ch AS (SELECT base.*, floor FROM base, floors), {_consensus_sql("floor", ", floor")}
    SELECT floor, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'ok_single') AS n_single, count(DISTINCT CASE WHEN status = 'ok' THEN species || '/' || tape_id END) AS n_tapes FROM cons GROUP BY floor""")
def consensus_sweep(spark, sf_dir):
    return provenance.consensus_sweep(src.channel_rows(spark, sf_dir), 2.0)


@query(f"WITH {src.CHANNELS}, {_consensus_sql()} SELECT species, cut_file, ord, offset_s, agree AS n_agree FROM near")
def channel_agreement(spark, sf_dir):
    return provenance.agreement(src.channel_rows(spark, sf_dir), 0.5, 2.0).select("species", "cut_file", "ord", "offset_s", "n_agree")


_CONFIDENT = f"{src.CHANNELS}, {_consensus_sql()}, conf AS (SELECT * FROM cons WHERE status = 'ok'), cc AS (SELECT species, tape_id, master_file, count(*) AS n, round(sum(ncc_peak), 4) AS ncc_sum, min(CAST(cut_file AS BIGINT)) AS first_ord FROM conf GROUP BY ALL), canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species, tape_id ORDER BY n DESC, ncc_sum DESC, first_ord) AS r FROM cc) WHERE r = 1)"


def _confident(spark, sf_dir):
    return _consensus(spark, sf_dir).where("status = 'ok'").withColumn("ord", F.col("cut_file").cast("long")).withColumn("ncc_peak", F.col("ncc_peak").cast("decimal(12,4)"))


@query(f"WITH {_CONFIDENT} SELECT species, tape_id, master_file, n FROM canon")
def canonical_channel(spark, sf_dir):
    return provenance.canonical_channel(_confident(spark, sf_dir)).select("species", "tape_id", "master_file", "n")


@query(f"""WITH {_CONFIDENT}, raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species, cut_file, master_file ORDER BY ord DESC) AS r FROM ch WHERE status = 'ok') WHERE r = 1)
    SELECT c.species, c.cut_file, k.master_file AS canon, coalesce(raw.offset_s, c.offset_s) AS on_s FROM conf c JOIN canon k USING (species, tape_id) LEFT JOIN raw ON raw.species = c.species AND raw.cut_file = c.cut_file AND raw.master_file = k.master_file""")
def offset_fallback(spark, sf_dir):
    conf = cut(_confident(spark, sf_dir).select("species", "cut_file", "tape_id", "master_file", "offset_s", "ncc_peak", "ord"))  # the votes are counted once
    return provenance.offsets(conf, src.channel_rows(spark, sf_dir), provenance.canonical_channel(conf)).select("species", "cut_file", "canon", "on_s")


@query("WITH c AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS cut_file FROM orders), d AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS cut_file FROM lineitem WHERE l_linestatus = 'O') SELECT cut_file FROM c ANTI JOIN d USING (cut_file)")
def resume_pending(spark, sf_dir):
    cuts = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cut_file")).distinct()
    done = src.table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").cast("string").alias("cut_file"))
    return provenance.pending(cuts, done, ("cut_file",))


# A customer is a master channel, four to a tape; an order is a cut of its customer's tape. The same expressions make both sides.
_TAPE = "lpad(CAST(CAST(floor({} / 4) AS BIGINT) AS VARCHAR(9)), 5, '0')"
_MASTER = {
    "ord": "CAST(c_custkey AS BIGINT)", "species": "'s' || CAST(CAST(floor(c_custkey / 4) AS BIGINT) % 10 AS VARCHAR(9))", "tape_id": _TAPE.format("c_custkey"),
    "file": f"CASE c_custkey % 8 WHEN 3 THEN substr({_TAPE.format('c_custkey')}, 1, 4) ELSE {_TAPE.format('c_custkey')} END || CASE c_custkey % 8 WHEN 0 THEN 'ch1 44kHz.wav' WHEN 1 THEN 'ch2.wav' WHEN 2 THEN ' hi1.WAV' WHEN 3 THEN 'H3.wav' WHEN 4 THEN '.wav' WHEN 5 THEN ' CH 2 44 khz.wav' WHEN 6 THEN 'A.wav' ELSE 'ch 1.wav' END",
}
_CUT = {
    "species": "'s' || CASE WHEN o_orderkey % 11 = 0 THEN '99' ELSE CAST(CAST(floor(o_custkey / 4) AS BIGINT) % 10 AS VARCHAR(9)) END", "tape_id": _TAPE.format("o_custkey"),
    "cut_base": f"{_TAPE.format('o_custkey')} || CASE o_orderkey % 3 WHEN 0 THEN 'A' ELSE 'B' END || CAST(o_orderkey AS VARCHAR(12))", "cut_sr": "CASE o_orderkey % 4 WHEN 0 THEN 44100 WHEN 1 THEN 96000 WHEN 2 THEN 22050 ELSE 48000 END",
}


def _made(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


_NAMES_SQL = f"""m0 AS (SELECT {_made(_MASTER)} FROM customer),
m1 AS (SELECT *, regexp_replace(file, '\\.wav$', '', 'i') AS name FROM m0),
m2 AS (SELECT *, lower(regexp_extract(name, '\\s*(ch|hi|h)\\s*([0-9])\\s*(44\\s*k?hz)?\\s*$', 1, 'i')) AS kind, regexp_extract(name, '\\s*(ch|hi|h)\\s*([0-9])\\s*(44\\s*k?hz)?\\s*$', 3, 'i') <> '' AS khz, trim(regexp_replace(name, '\\s*(ch|hi|h)\\s*([0-9])\\s*(44\\s*k?hz)?\\s*$', '', 'i')) AS stem FROM m1),
ms AS (SELECT ord, species, tape_id, file, stem, kind, kind IN ('hi', 'h') AS prefers_high, CASE WHEN kind = 'ch' AND khz THEN 0 WHEN kind = 'ch' THEN 1 WHEN kind = 'hi' THEN 2 WHEN kind = 'h' THEN 3 ELSE 4 END AS rank FROM m2),
cuts AS (SELECT {_made(_CUT)} FROM orders),
pr AS (SELECT c.*, file, stem, prefers_high, rank, ord FROM cuts c JOIN ms USING (species, tape_id) WHERE stem <> '' AND starts_with(cut_base, stem))"""


def _masters(spark, sf_dir):
    rows = src.table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {c}" for c, e in _MASTER.items()))
    return rows.withColumns(iv.master_name(F.col("file")))


def _cuts(spark, sf_dir):
    return src.table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {c}" for c, e in _CUT.items()))


@query(f"WITH {_NAMES_SQL} SELECT file, stem, kind, prefers_high, rank FROM ms")
def master_name_parse(spark, sf_dir):
    return _masters(spark, sf_dir).select("file", "stem", "kind", "prefers_high", "rank")


@query(f"""WITH {_NAMES_SQL}, lg AS (SELECT *, max(length(stem)) OVER (PARTITION BY species, tape_id, cut_base) AS most FROM pr)
    SELECT cut_base, file, row_number() OVER (PARTITION BY species, tape_id, cut_base ORDER BY CASE WHEN prefers_high <> (cut_sr > 48000) THEN 1 ELSE 0 END, rank, ord) AS choice FROM lg WHERE length(stem) = most""")
def channel_resolve(spark, sf_dir):
    return provenance.channels(_cuts(spark, sf_dir), _masters(spark, sf_dir)).select("cut_base", "file", "choice")


@query(f"WITH {_NAMES_SQL} SELECT species, tape_id, cut_base, 'no_master' AS status FROM cuts ANTI JOIN pr USING (species, tape_id, cut_base)")
def orphans(spark, sf_dir):
    return provenance.orphans(_cuts(spark, sf_dir), _masters(spark, sf_dir)).select("species", "tape_id", "cut_base", "status")


@query(f"WITH {_NAMES_SQL} SELECT cut_base, '19' || substr(tape_id, 1, 2) AS year, least(48000, cut_sr, 44100) AS corr_sr FROM cuts")
def tape_and_rate(spark, sf_dir):
    return _cuts(spark, sf_dir).select("cut_base", iv.tape_year(F.col("tape_id")).alias("year"), iv.correlation_rate(F.lit(48000), F.col("cut_sr"), F.lit(44100)).alias("corr_sr"))


# --- evaluation sets --------------------------------------------------------------------------------------------

_WINDOWS = f"wn AS (SELECT DISTINCT file_id || '-' || d AS win_id, file_id AS master, d * 86400.0::DOUBLE AS t0, d * 86400.0::DOUBLE + 43200 AS t1 FROM timed, (SELECT unnest(range(31)) AS d))"


def _windows(spark, sf_dir):
    files = src.timed(spark, sf_dir).select(F.col("file_id").alias("master")).distinct()
    rows = files.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(30))))
    return rows.select(F.concat_ws("-", "master", F.col("d").cast("string")).alias("win_id"), "master", (F.col("d") * F.lit(86400.0)).alias("t0"), (F.col("d") * F.lit(86400.0) + 43200).alias("t1"))


_LOCAL = f"""{src.ANNOTATIONS}, {_WINDOWS}, loc AS (SELECT win_id AS file_id, greatest(0.0, start_s - t0) AS onset_s, least(43200.0, end_s - t0) AS offset_s FROM wn JOIN an USING (master) WHERE end_s > t0 AND start_s < t1), iv AS (SELECT * FROM loc WHERE offset_s > onset_s)"""


@query(_stitched("onset_s > pe", _LOCAL, score="").replace("SELECT file_id, round", "SELECT file_id AS win_id, round"))
def events_in_window(spark, sf_dir):
    return evalset.events_in_windows(_windows(spark, sf_dir), src.annotations(spark, sf_dir)).select("win_id", *_r("onset_s", "offset_s"))


@query(f"SELECT win_id, round(sum(offset_s - onset_s) / 43200, 6) AS density FROM ({_stitched('onset_s > pe', _LOCAL, score='').replace('SELECT file_id, round', 'SELECT file_id AS win_id, round')}) GROUP BY win_id")
def gt_density(spark, sf_dir):
    spans = evalset.events_in_windows(_windows(spark, sf_dir), src.annotations(spark, sf_dir))
    return evalset.density(spans.select("win_id", *_r("onset_s", "offset_s")), 43200.0).select("win_id", *_r("density"))


@query(f"WITH {src.ANNOTATIONS}, {_WINDOWS} SELECT win_id, t0 FROM wn WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.master = wn.master AND end_s > t0 - 600 AND start_s < t1 + 600)")
def event_free_windows(spark, sf_dir):
    return evalset.free_windows(_windows(spark, sf_dir), src.annotations(spark, sf_dir), 600.0).select("win_id", "t0")


@query(f"""WITH {src.ANNOTATIONS}, h AS (SELECT *, md5('0|' || id) AS h FROM an), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY h, CAST(id AS VARCHAR)) AS r FROM h)
    SELECT id, code FROM r WHERE r <= 50 ORDER BY h LIMIT 180""")
def stratified_cap(spark, sf_dir):
    rows = src.annotations(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return evalset.stratified_cap(rows, 50, 180, "code", ["id"]).select(F.col("id").cast("long").alias("id"), "code")


_U = "CAST('0x' || substr(md5('0|' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""WITH {src.ANNOTATIONS}, a AS (SELECT id, start_s, least(end_s - start_s, 36000.0 - 7200) AS d, {_U} AS u FROM an),
    b AS (SELECT *, start_s - (3600.0 + u * (greatest(3600.0, 36000.0 - 3600 - d) - 3600.0)) AS raw FROM a), c AS (SELECT *, least(greatest(raw, 0.0), {src.MONTH_S - 36000.0}) AS t0 FROM b)
    SELECT id, round(t0 + 0.0012345678, 2) AS t0, round(least(greatest(start_s - t0, 0.0), 36000.0 - d) + 0.0012345678, 2) AS rel_on, round(least(greatest(start_s - t0, 0.0), 36000.0 - d) + d + 0.0012345678, 2) AS rel_off FROM c""")
def clip_placement(spark, sf_dir):
    rows = src.annotations(spark, sf_dir).select("id", F.col("start_s").alias("onset_s"), (F.col("end_s") - F.col("start_s")).alias("dur_s"), F.lit(src.MONTH_S).alias("total_s"))
    out = evalset.place_clips(rows, 36000.0, 3600.0, "id")
    # times lie on a grid of microseconds: the shift keeps rounding off its ties
    return out.select("id", *(F.round(F.col(c) + 0.0012345678, 2).alias(c) for c in ("t0", "rel_on", "rel_off")))


@query()
def draw_negatives(spark, sf_dir):
    needs = src.annotations(spark, sf_dir).groupBy("master").agg(F.lit(src.MONTH_S).alias("total_s"), F.lit(3).alias("n"))
    return evalset.draw_negatives(needs, src.annotations(spark, sf_dir), 3600.0, 60.0)


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe FROM pages")
def safe_ids(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", iv.safe_id(F.col("url")).alias("safe"))


@query("SELECT page_id, regexp_replace(regexp_replace(list_extract(string_split(url, '/'), -1), '(.)\\.[^.]*$', '\\1'), '[^\\p{L}\\p{N}_-]', '_', 'g') AS rec FROM pages")
def recording_ids(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select("page_id", iv.recording_id(F.col("url")).alias("rec"))


@query("SELECT r_name, CASE WHEN ends_with(r_name, '_scape') THEN r_name ELSE r_name || '_scape' END AS config FROM (SELECT r_name FROM region UNION ALL SELECT r_name || '_scape' FROM region)")
def config_name(spark, sf_dir):
    r = src.table(spark, sf_dir, "region").select("r_name")
    return r.union(r.select(F.concat("r_name", F.lit("_scape")))).select("r_name", iv.config_name(F.col("r_name")).alias("config"))


@query(f"""WITH {src.TIMED}, x AS (SELECT event_id AS id, t AS start_s, t + value * 600 - 60 AS end_s, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS one, CASE WHEN event_id % 6 = 0 THEN ['1', 'nocall', event_type] ELSE ['0'] END AS many FROM timed),
    l AS (SELECT id, start_s, end_s, unnest(CASE WHEN one IS NOT NULL THEN [one] ELSE many END) AS raw FROM x WHERE end_s > start_s)
    SELECT id, CASE raw WHEN '1' THEN 'first' WHEN '0' THEN 'zero' ELSE raw END AS code FROM l WHERE lower(raw) <> 'nocall'""")
def label_explode(spark, sf_dir):
    t = src.timed(spark, sf_dir)
    many = F.when(F.col("event_id") % 6 == 0, F.array(F.lit("1"), F.lit("nocall"), "event_type")).otherwise(F.array(F.lit("0")))
    rows = t.select(F.col("event_id").alias("id"), F.col("t").cast("string").alias("start_time"), (F.col("t") + F.col("value") * 600 - 60).cast("string").alias("end_time"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("ebird_code"), many.alias("ebird_code_multilabel"))
    return evalset.label_events(rows, spark.createDataFrame([(0, "zero"), (1, "first")], "code_id int, code string")).select("id", "code")


@query(f"""WITH {src.TIMED}, r AS (SELECT event_type AS detector, 'R' || (CAST(file_id AS BIGINT) % 3) AS region, avg(value) AS v FROM timed WHERE NOT (event_type = 'error' AND CAST(file_id AS BIGINT) % 3 = 1) GROUP BY ALL)
    SELECT detector, round(max(CASE WHEN region = 'R0' THEN v END), 6) AS R0, round(max(CASE WHEN region = 'R1' THEN v END), 6) AS R1, round(max(CASE WHEN region = 'R2' THEN v END), 6) AS R2, round(avg(v), 6) AS mean FROM r GROUP BY detector""")
def region_pivot(spark, sf_dir):
    region = F.concat(F.lit("R"), (F.col("file_id").cast("long") % 3).cast("string"))
    rows = src.timed(spark, sf_dir).select(F.col("event_type").alias("detector"), region.alias("region"), "value").where("NOT (detector = 'error' AND region = 'R1')").groupBy("detector", "region").agg(F.avg("value").alias("value"))
    return evalset.region_pivot(rows, ["R0", "R1", "R2"]).select("detector", *_r("R0", "R1", "R2", "mean"))


@query("""WITH s AS (SELECT vec_id, CAST(label AS VARCHAR) AS clip, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 300),
    p AS (SELECT a.clip, a.vec_id AS ord, list_dot_product(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC) AS r FROM s a JOIN s b ON a.clip = b.clip AND a.vec_id <> b.vec_id)
    SELECT clip, ord, round(avg(d), 6) AS score FROM p WHERE r <= 3 GROUP BY ALL""".replace(" WHERE vec_id < 300", ""))
def self_similarity(spark, sf_dir):
    rows = src.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("clip"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vec"))
    return evalset.self_similarity(rows).select("clip", "ord", *_r("score"))


# --- signals ----------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT CAST(vec_id AS VARCHAR) AS cut_file, k * 64.0 / 1000 AS offset_s, 1.0 AS ncc_peak, 'ok' AS status FROM s""")
def ncc_locate(spark, sf_dir):
    """Each vector found again in the concatenation of its label's vectors, at a rate of 1 kHz."""
    e = src.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("master_file"), "embedding")
    whole = e.groupBy("master_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("x"))
    masters = whole.select("master_file", F.lit(1000).alias("master_sr"), F.flatten("x").alias("samples"))
    pairs = e.select(F.lit("s").alias("species"), F.col("vec_id").cast("string").alias("cut_file"), F.lit("t").alias("tape_id"), F.lit(1000).alias("cut_sr"), F.col("embedding").alias("cut"), "master_file")
    return alignment.align(pairs, masters).select("cut_file", *_r("offset_s", "ncc_peak", digits=4), "status")


@query("""SELECT vec_id, k, round(CAST(CAST(sqrt((SELECT sum(v * v) FROM (SELECT unnest(embedding[k * 8 + 1 : k * 8 + 8])::DOUBLE AS v)) / 8) AS FLOAT) AS DOUBLE), 5) AS rms FROM embeddings, (SELECT unnest(range(8)) AS k)""")
def rms_envelope(spark, sf_dir):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, ks, out = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                e, _ = dsp.rms_envelope(np.array(x), 8000, 1000)
                ids += [i] * len(e)
                ks += range(len(e))
                out += e.astype(float).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(out, pa.float64())], names=["vec_id", "k", "rms"])

    return src.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, k long, rms double").select("vec_id", "k", *_r("rms", digits=5))


def _tones(spark, sf_dir):
    """(file_id, v): a recording to render per user, with the values of all of the user's events."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes of values still make many tasks
    rows = src.timed(spark, sf_dir).select("file_id", "value").repartition(n, "file_id").groupBy("file_id")
    return rows.agg(F.array_sort(F.collect_list("value")).alias("v"))


def _render(batches):
    """Noise with a tone burst for each of the user's events, 1.4 s apart; one recording a batch."""
    import pyarrow as pa

    steps = np.arange(6400.0)
    for batch in batches:
        for file_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rng = np.random.default_rng([len(file_id), *file_id.encode()])
            x = np.empty(round(16000 * (0.4 + 1.4 * len(v))), np.float32)
            for k in range(len(v) + 1):  # a stretch of 1.4 s holds one burst; that after the last holds none
                first = 22400 * k
                part = rng.standard_normal(min(22400, len(x) - first))
                part *= 0.003
                if k < len(v):
                    a = int(16000 * (0.5 + 1.4 * k)) - first
                    part[a : a + 6400] += 0.4 * np.sin(2 * np.pi * (2000 + 8 * v[k]) * steps / 16000)
                x[first : first + len(part)] = part
            yield pa.RecordBatch.from_arrays([pa.array([file_id], pa.string()), pa.array([16000], pa.int32()), pa.array([x], pa.list_(pa.float32()))], names=["file_id", "sr", "samples"])


def _detect(name: str):
    def run(spark, sf_dir):
        return detectors.detect(_tones(spark, sf_dir), [name], render=_render).select("file_id", "detector", "ord", *_r("onset_s", "offset_s", "score", digits=4), "status")

    run.__name__ = f"detect_{name}"
    return run


for _name in sorted(detectors.REGISTRY):
    query()(_detect(_name))


@query()
def chunked_detect(spark, sf_dir):
    return detectors.detect(_tones(spark, sf_dir), ["spectral_entropy"], None, 2.0, 0.5, _render).select("file_id", "ord", *_r("onset_s", "offset_s", digits=4))


@query()
def salience_curve_events(spark, sf_dir):
    """A detector's curve taken to events by the island operators instead of its own kernel."""
    return islands.salience_events(detectors.salience_curves(_tones(spark, sf_dir), "spectral_entropy", _render), ["file_id"], 1.5, 0.05, 0.1).select("file_id", *_r("onset_s", "offset_s", "score", digits=4))


@query()
def score_windows(spark, sf_dir):
    return detectors.score_windows(_tones(spark, sf_dir), "spectral_entropy", 2.0, _render).select("seg_id", "wav_id", "start", "end", "n_events", *_r("max_score", "sum_score", digits=4))


# --- text tables ------------------------------------------------------------------------------------------------

# Tables of strings as foreign tools write them, made of events and pages; the same expressions make both sides.
_SELECTION_TABLE = {
    "Filename": "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || CAST(user_id AS VARCHAR(12)) || ' ' ELSE CAST(user_id AS VARCHAR(12)) END",
    "Begin Time (s)": "CAST(event_id AS VARCHAR(12)) || '.10'", "STOP": "CAST(event_id + 1 AS VARCHAR(12)) || '.50'",
    "Conf": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE CAST(event_id % 7 AS VARCHAR(12)) || '.5' END",
}
_NOTES = {
    "master_id": "CAST(user_id AS VARCHAR(12))", "start_s": "CASE event_id % 7 WHEN 0 THEN 'x' ELSE CAST(event_id AS VARCHAR(12)) || '.25' END",
    "end_s": "CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR(12)) || '.25' ELSE CAST(event_id + 2 AS VARCHAR(12)) END", "ebird_code": "CASE event_id % 3 WHEN 0 THEN NULL ELSE event_type END",
}
_LINE = "CASE page_id % 6 WHEN 0 THEN '   ' WHEN 1 THEN '  id' || CAST(page_id AS VARCHAR(12)) || '\t ' || url ELSE 'id' || CAST(page_id AS VARCHAR(12)) || ' ' || url || ' 44kHz.wav' END"


def _strings(spark, sf_dir, name: str, columns: dict[str, str]):
    return src.table(spark, sf_dir, name).selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


@query("""SELECT CASE event_id % 5 WHEN 0 THEN 'table' ELSE CAST(user_id AS VARCHAR) END AS file_id, event_id + 0.1::DOUBLE AS onset_s, event_id + 1.5::DOUBLE AS offset_s, CASE WHEN event_id % 4 < 2 THEN 1.0 ELSE event_id % 7 + 0.5::DOUBLE END AS score FROM events""")
def selection_table_read(spark, sf_dir):
    return tables.selection_columns(_strings(spark, sf_dir, "events", _SELECTION_TABLE), F.lit("table"))


@query("SELECT CAST(page_id AS BIGINT) AS ord, 'id' || page_id AS wav_id, CASE page_id % 6 WHEN 1 THEN url ELSE url || ' 44kHz.wav' END AS path FROM pages WHERE page_id % 6 <> 0")
def scp_read(spark, sf_dir):
    return tables.recording_lines(_strings(spark, sf_dir, "pages", {"ord": "CAST(page_id AS BIGINT)", "value": _LINE}))


@query("SELECT CAST(user_id AS VARCHAR) AS master_id, event_id + 0.25::DOUBLE AS start_s, event_id + 2.0::DOUBLE AS end_s, CASE event_id % 3 WHEN 0 THEN '' ELSE event_type END AS ebird_code FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def annotations_read(spark, sf_dir):
    return tables.annotation_columns(_strings(spark, sf_dir, "events", _NOTES))


@query("SELECT count(DISTINCT user_id) AS n_masters, count(*) AS n_events FROM events")
def download_summary(spark, sf_dir):
    return src.annotations(spark, sf_dir).agg(F.countDistinct("master").alias("n_masters"), F.count("*").alias("n_events"))


# --- streams (run here over the whole table as one batch) -------------------------------------------------------


def _stream(spark, sf_dir):
    return src.timed(spark, sf_dir).select(F.col("file_id").alias("key"), F.timestamp_micros((F.floor("t") * 1_000_000).cast("long")).alias("ts"), F.floor(F.col("value") * 600).cast("double").alias("duration_s"), F.col("value").alias("score"))


@query(f"WITH {src.TIMED} SELECT file_id AS key, CAST(floor(floor(t) / 3600) AS BIGINT) AS hour, count(*) AS n_events, max(value) AS max_score, round(sum(value), 2) AS sum_score FROM timed GROUP BY ALL")
def stream_windows(spark, sf_dir):
    out = streams.window_scores(_stream(spark, sf_dir), "1 hour")
    return out.select("key", F.floor(F.unix_micros("start") / 3_600_000_000).alias("hour"), "n_events", "max_score", F.round("sum_score", 2).alias("sum_score"))


@query(_stitched("onset_s > pe", f"{src.TIMED}, iv AS (SELECT file_id, floor(t) AS onset_s, floor(t) + greatest(floor(value * 600), 0.000001) AS offset_s, value AS score FROM timed)").replace("SELECT file_id, round(onset_s, 6) AS onset_s, round(offset_s, 6) AS offset_s, score FROM o", "SELECT file_id AS key, CAST(onset_s AS BIGINT) AS onset_s, score FROM o"))
def stream_sessions(spark, sf_dir):
    return streams.stitched(_stream(spark, sf_dir)).select("key", F.floor(F.unix_micros("start") / 1_000_000).alias("onset_s"), "score")


