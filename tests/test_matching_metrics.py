import math
import random

import numpy as np
import pytest

from tidemark.operators import evalset, islands, matching, metrics, session
from tidemark.operators.matching import CollarMatcher, IoUMatcher, flagged, greedy_matches

EVENT = "file_id string, ord long, onset_s double, offset_s double, score double"


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def plain_greedy(preds, gts, fits, quality):
    used, out = set(), []
    for p in sorted(preds, key=lambda p: (-p[4], p[1])):
        free = [(quality(p, g), -g[1], g) for g in gts if g[0] == p[0] and (g[0], g[1]) not in used and fits(p, g)]
        if free:
            g = max(free, key=lambda x: x[:2])[2]
            used.add((g[0], g[1]))
            out.append((p[0], p[1], g[1]))
    return sorted(out)


def iou(p, g):
    common = max(0.0, min(p[3], g[3]) - max(p[2], g[2]))
    return common / (p[3] - p[2] + g[3] - g[2] - common) if common > 0 else 0.0


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    make = lambda n: [(f"f{rng.randrange(4)}", i, (a := round(rng.uniform(0, 60), 1)), a + round(rng.uniform(0, 4), 1), rng.randrange(8) / 8) for i in range(n)]
    return make(160), make(110)


def test_greedy_is_the_plain_one(spark, events):
    preds, gts = events
    got = sorted(map(tuple, greedy_matches(frame(spark, preds), frame(spark, gts), IoUMatcher(0.2)).collect()))
    assert got == plain_greedy(preds, gts, lambda p, g: iou(p, g) >= 0.2, iou)
    m = CollarMatcher(0.5, 0.5, 0.2)
    fits = lambda p, g: abs(p[2] - g[2]) <= 0.5 and abs(p[3] - g[3]) <= max(0.5, 0.2 * (g[3] - g[2]))
    got = sorted(map(tuple, greedy_matches(frame(spark, preds), frame(spark, gts), m).collect()))
    assert got == plain_greedy(preds, gts, fits, lambda p, g: -abs(p[2] - g[2]))


def test_hand_computed(spark):
    gts = frame(spark, [("a", 0, 0.0, 1.0, 1.0), ("a", 1, 2.0, 3.0, 1.0), ("a", 2, 5.0, 6.0, 1.0)])
    preds = frame(spark, [("a", 0, 0.05, 1.05, 0.9), ("a", 1, 2.0, 3.0, 0.8), ("a", 2, 10.0, 11.0, 0.7)])
    r = metrics.evaluate(preds, gts, CollarMatcher()).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1)
    assert r.ap == pytest.approx(2 / 3) and r.max_f1 == pytest.approx(0.8) and r.threshold_at_max_f1 == 0.8
    assert r.selection_rate == 0.0


def test_coverage_guards(spark):
    gts = frame(spark, [("f", 0, 5.0, 6.0, 1.0)])
    length = spark.createDataFrame([("f", 10.0)], "file_id string, duration_s double")
    sharp = metrics.evaluate(frame(spark, [("f", 0, 5.0, 6.0, 1.0)]), gts, IoUMatcher(), length).first()
    assert sharp.selection_rate == pytest.approx(0.1) and sharp.recall_at_sel_budget == 1.0
    assert (sharp.op_recall, sharp.op_selection) == (1.0, pytest.approx(0.1))
    blanket = metrics.evaluate(frame(spark, [("f", k, float(k), k + 1.0, 1.0) for k in range(10)]), gts, IoUMatcher(), length).first()
    assert blanket.selection_rate == 1.0 and blanket.recall_at_sel_budget == pytest.approx(0.15)
    assert blanket.auc_recall_sel < sharp.auc_recall_sel and blanket.op_threshold == float("inf")


@pytest.mark.parametrize("one_task", [100_000, 3])
def test_selection_is_the_plain_one(spark, events, one_task, monkeypatch):
    monkeypatch.setattr(metrics, "ONE_TASK", one_task)
    preds, gts = events
    rows = [(f"f{k}", 70.0) for k in range(4)] + [("silent", 30.0)]
    flags = flagged(frame(spark, preds), frame(spark, gts), IoUMatcher(0.2))
    got = metrics.selection(flags, spark.createDataFrame(rows, "file_id string, duration_s double"), len(gts), 0.15, 0.1).first()
    best, total = {}, sum(round(d / 0.1) for _, d in rows)
    import math

    for f, _, a, b, s in preds:
        for k in range(max(0, int(a / 0.1)), min(700, math.ceil(b / 0.1))):
            best[f, k] = max(best.get((f, k), -1), s)
    hit = {(f, p) for f, p, _ in plain_greedy(preds, gts, lambda p, g: iou(p, g) >= 0.2, iou)}
    points = [(0.0, 0.0, math.inf)]
    for t in sorted({p[4] for p in preds}, reverse=True):
        points.append((sum(v >= t for v in best.values()) / total, sum(p[4] >= t and (p[0], p[1]) in hit for p in preds) / len(gts), t))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False)) + points[-1][1] * (1 - points[-1][0])
    assert got.selection_rate == pytest.approx(points[-1][0]) and got.auc_recall_sel == pytest.approx(area)
    s, r, t = max(points, key=lambda p: p[1] - p[0])
    assert (got.op_threshold, got.op_recall, got.op_selection) == (t, pytest.approx(r), pytest.approx(s))


def test_empty_sides(spark):
    none, some = frame(spark, []), frame(spark, [("f", 0, 0.0, 1.0, 1.0)])
    r = metrics.evaluate(none, some, IoUMatcher()).first()
    assert (r.n_pred, r.ap, r.max_f1, r.macro_f1, r.fn) == (0, 0.0, 0.0, 0.0, 1)
    r = metrics.evaluate(some, none, IoUMatcher()).first()
    assert (r.n_gt, r.ap, r.fp) == (0, 0.0, 1)
    files = spark.createDataFrame([("quiet",)], "file_id string")
    assert metrics.macro_f1(flagged(none, none, IoUMatcher()), none, files).first().macro_f1 == 1.0


def _events(rows, scored):
    return [(f, k, a, b, s if scored else 1.0) for k, (f, a, b, s) in enumerate(rows)]


SCHEMA = "file_id string, ord long, onset_s double, offset_s double, score double"


@pytest.mark.parametrize("matcher", [IoUMatcher(0.0), IoUMatcher(0.2), CollarMatcher(2.0, 2.0, 0.2)])
@pytest.mark.parametrize(("one_task", "chain"), [(10**6, 10**6), (10, 3)])
def test_matching_is_that_of_plain_steps(spark, matcher, one_task, chain, monkeypatch):
    """However events are dealt to stretches and pairs to rounds; with threshold 0 disjoint events match too."""
    monkeypatch.setattr(session, "ONE_TASK", one_task)
    monkeypatch.setattr(matching, "CHAIN", chain)
    rng = random.Random(3)
    span = lambda f: (f, a := rng.randrange(120) / 2, a + rng.randrange(1, 12) / 2, rng.randrange(5) / 4)
    preds, gts = ([span(rng.choice("aab")) for _ in range(90)] for _ in range(2))
    p, g = _events(preds, True), _events(gts, False)
    want = set()
    for f in "ab":
        used = set()
        for _, k, a, b, _ in sorted((x for x in p if x[0] == f), key=lambda x: (-x[4], x[1])):
            best = None
            for _, j, c, d, _ in (x for x in g if x[0] == f):
                both = max(0.0, min(b, d) - max(a, c))
                if isinstance(matcher, IoUMatcher):
                    fits, quality = (both / (b - a + d - c - both) >= matcher.threshold), both / (b - a + d - c - both)
                else:
                    fits, quality = abs(a - c) <= 2 and abs(b - d) <= max(2.0, 0.2 * (d - c)), -abs(a - c)
                if fits and j not in used and (best is None or quality > best[0]):
                    best = (quality, j)
            if best:
                used.add(best[1])
                want.add((f, k, best[1]))
    got = matching.greedy_matches(spark.createDataFrame(p, SCHEMA), spark.createDataFrame(g, SCHEMA), matcher).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("one_task", [10**6, 5])
def test_islands_across_stretches(spark, one_task, monkeypatch):
    monkeypatch.setattr(session, "ONE_TASK", one_task)
    rng = random.Random(8)
    rows = [("x", k, a := rng.randrange(900) / 3, a + rng.choice((0.1, 0.5, 3.0, 60.0)) * rng.random(), rng.random()) for k in range(200)] + [("y", 0, 1.0, 2.0, 0.5), ("y", 1, 2.0, 3.0, 0.25)]
    want = []
    for f in "xy":
        for _, _, a, b, s in sorted((r for r in rows if r[0] == f), key=lambda r: (r[2], r[3])):
            if want and want[-1][0] == f and a <= want[-1][2] + 0.5:
                want[-1] = (f, want[-1][1], max(want[-1][2], b), max(want[-1][3], s))
            else:
                want.append((f, a, b, s))
    got = islands.stitch(spark.createDataFrame(rows, SCHEMA), ["file_id"], 0.5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("stretch", [256, 3])
def test_covered_bins_are_those_of_an_array(spark, stretch, monkeypatch):
    monkeypatch.setattr(metrics, "STRETCH", stretch)
    rng = random.Random(1)
    rows = [(rng.choice("ab"), k, a := rng.random() * 9 - 0.5, a + rng.choice((0.01, 0.5, 7.0)), rng.randrange(6) / 5) for k in range(80)]
    want: dict = {}
    for f in "ab":
        top = [None] * 80
        for _, _, a, b, s in (r for r in rows if r[0] == f):
            for i in range(max(0, math.floor(a / 0.1)), min(80, math.ceil(b / 0.1))):
                top[i] = s if top[i] is None else max(top[i], s)
        for s in top:
            if s is not None:
                want[s] = want.get(s, 0) + 1
    known = spark.createDataFrame([("a", 8.0), ("b", 8.0)], "file_id string, duration_s double")
    got = metrics.covered_bins(spark.createDataFrame(rows, SCHEMA), known, 0.1).collect()
    assert {r.score: r.bins for r in got} == want


def test_negatives_are_those_of_plain_draws(spark):
    rng = random.Random(2)
    events = [(m, a := rng.random() * 300, a + rng.random() * 5) for m in "ab" for _ in range(20)] + [("full", 0.0, 400.0)]
    needs = [("a", 400.0, 8), ("b", 400.0, 500), ("full", 400.0, 2), ("short", 3.0, 2), ("quiet", 90.0, 3)]
    got = evalset.draw_negatives(spark.createDataFrame(needs, "master string, total_s double, n int"), spark.createDataFrame(events, "master string, start_s double, end_s double"), 5.0, 1.0, 4).collect()
    want = []
    for m, total, n in needs:
        if total <= 5.0:
            continue
        draws, taken = np.random.default_rng([4, *m.encode()]), []
        for _ in range(400 * n):
            if len(taken) == n:
                break
            t = float(draws.uniform(0, total - 5.0))
            if not any(f == m and b > t - 1.0 and a < t + 6.0 for f, a, b in events) and all(abs(t - x) >= 5.0 for x in taken):
                taken.append(t)
        want += [(m, k, t) for k, t in enumerate(taken)]
    assert sorted(map(tuple, got)) == sorted(want) and len([w for w in want if w[0] == "quiet"]) == 3
