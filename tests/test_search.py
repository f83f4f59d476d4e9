"""Cuts of one length are searched for together; places that rounding cannot tell apart are compared exactly."""

import numpy as np
import pytest

from tidemark.functions import dsp


def places(master: np.ndarray, cut: np.ndarray) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(master, len(cut))
    w = w - w.mean(1, keepdims=True)
    t = cut - cut.mean()
    return w @ t / np.sqrt((w * w).sum(1) * (t @ t))


@pytest.mark.parametrize("n", [64, 300])
def test_cuts_of_one_length(n):
    rng = np.random.default_rng(3)
    master = rng.standard_normal(20_000) + 50
    cuts = [master[a : a + n] + rng.standard_normal(n) for a in range(0, 19_000, 1900)]
    for cut, (at, top, ratio) in zip(cuts, dsp.locate_all(lambda a, b: master[a:b], len(master), cuts), strict=True):
        score = places(master, cut)
        best = int(score.argmax())
        far = score[np.abs(np.arange(len(score)) - best) > n // 2].max()
        assert at == best and top == pytest.approx(score[best], abs=1e-9) and ratio == pytest.approx(score[best] / far, abs=1e-9)


def test_short_cuts_do_not_each_transform_the_recording(monkeypatch):
    rng = np.random.default_rng(4)
    master = rng.standard_normal(100_000)
    cuts = [master[a : a + 64] for a in range(0, 64_000, 640)]
    spent, plain = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda x, n=None, *more: spent.append(n or len(x)) or plain(x, n, *more))
    found = dsp.locate_all(lambda a, b: master[a:b], len(master), cuts)
    assert [f[0] for f in found] == list(range(0, 64_000, 640))
    assert sum(spent) < len(cuts) * len(master) / 4


def test_places_nearer_than_single_precision():
    rng = np.random.default_rng(5)
    master = rng.standard_normal(30_000)
    cut = rng.standard_normal(64)
    for k, a in enumerate(range(500, 29_000, 700)):  # each copy a little better than the last, but for one
        master[a : a + 64] = 3 * cut + 1e-3 * (0.5 if a == 14_500 else 1 - k / 100) * rng.standard_normal(64)
    score = places(master, cut)
    best = int(score.argmax())
    assert np.sum(score > score[best] - 1e-6) > 30
    at, top, ratio = dsp.locate(master, cut)
    far = score[np.abs(np.arange(len(score)) - best) > 32].max()
    assert at == best and top == pytest.approx(score[best], abs=1e-12) and ratio == pytest.approx(score[best] / far, abs=1e-12)


def test_samples_that_are_no_numbers():
    master = np.random.default_rng(6).standard_normal(20_000)
    cut = master[15_000:15_064].copy()
    master[10] = np.nan
    assert dsp.locate(master, cut)[:2] == (15_000, pytest.approx(1.0))
    assert dsp.locate(np.full(5000, np.nan), cut) is None and dsp.locate(master, np.full(64, np.nan)) is None
