"""Kernels of the detectors: spectra are gone through in parts, and give what plain steps on the whole give."""

import tracemalloc

import numpy as np

from tidemark.functions import dsp
from tidemark.operators import detectors

RATE = 16000


def noise(seconds: float) -> np.ndarray:
    return np.random.default_rng(5).standard_normal(int(RATE * seconds)).astype(np.float32)


def peak_mb(run) -> float:
    run()  # tables that stay are made once
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_spectral_entropy_holds_no_whole_spectrum():
    x, d = noise(60), detectors.get_detector("spectral_entropy")
    # the whole spectrum has 1,025 x 1,875 doubles
    assert peak_mb(lambda: d.detect(x, RATE)) < 25
    s = dsp.stft_magnitude(x)
    p = np.maximum(1e-10, s**2)
    assert np.allclose(dsp.flatness(s), np.exp(np.log(p).mean(0)) / p.mean(0), rtol=1e-12)
    loud = dsp.rms(s, 2048)
    assert np.allclose(d.salience(x, RATE)[1], (1 - dsp.flatness(s)) * loud / (loud.max() + 1e-12), rtol=1e-12)


def test_flatness_beyond_the_range_of_products():
    for scale in (0.0, 1e-9, 1e16, 1e60):
        s = scale * np.abs(np.random.default_rng(1).standard_normal((1025, 3)))
        p = np.maximum(1e-10, s**2)
        assert np.allclose(dsp.flatness(s), np.exp(np.log(p).mean(0)) / p.mean(0), rtol=1e-12)


def test_mel_power_multiplies_only_bins_that_filters_reach():
    x = noise(60)
    assert np.allclose(dsp.mel_power(x, RATE), dsp.mel_filters(RATE, 2048, 128) @ dsp.stft_magnitude(x) ** 2, rtol=1e-10)
    assert peak_mb(lambda: dsp.mel_power(x, RATE)) < 25
    # more filters than bins: some reach none
    assert np.allclose(dsp.mel_power(x, RATE, 64, 64, 100), dsp.mel_filters(RATE, 64, 100) @ dsp.stft_magnitude(x, 64, 64) ** 2)


def test_pcen_peak_goes_through_frames_that_lie_together():
    s = np.random.default_rng(2).random((128, 200)) * 1e6
    t = RATE / 512
    b = (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    m, want = np.ones(128), []
    for column in s.T:
        m = b * column + (1 - b) * m
        want.append((column / (1e-6 + m) ** 0.3 + 2) ** 0.5 - 2**0.5)
    got = dsp.pcen(s, RATE, 512, 0.3, 2.0, 0.5, 1.0)
    assert np.allclose(got, np.array(want).T, rtol=1e-9)
    x, d = noise(60), detectors.get_detector("pcen_peak")
    assert peak_mb(lambda: d.detect(x, RATE)) < 25


def test_regions_are_those_of_a_flood_fill():
    for share in (0.1, 0.3, 0.6, 1.0, 0.0):
        mask = np.random.default_rng(3).random((23, 57)) < share
        column, first, last, up = dsp.runs_of(mask)
        got = {}
        for c, a, b, k in zip(column, first, last, up, strict=True):
            got.setdefault(int(k), set()).update((int(r), int(c)) for r in range(a, b))
        left, want = {(int(r), int(c)) for r, c in np.argwhere(mask)}, set()
        while left:
            todo, own = [left.pop()], set()
            while todo:
                r, c = todo.pop()
                own.add((r, c))
                near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            want.add(frozenset(own))
        assert {frozenset(g) for g in got.values()} == want


def test_regions_of_a_spectrogram_whose_rows_are_finished_some_at_a_time(monkeypatch):
    d = detectors.get_detector("maad_roi")
    x = noise(60)
    # one image has 513 x 1,874 doubles, 7.7 MB: the density and the image are held, beside the runs of a mask
    assert peak_mb(lambda: d.detect(x, RATE)) < 25

    def plain(power, std, floor, level):
        image = np.clip(10 * np.log10(np.maximum(power.T, 1e-30)), -96, None) + 96
        r = int(4 * std + 0.5)
        if r:
            w = np.exp(-0.5 * (np.arange(-r, r + 1) / std) ** 2)
            for axis in (0, 1):
                image = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="edge"), w / w.sum(), "valid"), axis, image)
        if floor and image.shape[1] > 1:
            image = np.maximum(image - np.median(image, axis=1, keepdims=True), 0)
        return image + level * np.abs(np.random.default_rng(0).standard_normal(image.shape))

    monkeypatch.setattr(dsp, "KEPT", 5000)  # draws that are kept end within the image
    dsp.first_draws.cache_clear()
    for n in (1024, 1536, 33 * 512, 90 * 512):
        power, _ = dsp.psd(np.concatenate([np.zeros(n // 4, np.float32), 0.003 * x[: n - n // 4]]), RATE)
        for how in ((1.0, True, 1.0), (0.0, True, 2.5), (2.5, False, 0.0)):
            image, mean, deviation = dsp.noise_reduced(power, *how)
            want = plain(power, *how)
            assert np.allclose(image, want, rtol=0, atol=1e-9) and np.allclose((mean, deviation), (want.mean(), want.std()), rtol=1e-9, atol=1e-9)
    dsp.first_draws.cache_clear()


def test_regions_need_a_seed_and_an_area():
    image = np.zeros((6, 9))
    image[1:3, 1:4], image[2, 3], image[4:6, 5:8] = 0.6, 1.5, 0.9
    assert dsp.regions(image, 1.0, 0.5, 1) == [(1, 2, 1, 3)]
    image[4, 4] = 1.5
    assert sorted(dsp.regions(image, 1.0, 0.5, 1)) == [(1, 2, 1, 3), (4, 5, 4, 7)]
    assert dsp.regions(image, 1.0, 0.5, 7) == [(4, 5, 4, 7)] and dsp.regions(image, 1.0, 0.5, 1, 6) == [(1, 2, 1, 3)]
    assert dsp.regions(image, 1.0, 0.5, 1, 5) == [] == dsp.regions(image, np.nan)
