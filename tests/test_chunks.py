"""Short chunks of a recording: their kernels hold little and give what the plain steps give."""

import tracemalloc

import numpy as np
import pytest

from tidemark.functions import dsp
from tidemark.operators import detectors

RATE = 16000


def test_a_chunk_holds_few_spectra():
    x, d = np.random.default_rng(1).standard_normal(6 * RATE).astype(np.float32), detectors.get_detector("spectral_entropy")
    run = lambda: detectors.detect_chunked(d, lambda a, b: x[a:b], len(x), RATE, 2.0, 0.5)
    run()  # tables that stay are made once
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 3  # a chunk's 63 frames take 1 MB, their spectra 1 MB, and power as much again


@pytest.mark.parametrize("n", [1, 2, 5, 63, 64])
def test_median_is_that_of_numpy(n):
    v = np.random.default_rng(n).standard_normal(n)
    assert dsp.median(v) == np.median(v)
    v[0] = np.nan
    assert np.isnan(dsp.median(v))


def test_spectra_are_those_of_plain_frames():
    x = np.random.default_rng(2).standard_normal(70 * 128).astype(np.float32)
    n, parts = dsp.stft_power(x, 512, 128)
    got = np.concatenate([power.copy() for _, power in parts])
    padded = np.pad(x.astype(np.float64), 256)
    want = [np.abs(np.fft.rfft(padded[k * 128 : k * 128 + 512] * dsp.hann(512))) ** 2 for k in range(n)]
    assert n == 71 and np.allclose(got, want, rtol=1e-12)
    with pytest.raises(ValueError):
        dsp.hann(512)[0] = 1


def test_stitched_spans_are_those_of_sweeps():
    rng = np.random.default_rng(3)
    for score, put in ((np.maximum, max), (np.add, lambda a, b: a + b)):
        on = rng.integers(0, 400, 150) / 4
        spans = list(zip(on, on + rng.integers(1, 9, 150) / 4, rng.integers(0, 99, 150).astype(float), strict=True))
        want = []
        for a, b, s in sorted(spans):
            if want and a - want[-1][1] <= 0.5:
                want[-1] = (want[-1][0], max(want[-1][1], b), put(want[-1][2], s))
            else:
                want.append((a, b, s))
        got = dsp.stitch(spans, 0.5, 1.0, score)
        assert got == [w for w in want if w[1] - w[0] >= 1.0] and all(type(v) is float for w in got for v in w)
    assert dsp.stitch([], 0.5) == []
