import numpy as np
import pytest

from tidemark.functions import dsp
from tidemark.operators import alignment, detectors, islands

SR = 16000


def noise(seconds, level=0.003, seed=0, sr=SR):
    return level * np.random.default_rng(seed).standard_normal(int(seconds * sr))


def bursts(spans, seconds=6.0, tone=3000.0, sr=SR):
    x = noise(seconds, sr=sr)
    for a, b in spans:
        t = np.arange(int(a * sr), int(b * sr))
        x[t] += 0.5 * np.sin(2 * np.pi * tone * t / sr)
    return x.astype(np.float32)


def test_stft_is_the_plain_dft():
    x = noise(0.1, 1.0)
    got = dsp.stft_magnitude(x, 256, 64)
    k = 7
    frame = np.pad(x, 128)[k * 64 : k * 64 + 256] * dsp.hann(256)
    plain = [abs(sum(frame[n] * np.exp(-2j * np.pi * f * n / 256) for n in range(256))) for f in (0, 5, 128)]
    assert np.allclose(got[[0, 5, 128], k], plain)
    assert got.shape == (129, 1 + len(x) // 64)


def test_flatness_and_rms():
    s = dsp.stft_magnitude(bursts([(0, 1)], 1.0), 1024, 256)
    assert dsp.flatness(s).max() < 0.1 and dsp.flatness(dsp.stft_magnitude(noise(1.0), 1024, 256)).min() > 0.3
    x = noise(1.0, 0.1)
    mid = dsp.rms(np.abs(np.fft.rfft(x[:1024]))[:, None], 1024)
    assert mid[0] == pytest.approx(np.sqrt((x[:1024] ** 2).mean()))


def test_mel_bands_have_equal_area():
    f = dsp.mel_filters(SR, 4096, 40)
    assert f.shape == (40, 2049) and np.allclose(f.sum(1) * SR / 4096, 1, atol=0.15)


@pytest.mark.parametrize("target", [8000, 11025, 16000, 44100])
def test_resample_keeps_a_tone(target):
    x = np.sin(2 * np.pi * 440 * np.arange(SR) / SR).astype(np.float32)
    y = dsp.resample(x, SR, target)
    assert len(y) == target and y.dtype == np.float32
    want = np.sin(2 * np.pi * 440 * np.arange(target) / target)
    assert np.abs(y - want)[target // 10 : -target // 10].max() < 0.01


def test_label_and_regions():
    mask = np.zeros((6, 8), bool)
    mask[0, 0] = mask[1, 1] = mask[2, 2] = True  # joined by corners
    mask[4:6, 5:8] = True
    sizes = sorted(len(r) for _, r, _ in dsp.label(mask))
    assert sizes == [3, 6]
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    assert len(dsp.label(ring)) == 1


def test_locate_planted_copy():
    master = noise(4.0, 1.0)
    cut = 0.3 * master[20_000:24_000] + 0.1
    for block in (4_000_000, 5000):
        place, value, ratio = dsp.locate(master, cut, block)
        assert place == 20_000 and value == pytest.approx(1.0, abs=1e-6) and ratio > 3
    assert dsp.locate(master, np.zeros(100)) is None and dsp.locate(cut, master) is None


def test_envelope_and_patch():
    e, rate = dsp.rms_envelope(np.ones(1000), 8000, 1000)
    assert rate == 1000 and np.allclose(e, 1)
    v = dsp.patch_feature(np.random.default_rng(1).random((4, 9)), 16)
    assert np.linalg.norm(v) == pytest.approx(1) and v.mean() == pytest.approx(0)
    assert not dsp.patch_feature(np.ones((4, 1)), 16).any()


@pytest.mark.parametrize("name", sorted(detectors.REGISTRY))
def test_detector_contract(name):
    d = detectors.get_detector(name)
    x = bursts([(1.0, 1.8), (3.5, 4.0)])
    spans = d.detect(x, SR)
    assert spans and spans == sorted(spans)
    for a, b, s in spans:
        assert -0.05 <= a <= b <= 6.05 and np.isfinite(s)
    for want in (1.4, 3.75):
        assert any(a <= want <= b for a, b, _ in spans)
    assert d.detect(np.zeros(0, np.float32), SR) == []
    curve = d.salience(x, SR)
    assert curve is None or len(curve[0]) == len(curve[1])


def test_registry():
    with pytest.raises(KeyError):
        detectors.get_detector("none")
    with pytest.raises(TypeError):
        detectors.register("x")(int)
    with pytest.raises(ValueError):
        detectors.register("pcen_peak")(detectors.SpectralEntropy)


def test_template_prefers_what_recurs():
    x = noise(6.0)
    t = np.arange(6400) / SR
    chirp = 0.5 * np.sin(2 * np.pi * (1000 + 4000 * t) * t)
    for at in (1.0, 3.0):
        x[int(at * SR) : int(at * SR) + 6400] += chirp
    x[int(5 * SR) : int(5 * SR) + 6400] += 0.3 * np.random.default_rng(9).standard_normal(6400)
    spans = detectors.get_detector("energy_template", k=3.0).detect(x.astype(np.float32), SR)
    near = lambda at: max(s for a, b, s in spans if a <= at + 0.2 <= b)
    assert min(near(1.0), near(3.0)) > near(5.0)


def test_chunks_agree_with_the_whole():
    d = detectors.get_detector("spectral_entropy")
    x = bursts([(0.5, 0.9), (2.5, 2.9), (4.5, 4.9)])
    asked = []

    def read(a, b):
        asked.append((a, b))
        return x[a:b]

    whole, parts = detectors.detect_chunked(d, read, len(x), SR, None, 0), detectors.detect_chunked(d, read, len(x), SR, 2.0, 0.5)
    assert abs(len(whole) - len(parts)) <= 1
    assert max(b - a for a, b in asked[1:]) == 2 * SR and asked[-1][1] == len(x)
    # the same by plain steps
    found = sorted((a + k * 1.5, b + k * 1.5, s) for k in range(4) if k == 0 or (k - 1) * 1.5 + 2 < 6 for a, b, s in d.detect(x[int(k * 1.5 * SR) : int(k * 1.5 * SR) + 2 * SR], SR))
    want = []
    for a, b, s in found:
        if want and a - want[-1][1] <= 0.5:
            want[-1] = (want[-1][0], max(want[-1][1], b), max(want[-1][2], s))
        else:
            want.append((a, b, s))
    assert np.allclose(parts, want)
    # an overlap as long as the chunk moves on by single samples
    few = detectors.detect_chunked(d, lambda a, b: x[a:b], 4100, SR, 4096 / SR, 1.0)
    assert all(a <= b for a, b, _ in few)


def test_spans_of_a_recording_at_another_rate():
    x = noise(1.0, 1.0)
    for source, target in ((16000, 6000), (16000, 22050), (16000, 16000), (44100, 48000)):
        whole = dsp.resample(x, source, target)
        assert len(whole) == dsp.resampled_length(len(x), source, target)
        parts = [dsp.resample_span(lambda a, b: x[a:b], len(x), source, target, k, min(k + 999, len(whole))) for k in range(0, len(whole), 999)]
        assert np.allclose(np.concatenate(parts), whole, atol=1e-6)


def test_search_is_that_of_all_places():
    rng = np.random.default_rng(7)
    for n in (40, 41, 333):
        master = rng.standard_normal(3000).cumsum()
        cuts = [master[a : a + n] + 0.3 * rng.standard_normal(n) for a in (0, 700, 3000 - n)] + [np.ones(n), rng.standard_normal(4000)]
        got = {b: dsp.locate_all(lambda p, q: master[p:q], 3000, cuts, b) for b in (100_000, 500, 64)}
        for i, cut in enumerate(cuts):
            if i > 2:
                assert all(g[i] is None for g in got.values())
                continue
            t = cut - cut.mean()
            score = np.array([t @ (w - w.mean()) / np.sqrt((t @ t) * ((w - w.mean()) @ (w - w.mean()))) for w in (master[k : k + n] for k in range(3000 - n + 1))])
            best = int(score.argmax())
            far = score[np.abs(np.arange(len(score)) - best) > n // 2].max()
            for g in got.values():
                assert g[i][0] == best and g[i][1] == pytest.approx(score[best]) and g[i][2] == pytest.approx(score[best] / far)


def test_detect_in_spark_and_curve_to_events(spark):
    rows = [("a", SR, bursts([(1.0, 1.8)]).tolist()), ("empty", SR, []), ("none", SR, None)]
    df = spark.createDataFrame(rows, "file_id string, sr int, samples array<float>")
    got = detectors.detect(df, ["spectral_entropy", "maad_roi"]).collect()
    assert {(r.file_id, r.detector) for r in got} == {("a", "spectral_entropy"), ("a", "maad_roi")}
    assert got[0].params["n_fft"] == "2048" or got[0].params["nperseg"] == "1024"
    curve = detectors.salience_curves(df.where("file_id = 'a'"), "spectral_entropy")
    events = islands.salience_events(curve, ["file_id"], 1.5, 0.05, 0.1).orderBy("onset_s").collect()
    kernel = detectors.get_detector("spectral_entropy").detect(np.array(rows[0][2], np.float32), SR)
    assert np.allclose([(r.onset_s, r.offset_s, r.score) for r in events], kernel)


def test_alignment_statuses(spark):
    master = noise(2.0, 1.0).astype(np.float32)
    cut = lambda name, x, sr=SR, m="m": ("s", name, "t", sr, np.asarray(x, np.float32).tolist(), m)
    pairs = spark.createDataFrame(
        [cut("found", master[4000:9000]), cut("short", master[:4]), cut("silent", np.zeros(500)), cut("long", np.ones(40_000)), cut("slow", master[:50], 50), cut("lost", master[:500], m="gone")],
        "species string, cut_file string, tape_id string, cut_sr int, cut array<float>, master_file string",
    )
    masters = spark.createDataFrame([("m", SR, master.tolist())], "master_file string, master_sr int, samples array<float>")
    got = {r.cut_file: r for r in alignment.align(pairs, masters).collect()}
    assert {k: r.status for k, r in got.items() if k != "lost"} == {"found": "ok", "short": "cut_too_short", "silent": "no_corr", "long": "master_shorter_than_cut", "slow": "rate_too_low"}
    assert got["found"].offset_s == pytest.approx(0.25) and got["found"].end_s == pytest.approx(0.25 + 5000 / SR)
    env = alignment.align(pairs.where("cut_file = 'found'"), masters, mode="envelope").first()
    assert env.status == "ok" and env.offset_s == pytest.approx(0.25, abs=0.002)
