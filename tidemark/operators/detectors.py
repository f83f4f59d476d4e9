"""Detectors: waveform to scored intervals. Registered by name, run over rows of samples in Arrow batches."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions import dsp

Spans = list[tuple[float, float, float]]
REGISTRY: dict[str, type[Detector]] = {}


class Detector(ABC):
    """Parameters are the fields of the dataclass; detect() gives sorted (onset, offset, score)."""

    name = ""

    @abstractmethod
    def detect(self, x: np.ndarray, sr: int) -> Spans: ...

    def salience(self, x: np.ndarray, sr: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Frame times and values, where the detector has such a curve."""
        return None


def register(name: str) -> Callable[[type[Detector]], type[Detector]]:
    def enter(kind: type[Detector]) -> type[Detector]:
        if not (isinstance(kind, type) and issubclass(kind, Detector)):
            raise TypeError(f"{kind!r} is no Detector")
        if REGISTRY.get(name, kind) is not kind:
            raise ValueError(f"{name!r} is taken")
        kind.name = name
        REGISTRY[name] = kind
        return kind

    return enter


def get_detector(name: str, **params) -> Detector:
    if name not in REGISTRY:
        raise KeyError(f"no detector {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**params)


class _Curve(Detector):
    def detect(self, x: np.ndarray, sr: int) -> Spans:
        return dsp.curve_events(*self.salience(x, sr), self.k, self.min_dur_s, self.merge_gap_s)


@register("pcen_peak")
@dataclass
class PcenPeak(_Curve):
    """Mel power, normalised per channel against its slow mean, summed over bands."""

    n_fft: int = 2048
    hop_length: int = 512
    n_mels: int = 128
    gain: float = 0.3
    bias: float = 2.0
    power: float = 0.5
    time_constant: float = 1.0
    k: float = 1.0
    min_dur_s: float = 0.05
    merge_gap_s: float = 0.3

    def salience(self, x, sr):
        if not len(x):
            return np.zeros(0), np.zeros(0)
        mel = dsp.mel_power(x, sr, self.n_fft, self.hop_length, self.n_mels) * 2.0**31
        curve = dsp.pcen(mel, sr, self.hop_length, self.gain, self.bias, self.power, self.time_constant).sum(0)
        return dsp.frame_times(len(curve), sr, self.hop_length), curve


@register("spectral_entropy")
@dataclass
class SpectralEntropy(_Curve):
    """One minus spectral flatness, weighted by loudness."""

    n_fft: int = 2048
    hop_length: int = 512
    energy_weight: bool = True
    k: float = 1.5
    min_dur_s: float = 0.05
    merge_gap_s: float = 0.1

    def salience(self, x, sr):
        if not len(x):
            return np.zeros(0), np.zeros(0)
        n, parts = dsp.stft_power(x, self.n_fft, self.hop_length)
        curve, loud = np.empty(n), np.empty(n)
        for at, power in parts:
            curve[at] = 1 - dsp.power_flatness(power)
            loud[at] = dsp.power_rms(power, self.n_fft)
        if self.energy_weight:
            curve = curve * loud / (loud.max() + 1e-12)
        return dsp.frame_times(len(curve), sr, self.hop_length), curve


@register("energy_template")
@dataclass
class EnergyTemplate(Detector):
    """Candidates from the energy envelope, scored by how much their mel patches resemble other candidates'."""

    n_fft: int = 2048
    hop_length: int = 512
    n_mels: int = 128
    k: float = 0.25
    min_dur_s: float = 0.05
    merge_gap_s: float = 0.05
    patch_w: int = 32
    topk: int = 3

    def _mel(self, x, sr):
        mel = dsp.mel_power(x, sr, self.n_fft, self.hop_length, self.n_mels)
        return dsp.frame_times(mel.shape[1], sr, self.hop_length), mel

    def salience(self, x, sr):
        if not len(x):
            return np.zeros(0), np.zeros(0)
        times, mel = self._mel(x, sr)
        return times, dsp.power_to_db(mel.sum(0) + 1e-12)

    def detect(self, x, sr):
        if not len(x):
            return []
        times, mel = self._mel(x, sr)
        spans = dsp.curve_events(times, dsp.power_to_db(mel.sum(0) + 1e-12), self.k, self.min_dur_s, self.merge_gap_s)
        if len(spans) < 2:
            return [(a, b, 1.0) for a, b, _ in spans]
        image = dsp.power_to_db(mel, ref=float(mel.max()))
        patches = np.stack([dsp.patch_feature(image[:, dsp.frames_within(times, on, off)], self.patch_w) for on, off, _ in spans])
        alike = patches @ patches.T
        np.fill_diagonal(alike, -np.inf)
        others = max(1, min(self.topk, len(spans) - 1))
        best = -np.partition(-alike, others - 1, axis=1)[:, :others].mean(1)
        return [(a, b, s) for (a, b, _), s in zip(spans, best.tolist(), strict=True)]


@register("maad_roi")
@dataclass
class SpectrogramRegions(Detector):
    """Connected regions of the noise-reduced spectrogram, as time spans scored by the power in their boxes."""

    nperseg: int = 1024
    noverlap: int = 512
    smooth_std: float = 1.0
    subtract_noise_floor: bool = True
    dither_db: float = 1.0
    bin_std: float = 4.0
    bin_per: float = 0.5
    min_roi: int = 25
    max_roi: int | None = None
    min_dur_s: float = 0.05
    merge_gap_s: float = 0.05

    def detect(self, x, sr):
        if len(x) < self.nperseg:
            return []
        power, times = dsp.psd(x, sr, self.nperseg, self.noverlap)
        image, mean, deviation = dsp.noise_reduced(power, self.smooth_std, self.subtract_noise_floor, self.dither_db)
        boxes = dsp.regions(image, mean + self.bin_std * deviation, self.bin_per, self.min_roi, self.max_roi)
        return dsp.stitch([(times[c0], times[c1], power[c0 : c1 + 1, r0 : r1 + 1].sum()) for r0, r1, c0, c1 in boxes], self.merge_gap_s, self.min_dur_s)


def detect_chunked(detector: Detector, read: dsp.Reader, n: int, sr: int, chunk_s: float | None, overlap_s: float) -> Spans:
    """Detect in overlapping chunks of a recording of n samples and stitch events at most the overlap apart; a short one
    in one piece. Only one chunk is read at a time. An overlap as long as the chunk moves on by one sample."""
    size = int(chunk_s * sr) if chunk_s is not None else n
    if n <= size:
        return sorted(detector.detect(read(0, n), sr))
    hop, found = max(1, size - int(overlap_s * sr)), []
    for start in range(0, n - size + hop, hop):
        found += [(a + start / sr, b + start / sr, s) for a, b, s in detector.detect(read(start, min(n, start + size)), sr)]
    return dsp.stitch(found, overlap_s)


Render = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _over(recordings: DataFrame, run: Render, schema: str, render: Render | None) -> DataFrame:
    """run over recordings (file_id, sr, samples array<float>), or over what render makes of the rows within the same
    pass: samples that a task can make itself need not go through Spark's rows."""
    if render is None:
        return recordings.select("file_id", "sr", "samples").mapInArrow(run, schema)
    return recordings.mapInArrow(lambda batches: run(render(batches)), schema)


EVENTS = "file_id string, detector string, params map<string,string>, ord long, onset_s double, offset_s double, score double, status string"


def _event_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
    names = [x.split()[0] for x in EVENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], names=names)


def detect(recordings: DataFrame, names: list[str], params: dict[str, dict] | None = None, chunk_s: float | None = None, overlap_s: float = 0.0, render: Render | None = None) -> DataFrame:
    """recordings (file_id, sr, samples array<float>) -> events of every named detector, in one pass over the samples.

    A recording that a detector fails on gives one row with null times and the error as status."""
    chosen = [get_detector(n, **(params or {}).get(n, {})) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rates = (batch.column(c).to_pylist() for c in ("file_id", "sr"))
            samples = batch.column("samples")
            for i, (file_id, sr) in enumerate(zip(ids, rates, strict=True)):
                rows = []
                for d in chosen:
                    told = [(k, str(v)) for k, v in asdict(d).items()]
                    try:
                        x = np.asarray(samples[i].values, np.float32) if samples[i].is_valid else np.zeros(0, np.float32)
                        rows += [(file_id, d.name, told, k, a, b, s, "ok") for k, (a, b, s) in enumerate(detect_chunked(d, lambda a, b, x=x: x[a:b], len(x), sr, chunk_s, overlap_s))]
                    except (ValueError, ArithmeticError, IndexError, TypeError) as e:
                        rows.append((file_id, d.name, told, 0, None, None, None, f"error:{type(e).__name__}:{e}"[:120]))
                yield _event_batch(rows)

    return _over(recordings, run, EVENTS, render)


def detect_files(files: DataFrame, names: list[str], params: dict[str, dict] | None = None, target_sr: int | None = None, chunk_s: float | None = None, overlap_s: float = 0.0) -> DataFrame:
    """detect() over files (file_id, path): tasks open the files and read them chunk by chunk, at target_sr if given;
    samples never stand in rows. A file that cannot be read gives one row with its error."""
    from tidemark.sources import audio

    chosen = [get_detector(n, **(params or {}).get(n, {})) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for d in chosen:
                    told = [(k, str(v)) for k, v in asdict(d).items()]
                    try:
                        with audio.Recording(path, target_sr) as r:
                            rows += [(file_id, d.name, told, k, a, b, s, "ok") for k, (a, b, s) in enumerate(detect_chunked(d, r.read, r.frames, r.rate, chunk_s, overlap_s))]
                    except (ValueError, ArithmeticError, IndexError, TypeError, OSError) as e:
                        rows.append((file_id, d.name, told, 0, None, None, None, str(e) if str(e) == "unsupported_format" else f"error:{type(e).__name__}:{e}"[:120]))
                yield _event_batch(rows)

    return files.select("file_id", "path").mapInArrow(run, EVENTS)


def salience_curves(recordings: DataFrame, name: str, render: Render | None = None, **params) -> DataFrame:
    """(file_id, frame_idx, time_s, value) of a detector's curve."""
    d = get_detector(name, **params)
    schema = "file_id string, frame_idx int, time_s double, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, sr, x in zip(batch.column("file_id").to_pylist(), batch.column("sr").to_pylist(), batch.column("samples"), strict=True):
                curve = d.salience(np.asarray(x.values, np.float32), sr)
                if curve is None:
                    raise ValueError(f"{name} has no salience curve")
                n = len(curve[0])
                yield pa.RecordBatch.from_arrays([pa.array([file_id] * n, pa.string()), pa.array(np.arange(n), pa.int32()), pa.array(curve[0]), pa.array(curve[1].astype(np.float64))], names=["file_id", "frame_idx", "time_s", "value"])

    return _over(recordings, run, schema, render)


GRID = "seg_id string, wav_id string, k int, start double, `end` double, n_events long, max_score double, sum_score double"


def _grid_batch(d: Detector, wav_id: str, read: dsp.Reader, n: int, sr: int, window_s: float) -> pa.RecordBatch:
    total = n / sr if sr else 0.0
    spans = [(0.0, total)] if total < window_s else [(k * window_s, (k + 1) * window_s) for k in range(int(total // window_s))]
    rows = []
    for k, (a, b) in enumerate(spans):
        scores = [s for *_, s in d.detect(read(int(round(a * sr)), min(n, int(round(b * sr)))), sr)]
        rows.append((f"{wav_id}-{k:09d}", wav_id, k, a, b, len(scores), max(scores, default=0.0), float(sum(scores))))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["seg_id", "wav_id", "k", "start", "end", "n_events", "max_score", "sum_score"])


def score_windows(recordings: DataFrame, name: str = "maad_roi", window_s: float = 10.0, render: Render | None = None, **params) -> DataFrame:
    """(seg_id, wav_id, k, start, end, n_events, max_score, sum_score) for each grid window, the detector being run on
    each window by itself."""
    d = get_detector(name, **params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wav_id, sr, x in zip(batch.column("file_id").to_pylist(), batch.column("sr").to_pylist(), batch.column("samples"), strict=True):
                x = np.asarray(x.values, np.float32)
                yield _grid_batch(d, wav_id, lambda a, b, x=x: x[a:b], len(x), sr, window_s)

    return _over(recordings, run, GRID, render)


def score_files(files: DataFrame, name: str = "maad_roi", window_s: float = 10.0, target_sr: int | None = None, **params) -> DataFrame:
    """score_windows() over files (file_id, path), read window by window. Files that cannot be read are left out."""
    from tidemark.sources import audio

    d = get_detector(name, **params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wav_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    r = audio.Recording(path, target_sr)
                except (ValueError, OSError):
                    continue
                with r:
                    yield _grid_batch(d, wav_id, r.read, r.frames, r.rate, window_s)

    return files.select("file_id", "path").mapInArrow(run, GRID)
