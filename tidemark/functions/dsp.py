"""Signal kernels in NumPy, called inside Arrow batches. Arrays are float64 unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import gcd

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

BLOCK = 1 << 20


@lru_cache(8)
def hann(n: int) -> np.ndarray:
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    window.setflags(write=False)
    return window


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size))
    own = np.ndarray((1 + (len(x) - size) // hop, size), x.dtype, x, strides=(hop * x.strides[0], x.strides[0])) if x.flags.c_contiguous else sliding_window_view(x, size)[::hop]
    own.setflags(write=False)
    return own


#: Frames that are transformed at once: their spectra stay in a processor's cache.
SOME = 32


def spectra(own: np.ndarray, window: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Power spectra of windowed frames, time x frequency, some frames at a time: where they stand, and a buffer that
    the next ones overwrite."""
    most, bins = min(SOME, len(own)), len(window) // 2 + 1
    part, f = np.empty((most, len(window))), np.empty((most, bins), complex)
    power = part.ravel()[: most * bins].reshape(most, bins)  # frames that are transformed make room for their spectra
    for a in range(0, len(own), SOME):
        n = min(SOME, len(own) - a)
        np.fft.rfft(np.multiply(own[a : a + n], window, out=part[:n]), out=f[:n])
        both = f[:n].view(np.float64)
        np.multiply(both, both, out=both)
        yield slice(a, a + n), np.add(both[:, ::2], both[:, 1::2], out=power[:n])


def stft_power(x: np.ndarray, n_fft: int = 2048, hop: int = 512) -> tuple[int, Iterator[tuple[slice, np.ndarray]]]:
    """How many frames there are, and their spectra: Hann window, frames centred on multiples of hop, zeros beyond the
    ends."""
    padded = np.zeros(len(x) + n_fft // 2 * 2)
    padded[n_fft // 2 : n_fft // 2 + len(x)] = x
    own = frames(padded, n_fft, hop)
    return len(own), spectra(own, hann(n_fft))


def stft_magnitude(x: np.ndarray, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """|STFT|, frequency x time."""
    n, parts = stft_power(x, n_fft, hop)
    out = np.empty((n_fft // 2 + 1, n))
    for at, power in parts:
        out[:, at] = np.sqrt(power).T
    return out


def frame_times(n: int, sr: int, hop: int) -> np.ndarray:
    return np.arange(n) * hop / sr


def mel_filters(sr: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangles of equal area on a scale that is linear to 1 kHz and logarithmic above."""
    step, knee, growth = 200 / 3, 1000.0, np.log(6.4) / 27
    to_mel = lambda f: f / step if f < knee else knee / step + np.log(f / knee) / growth
    m = np.linspace(0, to_mel(sr / 2), n_mels + 2)
    hz = np.where(m < knee / step, m * step, knee * np.exp(growth * (m - knee / step)))
    f = np.fft.rfftfreq(n_fft, 1 / sr)
    rise = (f - hz[:-2, None]) / np.diff(hz)[:-1, None]
    fall = (hz[2:, None] - f) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (hz[2:] - hz[:-2]))[:, None]


@lru_cache(8)
def mel_bands(sr: int, n_fft: int, n_mels: int) -> list[tuple[slice, slice, np.ndarray]]:
    """The filters eight by eight, with the bins that they reach: (filters, bins, weights by bin)."""
    weights, out = mel_filters(sr, n_fft, n_mels), []
    for k in range(0, n_mels, 8):
        used = np.flatnonzero(weights[k : k + 8].any(0))
        bins = slice(int(used[0]), int(used[-1]) + 1) if len(used) else slice(0, 0)
        out.append((slice(k, min(n_mels, k + 8)), bins, np.ascontiguousarray(weights[k : k + 8, bins].T)))
    return out


def mel_power(x: np.ndarray, sr: int, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> np.ndarray:
    n, parts = stft_power(x, n_fft, hop)
    out = np.empty((n, n_mels))
    for at, power in parts:
        for own, bins, weights in mel_bands(sr, n_fft, n_mels):
            out[at, own] = power[:, bins] @ weights
    return out.T


def pcen(s: np.ndarray, sr: int, hop: int, gain: float, bias: float, power: float, time_constant: float, eps: float = 1e-6) -> np.ndarray:
    """Per-channel energy normalisation: (s / (eps + m)^gain + bias)^power - bias^power, m a first-order low-pass of s
    that starts from the steady state of a unit input."""
    t = time_constant * sr / hop
    b = (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    m, state = b * np.ascontiguousarray(s.T), np.full(len(s), 1 - b)
    for row in m:
        row += state
        np.multiply(row, 1 - b, out=state)
    m = m.T
    smooth = np.exp(-gain * (np.log(eps) + np.log1p(m / eps)))
    return bias**power * np.expm1(power * np.log1p(s * smooth / bias))


def power_to_db(s: np.ndarray, ref: float = 1.0, floor: float = 1e-10, top: float | None = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(floor, s)) - 10 * np.log10(max(floor, ref))
    return np.maximum(db, db.max() - top) if top is not None and db.size else db


def flatness(magnitude: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Geometric over arithmetic mean of each frame's power."""
    return power_flatness(magnitude.T**2, floor)


def power_flatness(power: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """The same of spectra, time x frequency."""
    p = power if power.size and power.min() >= floor else np.maximum(floor, power)
    total = p.sum(1)
    # a logarithm of eight bins' product instead of eight, where no product can leave the range of doubles
    n = p.shape[1] // 8
    if floor >= 1e-30 and p.size and total.max() < 1e30:
        heads = p[:, : 4 * n] * p[:, 4 * n : 8 * n]
        heads = heads[:, : 2 * n] * heads[:, 2 * n :]
        logs = np.log(heads[:, :n] * heads[:, n:]).sum(1) + np.log(p[:, 8 * n :]).sum(1)
    else:
        logs = np.log(p).sum(1)
    return np.exp(logs / p.shape[1]) / (total / p.shape[1])


def rms(magnitude: np.ndarray, n_fft: int) -> np.ndarray:
    """Each frame's root mean square, from its one-sided spectrum."""
    return power_rms(magnitude.T**2, n_fft)


def power_rms(power: np.ndarray, n_fft: int) -> np.ndarray:
    """The same of spectra, time x frequency."""
    ends = 0.5 * power[:, 0] + (0.5 * power[:, -1] if n_fft % 2 == 0 else 0.0)
    return np.sqrt(2 * (power.sum(1) - ends)) / n_fft


def psd(x: np.ndarray, sr: int, size: int = 1024, overlap: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power spectral density, time x frequency, and the frames' centres."""
    own, window = frames(np.asarray(x), size, size - overlap), hann(size)
    scale = np.full(size // 2 + 1, 2 / (sr * (window**2).sum()))
    scale[[0, -1]] *= 0.5
    p = np.empty((len(own), len(scale)))
    for at, power in spectra(own, window):
        np.multiply(power, scale, out=p[at])
    return p, (np.arange(len(own)) * (size - overlap) + size / 2) / sr


@lru_cache(8)
def gaussian(std: float, n: int) -> np.ndarray:
    """n rows of weights of a Gaussian, four deviations wide, over n + 2 r values; none but the value itself without a
    deviation."""
    r = int(4 * std + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / std) ** 2) if r else np.ones(1)
    out = np.zeros((n, n + 2 * r))
    for k in range(n):
        out[k, k : k + 2 * r + 1] = w / w.sum()
    out.setflags(write=False)
    return out


#: Rows of an image that are smoothed along frequency at once.
ROWS = 27


def smoothed_db(power: np.ndarray, std: float) -> Iterator[np.ndarray]:
    """Decibels over -96 of a density time x frequency, smoothed by a separable Gaussian, edges repeated: first a buffer
    frequency x time for the whole, then its rows, some at a time; room for them is made at the top of the buffer."""
    n, bins = power.shape
    r = gaussian(std, 1).shape[1] // 2
    image, near = np.empty((bins + 2 * r, n)), np.empty((SOME + 2 * r, bins))
    for a in range(0, n, SOME):
        b = min(n, a + SOME)
        db = np.take(power, np.arange(a - r, b + r), 0, near[: b - a + 2 * r], "clip")
        np.log10(np.maximum(db, 1e-30, out=db), out=db)
        db *= 10
        np.maximum(db, -96, out=db)
        db += 96
        np.matmul(db.T, gaussian(std, b - a).T, out=image[r : r + bins, a:b])
    image[:r], image[r + bins :] = image[r], image[r + bins - 1]
    yield image[:bins]
    for a in range(0, bins, ROWS):
        b = min(bins, a + ROWS)
        yield gaussian(std, b - a) @ image[a : b + 2 * r]


def remove_floor(rows: np.ndarray) -> None:
    """Each row less its median, at least 0, in place."""
    half = rows.shape[1] // 2
    part = np.partition(rows, half, axis=1)
    middle = part[:, half] if rows.shape[1] % 2 else (part[:, :half].max(1) + part[:, half]) / 2
    np.maximum(np.subtract(rows, middle[:, None], out=rows), 0.0, out=rows)


#: Draws of a dither that a worker keeps, as they are the same for every recording: 16 MB.
KEPT = 1 << 21


@lru_cache(1)
def first_draws(seed: int) -> tuple[np.ndarray, dict]:
    rng = np.random.default_rng(seed)
    kept = np.abs(rng.standard_normal(KEPT))
    kept.setflags(write=False)
    return kept, rng.bit_generator.state


def dither(seed: int = 0) -> Callable[[int], np.ndarray]:
    """The sizes of a generator's normal draws, from the first one on, as many as are asked for at a time."""
    kept, state = first_draws(seed)
    rng, at = np.random.default_rng(seed), 0
    rng.bit_generator.state = state

    def take(n: int) -> np.ndarray:
        nonlocal at
        own, at = kept[at : at + n], at + n
        return own if len(own) == n else np.concatenate([own, np.abs(rng.standard_normal(n - len(own)))])

    return take


def noise_reduced(power: np.ndarray, std: float, floor: bool, level: float) -> tuple[np.ndarray, float, float]:
    """Image frequency x time of a density time x frequency, with its mean and standard deviation: smoothed decibels,
    less each row's median, plus a dither. Rows are finished some at a time, so that they stay in a processor's cache."""
    n, noise = len(power), dither()
    parts = smoothed_db(power, std)
    image = next(parts)
    sizes, means, squares, at = [], [], [], 0
    for rows in parts:
        if floor and n > 1:
            remove_floor(rows)
        if level > 0:
            rows += level * noise(rows.size).reshape(rows.shape)
        image[at : at + len(rows)] = rows
        at += len(rows)
        sizes.append(rows.size)
        means.append(rows.mean())
        rows -= means[-1]
        squares.append(np.vdot(rows, rows))
    mean = np.average(means, weights=sizes)
    return image, mean, np.sqrt((sum(squares) + np.dot(sizes, (np.array(means) - mean) ** 2)) / image.size)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertical runs of a mask by column: column, first row, row behind the last, and the number of the first run of the
    8-connected region that it is of."""
    height = len(mask) + 2
    padded = np.zeros((mask.shape[1], height), bool)
    padded[:, 1:-1] = mask.T
    flat = padded.ravel()
    # places in the padded columns laid end to end: column * height + row
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    first, last = edges[::2], edges[1::2]
    column = first // height
    # those of the column before that touch a run, corners too, follow each other
    low, high = np.searchsorted(last, first - height), np.searchsorted(first, last - height, side="right")
    n = np.maximum(high - low, 0)
    right = np.repeat(np.arange(len(first)), n)
    left = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    up = np.arange(len(first))
    while True:
        a, b = up[left], up[right]
        apart = a != b
        if not apart.any():
            return column, first - column * height, last - column * height, up
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


def label(mask: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """8-connected regions of a mask as (number, rows, columns): vertical runs of neighbouring columns are joined."""
    column, first, last, up = runs_of(mask)
    out = []
    for n, root in enumerate(np.unique(up)):
        own = np.flatnonzero(up == root)
        rows = np.concatenate([np.arange(first[k], last[k]) for k in own])
        out.append((n, rows, np.repeat(column[own], last[own] - first[own])))
    return out


def regions(image: np.ndarray, high: float, share: float = 0.5, least: int = 25, most: int | None = None) -> list[tuple[int, int, int, int]]:
    """Boxes (first and last row, first and last column) of regions above a low threshold that hold a seed above the
    high one (the low one is its share), by area."""
    # runs along the rows of the image, which lie together in memory
    row, first, last, up = runs_of((image >= share * high).T)
    if not len(up):
        return []
    order = np.argsort(up, kind="stable")
    row, first, last = row[order], first[order], last[order]
    begin = np.flatnonzero(np.diff(up[order], prepend=-1))
    size = last - first
    ends = np.cumsum(size)
    cells = np.arange(ends[-1]) + np.repeat(row * image.shape[1] + first - ends + size, size)
    seeded = np.maximum.reduceat(image.ravel()[cells], (ends - size)[begin]) > high
    area = np.add.reduceat(size, begin)
    kept = (area >= least) & seeded
    if most is not None:
        kept &= area <= most
    sides = (np.minimum.reduceat(row, begin), np.maximum.reduceat(row, begin), np.minimum.reduceat(first, begin), np.maximum.reduceat(last, begin) - 1)
    return list(zip(*(e[kept].tolist() for e in sides), strict=True))


Reader = Callable[[int, int], np.ndarray]  # samples [first, last) of a recording


def resampled_length(n: int, source: int, target: int) -> int:
    g = gcd(int(source), int(target)) if source and target else 1
    return n if source == target else -(-n * (int(target) // g) // (int(source) // g))


def resample_span(read: Reader, n: int, source: int, target: int, first: int, last: int) -> np.ndarray:
    """Samples [first, last) of a recording of n samples at another rate: polyphase resampling by the reduced ratio with
    a Kaiser-windowed sinc, float32, zeros beyond the ends. Only the samples that these depend on are read."""
    if source == target:
        return np.ascontiguousarray(read(first, last), np.float32)
    g = gcd(int(source), int(target))
    up, down = int(target) // g, int(source) // g
    widest = max(up, down)
    half = 10 * widest
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    # y[m] = sum_j x[j] taps[m * down - j * up + half]
    reach = -(-half // up) + 1
    low, high = first * down // up - reach, max(first, last - 1) * down // up + reach + 1
    x = np.asarray(read(max(0, low), min(n, high)), np.float64)
    x = np.pad(x, (max(0, -low), max(0, high - n)))
    rows = sliding_window_view(x, 2 * reach + 1)
    out = np.empty(last - first)
    for phase in range(min(up, last - first)):
        m = np.arange(first + phase, last, up)
        centre, rest = np.divmod(m[0] * down, up)
        at = rest - np.arange(-reach, reach + 1) * up + half
        weight = np.where((at >= 0) & (at <= 2 * half), taps[np.clip(at, 0, 2 * half)], 0.0)
        begin = centre - reach - low + np.arange(len(m)) * down
        out[phase::up] = np.concatenate([rows[part] @ weight for part in np.array_split(begin, max(1, len(m) // BLOCK))])
    return out.astype(np.float32)


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """A whole recording at another rate. Equal rates change nothing."""
    x = np.ascontiguousarray(x, np.float32)
    if source == target or not len(x):
        return x
    return resample_span(lambda a, b: x[a:b], len(x), source, target, 0, resampled_length(len(x), source, target))


def rms_envelope(x: np.ndarray, sr: int, rate: int) -> tuple[np.ndarray, float]:
    """Root mean square of successive windows of about sr / rate samples, whole windows only; and their rate."""
    size = max(1, int(np.rint(sr / rate)))
    whole = np.asarray(x[: len(x) // size * size], np.float64).reshape(-1, size)
    return np.sqrt((whole**2).mean(1)).astype(np.float32), sr / size


def moments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of n samples the sum, and the energy about its mean."""
    sums = np.cumsum(np.stack([x, x * x]), axis=1)
    sums = np.concatenate([sums[:, n - 1 : n], sums[:, n:] - sums[:, :-n]], axis=1)
    return sums[0], np.maximum(sums[1] - sums[0] ** 2 / n, SILENT)


def correlations(part: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised correlation of a template of zero mean with every place of part where it fits."""
    n = len(template)
    size = 1 << (len(part) - 1).bit_length()
    x = np.asarray(part, np.float64)
    along = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(template, size).conj(), size)[: len(x) - n + 1]
    return along / np.sqrt(moments(x, n)[1] * (template @ template))


def template(cut: np.ndarray) -> np.ndarray:
    cut = np.asarray(cut, np.float64)
    return cut - cut.mean() if len(cut) else cut


#: Fixed value: energy below which a window or a template counts as silent.
SILENT = 1e-9


#: Places whose greatest correlation is kept (half a cut, where that is more), places that are multiplied at once, and
#: the longest cut whose correlations are taken as products of matrices; those of longer ones go through a transform.
CELL, STRIP, SHORT = 256, 1024, 256


class Search:
    """Where each of some cuts of one length correlates best with a recording that is fed block by block. Kept is the
    greatest correlation of each cell of places; a block begins at a multiple of that.

    Short cuts are multiplied in single precision, all of them with some places at once. That only tells which cells can
    hold the greatest correlation: `found` takes it from these in double precision."""

    def __init__(self, cuts: list[np.ndarray], total: int) -> None:
        self.size, self.places = len(cuts[0]), total - len(cuts[0]) + 1
        self.templates = np.stack([template(c) for c in cuts])
        self.guard = max(1, self.size // 2)
        self.cell = max(self.guard, CELL)
        self.short = self.size <= SHORT
        # twice what a sum of rounded products of two unit vectors can be off by; of transforms, their noise
        self.slack = 2 * (self.size + 8) * 2.0**-24 if self.short else 1e-9
        norms = np.sqrt((self.templates**2).sum(1, keepdims=True))
        self.unit = (self.templates / norms).astype(np.float32) if self.short else self.templates
        self.value: list[np.ndarray] = []

    def feed(self, begin: int, part: np.ndarray) -> None:
        """part: samples from `begin` on, with as many more than the block's places as the cuts need."""
        step = STRIP if self.short else len(part)
        for k in range(0, len(part) - self.size + 1, step):
            own = part[k : k + step + self.size - 1]
            scores = self._rough(own) if self.short else np.stack([self._greatest(correlations(own, t)[None])[0] for t in self.templates])
            self.value.append(self._greatest(scores) if self.short else scores)

    def _rough(self, part: np.ndarray) -> np.ndarray:
        x = np.asarray(part, np.float64)
        x = x - x.mean()
        total, spread = moments(x, self.size)
        windows = sliding_window_view(x, self.size) - (total / self.size)[:, None]
        return self.unit @ np.multiply(windows, (1 / np.sqrt(spread))[:, None]).astype(np.float32).T

    def _greatest(self, scores: np.ndarray) -> np.ndarray:
        """Of each cell, cut by cut."""
        return np.maximum.reduceat(scores, np.arange(0, scores.shape[1], self.cell), axis=1)

    def found(self, read: Reader) -> list[tuple[int, float, float] | None]:
        """Of each cut the position, the correlation, and its ratio to the best one more than half a cut away; None
        where no place has a correlation, as samples are no numbers."""
        return [self._found(read, t, v) for t, v in zip(self.templates, np.concatenate(self.value, axis=1), strict=True)]

    def _found(self, read: Reader, own: np.ndarray, value: np.ndarray) -> tuple[int, float, float] | None:
        def exactly(first: int, last: int) -> np.ndarray:
            return correlations(read(first, last + self.size - 1), own)

        first = np.arange(len(value)) * self.cell
        last = np.minimum(first + self.cell, self.places)
        value = np.where(np.isnan(value), -np.inf, value)
        top, at = -np.inf, 0
        for c in np.flatnonzero(value >= value.max() - self.slack):
            score = exactly(first[c], last[c])
            k = int(score.argmax())
            if score[k] > top:
                top, at = float(score[k]), int(first[c]) + k
        if top == -np.inf:
            return None
        # cells that lie partly within reach of the best place are gone over again, and so are the best of the others
        other = 0.0
        reach = (last > at - self.guard) & (first <= at + self.guard)
        for a, b in ((first[reach][0], at - self.guard), (at + self.guard + 1, last[reach][-1])):
            if a < b:
                other = max(other, float(exactly(a, b).max()))
        value = np.where(reach, -np.inf, value)
        for c in np.flatnonzero(value >= max(other, value.max()) - self.slack) if not reach.all() else ():
            other = max(other, float(exactly(first[c], last[c]).max()))
        return at, top, peak_ratio(top, other)


def peak_ratio(best: float, other: float) -> float:
    return best / other if other > 1e-6 else float("inf")


def locate_all(read: Reader, total: int, cuts: list[np.ndarray], block: int = BLOCK) -> list[tuple[int, float, float] | None]:
    """Search's result for each cut, None for silent ones and those that do not fit. The recording is read once, in
    blocks, for all; cuts of one length are searched for together."""
    by: dict[int, list[int]] = {}
    for i, cut in enumerate(cuts):
        if len(cut) <= total and float(np.sqrt((template(cut) ** 2).sum())) >= SILENT:
            by.setdefault(len(cut), []).append(i)
    searches = {n: Search([cuts[i] for i in own], total) for n, own in by.items()}
    beyond = max((s.size + s.cell for s in searches.values()), default=0)
    next_ = dict.fromkeys(searches.values(), 0)  # the first place of each search that is still to be looked at
    while left := [s for s in next_ if next_[s] < s.places]:
        begin = min(next_[s] for s in left)
        part = read(begin, min(total, begin + block + beyond))
        for s in left:
            # whole cells up to the block's end, one at least where the search has not come farther yet
            first, cells = next_[s], -(-(begin + block - next_[s]) // s.cell)
            if cells > 0:
                last = min(s.places, first + cells * s.cell)
                s.feed(first, part[first - begin : last + s.size - 1 - begin])
                next_[s] = last
    out: list[tuple[int, float, float] | None] = [None] * len(cuts)
    for n, s in searches.items():
        for i, hit in zip(by[n], s.found(read), strict=True):
            out[i] = hit
    return out


def locate(master: np.ndarray, cut: np.ndarray, block: int = BLOCK) -> tuple[int, float, float] | None:
    """Where cut correlates best with master: (position, normalised correlation, ratio to the best elsewhere).

    Positions nearer than half a cut to the best do not count as elsewhere. None for a silent cut or a master shorter
    than it."""
    return locate_all(lambda a, b: master[a:b], len(master), [cut], block)[0]


def patch_feature(patch: np.ndarray, width: int) -> np.ndarray:
    """A patch stretched to width columns, with zero mean and unit length."""
    t = patch.shape[1]
    at = np.linspace(0.0, 1.0, width) * (t - 1)
    low = np.minimum(np.floor(at).astype(int), max(0, t - 2))
    part = at - low
    high = np.minimum(low + 1, t - 1)
    v = (patch[:, low] * (1 - part) + patch[:, high] * part).ravel()
    v = v - v.mean()
    for size in (v.std(), None):
        size = np.linalg.norm(v) if size is None else size
        if size > 1e-12:
            v = v / size
    return v


def frames_within(times: np.ndarray, on: float, off: float) -> slice:
    """The frames from on to off; where none lies there, the next one, or the last."""
    inside = np.flatnonzero((times >= on) & (times <= off))
    if inside.size:
        return slice(inside[0], inside[-1] + 1)
    after = np.flatnonzero(times >= on)
    k = int(after[0]) if after.size else len(times) - 1
    return slice(k, k + 1)


def stitch(spans: list[tuple[float, float, float]], gap: float, least: float = -np.inf, score=np.maximum) -> list[tuple[float, float, float]]:
    """Spans at most gap apart become one, scores put together by a ufunc; those of `least` or more are kept."""
    out: list[tuple[float, float, float]] = []
    reach = -np.inf
    for on, off, s in sorted(spans):
        joined = bool(out) and not on - reach > gap
        reach = max(reach, float(off))
        if joined:
            out[-1] = (out[-1][0], reach, float(score(out[-1][2], s)))
        else:
            out.append((float(on), reach, float(s)))
    return [x for x in out if x[1] - x[0] >= least]


def median(values: np.ndarray) -> float:
    """np.median of one row, which takes ten times as long for the few frames of a chunk."""
    own = np.sort(values)
    n = len(own)
    return float(own[-1] if np.isnan(own[-1]) else own[n // 2] if n % 2 else (own[n // 2 - 1] + own[n // 2]) / 2)


def curve_events(times: np.ndarray, values: np.ndarray, k: float, min_dur: float, gap: float) -> list[tuple[float, float, float]]:
    """(onset, offset, score) from a salience curve: the same steps as operators.islands.salience_events."""
    if not len(times):
        return []
    med = median(values)
    spread = median(np.abs(values - med)) or float(values.std()) or 1e-9
    over = values - (med + k * spread)
    dt = max(median(times[1:] - times[:-1]), 0.0) if len(times) > 1 else 0.0
    inside = np.zeros(len(over) + 2, bool)
    np.greater_equal(over, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).tolist()
    runs = [(max(0.0, float(times[a]) - dt / 2), float(times[b - 1]) + dt / 2, float(over[a:b].sum()) * (dt or 1.0)) for a, b in edges]
    return [(a, b, max(area, 1e-12)) for a, b, area in stitch(runs, gap, min_dur, np.add)]
