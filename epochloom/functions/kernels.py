"""Numeric kernels over blocks of equally long signals (rows x samples), for Arrow batches."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable

import numpy as np

#: Fixed: frequency bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "sigma": (12.0, 16.0), "beta": (16.0, 30.0), "gamma": (30.0, 40.0)}


def welch(x: np.ndarray, frequency: float, seconds: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density by averaging half-overlapping Hann windows of mean-free segments."""
    n = min(int(round(seconds * frequency)), x.shape[1])
    if n < 2:
        return np.zeros(0), np.zeros((len(x), 0))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, x.shape[1] - n + 1, max(n - n // 2, 1))
    power = 0.0
    for s in starts:
        seg = x[:, s : s + n]
        power = power + np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    power = power / len(starts) / (frequency * (window**2).sum())
    power[:, 1 : (None if n % 2 else -1)] *= 2
    return np.fft.rfftfreq(n, 1 / frequency), power


def _area(y: np.ndarray, dx: float) -> np.ndarray:
    return ((y[:, 1:] + y[:, :-1]) / 2).sum(axis=1) * dx if y.shape[1] > 1 else np.zeros(len(y))


def band_powers(f: np.ndarray, power: np.ndarray, bands: dict[str, tuple[float, float]] = BANDS, relative: bool = True) -> dict[str, np.ndarray]:
    """Power per band by the trapezoid rule, over the whole range of the bands if relative."""
    low, high = min(b[0] for b in bands.values()), max(b[1] for b in bands.values())
    dx = f[1] - f[0] if len(f) > 1 else 1.0
    whole = _area(power[:, (f >= low) & (f <= high)], dx)
    out = {}
    for name, (a, b) in bands.items():
        area = _area(power[:, (f >= a) & (f <= b)], dx)
        out[name] = np.divide(area, whole, out=np.full(len(area), np.nan), where=whole > 0) if relative else area
    return out


def smooth_polynomial(y: np.ndarray, width: int = 5, degree: int = 2) -> np.ndarray:
    """Local least-squares polynomial smoothing along the last axis; the ends use the outermost fits."""
    half = width // 2
    if y.shape[-1] < width:
        return y
    at = np.arange(-half, half + 1)
    hat = np.vander(at, degree + 1, increasing=True) @ np.linalg.pinv(np.vander(at, degree + 1, increasing=True))
    w = np.lib.stride_tricks.sliding_window_view(y, width, axis=-1)
    return np.concatenate((w[..., 0, :] @ hat[:half].T, w @ hat[half], w[..., -1, :] @ hat[half + 1 :].T), axis=-1)


def aperiodic(f: np.ndarray, power: np.ndarray, low: float = 1.0, high: float = 45.0) -> dict[str, np.ndarray]:
    """Offset and exponent of a power law in log-log space, with r2 and mean absolute error.

    A first fit shows the peaks; frequencies in the upper part of its residuals are left out of the
    second. Signals without positive power in the range give NaN.
    """
    keep = (f >= low) & (f <= high)
    n = len(power)
    out = {k: np.full(n, np.nan) for k in ("offset", "exponent", "r2", "error")}
    x = np.log10(f[keep]) if keep.sum() > 3 else None
    for i in range(n):
        p = power[i, keep]
        if x is None or not (np.isfinite(p).all() and (p > 0).all()):
            continue
        y = smooth_polynomial(np.log10(p))
        slope, offset = np.polyfit(x, y, 1)
        residual = y - (offset + slope * x)
        base = residual <= np.quantile(residual, 0.75)
        if base.sum() > 2:
            slope, offset = np.polyfit(x[base], y[base], 1)
        model = offset + slope * x
        spread = ((y - y.mean()) ** 2).sum()
        out["offset"][i], out["exponent"][i] = offset, -slope
        out["r2"][i] = 1 - ((y - model) ** 2).sum() / spread if spread > 0 else np.nan
        out["error"][i] = np.abs(y - model).mean()
    return out


def moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """std (ddof 1), IQR, skewness and excess kurtosis (population forms)."""
    c = x - x.mean(axis=1, keepdims=True)
    m2, m3, m4 = ((c**k).mean(axis=1) for k in (2, 3, 4))
    q1, q3 = np.percentile(x, [25, 75], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"std": x.std(axis=1, ddof=1) if x.shape[1] > 1 else np.full(len(x), np.nan), "iqr": q3 - q1, "skew": np.where(m2 > 0, m3 / m2**1.5, np.nan), "kurt": np.where(m2 > 0, m4 / m2**2 - 3, np.nan)}


def hjorth(x: np.ndarray) -> dict[str, np.ndarray]:
    """Mobility and complexity from the variances of the signal and its first two differences."""
    d1, d2 = np.diff(x, axis=1), np.diff(x, 2, axis=1)
    v0, v1, v2 = x.var(axis=1), d1.var(axis=1), d2.var(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mobility = np.where(v0 > 0, np.sqrt(v1 / v0), np.nan)
        return {"mobility": mobility, "complexity": np.where((v0 > 0) & (v1 > 0), np.sqrt(v2 / v1) / mobility, np.nan)}


def zero_crossings(x: np.ndarray) -> np.ndarray:
    return (np.diff(np.signbit(x).astype(np.int8), axis=1) != 0).sum(axis=1)


def permutation_entropy(x: np.ndarray, order: int = 3) -> np.ndarray:
    """Normalised entropy of the orders of ``order`` successive samples."""
    w = np.lib.stride_tricks.sliding_window_view(x, order, axis=1)
    code = np.argsort(w, axis=2, kind="stable") @ (order ** np.arange(order))
    out = np.empty(len(x))
    for i, row in enumerate(code):
        p = np.unique(row, return_counts=True)[1] / len(row)
        out[i] = -(p * np.log2(p)).sum() / math.log2(math.factorial(order))
    return out


def higuchi(x: np.ndarray, k_max: int = 10) -> np.ndarray:
    """Fractal dimension from curve lengths at strides 1..k_max."""
    n = x.shape[1]
    ks = np.arange(1, min(k_max, n // 2) + 1)
    lengths = np.empty((len(ks), len(x)))
    for j, k in enumerate(ks):
        per_start = []
        for m in range(k):
            steps = (n - 1 - m) // k
            if steps:
                per_start.append(np.abs(np.diff(x[:, m :: k][:, : steps + 1], axis=1)).sum(axis=1) * (n - 1) / (steps * k) / k)
        lengths[j] = np.mean(per_start, axis=0)
    with np.errstate(divide="ignore"):
        logs = np.log(lengths)
    good = np.isfinite(logs).all(axis=0)
    out = np.full(len(x), np.nan)
    if good.any():
        out[good] = np.polyfit(np.log(1.0 / ks), logs[:, good], 1)[0]
    return out


def petrosian(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    turns = (np.diff(np.signbit(np.diff(x, axis=1)).astype(np.int8), axis=1) != 0).sum(axis=1)
    return math.log10(n) / (math.log10(n) + np.log10(n / (n + 0.4 * turns)))


#: Fixed: bands of the staging features in Hz.
STAGING_BANDS = {"sdelta": (0.4, 1.0), "fdelta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "sigma": (12.0, 16.0), "beta": (16.0, 30.0)}


def staging_features(x: np.ndarray, frequency: float, seconds: float = 5.0) -> dict[str, np.ndarray]:
    """The 21 base features of an epoch: moments, shape, band shares, ratios, absolute power, complexity."""
    f, power = welch(x, frequency, seconds)
    share = band_powers(f, power, STAGING_BANDS)
    dx = f[1] - f[0] if len(f) > 1 else 1.0
    wide = (f >= 0.4) & (f <= 30.0)
    delta = share["sdelta"] + share["fdelta"]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = {"dt": delta / share["theta"], "ds": delta / share["sigma"], "db": delta / share["beta"], "at": share["alpha"] / share["theta"]}
    h = hjorth(x)
    return moments(x) | {"nzc": zero_crossings(x).astype(float), "hmob": h["mobility"], "hcomp": h["complexity"]} | share | ratios | {"abspow": _area(power[:, wide], dx), "perm": permutation_entropy(x), "higuchi": higuchi(x), "petrosian": petrosian(x)}


def autocorrelation(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    c = x - x.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(c, size, axis=1)) ** 2, size, axis=1)[:, :n]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(r[:, :1] > 0, r / r[:, :1], np.nan)


def _first(flags: np.ndarray) -> np.ndarray:
    if not flags.shape[1]:
        return np.zeros(len(flags))
    return np.where(flags.any(axis=1), flags.argmax(axis=1), flags.shape[1]).astype(float)


def series_features(x: np.ndarray) -> dict[str, np.ndarray]:
    """The 22 canonical time-series features (catch22) of z-scored signals, one number per signal each.

    Thresholds, lags and outputs are the published ones. Every signal has its own lags, so its numbers don't
    depend on the other rows. ``dfa`` and ``rs_range`` are scaling exponents over ten window sizes; the
    published outputs of these two, the share of scales in the first of two linear regimes, are
    ``dfa_prop`` and ``rs_range_prop``. Signals without spread give NaN, as do features that a signal is
    too short for.
    """
    n = x.shape[1]
    sd = x.std(axis=1, ddof=1, keepdims=True)
    ok = np.isfinite(x).all(axis=1) & (x.max(axis=1) > x.min(axis=1)) & (sd[:, 0] > 0)
    z = np.divide(x - x.mean(axis=1, keepdims=True), sd, out=np.zeros(x.shape), where=ok[:, None])
    out: dict[str, np.ndarray] = {}
    for bins in (5, 10):
        lo, width = z.min(axis=1), (z.max(axis=1) - z.min(axis=1)) / bins
        code = np.clip(np.divide(z - lo[:, None], width[:, None], out=np.zeros_like(z), where=width[:, None] > 0).astype(int), 0, bins - 1)
        counts = np.stack([(code == b).sum(axis=1) for b in range(bins)], axis=1)
        top = counts == counts.max(axis=1, keepdims=True)
        out[f"mode_{bins}"] = lo + width * ((top * (np.arange(bins) + 0.5)).sum(axis=1) / top.sum(axis=1))
    r = np.nan_to_num(autocorrelation(z))
    first_zero = _first(r <= 0).astype(int)
    below = r[:, : n - 1] < 1 / math.e
    k = below.argmax(axis=1).clip(1)
    rows = np.arange(len(z))
    a, b = r[rows, k - 1], r[rows, k]
    out["acf_timescale"] = np.where(below.any(axis=1), k - 1 + (a - 1 / math.e) / np.where(a > b, a - b, 1), n)
    dip = (r[:, 1:-1] < r[:, :-2]) & (r[:, 1:-1] < r[:, 2:])
    out["acf_first_min"] = np.where(dip.any(axis=1), _first(dip) + 1, n)
    out["low_freq_power"], out["centroid_freq"] = _spectrum_shape(z)
    d = np.diff(z, axis=1)
    out["reversibility"] = (d**3).mean(axis=1)
    out["high_fluctuation"] = (np.abs(d) * 1000 > 40).mean(axis=1)
    out["stretch_high"] = _stretch(z[:, :-1] - z.mean(axis=1, keepdims=True) > 0)
    out["stretch_decreasing"] = _stretch(d < 0)
    nothing = np.full(len(z), np.nan)
    out["forecast_error"] = (z[:, 3:] - np.lib.stride_tricks.sliding_window_view(z, 3, axis=1)[:, :-1].mean(axis=2)).std(axis=1, ddof=1) if n > 4 else nothing
    out["whiten_timescale"] = _first(np.nan_to_num(autocorrelation(d), nan=-1.0) <= 0) / np.where(first_zero > 0, first_zero, 1)
    for name, s in (("outlier_timing_pos", 1), ("outlier_timing_neg", -1)):
        out[name] = _extreme_timing(s * z)
    third = _thirds(z)
    out["motif_entropy"] = _code_entropy(third[:, :-1] * 3 + third[:, 1:], 9)
    out["transition_variance"] = _by_lag(z, first_zero, _transition_variance)
    out["embedding_dist"] = _by_lag(z, np.where(first_zero > n / 10, n // 10, first_zero), _embedding_distance)
    out["ami2"] = _histogram_information(z, 2) if n > 2 else nothing
    out["ami_timescale"] = _information_minimum(z)
    out["dfa"], out["rs_range"] = _fluctuation(z, True), _fluctuation(z, False)
    out["dfa_prop"], out["rs_range_prop"] = _first_regime(z, 2, True), _first_regime(z, 1, False)
    out["periodicity"] = _periodicity(z)
    return {name: np.where(ok, v, np.nan) for name, v in out.items()}


def _by_lag(z: np.ndarray, lags: np.ndarray, f: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """``f`` of the rows of each lag together."""
    out = np.full(len(z), np.nan)
    for lag in np.unique(lags):
        out[lags == lag] = f(z[lags == lag], int(lag))
    return out


def _stretch(flags: np.ndarray) -> np.ndarray:
    """Longest way from one False, or the first place, to the next False or the last place."""
    n = flags.shape[1]
    best, since = np.zeros(len(flags), int), np.zeros(len(flags), int)
    for i in range(n):
        stop = ~flags[:, i] | (i == n - 1)
        best = np.where(stop, np.maximum(best, i - since), best)
        since = np.where(stop, i, since)
    return best.astype(float)


def _thirds(z: np.ndarray) -> np.ndarray:
    """0, 1 or 2 by the row's own tertiles."""
    low, high = np.quantile(z, [1 / 3, 2 / 3], axis=1, method="hazen")
    return (z > low[:, None]).astype(int) + (z > high[:, None])


def _spectrum_shape(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Power in the lowest fifth of the frequencies, and the angular frequency that halves the power."""
    n = z.shape[1]
    size = 1 << (n - 1).bit_length()
    p = np.abs(np.fft.rfft(z - z.mean(axis=1, keepdims=True), size, axis=1)) ** 2 / n
    p[:, 1:-1] *= 2
    total = np.cumsum(p, axis=1)
    return p[:, : p.shape[1] // 5].sum(axis=1) / size, 2 * math.pi / size * (total > total[:, -1:] / 2).argmax(axis=1)


def _extreme_timing(z: np.ndarray) -> np.ndarray:
    """Median over thresholds 0, 0.01, ... of the median place, in (-1, 1], of the samples that reach them.

    Thresholds go on to the maximum, but end where 2 % of the samples that aren't negative, or a single one, are left.
    """
    n = z.shape[1]
    out = np.zeros(len(z))
    for i, row in enumerate(z):
        order = np.argsort(-row, kind="stable")
        values = row[order]
        if not values[0] >= 0.01:
            continue
        reach = n - np.searchsorted(values[::-1], np.arange(int(values[0] / 0.01 + 1)) * 0.01, "left")
        reach = reach[reach > 0]
        enough, single = np.flatnonzero((reach - 1) * 100.0 / reach[0] > 2), np.flatnonzero(reach == 1)
        last = min(enough[-1] if len(enough) else 0, single[0] if len(single) else len(reach) - 1)
        places: list[int] = []
        middle = np.empty(reach[0] + 1)
        for count, place in enumerate(order[: reach[0]].tolist(), 1):
            insort(places, place + 1)
            middle[count] = (places[count // 2] + places[(count - 1) // 2]) / 2
        out[i] = np.median(middle[reach[: last + 1]] / (n / 2) - 1)
    return out


def _code_entropy(code: np.ndarray, size: int) -> np.ndarray:
    out = np.empty(len(code))
    for i, row in enumerate(code):
        p = np.bincount(row, minlength=size) / max(len(row), 1)
        p = p[p > 0]
        out[i] = -(p * np.log(p)).sum()
    return out


def _transition_variance(z: np.ndarray, lag: int) -> np.ndarray:
    """Summed variances of the columns of the transition matrix between tertiles of every ``lag``-th sample."""
    if lag < 1 or lag >= z.shape[1]:
        return np.full(len(z), np.nan)
    third = _thirds(z[:, ::lag])
    joint = np.stack([np.bincount(t[:-1] * 3 + t[1:], minlength=9).reshape(3, 3) / (third.shape[1] - 1) for t in third])
    return joint.var(axis=1, ddof=1).sum(axis=1)


def _embedding_distance(z: np.ndarray, lag: int) -> np.ndarray:
    """Mean difference between the histogram of steps in the plane (z, z ``lag`` later) and an exponential law."""
    step = np.diff(z, axis=1)
    step = np.hypot(step[:, : step.shape[1] - lag], step[:, lag:])
    m = step.shape[1]
    out = np.full(len(z), np.nan)
    if m < 2:
        return out
    for i, row in enumerate(step):
        mean, sd, low, high = row.mean(), row.std(ddof=1), row.min(), row.max()
        bins = math.ceil((high - low) / (3.5 * sd / m ** (1 / 3))) if sd >= 0.001 else 0
        if not bins:
            out[i] = 0.0
            continue
        width = (high - low) / bins
        counts = np.bincount(np.clip((row - low) / width, 0, bins - 1).astype(int), minlength=bins)
        out[i] = np.abs(counts / m - np.exp(-(low + width * (np.arange(bins) + 0.5)) / mean) / mean).mean()
    return out


def _histogram_information(z: np.ndarray, lag: int, bins: int = 5) -> np.ndarray:
    """Information between a series and itself ``lag`` later, from a histogram of even bins with a margin of 0.1."""
    low = z.min(axis=1, keepdims=True) - 0.1
    width = (z.max(axis=1, keepdims=True) + 0.1 - low) / bins
    code = np.clip(np.floor((z - low) / width).astype(int), 0, bins - 1)
    pair = code[:, :-lag] * bins + code[:, lag:]
    joint = np.array([np.bincount(row, minlength=bins**2) for row in pair]).reshape(len(z), bins, bins) / pair.shape[1]
    apart = joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)
    ratio = np.divide(joint, apart, out=np.ones_like(joint), where=joint > 0)
    return (joint * np.log(ratio)).sum(axis=(1, 2))


def _lagged_information(z: np.ndarray, lag: int) -> np.ndarray:
    """Information between a series and itself ``lag`` later, if both were jointly normal."""
    a, b = z[:, :-lag], z[:, lag:]
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    norm = np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1))
    c = np.divide((a * b).sum(axis=1), norm, out=np.zeros(len(z)), where=norm > 0)
    return -0.5 * np.log(np.clip(1 - c**2, 1e-300, None))


def _information_minimum(z: np.ndarray) -> np.ndarray:
    """Place (from 0, of lag 1) of the first minimum of lagged information up to lag 40 or half the length; the number of lags if none."""
    most = min(40, -(-z.shape[1] // 2))
    if most < 3:
        return np.full(len(z), float(most))
    v = np.stack([_lagged_information(z, lag) for lag in range(1, most + 1)], axis=1)
    dip = (v[:, 1:-1] < v[:, :-2]) & (v[:, 1:-1] < v[:, 2:])
    return np.where(dip.any(axis=1), dip.argmax(axis=1) + 1, most).astype(float)


def _fluctuation(z: np.ndarray, detrend: bool) -> np.ndarray:
    """Scaling exponent of the cumulated signal's fluctuation over window sizes."""
    y = np.cumsum(z, axis=1)
    n = z.shape[1]
    sizes = np.unique(np.logspace(math.log10(5), math.log10(max(n // 2, 6)), 10).astype(int))
    sizes = sizes[sizes <= n]
    if len(sizes) < 2:
        return np.full(len(z), np.nan)
    logs = []
    for s in sizes:
        rest = _detrended(y, s)
        f = np.sqrt((rest**2).mean(axis=(1, 2))) if detrend else (rest.max(axis=2) - rest.min(axis=2)).mean(axis=1)
        logs.append(np.log(np.maximum(f, 1e-300)))
    t, v = np.log(sizes) - np.log(sizes).mean(), np.stack(logs, axis=1)
    return ((v - v.mean(axis=1, keepdims=True)) * t).sum(axis=1) / (t**2).sum()


def _detrended(y: np.ndarray, size: int) -> np.ndarray:
    """Whole windows of ``size`` samples (rows x windows x samples) without their straight lines."""
    w = y[:, : y.shape[1] // size * size].reshape(len(y), y.shape[1] // size, size)
    t = np.arange(size) - (size - 1) / 2
    slope = (w * t).sum(axis=2, keepdims=True) / (t**2).sum()
    return w - w.mean(axis=2, keepdims=True) - slope * t


def _first_regime(z: np.ndarray, lag: int, detrend: bool, steps: int = 50, least: int = 6) -> np.ndarray:
    """Share of window sizes in the first of the two straight lines that fit log fluctuation best; 0 under 12 sizes."""
    n = z.shape[1]
    if n < 10:
        return np.zeros(len(z))
    sizes = np.unique(np.floor(np.exp(np.linspace(math.log(5), math.log(n // 2), steps)) + 0.5).astype(int))
    count = len(sizes)
    if count < 2 * least:
        return np.zeros(len(z))
    y = np.cumsum(z[:, ::lag][:, : n // lag], axis=1)
    logs = np.empty((len(z), count))
    for i, s in enumerate(sizes):
        rest = _detrended(y, int(s))
        f = (rest**2).mean(axis=(1, 2)) if detrend else ((rest.max(axis=2) - rest.min(axis=2)) ** 2).mean(axis=1)
        logs[:, i] = np.log(np.maximum(f, 1e-300)) / 2
    at = np.log(sizes)

    def misfit(part: slice) -> np.ndarray:
        t, v = at[part] - at[part].mean(), logs[:, part] - logs[:, part].mean(axis=1, keepdims=True)
        return np.sqrt(((v - (v * t).sum(axis=1, keepdims=True) / (t**2).sum() * t) ** 2).sum(axis=1))

    wrong = np.stack([misfit(slice(0, i)) + misfit(slice(i - 1, count)) for i in range(least, count - least + 1)], axis=1)
    return (wrong.argmin(axis=1) + least) / count


def _periodicity(z: np.ndarray) -> np.ndarray:
    """Place (from 0, of lag 1) of the first positive peak of the autocovariance that is 0.01 above the trough before it.

    The trend, a cubic spline of two pieces, is taken off first; lags go up to a third of the length. 0 if no peak.
    """
    n = z.shape[1]
    t = np.linspace(0, 1, n)
    knot = t[max(n // 2 - 1, 0)]
    basis = np.linalg.qr(np.stack([np.ones(n), t, t**2, t**3, np.maximum(t - knot, 0) ** 3], axis=1))[0]
    rest = z.copy()
    for column in basis.T:
        rest -= (rest * column).sum(axis=1, keepdims=True) * column
    most = -(-n // 3)
    cov = np.stack([(rest[:, : n - lag] * rest[:, lag:]).mean(axis=1) for lag in range(1, most + 1)], axis=1)
    slope = np.diff(cov, axis=1)
    out, trough = np.zeros(len(z)), np.full(len(z), np.nan)
    for i in range(1, most - 1):
        trough = np.where((slope[:, i - 1] < 0) & (slope[:, i] > 0), cov[:, i], trough)
        peak = (slope[:, i - 1] > 0) & (slope[:, i] < 0) & (cov[:, i] - trough >= 0.01) & (cov[:, i] >= 0)
        out = np.where(peak & (out == 0), i, out)
    return out


def bandpass(x: np.ndarray, frequency: float, low: float | None, high: float | None) -> np.ndarray:
    """Zero-phase filter in the frequency domain with raised-cosine edges of a tenth of the cut-off."""
    f = np.fft.rfftfreq(x.shape[1], 1 / frequency)
    gain = np.ones(len(f))
    if low:
        gain *= 0.5 - 0.5 * np.cos(np.pi * np.clip((f - 0.9 * low) / (0.1 * low), 0, 1))
    if high:
        gain *= 0.5 + 0.5 * np.cos(np.pi * np.clip((f - high) / (0.1 * high), 0, 1))
    return np.fft.irfft(np.fft.rfft(x, axis=1) * gain, x.shape[1], axis=1)


def resample_standardize(x: np.ndarray, source: float, target: float, samples: int | None = None) -> np.ndarray:
    """Linear interpolation to another rate (low-passed first when going down), mean 0 and spread 1.

    Signals without spread are only centred.
    """
    n = samples or int(round(x.shape[1] * target / source))
    if target < source:
        x = bandpass(x, source, None, 0.45 * target)
    if n != x.shape[1] or target != source:
        at = np.arange(n) / target
        x = np.stack([np.interp(at, np.arange(x.shape[1]) / source, row) for row in x]) if len(x) else x[:, :0]
    x = x - x.mean(axis=1, keepdims=True)
    sd = x.std(axis=1, keepdims=True)
    return np.divide(x, sd, out=x.copy(), where=sd > 0)
