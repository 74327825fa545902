"""Problem 6: irregular readings onto a regular grid, by a Kalman smoother in continuous time.

Model per source: a level with a slope (local linear trend) that drifts in continuous time, seen with
noise. A forward filter and a backward smoother run over readings and grid times together, so every
cell gets a value and its standard deviation whether it has readings or not. Work is partitioned by
(source, span of time), so a source may be of any length. Spans give what one piece would give: each
is first condensed into what its readings say about the states at its two ends, one row; these rows
are passed along the source in both directions, and each span is smoothed between the state before
it and the information after it. So a gap is filled from both of its sides however many spans it crosses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_CELLS = 360
#: Drift of level and slope per second, relative to the noise variance of the readings.
LEVEL_DRIFT, SLOPE_DRIFT = 0.02, 1e-5
#: Before the first reading: level, slope and their covariance (11, 12, 22), about the source's centre.
_UNKNOWN = (0.0, 0.0, 1e4, 0.0, 1e-4)
_BATCH_POINTS = 400_000


def _drift(h):
    """Covariance (11, 12, 22) that the drift of level and slope adds over ``h`` seconds."""
    return LEVEL_DRIFT * h + SLOPE_DRIFT * h**3 / 3, SLOPE_DRIFT * h * h / 2, SLOPE_DRIFT * h


def smooth(t: np.ndarray, y: np.ndarray, seen: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its variance at every time, for many series in lockstep.

    ``t``, ``y``, ``seen`` are (series, points), times ascending within a series; unseen points carry
    no reading. Units of y: noise variance 1. ``before`` (series, 6) has a time with the state there, given
    all earlier readings: time, level, slope, their covariance (11, 12, 22); without it, level and slope
    are unknown at the first time. ``after`` (series, 5) is what all readings after the last time say about
    the state there: information vector and matrix (11, 12, 22).
    """
    b, n = t.shape
    dt = np.diff(t, axis=1, prepend=t[:, :1] if before is None else before[:, :1])
    fl, fs = np.empty((n, b)), np.empty((n, b))  # filtered level, slope
    p11, p12, p22 = (np.empty((n, b)) for _ in range(3))
    q11, q12, q22 = (np.empty((n, b)) for _ in range(3))  # predicted covariance
    level, slope, a11, a12, a22 = (np.full(b, v) for v in _UNKNOWN) if before is None else before[:, 1:].T
    for k in range(n):
        h = dt[:, k]
        d11, d12, d22 = _drift(h)
        level = level + h * slope
        a11 = a11 + 2 * h * a12 + h * h * a22 + d11
        a12 = a12 + h * a22 + d12
        a22 = a22 + d22
        q11[k], q12[k], q22[k] = a11, a12, a22
        s = a11 + 1
        g1, g2 = np.where(seen[:, k], a11 / s, 0.0), np.where(seen[:, k], a12 / s, 0.0)
        e = np.where(seen[:, k], y[:, k] - level, 0.0)
        level, slope = level + g1 * e, slope + g2 * e
        a11, a12, a22 = a11 - g1 * a11, a12 - g1 * a12, a22 - g2 * a12
        fl[k], fs[k], p11[k], p12[k], p22[k] = level, slope, a11, a12, a22
    out, var = np.empty((b, n)), np.empty((b, n))
    sl, ss, s11, s12, s22 = fl[-1], fs[-1], p11[-1], p12[-1], p22[-1]
    if after is not None:
        sl, ss, s11, s12, s22 = _informed(sl, ss, s11, s12, s22, *after.T)
    out[:, -1], var[:, -1] = sl, s11
    for k in range(n - 2, -1, -1):
        h = dt[:, k + 1]
        # P F' and the inverse of the predicted covariance
        c11, c12, c21, c22 = p11[k] + h * p12[k], p12[k], p12[k] + h * p22[k], p22[k]
        r11, r12, r22 = q11[k + 1], q12[k + 1], q22[k + 1]
        det = np.maximum(r11 * r22 - r12 * r12, 1e-300)
        j11, j12 = (c11 * r22 - c12 * r12) / det, (c12 * r11 - c11 * r12) / det
        j21, j22 = (c21 * r22 - c22 * r12) / det, (c22 * r11 - c21 * r12) / det
        dl, ds = sl - (fl[k] + h * fs[k]), ss - fs[k]
        m11, m12, m22 = s11 - r11, s12 - r12, s22 - r22
        sl, ss = fl[k] + j11 * dl + j12 * ds, fs[k] + j21 * dl + j22 * ds
        u11, u12 = j11 * m11 + j12 * m12, j11 * m12 + j12 * m22
        u21, u22 = j21 * m11 + j22 * m12, j21 * m12 + j22 * m22
        s11, s12, s22 = p11[k] + u11 * j11 + u12 * j12, p12[k] + u11 * j21 + u12 * j22, p22[k] + u21 * j21 + u22 * j22
        out[:, k], var[:, k] = sl, s11
    return out, np.maximum(var, 0.0)


def _informed(level, slope, p11, p12, p22, e1, e2, j11, j12, j22):
    """The state once information (vector, matrix) about it is added: (I + PJ)^-1 (m + Pe), (I + PJ)^-1 P."""
    m11, m12, m21, m22 = 1 + p11 * j11 + p12 * j12, p11 * j12 + p12 * j22, p12 * j11 + p22 * j12, 1 + p12 * j12 + p22 * j22
    det = m11 * m22 - m12 * m21
    a, b = level + p11 * e1 + p12 * e2, slope + p12 * e1 + p22 * e2
    return (m22 * a - m12 * b) / det, (m11 * b - m21 * a) / det, (m22 * p11 - m12 * p12) / det, (m22 * p12 - m12 * p22) / det, (m11 * p22 - m21 * p12) / det


#: What the readings of a span say: the end state is A x + b with covariance C for the start state x, of
#: which they give information e, J.
_CONDENSED = ("a11", "a12", "a21", "a22", "b1", "b2", "c11", "c12", "c22", "e1", "e2", "j11", "j12", "j22")


def condense(t: np.ndarray, y: np.ndarray, seen: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Columns _CONDENSED of many series in lockstep, from the time ``start`` to the time ``end`` of each."""
    b, n = t.shape
    a11, a12, a21, a22 = np.ones(b), np.zeros(b), np.zeros(b), np.ones(b)
    b1, b2, c11, c12, c22, e1, e2, j11, j12, j22 = np.zeros((10, b))
    times = np.concatenate((start[:, None], t, end[:, None]), axis=1)
    for k in range(n + 1):
        h = times[:, k + 1] - times[:, k]
        d11, d12, d22 = _drift(h)
        a11, a12, b1 = a11 + h * a21, a12 + h * a22, b1 + h * b2
        c11, c12, c22 = c11 + 2 * h * c12 + h * h * c22 + d11, c12 + h * c22 + d12, c22 + d22
        if k == n:
            break
        w = np.where(seen[:, k], 1 / (c11 + 1), 0.0)
        r = np.where(seen[:, k], y[:, k] - b1, 0.0)
        e1, e2 = e1 + a11 * r * w, e2 + a12 * r * w
        j11, j12, j22 = j11 + a11 * a11 * w, j12 + a11 * a12 * w, j22 + a12 * a12 * w
        g1, g2 = c11 * w, c12 * w
        a21, a22, b2 = a21 - g2 * a11, a22 - g2 * a12, b2 + g2 * r
        a11, a12, b1 = a11 - g1 * a11, a12 - g1 * a12, b1 + g1 * r
        c11, c12, c22 = c11 - g1 * c11, c12 - g1 * c12, c22 - g2 * c12
    return np.stack([a11, a12, a21, a22, b1, b2, c11, c12, c22, e1, e2, j11, j12, j22], axis=1)


def _scale(finite: np.ndarray) -> tuple[float, float]:
    """Centre and noise scale of a span: the median, and the robust spread of successive changes."""
    if not len(finite):
        return 0.0, float("nan")
    steps = np.abs(np.diff(finite))
    return float(np.median(finite)), float(np.median(steps)) / 0.6745 / np.sqrt(2) if len(steps) else float("nan")


def _middle(values: np.ndarray, weights: np.ndarray) -> float:
    """Weighted median; between two values where the weights are halved."""
    order = np.argsort(values, kind="stable")
    values, total = values[order], np.cumsum(weights[order])
    return float((values[np.searchsorted(total, total[-1] / 2)] + values[min(np.searchsorted(total, total[-1] / 2, "right"), len(values) - 1)]) / 2)


def _fresh(times: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repetitions: the same reading twice is one."""
    fresh = np.ones(len(times), bool)
    fresh[1:] = (times[1:] != times[:-1]) | (values[1:] != values[:-1])
    return times[fresh], values[fresh]


def _alike(spans: list[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """Spans of like length share a block, so that padding stays small."""
    spans.sort(key=size)
    at = 0
    while at < len(spans):
        upto = at
        while upto < len(spans) and size(spans[upto]) <= size(spans[at]) * 1.25 + 8:
            upto += 1
        yield spans[at:upto]
        at = upto


def _by_span(span: Callable[..., tuple | None], finish: Callable[[list[tuple]], Iterator[pa.RecordBatch]], size: Callable[[tuple], int]) -> Callable:
    """Sorted rows through ``span`` per (key, span), given the table's part, and ``finish`` per many of its results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        points = 0
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, complete: bool) -> tuple[list[tuple], pa.Table | None]:
            keys = table.column("key").combine_chunks().dictionary_encode()
            codes, spans = keys.indices.to_numpy(), table.column("span").to_numpy()
            change = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (spans[1:] != spans[:-1]))))
            ends = np.append(change[1:], len(codes))
            if not complete:
                change, ends, kept = change[:-1], ends[:-1], table.slice(int(change[-1]))
            else:
                kept = None
            names = keys.dictionary.to_pylist()
            return [g for f, e in zip(change, ends, strict=True) if (g := span(names[codes[f]], int(spans[f]), table.slice(int(f), int(e - f)))) is not None], kept

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            done, kept = groups(pa.Table.from_batches(held), False)
            held = kept.combine_chunks().to_batches()
            waiting += done
            points += sum(size(g) for g in done)
            if points > _BATCH_POINTS:
                yield from finish(waiting)
                waiting, points = [], 0
        if held:
            waiting += groups(pa.Table.from_batches(held), True)[0]
        if waiting:
            yield from finish(waiting)

    return run


_SPAN_FIELDS = ("start", "first", "last", "readings", "centre", "scale", "low", "high", *_CONDENSED)
_SPAN_SCHEMA = ", ".join(["key string", "span long", *[f"{c} double" for c in _SPAN_FIELDS]])


def _condensed(cell: float, span_cells: int) -> Callable:
    """One row per span with readings: first time, first and last cell, scale, and what its readings say in terms of its own centre."""
    schema = pa.schema([("key", pa.string()), ("span", pa.int64()), *[(c, pa.float64()) for c in _SPAN_FIELDS]])

    def span(key: str, number: int, rows: pa.Table) -> tuple:
        times, values = _fresh(rows.column("a").to_numpy(), rows.column("b").to_numpy())
        first, last = np.floor(times[0] / cell), np.floor(times[-1] / cell)
        start = min(times[0], (first + 0.5) * cell)
        good = np.isfinite(values)
        finite = values[good]
        centre, scale = _scale(finite)
        facts = (start, first, last, float(len(finite)), centre, scale, finite.min() if len(finite) else np.nan, finite.max() if len(finite) else np.nan)
        return key, number, facts, times[good], finite - centre

    def finish(spans: list[tuple]) -> Iterator[pa.RecordBatch]:
        for block in _alike(spans, lambda s: len(s[3])):
            n = max(len(s[3]) for s in block)
            start = np.array([s[2][0] for s in block], float)
            end = np.array([(s[1] + 1) * span_cells * cell for s in block], float)
            t, y, seen = np.repeat(end[:, None], n, axis=1), np.zeros((len(block), n)), np.zeros((len(block), n), bool)
            for i, (_, _, _, times, values) in enumerate(block):
                t[i, : len(times)], y[i, : len(times)], seen[i, : len(times)] = times, values, True
            facts = np.concatenate((np.array([s[2] for s in block], float), condense(t, y, seen, start, end)), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in block]), pa.array([s[1] for s in block], pa.int64()), *[pa.array(c) for c in facts.T]], schema=schema)

    return _by_span(span, finish, lambda s: len(s[3]))


def _onward(state: tuple, c: tuple) -> tuple:
    """The state after a condensed stretch from the one before it."""
    a11, a12, a21, a22, b1, b2, c11, c12, c22, *told = c
    level, slope, p11, p12, p22 = _informed(*state, *told)
    u11, u12, u21, u22 = a11 * p11 + a12 * p12, a11 * p12 + a12 * p22, a21 * p11 + a22 * p12, a21 * p12 + a22 * p22
    return a11 * level + a12 * slope + b1, a21 * level + a22 * slope + b2, u11 * a11 + u12 * a12 + c11, u11 * a21 + u12 * a22 + c12, u21 * a21 + u22 * a22 + c22


def _backward(later: tuple, c: tuple) -> tuple:
    """What a condensed stretch and all readings after it say about the state before it."""
    a11, a12, a21, a22, b1, b2, c11, c12, c22, e1, e2, j11, j12, j22 = c
    f1, f2, i11, i12, i22 = later
    m11, m12, m21, m22 = 1 + i11 * c11 + i12 * c12, i11 * c12 + i12 * c22, i12 * c11 + i22 * c12, 1 + i12 * c12 + i22 * c22
    det = m11 * m22 - m12 * m21
    k11, k12, k22 = (m22 * i11 - m12 * i12) / det, (m22 * i12 - m12 * i22) / det, (m11 * i22 - m21 * i12) / det
    u1, u2 = f1 - i11 * b1 - i12 * b2, f2 - i12 * b1 - i22 * b2
    v1, v2 = (m22 * u1 - m12 * u2) / det, (m11 * u2 - m21 * u1) / det
    return (
        e1 + a11 * v1 + a21 * v2, e2 + a12 * v1 + a22 * v2,
        j11 + a11 * (k11 * a11 + k12 * a21) + a21 * (k12 * a11 + k22 * a21), j12 + a11 * (k11 * a12 + k12 * a22) + a21 * (k12 * a12 + k22 * a22), j22 + a12 * (k11 * a12 + k12 * a22) + a22 * (k12 * a12 + k22 * a22),
    )


def _still(h: float) -> tuple:
    """A condensed stretch of ``h`` seconds without readings."""
    return 1.0, h, 0.0, 1.0, 0.0, 0.0, *_drift(h), 0.0, 0.0, 0.0, 0.0, 0.0


_STATE_SCHEMA = "key string, span long, a double, b double, state array<double>"


def _passed_along(cell: float, span_cells: int) -> Callable:
    """From the sorted rows of spans with readings: every span of each source with the source's first and last cell (a, b) and ``state``.

    ``state`` is what smooth() takes as ``before`` (6) and ``after`` (5), in terms of the source's centre, then centre and scale:
    medians of those of its spans, weighted by readings.
    """
    width = span_cells * cell
    schema = pa.schema([("key", pa.string()), ("span", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("state", pa.list_(pa.float64()))])

    def scale_of(m: np.ndarray) -> tuple[float, float]:
        count, centres, scales, low, high = m[:, 3:8].T
        some, stepped = count > 0, count > 1
        if not some.any():
            return 0.0, 1.0
        centre = _middle(centres[some], count[some])
        scale = _middle(scales[stepped], count[stepped] - 1) if stepped.any() else 0.0
        return centre, scale or float(max(high[some].max() - centre, centre - low[some].min())) or 1.0

    def source(spans: list[int], m: np.ndarray) -> Iterator[tuple[int, list[float]]]:
        centre, scale = scale_of(m)
        told = []
        for start, _, _, count, own, *_rest, a11, a12, a21, a22, b1, b2, c11, c12, c22, e1, e2, j11, j12, j22 in m.tolist():
            d = centre - own if count else 0.0  # from the span's centre to the source's
            told.append((start, (a11, a12, a21, a22, b1 - (1 - a11) * d, b2 + a21 * d, c11, c12, c22, e1 - j11 * d, e2 - j12 * d, j11, j12, j22)))
        # What all readings from a span with readings on say about the state at its edge, last span first.
        onwards, later = [], (0.0,) * 5
        for k, (start, condensed) in zip(reversed(spans), reversed(told), strict=True):
            later = _backward(later, condensed)
            later = _backward(later, _still(max(start - k * width, 0.0)))
            onwards.append(later)
            if len(onwards) < len(spans):
                later = _backward(later, _still((k - spans[-len(onwards) - 1] - 1) * width))
        onwards.reverse()
        state = _UNKNOWN
        for i, (k, (start, condensed)) in enumerate(zip(spans, told, strict=True)):
            until = spans[i + 1] if i + 1 < len(spans) else k + 1
            after = _backward(onwards[i + 1], _still((until - k - 1) * width)) if i + 1 < len(spans) else (0.0,) * 5
            # A source begins at its first time, not at the edge of its first span.
            yield k, [k * width if i else start, *state, *after, centre, scale]
            if i:
                state = _onward(state, _still(max(start - k * width, 0.0)))
            state = _onward(state, condensed)
            for empty in range(k + 1, until):
                yield empty, [empty * width, *_onward(state, _still((empty - k - 1) * width)), *_backward(onwards[i + 1], _still((until - empty - 1) * width)), centre, scale]
            state = _onward(state, _still((until - k - 1) * width))

    def sources(keys: list[str], spans: list[int], m: np.ndarray, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], []]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            for c in columns:
                c.clear()
            return out

        for f, e in zip(cuts[:-1], cuts[1:], strict=True):
            for k, state in source(spans[f:e], m[f:e]):
                for column, value in zip(columns, (keys[f], k, float(m[f, 1]), float(m[e - 1, 2]), state), strict=True):
                    column.append(value)
                if len(columns[0]) >= 20_000:
                    yield flush()
        yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last source seen wait in pieces until the next one begins.
        held: list[tuple[list[str], list[int], np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, spans = batch.column("key").to_pylist(), batch.column("span").to_pylist()
            held.append((keys, spans, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _SPAN_FIELDS], axis=1)))
            if keys[-1] != held[0][0][-1]:
                keys, spans, m = [k for h in held for k in h[0]], [k for h in held for k in h[1]], np.concatenate([h[2] for h in held])
                cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
                yield from sources(keys, spans, m, cuts)
                held = [(keys[cuts[-1] :], spans[cuts[-1] :], m[cuts[-1] :])]
        if held:
            keys, spans, m = [k for h in held for k in h[0]], [k for h in held for k in h[1]], np.concatenate([h[2] for h in held])
            yield from sources(keys, spans, m, [*(i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]), len(keys)])

    return run


def _span_cells(cell: float, span_cells: int) -> Callable:
    out_schema = pa.schema([("key", pa.string()), ("cell", pa.int64()), ("kind", pa.string()), ("readings", pa.int64()), ("value", pa.float64()), ("sd", pa.float64())])

    def finish(spans: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Smooth a batch of spans; each is (key, end, cells, counts, covered, times, values, state)."""
        for block in _alike(spans, lambda s: len(s[2]) + len(s[5])):
            n = max(len(s[2]) + len(s[5]) for s in block) + 1
            states = np.array([s[7] for s in block])
            centre, scale = states[:, 11], states[:, 12]
            t, y, seen = np.repeat(np.array([[s[1]] for s in block]), n, axis=1), np.zeros((len(block), n)), np.zeros((len(block), n), bool)
            place = []
            for i, (_, _, cells, _, _, times, values, _) in enumerate(block):
                when = np.concatenate((times, (cells + 0.5) * cell))
                order = np.argsort(when, kind="stable")
                m = len(when)
                full = np.concatenate((values - centre[i], np.zeros(len(cells))))
                t[i, :m], y[i, :m], seen[i, :m] = when[order], full[order], (order < len(times)) & np.isfinite(full[order])
                back = np.empty(m, int)
                back[order] = np.arange(m)
                place.append(back[len(times) :])
            level, var = smooth(t, np.where(seen, y, 0.0), seen, states[:, :6], states[:, 6:11])
            for i, (key, _, cells, counts, covered, *_rest) in enumerate(block):
                kind = np.where(counts > 0, "observed", np.where(covered, "lost", "break"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(cells)), pa.array(cells), pa.array(kind), pa.array(counts), pa.array(level[i, place[i]] + centre[i]), pa.array(np.sqrt(var[i, place[i]]) * scale[i])], schema=out_schema
                )

    def span(key: str, number: int, rows: pa.Table) -> tuple | None:
        """Rows of one (key, span): tag 0 (first, last cell; state), 1 (run start, end), 2 (time, value)."""
        tags, a, b = (rows.column(c).to_numpy() for c in ("tag", "a", "b"))
        if tags[0] != 0:
            return None
        cells = np.arange(max(number * span_cells, int(a[0])), min((number + 1) * span_cells - 1, int(b[0])) + 1)
        edges = np.zeros(len(cells) + 1, int)
        lo = np.clip(np.floor(a[tags == 1] / cell).astype(int) - cells[0], 0, len(cells))
        hi = np.clip(np.floor(b[tags == 1] / cell).astype(int) + 1 - cells[0], 0, len(cells))
        good = hi > lo
        np.add.at(edges, lo[good], 1)
        np.add.at(edges, hi[good], -1)
        times, values = _fresh(a[tags == 2], b[tags == 2])
        counts = np.bincount(np.floor(times / cell).astype(int) - cells[0], minlength=len(cells))
        return key, (number + 1) * span_cells * cell, cells, counts, np.cumsum(edges)[:-1] > 0, times, values, rows.column("state")[0].as_py()

    return _by_span(span, finish, lambda s: len(s[2]) + len(s[5]))


def _each_span(rows: DataFrame, first: Column, last: Column, many: int = 4096) -> DataFrame:
    """Every row once for each whole number ``span`` from ``first`` to ``last``; in two steps, so that no list is longer than the root of their number allows."""
    rough = rows.withColumns({"_first": first, "_last": last}).withColumn("_many", F.explode(F.sequence(F.floor(F.col("_first") / many), F.floor(F.col("_last") / many))))
    fine = F.sequence(F.greatest(F.col("_first"), F.col("_many") * many), F.least(F.col("_last"), F.col("_many") * many + many - 1))
    return rough.withColumn("span", F.explode(fine)).drop("_first", "_last", "_many")


def regular_grid(readings: DataFrame, runs: DataFrame, cell_seconds: float = 10.0, span_cells: int = SPAN_CELLS) -> DataFrame:
    """One row per grid cell between the first and the last cell with readings of each source.

    ``readings`` (key, time, value): rows with a NULL or NaN key, time or value are no readings, nor
    are infinite times; equal readings count once; order doesn't matter. ``runs`` (key, start, end):
    spans in which the source was recording; rows with a missing time or an end before the start
    cover nothing. A source without readings has no cells.

    Returns (key, cell, kind, readings, value, sd): cell k covers [k * cell, (k + 1) * cell) seconds; kind
    is 'observed', 'lost' (no reading though a run touches the cell) or 'break'; value is the smoothed
    level at the middle of the cell and sd its uncertainty, which grows inside gaps. An infinite
    reading counts as observed but doesn't enter the smoother. Neither depends on ``span_cells``, but for
    sd's unit: the noise scale of a source is the middle one of its spans. A gap costs its cells, and
    nothing more in any one task: the spans inside it come from closed forms, one after the other.
    """
    inf = float("inf")
    good = F.col("time").isNotNull() & ~F.isnan("time") & (F.abs("time") < inf) & F.col("value").isNotNull() & ~F.isnan("value") & F.col("key").isNotNull()
    points = readings.where(good).select("key", "time", "value")
    cell = F.floor(F.col("time") / cell_seconds)
    reach = points.groupBy("key").agg(F.floor(F.min("time") / cell_seconds).alias("first"), F.floor(F.max("time") / cell_seconds).alias("last"))
    data = points.select("key", F.floor(cell / span_cells).alias("span"), F.col("time").alias("a"), F.col("value").alias("b"))
    told = data.repartition("key", "span").sortWithinPartitions("key", "span", "a", "b").mapInArrow(_condensed(cell_seconds, span_cells), _SPAN_SCHEMA)
    frame = told.repartition("key").sortWithinPartitions("key", "span").mapInArrow(_passed_along(cell_seconds, span_cells), _STATE_SCHEMA)
    width = cell_seconds * span_cells
    cover = (
        runs.where("key IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND NOT isnan(start) AND NOT isnan(end) AND end >= start")
        .join(reach, "key")
        # A run counts within the source's grid only, which bounds the spans it is listed under.
        .select("key", F.greatest("start", F.col("first") * cell_seconds).alias("a"), F.least("end", (F.col("last") + 1) * cell_seconds).alias("b")).where("b >= a").distinct()
    )
    cover = _each_span(cover, F.floor(F.col("a") / width), F.floor(F.col("b") / width)).select("key", "span", F.lit(1).alias("tag"), "a", "b")
    rows = frame.withColumn("tag", F.lit(0)).unionByName(cover, allowMissingColumns=True).unionByName(data.withColumn("tag", F.lit(2)), allowMissingColumns=True)
    return rows.repartition("key", "span").sortWithinPartitions("key", "span", "tag", "a", "b").mapInArrow(_span_cells(cell_seconds, span_cells), "key string, cell long, kind string, readings long, value double, sd double")
