"""Numeric kernels on one series: detrending, period search, shape fits. They run inside grouped tasks."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np

MAD = 1.4826


def biweight_trend(t: np.ndarray, x: np.ndarray, use: np.ndarray, window: float, at: np.ndarray | None = None) -> np.ndarray:
    """One-step Tukey biweight (c = 6) of the usable points within half a window, both ends included.

    Without points the flux itself; without scatter the median. Where ``at`` is given, the trend is found there only.
    """
    out = x.astype(float).copy()
    tt, xx = t[use], x[use].astype(float)
    rows = np.arange(len(t)) if at is None else np.asarray(at)
    low, high = np.searchsorted(tt, t[rows] - window / 2, "left"), np.searchsorted(tt, t[rows] + window / 2, "right")
    some = high > low
    rows, low, count = rows[some], low[some], (high - low)[some]
    start = 0
    while start < len(rows):
        stop = start + max(1, _WINDOWS_AT_ONCE // int(count[start : start + 256].max()))
        stop = min(stop, start + 256, len(rows))
        c, each = count[start:stop], np.arange(stop - start)
        column = np.arange(int(c.max()))[None]
        inside = column < c[:, None]
        near = xx[np.minimum(low[start:stop, None] + column, len(xx) - 1)]
        middle = lambda v: 0.5 * (v[each, (c - 1) // 2] + v[each, c // 2])  # noqa: B023, E731
        m = middle(np.sort(np.where(inside, near, np.inf), axis=1))
        off = near - m[:, None]
        s = middle(np.sort(np.where(inside, np.abs(off), np.inf), axis=1))
        u = off / (6 * np.maximum(s, 1e-12))[:, None]
        w = np.where(inside & (np.abs(u) < 1), (1 - u * u) ** 2, 0.0)
        total = w.sum(axis=1)
        flat = (s < 1e-12) | (total <= 0)
        out[rows[start:stop]] = np.where(flat, m, (w * near).sum(axis=1) / np.where(flat, 1.0, total))
        start = stop
    return out


#: Values of windows that are held at once.
_WINDOWS_AT_ONCE = 1 << 17


def interpolated_trend(t: np.ndarray, x: np.ndarray, use: np.ndarray, window: float) -> np.ndarray:
    """The biweight trend where a whole window has usable points, interpolated elsewhere: near the ends, and within masked stretches.

    Up to three points are their own trend; with fewer than three usable ones, or without a whole window, the median is.
    """
    if len(t) <= 3:
        return x.astype(float)
    whole = (t > t[0] + window / 2) & (t < t[-1] - window / 2)
    tt = t[use]
    good = whole & (np.searchsorted(tt, t + window / 2, "right") > np.searchsorted(tt, t - window / 2, "left"))
    if use.sum() < 3 or not good.any():
        return np.full(len(t), np.median(x))
    return np.interp(t, t[good], biweight_trend(t, x, use, window)[good])


def detrend(t: np.ndarray, x: np.ndarray, segment: np.ndarray, window: float, masked: np.ndarray | None = None, interpolate: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(flux / trend, trend), by segment; trends that aren't positive count as 1."""
    trend = np.ones(len(t))
    use = np.ones(len(t), bool) if masked is None else ~masked
    for s in np.unique(segment):
        at = segment == s
        trend[at] = (interpolated_trend if interpolate else biweight_trend)(t[at], x[at], use[at], window)
    trend = np.where(trend > 0, trend, 1.0)
    return x / trend, trend


def duration_grid(least: float, most: float, count: int, least_period: float) -> np.ndarray:
    """Geometric durations (days), at most a quarter of the least period."""
    top = min(most, 0.25 * least_period)
    return np.geomspace(least, top if top > least else 1.5 * least, count)


def period_count(baseline: float, least: float, most: float, least_duration: float, factor: float = 1.0) -> int:
    """How many periods ``period_grid`` has."""
    if not baseline > 0 or most < least:
        return 0
    return int(np.floor((1 / least - 1 / most) / (factor * least_duration / baseline**2))) + 1


def period_grid(baseline: float, least: float, most: float, least_duration: float, factor: float = 1.0, budget: int | None = None, at: slice = slice(None)) -> np.ndarray:
    """Periods, rising, uniform in frequency with steps of factor * duration / baseline**2; ``at`` picks a part of them."""
    n = period_count(baseline, least, most, least_duration, factor)
    if budget is not None and n > budget + 1:
        raise ValueError(f"{n} trial periods exceed the budget of {budget}")
    return 1 / (1 / least - np.arange(n)[at] * (factor * least_duration / baseline**2)) if n else np.zeros(0)


@dataclass
class Bls:
    periods: np.ndarray
    power: np.ndarray
    depth: np.ndarray
    duration: np.ndarray
    epoch: np.ndarray
    best: int
    sde: float
    snr: float


def _time_cells(t: np.ndarray, w: np.ndarray, wx: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over cells of time, each at the weighted mean of its times; ``t`` is in order."""
    cell = np.floor((t - t[0]) / width)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    if len(starts) == len(t):
        return t, w, wx
    sums = np.add.reduceat(w, starts)
    return np.add.reduceat(w * t, starts) / sums, sums, np.add.reduceat(wx, starts, axis=-1)


def _weighted_cells(t: np.ndarray, xs: np.ndarray, error: np.ndarray | None, width: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(first time, times after it, weights, weighted fluxes less their mean) of the cells of several series (rows) at the same times."""
    order = np.argsort(t, kind="stable")
    t, xs = t[order], xs[:, order]
    w = np.ones(len(t)) if error is None else 1 / np.maximum(error[order], 1e-12) ** 2
    w = w / w.sum()
    wx = w * (xs - (w * xs).sum(axis=1)[:, None])
    tt, w, wx = _time_cells(t, w, wx, width)
    return t[0], tt - t[0], w, wx


#: Of what is held at once: cells times periods, and phase bins times periods.
_CELLS_AT_ONCE, _BINS_AT_ONCE = 1 << 19, 1 << 18


def box_powers(t: np.ndarray, x: np.ndarray, error: np.ndarray | None, periods: np.ndarray, durations: np.ndarray, oversample: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(power, depth, duration, epoch) at each period: of the box, over phase and duration, of largest likelihood gain.

    Phase bins are the least duration over ``oversample`` wide, the last of a period narrower; boxes are runs of bins, wrapped
    around. Cadences are summed first over cells of half a bin in time. Only dips count; equal gains go to the
    shorter duration, then to the earlier phase. Many periods are folded at once, so a call costs about cells times periods.
    """
    power, depth, width, epoch = boxes_of_all(t, x[None], error, periods, durations, oversample)[0]
    return power, depth, width, epoch


def boxes_of_all(t: np.ndarray, xs: np.ndarray, error: np.ndarray | None, periods: np.ndarray, durations: np.ndarray, oversample: int = 3) -> np.ndarray:
    """``box_powers`` of several series (rows) at the same times: (series, 4, periods). Phases and weights are folded once for all."""
    step = durations.min() / oversample
    t0, tt, w, wx = _weighted_cells(t, xs, error, step / 2)
    runs = np.maximum(np.rint(durations / step).astype(int), 1)
    bins = np.maximum(np.ceil(periods / step - 1e-9).astype(int), 1)
    found = np.zeros((len(xs), 4, len(periods)))
    at_once = max(1, min(_CELLS_AT_ONCE // len(tt), len(periods)))
    weights, fluxes = np.tile(w, at_once), np.tile(wx, at_once)
    lo = 0
    while lo < len(periods):
        hi = min(lo + at_once, len(periods))
        hi = max(lo + 1, min(hi, lo + _BINS_AT_ONCE // (int(bins[lo:hi].max()) + int(runs.max()))))
        p, n = periods[lo:hi], bins[lo:hi]
        k, most = hi - lo, int(n.max())
        stride = most + int(runs.max())
        cycle = np.multiply.outer(1 / p, tt)
        cycle -= np.floor(cycle)
        cycle *= (p / step)[:, None]
        at = cycle.astype(np.int32)
        np.minimum(at, (n - 1).astype(np.int32)[:, None], out=at)
        at += (np.arange(k, dtype=np.int32) * stride)[:, None]
        at = at.ravel()
        wrap = np.arange(stride)[None] % n[:, None]

        def running(v: np.ndarray) -> np.ndarray:
            own = np.bincount(at, v[: len(at)], k * stride).reshape(k, stride)  # noqa: B023
            total = np.zeros((k, stride + 1))  # noqa: B023
            np.cumsum(np.take_along_axis(own, wrap, axis=1), axis=1, out=total[:, 1:])  # noqa: B023
            return total

        cw = running(weights)
        beyond = np.arange(most)[None] >= n[:, None]
        rows, boxes = np.arange(k), []
        for d, m in zip(durations, runs, strict=True):
            a = cw[:, m : m + most] - cw[:, :most]
            room = a * (1 - a)
            bad = (room <= 1e-9) | beyond
            bad[m >= n] = True
            room[bad] = 1.0
            boxes.append((d, m, room, bad))
        for v, (power, depth, width, epoch) in zip(fluxes, found[:, :, lo:hi], strict=True):
            cx = running(v)
            for d, m, room, bad in boxes:
                b = cx[:, m : m + most] - cx[:, :most]
                gain = b * b
                gain /= room
                gain[bad | (b >= 0)] = 0.0
                i = gain.argmax(axis=1)
                g = gain[rows, i]
                r = np.flatnonzero(g > power)
                if len(r):
                    j = i[r]
                    power[r], width[r] = g[r], d
                    depth[r] = -b[r, j] / room[r, j]
                    epoch[r] = (t0 + (j + m / 2) * step) % p[r]
        lo = hi
    return found


#: Of periods that drift: phase bins times periods, and stays of cadences in bins, held at once; the least periods of equally many bins, in the mean; the most stays for a cadence and period.
_DRIFT_BINS, _DRIFT_STAYS, _DRIFT_EQUAL, _DRIFT_SHARE = 1 << 15, 1 << 19, 64, 0.2


def _stays(tt: np.ndarray, periods: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, bin, first, end): the runs of periods, rising and uniform in frequency, over which each cell stays in one phase bin; and periods that put a cell on a bin's edge.

    Cells lie behind the longest period. In cycle c a cell is in bin j or above up to the period (tt - j * step) / c; from there on it is in the bin before.
    """
    n, f0 = len(periods), 1 / periods[0]
    df = (f0 - 1 / periods[-1]) / (n - 1)
    most, least = (np.floor(tt / p).astype(np.int64) for p in (periods[0], periods[-1]))
    count = most - least + 1
    cell = np.repeat(np.arange(len(tt)), count)
    first = np.cumsum(count) - count
    c = most[cell] - (np.arange(len(cell)) - first[cell])  # falls, so that periods rise
    at = tt[cell]
    top = np.floor((at - c * np.maximum(periods[0], at / (c + 1))) / step).astype(np.int64)
    low = np.maximum(np.floor((at - c * np.minimum(periods[-1], at / c)) / step).astype(np.int64), 0)
    count = np.maximum(top - low + 1, 1)
    first = np.cumsum(count) - count
    pair = np.repeat(np.arange(len(cell)), count)
    j = (np.maximum(top, low) + first)[pair] - np.arange(len(pair))
    cell, c = cell[pair], c[pair]
    end = (f0 - c / (tt[cell] - j * step)) / df
    nearest = np.rint(end)
    edge = nearest[np.abs(end - nearest) < 1e-6].astype(np.int64)
    end = np.clip(np.floor(end).astype(np.int64) + 1, 0, n)
    new = np.flatnonzero(np.diff(cell)) + 1
    end[np.append(new - 1, len(end) - 1)] = n
    begin = np.concatenate([[0], end[:-1]])
    begin[new] = 0
    return cell, j, np.minimum(begin, end), end, np.unique(edge[(edge >= 0) & (edge < n)])


def drifting_powers(t: np.ndarray, xs: np.ndarray, error: np.ndarray | None, periods: np.ndarray, durations: np.ndarray, oversample: int = 3) -> np.ndarray | None:
    """The powers of ``box_powers``, up to rounding, of several series at the same times: (series, periods).

    From one period of a fine grid to the next few cadences change their phase bin. So sums over bins are carried on from period to period,
    and a cadence is handled once for each bin that it passes, not for each period. None if the periods aren't a grid, rising and uniform
    in frequency, for which that is less work. Cadences of the first longest period, and periods that put a cadence on a bin's edge, are
    folded as in ``box_powers``, so that both round to the same bin.
    """
    step, size = durations.min() / oversample, len(periods)
    bins = np.maximum(np.ceil(periods / step - 1e-9).astype(int), 1)
    if size < _DRIFT_EQUAL * (int(bins[-1]) - int(bins[0]) + 1) or not (np.diff(periods) > 0).all():
        return None
    f = 1 / periods
    if np.abs(f - np.linspace(f[0], f[-1], size)).max() > 1e-4 * (f[0] - f[-1]) / size:
        return None
    _, tt, w, wx = _weighted_cells(t, xs, error, step / 2)
    if tt[-1] * (f[0] - f[-1]) * periods.mean() / step > 2 * _DRIFT_SHARE * size:
        return None
    values = [w, *wx]
    runs = np.maximum(np.rint(durations / step).astype(int), 1)
    longest = int(runs.max())
    power, edges = np.zeros((len(xs), size)), []
    lo = 0
    while lo < size:
        hi = min(size, lo + max(_DRIFT_EQUAL, _DRIFT_BINS // int(bins[lo])))
        if size - hi < _DRIFT_EQUAL:
            hi = size
        p, most, wide = periods[lo:hi], int(bins[hi - 1]), hi - lo + 1
        early = int(np.searchsorted(tt, p[-1] * (1 + 1e-9), "right"))
        sums = [np.zeros((most + 1) * wide) for _ in values]
        some = max(1, int(_DRIFT_STAYS / (2 + tt[-1] * (f[lo] - f[hi - 1]) * p[-1] / step)))
        for a in range(early, len(tt), some):
            part = slice(a, a + some)
            cell, j, begin, end, edge = _stays(tt[part], p, step)
            edges.append(lo + edge)
            j = np.minimum(j, most) * wide
            places = np.concatenate([j + begin, j + end])
            for v, total in zip(values, sums, strict=True):
                own = v[part][cell]
                total += np.bincount(places, np.concatenate([own, -own]), len(total))
        cycle = np.multiply.outer(tt[:early], 1 / p)
        cycle -= np.floor(cycle)
        cycle *= p / step
        places = (np.minimum(cycle.astype(np.int64), bins[lo:hi] - 1) * wide + np.arange(hi - lo)).ravel()
        for k, v in enumerate(values):
            own = np.cumsum(sums[k].reshape(most + 1, wide), axis=1)
            own += np.bincount(places, np.repeat(v[:early], hi - lo), own.size).reshape(own.shape)
            sums[k] = np.zeros((most + 1, wide))
            for i in range(most):
                np.add(sums[k][i], own[i], out=sums[k][i + 1])
        ends = np.append(np.flatnonzero(np.diff(bins[lo:hi])) + 1, hi - lo)
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            n = int(bins[lo + a])
            cw, *flux = (np.concatenate([s[: n + 1, a:b], s[n, a:b] + s[1 : min(longest, n) + 1, a:b]]) for s in sums)
            for m in runs[runs < n]:
                room = cw[m : m + n] - cw[:n]
                room -= room * room
                np.maximum(room, 1e-9, out=room)  # nothing lies in the box, or all: no flux either
                for cx, best in zip(flux, power[:, lo + a : lo + b], strict=True):
                    gain = cx[m : m + n] - cx[:n]
                    np.minimum(gain, 0, out=gain)
                    gain *= gain
                    gain /= room
                    np.maximum(best, gain.max(axis=0), out=best)
        lo = hi
    if edges and len(edge := np.unique(np.concatenate(edges))):
        power[:, edge] = boxes_of_all(t, xs, error, periods[edge], durations, oversample)[:, 0]
    return power


#: Bins times periods times series that are held at once, and by how much the bins of periods that are folded together may differ.
_SERIES_AT_ONCE, _ALIKE = 1 << 17, 1.25


def shared_powers(t: np.ndarray, xs: np.ndarray, error: np.ndarray | None, periods: np.ndarray, durations: np.ndarray, oversample: int = 3) -> np.ndarray:
    """The powers of ``box_powers``, up to rounding, of several series at the same times: (series, periods). Phases and weights are folded once for all."""
    step = durations.min() / oversample
    _, tt, w, wx = _weighted_cells(t, xs, error, step / 2)
    runs = np.maximum(np.rint(durations / step).astype(int), 1)
    longest = int(runs.max())
    bins = np.maximum(np.ceil(periods / step - 1e-9).astype(int), 1)
    power = np.zeros((len(xs), len(periods)))
    lo = 0
    while lo < len(periods):
        hi = min(len(periods), lo + max(1, _CELLS_AT_ONCE // len(tt)))
        other = np.flatnonzero((bins[lo:hi] > _ALIKE * bins[lo] + 1) | (bins[lo:hi] < bins[lo] / _ALIKE - 1))
        hi = lo + int(other[0]) if len(other) else hi
        p, n, k = periods[lo:hi], bins[lo:hi], hi - lo
        most = int(n.max())
        rows = most + longest
        cycle = np.multiply.outer(tt, 1 / p)
        cycle -= np.floor(cycle)
        cycle *= p / step
        at, column = np.minimum(cycle.astype(np.int64), n - 1), np.arange(k)
        places, cells = [at * k + column], [np.broadcast_to(np.arange(len(tt))[:, None], at.shape)]
        for again in range(1, -(-longest // int(n.min())) + 1):  # boxes that go beyond a period's last bin find its first ones behind it
            beyond = at + again * n
            some = beyond < np.minimum(n + longest, rows)
            places.append((beyond * k + column)[some])
            cells.append(cells[0][some])
        place, cell = (np.concatenate([v.ravel() for v in part]) for part in (places, cells))
        total = np.zeros((rows + 1, k))
        np.cumsum(np.bincount(place, w[cell], rows * k).reshape(rows, k), axis=0, out=total[1:])
        boxes = []
        for m in runs:
            a = total[m : m + most] - total[:most]
            room = a * (1 - a)
            good = (room > 1e-9) & (np.arange(most)[:, None] < n) & (m < n)
            boxes.append((m, np.where(good, 1 / np.where(good, room, 1.0), 0.0)[:, None]))
        many = max(1, _SERIES_AT_ONCE // (rows * k))
        for a in range(0, len(xs), many):
            part = wx[a : a + many]
            sums = np.zeros((rows + 1, len(part), k))
            for i, v in enumerate(part):
                sums[1:, i] = np.bincount(place, v[cell], rows * k).reshape(rows, k)
            for i in range(rows):
                sums[i + 1] += sums[i]
            best = power[a : a + many, lo:hi]
            for m, weight in boxes:
                gain = sums[m : m + most] - sums[:most]
                np.minimum(gain, 0, out=gain)
                gain *= gain
                gain *= weight
                np.maximum(best, gain.max(axis=0), out=best)
        lo = hi
    return power


def box_snr(t: np.ndarray, x: np.ndarray, period: float, epoch: float, duration: float, depth: float) -> float:
    """The depth over the scatter of as many cadences as lie in events."""
    inside = np.abs((t - epoch + period / 2) % period - period / 2) <= duration / 2
    noise = x.std() / np.sqrt(max(inside.sum(), 1))
    return max(float(depth / noise), 0.0) if noise > 0 else 0.0


def box_least_squares(t: np.ndarray, x: np.ndarray, error: np.ndarray | None, periods: np.ndarray, durations: np.ndarray, oversample: int = 3) -> Bls:
    """The periodogram of ``box_powers``, with its peak's efficiency and SNR."""
    power, depth, width, epoch = box_powers(t, x, error, periods, durations, oversample)
    best = int(np.argmax(power))
    spread = power.std()
    snr = box_snr(t, x, periods[best], epoch[best], width[best], depth[best])
    return Bls(periods, power, depth, width, epoch, best, (power[best] - power.mean()) / spread if spread > 0 else 0.0, snr)


def lomb_scargle(t: np.ndarray, x: np.ndarray, frequencies: np.ndarray, error: np.ndarray | None = None) -> np.ndarray:
    """Generalized (floating mean) power, from 0 to 1."""
    w = np.ones(len(x)) if error is None else 1 / np.maximum(error, 1e-12) ** 2
    w = w / w.sum()
    y = x - (w * x).sum()
    yy = (w * y * y).sum()
    out = np.zeros(len(frequencies))
    for start in range(0, len(frequencies), 256):
        f = frequencies[start : start + 256]
        a = 2 * np.pi * f[:, None] * t[None]
        c, s = np.cos(a), np.sin(a)
        mc, ms = c @ w, s @ w
        yc, ys = c @ (w * y), s @ (w * y)
        cc, ss, cs = (c * c) @ w - mc * mc, (s * s) @ w - ms * ms, (c * s) @ w - mc * ms
        d = cc * ss - cs * cs
        ok = d > 1e-12
        out[start : start + 256] = np.where(ok, (ss * yc**2 + cc * ys**2 - 2 * cs * yc * ys) / np.where(ok, d, 1) / max(yy, 1e-300), 0)
    return np.clip(out, 0, 1)


def false_alarm(power: float, n: int, highest: float, t: np.ndarray) -> float:
    """Baluev's bound on the probability that noise reaches the power."""
    span = np.sqrt(4 * np.pi * t.var())
    z = (1 - power) ** ((n - 4) / 2)
    tau = highest * span * z * np.sqrt(max(0.5 * (n - 1) * power, 0))
    return float(np.clip(1 - (1 - (1 - power) ** ((n - 3) / 2)) * np.exp(-tau), 0, 1))


def phase(t: np.ndarray, epoch: float, period: float) -> np.ndarray:
    return (t - epoch + period / 2) % period - period / 2


def trapezoid(t: np.ndarray, epoch: float, period: float, depth: float, duration: float, ingress: float) -> np.ndarray:
    half = duration / 2
    return 1 - depth * np.clip((half - np.abs(phase(t, epoch, period))) / np.maximum(half * ingress, 1e-9), 0, 1)


def _columns(q: np.ndarray) -> np.ndarray:
    """Parameters, of one model or a row each, as numbers or columns that meet a row of times."""
    return np.moveaxis(q, -1, 0)[..., None]


def bounded_fits(model, start: np.ndarray, low: np.ndarray, high: np.ndarray, ys: np.ndarray, error: np.ndarray, soft: bool = True, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt steps within a box, for several series (rows) of one model at once; ``soft`` reweights for a soft-L1 loss of scale 0.1.

    ``model`` takes parameters in the last axis and gives fluxes there. Returns rows of parameters, and whether each one's steps settled:
    a series takes the steps that it would take alone.
    """
    many, k = len(ys), len(start)
    p, damping = np.tile(np.clip(start, low, high).astype(float), (many, 1)), np.full(many, 1e-2)
    size = np.maximum((high - low) * 1e-6, 1e-10)

    def cost(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = model(q)
        r = (m - y) / error
        z = (r / 0.1) ** 2 if soft else None
        return (0.01 * 2 * (np.sqrt(1 + z) - 1).sum(axis=1) if soft else (r * r).sum(axis=1)), r, m

    now, r, here = cost(p, ys)
    settled, good, going = np.zeros(many, int), np.zeros(many, bool), np.arange(many)
    for _ in range(steps):
        if not len(going):
            break
        slopes = (model(np.clip(p[going, None] + np.diag(size), low, high)) - here[going, None]) / error / size[:, None]
        weights = 1 / np.sqrt(1 + (r[going] / 0.1) ** 2) if soft else np.ones(r[going].shape)
        normal = {}
        for i, slope, w in zip(going.tolist(), slopes, weights, strict=True):
            jac = np.ascontiguousarray(slope.T)
            left = (jac * w[:, None]).T
            normal[i] = left @ jac, left @ r[i]
        trying = going
        for _ in range(8):
            step = [np.linalg.lstsq(a + damping[i] * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0] for i, (a, g) in ((i, normal[i]) for i in trying.tolist())]
            q = np.clip(p[trying] + step, low, high)
            then, rq, there = cost(q, ys[trying])
            better = then < now[trying]
            i = trying[better]
            settled[i] = np.where(now[i] - then[better] <= 1e-9 * np.maximum(now[i], 1e-12), settled[i] + 1, 0)
            p[i], now[i], r[i], here[i], damping[i] = q[better], then[better], rq[better], there[better], np.maximum(damping[i] / 5, 1e-9)
            trying = trying[~better]
            damping[trying] = np.minimum(damping[trying] * 4, 1e9)
            if not len(trying):
                break
        good[trying] = True  # no step makes it better
        good[settled >= 2] = True
        going = np.flatnonzero(~good)
    return p, good


def bounded_fit(model, start: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, error: np.ndarray, soft: bool = True, steps: int = 60) -> tuple[np.ndarray, bool]:
    """``bounded_fits`` of one series."""
    p, good = bounded_fits(model, start, low, high, y[None], error, soft, steps)
    return p[0], bool(good[0])


@dataclass
class ShapeFit:
    epoch: float
    period: float
    depth: float
    duration: float
    ingress: float
    chi2: float
    bic: float
    converged: bool


def fit_trapezoids(t: np.ndarray, xs: np.ndarray, error: np.ndarray, epoch: float, period: float, depth: float, duration: float) -> list[ShapeFit]:
    """Epoch, period, depth, duration, ingress and level of several series (rows) at the same times, from the cadences near events; chi-square per degree over all."""
    near = np.abs(phase(t, epoch, period)) <= max(0.1, 3.5 * duration)
    if near.sum() < 15:
        near = np.ones(len(t), bool)
    low = np.array([epoch - duration, period * 0.99, 0.0, duration * 0.3, 0.05, 0.9])
    high = np.array([epoch + duration, period * 1.01, min(1.0, max(depth * 4, 1e-4)), duration * 3, 1.0, 1.1])
    tt, ee = t[near], error[near]
    found, good = bounded_fits(lambda q: (c := _columns(q))[5] * trapezoid(tt, *c[:5]), np.array([epoch, period, depth, duration, 0.3, 1.0]), low, high, np.ascontiguousarray(xs[:, near]), ee)
    out = []
    for x, q, settled in zip(xs, found, good.tolist(), strict=True):
        r = (x - q[5] * trapezoid(t, *q[:5])) / error
        chi = float((r * r).sum())
        out.append(ShapeFit(*q[:5].tolist(), chi / max(len(t) - 6, 1), chi + 6 * np.log(len(t)), settled))
    return out


def fit_trapezoid(t: np.ndarray, x: np.ndarray, error: np.ndarray, epoch: float, period: float, depth: float, duration: float) -> ShapeFit:
    """``fit_trapezoids`` of one series."""
    return fit_trapezoids(t, x[None], error, epoch, period, depth, duration)[0]


def fit_joint(series: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epoch: float, period: float, depth: float, duration: float) -> tuple[np.ndarray, bool]:
    """Shared epoch, period, duration and ingress; for each series a level and a depth. At least two events."""
    k = len(series)
    t, y, e = (np.concatenate([s[i] for s in series]) for i in range(3))
    which = np.repeat(np.arange(k), [len(s[0]) for s in series])

    def model(q: np.ndarray) -> np.ndarray:
        epoch, period, duration, ingress = _columns(q)[:4]
        return q[..., 4 + which] * (1 - q[..., 4 + k + which] * (1 - trapezoid(t, epoch, period, 1.0, duration, ingress)))

    start = np.array([epoch, period, duration, 0.3, *[1.0] * k, *[depth] * k])
    low = np.array([epoch - duration, period * 0.99, duration * 0.3, 0.05, *[0.9] * k, *[0.0] * k])
    high = np.array([epoch + duration, period * 1.01, duration * 3, 1.0, *[1.1] * k, *[min(1.0, 4 * depth + 1e-4)] * k])
    return bounded_fit(model, start, low, high, y, e, soft=False)


#: Values of replicates that are refitted at once.
_REFITTED_AT_ONCE = 1 << 17


def block_bootstrap(t: np.ndarray, x: np.ndarray, error: np.ndarray, fit: ShapeFit, replicates: int, *seeds: int) -> np.ndarray:
    """Refits to the model plus residuals drawn in blocks of max(0.2 days, two durations), five points at least; rows of (epoch, period, depth, duration). So many replicates for each seed."""
    model = trapezoid(t, fit.epoch, fit.period, fit.depth, fit.duration, fit.ingress)
    left = x - model
    dt = np.median(np.diff(t)) if len(t) > 1 else 1.0
    block = max(5, int(round(max(0.2, 2 * fit.duration) / max(dt, 1e-9))))
    draws = [rng.integers(0, max(len(t) - block, 0) + 1, -(-len(t) // block)) for rng in map(np.random.default_rng, seeds) for _ in range(replicates)]
    out, at_once = [], max(1, _REFITTED_AT_ONCE // len(t))
    for lo in range(0, len(draws), at_once):
        drawn = [np.concatenate([left[s : s + block] for s in starts])[: len(t)] for starts in draws[lo : lo + at_once]]
        again = fit_trapezoids(t, np.array([model + np.resize(d, len(t)) for d in drawn]), error, fit.epoch, fit.period, fit.depth, fit.duration)
        out += [(a.epoch, a.period, a.depth, a.duration) for a in again if a.converged]
    return np.array(out).reshape(-1, 4)


@cache
def _nodes(count: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(count)


def occulted_flux(distance: np.ndarray, ratio: float, u1: float, u2: float, nodes: int = 32) -> np.ndarray:
    """Flux of a quadratically limb-darkened disk of radius 1 behind a dark one, in rings.

    Rings wholly behind it count in full, those that its edge cuts by the hidden share of their arc;
    each part is integrated over its own range of radii, smoothly to its ends. Disks that don't touch aren't integrated.
    """
    at, weight = _nodes(nodes)
    u = (at + 1) * np.pi / 2
    out = np.abs(np.asarray(distance, float))
    touch = ~(out >= 1 + ratio)
    z, ratio = out[touch, None], np.broadcast_to(ratio, out.shape)[touch, None]

    def rings(low: np.ndarray, high: np.ndarray, share) -> np.ndarray:
        span = np.maximum(high - low, 0)
        r = low + span * (1 - np.cos(u)) / 2
        step = span / 2 * np.sin(u) * weight * np.pi / 2
        mu = np.sqrt(np.maximum(1 - r * r, 0))
        return ((1 - u1 * (1 - mu) - u2 * (1 - mu) ** 2) * 2 * np.pi * r * share(r) * step).sum(axis=1)

    def arc(r: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip((r * r + z * z - ratio * ratio) / np.maximum(2 * r * z, 1e-12), -1, 1)) / np.pi

    full = rings(np.zeros_like(z), np.clip(ratio - z, 0, 1), np.ones_like)
    cut = rings(np.minimum(np.abs(z - ratio), 1), np.minimum(z + ratio, 1), arc)
    out[:] = 1.0
    out[touch] = 1 - (full + cut) / (np.pi * (1 - u1 / 3 - u2 / 6))
    return out


def physical_model(t: np.ndarray, epoch: float, period: float, ratio: float, axis: float, inclination: float, u1: float, u2: float, exposure: float = 0.0, samples: int = 5) -> np.ndarray:
    """Transit of a circular orbit (degrees of inclination), averaged over the exposure."""
    offsets = (np.arange(samples) + 0.5) / samples * exposure - exposure / 2 if exposure > 0 else np.zeros(1)
    angle = 2 * np.pi * phase((t[:, None] + offsets).ravel(), epoch, period) / period
    z = axis * np.sqrt(np.sin(angle) ** 2 + (np.cos(np.radians(inclination)) * np.cos(angle)) ** 2)
    flux, front = np.ones(z.shape), ~(np.cos(angle) <= 0)
    flux[front] = occulted_flux(z[front], np.broadcast_to(ratio, z.shape)[front], u1, u2)
    return flux.reshape(*z.shape[:-1], len(t), -1).mean(axis=-1)


def simpson_exposure(model, t: np.ndarray, exposure: float, n: int) -> np.ndarray:
    """Simpson mean of a model over the exposure with an odd number of instants, three at least."""
    if n < 3 or n % 2 == 0:
        raise ValueError("an odd number of instants, three at least")
    w = np.ones(n)
    w[1:-1:2], w[2:-1:2] = 4, 2
    at = np.linspace(-exposure / 2, exposure / 2, n)
    return np.stack([model(t + o) for o in at]).T @ (w / w.sum())


def fit_physical(t: np.ndarray, x: np.ndarray, error: np.ndarray, epoch: float, period: float, depth: float, duration: float, u1: float = 0.30, u2: float = 0.22, exposure: float = 0.0) -> tuple[np.ndarray, float, bool] | None:
    """Epoch, period, radius ratio, scaled axis and inclination; their BIC over all cadences. None where it can't be done."""
    near = np.abs(phase(t, epoch, period)) <= max(0.1, 3.5 * duration)
    if near.sum() < 15:
        near = np.ones(len(t), bool)
    axis = max(1.5, period / (np.pi * max(duration, 1e-3)))
    start = np.array([epoch, period, np.sqrt(max(depth, 1e-6)), axis, 89.0])
    low, high = np.array([epoch - duration, period * 0.99, 1e-4, 1.1, 60.0]), np.array([epoch + duration, period * 1.01, 0.9, axis * 5, 90.0])
    tt, xx, ee = t[near], x[near], error[near]
    try:
        found, good = bounded_fit(lambda q: physical_model(tt, *_columns(q), u1, u2, exposure), start, low, high, xx, ee, steps=25)
        r = (x - physical_model(t, *found, u1, u2, exposure)) / error
    except (ValueError, np.linalg.LinAlgError):
        return None
    return found, float((r * r).sum() + 5 * np.log(len(t))), good


@dataclass(frozen=True)
class Grid:
    """Trial periods and durations (days) of a search. ``largest`` null: half the baseline. ``budget``: periods at most, null: any number."""

    least: float = 0.3
    largest: float | None = None
    least_duration: float = 0.5 / 24
    most_duration: float = 12.0 / 24
    durations: int = 15
    factor: float = 5.0
    budget: int | None = None

    def top(self, baseline: float) -> float:
        return max(self.least + 0.1, 0.5 * baseline) if self.largest is None else self.largest

    def count(self, baseline: float) -> int:
        return period_count(baseline, self.least, self.top(baseline), self.least_duration, self.factor)

    def periods(self, baseline: float, at: slice = slice(None)) -> np.ndarray:
        return period_grid(baseline, self.least, self.top(baseline), self.least_duration, self.factor, None, at)

    def widths(self) -> np.ndarray:
        return duration_grid(self.least_duration, self.most_duration, self.durations, self.least)

    def fault(self, cadences: int, baseline: float, fewest: int) -> str | None:
        """Why a series isn't searched."""
        if cadences < fewest:
            return "too_few_cadences"
        if not baseline > 0 or not self.count(baseline):
            return "no_trial_periods"
        return "grid_exceeds_budget" if self.budget is not None and self.count(baseline) > self.budget + 1 else None


@dataclass
class Peak:
    """The largest power of a part of a periodogram, and the sums that parts add up to; parts join to what the whole would give."""

    power: float = 0.0
    period: float = 0.0
    epoch: float = 0.0
    duration: float = 0.0
    depth: float = 0.0
    n: int = 0
    total: float = 0.0
    squares: float = 0.0

    @classmethod
    def of(cls, t: np.ndarray, x: np.ndarray, error: np.ndarray | None, periods: np.ndarray, durations: np.ndarray) -> Peak:
        return cls.of_all(t, x[None], error, periods, durations)[0]

    @classmethod
    def of_all(cls, t: np.ndarray, xs: np.ndarray, error: np.ndarray | None, periods: np.ndarray, durations: np.ndarray) -> list[Peak]:
        """The peaks of several series (rows) at the same times; where sums are carried on or shared, the powers next to the best are taken again by ``boxes_of_all``."""
        if not len(periods):
            return [cls() for _ in xs]
        powers = drifting_powers(t, xs, error, periods, durations)
        if powers is None and len(xs) > 1:
            powers = shared_powers(t, xs, error, periods, durations)
        alike = defaultdict(list)
        for i in range(len(xs)):
            alike[(np.arange(len(periods)) if powers is None else np.flatnonzero(powers[i] >= powers[i].max() * (1 - 1e-9))).tobytes()].append(i)
        out = [cls()] * len(xs)
        for near, some in alike.items():
            near = np.frombuffer(near, np.int64)
            for i, boxes in zip(some, boxes_of_all(t, xs[some], error, periods[near], durations), strict=True):
                power = boxes[0] if powers is None else powers[i]
                k = int(np.argmax(boxes[0]))
                best, depth, width, epoch = boxes[:, k].tolist()
                out[i] = cls(best, float(periods[near[k]]), epoch, width, depth, len(power), float(power.sum()), float((power * power).sum()))
        return out

    def joined(self, later: Peak) -> Peak:
        """This part and one of longer periods; equal powers go to the shorter period."""
        first = self if self.power >= later.power else later
        return Peak(first.power, first.period, first.epoch, first.duration, first.depth, self.n + later.n, self.total + later.total, self.squares + later.squares)

    def sde(self) -> float:
        mean = self.total / max(self.n, 1)
        spread = np.sqrt(max(self.squares / max(self.n, 1) - mean * mean, 0.0))
        return float((self.power - mean) / spread) if spread > 1e-12 * max(self.power, 1e-300) else 0.0


def next_candidate(t: np.ndarray, x: np.ndarray, hidden: np.ndarray, peak: Peak, number: int, least_snr: float) -> tuple[dict | None, np.ndarray, np.ndarray]:
    """(candidate, flux, hidden): the peak as a candidate with its events hidden, or nothing if it isn't one."""
    snr = box_snr(t, x, peak.period, peak.epoch, peak.duration, peak.depth) if peak.power > 0 else 0.0
    if peak.power <= 0 or snr < least_snr:
        return None, x, hidden
    near = phase(t, peak.epoch, peak.period)
    cycle = np.rint((t - peak.epoch) / peak.period).astype(int)
    _, counts = np.unique(cycle[np.abs(near) <= peak.duration / 2], return_counts=True)
    events = int((counts >= 3).sum())
    flags = ["single_event"] if events <= 1 else ["weak_events"] if events < 3 else []
    found = {"candidate": number, "period": peak.period, "epoch": peak.epoch, "duration": peak.duration, "depth": peak.depth, "events": events, "snr": snr, "sde": peak.sde(), "aliases": [round(peak.period / 2, 6), round(2 * peak.period, 6)], "flags": flags}
    mask = np.abs(near) <= 0.75 * peak.duration
    return found, np.where(mask, 1.0, x), hidden | mask


def enough_open(hidden: np.ndarray) -> bool:
    """A search goes on while 100 cadences are open; half of them, if there are fewer than 200."""
    return int((~hidden).sum()) >= min(100, len(hidden) // 2)


def find_candidates(t: np.ndarray, x: np.ndarray, error: np.ndarray | None, most: int, least_snr: float, grid: Grid, fewest: int = 50) -> tuple[list[dict], str]:
    """Up to ``most`` dips of one series, and its status: search, measure, hide, search again; ends below the SNR."""
    baseline = float(np.ptp(t)) if len(t) else 0.0
    if fault := grid.fault(len(t), baseline, fewest):
        return [], fault
    y, hidden, out = x.copy(), np.zeros(len(t), bool), []
    periods, widths = grid.periods(baseline), grid.widths()
    for k in range(most):
        if not enough_open(hidden):
            break
        found, y, hidden = next_candidate(t, y, hidden, Peak.of(t, y, error, periods, widths), k + 1, least_snr)
        if found is None:
            break
        out.append(found)
    return out, "searched"


def first_candidates(t: np.ndarray, xs: np.ndarray, error: np.ndarray | None, least_snr: float, grid: Grid, fewest: int = 50) -> list[tuple[list[dict], str]]:
    """``find_candidates`` for one dip of each of several series (rows) at the same times, folded together."""
    baseline = float(np.ptp(t)) if len(t) else 0.0
    if fault := grid.fault(len(t), baseline, fewest):
        return [([], fault) for _ in xs]
    peaks = Peak.of_all(t, xs, error, grid.periods(baseline), grid.widths())
    found = (next_candidate(t, x, np.zeros(len(t), bool), peak, 1, least_snr)[0] for x, peak in zip(xs, peaks, strict=True))
    return [([f] if f else [], "searched") for f in found]


def lttb(t: np.ndarray, x: np.ndarray, count: int) -> np.ndarray:
    """Indices of the largest-triangle downsample: first, last, and from each bucket the point farthest from its neighbours' line."""
    n = len(t)
    if count >= n or count < 3:
        return np.arange(n)
    edges = np.linspace(1, n - 1, count - 1).astype(int)
    out = [0]
    for k in range(count - 2):
        low, high = edges[k], max(edges[k + 1], edges[k] + 1)
        after = slice(edges[k + 1], edges[k + 2] if k + 2 < len(edges) else n)
        tx, ty = t[after].mean(), x[after].mean()
        a = out[-1]
        area = np.abs((t[a] - tx) * (x[low:high] - x[a]) - (t[a] - t[low:high]) * (ty - x[a]))
        out.append(low + int(np.argmax(area)))
    return np.array([*out, n - 1])


def resolve_overlap(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In the given order of preference: which half-open intervals are kept, and the kept one that each loser meets first.

    A point interval [s, s) meets what covers s.
    """
    import bisect

    starts: list[float] = []
    held: list[tuple[float, int]] = []
    kept, winner = np.zeros(len(begin), bool), np.full(len(begin), -1)
    for i, (s, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        at = bisect.bisect_right(starts, s)
        hit = -1
        if at and (held[at - 1][0] > s or starts[at - 1] == s):
            hit = held[at - 1][1]
        elif at < len(starts) and starts[at] < e:
            hit = held[at][1]
        if hit >= 0:
            winner[i] = hit
            continue
        kept[i] = True
        starts.insert(at, s)
        held.insert(at, (e, i))
    return kept, winner
