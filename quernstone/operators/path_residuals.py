"""NumPy helpers of the spike operator: small, pure, one block of one source's readings at a time."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_REACH = 4  # readings on either side of a run that carry its path


def t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's t quantile: the normal quantile with four Cornish-Fisher terms in 1/df."""
    x = np.fromiter(map(_NORMAL.inv_cdf, np.atleast_1d(p).tolist()), dtype=float)
    n = np.maximum(np.asarray(df, dtype=float), 1.0)
    g1 = (x**3 + x) / 4
    g2 = (5 * x**5 + 16 * x**3 + 3 * x) / 96
    g3 = (3 * x**7 + 19 * x**5 + 17 * x**3 - 15 * x) / 384
    g4 = (79 * x**9 + 776 * x**7 + 1482 * x**5 - 1920 * x**3 - 945 * x) / 92160
    return x + g1 / n + g2 / n**2 + g3 / n**3 + g4 / n**4


def esd_outliers(score: np.ndarray, alpha: float, among: int = 0) -> np.ndarray:
    """Generalised extreme studentised deviate test on scores already centred and scaled robustly.

    The i-th largest score is held against the i-th critical value; all scores up to the last one that exceeds
    its value are outliers. Every score is tried that can be one, which is half of them: beyond that the scale is not
    that of the sound ones. ``among``: number of readings of the whole source, if these are a part of it.
    """
    out = np.zeros(len(score), dtype=bool)
    known = np.flatnonzero(np.isfinite(score))
    n = max(len(known), among)
    if len(known) < 5:
        return out
    order = known[np.argsort(-score[known], kind="stable")][: max(1, len(known) // 2)]
    i = np.arange(1, len(order) + 1)
    t = t_quantile(1 - alpha / (2 * (n - i + 1)), n - i - 1)
    over = np.flatnonzero(score[order] > (n - i) * t / np.sqrt((n - i - 1 + t**2) * (n - i + 1)))
    if len(over):
        out[order[: over[-1] + 1]] = True
    return out


def still_runs(v: np.ndarray, width: float, least: int) -> np.ndarray:
    """Readings that hang: at least ``least`` in a row within ``width`` of the first, which is not marked itself.

    NaN readings are stepped over. Only stretches whose neighbours lie within twice the width are looked at.
    """
    out = np.zeros(len(v), dtype=bool)
    known = np.flatnonzero(np.isfinite(v))
    if len(known) < least:
        return out
    x = v[known]
    near = np.abs(np.diff(x)) <= 2 * width + 1e-9
    edge = np.flatnonzero(np.diff(np.concatenate(([0], near.view(np.int8), [0]))))
    for lo, hi in zip(edge[::2], edge[1::2]):  # near[lo:hi] joins x[lo..hi]
        at = lo
        while hi - at + 1 >= least:
            off = np.flatnonzero(np.abs(x[at : hi + 1] - x[at]) > width + 1e-9)
            end = at + (off[0] if len(off) else hi - at + 1)
            if end - at >= least:
                out[known[at + 1 : end]] = True
                at = end
            else:
                at += 1
    return out


def _solve(t: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted least-squares parabolas, one per row; rows with few or badly placed points fall back to ridge."""
    m = np.stack([np.ones_like(t), t, t * t], axis=-1)
    a = np.einsum("nk,nki,nkj->nij", w, m, m)
    b = np.einsum("nk,nki,nk->ni", w, m, np.where(w > 0, v, 0.0))
    a[:, [0, 1, 2], [0, 1, 2]] += np.array([1e-9, 1e-9, 1e-6])
    return np.linalg.solve(a, b[..., None])[..., 0]


def chord_gap(t: np.ndarray, v: np.ndarray, length: int) -> np.ndarray:
    """Least distance of each run of ``length`` readings from the chord between the readings beside it (NaN at ends)."""
    n = len(v)
    out = np.full(n, np.nan)
    at = np.arange(1, n - length)
    if len(at) == 0:
        return out
    t0, t1, v0, v1 = t[at - 1], t[at + length], v[at - 1], v[at + length]
    run = at[:, None] + np.arange(length)[None, :]
    part = (t[run] - t0[:, None]) / np.where(t1 > t0, t1 - t0, 1.0)[:, None]
    out[at] = np.abs(v[run] - (v0[:, None] + part * (v1 - v0)[:, None])).min(axis=1)
    return out


def path_gap(t: np.ndarray, v: np.ndarray, sigma: float, length: int, at: np.ndarray, times: float) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of the runs starting at ``at`` from the path that the readings around them follow, and the share of
    those readings that lie on it.

    Up to ``_REACH`` readings on both sides of a run carry the path: a Theil-Sen line picks the sound ones, a parabola
    through those is the robust local trend. NaN where a side has no reading, where the readings around the run do not
    follow one path (a step, a gap with a turn in it), or where the reading right before or after the run is off the path
    by ``times`` sigma as well (the run is then part of a longer one).
    """
    n = len(v)
    out, share = np.full(len(at), np.nan), np.zeros(len(at))
    keep = np.flatnonzero((at >= 1) & (at + length + 1 <= n))
    if len(keep) == 0 or not sigma > 0:
        return out, share
    at = at[keep]
    side = np.concatenate([np.arange(-_REACH, 0), np.arange(length, length + _REACH)])
    idx = at[:, None] + side[None, :]
    there = (idx >= 0) & (idx < n)
    idx = np.clip(idx, 0, n - 1)
    mid = (t[at - 1] + t[at + length]) / 2
    tt, vv = t[idx] - mid[:, None], v[idx]
    base = np.nanmedian(np.where(there, vv, np.nan), axis=1)
    vv = vv - base[:, None]
    i, j = np.triu_indices(2 * _REACH, 1)
    gap = tt[:, j] - tt[:, i]
    usable = there[:, i] & there[:, j] & (np.abs(gap) > 1e-9)
    usable[:, 0] |= ~usable.any(axis=1)  # readings of one instant: no slope
    slope = np.where(usable, (vv[:, j] - vv[:, i]) / np.where(np.abs(gap) > 1e-9, gap, np.inf), np.nan)
    b = np.nanmedian(slope, axis=1)
    a = np.nanmedian(np.where(there, vv - b[:, None] * tt, np.nan), axis=1)
    res = np.abs(vv - a[:, None] - b[:, None] * tt)
    bound = np.maximum(6 * sigma, 4 * np.nanmedian(np.where(there, res, np.nan), axis=1))
    for _ in range(3):
        coef = _solve(tt, vv, (there & (res <= bound[:, None])).astype(float))
        res = np.abs(vv - (coef[:, :1] + coef[:, 1:2] * tt + coef[:, 2:] * tt * tt))
        bound = np.full(len(at), 5 * sigma)
    good = there & (res <= 5 * sigma)
    follows = good.sum(1) >= np.maximum(5, there.sum(1) - 3)
    for half in (slice(None, _REACH), slice(_REACH, None)):
        follows &= good[:, half].sum(1) >= np.minimum(2, there[:, half].sum(1))
    follows &= (res[:, _REACH - 1] <= times * sigma) & (res[:, _REACH] <= times * sigma)
    run = at[:, None] + np.arange(length)[None, :]
    tr = t[run] - mid[:, None]
    rem = v[run] - base[:, None] - (coef[:, :1] + coef[:, 1:2] * tr + coef[:, 2:] * tr * tr)
    out[keep] = np.where(follows, np.abs(rem).min(axis=1), np.nan)
    share[keep] = good.sum(1) / there.sum(1)
    return out, share


def season_of(v: np.ndarray, phase: np.ndarray, period: int) -> np.ndarray:
    """Seasonal part: for each phase the median distance of its readings from the moving average over one period.

    A season counts only where a phase stands out from the scatter of those distances by more than four standard errors of
    its median; otherwise there is none and the part is 0.
    """
    if period < 2 or len(v) < 4 * period:
        return np.zeros(len(v))
    taps = np.ones(period) if period % 2 else np.concatenate(([0.5], np.ones(period - 1), [0.5]))
    inner = np.convolve(v, taps / period, mode="valid")
    lead = len(taps) // 2
    off, of_phase = v[lead : lead + len(inner)] - inner, phase[lead : lead + len(inner)]
    order = np.argsort(of_phase, kind="stable")
    parts = np.split(off[order], np.searchsorted(of_phase[order], np.arange(1, period)))
    if min(map(len, parts)) < 3:
        return np.zeros(len(v))
    by_phase = np.array([np.median(x) for x in parts])
    spread = np.median(np.abs(off - by_phase[of_phase])) / 0.6745
    error = 1.2533 * spread / np.sqrt(min(map(len, parts)))
    by_phase = by_phase - by_phase.mean()
    return by_phase[phase] if np.abs(by_phase).max() > 4 * error else np.zeros(len(v))


def spikes(t: np.ndarray, v: np.ndarray, sigma: float, times: float, longest: int, alpha: float, among: int = 0) -> np.ndarray:
    """Readings of runs of at most ``longest`` that stand off the path by more than ``times`` sigma.

    A run counts only if the deviate test also calls its remainder an outlier among all readings. Of the runs within reach
    of each other the one whose surroundings follow the path best is taken, then the farthest; it is taken out and the
    rest is looked at again until nothing is found, so that close spikes neither hide nor fake each other.
    """
    found = np.zeros(len(v), dtype=bool)
    if not sigma > 0:
        return found
    while True:
        left = np.flatnonzero(~found)
        tl, vl = t[left], v[left]
        score = np.nan_to_num(chord_gap(tl, vl, 1) / sigma)
        runs: list[tuple[float, float, int, int]] = []
        for length in range(1, longest + 1):
            at = np.flatnonzero(np.nan_to_num(chord_gap(tl, vl, length)) > times / 2 * sigma)
            if len(at):
                far, share = path_gap(tl, vl, sigma, length, at, times)
                for a, f, s in zip(at.tolist(), (far / sigma).tolist(), share.tolist()):
                    if f > times:
                        runs.append((-s, -f, a, length))
                        score[a : a + length] = np.maximum(score[a : a + length], f)
        if not runs:
            return found
        odd = esd_outliers(score, alpha, among)
        near = np.zeros(len(left), dtype=bool)
        new = []
        for _, _, a, length in sorted(runs):
            if odd[a : a + length].all() and not near[a : a + length].any():
                near[max(0, a - _REACH) : a + length + _REACH] = True
                new.append(left[a : a + length])
        if not new:
            return found
        found[np.concatenate(new)] = True
