"""Pure NumPy geometry and assignment kernels, called on batches of pairs or on bounded groups."""

from __future__ import annotations

import numpy as np


def rectangle_corners(boxes: np.ndarray) -> np.ndarray:
    """(n, 4, 2) corners, counter-clockwise, of rectangles (x, y, length, width, yaw)."""
    sx, sy = np.array([0.5, -0.5, -0.5, 0.5]), np.array([0.5, 0.5, -0.5, -0.5])
    x, y = boxes[:, 2:3] * sx, boxes[:, 3:4] * sy
    c, s = np.cos(boxes[:, 4:5]), np.sin(boxes[:, 4:5])
    return np.stack([boxes[:, 0:1] + x * c - y * s, boxes[:, 1:2] + x * s + y * c], axis=-1)


def paired_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common area of row i of ``a`` and row i of ``b`` (x, y, length, width, yaw), all pairs at once.

    Rectangle ``a``, seen from ``b``'s own axes, is clipped by ``b``'s four sides one after the other; each side adds at most
    one corner, so eight places hold the polygon of every pair. Its area is half the sum of cross products.
    """
    n = len(a)
    if not n:
        return np.zeros(0)
    c, s = np.cos(b[:, 4]), np.sin(b[:, 4])
    d = rectangle_corners(a) - b[:, None, :2]
    x, y = np.zeros((n, 8)), np.zeros((n, 8))
    x[:, :4], y[:, :4] = d[..., 0] * c[:, None] + d[..., 1] * s[:, None], d[..., 1] * c[:, None] - d[..., 0] * s[:, None]
    count, rows, places = np.full(n, 4), np.arange(n)[:, None], np.arange(8)[None, :]
    for axis, sign in ((0, 1.0), (0, -1.0), (1, 1.0), (1, -1.0)):
        after = (places + 1) % np.maximum(count, 1)[:, None]
        depth = b[:, 2 + axis, None] / 2 - sign * (x, y)[axis]  # not negative: on the inner side
        far, fx, fy = depth[rows, after], x[rows, after], y[rows, after]
        there = places < count[:, None]
        stays, crosses = there & (depth >= 0), there & ((depth >= 0) != (far >= 0))
        part = depth / np.where(crosses, depth - far, 1.0)
        # every corner gives itself if it stays and the crossing behind it; both in order
        keep = np.stack([stays, crosses], axis=2).reshape(n, 16)
        px = np.stack([x, x + part * (fx - x)], axis=2).reshape(n, 16)
        py = np.stack([y, y + part * (fy - y)], axis=2).reshape(n, 16)
        order = np.argsort(~keep, axis=1, kind="stable")[:, :8]
        count = np.minimum(keep.sum(axis=1), 8)
        x, y = np.take_along_axis(px, order, axis=1), np.take_along_axis(py, order, axis=1)
    after = (places + 1) % np.maximum(count, 1)[:, None]
    cross = np.where(places < count[:, None], x * y[rows, after] - y * x[rows, after], 0.0)
    return np.where(count >= 3, np.abs(cross.sum(axis=1)) / 2, 0.0)


def paired_iou(a: np.ndarray, b: np.ndarray, over: str = "union") -> np.ndarray:
    """Common area of pairs over their ``union``, over the ``first`` or the ``second`` rectangle, or the ``area`` itself."""
    common = paired_overlap(a, b)
    if over == "area":
        return common
    one, two = a[:, 2] * a[:, 3], b[:, 2] * b[:, 3]
    by = {"union": one + two - common, "first": one, "second": two}[over]
    return np.divide(common, by, out=np.zeros(len(common)), where=by > 0)


def cheapest_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, dtype=int)  # 0: free, else row + 1
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            r = row_of[j]
            slack = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], j
            open_ = np.where(used[1:], np.inf, least[1:])
            j1 = int(np.argmin(open_)) + 1
            step = open_[j1 - 1]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j = j1
            if row_of[j] == 0:
                break
        while j:
            row_of[j], j = row_of[back[j]], back[j]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def pair_components(i: np.ndarray, j: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Component of each row in the graph of the pairs (i, j), named by its smallest row; every row has a pair."""
    of_row = np.arange(rows)
    while True:
        of_column = np.full(columns, rows)
        np.minimum.at(of_column, j, of_row[i])
        least = of_row.copy()
        np.minimum.at(least, i, of_column[j])
        if (least == of_row).all():
            return of_row
        of_row = least


def farthest_points(xyz: np.ndarray, count: int) -> np.ndarray:
    """Indices of farthest point sampling that starts at the first point; ties to the lower index."""
    count = min(count, len(xyz))
    picked = np.zeros(count, dtype=int)
    far = np.full(len(xyz), np.inf)
    for i in range(1, count):
        far = np.minimum(far, ((xyz - xyz[picked[i - 1]]) ** 2).sum(axis=1))
        picked[i] = int(np.argmax(far))
    return picked


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)


def pair_blocks(frames_a: np.ndarray, xa: np.ndarray, frames_b: np.ndarray, xb: np.ndarray, reach: float, group: np.ndarray, most: int = 300_000):
    """Blocks (i, j) of all pairs of rows of one frame whose ``x`` differ by at most ``reach`` (some differ by a trifle more).

    Frames rise along the rows. The pairs are in the order of i; rows of one ``group``, which lie together, stay in one block. A block
    has at most ``most`` pairs, or those of one group.
    """
    order = np.lexsort((xb, frames_b))
    x = xb[order]
    first = run_starts(frames_a)
    names, last = frames_a[first], np.append(first[1:], len(frames_a))
    slack = reach + 1e-9 * (np.abs(xa) + reach)
    low, high = xa - slack, xa + slack
    lo, hi = np.zeros(len(xa), dtype=np.int64), np.zeros(len(xa), dtype=np.int64)
    for s, e, p, q in zip(first.tolist(), last.tolist(), np.searchsorted(frames_b, names).tolist(), np.searchsorted(frames_b, names, "right").tolist()):
        lo[s:e] = x[p:q].searchsorted(low[s:e]) + p
        hi[s:e] = x[p:q].searchsorted(high[s:e], "right") + p
    n = hi - lo
    upto = np.concatenate(([0], np.cumsum(n)))
    ends = np.append(run_starts(group)[1:], len(group))
    at, k = 0, 0
    while at < len(xa):
        k = max(k, int(np.searchsorted(upto[ends], upto[at] + most, "right")) - 1)
        end = int(ends[k])
        of = n[at:end]
        if upto[end] > upto[at]:
            i = np.repeat(np.arange(at, end), of)
            j = order[np.arange(upto[end] - upto[at]) + np.repeat(lo[at:end] - (upto[at:end] - upto[at]), of)]
            yield i, j
        at, k = end, k + 1


def reached_pairs(group: np.ndarray, x: np.ndarray, reach: np.ndarray, most: int = 300_000):
    """Blocks (i, j) of all pairs of rows of one group, each once, whose ``x`` differ by at most the larger ``reach`` of both, which is i's.

    A row of wide reach doesn't widen the search of the others. A block has some more than ``most`` pairs at most.
    """
    order = np.lexsort((x, group))
    group, x, reach = group[order], x[order], reach[order]
    some, held = [], 0
    for step in (1, -1):
        at, lag = np.arange(len(x)), 0
        while True:
            lag += step
            at = at[(at + lag >= 0) & (at + lag < len(x))]
            at = at[(group[at + lag] == group[at]) & (np.abs(x[at + lag] - x[at]) <= reach[at])]
            if not len(at):
                break
            i = at[(reach[at] > reach[at + lag]) | ((reach[at] == reach[at + lag]) & (step > 0))]
            some.append((order[i], order[i + lag]))
            held += len(i)
            if held > most:
                yield tuple(np.concatenate(p) for p in zip(*some))
                some, held = [], 0
    if held:
        yield tuple(np.concatenate(p) for p in zip(*some))


def least(value: np.ndarray, tie: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(runs, n) places of the ``n`` least finite (value, tie) of every run, -1 where a run has no more."""
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(value))))
    value, out = value.copy(), np.full((len(starts), n), -1)
    for k in range(n if len(value) else 0):
        at = np.flatnonzero((value == np.minimum.reduceat(value, starts)[run]) & np.isfinite(value))
        at = at[np.lexsort((tie[at], run[at]))]
        at = at[run_starts(run[at])]
        out[run[at], k] = at
        value[at] = np.inf
    return out
