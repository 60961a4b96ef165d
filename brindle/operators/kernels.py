"""The few computations that frames and aggregates don't express: one-dimensional linkage, peaks, GARCH. Pure numpy on one small group each."""

from __future__ import annotations

import heapq

import numpy as np


def linkage_1d(values: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage clusters of numbers, merged while the closest two are nearer than threshold.

    In one dimension clusters stay runs of the sorted values and their average distance is that of their means, so only
    neighbours are compared: a heap holds the gaps of a linked list of clusters, and gaps that a merge has changed are
    passed over when they come up. Of equal gaps the leftmost is closed first.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    total, size = [float(v) for v in np.asarray(values, float)[order]], [1] * n  # of the cluster that begins at a place
    after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap = [(total[i + 1] - total[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    begins = np.ones(n, bool)
    while heap and heap[0][0] < threshold:
        _, i, vi, vj = heapq.heappop(heap)
        j = after[i]
        if not begins[i] or j >= n or version[i] != vi or version[j] != vj:
            continue
        total[i], size[i], after[i], version[i] = total[i] + total[j], size[i] + size[j], after[j], version[i] + 1
        begins[j] = False
        version[j] = -1
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n:
                heapq.heappush(heap, (total[right] / size[right] - total[left] / size[left], left, version[left], version[right]))
    out = np.zeros(n, np.int64)
    out[order] = np.cumsum(begins) - 1
    return out


def _lowest_before_higher(y: np.ndarray) -> np.ndarray:
    """For each place the lowest value from it back to the nearest higher one (or the start), by a stack of falling values."""
    out, stack = np.empty(len(y)), []
    for i, v in enumerate(y.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        out[i] = low
        stack.append((v, low))
    return out


def peaks(y: np.ndarray, least_prominence: float) -> np.ndarray:
    """Places of strict local maxima (the middle of a plateau) whose prominence reaches the bound. Linear in the length."""
    y = np.asarray(y, float)
    if len(y) < 3:
        return np.empty(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))  # of plateaus
    level = y[begin]
    end = np.append(begin[1:], len(y)) - 1
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    base = np.maximum(_lowest_before_higher(level), _lowest_before_higher(level[::-1])[::-1])
    top = top[level[top] - base[top] >= least_prominence]
    return (begin[top] + end[top]) // 2


#: The grid search of GARCH: points an axis, rounds, and the first grid's middle and half width for log omega (over the sample variance), alpha and beta.
GRID, GRID_ROUNDS, GRID_CENTRE, GRID_SPAN = 9, 14, (-2.5, 0.3, 0.6), (4.5, 0.3, 0.4)


def decayed(x: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """For each rate the sums s with s[0] = 0 and s[t + 1] = x[t] + rate * s[t], by doubling the reach of the sums."""
    out, reach, power = np.tile(np.asarray(x, float), (len(rates), 1)), 1, np.asarray(rates, float)[:, None]
    while reach < len(x):
        out[:, reach:] = out[:, reach:] + power * out[:, :-reach]
        reach, power = 2 * reach, power * power
    return np.concatenate([np.zeros((len(rates), 1)), out], 1)


def garch_next_variance(returns: np.ndarray, rounds: int = GRID_ROUNDS) -> float:
    """Variance of the next return under a zero-mean GARCH(1,1), fitted by maximum likelihood over omega, alpha and beta.

    The likelihood of a whole grid of parameters is run through the returns at once; the grid then shrinks around its
    best point. omega goes by its share of the sample variance, on a logarithmic scale.
    """
    r2 = np.square(returns)
    target = float(r2.mean()) if len(r2) else 0.0
    if target <= 0:
        return target

    def path(omega: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, loss = np.full(len(a), target), np.zeros(len(a))
        for x in r2:
            loss += np.log(h) + x / h
            h = omega + a * x + b * h
        return loss, h

    centre, span, best = np.array(GRID_CENTRE), np.array(GRID_SPAN), target
    for _ in range(rounds):
        grid = [np.linspace(c - s, c + s, GRID) for c, s in zip(centre, span)]
        w, a, b = (x.ravel() for x in np.meshgrid(*grid))
        ok = (a >= 0) & (b >= 0) & (a + b < 1)
        w, a, b = w[ok], a[ok], b[ok]
        loss, h = path(target * np.exp(w), a, b)
        at = int(np.argmin(np.round(loss / len(r2), 10)))  # so that the order of a sum doesn't decide between equal points
        moved = np.abs(np.array([w[at], a[at], b[at]]) - centre) > 0.6 * span
        centre, span, best = np.array([w[at], a[at], b[at]]), np.where(moved, span, span / 2), float(h[at])
    return best
