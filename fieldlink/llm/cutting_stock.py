"""The cutting-stock problem over a histogram of lengths, by column generation."""

from __future__ import annotations

import numpy as np


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of a matrix and a vector (either order) by numpy's own loops.

    The threads of a BLAS library can block for ever in a driver process that
    has forked (seen with ``numpy.linalg.inv`` beside a running JVM gateway).
    """
    return np.einsum("ij,j->i", a, b) if a.ndim == 2 else np.einsum("i,ij->j", a, b)


def inverted(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting."""
    n = len(a)
    w = np.hstack([a.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.argmax(np.abs(w[k:, k])))
        if p != k:
            w[[k, p]] = w[[p, k]]
        w[k] /= w[k, k]
        f = w[:, k].copy()
        f[k] = 0
        w -= np.multiply.outer(f, w[k])
    return w[:, n:]


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of largest worth: an unbounded knapsack by dynamic programming over the room."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        fits = np.searchsorted(sizes, r, side="right")
        if fits:
            worth = duals[:fits] + best[r - sizes[:fits]]
            k = int(np.argmax(worth))
            if worth[k] > best[r] + 1e-12:
                best[r], take[r] = worth[k], k
    pattern, r = np.zeros(len(sizes)), room
    while r > 0:
        if take[r] < 0:
            r -= 1
        else:
            pattern[take[r]] += 1
            r -= sizes[take[r]]
    return float(best[room]), pattern


def solve(sizes: np.ndarray, counts: np.ndarray, room: int, steps: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the linear program's (fractional) solution.

    Minimises the number of bins so that every size is covered. Revised
    simplex: the basis starts with one pattern per size; the knapsack prices
    columns; a size with a negative dual gets a surplus column instead.
    Stopped after ``steps`` pivots the solution is feasible, if not the best.
    """
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    cost, inverse = np.ones(m), np.diag(1.0 / (room // sizes))
    for step in range(steps):
        if step % 200 == 199:
            inverse = inverted(basis)
        x = np.maximum(times(inverse, counts), 0.0)
        duals = times(cost, inverse)
        low = int(np.argmin(duals))
        if duals[low] < -1e-9:
            column, c = -np.eye(m)[low], 0.0
        else:
            worth, column = price(np.maximum(duals, 0.0), sizes, room)
            c = 1.0
            if worth <= 1 + 1e-7:
                break
        d = times(inverse, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1.0), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], cost[out] = column, c
        pivot = inverse[out] / d[out]
        inverse = inverse - np.outer(d, pivot)
        inverse[out] = pivot
    x = np.maximum(times(inverted(basis), counts), 0.0)
    return [(basis[:, k], float(x[k])) for k in range(m) if cost[k] and x[k] > 1e-9]


def best_fit(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[np.ndarray]:
    """Bins for the items left over by rounding: largest first, into the fullest bin that has room."""
    bins: list[np.ndarray] = []
    free: list[list[int]] = [[] for _ in range(room + 1)]
    for k in np.argsort(-sizes, kind="stable"):
        for _ in range(int(counts[k])):
            r = next((r for r in range(int(sizes[k]), room + 1) if free[r]), None)
            if r is None:
                bins.append(np.zeros(len(sizes)))
                n, r = len(bins) - 1, room
            else:
                n = free[r].pop()
            bins[n][k] += 1
            free[r - int(sizes[k])].append(n)
    return bins


def patterns(histogram: dict[int, int], room: int) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Whole patterns with multiplicities that cover the histogram (size -> items); the sizes in order.

    The linear program's uses are rounded down. What they leave is at most one
    pattern's items per basis column, whatever the counts, and goes to
    best-fit bins.
    """
    sizes = np.array(sorted(histogram), int)
    if not len(sizes):
        return sizes, []
    counts = np.array([histogram[s] for s in sizes], float)
    used, left = [], counts.copy()
    for pattern, x in solve(sizes, counts, room):
        if n := int(np.floor(x + 1e-6)):
            used.append((pattern, n))
            left -= pattern * n
    used += [(b, 1) for b in best_fit(sizes, np.maximum(np.rint(left), 0), room)]
    return sizes, used
