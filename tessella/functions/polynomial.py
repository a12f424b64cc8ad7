"""Real roots of polynomials, isolated by the roots of the derivative; many of one degree at a time."""

from __future__ import annotations

import numpy as np

#: Roots are looked for from -LIMIT to LIMIT.
LIMIT = 1000.0


def value(p: np.ndarray, x):
    """p[0] + p[1] x + ..."""
    out = 0.0
    for c in p[::-1]:
        out = out * x + c
    return out


def _between(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots in intervals where the sign changes once, by halving until no number lies between; p has a column for each."""
    out, live = np.zeros(len(a)), np.arange(len(a))
    rising = value(p, a) < 0
    while len(live):
        m = a + (b - a) / 2
        done = (m == a) | (m == b)
        if done.any():
            out[live[done]] = m[done]
            p, a, b, m, rising, live = p[:, ~done], a[~done], b[~done], m[~done], rising[~done], live[~done]
        left = (value(p, m) < 0) == rising
        a, b = np.where(left, m, a), np.where(left, b, m)
    return out


def _all(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places for roots in ascending order, and which of them are roots; the columns of p end with a coefficient that isn't 0."""
    size, n = p.shape
    if size < 2:
        return np.zeros((0, n)), np.zeros((0, n), bool)
    if size == 2:
        return -p[:1] / p[1:], ~(np.abs(p[:1]) > LIMIT * np.abs(p[1:]))
    at, found = _all(p[1:] * np.arange(1, size)[:, None])
    cuts = [np.full(n, -LIMIT), *np.sort(np.where(found, at, LIMIT), axis=0), np.full(n, LIMIT)]  # empty places give intervals without inner numbers
    out, some = np.zeros((size - 1, n)), np.zeros((size - 1, n), bool)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        end = value(p, b)
        cross = value(p, a) * end < 0
        out[k] = b
        out[k, cross] = _between(p[:, cross], a[cross], b[cross])
        some[k] = cross | ((end == 0) & ~(some[:k] & (out[:k] == b)).any(axis=0))
    return out, some


def roots_of(p: np.ndarray) -> list[list[float]]:
    """For each row of p the real roots of p[0] + p[1] x + ... in ascending order; one where the curve only touches the axis counts if it is met exactly."""
    p = np.asarray(p, float)
    size = np.where(p != 0, np.arange(1, p.shape[1] + 1), 0).max(axis=1, initial=0)
    out: list[list[float]] = [[] for _ in p]
    for k in np.unique(size[size > 1]):
        rows = np.flatnonzero(size == k)
        with np.errstate(over="ignore", invalid="ignore"):
            at, found = _all(np.ascontiguousarray(p[rows, :k].T))
        for i, x, some in zip(rows.tolist(), at.T.tolist(), found.T.tolist()):
            out[i] = [v for v, is_root in zip(x, some) if is_root]
    return out


def roots(p) -> list[float]:
    """The real roots of one polynomial."""
    return roots_of(np.asarray(p, float)[None])[0]
