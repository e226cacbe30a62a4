"""The largest eigenvalues of a symmetric matrix by contour integration (FEAST), counted by inertia.

By Sylvester's law of inertia the pivots of a symmetric factorization of A - s * I have the signs of A's eigenvalues less
s. One reduction to a tridiagonal matrix makes each such count a single pass over it. Counts place interval borders, so
that intervals hold few eigenvalues each, and say how many an interval must yield.
Inside an interval the spectral projector is the integral of (z * I - A)^-1 over a circle through its ends; a quadrature
of shifted solves applies it to a block of vectors, a Rayleigh-Ritz step extracts eigenpairs from what comes out, and
both repeat until residuals are at rounding level.
"""

from __future__ import annotations

import numpy as np

#: Nodes on the upper half of the circle; the lower half is conjugate.
NODES = 8
#: Eigenvalues of an interval, unless they lie too close together to be parted.
PER_INTERVAL = 8
ROUNDS = 30
EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with the eigenvalues of `a`, by Householder reflections."""
    m = a.copy()
    side = np.zeros(max(0, len(m) - 1))
    for k in range(len(m) - 2):
        x = m[k + 1 :, k]
        length = np.linalg.norm(x)
        side[k] = length
        if length == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = m[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
    if len(m) > 1:
        side[-1] = m[-1, -2]
    return np.diag(m).copy(), side


def above(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues of a tridiagonal matrix are above `shift`: positive pivots of T - shift * I = L * D * L'."""
    positive, pivot = 0, 1.0
    for diagonal, before in zip(t[0].tolist(), [0.0, *(t[1] ** 2).tolist()], strict=True):
        pivot = diagonal - shift - before / pivot
        if abs(pivot) < EPS * EPS:
            pivot = -EPS * EPS
        positive += pivot > 0
    return positive


def _project(a: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block's part in the eigenvectors of (low, high), but for the quadrature's error."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for angle, weight in zip(np.pi * (x + 1) / 2, w, strict=True):
        turn = np.exp(1j * angle)
        out += weight / 2 * np.real(radius * turn * np.linalg.solve((middle + radius * turn) * np.eye(len(a)) - a, block.astype(complex)))
    return out


def interval(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues in (low, high), falling, and their vectors as columns."""
    d, norm, rng = len(a), np.linalg.norm(a, 2), np.random.default_rng(13)
    for extra in (max(4, count // 2), 2 * count + 8, d):
        size = min(d, count + extra)
        block, best = rng.standard_normal((d, size)), np.inf
        for _ in range(ROUNDS):
            # What is outside of the contour shrinks to rounding level and goes.
            u, s, _ = np.linalg.svd(_project(a, low, high, block), full_matrices=False)
            q = u[:, s > s[0] * EPS]
            values, turns = np.linalg.eigh(q.T @ a @ q)
            vectors = q @ turns
            inside = np.flatnonzero((values > low) & (values < high))[::-1]
            found = values[inside], vectors[:, inside]
            if len(inside) >= count:
                residual = np.abs(a @ found[1] - found[1] * found[0]).max()
                if len(inside) == count and (residual <= 4 * EPS * norm or residual > best / 2 and residual <= 1e3 * EPS * norm):
                    return found
                best = min(best, residual)
            block = vectors if vectors.shape[1] == size else np.hstack([vectors, rng.standard_normal((d, size - vectors.shape[1]))])
    raise ArithmeticError(f"{len(inside)} of {count} eigenvalues found between {low} and {high}")


def _border(t: tuple[np.ndarray, np.ndarray], low: float, high: float) -> tuple[float, int] | None:
    """A border between low and high that has no eigenvalue next to it, and how many are above it; None: none is there."""
    if high - low <= 1e-8 * high:
        return None
    for share in (0.5, 0.47, 0.53, 0.41, 0.59, 0.33, 0.67):
        at = low + share * (high - low)
        n = above(t, at)
        if above(t, at * (1 - 1e-10)) == n == above(t, at * (1 + 1e-10)):
            return at, n
    return None


def largest(a: np.ndarray, wanted: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """At most `wanted` largest eigenvalues above floor * trace (falling), and their unit vectors as columns.

    Where no eigenvalue is above it, none. Equal eigenvalues get some orthogonal vectors of their space.
    """
    d, trace = len(a), float(np.trace(a))
    none = np.empty(0), np.empty((d, 0))
    if not trace > 0:
        return none
    a = a / trace
    high, low = 1.0 + 1e-6, floor
    t = tridiagonal(a)
    total = above(t, low)
    if not total:
        return none
    wanted = min(wanted, total)
    # The lowest border that leaves enough above it, and not many more unless they lie together.
    top, n = high, total
    while n > wanted + 2 and (border := _border(t, low, top)):
        if border[1] >= wanted:
            low, n = border
        else:
            top = border[0]
    parts, todo = [], [(low, high, n, 0)]
    while todo:
        lo, hi, below, over = todo.pop()
        border = _border(t, lo, hi) if below - over > PER_INTERVAL else None
        if border:
            todo += [x for x in ((lo, border[0], below, border[1]), (border[0], hi, border[1], over)) if x[2] > x[3]]
        else:
            parts.append(interval(a, lo, hi, below - over))
    # One Rayleigh-Ritz step over all intervals makes their vectors orthogonal to rounding level.
    q, _ = np.linalg.qr(np.hstack([v for _, v in parts]))
    values, turns = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-values)[:wanted]
    found = values[order], (q @ turns)[:, order]
    if len(order) < wanted or above(t, found[0][-1] * (1 - 1e-9) - EPS) < wanted:
        raise ArithmeticError("eigenvalues are missing")
    return found[0] * trace, found[1]
