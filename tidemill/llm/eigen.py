"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, Sturm bisection, inverse iteration.

The matrix has as many rows as a vector has entries, whatever the number of vectors, so it is worked on by the driver.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues closer than this share of the matrix's size are a cluster, whose vectors are made orthogonal.
_CLUSTER = 1e-3
_ROUNDS = 5


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as rows.

    An eigenvector's largest entry is positive.  Eigenvalues that cannot be told from zero in double precision are left out,
    so a matrix of zeros has none.
    """
    size = float(np.abs(matrix).max(initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, beside, reflectors = tridiagonal(matrix / size)
    values = bisect(diagonal, beside, min(count, len(diagonal)))
    values = values[values > 64 * len(diagonal) * _EPS * values.max(initial=0.0)]
    vectors = np.array([reflected(y, reflectors) for y in inverse_iteration(diagonal, beside, values)]).reshape(len(values), -1)
    top = vectors[np.arange(len(values)), np.abs(vectors).argmax(axis=1)]
    return values * size, vectors * np.where(top < 0, -1.0, 1.0)[:, None]


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, and the unit vectors of the reflections that lead there."""
    a = np.array(matrix, np.float64)
    n = len(a)
    beside = np.zeros(max(n - 1, 0))
    reflectors: list[np.ndarray | None] = []
    for k in range(n - 2):
        column = a[k + 1 :, k]
        if not np.any(column[1:]):
            beside[k] = column[0]
            reflectors.append(None)
            continue
        beside[k] = -math.copysign(float(np.linalg.norm(column)), column[0])
        v = column.copy()
        v[0] -= beside[k]
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        q = 2 * (p - (p @ v) * v)
        rest -= np.outer(v, q) + np.outer(q, v)
        reflectors.append(v)
    if n > 1:
        beside[-1] = a[-1, -2]
    return np.diagonal(a).copy(), beside, reflectors


def reflected(y: np.ndarray, reflectors: list[np.ndarray | None]) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the matrix it was made from."""
    out = y.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        if (v := reflectors[k]) is not None:
            out[k + 1 :] -= 2 * (v @ out[k + 1 :]) * v
    return out / np.linalg.norm(out)


def below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are below each of ``at``, by the signs of the pivots."""
    least = np.finfo(np.float64).tiny / _EPS
    squares = [0.0, *(beside * beside).tolist()]
    pivot = np.ones(len(at))
    count = np.zeros(len(at), np.int64)
    for d, square in zip(diagonal.tolist(), squares, strict=True):
        pivot = d - at - square / pivot
        pivot[np.abs(pivot) < least] = -least
        count += pivot < 0
    return count


def bisect(diagonal: np.ndarray, beside: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(beside)]) + np.concatenate([np.abs(beside), [0.0]])
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    slack = 2 * _EPS * max(abs(low[0]), abs(high[0]), 1e-300)
    low, high = low - slack, high + slack
    fewer = n - 1 - np.arange(count)  # eigenvalues below the wanted one
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high) & (high - low > _EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            return middle
        over = below(diagonal, beside, middle) > fewer
        high = np.where(open_ & over, middle, high)
        low = np.where(open_ & ~over, middle, low)


def _factored(diagonal: np.ndarray, beside: np.ndarray, value: float, least: float):
    """Gaussian elimination of the shifted matrix with row exchanges."""
    main, up = (diagonal - value).tolist(), [*beside.tolist(), 0.0]
    up2, steps = [0.0] * len(main), []
    for i, low in enumerate(beside.tolist()):
        if abs(main[i]) >= abs(low):
            main[i] = main[i] or least
            factor = low / main[i]
            main[i + 1] -= factor * up[i]
            steps.append((False, factor))
        else:
            factor = main[i] / low
            main[i], up[i], main[i + 1] = low, main[i + 1], up[i] - factor * main[i + 1]
            up2[i], up[i + 1] = up[i + 1], -factor * up[i + 1]
            steps.append((True, factor))
    return [x if abs(x) > least else math.copysign(least, x) for x in main], up, up2, steps


def _solved(factors, right: np.ndarray) -> np.ndarray:
    main, up, up2, steps = factors
    b = right.tolist()
    for i, (exchanged, factor) in enumerate(steps):
        if exchanged:
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            b[i + 1] -= factor * b[i]
    x = [0.0] * (len(b) + 2)
    for i in range(len(b) - 1, -1, -1):
        x[i] = (b[i] - up[i] * x[i + 1] - up2[i] * x[i + 2]) / main[i]
    return np.array(x[:-2])


def inverse_iteration(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Unit eigenvectors of the tridiagonal matrix for falling eigenvalues; those of a cluster are kept orthogonal."""
    size = max(float(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(beside).max(initial=0.0)), 1e-300)
    random = np.random.default_rng(11)
    found: list[np.ndarray] = []
    first, shift = 0, math.inf
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > _CLUSTER * size:
            first = k
        # Equal eigenvalues are told apart by a few units in the last place.
        shift = min(value, shift - 10 * _EPS * size) if k > first else value
        factors = _factored(diagonal, beside, shift, _EPS * size)
        y = random.standard_normal(len(diagonal))
        for _ in range(_ROUNDS):
            y = _solved(factors, y / np.abs(y).max())
            for _ in range(2):
                for other in found[first:k]:
                    y = y - (other @ y) * other
            y /= np.linalg.norm(y)
        found.append(y)
    return found
