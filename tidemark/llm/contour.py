"""Eigenpairs of a small symmetric matrix in an interval, by contour integration (FEAST), with inertia counts."""

from __future__ import annotations

import numpy as np

POINTS, ROUNDS, TRIES = 8, 40, 4


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than shift: the inertia of matrix - shift, by LDL^T with symmetric pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    bound, positive, k, n = (1 + 17**0.5) / 8, 0, 0, len(matrix)
    while k < n:
        rest = a[k:, k:]
        column = np.abs(rest[1:, 0])
        low = 1 + int(column.argmax()) if len(column) else 0
        most = column[low - 1] if len(column) else 0.0
        pivot, size = 0, 1
        if most and abs(rest[0, 0]) < bound * most:
            across = np.abs(rest[low])
            across[low] = 0
            other = across.max()
            if abs(rest[0, 0]) * other >= bound * most**2:
                pivot = 0
            elif abs(rest[low, low]) >= bound * other:
                pivot = low
            else:
                pivot, size = low, 2
        to = size - 1
        if pivot != to:
            rest[[to, pivot]] = rest[[pivot, to]]
            rest[:, [to, pivot]] = rest[:, [pivot, to]]
        head, side = rest[:size, :size], rest[size:, :size]
        if size == 2:
            positive += 1  # a pivot of two rows has one value of either sign
            rest[size:, size:] -= side @ np.linalg.solve(head, side.T)
        else:
            positive += head[0, 0] > 0
            if head[0, 0]:
                rest[1:, 1:] -= np.outer(side[:, 0], side[:, 0] / head[0, 0])
        k += size
    return int(positive)


def interval(matrix: np.ndarray, count: int, high: float, least: float, steps: int = 60) -> tuple[float, int]:
    """A lower end, not under least, above which at least count eigenvalues lie, few more if that can be, and how many do."""
    found = above(matrix, least)
    if found <= count:  # all that are not rounding: half of the smallest of them
        low, top = least, high
        for _ in range(steps if found else 0):
            middle = (low * top) ** 0.5
            low, top = (middle, top) if above(matrix, middle) == found else (low, middle)
        return max(least, low / 2), found
    low, top, most = least, high, found
    for _ in range(steps):  # count or more above low, fewer above top
        middle = (low + top) / 2
        if not low < middle < top or most == count:
            break
        n = above(matrix, middle)
        if n >= count:
            low, most = middle, n
        else:
            top = middle
    end = low
    for _ in range(12):  # away from the eigenvalue above it, towards the middle of the gap
        n = above(matrix, (end + top) / 2)
        if n < most:
            top = (end + top) / 2
        else:
            end = (end + top) / 2
    under = least
    for _ in range(12):
        n = above(matrix, (under + low) / 2)
        if n > most:
            under = (under + low) / 2
        else:
            low = (under + low) / 2
    return max(least, (under + end) / 2 if above(matrix, (under + end) / 2) == most else low), most


def feast(matrix: np.ndarray, low: float, high: float, expected: int, tolerance: float = 1e-14, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues between low and high, falling, and their unit eigenvectors as columns.

    A circle through both ends; Gauss-Legendre points on its upper half, the lower half by
    conjugation. Each point is one complex shifted solve against the whole subspace; the sum
    projects on the eigenvalues inside. Rayleigh-Ritz on its range, until residuals vanish.
    Fewer or more values than the inertia count says are tried again with a larger subspace,
    and are an error in the end."""
    n, rng = len(matrix), np.random.default_rng(seed)
    middle, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)
    shifts = middle + radius * np.exp(1j * angles)
    floor = tolerance * max(abs(low), abs(high))
    for attempt in range(TRIES):
        size = min(n, (expected * 3 // 2 + 4) << attempt)
        basis = np.linalg.qr(rng.standard_normal((n, size)))[0]
        best, stalled = np.inf, 0
        for _ in range(ROUNDS):
            moved = np.zeros((n, basis.shape[1]))
            for z, angle, w in zip(shifts, angles, weights, strict=True):
                moved += w / 2 * (radius * np.exp(1j * angle) * np.linalg.solve(z * np.eye(n) - matrix, basis)).real
            basis = np.linalg.qr(moved)[0]
            small = basis.T @ matrix @ basis
            values, inner = np.linalg.eigh((small + small.T) / 2)
            basis = basis @ inner
            inside = np.flatnonzero((values > low) & (values < high))
            residual = np.linalg.norm(matrix @ basis[:, inside] - basis[:, inside] * values[inside], axis=0)
            now = residual.max(initial=0.0)
            stalled = stalled + 1 if now >= best / 2 else 0
            if len(inside) == expected and (now <= floor or (stalled > 2 and now <= 1e3 * floor)):
                order = inside[::-1]
                return values[order], basis[:, order]
            best = min(best, now)
    raise ArithmeticError(f"{expected} eigenvalues lie between {low} and {high}, not all were found")


def largest(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count largest eigenvalues that are positive beyond rounding, falling, and their vectors as columns."""
    matrix = (matrix + matrix.T) / 2
    scale = float(np.trace(matrix)) if len(matrix) else 0.0
    if not scale > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    high = float(np.abs(matrix).sum(1).max()) * (1 + 1e-9)  # no eigenvalue is larger than a row's sum
    least = scale * len(matrix) * 2.0**-50
    low, found = interval(matrix, count, high, least)
    if not found:
        return np.zeros(0), np.zeros((len(matrix), 0))
    values, vectors = feast(matrix, low, high, found)
    return values[:count], vectors[:, :count]
