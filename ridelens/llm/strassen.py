"""Products of integer matrices by Strassen's recursion."""

from __future__ import annotations

import numpy as np

LEAF = 16


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices, exact: seven products of halves in place of eight, odd sizes padded with zeros."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= LEAF:
        made = np.zeros((rows, columns), np.int64)
        for k in range(inner):
            made += a[:, k, None] * b[k]
        return made
    a, b = _even(a), _even(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = product(a11 + a22, b11 + b22)
    p2 = product(a21 + a22, b11)
    p3 = product(a11, b12 - b22)
    p4 = product(a22, b21 - b11)
    p5 = product(a11 + a12, b22)
    p6 = product(a21 - a11, b11 + b12)
    p7 = product(a12 - a22, b21 + b22)
    made = np.empty((2 * m, 2 * n), np.int64)
    made[:m, :n] = p1 + p4 - p5 + p7
    made[:m, n:] = p3 + p5
    made[m:, :n] = p2 + p4
    made[m:, n:] = p1 - p2 + p3 + p6
    return made[:rows, :columns]


def _even(m: np.ndarray) -> np.ndarray:
    return np.pad(m, [(0, m.shape[0] % 2), (0, m.shape[1] % 2)]) if m.shape[0] % 2 or m.shape[1] % 2 else m
