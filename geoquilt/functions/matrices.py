"""Small dense helpers: random, Hilbert and positive definite matrices, norms and updates."""

from __future__ import annotations

import numpy as np


def random_matrix(rows: int, columns: int, seed: int = 0) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).random((rows, columns))


def hilbert(rows: int, columns: int, scale: float = 1.0) -> np.ndarray:
    return scale / (np.arange(rows)[:, None] + np.arange(columns)[None, :] + 1)


def make_hpd(a: np.ndarray) -> np.ndarray:
    """Symmetric with a dominant diagonal."""
    a = (a + a.T) / 2
    return a + np.eye(len(a)) * len(a)


def max_norm(a: np.ndarray) -> float:
    """The largest absolute entry; nan if any is."""
    return float(np.max(np.abs(a))) if a.size else 0.0


def axpy(alpha: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y + alpha * x


def magnitude(a: complex) -> float:
    return float(np.hypot(a.real, a.imag))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
