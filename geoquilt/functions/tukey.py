"""Tukey's g-and-h transform of a Gaussian value, its inverse and its slope, for arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tukey:
    """z = xi + omega (exp(g u) - 1) / g exp(h u**2 / 2): g skews, h >= 0 makes tails heavy; g = h = 0 is linear."""

    xi: float = 0.0
    omega: float = 1.0
    g: float = 0.0
    h: float = 0.0

    def __post_init__(self):
        if not self.omega > 0 or not self.h >= 0:
            raise ValueError("omega must be positive and h not negative")

    def _unit(self, u: np.ndarray) -> np.ndarray:
        return (np.expm1(self.g * u) / self.g if self.g else u) * np.exp(self.h * u * u / 2)

    def transformed(self, u: np.ndarray) -> np.ndarray:
        return self.xi + self.omega * self._unit(np.asarray(u, float))

    def log_slope(self, u: np.ndarray) -> np.ndarray:
        """log dz / du."""
        with np.errstate(all="ignore"):
            return np.log(self.omega * (np.exp(self.g * u + self.h * u * u / 2) + self.h * u * self._unit(u)))

    def inverse(self, z: np.ndarray) -> np.ndarray:
        """u of each z, by brackets that grow until they hold it and are then halved to neighbouring numbers; NaN where
        no u gives z (h = 0 and z beyond xi - omega / g) or z is not finite."""
        w = (np.asarray(z, float) - self.xi) / self.omega
        none = ~np.isfinite(w)
        if self.g and not self.h:
            none |= w * self.g <= -1
        w = np.where(none, 0.0, w)
        if not self.g and not self.h:
            return np.where(none, np.nan, w)
        low, high = np.full(w.shape, -1.0), np.full(w.shape, 1.0)
        with np.errstate(over="ignore"):
            while (out := self._unit(high) < w).any():
                high = np.where(out, 2 * high, high)
            while (out := self._unit(low) > w).any():
                low = np.where(out, 2 * low, low)
            while True:
                middle = (low + high) / 2
                if ((middle <= low) | (middle >= high)).all():
                    return np.where(none, np.nan, middle)
                below = self._unit(middle) < w
                low, high = np.where(below, middle, low), np.where(below, high, middle)
