"""Bounded derivative-free maximisation by quadratic models in a trust region; the points of a step are evaluated together."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np


@dataclass
class Optimum:
    x: list[float]
    value: float
    evaluations: int
    trace: list[tuple[list[float], float]] = field(default_factory=list)


def _terms(s: np.ndarray) -> np.ndarray:
    """Of offsets (points, d): 1, each coordinate, each square and each product."""
    pairs = list(combinations(range(s.shape[1]), 2))
    return np.column_stack([np.ones(len(s)), s, s * s, *(s[:, i] * s[:, j] for i, j in pairs)])


def _summit(model: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The best point of a quadratic model in the box [low, high]: each coordinate in turn goes to its maximum given the others."""
    d = len(low)
    cross = np.zeros((d, d))
    for c, (i, j) in zip(model[1 + 2 * d :], combinations(range(d), 2)):
        cross[i, j] = cross[j, i] = c
    best = None
    for s in np.clip(starts, low, high):
        s = s.copy()
        for _ in range(60):
            before = s.copy()
            for i in range(d):
                slope, bend = model[1 + i] + cross[i] @ s, model[1 + d + i]
                ends = [low[i], high[i]] + ([min(max(-slope / (2 * bend), low[i]), high[i])] if bend < 0 else [])
                s[i] = max(ends, key=lambda v: slope * v + bend * v * v)
            if np.abs(s - before).max() < 1e-12:
                break
        value = float((_terms(s[None]) @ model)[0])
        if best is None or value > best[0]:
            best = (value, s)
    return best[1]


def maximise(f: Callable[[list[list[float]]], list[float]], start: list[float], low: list[float], high: list[float], ftol_rel: float = 1e-5, maxeval: int = 1000) -> Optimum:
    """The best point found in the box [low, high]. f takes a list of points and gives their values; NaN counts as -inf.

    A step evaluates the best point's surroundings (two points on each axis, one for each pair of axes, in units of the
    box) in one call of f, fits the quadratic through them, and tries the model's summits within one and two radii in a
    second call. The radius grows while the farther summit wins and shrinks otherwise. Where nothing near the start has a
    value the whole box is looked at once, by a coarse grid. Coordinates whose bounds coincide
    stay fixed. The search ends after maxeval evaluations or when four steps in a row gain less than ftol_rel of the value.
    """
    if any(a > b for a, b in zip(low, high)):
        raise ValueError("a lower bound is above its upper bound")
    free = [i for i, (a, b) in enumerate(zip(low, high)) if b > a]
    trace: list[tuple[list[float], float]] = []

    def full(u):
        x = [min(max(s, a), b) for s, a, b in zip(start, low, high)]
        for i, v in zip(free, u):
            x[i] = low[i] + (high[i] - low[i]) * float(v)
        return x

    def values(points: np.ndarray) -> np.ndarray:
        points = [full(p) for p in points[: max(0, maxeval - len(trace))]]
        got = [-math.inf if math.isnan(v) else float(v) for v in f(points)] if points else []
        trace.extend(zip(points, got))
        return np.array(got)

    d, radius, settled, scanned = len(free), 0.25, 0, False
    best = np.array([(min(max(start[i], low[i]), high[i]) - low[i]) / (high[i] - low[i]) for i in free])
    top = float(values(best[None])[0])
    while d and len(trace) < maxeval and settled < 4 and radius > 1e-9:
        signs = np.where(best + radius <= 1, 1.0, -1.0)
        eye = np.eye(d) * (signs * radius)
        there = eye + best
        back = best - eye
        back = np.where((back < 0) | (back > 1), best + eye / 2, back)  # at a bound: half the way to the same side
        around = np.clip(np.concatenate([there, back, *[(best + eye[i] + eye[j])[None] for i, j in combinations(range(d), 2)]]), 0, 1)
        got = values(around)
        if len(got) < len(around):
            break
        known, seen = np.concatenate([best[None], around]), np.concatenate([[top], got])
        fine = np.isfinite(seen)
        before = top
        if fine.any():
            seen = np.where(fine, seen, seen[fine].min() - (np.ptp(seen[fine]) + 1))
            model = np.linalg.lstsq(_terms((known - best) / radius), seen, rcond=None)[0]
            starts = (known[np.argsort(-seen)[:3]] - best) / radius
            tried = np.array([best + radius * _summit(model, np.maximum(-k, -best / radius), np.minimum(k, (1 - best) / radius), starts) for k in (1.0, 2.0)])
            tried = np.clip(tried, 0, 1)
            values_there = values(tried)
            known, seen = np.concatenate([known, tried[: len(values_there)]]), np.concatenate([seen, values_there])
            k = int(np.argmax(seen))
            far = k == len(seen) - 1 and np.abs(known[k] - best).max() > 1.01 * radius
            if seen[k] > top or not math.isfinite(top):
                best, top = known[k], float(seen[k])
            radius = min(0.5, radius * 1.5) if far else radius * 0.4
        elif scanned:
            break
        else:  # no value anywhere near: one look at the whole box
            scanned = True
            known = np.array(list(product((0.1, 0.35, 0.65, 0.9), repeat=d)))
            seen = values(known)
            if len(seen) and math.isfinite(seen.max()):
                best, top = known[int(np.argmax(seen))], float(seen.max())
        settled = settled + 1 if math.isfinite(top) and abs(top - before) <= ftol_rel * max(abs(top), 1e-300) else 0
    x, value = max(trace, key=lambda s: s[1])
    return Optimum(x, value, len(trace), trace)
