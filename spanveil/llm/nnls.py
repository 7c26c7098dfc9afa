"""Shallow length combinations, non-negative least squares over them, and greedy packing of what is left."""

from __future__ import annotations

import numpy as np


def combinations(window: int, present: np.ndarray, depth: int = 3) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` (1 to 3) present sizes that sum to ``window``."""
    there = np.zeros(window + 1, bool)
    there[present] = True
    found = [(window,)] if there[window] else []
    if depth >= 2:
        found += [(window - a, a) for a in range(1, window // 2 + 1) if there[a] and there[window - a]]
    if depth >= 3:
        for a in range(1, window // 3 + 1):
            if there[a]:
                b = np.arange(a, (window - a) // 2 + 1)
                b = b[there[b] & there[window - a - b]]
                found += [(window - a - int(x), int(x), a) for x in b]
    return found


def solve(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson-Hanson: repeat counts >= 0 that minimise the weighted squared distance to the histogram.

    Long pieces weigh more, since one that stays over costs more padding. The solution is basic: no more
    combinations are used than there are sizes, so rounding it loses little.
    """
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / (size - 1) + 0.05)
    width = max((len(c) for c in combos), default=1)
    at = np.zeros((len(combos), width), np.int64)
    for i, c in enumerate(combos):
        at[i, : len(c)] = c
    counted = (at > 0).astype(float)
    aim = histogram * weight
    scale = aim.max() or 1.0
    aim = aim / scale
    x = np.zeros(len(combos))
    passive: list[int] = []

    def columns(which: list[int]) -> np.ndarray:
        a = np.zeros((size, len(which)))
        for k in range(width):
            np.add.at(a, (at[which, k], np.arange(len(which))), counted[which, k])
        return a * weight[:, None]

    matrix = np.zeros((size, 0))
    barred = np.zeros(len(combos), bool)
    for _ in range(rounds or 3 * size):
        rest = (aim - matrix @ x[passive]) * weight if passive else aim * weight
        gain = (rest[at] * counted).sum(1)
        gain[passive] = -1
        gain[barred] = -1
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] <= 1e-7:
            break
        passive.append(best)
        matrix = np.concatenate([matrix, columns([best])], axis=1)
        while True:
            gram = matrix.T @ matrix + 1e-10 * np.eye(len(passive))
            z = np.linalg.solve(gram, matrix.T @ aim)
            if (z > 0).all():
                x[passive] = z
                break
            now = x[passive]
            bad = z <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-30))
            now = now + step * (z - now)
            keep = now > 1e-12
            if not keep[-1] and len(keep) and step <= 0:
                barred[passive[-1]] = True
            x[passive] = np.where(keep, now, 0)
            passive = [p for p, k in zip(passive, keep) if k]
            matrix = matrix[:, keep]
            if not passive:
                break
    return x * scale


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes, descending) and how often each is used; every counted piece is in exactly one pattern.

    ``histogram[s]`` counts the pieces of size s, up to the window. NNLS counts are rounded and held to what is
    there; the residuals are packed best fit decreasing, a whole run of equal sequences at a time.
    """
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        patterns.append(((window,), int(left[window])))
        left[window] = 0
    combos = [c for c in combinations(window, np.flatnonzero(left), depth) if len(c) > 1]
    if combos:
        x = solve(combos, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            uses = {s: combos[i].count(s) for s in combos[i]}
            n = min(int(x[i] + 0.5), *(int(left[s]) // u for s, u in uses.items()))
            if n > 0:
                patterns.append((combos[i], n))
                for s, u in uses.items():
                    left[s] -= n * u
    while left.any():
        room, sizes, uses = window, [], {}
        free = left.copy()
        while True:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            s = int(fits[-1])
            sizes.append(s)
            uses[s] = uses.get(s, 0) + 1
            free[s] -= 1
            room -= s
        n = min(int(left[s]) // u for s, u in uses.items())
        patterns.append((tuple(sizes), n))
        for s, u in uses.items():
            left[s] -= n * u
    return patterns
