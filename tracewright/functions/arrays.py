"""The kernels of ``scalars`` over NumPy arrays, for loops that run inside a task. Null is NaN."""

from __future__ import annotations

import numpy as np


def prob_sums(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """1 - product(1 - x) of each of ``n`` groups."""
    left = np.ones(n)
    np.multiply.at(left, of, 1 - x)
    return 1 - left


def exact_sums(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The sum of each of ``n`` groups, rounded once, by the cuts of ``scalars.exact_sum``."""
    fits = np.abs(x) < 2.0**30
    rest, exact = np.where(fits, x, 0.0), []
    for bits in (30, 31, 31):
        rest = rest * 2.0**bits
        whole = np.floor(rest)
        total = np.zeros(n, np.int64)
        np.add.at(total, of, whole.astype(np.int64))
        exact.append(total.astype(float))
        rest = rest - whole
    high, middle, low = exact
    loose = np.bincount(of[~fits], minlength=n) > 0
    return np.where(loose, np.bincount(of, x, n), high * 2.0**-30 + (middle * 2.0**-61 + low * 2.0**-92))


def df_quad(base: np.ndarray, support: np.ndarray, attack: np.ndarray) -> np.ndarray:
    down = np.where(attack > support, base - base * (attack - support), base)
    return np.where(support > attack, base + (1 - base) * (support - attack), down)


def quadratic_energy(base: np.ndarray, support: np.ndarray, attack: np.ndarray) -> np.ndarray:
    energy = support - attack
    pull = energy * energy / (1 + energy * energy)
    return np.where(energy > 0, base + (1 - base) * pull, np.where(energy < 0, base - base * pull, base))
