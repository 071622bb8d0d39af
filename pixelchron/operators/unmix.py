"""Linear spectral unmixing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many endmembers all their subsets are tried.
SUBSETS = 8


def coefficients(endmembers: dict[str, list[float]], sum_to_one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fractions are matrix @ bands + offset: least squares, with a Lagrange multiplier if they have to sum to one."""
    e = np.array(list(endmembers.values()), float).T
    m = e.shape[1]
    if not sum_to_one:
        return np.linalg.pinv(e), np.zeros(m)
    system = np.block([[e.T @ e, np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
    inverse = np.linalg.pinv(system)
    return inverse[:m, :m] @ e.T, inverse[:m, m]


def unmix(df: DataFrame, bands: list[str], endmembers: dict[str, list[float]], sum_to_one: bool = True, non_negative: bool = False, drop_inputs: bool = False) -> DataFrame:
    """Adds a fraction for each endmember.

    Without non_negative the solution is a constant matrix times the bands: plain column arithmetic. With it each row is an active-set problem, solved in
    Arrow batches. A row with a missing band has no fractions.
    """
    if not non_negative:
        a, b = coefficients(endmembers, sum_to_one)
        out = {}
        for k, name in enumerate(endmembers):
            total = F.lit(float(b[k]))
            for j, band in enumerate(bands):
                total = total + F.lit(float(a[k, j])) * F.col(band)
            out[name] = total
        df = df.withColumns(out)
    else:
        e = np.array(list(endmembers.values()), float).T
        names = list(endmembers)

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[bands].to_numpy(float)
                f = np.full((len(x), len(names)), np.nan)
                good = ~np.isnan(x).any(axis=1)
                f[good] = best_subset(e, x[good], sum_to_one) if len(names) <= SUBSETS else [non_negative_fractions(e, row, sum_to_one) for row in x[good]]
                yield batch.assign(**{n: f[:, k] for k, n in enumerate(names)})

        schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{n}` double" for n in names])
        df = df.mapInPandas(solve, schema)
        df = df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})
    return df.drop(*bands) if drop_inputs else df


def best_subset(e: np.ndarray, x: np.ndarray, sum_to_one: bool) -> np.ndarray:
    """Fractions of 0 or more for all rows of x at once.

    The best non-negative solution is the plain one on the endmembers that it uses, so of all subsets' plain solutions
    the one without a negative fraction that leaves the least is it.
    """
    m = e.shape[1]
    best, least = np.zeros((len(x), m)), np.full(len(x), np.inf) if sum_to_one else (x * x).sum(axis=1)
    for used in (list(s) for k in range(1, m + 1) for s in combinations(range(m), k)):
        a, b = coefficients({str(j): e[:, j].tolist() for j in used}, sum_to_one)
        f = x @ a.T + b
        left = ((x - f @ e[:, used].T) ** 2).sum(axis=1)
        better = (f >= -1e-12).all(axis=1) & (left < least)
        least = np.where(better, left, least)
        best[better] = 0
        best[np.ix_(better, used)] = np.maximum(f[better], 0)
    return best


def non_negative_fractions(e: np.ndarray, y: np.ndarray, sum_to_one: bool) -> np.ndarray:
    """Least squares with fractions of 0 or more (Lawson and Hanson 1974); a heavy extra row makes them sum to one."""
    if sum_to_one:
        heavy = 1e5 * max(1.0, np.abs(e).max())
        e, y = np.vstack([e, np.full(e.shape[1], heavy)]), np.append(y, heavy)
    n = e.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 10):
        w = e.T @ (y - e @ x)
        if active.all() or w[~active].max() <= 1e-9 * max(1.0, np.abs(w).max()):
            break
        active[np.where(~active, w, -np.inf).argmax()] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(e[:, active], y, rcond=None)[0]
            if s[active].min() > 0:
                break
            low = active & (s <= 0)
            step = (x[low] / (x[low] - s[low])).min()
            x = x + step * (s - x)
            active &= x > 1e-12
            if not active.any():
                s = np.zeros(n)
                break
        x = s
    return x
