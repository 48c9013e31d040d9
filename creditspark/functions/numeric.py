"""Scalar numerics for results that are already one row per test: tail probabilities, t quantile, phi_k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, dof: int) -> float:
    """P(X >= x) for a chi-squared variable with integer degrees of freedom, by its finite series."""
    if dof < 1:
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2:
        total = math.erfc(math.sqrt(half))
        steps = [i + 0.5 for i in range((dof - 1) // 2)]
    else:
        total = 0.0
        steps = [float(i) for i in range(dof // 2)]
    for s in steps:
        total += math.exp(s * math.log(half) - half - math.lgamma(s + 1.0))
    return min(total, 1.0)


def t_quantile(p: float, dof: int) -> float:
    """Student t quantile for p >= 0.5, by bisection on the integrated density."""
    nodes, weights = np.polynomial.legendre.leggauss(200)

    def mass(angle: float) -> float:
        # with t = sqrt(dof) * tan(a) the density becomes cos(a)^(dof - 1), smooth on a bounded range
        a = angle * (nodes + 1.0) / 2.0
        return float(np.sum(weights * np.cos(a) ** (dof - 1)) * angle / 2.0)

    whole = 2.0 * mass(math.pi / 2.0)
    low, high = 0.0, math.pi / 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 0.5 + mass(mid) / whole < p:
            low = mid
        else:
            high = mid
    return math.sqrt(dof) * math.tan((low + high) / 2.0)


# ---- phi_k (Baak et al. 2020, arXiv:1811.11440) --------------------------------------------

REACH = 5.0  # the bivariate normal is binned uniformly over +-5 standard deviations
BLOCK_CELLS = 1 << 16
PANELS = 16  # rho = cos(angle); panels of the angle halve towards 0, where the normal becomes a line
POINTS = 16
_PLACES = np.polynomial.chebyshev.chebpts1(POINTS)
_SERIES = np.linalg.inv(np.polynomial.chebyshev.chebvander(_PLACES, POINTS - 1))
# integrals from -1 to every place, and to 1 in the last row, of a function given at the places
_UP_TO = np.column_stack([
    np.polynomial.chebyshev.chebval(np.append(_PLACES, 1.0), np.polynomial.chebyshev.chebint(one, lbnd=-1))
    for one in _SERIES.T])


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in x])


def _masses(corner: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(np.diff(corner, axis=-2), axis=-1), 0.0)


def _cells(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[float, float, np.ndarray]]:
    """Panel by panel from rho 0 on: (widest angle, narrowest angle, masses of the grid's cells at its places and its end).

    The joint distribution grows with rho by the joint density, so that one integration serves every rho.
    """
    corner = np.outer(_normal_cdf(x), _normal_cdf(y))
    apart, across = (x[:, None] - y[None, :]) ** 2, np.outer(x, y)
    wide = math.pi / 2
    for _ in range(PANELS):
        narrow = wide / 2
        angle = (wide + narrow) / 2 - (wide - narrow) / 2 * _PLACES[:, None, None]
        density = np.exp(-(apart + 4 * np.sin(angle / 2) ** 2 * across) / (2 * np.sin(angle) ** 2)) / (2 * math.pi)
        grown = corner + np.tensordot(_UP_TO, density, 1) * (wide - narrow) / 2
        yield wide, narrow, _masses(grown)
        corner, wide = grown[-1], narrow


@lru_cache(maxsize=4096)
def dependence_table(r: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Chi-squared per record of the binned normal against independence, for every rho.

    Per panel: the values at its ends and the Chebyshev series between them; and the value at rho 1. Serves every
    pair of features with ``r`` and ``k`` levels; grids are summed in blocks of at most ``BLOCK_CELLS`` cells or so.
    """
    x, y = np.linspace(-REACH, REACH, r + 1), np.linspace(-REACH, REACH, k + 1)
    in_x, in_y = np.diff(_normal_cdf(x)), np.diff(_normal_cdf(y))
    flat_mass = in_x.sum() * in_y.sum()
    whole = [masses[:, 0, 0] for _, _, masses in _cells(x[[0, -1]], y[[0, -1]])]
    line_mass = in_x.sum()
    values, strongest = np.zeros((PANELS, POINTS + 1)), 0.0
    wide = min(k, BLOCK_CELLS)
    high = max(1, BLOCK_CELLS // wide)
    for i, j in product(range(0, r, high), range(0, k, wide)):
        rows, columns = x[i:i + high + 1], y[j:j + wide + 1]
        flat = np.outer(in_x[i:i + high], in_y[j:j + wide]) / flat_mass
        for panel, (_, _, masses) in enumerate(_cells(rows, columns)):
            joint = masses / whole[panel][:, None, None]
            values[panel] += ((joint - flat) ** 2 / flat).sum(axis=(1, 2))
        line = _masses(_normal_cdf(np.minimum.outer(rows, columns).ravel()).reshape(len(rows), -1)) / line_mass
        strongest += float(((line - flat) ** 2 / flat).sum())
    return values[:, -1], values[:, :-1] @ _SERIES.T, strongest


def phik_from_chi2(chi2: float, n: float, r: int, k: int) -> float:
    """Correlation of the binned normal whose chi-squared equals the observed one.

    The noise pedestal is the effective number of degrees of freedom; below it the result is 0, at the
    largest possible chi-squared it is 1.
    """
    if r < 2 or k < 2 or n <= 0:
        return math.nan
    pedestal = (r - 1) * (k - 1)
    ceiling = n * min(r - 1, k - 1)
    if chi2 <= pedestal:
        return 0.0
    if chi2 >= ceiling:
        return 1.0
    ends, series, strongest = dependence_table(min(r, k), max(r, k))
    wanted = (chi2 - pedestal) / (ceiling - pedestal) * strongest
    panel = int(np.searchsorted(ends, wanted))
    wide = math.pi / 2 / 2 ** panel
    if panel == PANELS:  # narrower than any panel: rho is 1 to nine digits
        return math.cos(wide * min(1.0, max(0.0, (strongest - wanted) / (strongest - ends[-1]))))
    low, high = -1.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        if np.polynomial.chebyshev.chebval(middle, series[panel]) < wanted:
            low = middle
        else:
            high = middle
    return math.cos(wide * (0.75 - low / 4))
