"""Fixed linear maps on series: y' = y W with W known when the plan is built.

Savitzky-Golay filters, trapezoid integrals, derivatives, wavelet banks, projections and resampling
are all such maps.  Maps whose output columns each read a short run of positions become built-in
dot-product expressions; the others run as one matrix product per Arrow batch.  Neither shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from wavetable.functions.series import row_map

# Longest run of positions for which a dot product stays a JVM expression.
NARROW_RUN = 64
# Most dot-product terms in one expression tree before the matrix form is used.
NARROW_TERMS = 512


def _support(w: np.ndarray) -> tuple[int, int]:
    nz = np.flatnonzero(w)
    return (int(nz[0]), int(nz[-1]) + 1) if len(nz) else (0, 1)


def is_narrow(matrix: np.ndarray) -> bool:
    runs = [_support(matrix[:, j]) for j in range(matrix.shape[1])]
    return all(b - a <= NARROW_RUN for a, b in runs) and sum(b - a for a, b in runs) <= NARROW_TERMS


def dot(c: Column | str, weights: np.ndarray) -> Column:
    """Sum of y[i] * w[i] over the support of ``weights``, as a built-in expression."""
    a, b = _support(weights)
    if isinstance(c, str):  # one SQL string: far fewer driver calls than building the tree node by node
        lits = ", ".join(f"{float(v)!r}D" for v in weights[a:b])
        return F.expr(
            f"aggregate(zip_with(slice(`{c}`, {a + 1}, {b - a}), array({lits}), (y, w) -> y * w), 0D, (acc, v) -> acc + v)"
        )
    lits = F.array(*[F.lit(float(v)) for v in weights[a:b]])
    pairs = F.zip_with(F.slice(c, a + 1, b - a), lits, lambda y, w: y * w)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def linear_map(c: Column | str, matrix: np.ndarray) -> Column:
    """Apply W of shape (B, k): an array column of k values per series."""
    matrix = np.asarray(matrix, dtype=np.float64)
    if is_narrow(matrix):
        return F.array(*[dot(c, matrix[:, j]) for j in range(matrix.shape[1])])
    return row_map(lambda x: x @ matrix)(c)


# ---------------------------------------------------------------- coefficient builders

def window_mask(axis: Sequence[float], lo: float, hi: float) -> np.ndarray:
    axis = np.asarray(axis)
    return (axis >= lo) & (axis <= hi)


def trapezoid_weights(axis: Sequence[float], lo: float, hi: float) -> np.ndarray | None:
    """Weights of the trapezoid rule over the axis points in [lo, hi]; None below two points."""
    axis = np.asarray(axis, dtype=np.float64)
    idx = np.flatnonzero(window_mask(axis, lo, hi))
    if len(idx) < 2:
        return None
    w = np.zeros(len(axis))
    half = np.diff(axis[idx]) / 2.0
    w[idx[:-1]] += half
    w[idx[1:]] += half
    return w


def savgol_matrix(n: int, window: int, polyorder: int, *, deriv: int = 0, delta: float = 1.0) -> np.ndarray:
    """Savitzky-Golay filter as an (n, n) map, end points from the polynomial fitted to the end windows."""
    window += 1 - window % 2
    if window > n:
        raise ValueError(f"window {window} is longer than the series ({n})")
    half = window // 2
    offsets = np.arange(-half, half + 1, dtype=np.float64)
    fit = np.linalg.pinv(np.vander(offsets, polyorder + 1, increasing=True))

    def row_at(t: float) -> np.ndarray:
        powers = np.zeros(polyorder + 1)
        for p in range(deriv, polyorder + 1):
            powers[p] = factorial(p) / factorial(p - deriv) * t ** (p - deriv)
        return powers @ fit / delta**deriv

    m = np.zeros((n, n))
    for i in range(n):
        start = min(max(i - half, 0), n - window)
        m[start : start + window, i] = row_at(i - start - half)
    return m


# Daubechies-4 decomposition low-pass filter (8 taps).
DB4_DEC_LO = (
    -0.010597401784997278,
    0.032883011666982945,
    0.030841381835986965,
    -0.18703481171888114,
    -0.02798376941698385,
    0.6308807679295904,
    0.7148465705525415,
    0.23037781330885523,
)


def _dwt_step(n: int, taps: np.ndarray) -> np.ndarray:
    """One decomposition step with half-sample symmetric extension, as an (n, m) map."""
    f = len(taps)
    m = (n + f - 1) // 2
    w = np.zeros((n, m))
    for k in range(m):
        for j in range(f):
            i = 2 * k + 1 - j
            i %= 2 * n
            w[i if i < n else 2 * n - 1 - i, k] += taps[j]
    return w


def wavelet_bank(n: int, levels: int) -> list[np.ndarray]:
    """Detail-coefficient maps (n, m_k) for level 1 (finest) to ``levels``."""
    lo = np.array(DB4_DEC_LO)
    hi = lo[::-1] * np.where(np.arange(len(lo)) % 2 == 0, -1.0, 1.0)
    approx = np.eye(n)
    bank = []
    for _ in range(levels):
        step = approx.shape[1]
        bank.append(approx @ _dwt_step(step, hi))
        approx = approx @ _dwt_step(step, lo)
    return bank


def resample_matrix(source: Sequence[float], target: Sequence[float]) -> np.ndarray:
    """Linear interpolation from one axis to another, clamped at the ends."""
    source = np.asarray(source, dtype=np.float64)
    return np.stack([np.interp(np.asarray(target), source, e) for e in np.eye(len(source))])


def savgol_kernel(window: int, polyorder: int, deriv: int = 0, delta: float = 1.0):
    """Matrix kernel of the filter: shifted sums inside, polynomial rows at both ends."""
    window += 1 - window % 2
    half = window // 2
    m = savgol_matrix(2 * window, window, polyorder, deriv=deriv, delta=delta)
    taps, head, tail = m[:window, half], m[:window, :half], m[-window:, -half:]

    def kernel(x):
        if x.shape[1] < window:
            raise ValueError(f"window {window} is longer than the series ({x.shape[1]})")
        n = x.shape[1] - window + 1
        inner = sum(t * x[:, k : k + n] for k, t in enumerate(taps))
        return np.concatenate([x[:, :window] @ head, inner, x[:, -window:] @ tail], axis=1)

    return kernel


def savgol(c: Column | str, *, window: int, polyorder: int, deriv: int = 0, delta: float = 1.0) -> Column:
    """Savitzky-Golay filter of each series."""
    return row_map(savgol_kernel(window, polyorder, deriv, delta))(c)
