"""Column functions on series held as ``array<double>`` in the same row as their key.

Every function maps one row to one row, so none of them shuffles.  The numeric work runs on Arrow
batches: a batch of n series of width B arrives as one (n, B) matrix.  Chained calls are fused by
Spark into one Python stage.  (Nested higher-order lambdas are avoided on purpose: Catalyst inlines
an aggregate used inside a ``transform`` lambda, which turns a linear pass into a quadratic one.)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARRAY = T.ArrayType(T.DoubleType())

# Upper bound on the elements a sliding-window kernel materialises at once.
_WINDOW_ELEMENTS = 4_000_000


def _by_width(values: pa.Array):
    """Yield (row numbers, matrix) for each distinct series width in an Arrow batch."""
    lengths = np.asarray(values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all() and lengths[0] > 0:
        yield np.arange(len(lengths)), flat.reshape(len(lengths), lengths[0])
        return
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]) if len(lengths) else lengths
    for width in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)[None, :]]


def row_map(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column | str], Column]:
    """Lift a matrix kernel (n, B) -> (n, k) to a function from a series column to a series column."""

    @F.arrow_udf(ARRAY)
    def apply(values: pa.Array) -> pa.Array:
        rows_out: list[tuple[np.ndarray, np.ndarray]] = [
            (rows, np.ascontiguousarray(kernel(x), dtype=np.float64)) for rows, x in _by_width(values)
        ]
        n = len(values)
        if len(rows_out) == 1 and len(rows_out[0][0]) == n:
            z = rows_out[0][1]
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
        out: list = [None] * n
        for rows, z in rows_out:
            for r, line in zip(rows, z):
                out[r] = line
        return pa.array(out, type=pa.list_(pa.float64()))

    return lambda c: apply(F.col(c) if isinstance(c, str) else c)


def row_reduce(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column | str], Column]:
    """Lift a matrix kernel (n, B) -> (n,) to a function from a series column to a double column."""

    @F.arrow_udf(T.DoubleType())
    def apply(values: pa.Array) -> pa.Array:
        out = np.full(len(values), np.nan)
        for rows, x in _by_width(values):
            out[rows] = kernel(x)
        return pa.array(out, mask=np.isnan(out))

    return lambda c: apply(F.col(c) if isinstance(c, str) else c)


def _sliding(x: np.ndarray, window: int, reduce: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Reduce every full window of each row, a bounded number of rows at a time."""
    width = x.shape[1] - window + 1
    step = max(1, _WINDOW_ELEMENTS // (max(width, 1) * window))
    parts = [
        reduce(np.lib.stride_tricks.sliding_window_view(x[i : i + step], window, axis=1))
        for i in range(0, len(x), step)
    ]
    return np.concatenate(parts) if parts else np.empty((0, width))


def _rolling(x: np.ndarray, half: int, reduce: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Rolling reduction over positions i-half .. i+half, windows cut at both ends of the series."""
    width = x.shape[1]
    out = np.empty_like(x, dtype=np.float64)
    if width > 2 * half:
        out[:, half : width - half] = _sliding(x, 2 * half + 1, reduce)
        edge = [*range(half), *range(width - half, width)]
    else:
        edge = range(width)
    for i in edge:
        out[:, i] = reduce(x[:, max(0, i - half) : i + half + 1])
    return out


# ---------------------------------------------------------------- normalisation

def snv(c: Column | str) -> Column:
    """Zero mean and unit population standard deviation per series."""
    return row_map(lambda x: (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-8))(c)


def snv_or_zero(c: Column | str) -> Column:
    """As :func:`snv` without the epsilon; a constant series becomes all zero."""

    def kernel(x):
        d = x - x.mean(1, keepdims=True)
        s = x.std(1, keepdims=True)
        return np.where(s > 0, d / np.where(s > 0, s, 1.0), 0.0)

    return row_map(kernel)(c)


def min_max(c: Column | str) -> Column:
    """Scale each series to [0, 1]; a constant series becomes all zero."""

    def kernel(x):
        lo = x.min(1, keepdims=True)
        span = x.max(1, keepdims=True) - lo
        return np.where(span > 0, (x - lo) / np.where(span > 0, span, 1.0), 0.0)

    return row_map(kernel)(c)


def mean_centre(c: Column | str) -> Column:
    return row_map(lambda x: x - x.mean(1, keepdims=True))(c)


NORMALISERS: dict[str, Callable[[Column | str], Column]] = {
    "raw": lambda c: F.col(c) if isinstance(c, str) else c,
    "snv": snv_or_zero,
    "minmax": min_max,
    "mean": mean_centre,
}


def normalise(c: Column | str, mode: str) -> Column:
    return NORMALISERS[mode](c)


# ---------------------------------------------------------------- cleaning

def despike(c: Column | str, *, threshold: float = 5.0, window: int = 7) -> Column:
    """Replace narrow upward spikes by the running median (zero padded at the ends)."""
    window += 1 - window % 2
    half = window // 2

    def kernel(x):
        med = _sliding(np.pad(x, ((0, 0), (half, half))), window, lambda w: np.median(w, axis=-1))
        r = x - med
        sigma = 1.4826 * np.median(np.abs(r - np.median(r, axis=1, keepdims=True)), axis=1, keepdims=True)
        spike = (sigma >= 1e-6) & (r > threshold * np.where(sigma >= 1e-6, sigma, 1.0))
        return np.where(spike, med, x)

    return row_map(kernel)(c)


def remove_baseline(c: Column | str, *, half_width: int = 50, quantile: float = 0.1) -> Column:
    """Subtract a smooth lower envelope: rolling low quantile, then rolling mean of it."""

    def kernel(x):
        low = _rolling(x, half_width, lambda w: np.quantile(w, quantile, axis=-1))
        return x - _rolling(low, half_width, lambda w: w.mean(axis=-1))

    return row_map(kernel)(c)


def penalised_fit(x: np.ndarray, weights: np.ndarray, lam: float) -> np.ndarray:
    """Rows z that minimise sum(w (x - z)^2) + lam * sum(second difference of z)^2.

    The matrix of every row has five diagonals; its LDL' factors are computed position by position for all rows at once.
    """
    n, b = x.shape
    if b < 3:
        return x.copy()
    second = np.zeros((b - 2, b))
    i = np.arange(b - 2)
    second[i, i], second[i, i + 1], second[i, i + 2] = 1.0, -2.0, 1.0
    main = lam * (second**2).sum(0)
    one = lam * np.array([(second[:, j] * second[:, j + 1]).sum() for j in range(b - 1)])
    two = lam * np.array([(second[:, j] * second[:, j + 2]).sum() for j in range(b - 2)])
    d, l1, l2, z = (np.zeros((b, n)) for _ in range(4))
    w, right = weights.T, (weights * x).T
    for j in range(b):
        d[j] = w[j] + main[j]
        z[j] = right[j]
        if j > 0:
            d[j] -= l1[j - 1] ** 2 * d[j - 1]
            z[j] -= l1[j - 1] * z[j - 1]
        if j > 1:
            d[j] -= l2[j - 2] ** 2 * d[j - 2]
            z[j] -= l2[j - 2] * z[j - 2]
        if j < b - 1:
            l1[j] = (one[j] - (l1[j - 1] * l2[j - 1] * d[j - 1] if j > 0 else 0.0)) / d[j]
        if j < b - 2:
            l2[j] = two[j] / d[j]
    z /= d
    for j in range(b - 2, -1, -1):
        z[j] -= l1[j] * z[j + 1]
        if j < b - 2:
            z[j] -= l2[j] * z[j + 2]
    return z.T


def penalised_baselines(x: np.ndarray, lam: float, max_iter: int, tol: float) -> np.ndarray:
    """Baselines by penalised least squares; points far above the curve lose their weight from step to step (asymmetric reweighting).

    A row stops when its weights change by less than ``tol`` of their length, or when no point lies below its curve.
    """
    out, w, rows = x.astype(np.float64).copy(), np.ones_like(x, dtype=np.float64), np.arange(len(x))
    for _ in range(max_iter):
        z = penalised_fit(x[rows], w[rows], lam)
        out[rows] = z
        gap = x[rows] - z
        below = gap < 0
        k = below.sum(1)
        mean = np.where(below, gap, 0.0).sum(1) / np.maximum(k, 1)
        sd = np.sqrt(np.where(below, (gap - mean[:, None]) ** 2, 0.0).sum(1) / np.maximum(k - 1, 1))
        able = (k > 1) & (sd > 0)
        s = np.where(able, sd, 1.0)[:, None]
        fresh = 1.0 / (1.0 + np.exp(np.clip(2.0 * (gap - (2.0 * s - mean[:, None])) / s, -500, 500)))
        moved = np.linalg.norm(fresh - w[rows], axis=1) / np.maximum(np.linalg.norm(w[rows], axis=1), 1e-300)
        go = able & (moved >= tol)
        w[rows] = fresh
        rows = rows[go]
        if not len(rows):
            break
    return out


def remove_penalised_baseline(c: Column | str, *, lam: float = 1e5, max_iter: int = 50, tol: float = 1e-3) -> Column:
    """Subtract a baseline fitted by asymmetrically reweighted penalised least squares."""
    return row_map(lambda x: x - penalised_baselines(x, lam, max_iter, tol))(c)


# ---------------------------------------------------------------- long form

def exploded(df: DataFrame, keys: Sequence[str], y: str = "y", pos: str = "pos", v: str = "v") -> DataFrame:
    """One row per (key, position).

    The outer form on purpose: for the plain one Catalyst adds a "size > 0" filter and pushes it below
    the projection, where it computes a Python-made series a second time.
    """
    return df.select(*keys, F.posexplode_outer(y).alias(pos, v)).where(F.col(pos).isNotNull())


# ---------------------------------------------------------------- scalars per series

def mad(c: Column | str) -> Column:
    """Median absolute deviation from the series median."""
    return row_reduce(lambda x: np.median(np.abs(x - np.median(x, axis=1, keepdims=True)), axis=1))(c)


def total(c: Column | str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)


def norm(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v))


def roll(c: Column | str, shift: Column) -> Column:
    """Circular shift to the right by ``shift`` positions (negative shifts left)."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.size(c)
    k = F.pmod(shift.cast("int"), n)
    return F.concat(F.slice(c, n - k + 1, k), F.slice(c, F.lit(1), n - k))


def subtract_series(a: Column | str, b: Column | str) -> Column:
    """Element-wise difference on the shorter of the two lengths."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda u, v: u - v)
