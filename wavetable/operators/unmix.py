"""Non-negative factorisation of a series table: D ~ C S with C, S >= 0.

Rows of D stay distributed.  What travels is of component size: the component spectra (K x B) go out
with the task closure, and C'C (K x K) and C'D (K x B) come back summed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions.series import _by_width, exploded, row_map, row_reduce
from wavetable.operators.moments import second_moments
from wavetable.operators.scale import exact_percentiles
from wavetable.session import materialise


def shift_non_negative(df: DataFrame, y: str) -> DataFrame:
    """Subtract the table's smallest value from every value."""
    low = df.agg(F.min(F.array_min(y)).alias("m")).first()["m"]
    return df.withColumn(y, row_map(lambda x: x - low)(y))


def purest_variables(df: DataFrame, y: str, components: int, offset_pct: float = 5.0) -> tuple[np.ndarray, list[int]]:
    """Greedy pick of the positions that vary most independently, and a start spectrum for each.

    The start spectrum is the series with the largest value at the picked position (of equal ones the last
    in order), cut at zero and scaled to unit length.  Only the B x B cross-moment matrix is used for the picks.
    """
    _, mean, sd, moments = second_moments(df, y)
    picked = purest_positions(mean, sd, moments, components, offset_pct)
    tops = df.agg(*[F.max_by(y, F.struct(F.col(y)[p], y)).alias(f"t{k}") for k, p in enumerate(picked)]).first()
    return unit_rows(np.array([tops[f"t{k}"] for k in range(components)])), picked


def unit_rows(spectra: np.ndarray) -> np.ndarray:
    """Rows cut at zero and scaled to unit length."""
    start = np.maximum(spectra, 0.0)
    lengths = np.linalg.norm(start, axis=1, keepdims=True)
    return start / np.where(lengths > 0, lengths, 1.0)


def purest_positions(mean: np.ndarray, sd: np.ndarray, moments: np.ndarray, components: int, offset_pct: float = 5.0) -> list[int]:
    """The greedy pick alone, from mean, population sd and X'X / n."""
    alpha = offset_pct / 100.0 * float(mean.max())
    purity = sd / (mean + alpha)
    length = np.sqrt(mean**2 + sd**2 + alpha**2)
    length[length < 1e-12] = 1.0
    c = moments / np.outer(length, length)
    picked = [int(np.argmax(purity))]
    while len(picked) < components:
        cross = c[picked]
        left = np.maximum(np.diag(c) - np.einsum("ij,ij->j", cross, np.linalg.pinv(c[np.ix_(picked, picked)]) @ cross), 0.0)
        score = left * purity
        score[picked] = -np.inf
        picked.append(int(np.argmax(score)))
    return picked


def solve_non_negative(d: np.ndarray, spectra: np.ndarray, sweeps: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Rows c >= 0 minimising |d - c S|, by cyclic coordinate descent (a convex problem).

    Starts from the clipped least-squares solution; rows leave the sweep once they stop moving.
    """
    gram, target = spectra @ spectra.T, d @ spectra.T
    c = np.maximum(target @ np.linalg.pinv(gram), 0.0)
    rows = np.arange(len(c))
    for _ in range(sweeps):
        x, t = c[rows], target[rows]
        before = x.copy()
        for k in range(len(gram)):
            if gram[k, k] > 0:
                x[:, k] = np.maximum(0.0, x[:, k] + (t[:, k] - x @ gram[:, k]) / gram[k, k])
        c[rows] = x
        rows = rows[np.abs(x - before).max(1, initial=0.0) > tol]
        if not len(rows):
            break
    return c


@dataclass
class Unmixing:
    spectra: np.ndarray
    variables: list[int]
    errors: list[float] = field(default_factory=list)


def _products(df: DataFrame, y: str, spectra: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """C'C, C'D and |D|^2, summed per task and then by Spark."""
    k, b = spectra.shape

    def partial(batches):
        total = np.zeros(k * k + k * b + 1)
        for batch in batches:
            for _, d in _by_width(batch.column(0)):
                c = solve_non_negative(d, spectra)
                total[: k * k] += (c.T @ c).ravel()
                total[k * k : -1] += (c.T @ d).ravel()
                total[-1] += float((d * d).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    sums = df.select(y).mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r.v for r in sorted(sums, key=lambda r: r.i)])  # K x (K + B) numbers
    return flat[: k * k].reshape(k, k), flat[k * k : -1].reshape(k, b), flat[-1]


def fit(df: DataFrame, y: str, components: int, *, max_iter: int = 100, tol: float = 1e-7, offset_pct: float = 5.0) -> Unmixing:
    """Alternate exact non-negative solves for C (per row, on the executors) and S (K x B, on the driver).

    Every iteration reads ``df`` once; give it a stored table, not a long chain of steps.
    """
    spectra, variables = purest_variables(df, y, components, offset_pct)
    out = Unmixing(spectra, variables)
    for _ in range(max_iter):
        cc, cd, dd = _products(df, y, out.spectra)
        # objective at (C, S) of this step, from the summed products alone
        out.errors.append(float(dd - 2 * (cd * out.spectra).sum() + ((cc @ out.spectra) * out.spectra).sum()))
        if len(out.errors) > 1 and abs(out.errors[-2] - out.errors[-1]) <= tol * max(dd, 1e-30):
            break
        out.spectra = next_spectra(cc, cd, out.spectra)
    return out


def next_spectra(cc: np.ndarray, cd: np.ndarray, spectra: np.ndarray) -> np.ndarray:
    """The spectra solved for the summed products, at unit length; a component that vanishes keeps its old one."""
    s = _solve_spectra(cc, cd, spectra)
    lengths = np.linalg.norm(s, axis=1, keepdims=True)
    return np.where(lengths > 0, s / np.where(lengths > 0, lengths, 1.0), spectra)


def _solve_spectra(cc: np.ndarray, cd: np.ndarray, start: np.ndarray, sweeps: int = 500) -> np.ndarray:
    s = start.copy()
    for _ in range(sweeps):
        before = s.copy()
        for k in range(len(s)):
            if cc[k, k] > 0:
                s[k] = np.maximum(0.0, s[k] + (cd[k] - cc[k] @ s) / cc[k, k])
        if np.abs(s - before).max(initial=0.0) < 1e-12:
            break
    return s


def concentrations(df: DataFrame, y: str, spectra: np.ndarray, out: str = "c") -> DataFrame:
    """Non-negative contributions of fixed spectra to every series."""
    return df.withColumn(out, row_map(lambda d: solve_non_negative(d, spectra))(y))


def residual(df: DataFrame, y: str, spectra: np.ndarray, c: str = "c") -> DataFrame:
    """Length of y - c S per series."""
    k = len(spectra)
    both = F.concat(c, y)
    return df.withColumn("residual_norm", row_reduce(lambda x: np.sqrt(((x[:, k:] - x[:, :k] @ spectra) ** 2).sum(1)))(both))


def partial_reconstruction(df: DataFrame, y: str, spectra: np.ndarray, keep: Sequence[int], c: str = "c") -> DataFrame:
    """Series rebuilt from some components, moved to the mean level of the original."""
    k, keep = len(spectra), list(keep)

    def kernel(x):
        rec = x[:, keep] @ spectra[keep]
        return rec + x[:, k:].mean(1, keepdims=True) - rec.mean(1, keepdims=True)

    return df.withColumn("reconstruction", row_map(kernel)(F.concat(c, y)))


def abundance_summary(df: DataFrame, file: str, c: str = "c") -> DataFrame:
    """Mean, sample sd, max and 90th percentile of every component per file."""
    flat = exploded(df, [file], c, "k").select(file, (F.col("k") + 1).cast("long").alias("component"), "v")
    flat = materialise(flat, "abundance")  # three passes read it; the non-negative solve runs once
    stats = flat.groupBy(file, "component").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.max("v").alias("max"))
    return stats.join(exact_percentiles(flat, [file, "component"], "v", {"p90": 0.9}), [file, "component"])
