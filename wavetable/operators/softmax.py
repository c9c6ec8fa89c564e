"""Many multinomial logistic models fitted together.

Models differ in the rows they may see (a fold is left out), in a linear preparation of the features (centring,
scaling, projection), in their penalty and in the labels' weights.  Newton's method needs the gradient and the Hessian of each; one job
per iteration adds those of all models in the tasks.  A row whose fold is ``without`` a model adds nothing to it, and
weights come from the same training side, so no held-out row or label reaches a fit.  Newton ends at the optimum itself, so results
don't depend on partitions beyond rounding.

The loss of a model is ``sum(w * nll) / sum(w) + reg / 2 * |W|^2`` over prepared features; intercepts are not penalised.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.functions.series import _by_width
from wavetable.operators.vectorsums import gram_sums

ITERATIONS = 60
TOLERANCE = 1e-9


@dataclass
class Softmax:
    """One model: what it is fitted on, and after the fit its coefficients (classes x prepared features, last column intercepts)."""

    name: object
    without: frozenset = frozenset()  # folds whose rows it must not see
    shift: np.ndarray | None = None
    matrix: np.ndarray | None = None
    columns: np.ndarray | None = None  # features it may use, before the preparation
    reg: float = 0.0
    family: object = None  # which of several feature tables of a row it reads, if there are several
    weights: np.ndarray | None = None
    theta: np.ndarray | None = None
    loss: float = np.inf
    history: list = field(default_factory=list)

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = x if self.columns is None else x[:, self.columns]
        x = x if self.shift is None else x - self.shift
        x = x if self.matrix is None else x @ self.matrix
        return np.hstack([x, np.ones((len(x), 1))])

    def probabilities(self, x: np.ndarray, theta: np.ndarray | None = None) -> np.ndarray:
        z = self.prepared(x) @ (self.theta if theta is None else theta).T
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fold_moments(df: DataFrame, y: str, fold: str) -> dict:
    """fold -> (n, sum, X'X) of its rows, from one pass; a training side is the total minus what it leaves out."""
    one = F.concat(F.array(F.lit(1.0)), F.col(y))
    blocks: dict = {}
    for r in gram_sums(df.withColumn("_one", one).where(F.col(y).isNotNull()), [fold], "_one").collect():  # folds x B / GRAM_ROWS rows
        blocks.setdefault(r[fold], []).append((r["block"], np.array(r["rows"]), r["n"]))
    out = {}
    for f, parts in blocks.items():
        flat = np.concatenate([m for _, m, _ in sorted(parts, key=lambda p: p[0])])
        full = flat.reshape(int(np.sqrt(len(flat))), -1)
        out[f] = (parts[0][2], full[0, 1:], full[1:, 1:])
    return out


def training_side(moments: dict, without: frozenset = frozenset()) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, population covariance) of all folds but those left out."""
    kept = [m for f, m in moments.items() if f not in without]
    n = sum(m[0] for m in kept)
    mean = sum(m[1] for m in kept) / n
    return n, mean, sum(m[2] for m in kept) / n - np.outer(mean, mean)


def standardised(n: int, mean: np.ndarray, cov: np.ndarray, components: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(shift, matrix) that standardises the features and, if wanted, projects them on their first principal components.

    A feature without spread becomes 0.  Of a component the largest loading is positive.
    """
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0) * n / max(n - 1, 1))
    scale = np.where(sd > 1e-12, 1.0 / np.where(sd > 1e-12, sd, 1.0), 0.0)
    matrix = np.diag(scale)
    if components:
        corr = cov * np.outer(scale, scale)
        vectors = np.linalg.eigh(corr)[1][:, ::-1][:, :components]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        matrix = matrix @ vectors
    return mean, matrix


def class_weights(df: DataFrame, models: Sequence[Softmax], label: str, fold: str, classes: int) -> None:
    """n / (classes * class size) of each model's own training side; a class that is not there has weight 0."""
    counts = df.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n")).collect()  # folds x classes rows
    for m in models:
        n = np.zeros(classes)
        for r in counts:
            if r[fold] not in m.without:
                n[int(r[label])] += r["n"]
        m.weights = np.where(n > 0, n.sum() / (max((n > 0).sum(), 1) * np.maximum(n, 1)), 0.0)


def _sums(m: Softmax, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[weight, loss, gradient, Hessian] of some rows, flat."""
    z = m.prepared(x)
    k, p = theta.shape
    w = m.weights[y]
    s = z @ theta.T
    top = s.max(1, keepdims=True)
    e = np.exp(s - top)
    prob = e / e.sum(1, keepdims=True)
    nll = np.log(e.sum(1)) + top[:, 0] - s[np.arange(len(y)), y]
    miss = prob.copy()
    miss[np.arange(len(y)), y] -= 1.0
    hessian = np.empty((k, p, k, p))
    for a in range(k):
        for b in range(a, k):
            v = w * prob[:, a] * ((a == b) - prob[:, b])
            block = z.T @ (z * v[:, None])
            hessian[a, :, b, :], hessian[b, :, a, :] = block, block.T
    return np.concatenate([[w.sum(), w @ nll], ((miss * w[:, None]).T @ z).ravel(), hessian.ravel()])


def fit_many(df: DataFrame, features: str, label: str, fold: str, models: Sequence[Softmax], classes: int, *, family: str | None = None, iterations: int = ITERATIONS) -> list[Softmax]:
    """Fit all models on a stored table with an array of features, an integer label below ``classes`` and a fold.

    ``family`` names the column that tells several feature tables of one row apart.  A step that does not lower the loss is halved.
    """
    class_weights(df if family is None else df.where(F.col(family).eqNullSafe(F.lit(models[0].family))), models, label, fold, classes)
    rows = df.select(features, label, fold, *([family] if family else [])).where(F.col(label).isNotNull())
    width = None
    tried: dict[int, np.ndarray] = {}
    for i, m in enumerate(models):
        if m.matrix is not None:
            width = m.matrix.shape[1]
        elif m.columns is not None:
            width = len(m.columns)
        else:
            width = df.select(F.size(features)).first()[0]
        tried[i] = np.zeros((classes, width + 1))
    best: dict[int, tuple] = {}
    step: dict[int, np.ndarray] = {}

    for _ in range(iterations):
        if not tried:
            break
        asked = {i: (models[i], t) for i, t in tried.items()}

        def partial(batches, asked=asked):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                y, f = np.asarray(b.column(1).to_pylist(), np.int64), b.column(2).to_pylist()
                kind = b.column(3).to_pylist() if b.num_columns > 3 else None
                for at, x in _by_width(b.column(0)):
                    for i, (m, theta) in asked.items():
                        on = np.fromiter((f[r] not in m.without and (kind is None or kind[r] == m.family) for r in at), bool, len(at))
                        on &= m.weights[y[at]] > 0
                        if on.any():
                            total[i] = total.get(i, 0.0) + _sums(m, theta, x[on], y[at][on])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["model", "v"])

        def merge(t: pa.Table) -> pa.Table:
            return pa.table([t["model"].slice(0, 1), pa.array([np.sum([v.values.to_numpy() for v in t["v"]], axis=0).tolist()], pa.list_(pa.float64()))], ["model", "v"])

        schema = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
        got = {r["model"]: np.array(r["v"]) for r in rows.mapInArrow(partial, schema).groupBy("model").applyInArrow(merge, schema).collect()}  # one row per model
        following = {}
        for i, theta in tried.items():
            if i not in got:
                continue
            m, v = models[i], got[i]
            k, p = theta.shape
            penalty = np.append(np.full(p - 1, m.reg), 0.0)
            loss = v[1] / v[0] + 0.5 * float((penalty * theta * theta).sum())
            gradient = v[2 : 2 + k * p] / v[0] + (penalty * theta).ravel()
            m.history.append(loss)
            if i in best and loss > best[i][0] + 1e-13:
                step[i] = step[i] / 2
                if np.abs(step[i]).max() > 1e-12:
                    following[i] = best[i][1] + step[i]
                continue
            best[i] = (loss, theta)
            if np.abs(gradient).max() < TOLERANCE:
                continue
            hessian = v[2 + k * p :].reshape(k * p, k * p) / v[0] + np.diag(np.tile(penalty, k))
            step[i] = -np.linalg.lstsq(hessian + 1e-12 * np.eye(k * p), gradient, rcond=1e-12)[0].reshape(k, p)
            following[i] = theta + step[i]
        tried = following
    for i, m in enumerate(models):
        if i in best:
            m.loss, m.theta = best[i]
    return list(models)


def score_held_out(df: DataFrame, features: str, fold: str, models: dict, out: str = "probability") -> DataFrame:
    """``df`` with the probabilities that the model of each row's own fold gives it; ``models``: fold -> model."""
    names = list(models)
    place = F.create_map(*[x for i, f in enumerate(names) for x in (F.lit(f), F.lit(float(i)))])
    from wavetable.functions.series import row_map

    def kernel(x):
        p = None
        for i, f in enumerate(names):
            on = x[:, 0] == i
            if on.any():
                q = models[f].probabilities(x[on, 1:])
                p = np.full((len(x), q.shape[1]), np.nan) if p is None else p
                p[on] = q
        return p if p is not None else np.full((len(x), 1), np.nan)

    return df.withColumn(out, row_map(kernel)(F.concat(F.array(place[F.col(fold)]), F.col(features))))
