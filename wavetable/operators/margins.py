"""Linear margins with cross-fitted isotonic calibration.

``fit_margins``  squared-hinge linear models, one per class and fold, all of them in one job per Newton step
``calibrate``    per model the monotone curve from margin to probability, from held-out margins only
``probabilities``  the mean over folds of each fold's calibrated and normalised margins

A curve is the least-squares monotone fit.  Range partitions pool their own violators to blocks; the blocks of neighbouring ranges
pool the same way, so no task and not the driver sorts all margins of a class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.functions.series import _by_width, row_map
from wavetable.operators.softmax import Softmax, class_weights

TOLERANCE = 1e-8


@dataclass
class Margins:
    """One-against-rest linear scores of all classes, fitted without some folds; ``curves`` per class after calibration."""

    side: Softmax  # what it may see and how features are prepared
    cost: float = 1.0
    theta: np.ndarray | None = None  # classes x (prepared features + 1)
    curves: list | None = None  # per class: margins and probabilities of the curve's corners

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.side.prepared(x) @ self.theta.T

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        p = np.stack([np.interp(s[:, k], *self.curves[k]) if len(self.curves[k][0]) else np.zeros(len(s)) for k in range(s.shape[1])], axis=1)
        total = p.sum(1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / s.shape[1])


def _merge(t: pa.Table) -> pa.Table:
    return pa.table([t["model"].slice(0, 1), pa.array([np.sum([v.values.to_numpy() for v in t["v"]], axis=0).tolist()], pa.list_(pa.float64()))], ["model", "v"])


def fit_margins(df: DataFrame, features: str, label: str, fold: str, models: Sequence[Margins], classes: int, *, width: int, iterations: int = 60) -> list[Margins]:
    """Minimise ``|w|^2 / 2 + cost * sum(weight * max(0, 1 - y s)^2)`` for every model and class; the intercept is penalised like a weight.

    ``width``: prepared features.  A step that does not lower the loss is halved.
    """
    class_weights(df, [m.side for m in models], label, fold, classes)
    rows = df.select(features, label, fold).where(F.col(label).isNotNull())
    schema = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    p = width + 1
    tried = {(i, k): np.zeros(p) for i in range(len(models)) for k in range(classes)}
    best: dict = {}
    step: dict = {}
    for _ in range(iterations):
        if not tried:
            break
        asked = dict(tried)

        def partial(batches, asked=asked):
            total: dict = {}
            for b in batches:
                y, f = np.asarray(b.column(1).to_pylist(), np.int64), b.column(2).to_pylist()
                for at, x in _by_width(b.column(0)):
                    for i, m in enumerate(models):
                        mine = [k for k in range(classes) if (i, k) in asked]
                        on = np.fromiter((f[r] not in m.side.without for r in at), bool, len(at)) & (m.side.weights[y[at]] > 0)
                        if not mine or not on.any():
                            continue
                        z, t = m.side.prepared(x[on]), y[at][on]
                        w = m.side.weights[t]
                        for k in mine:
                            sign = np.where(t == k, 1.0, -1.0)
                            gap = np.maximum(0.0, 1.0 - sign * (z @ asked[i, k]))
                            a = gap > 0
                            v = np.concatenate([[w @ (gap * gap)], -2.0 * (z.T @ (w * sign * gap)), 2.0 * (z[a].T @ (z[a] * w[a, None])).ravel()])
                            total[i * classes + k] = total.get(i * classes + k, 0.0) + v
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["model", "v"])

        got = {divmod(r["model"], classes): np.array(r["v"]) for r in rows.mapInArrow(partial, schema).groupBy("model").applyInArrow(_merge, schema).collect()}  # one row per model and class
        following = {}
        for key, theta in tried.items():
            v, cost = got.get(key), models[key[0]].cost
            if v is None:
                best[key] = (0.0, theta)
                continue
            loss = 0.5 * theta @ theta + cost * v[0]
            if key in best and loss > best[key][0] + 1e-12 * abs(best[key][0]):
                step[key] = step[key] / 2
                if np.abs(step[key]).max() > 1e-14:
                    following[key] = best[key][1] + step[key]
                continue
            best[key] = (loss, theta)
            gradient = theta + cost * v[1 : 1 + p]
            if np.abs(gradient).max() < TOLERANCE * max(1.0, cost * v[0]):
                continue
            step[key] = -np.linalg.solve(np.eye(p) + cost * v[1 + p :].reshape(p, p), gradient)
            following[key] = theta + step[key]
        tried = following
    for i, m in enumerate(models):
        m.theta = np.stack([best[i, k][1] for k in range(classes)])
    return list(models)


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent blocks (in order) pooled until their means rise."""
    out: list[list[float]] = []
    for a, b, s, m in zip(low.tolist(), high.tolist(), total.tolist(), n.tolist(), strict=True):
        out.append([a, b, s, m])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b2, s2, m2 = out.pop()
            out[-1] = [out[-1][0], b2, out[-1][2] + s2, out[-1][3] + m2]
    return tuple(np.array([o[i] for o in out]) for i in range(4))


def calibrate(df: DataFrame, features: str, label: str, fold: str, models: Sequence[Margins], classes: int) -> list[Margins]:
    """Curves of every model from the margins of the rows in the folds it left out."""
    models = list(models)
    scores = row_map(lambda x: np.concatenate([m.scores(x) for m in models], axis=1))(features)
    long = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(fold).alias("f"), F.posexplode(scores).alias("i", "s"))
    model, k = F.floor(F.col("i") / classes).cast("int"), (F.col("i") % classes).cast("int")
    seen = F.coalesce(*[F.when(model == i, F.col("f").isin(*m.side.without)) for i, m in enumerate(models) if m.side.without], F.lit(False))
    points = long.where(seen).select("i", "s", (F.col("y") == k).cast("double").alias("hit")).groupBy("i", "s").agg(F.sum("hit").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    names = ["i", "low", "high", "total", "n"]
    kinds = [pa.int32(), *[pa.float64()] * 4]

    def blocks(batches):
        held: dict[int, list] = {}
        for b in batches:
            i, s, total, n = (b.column(c).to_numpy() for c in range(4))
            for x in np.unique(i):
                on = i == x
                held.setdefault(int(x), []).append(pooled(s[on], s[on], total[on], n[on]))
        for x, parts in held.items():
            low, high, total, n = pooled(*[np.concatenate(v) for v in zip(*parts, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), x), pa.int32()), *map(pa.array, (low, high, total, n))], names=names)

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("low")
        v = pooled(*[t[c].to_numpy() for c in names[1:]])
        return pa.table([pa.array(np.full(len(v[0]), t["i"][0].as_py()), pa.int32()), *map(pa.array, v)], schema=pa.schema(list(zip(names, kinds, strict=True))))

    schema = "i int, low double, high double, total double, n double"
    ranges = points.repartitionByRange("i", "s").sortWithinPartitions("i", "s").mapInArrow(blocks, schema)
    curves: dict[int, list] = {}
    for r in ranges.groupBy("i").applyInArrow(join, schema).collect():  # the corners of monotone curves
        curves.setdefault(r["i"], []).append((r["low"], r["high"], r["total"] / r["n"]))
    for m_at, m in enumerate(models):
        m.curves = []
        for k_at in range(classes):
            corners = sorted(curves.get(m_at * classes + k_at, []))
            m.curves.append((np.array([x for lo, hi, _ in corners for x in (lo, hi)]), np.array([p for _, _, p in corners for _ in (0, 1)])))
    return models


def probabilities(models: Sequence[Margins]):
    """Series of features to the mean of all models' probabilities, as a column function."""
    models = list(models)
    return row_map(lambda x: np.mean([m.probabilities(x) for m in models], axis=0))
