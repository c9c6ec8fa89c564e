"""Soft-max gradient boosting of trees, many models (folds, seeds, trials) in the same jobs.

Every round grows one tree per class and model.  A level needs one job: tasks add the gradients of all models by (node,
feature, bin), and the driver picks the splits from these sums, whose size depends on parameters only.  Gradients are rounded
to multiples of 2**-30, so their sums are exact and trees do not depend on how rows are partitioned.  Rows keep their bins
and margins in a stored table, which is written again every ``STORE_EVERY`` rounds; between, tasks add the newest trees.

Bins are cut at exact percentiles of a model's own training side.  Row samples are hashes of (seed, round, row).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable.operators.scale import exact_percentiles
from wavetable.session import materialise

STORE_EVERY = 10
FIXED = float(1 << 30)


@dataclass
class Boosted:
    """One model: what it is fitted on, its parameters, and after the fit its trees per round and class."""

    name: object
    without: frozenset = frozenset()
    family: object = None
    columns: np.ndarray | None = None
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    penalty: float = 1.0
    least: float = 1.0  # hessian weight that a leaf needs
    rows: float = 1.0  # share of rows a round sees
    features: float = 1.0  # share of features a tree may use
    seed: int = 0
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None  # features x inner edges
    trees: list = field(default_factory=list)  # per round: (classes, nodes) features, bins; (classes, leaves) values

    def binned(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] >= self.edges).sum(2).astype(np.int16)

    def margins(self, bins: np.ndarray, since: int = 0, upto: int | None = None) -> np.ndarray:
        """Sum of the trees from round ``since`` on for rows of bins."""
        k = len(self.weights)
        out = np.zeros((len(bins), k))
        for split, cut, value in self.trees[since:upto]:
            for c in range(k):
                out[:, c] += value[c][_leaf(bins, split[c], cut[c], self.depth)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.margins(self.binned(x))
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _leaf(bins: np.ndarray, split: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node of each row after ``depth`` levels of a complete tree (children of i: 2 i and 2 i + 1 on the next level)."""
    at, first = np.zeros(len(bins), np.int64), 0
    for level in range(depth):
        node = first + at
        at = 2 * at + (bins[np.arange(len(bins)), split[node]] >= cut[node])
        first += 1 << level
    return at


def _uniform(h: np.ndarray, seed: int, turn: int) -> np.ndarray:
    x = h.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + turn * 7_919 + 12_345) & 0xFFFFFFFFFFFF)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def training_edges(df: DataFrame, features: str, fold: str, family: Column, without: dict, bins: int) -> dict:
    """family -> (features x (bins - 1)) exact inner percentiles of the rows whose fold it may see; ``without``: family -> folds left out."""
    held = F.lit(False)
    for name, folds in without.items():
        if folds:
            held = held | (family.eqNullSafe(F.lit(name)) & F.col(fold).isin(*folds))
    long = df.where(~F.coalesce(held, F.lit(False))).select(family.alias("family"), F.posexplode(features).alias("feature", "value"))
    long = materialise(long, "bins")
    names = {f"e{i}": i / bins for i in range(1, bins)}
    out: dict = {}
    for r in exact_percentiles(long, ["family", "feature"], "value", names).collect():  # families x features rows
        out.setdefault(r["family"], {})[r["feature"]] = [r[n] for n in names]
    return {f: np.array([e[i] for i in sorted(e)]) for f, e in out.items()}


def fit_boosted(df: DataFrame, features: str, label: str, fold: str, key: str, models: Sequence[Boosted], classes: int, *, family: str | None = None, bins: int = 16) -> list[Boosted]:
    """Fit all models on a table with an array of features, an integer label, a fold and a key that tells rows apart.

    Models of one family share their bins, so they must leave out the same folds; give each fold a family of its own otherwise.
    """
    kind = F.col(family) if family else F.lit(0)
    for m in models:
        m.family = m.family if family else 0
    groups = list(dict.fromkeys(m.family for m in models))
    of_group = {g: [i for i, m in enumerate(models) if m.family == g] for g in groups}
    if any(models[i].without != models[members[0]].without for members in of_group.values() for i in members):
        raise ValueError("models of one family must leave out the same folds")
    df = df.where(F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"), F.col(fold).alias("fold"), kind.alias("family"), F.xxhash64(key).alias("h"))
    counts = df.groupBy("family", "fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # families x folds x classes rows
    edges = training_edges(df, "x", "fold", F.col("family"), {g: sorted(models[of_group[g][0]].without) for g in groups}, bins)
    for m in models:
        n = np.zeros(classes)
        for r in counts:
            if r["family"] == m.family and r["fold"] not in m.without:
                n[r["y"]] += r["n"]
        m.weights = np.where(n > 0, n.sum() / (max((n > 0).sum(), 1) * np.maximum(n, 1)), 0.0)
        m.edges, m.trees = edges[m.family], []
    state, stored = None, 0
    schema = T.StructType([T.StructField("y", T.IntegerType()), df.schema["fold"], T.StructField("family", df.schema["family"].dataType), T.StructField("h", T.LongType()), T.StructField("bins", T.BinaryType()), T.StructField("z", T.BinaryType())])

    def begin(batches):
        for b in batches:
            fam = b["family"].to_pylist()
            x = [np.asarray(v.as_py(), float) for v in b["x"]]
            rows = [models[of_group[g][0]].binned(v[None])[0] if g in of_group else np.zeros(0, np.int16) for g, v in zip(fam, x, strict=True)]
            z = [np.zeros(len(of_group.get(g, [])) * classes).tobytes() for g in fam]
            yield pa.RecordBatch.from_arrays([b["y"], b["fold"], b["family"], b["h"], pa.array([r.astype(np.int16).tobytes() for r in rows], pa.binary()), pa.array(z, pa.binary())], names=schema.names)

    def groups_of(b: pa.RecordBatch):
        """(rows, models, labels, folds, hashes, bins, margins with the newest trees) of each family of a batch."""
        fam = b["family"].to_pylist()
        y, h, folds = b["y"].to_numpy(), b["h"].to_numpy(), b["fold"].to_pylist()
        for g, members in of_group.items():
            at = np.array([i for i, f in enumerate(fam) if f == g], np.int64)
            if not len(at):
                continue
            bins_ = np.stack([np.frombuffer(b["bins"][int(i)].as_py(), np.int16) for i in at])
            z = np.stack([np.frombuffer(b["z"][int(i)].as_py(), np.float64) for i in at]).reshape(len(at), len(members), classes).copy()
            for j, i in enumerate(members):
                z[:, j] += models[i].margins(bins_, since=stored)
            yield at, members, y[at], [folds[i] for i in at], h[at], bins_, z

    def add(batches):
        for b in batches:
            z_out = [x.as_py() for x in b["z"]]
            for at, _, _, _, _, _, z in groups_of(b):
                for r, i in enumerate(at):
                    z_out[i] = z[r].ravel().tobytes()
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(z_out, pa.binary())], names=schema.names)

    state = materialise(df.mapInArrow(begin, schema), "boost")
    width = len(next(iter(edges.values())))
    for turn in range(max(m.rounds for m in models)):
        if turn - stored >= STORE_EVERY:
            state = materialise(state.mapInArrow(add, schema), "boost")
            stored = turn
        grown = {i: _Grown(m, classes, width, turn) for i, m in enumerate(models) if turn < m.rounds}
        for level in range(max(models[i].depth for i in grown)):
            live = {i: g for i, g in grown.items() if level < models[i].depth}
            flat = _level_sums(state, groups_of, models, live, level, turn, classes, bins)
            for i, g in live.items():
                if i in flat:
                    g.choose(level, flat[i].reshape(2, classes, 1 << level, width, bins))
        for i, g in grown.items():
            models[i].trees.append((g.split, g.cut, g.value))
    return list(models)


class _Grown:
    """The trees of one model in one round while they grow."""

    def __init__(self, m: Boosted, classes: int, width: int, turn: int):
        self.m = m
        self.split, self.cut = np.zeros((classes, (1 << m.depth) - 1), np.int64), np.full((classes, (1 << m.depth) - 1), 32_000)
        self.value = np.zeros((classes, 1 << m.depth))
        self.allowed = np.zeros(width, bool)
        usable = np.arange(width) if m.columns is None else np.asarray(m.columns)
        rng = np.random.default_rng([m.seed, turn])
        self.allowed[usable if m.features >= 1 else rng.choice(usable, max(1, int(round(m.features * len(usable)))), replace=False)] = True

    def choose(self, level: int, sums: np.ndarray) -> None:
        """The best split of every node of a level; a node without a gain keeps its rows on the left."""
        m, first = self.m, (1 << level) - 1
        left = sums.cumsum(-1)[..., :-1]
        whole = sums.sum(-1)[..., 0]  # the same for every feature
        right = whole[..., None, None] - left
        score = lambda s: s[0] ** 2 / (s[1] + m.penalty)
        gain = score(left) + score(right) - score(whole)[..., None, None]
        gain = np.where((left[1] >= m.least) & (right[1] >= m.least) & self.allowed[:, None], gain, -np.inf)
        k, nodes = gain.shape[:2]
        best = gain.reshape(k, nodes, -1).argmax(-1)
        f, c = np.unravel_index(best, gain.shape[2:])
        a, n = np.indices((k, nodes))
        splits = gain[a, n, f, c] > 1e-9
        self.split[:, first : first + nodes] = np.where(splits, f, 0)
        self.cut[:, first : first + nodes] = np.where(splits, c + 1, 32_000)
        if level == m.depth - 1:
            leaf = lambda s: -m.rate * s[0] / (s[1] + m.penalty)
            self.value[:, 0::2] = np.where(splits, leaf(left[:, a, n, f, c]), leaf(whole))
            self.value[:, 1::2] = np.where(splits, leaf(right[:, a, n, f, c]), 0.0)


def _level_sums(state: DataFrame, groups_of, models, live: dict, level: int, turn: int, classes: int, bins: int) -> dict:
    """model -> gradients and hessians by (class, node, feature, bin) of the rows its round sees, from one job."""

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, members, y, folds, h, binned, z in groups_of(b):
                for j, i in enumerate(members):
                    if i not in live:
                        continue
                    m, g = models[i], live[i]
                    on = np.fromiter((f not in m.without for f in folds), bool, len(folds)) & (m.weights[y] > 0)
                    if m.rows < 1:
                        on &= _uniform(h, m.seed, turn) < m.rows
                    if not on.any():
                        continue
                    x, w, t = binned[on].astype(np.int64), m.weights[y[on]], y[on]
                    e = np.exp(z[on, j] - z[on, j].max(1, keepdims=True))
                    p = e / e.sum(1, keepdims=True)
                    width = x.shape[1]
                    out = total.setdefault(i, np.zeros((2, classes, 1 << level, width, bins)))
                    for c in range(classes):
                        node = _leaf(x, g.split[c], g.cut[c], level)
                        place = ((node[:, None] * width + np.arange(width)) * bins + x).ravel()
                        for s, v in enumerate((w * (p[:, c] - (t == c)), w * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6))):
                            fixed = np.repeat(np.round(v * FIXED), width)
                            out[s, c] += np.bincount(place, fixed, out[s, c].size).reshape(out[s, c].shape)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], names=["model", "v"])

    def merge(t: pa.Table) -> pa.Table:
        return pa.table([t["model"].slice(0, 1), pa.array([np.sum([v.values.to_numpy() for v in t["v"]], axis=0).tolist()], pa.list_(pa.float64()))], ["model", "v"])

    schema = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    got = state.mapInArrow(partial, schema).groupBy("model").applyInArrow(merge, schema).collect()  # one row per model
    return {r["model"]: np.array(r["v"]) / FIXED for r in got}
