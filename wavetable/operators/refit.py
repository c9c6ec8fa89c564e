"""Refit of every learned step on each fold's training side, all folds together.

What a fold's fit needs are sums: cross-products, sums per label, smallest values, C'C and C'D.  They are computed per fold in one
pass over the series, and the training side of a fold is the total less what the fold holds, so ten folds read the series no
more often than one.  Only the alternating unmixing needs passes of its own, one per iteration for all folds.

``fit_folds``       region components, class and subclass templates and component spectra per fold
``fold_features``   one row per (fit, file): features of all files under each fold's fit, from one pass
``select_features`` the most informative features of each training side
``evaluate``        held-out predictions per (seed, fold, algorithm, file)

No value or label of a held-out file enters the fit that predicts it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable import catalog
from wavetable.functions.series import _by_width, row_map
from wavetable.operators import features as ft
from wavetable.operators import unmix
from wavetable.operators.boosting import Boosted, fit_boosted
from wavetable.operators.models import latent_model
from wavetable.operators.softmax import Softmax, fit_many, fold_moments, standardised, training_side
from wavetable.operators.statistics import information
from wavetable.operators.vectorsums import vector_sums
from wavetable.session import materialise

MAX_FOLDS = 1_000  # folds whose sums the driver holds; more are an error
TOP_FEATURES = 35
ALL = "all"  # the fit that leaves out no fold
ALGORITHMS = ("latent", "logistic", "boosted")


@dataclass
class FoldFit:
    """Everything learned on the rows outside one fold."""

    fold: object
    low: float  # smallest value of the training side; unmixing works on y - low
    mean: np.ndarray  # the reference of the scatter correction
    components: list
    templates: dict  # "class" and "sub": label -> mean series
    spectra: np.ndarray
    variables: list
    errors: list = field(default_factory=list)

    def families(self, axis: Sequence[float]) -> list[ft.Family]:
        out = [ft.scatter_family(axis, self.mean), *([ft.component_family(self.components)] if self.components else [])]
        for kind, t in self.templates.items():
            out += [ft.angle_family(t, f"sam_{kind}_"), ft.angle_family(t, f"sam_region_{kind}_", axis, catalog.ANGLE_REGION)] if t else []
        return out

    def abundance(self) -> ft.Family:
        return ft.Family([f"mcr_C{i + 1}" for i in range(len(self.spectra))], lambda x: unmix.solve_non_negative(x - self.low, self.spectra))


def _side(parts: dict, fold) -> tuple[int, np.ndarray, np.ndarray]:
    return training_side(parts, frozenset([fold]))


def _means(sums: list, fold, level: int) -> dict:
    """label -> mean series of the rows outside ``fold``; ``sums``: (fold, labels, n, s)."""
    total: dict = {}
    for f, labels, n, s in sums:
        if f != fold and labels[level] is not None:
            a, b = total.get(labels[level], (0, 0.0))
            total[labels[level]] = (a + n, b + s)
    return {k: total[k][1] / total[k][0] for k in sorted(total)}


def fit_folds(df: DataFrame, y: str, axis: Sequence[float], fold: str, label: str, sublabel: str, *, regions: dict | None = None, components: int = 8, iterations: int = 80, tol: float = 1e-7, offset_pct: float = 5.0, everything: bool = False) -> dict:
    """fold -> :class:`FoldFit`.  ``df`` should be a stored table: it is read three times and once per iteration of the unmixing.

    ``everything`` gives one fit, ``ALL``, that leaves nothing out: the one to save.
    """
    moments = fold_moments(df, y, fold)
    if len(moments) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    rows = vector_sums(df, [fold, label, sublabel], y).limit(ft.MAX_TEMPLATES + 1).collect()
    if len(rows) > ft.MAX_TEMPLATES:
        raise ValueError("too many labels and folds")
    sums = [(r[fold], (r[label], r[sublabel]), np.array(r["n"]), np.array(r["s"])) for r in rows]
    lows = {r[fold]: r["m"] for r in df.groupBy(fold).agg(F.min(F.array_min(y)).alias("m")).collect()}  # one row per fold
    folds = [ALL] if everything else sorted(moments)
    low = {f: min(v for g, v in lows.items() if g != f) for f in folds}
    picked = {}
    for f in folds:
        _, mean, cov = _side(moments, f)
        m = mean - low[f]
        picked[f] = unmix.purest_positions(m, np.sqrt(np.maximum(np.diag(cov), 0.0)), cov + np.outer(m, m), components, offset_pct)
    wanted = sorted({p for v in picked.values() for p in v})
    tops = {r[fold]: r for r in df.groupBy(fold).agg(*[F.max_by(y, F.struct(F.col(y)[p], y)).alias(f"t{p}") for p in wanted]).collect()}  # folds x positions series
    start = {}
    for f in folds:
        best = [max((list(tops[g][f"t{p}"]) for g in tops if g != f), key=lambda s: (s[p], s)) for p in picked[f]]
        start[f] = unmix.unit_rows(np.array(best) - low[f])
    fits = {}
    for f in folds:
        _, mean, cov = _side(moments, f)
        templates = {"class": _means(sums, f, 0), "sub": _means(sums, f, 1)}
        fits[f] = FoldFit(f, low[f], mean, ft.region_components(mean, cov, axis, regions), templates, start[f], picked[f])
    return _unmix_folds(df, y, fold, fits, iterations, tol)


def _unmix_folds(df: DataFrame, y: str, fold: str, fits: dict, iterations: int, tol: float) -> dict:
    """Alternate the unmixing of all folds: one job per iteration adds C'C, C'D and |D|^2 of every fold that still moves."""
    live = list(fits)
    schema = T.StructType([T.StructField("fit", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    number = {f: i for i, f in enumerate(fits)}
    for _ in range(iterations):
        if not live:
            break
        asked = {f: (fits[f].spectra, fits[f].low) for f in live}

        def partial(batches, asked=asked):
            total: dict = {}
            for b in batches:
                own = b.column(1).to_pylist()
                for at, x in _by_width(b.column(0)):
                    for f, (s, low) in asked.items():
                        d = x[np.fromiter((own[r] != f for r in at), bool, len(at))] - low
                        if len(d):
                            c = unmix.solve_non_negative(d, s)
                            total[f] = total.get(f, 0.0) + np.concatenate([(c.T @ c).ravel(), (c.T @ d).ravel(), [float((d * d).sum())]])
            yield pa.RecordBatch.from_arrays([pa.array([number[f] for f in total], pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["fit", "v"])

        def merge(t: pa.Table) -> pa.Table:
            return pa.table([t["fit"].slice(0, 1), pa.array([np.sum([v.values.to_numpy() for v in t["v"]], axis=0).tolist()], pa.list_(pa.float64()))], ["fit", "v"])

        got = {r["fit"]: np.array(r["v"]) for r in df.select(y, fold).mapInArrow(partial, schema).groupBy("fit").applyInArrow(merge, schema).collect()}  # one row per fold
        still = []
        for f in live:
            m, v = fits[f], got[number[f]]
            k, width = m.spectra.shape
            cc, cd, dd = v[: k * k].reshape(k, k), v[k * k : -1].reshape(k, width), v[-1]
            m.errors.append(float(dd - 2 * (cd * m.spectra).sum() + ((cc @ m.spectra) * m.spectra).sum()))
            if len(m.errors) > 1 and abs(m.errors[-2] - m.errors[-1]) <= tol * max(dd, 1e-30):
                continue
            m.spectra = unmix.next_spectra(cc, cd, m.spectra)
            still.append(f)
        live = still
    return fits


def fold_features(df: DataFrame, y: str, axis: Sequence[float], fits: dict, file: str, keep: Sequence[str], static: Sequence[ft.Family] = ()) -> tuple[DataFrame, dict]:
    """((fit, file, kept columns, x), fit -> names): per file the mean of every feature and the spread of every abundance under each fit.

    ``keep``: columns that are constant in a file (labels, fold).  ``static``: families that learn nothing.  Missing values count as 0.
    """
    folds = list(fits)
    per_fit = {f: [*static, *fits[f].families(axis), fits[f].abundance()] for f in folds}
    names = {f: [n for fam in per_fit[f] for n in fam.names] + [f"{n}_std" for n in per_fit[f][-1].names] for f in folds}
    kernels = [fam.kernel for f in folds for fam in per_fit[f]]
    packed = row_map(lambda x: np.nan_to_num(np.concatenate([k(x) for k in kernels], axis=1), nan=0.0, posinf=0.0, neginf=0.0))(y)
    sums = vector_sums(df.select(file, *keep, packed.alias("_all")), [file, *keep], "_all")
    cut, parts = 0, []
    for f in folds:
        width = sum(len(fam.names) for fam in per_fit[f])
        last = len(per_fit[f][-1].names)
        mean = F.transform(F.sequence(F.lit(cut), F.lit(cut + width - 1)), lambda i: F.get("s", i) / F.get("n", i))
        spread = F.transform(F.sequence(F.lit(cut + width - last), F.lit(cut + width - 1)), lambda i: F.when(F.get("n", i) > 1, F.sqrt(F.get("m2", i) / (F.get("n", i) - 1))).otherwise(0.0))
        parts.append(F.struct(F.lit(f).alias("fit"), F.concat(mean, spread).alias("x")))
        cut += width
    out = sums.select(file, *keep, F.explode(F.array(*parts)).alias("e"))
    return materialise(out.select("e.fit", file, *keep, "e.x"), "fold_features"), names


def select_features(table: DataFrame, fold: str, label: str, top: int = TOP_FEATURES, bins: int = 10) -> dict:
    """fit -> numbers of the features that tell most about the label on the training side, best first; ties to the smaller number."""
    long = table.where(F.col("fit") != F.col(fold)).select("fit", label, F.posexplode("x").alias("feature", "value"))
    ranked = information(long, ["fit", "feature"], label, bins)
    place = Window.partitionBy("fit").orderBy(F.desc(F.round("mi", 12)), "feature")
    best = ranked.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    out: dict = {}
    for r in best.orderBy("fit", "place").collect():  # folds x top rows
        out.setdefault(r["fit"], []).append(r["feature"])
    return {f: np.array(v) for f, v in out.items()}


def _latent(table: DataFrame, fold: str, label: str, selected: dict, components: int) -> dict:
    """fit -> (shift, matrix, coefficients, shares, classes) of a partial least squares fit with standardised features."""
    key = F.concat_ws("|", F.col("fit").cast("string"), F.col(fold).cast("string"))
    moments = fold_moments(table.withColumn("_side", key), "x", "_side")
    sums = [(r["fit"], r[fold], r[label], np.array(r["n"]), np.array(r["s"])) for r in vector_sums(table, ["fit", fold, label], "x").collect()]  # fits x folds x classes
    out = {}
    for f, columns in selected.items():
        mine = {s: m for s, m in moments.items() if s.split("|", 1)[0] == str(f) and s != f"{f}|{f}"}
        n, mean, cov = training_side(mine)
        mean, cov = mean[columns], cov[np.ix_(columns, columns)]
        shift, matrix = standardised(n, mean, cov)
        labels: dict = {}
        for fit, of, k, count, s in sums:
            if fit == f and of != f:
                a, b = labels.get(k, (0, 0.0))
                labels[k] = (a + count[0], b + s)
        classes = sorted(labels)
        means = {k: (labels[k][1][columns] / labels[k][0] - shift) @ matrix for k in classes}
        m = latent_model(n, np.zeros(len(columns)), matrix.T @ cov @ matrix, means, {k: labels[k][0] for k in classes}, components)
        out[f] = (shift, matrix, m.rotation @ m.loadings.T, m.class_share, classes)
    return out


def evaluate(table: DataFrame, file: str, fold: str, label: str, classes: int, *, selected: dict | None = None, algorithms: Sequence[str] = ALGORITHMS, seeds: Sequence[int] = (42,), reg: float = 0.01, components: int = 5, rounds: int = 100, depth: int = 3) -> DataFrame:
    """(algorithm, seed, fold, file, y_true, p0.., pred): every file predicted by the models that did not see its fold.

    ``table``: (fit, file, fold, label, x) as :func:`fold_features` gives it, labels from 0.  Seeds change the boosted model (its rows and
    features are samples); the other two have no random part and are given for each seed alike.
    """
    table = table.withColumn("_y", F.col(label).cast("int"))
    selected = selected if selected is not None else select_features(table, fold, "_y")
    folds = list(selected)
    held = table.where(F.col("fit") == F.col(fold))
    scorers: dict = {}
    latent = _latent(table, fold, "_y", selected, components)
    if "latent" in algorithms:
        for f in folds:
            shift, matrix, beta, share, names = latent[f]

            def decode(x, columns=selected[f], shift=shift, matrix=matrix, beta=beta, share=share, names=names):
                s = (x[:, columns] - shift) @ matrix @ beta + share
                s = s - s.min(1, keepdims=True)
                out = np.zeros((len(x), classes))
                out[:, names] = s / (s.sum(1, keepdims=True) + 1e-9)
                return out

            for seed in seeds:
                scorers["latent", seed, f] = decode
    if "logistic" in algorithms:
        models = [Softmax(f, frozenset([f]), latent[f][0], latent[f][1], selected[f], reg, family=f) for f in folds]
        fit_many(table, "x", "_y", fold, models, classes, family="fit")
        for m in models:
            for seed in seeds:
                scorers["logistic", seed, m.name] = m.probabilities
    if "boosted" in algorithms:
        models = [Boosted((seed, f), frozenset([f]), f, selected[f], rounds, depth, rows=0.8, features=0.8, seed=seed) for f in folds for seed in seeds]
        fit_boosted(table, "x", "_y", fold, file, models, classes, family="fit")
        for m in models:
            scorers["boosted", *m.name] = m.probabilities
    lines = [(a, s) for a in algorithms for s in seeds]

    def kernel(x):
        out = np.full((len(x), len(lines) * classes), np.nan)
        for i, f in enumerate(folds):
            on = x[:, 0] == i
            if on.any():
                out[on] = np.concatenate([scorers[a, s, f](x[on, 1:]) for a, s in lines], axis=1)
        return out

    place = F.create_map(*[v for i, f in enumerate(folds) for v in (F.lit(f), F.lit(float(i)))])
    scored = held.withColumn("_p", row_map(kernel)(F.concat(F.array(place[F.col(fold)]), F.col("x"))))
    each = [F.struct(F.lit(a).alias("algorithm"), F.lit(s).alias("seed"), F.slice("_p", i * classes + 1, classes).alias("p")) for i, (a, s) in enumerate(lines)]
    rows = scored.select(fold, file, F.col("_y").cast("long").alias("y_true"), F.explode(F.array(*each)).alias("e"))
    best = F.array_position(F.col("e.p"), F.array_max("e.p")) - 1
    return rows.select("e.algorithm", "e.seed", fold, file, "y_true", *[F.col("e.p")[i].alias(f"p{i}") for i in range(classes)], best.cast("long").alias("pred"))
