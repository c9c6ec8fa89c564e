"""Model jobs: training on a table with Spark ML, and scoring of tables.

Partial least squares needs only cross-products of the features with themselves and with the labels;
those come from one distributed pass, and the small eigenproblems run on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.functions.linear import linear_map
from wavetable.functions.series import exploded, row_map
from wavetable.operators import features as ft
from wavetable.operators import margins, softmax
from wavetable.operators.evaluate import class_metrics, confusion, soft_vote, summary_metrics, with_prediction
from wavetable.operators.scale import checked_broadcast, hash_bucket, hash_key, ranked
from wavetable.operators.splits import MAX_FOLDS
from wavetable.operators.moments import second_moments
from wavetable.session import materialise

c = F.col
ABSTAIN_BELOW = 0.55


# Folds or trials fitted at the same time from the driver.
PARALLEL_FITS = 4


def balanced(df: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """Weight n / (classes * class size) per row.

    With a ``key``, rows are dealt by its hash into as many partitions as the session shuffles to, in key order: fits that draw samples by partition
    and row (forests) then give the same model whatever the input's partitions and the number of cores.
    """
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = n.crossJoin(F.broadcast(total)).select(label, (c("_t") / (c("_n") * c("_k"))).alias("weight"))
    out = df.join(checked_broadcast(w), label)
    if key is None:
        return out
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, key).sortWithinPartitions(key)


def in_parallel(spark: SparkSession, items: Sequence, fn: Callable) -> list:
    """Run independent fits from a few driver threads, so their jobs share the cluster.

    Not for fits with a PCA stage: its driver-side SVD is not safe to run in two threads.
    """
    with ThreadPool(min(PARALLEL_FITS, max(1, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)


def standardised_components(df: DataFrame, y: str, k: int) -> tuple[DataFrame, list[float]]:
    """Scores and explained shares of k principal components of the standardised positions."""
    v = df.withColumn("_v", array_to_vector(y))
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled)
    out = model.transform(scaled).withColumn("scores", vector_to_array("_p")).drop("_v", "_s", "_p")
    return out, [float(x) for x in model.explainedVariance.toArray()]


# ---------------------------------------------------------------- estimators

def logistic(components: int | None = None, reg: float = 0.01) -> Pipeline:
    stages = [StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True)]
    last = "_s"
    if components:
        stages.append(PCA(k=components, inputCol="_s", outputCol="_p"))
        last = "_p"
    stages.append(LogisticRegression(featuresCol=last, weightCol="weight", regParam=reg, maxIter=100, family="multinomial"))
    return Pipeline(stages=stages)


def forest(trees: int = 50, depth: int = 6, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)])


def boosted(rounds: int = 20, depth: int = 3, step: float = 0.1, seed: int = 42) -> Pipeline:
    base = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, weightCol="weight")
    return Pipeline(stages=[OneVsRest(classifier=base, parallelism=4, weightCol="weight")])


def linear_margin(reg: float = 0.01) -> Pipeline:
    base = LinearSVC(maxIter=50, regParam=reg, standardization=True, weightCol="weight")
    return Pipeline(stages=[OneVsRest(classifier=base, parallelism=4, weightCol="weight", rawPredictionCol="rawPrediction")])


def assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Feature vector and integer label next to the keys."""
    v = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)
    return v.withColumn("label", c(label).cast("double"))


def probabilities(scored: DataFrame, k: int, col: str = "probability") -> DataFrame:
    """Spread a probability vector over p0 .. p{k-1}."""
    d = scored.withColumn("_p", vector_to_array(col))
    return d.withColumns({f"p{i}": c("_p")[i] for i in range(k)}).drop("_p")


def raw_to_probabilities(scored: DataFrame, k: int, col: str = "rawPrediction", slope: float = 2.0) -> DataFrame:
    """Logistic of one-vs-rest scores, scaled to sum to one; the loss of boosted trees has 1 / (1 + exp(-2 v))."""
    d = scored.withColumn("_r", F.transform(vector_to_array(col), lambda v: 1.0 / (1.0 + F.exp(-slope * v))))
    total = F.aggregate("_r", F.lit(0.0), lambda a, v: a + v)
    return d.withColumns({f"p{i}": c("_r")[i] / total for i in range(k)}).drop("_r")


def calibrated_margins(df: DataFrame, features: str, label: str, key: str, k: int, *, components: int | None = 20, cost: float = 1.0, inner: int = 3) -> list[margins.Margins]:
    """Squared-hinge linear models on standardised components with isotonic calibration, cross-fitted over ``inner`` folds by hash of ``key``.

    Each model and its preparation see all inner folds but one; its curves come from that one.  ``margins.probabilities`` averages the models.
    """
    part = F.pmod(F.xxhash64(key), F.lit(inner)).cast("int")
    d = materialise(df.select(c(features).alias("_x"), c(label).cast("int").alias("_y"), part.alias("_f")), "margins")
    moments = softmax.fold_moments(d, "_x", "_f")
    out = []
    for f in sorted(moments):
        shift, matrix = softmax.standardised(*softmax.training_side(moments, frozenset([f])), components)
        out.append(margins.Margins(softmax.Softmax(f, frozenset([f]), shift, matrix), cost))
    margins.fit_margins(d, "_x", "_y", "_f", out, k, width=out[0].side.matrix.shape[1])
    return margins.calibrate(d, "_x", "_y", "_f", out, k)


# ---------------------------------------------------------------- partial least squares

@dataclass
class LatentModel:
    mean: np.ndarray
    rotation: np.ndarray  # B x a
    loadings: np.ndarray  # classes x a
    class_share: np.ndarray
    classes: list


def fit_latent(df: DataFrame, y: str, label: str, components: int) -> LatentModel:
    """Partial least squares of one-hot labels on centred series, from cross-products only."""
    n, mean, _, moments = second_moments(df, y)
    means = ft.fit_templates(df, y, label)
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    return latent_model(n, mean, moments - np.outer(mean, mean), means, counts, components)


def latent_model(n: int, mean: np.ndarray, cov: np.ndarray, means: dict, counts: dict, components: int) -> LatentModel:
    """The same from moments that are already known: population covariance, class means and class sizes."""
    xx = n * cov
    classes = list(means)
    xy = np.stack([counts[k] * (means[k] - mean) for k in classes], axis=1)
    rotation, loadings, basis = [], [], []
    s = xy.copy()
    for _ in range(min(components, xx.shape[0], n - 1)):
        u, sv, _ = np.linalg.svd(s, full_matrices=False)
        if sv[0] < 1e-12:
            break
        w = u[:, 0]
        size = np.sqrt(w @ xx @ w)
        if size < 1e-12:
            break
        w = w / size
        p = xx @ w
        v = p - sum((b * (b @ p) for b in basis), np.zeros_like(p))
        v = v / np.linalg.norm(v)
        rotation.append(w)
        loadings.append(xy.T @ w)
        basis.append(v)
        s = s - np.outer(v, v @ s)
    return LatentModel(mean, np.array(rotation).T, np.array(loadings).T, np.array([counts[k] / n for k in classes]), classes)


def latent_scores(df: DataFrame, y: str, m: LatentModel, out: str = "scores") -> DataFrame:
    return df.withColumn(out, row_map(lambda x: (x - m.mean) @ m.rotation)(y))


def latent_decode(df: DataFrame, y: str, m: LatentModel) -> DataFrame:
    """Class scores of the regression, shifted to zero minimum and scaled to sum to one; argmax class."""
    beta = m.rotation @ m.loadings.T

    def kernel(x):
        s = (x - m.mean) @ beta + m.class_share
        s = s - s.min(1, keepdims=True)
        return s / (s.sum(1, keepdims=True) + 1e-9)

    k = len(m.classes)
    d = df.withColumn("_p", row_map(kernel)(y))
    return with_prediction(d.withColumns({f"p{i}": c("_p")[i] for i in range(k)}).drop("_p"), k)


def latent_logistic(df: DataFrame, y: str, label: str, m: LatentModel) -> Callable[[DataFrame], DataFrame]:
    """Balanced multinomial logistic on the latent scores; returns the scoring function."""
    prepare = lambda d: latent_scores(d, y, m).withColumn("features", array_to_vector("scores"))
    train = balanced(prepare(df).withColumn("label", c(label).cast("double")), "label")
    lr = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=200, family="multinomial").fit(train)
    return lambda d: with_prediction(probabilities(lr.transform(prepare(d)), len(m.classes)), len(m.classes))


# ---------------------------------------------------------------- search, folds, scoring

def macro_f1(scored: DataFrame, k: int) -> float:
    cells = confusion(scored, "y_true", list(range(k)), k)
    return float(summary_metrics(class_metrics(cells)).first()["macro_f1"])


def logistic_search(df: DataFrame, features: str, label: str, fold: str, train: frozenset, valid: frozenset, trials: Sequence[dict], k: int) -> tuple[list[tuple[dict, float]], softmax.Softmax]:
    """Fit every trial on the folds in ``train``, rank by macro F1 on those in ``valid``, refit the best on both.

    ``df`` is a stored table.  All trials share each job: one for the moments that prepare the features, one per Newton iteration, one that counts
    the confusion of all.  Preparation and weights of a trial come from its training side.
    """
    moments = softmax.fold_moments(df, features, fold)
    folds = frozenset(moments)

    def model(name, hp, seen):
        shift, matrix = softmax.standardised(*softmax.training_side(moments, folds - seen), hp.get("components"))
        return softmax.Softmax(name, folds - seen, shift, matrix, reg=hp["reg"])

    models = [model(i, hp, train) for i, hp in enumerate(trials)]
    softmax.fit_many(df, features, label, fold, models, k)
    called = row_map(lambda x: np.stack([m.probabilities(x).argmax(1) for m in models], axis=1).astype(float))(features)
    scored = df.where(c(fold).isin(*valid)).select(c(label).cast("long").alias("y_true"), F.posexplode(called).alias("trial", "_p")).withColumn("pred", c("_p").cast("long"))
    scores = summary_metrics(class_metrics(confusion(scored, "y_true", list(range(k)), k, ["trial"]), ["trial"]), ["trial"])
    f1 = {r["trial"]: float(r["macro_f1"]) for r in scores.collect()}  # one row per trial
    results = [(hp, f1.get(i, 0.0)) for i, hp in enumerate(trials)]
    best = max(range(len(trials)), key=lambda i: (results[i][1], -i))
    refit = model("best", trials[best], train | valid)
    softmax.fit_many(df, features, label, fold, [refit], k)
    return results, refit


def templates_by_fold(df: DataFrame, y: str, label: str, fold: str) -> dict:
    """Class means on the training side of every fold from one aggregation: total minus the held-out part."""
    e = exploded(df, [label, fold], y).groupBy(label, fold, "pos").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    total = e.groupBy(label, "pos").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    ids = [r[0] for r in e.select(fold).distinct().limit(MAX_FOLDS + 1).collect()]
    if len(ids) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    grid = total.withColumn("_fold", F.explode(F.array(*[F.lit(i).cast(df.schema[fold].dataType) for i in ids])))
    j = grid.join(e.withColumnRenamed(fold, "_fold"), [label, "pos", "_fold"], "left")
    m = j.select(label, "_fold", "pos", F.try_divide(c("_s") - F.coalesce("s", F.lit(0.0)), c("_n") - F.coalesce("n", F.lit(0))).alias("m"))
    packed = m.where("m is not null").groupBy("_fold", label).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("t"))
    rows = packed.limit(ft.MAX_TEMPLATES + 1).collect()
    if len(rows) > ft.MAX_TEMPLATES:
        raise ValueError("too many fold templates")
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["_fold"], r[label])):
        out.setdefault(r["_fold"], {})[r[label]] = np.array([p.m for p in r.t])
    return out


def per_fold(folds: Iterable, fit_and_score: Callable[[object], DataFrame]) -> DataFrame:
    """Union of the held-out predictions of every fold; each fold is fitted on its training side only."""
    return reduce(lambda a, b: a.unionByName(b), [fit_and_score(f).withColumn("fold", F.lit(f)) for f in folds])


def score_files(scored: DataFrame, file: str, k: int, abstain_below: float = ABSTAIN_BELOW) -> DataFrame:
    """Row probabilities to one decision per file; below the threshold the answer is "abstain"."""
    v = soft_vote(scored, [file], k)
    return v.withColumn("decision", F.when(c("top_p") < abstain_below, "abstain").otherwise(c("pred").cast("string")))


def contributions(df: DataFrame, y: str, weights: np.ndarray, names: Sequence, key: str) -> DataFrame:
    """Per-position share of a linear score for every class: weight times value, in long form."""
    per_class = [F.struct(F.lit(n).alias("cls"), F.zip_with(y, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b).alias("z")) for n, w in zip(names, weights)]
    e = df.select(key, F.explode(F.array(*per_class)).alias("e"))
    return exploded(e.select(key, "e.cls", "e.z"), [key, "cls"], "z", v="contribution")


def top_coefficients(spark, weights: np.ndarray, names: Sequence, n: int = 11) -> DataFrame:
    """Largest absolute coefficients per class."""
    rows = []
    for name, w in zip(names, weights):
        for place, i in enumerate(sorted(range(len(w)), key=lambda i: (-abs(w[i]), i))[:n], 1):
            rows.append((name, place, int(i), float(w[i])))
    return spark.createDataFrame(rows, "cls long, place long, pos long, coefficient double")


def top_n_hits(scored: DataFrame, k: int, n: int) -> DataFrame:
    """Share of rows whose true class is the first / among the first n, next to chance."""
    order = F.reverse(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.get(vector_to_array("probability"), i).alias("p"), (-i).alias("k")))))
    d = scored.withColumn("_o", F.transform(F.slice(order, 1, n), lambda s: -s["k"]))
    return d.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((c("_o")[0] == c("label").cast("int")).cast("double")).alias("top1"),
        F.avg(F.array_contains("_o", c("label").cast("int")).cast("double")).alias("topn"),
        F.lit(1.0 / k).alias("chance"),
    )


def permute_labels(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Give every row the label of another row: labels shifted by one in hash order against key order."""
    h = df.withColumn("_h", hash_key(key, seed=seed)).withColumn("_g", hash_key(key, seed=seed + 1))
    a = ranked(h, [], [c("_h"), c(key)], hash_bucket(c("_h")), "_i").drop("_h", "_g")
    b = ranked(h.select(key, label, "_g"), [], [c("_g"), c(key)], hash_bucket(c("_g")), "_i").select("_i", c(label).alias("_l"))
    return a.join(b, "_i").withColumn(label, c("_l")).drop("_i", "_l")


def permuted_importance(df: DataFrame, features: Sequence[str], label: str, key: str, seed: int, drop_at: float = 0.5) -> DataFrame:
    """Forest importance with shuffled labels over importance with real labels; high ratios are suspect."""
    def importance(d: DataFrame) -> np.ndarray:
        train = balanced(assembled(d, features, label), "label", key).cache()
        out = forest(seed=seed).fit(train).stages[0].featureImportances.toArray()
        train.unpersist()
        return out

    df = materialise(df.select(key, label, *features), "importance")  # two fits, each with several passes
    real, fake = importance(df), importance(permute_labels(df, key, label, seed))
    rows = [(f, float(a), float(b), float(b / a) if a > 0 else None) for f, a, b in zip(features, real, fake)]
    t = df.sparkSession.createDataFrame(rows, "feature string, real double, shuffled double, ratio double")
    return t.withColumn("drop", F.coalesce(c("ratio") >= drop_at, F.lit(True)))


def stack_per_fold(wide: DataFrame, features: Sequence[str], k: int, reg: float = 0.01) -> DataFrame:
    """Logistic on the models' file probabilities, each fold predicted by a fit on the other folds.

    Scaling, class weights and coefficients of a fold's model come from the other folds alone; all folds are fitted in one job per iteration.
    """
    ready, models = stack_models(wide, features, k, reg)
    out = softmax.score_held_out(ready, "_x", "fold_id", models, "_p").withColumns({f"p{i}": c("_p")[i] for i in range(k)})
    return with_prediction(out, k).select("fold_id", "file_id", "subclass", "y_true", *[f"p{i}" for i in range(k)], "pred")


def stack_models(wide: DataFrame, features: Sequence[str], k: int, reg: float = 0.01) -> tuple[DataFrame, dict]:
    """(stored feature rows, fold -> the model fitted on the other folds)."""
    ready = wide.select("fold_id", "file_id", "subclass", "y_true", F.array(*[c(f).cast("double") for f in features]).alias("_x"))
    ready = materialise(ready, "stack")
    moments = softmax.fold_moments(ready, "_x", "fold_id")  # one entry per fold
    models = {}
    for f in sorted(moments):
        shift, matrix = softmax.standardised(*softmax.training_side(moments, frozenset([f])))
        models[f] = softmax.Softmax(f, frozenset([f]), shift, matrix, reg=reg)
    softmax.fit_many(ready, "_x", "y_true", "fold_id", list(models.values()), k)
    return ready, models


def mixture_curve(means: DataFrame, label: str, y: str, pairs: Sequence[tuple], alphas: Sequence[float]) -> DataFrame:
    """Majority accuracy of alpha * a + (1 - alpha) * b over all pairs of samples from two classes.

    The score is linear (nearest class mean), so a mixture is called A exactly when
    alpha * margin(a) > -(1 - alpha) * margin(b).  Counting the pairs that satisfy it is a rank count
    per (pair of classes, alpha); no pair is ever built.  alpha = 0.5 has no majority and is left out.
    """
    from wavetable.operators.scale import running_totals

    t = ft.fit_templates(means, y, label)
    frames = []
    for a, b in pairs:
        w = t[a] - t[b]
        bias = float(t[a] @ t[a] - t[b] @ t[b]) / 2
        d = means.where(c(label).isin(a, b)).select(
            F.lit(f"{a}x{b}").alias("pair"), (c(label) == a).alias("_is_a"), (linear_map(y, w[:, None])[0] - bias).alias("_m")
        )
        frames.append(d)
    m = reduce(lambda x, z: x.unionByName(z), frames).withColumn("alpha", F.explode(F.array(*[F.lit(float(x)) for x in alphas if x != 0.5])))
    v = m.withColumn("_v", F.round(F.when(c("_is_a"), c("alpha") * c("_m")).otherwise(-(1 - c("alpha")) * c("_m")), 12) + F.lit(0.0))
    one = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")
    r = running_totals(v, ["pair", "alpha"], "_v", {"na": one(c("_is_a")), "nb": one(~c("_is_a"))})
    g = r.groupBy("pair", "alpha").agg(F.sum(c("na").cast("double") * c("nb_before")).alias("called_a"), (F.sum("na") * F.sum("nb")).alias("n_pairs"))
    share = F.try_divide(c("called_a"), c("n_pairs").cast("double"))
    return g.select("pair", "alpha", "n_pairs", F.when(c("alpha") > 0.5, share).otherwise(1 - share).alias("majority_accuracy"))
