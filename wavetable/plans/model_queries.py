"""Model jobs (M1-M10), stacking (E13) and the mixture curve (E15)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wavetable.functions.linear import linear_map
from wavetable.functions.series import row_map
from wavetable.operators import combine as cb
from wavetable.operators import features as ft
from wavetable.operators import models as ml
from wavetable.operators import margins, refit, softmax
from wavetable.operators import rollup as ru
from wavetable.operators import splits as sp
from wavetable.operators.boosting import Boosted, fit_boosted
from wavetable.operators.evaluate import probs
from wavetable.plans.feature_queries import HALF
from wavetable.plans.registry import query
from wavetable.plans.tables import AXIS, prediction, r, series, sql
from wavetable.session import materialise, shared_folder


def vectors(spark, sf):
    s = series(spark, sf)
    return s.withColumn("features", array_to_vector("y")).withColumn("label", F.col("cls").cast("double")).withColumn("y_true", F.col("cls"))


def split(d):
    """Files whose id is divisible by five are held out."""
    return ml.balanced(d.where("sample_id % 5 <> 0"), "label", "vec_id"), d.where("sample_id % 5 = 0")


def folded(spark, sf):
    """Stored series with their fold; fold 0 is held out."""
    return materialise(series(spark, sf).select("vec_id", "sample_id", "cls", "y", (F.col("sample_id") % 5).alias("fold")), "folded")


def logistic_of_train(d, components=20, reg=0.01):
    shift, matrix = softmax.standardised(*softmax.training_side(softmax.fold_moments(d, "y", "fold"), frozenset([0])), components)
    m = softmax.Softmax("train", frozenset([0]), shift, matrix, reg=reg)
    return softmax.fit_many(d, "y", "cls", "fold", [m], 4)[0]


def spread(d, p):
    return ml.with_prediction(d.withColumn("_p", p).withColumns({f"p{i}": F.col("_p")[i] for i in range(4)}).drop("_p"), 4)


def rounded(d, *keys):
    return d.select(*keys, *[F.round(p, 5).alias(p) for p in probs(4)], "pred")


@query("m1_latent_discriminant")
def m1(spark, sf):
    s = series(spark, sf)
    train = s.where("sample_id % 5 <> 0")
    m = ml.fit_latent(train, "y", "cls", 10)
    return rounded(ml.latent_logistic(train, "y", "cls", m)(s.where("sample_id % 5 = 0")), "vec_id", "cls")


@query("m1b_latent_argmax")
def m1b(spark, sf):
    s = series(spark, sf)
    m = ml.fit_latent(s.where("sample_id % 5 <> 0"), "y", "cls", 5)
    return rounded(ml.latent_decode(s.where("sample_id % 5 = 0"), "y", m), "vec_id", "cls")


# With as many components as classes minus one the fitted class scores average, over the training
# rows, to the class shares, whatever the data: a property SQL can state.
@query(
    "m1b_latent_mean_scores",
    sql("S", "SELECT cls, round(count(*) / (SELECT count(*) FROM S WHERE sample_id % 5 <> 0), 6) AS mean_score FROM S WHERE sample_id % 5 <> 0 GROUP BY cls"),
)
def m1b_mean(spark, sf):
    train = series(spark, sf).where("sample_id % 5 <> 0")
    m = ml.fit_latent(train, "y", "cls", 5)
    beta = m.rotation @ m.loadings.T
    bias = m.class_share - m.mean @ beta
    d = train.select(linear_map("y", beta).alias("z")).select(F.posexplode_outer("z").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v"))
    shift = F.element_at(F.array(*[F.lit(float(b)) for b in bias]), F.col("k") + 1)
    label = F.element_at(F.array(*[F.lit(int(k)).cast("long") for k in m.classes]), F.col("k") + 1)
    return d.select(label.alias("cls"), F.round(F.col("v") + shift, 6).alias("mean_score"))


@query("m2_logistic")
def m2(spark, sf):
    d = folded(spark, sf)
    m = logistic_of_train(d)
    return rounded(spread(d.where("fold = 0"), row_map(m.probabilities)("y")), "vec_id", "cls")


# At the optimum the free intercepts make the weighted mean probability of a class equal its weighted share of the training rows.
@query(
    "m2_logistic_mean_probability",
    sql("S", "SELECT cls, round(sum(w) / (SELECT sum(w) FROM W), 6) AS mean_probability FROM W GROUP BY cls",
        "N AS (SELECT cls, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM S WHERE sample_id % 5 <> 0 GROUP BY cls)",
        "W AS (SELECT S.cls, t / (k * n) AS w FROM S JOIN N ON S.cls = N.cls WHERE sample_id % 5 <> 0)"),
)
def m2_mean(spark, sf):
    d = folded(spark, sf)
    m = logistic_of_train(d)
    w = F.array(*[F.lit(float(x)) for x in m.weights])[F.col("cls").cast("int")]
    p = d.where("fold <> 0").select(w.alias("w"), F.posexplode(row_map(m.probabilities)("y")).alias("k", "p"))
    return p.groupBy(F.col("k").cast("long").alias("cls")).agg(F.round(F.sum(F.col("w") * F.col("p")) / F.sum("w"), 6).alias("mean_probability"))


@query("m3_linear_margin_calibrated")
def m3(spark, sf):
    d = folded(spark, sf)
    models = ml.calibrated_margins(d.where("fold <> 0"), "y", "cls", "sample_id", 4)
    return rounded(spread(d.where("fold = 0"), margins.probabilities(models)("y")), "vec_id", "cls")


@query("m4_random_forest")
def m4(spark, sf):
    train, test = split(vectors(spark, sf))
    return rounded(ml.with_prediction(ml.probabilities(ml.forest(30, 6).fit(train).transform(test), 4), 4), "vec_id", "cls")


@query("m5_boosted_trees")
def m5(spark, sf):
    d = folded(spark, sf)
    m = Boosted("train", frozenset([0]), rounds=100, depth=3)
    fit_boosted(d, "y", "cls", "fold", "vec_id", [m], 4)
    return rounded(spread(d.where("fold = 0"), row_map(m.probabilities)("y")), "vec_id", "cls")


@query("m6_random_search")
def m6(spark, sf):
    rng = np.random.default_rng(42)
    trials = [{"components": int(rng.integers(5, 30)), "reg": float(10 ** rng.uniform(-4, 0))} for _ in range(20)]
    results, _ = ml.logistic_search(folded(spark, sf), "y", "cls", "fold", frozenset([2, 3, 4]), frozenset([1]), trials, 4)
    rows = [(i, hp["components"], hp["reg"], f1) for i, (hp, f1) in enumerate(results)]
    return spark.createDataFrame(rows, "trial long, components long, reg double, macro_f1 double").withColumn("macro_f1", F.round("macro_f1", 6))


@query(
    "m7_fold_templates",
    sql(
        "L",
        """SELECT T.fold, a.vec_id, T.cls, round(acos(greatest(-1, least(1, sum(a.y * T.m) / ((sqrt(sum(a.y * a.y)) + 1e-9) * (sqrt(sum(T.m * T.m)) + 1e-9))))), 6) AS angle
        FROM T JOIN L a ON a.pos = T.pos AND a.sample_id % 5 = T.fold GROUP BY T.fold, a.vec_id, T.cls""",
        "T AS (SELECT f.f AS fold, cls, pos, avg(y) AS m FROM L, range(5) f(f) WHERE L.sample_id % 5 <> f.f GROUP BY ALL)",
    ),
)
def m7_templates(spark, sf):
    s = series(spark, sf).withColumn("fold", F.col("sample_id") % 5).select("vec_id", "fold", "cls", "y")
    t = ml.templates_by_fold(s, "y", "cls", "fold")

    def one(f):
        out = ft.angles(s.where(F.col("fold") == f).drop("fold", "cls"), "y", t[f], "a")
        parts = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("cls"), F.col(f"a{k}").alias("v")) for k in t[f]]))
        return out.select("vec_id", parts.alias("e")).select("vec_id", "e.cls", F.round("e.v", 6).alias("angle"))

    return ml.per_fold(sorted(t), one).select(F.col("fold").cast("long").alias("fold"), "vec_id", "cls", "angle")


def fold_series(spark, sf):
    """Series with the fold of their sample, stored: the refit reads it in several passes."""
    return materialise(series(spark, sf).withColumn("fold_id", F.col("sample_id") % 5).select("sample_id", "fold_id", "cls", "subclass", "y"), "folds")


@query("m7_per_fold_refit")
def m7(spark, sf):
    """Components, templates, scatter reference, unmixing, feature choice and three algorithms, all on each fold's training side only."""
    s = fold_series(spark, sf)
    fits = refit.fit_folds(s, "y", AXIS, "fold_id", "cls", "subclass", components=4)
    table, _ = refit.fold_features(s, "y", AXIS, fits, "sample_id", ["fold_id", "cls"], [ft.wavelet_family(len(AXIS), 3), ft.moments_family(AXIS)])
    out = refit.evaluate(table, "sample_id", "fold_id", "cls", 4, seeds=(7, 42), rounds=15)
    return out.select("algorithm", "seed", "fold_id", "sample_id", "y_true", *[F.round(p, 5).alias(p) for p in probs(4)], "pred")


def saved_model(spark, sf) -> str:
    """Fit everything on the samples outside fold 0, save it, and return the folder."""
    from wavetable.plans import scoring

    d = folded_labels(spark, sf).where("sample_id % 5 <> 0")
    model = scoring.train(d, AXIS, AXIS, ["0", "1", "2", "3"], file="sample_id", label="cls", components=4, half_width=HALF, window=HALF, levels=3)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    scoring.save(spark, model, path)
    return path


def folded_labels(spark, sf):
    return series(spark, sf).select("sample_id", "cls", "subclass", "y")


@query("m8_score_files")
def m8(spark, sf):
    from wavetable.plans import scoring

    out = scoring.score(folded_labels(spark, sf), scoring.load(spark, saved_model(spark, sf)), "sample_id", preprocess=False)
    return out.select("sample_id", "pred", F.round("top_p", 5).alias("top_p"), "decision", "n_rows")


# What scoring must keep: one decision per file, from all its rows.
@query("m8_files_and_rows", sql("S", "SELECT sample_id, count(*) AS n_rows, true AS sums_to_one FROM S GROUP BY sample_id"))
def m8_rows(spark, sf):
    from wavetable.plans import scoring

    out = scoring.score(folded_labels(spark, sf), scoring.load(spark, saved_model(spark, sf)), "sample_id", preprocess=False)
    total = sum((F.col(p) for p in probs(4)), F.lit(0.0))
    return out.select("sample_id", "n_rows", (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


NEAREST = "T AS (SELECT cls, pos, avg(y) AS w FROM L GROUP BY ALL)"


@query("m9_contributions", sql("L", "SELECT L.vec_id, T.cls, L.pos, round(L.y * T.w, 6) + 0.0 AS contribution FROM L JOIN T ON T.pos = L.pos", NEAREST))
def m9(spark, sf):
    s = series(spark, sf)
    t = ft.fit_templates(s, "y", "cls")
    out = ml.contributions(s, "y", np.stack(list(t.values())), [int(k) for k in t], "vec_id")
    return out.select("vec_id", F.col("cls").cast("long").alias("cls"), F.col("pos").cast("long").alias("pos"), r("contribution").alias("contribution"))


@query("m9_top_coefficients", sql("L", "SELECT cls, place, CAST(pos AS BIGINT) AS pos, round(w, 6) + 0.0 AS coefficient FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY abs(w) DESC, pos) AS place FROM T) WHERE place <= 11", NEAREST))
def m9_top(spark, sf):
    t = ft.fit_templates(series(spark, sf), "y", "cls")
    return ml.top_coefficients(spark, np.stack(list(t.values())), [int(k) for k in t]).withColumn("coefficient", r("coefficient"))


@query("m10_group_memory_probe")
def m10(spark, sf):
    d = series(spark, sf).withColumn("features", array_to_vector("y")).withColumn("label", F.col("file_id").cast("double"))
    sided = sp.within_group_split(d, "file_id", "vec_id")
    train, test = ml.balanced(sided.where("role = 'train'"), "label"), sided.where("role = 'test'")
    scored = ml.logistic(reg=0.1).fit(train).transform(test)
    return ml.top_n_hits(scored, 25, 5).select("n_test", F.round("top1", 6).alias("top1"), F.round("topn", 6).alias("topn"), "chance")


WIDE_COLS = [f"m{m}_p{k}" for m in range(3) for k in range(4)]


@query("e13_stacking")
def e13(spark, sf):
    wide = cb.wide_over_models(prediction(spark, sf), ["fold_id", "file_id", "subclass", "y_true"], [0, 1, 2], 4)
    return ml.stack_per_fold(wide, WIDE_COLS, 4).select("fold_id", "file_id", "y_true", "pred", *[F.round(p, 5).alias(p) for p in probs(4)])


# At the optimum of each fold's model the weighted mean probability of a class over the other folds is its weighted share there.
@query(
    "e13_stacking_mean_probability",
    sql(
        "P",
        "SELECT fold_id, cls, round(n * (t / (k * n)) / t, 6) AS mean_probability FROM (SELECT *, sum(n) OVER (PARTITION BY fold_id) AS t, count(*) OVER (PARTITION BY fold_id) AS k FROM N)",
        "FI AS (SELECT DISTINCT fold_id, file_id, subclass, y_true FROM P)",
        "N AS (SELECT f.fold_id, o.y_true AS cls, count(*) AS n FROM (SELECT DISTINCT fold_id FROM FI) f JOIN FI o ON o.fold_id <> f.fold_id GROUP BY ALL)",
    ),
)
def e13_mean(spark, sf):
    wide = cb.wide_over_models(prediction(spark, sf), ["fold_id", "file_id", "subclass", "y_true"], [0, 1, 2], 4)
    ready, models = ml.stack_models(wide, WIDE_COLS, 4)
    folds = list(models)
    called = row_map(lambda x: np.concatenate([models[f].probabilities(x) for f in folds], axis=1))("_x")
    held = F.array(*[F.lit(f) for f in folds])
    weights = F.array(*[F.array(*[F.lit(float(w)) for w in models[f].weights]) for f in folds])
    d = ready.select("fold_id", "y_true", F.posexplode(called).alias("i", "p")).withColumn("m", F.floor(F.col("i") / 4).cast("int"))
    d = d.withColumn("fit", held[F.col("m")]).where("fit <> fold_id").withColumn("w", weights[F.col("m")][F.col("y_true").cast("int")])
    g = d.groupBy(F.col("fit").alias("fold_id"), (F.col("i") % 4).cast("long").alias("cls")).agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("mean_probability"))
    return g.select("fold_id", "cls", F.round("mean_probability", 6).alias("mean_probability"))


ALPHAS = [round(0.1 * i, 1) for i in range(11)]


@query(
    "e15_mixture_curve",
    sql(
        "L",
        """SELECT concat(pa, 'x', pb) AS pair, alpha, count(*) AS n_pairs, round(avg(CASE WHEN (alpha * a.m > -(1 - alpha) * b.m) = (alpha > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS majority_accuracy
        FROM (SELECT pa, pb, alpha FROM (VALUES (0, 1), (0, 2), (1, 3)) p(pa, pb), (SELECT unnest(["""
        + ", ".join(f"{a}e0" for a in ALPHAS if a != 0.5)
        + """]) AS alpha)) g JOIN MG a ON a.pa = g.pa AND a.pb = g.pb AND a.cls = g.pa JOIN MG b ON b.pa = g.pa AND b.pb = g.pb AND b.cls = g.pb GROUP BY g.pa, g.pb, alpha""".replace("GROUP BY g.pa, g.pb, alpha", "GROUP BY ALL"),
        "FM AS (SELECT sample_id, cls, pos, avg(y) AS y FROM L GROUP BY ALL)",
        "T AS (SELECT cls, pos, avg(y) AS m FROM FM GROUP BY ALL)",
        """MG AS (SELECT x.pa, x.pb, f.sample_id, f.cls, sum(f.y * (ta.m - tb.m)) - sum(ta.m * ta.m - tb.m * tb.m) / 2 AS m FROM (VALUES (0, 1), (0, 2), (1, 3)) x(pa, pb)
          JOIN FM f ON f.cls IN (x.pa, x.pb) JOIN T ta ON ta.cls = x.pa AND ta.pos = f.pos JOIN T tb ON tb.cls = x.pb AND tb.pos = f.pos GROUP BY x.pa, x.pb, f.sample_id, f.cls)""",
    ).replace("concat(pa, 'x', pb)", "concat(g.pa, 'x', g.pb)"),
)
def e15(spark, sf):
    means = ru.mean_series(series(spark, sf), ["sample_id", "cls"])
    m = ml.mixture_curve(means, "cls", "y", [(0, 1), (0, 2), (1, 3)], ALPHAS)
    return m.withColumn("majority_accuracy", F.round("majority_accuracy", 6))
