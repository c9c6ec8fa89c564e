"""Unmixing, partial least squares, combination and split invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.operators import combine as cb
from wavetable.operators import models as ml
from wavetable.operators import ranking as rk
from wavetable.operators import splits as sp
from wavetable.operators import unmix


def frame(spark, x, **cols):
    rows = [(i, [float(v) for v in line]) for i, line in enumerate(x)]
    return spark.createDataFrame(rows, "id long, y array<double>")


def test_unmixing_recovers_two_components(spark):
    rng = np.random.default_rng(0)
    wn = np.linspace(400, 1800, 120)
    g = lambda c, s: np.exp(-0.5 * ((wn - c) / s) ** 2)
    true = np.vstack([g(800, 30) + 0.6 * g(1450, 25), g(1200, 30) + 0.4 * g(1650, 20)])
    true = true / np.linalg.norm(true, axis=1, keepdims=True)
    d = np.maximum(rng.uniform(0.1, 1.5, size=(100, 2)) @ true + 0.005 * rng.standard_normal((100, 120)), 0)
    fit = unmix.fit(frame(spark, d), "y", 2, max_iter=30, offset_pct=2.0)
    cos = (fit.spectra / np.linalg.norm(fit.spectra, axis=1, keepdims=True)) @ true.T
    assert max(min(cos[0, 0], cos[1, 1]), min(cos[0, 1], cos[1, 0])) >= 0.95
    assert (fit.spectra >= 0).all() and all(b <= a * (1 + 1e-9) for a, b in zip(fit.errors, fit.errors[1:]))


def test_non_negative_solver_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    s, d = np.abs(rng.normal(size=(4, 30))), rng.normal(size=(50, 30))
    c = unmix.solve_non_negative(d, s)
    grad = (c @ s - d) @ s.T
    assert (c >= 0).all() and grad.min() > -1e-6 and np.abs(c * grad).max() < 1e-6


def test_purest_variables_match_the_direct_definition(spark):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(60, 8)) * np.arange(1, 9))
    _, picked = unmix.purest_variables(frame(spark, x), "y", 3)
    mu, sd = x.mean(0), x.std(0)
    a = 0.05 * mu.max()
    base, purity = x / np.sqrt(mu**2 + sd**2 + a**2), sd / (mu + a)
    want = [int(np.argmax(purity))]
    while len(want) < 3:
        q, _ = np.linalg.qr(base[:, want])
        left = ((base - q @ (q.T @ base)) ** 2).sum(0) * purity
        left[want] = -1
        want.append(int(np.argmax(left)))
    assert picked == want


def test_latent_model_with_all_components_is_least_squares(spark):
    rng = np.random.default_rng(4)
    x, lab = rng.normal(size=(80, 5)), rng.integers(0, 3, 80)
    df = spark.createDataFrame([(int(k), [float(v) for v in line]) for k, line in zip(lab, x)], "cls long, y array<double>")
    m = ml.fit_latent(df, "y", "cls", 5)
    onehot = np.eye(3)[lab]
    beta, *_ = np.linalg.lstsq(x - x.mean(0), onehot - onehot.mean(0), rcond=None)
    assert m.rotation @ m.loadings.T == pytest.approx(beta, abs=1e-8)
    t = (x - m.mean) @ m.rotation
    assert t.T @ t == pytest.approx(np.eye(5), abs=1e-8)


def test_folds_do_not_leak_and_cover_every_file(spark):
    files = spark.createDataFrame([(i, "w" if i < 8 else f"c{i % 3}", None if i < 8 else f"s{i % 9}") for i in range(87)], "file_id long, cls string, sub string")
    a = sp.stratified_folds(files, "file_id", "cls", 5)
    roles = sp.kfold_roles(a, "file_id", 5).toPandas()
    tested = roles[roles.role == "test"].groupby("file_id").size()
    assert len(tested) == 87 and (tested == 1).all()
    sizes = a.groupBy("test_fold").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1
    per = a.groupBy("cls", "test_fold").count().toPandas().groupby("cls")["count"]
    assert (per.max() - per.min() <= 1).all()
    loso = sp.leave_one_subclass_out(files, "file_id", "cls", "sub", always_train=["w"]).toPandas()
    assert loso.fold.nunique() == 9 and (loso[loso.file_id < 8].role == "train").all()


def test_leakage_is_found(spark):
    rows = spark.createDataFrame([(1, "f1", True), (2, "f1", False), (3, "f2", True)], "id long, f string, keep boolean")
    bad = spark.createDataFrame([("a", 1, "f1", "train"), ("a", 1, "f1", "test"), ("a", 2, "f1", "train"), ("a", 9, "f3", "test")], "fold string, id long, f string, role string")
    r = sp.leakage(bad, rows, "id", "f").first()
    assert (r.shared_rows, r.shared_files, r.unknown_rows, r.rejected_rows) == (1, 1, 1, 1)


def test_fold_seed(spark):
    assert spark.range(1).select(sp.fold_seed(F.lit(3))).first()[0] == (42 * 31337 + 3) % 2**31


def test_fingerprint_sees_one_changed_row_and_ignores_order(spark):
    a = spark.range(1000).withColumn("v", F.col("id") % 7)
    h = lambda d: sp.fingerprint(d, "id", ["v"]).first().fingerprint
    assert h(a) == h(a.repartition(13)) and h(a) != h(a.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v"))))


def test_incomplete_predictions_fail(spark):
    df = spark.createDataFrame([(0, 1, 1, 1, 0, 0, 1.0, 0.0), (1, 1, 1, 1, 0, 0, 0.5, 0.5), (0, 1, 1, 2, 0, 0, 1.0, 0.0)], "model long, fold_id long, file_id long, spectrum_id long, subclass long, y_true long, p0 double, p1 double")
    with pytest.raises(Exception, match="incomplete predictions"):
        cb.weighted_vote(df, F.lit(0.5), 2, 2).collect()


def test_missing_scores_rank_last(spark):
    s = spark.createDataFrame([(1, 0, float("nan")), (1, 1, 0.2), (2, 0, None), (2, 1, None)], "fold_id long, model long, score double")
    assert {r.fold_id: r.model for r in cb.hard_select(s).collect()} == {1: 1, 2: 0}
    w = {(r.fold_id, r.model): r.weight for r in cb.soft_weights(s).collect()}
    assert w[(1, 0)] == pytest.approx(0.5) and w[(2, 1)] == pytest.approx(0.5)


def test_peak_distance_keeps_the_higher_peak(spark):
    y = [0, 1, 0, 2, 0, 0, 0, 0, 3, 0]
    df = spark.createDataFrame([("a", i, float(i), float(v)) for i, v in enumerate(y)], "k string, pos int, wn double, y double")
    got = [(r.pos, r.prominence) for r in rk.local_peaks(df, ["k"], min_prominence=0.5, min_distance=3, n=5).orderBy("place").collect()]
    assert got == [(8, 3.0), (3, 2.0)]


def test_permuted_labels_keep_the_label_counts(spark):
    d = spark.range(200).withColumn("l", F.col("id") % 3)
    p = ml.permute_labels(d, "id", "l", 5)
    assert sorted(r.l for r in p.collect()) == sorted(r.l for r in d.collect())
    assert p.join(d.withColumnRenamed("l", "was"), "id").where("l <> was").count() > 50
