import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.operators import features as ft
from wavetable.operators import refit, softmax, unmix, vectorsums
from wavetable.operators.boosting import Boosted, fit_boosted

AXIS = list(np.linspace(700.0, 3100.0, 40))


def corpus(seed=0, files=18, per=8):
    r = np.random.default_rng(seed)
    rows = []
    for f in range(files):
        cls = f % 3
        for _ in range(per):
            y = np.exp(-(((np.arange(40) - 8 - 9 * cls) / 4.0) ** 2)) + 0.3 * r.random(40)
            rows.append((f, f % 3 * 10 + f % 2, cls, int(f * 7 % 4), [float(v) for v in y]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "file long, sub long, cls long, fold long, y array<double>").repartition(5).cache()


def test_vector_sums_with_nulls_and_uneven_lengths(spark, monkeypatch):
    monkeypatch.setattr(vectorsums, "HELD_VALUES", 10)
    rows = [("a", [1.0, None, 3.0]), ("a", [2.0]), ("a", None), ("b", []), (None, [5.0, 7.0]), (None, [6.0, 9.0])] + [("hot", [float(i), -float(i)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, y array<double>").repartition(7)
    got = {(r["k"], r["pos"]): (r["n"], round(r["s"], 9), round(r["m2"], 6)) for r in vectorsums.position_sums(df, ["k"]).collect()}
    x = np.arange(200.0)
    hot = round(float(((x - x.mean()) ** 2).sum()), 6)
    assert got == {("a", 0): (2, 3.0, 0.5), ("a", 2): (1, 3.0, 0.0), (None, 0): (2, 11.0, 0.5), (None, 1): (2, 16.0, 2.0), ("hot", 0): (200, 19900.0, hot), ("hot", 1): (200, -19900.0, hot)}
    whole = vectorsums.vector_sums(df, []).first()
    assert whole["n"][0] == 204 and vectorsums.vector_sums(df.limit(0), ["k"]).collect() == []


def test_fold_fits_equal_fits_on_the_training_side(spark):
    df = frame(spark, corpus())
    fits = refit.fit_folds(df, "y", AXIS, "fold", "cls", "sub", components=3, iterations=5)
    for f in (0, 2):
        train = df.where(F.col("fold") != f)
        for a, b in zip(fits[f].components, ft.fit_region_components(train, "y", AXIS), strict=True):
            assert (a.axes is None) == (b.axes is None)
            assert a.axes is None or np.allclose(a.axes, b.axes, atol=1e-6)
        want = ft.fit_templates(train, "y", "cls")
        assert list(fits[f].templates["class"]) == list(want) and all(np.allclose(fits[f].templates["class"][k], want[k]) for k in want)
        alone = unmix.fit(unmix.shift_non_negative(train, "y"), "y", 3, max_iter=5)
        assert fits[f].variables == alone.variables and np.allclose(fits[f].spectra, alone.spectra, atol=1e-6)


def test_held_out_labels_and_values_reach_no_fit(spark):
    rows = corpus(1)
    other = [(f, s + 100 if fold == 2 else s, (c + 1) % 3 if fold == 2 else c, fold, [v * 3 + 1 for v in y] if fold == 2 else y) for f, s, c, fold, y in rows]
    fits = [refit.fit_folds(frame(spark, x), "y", AXIS, "fold", "cls", "sub", components=3, iterations=4)[2] for x in (rows, other)]
    a, b = fits
    assert np.allclose(a.spectra, b.spectra, atol=1e-9) and np.allclose(a.mean, b.mean, atol=1e-9) and abs(a.low - b.low) < 1e-12
    assert list(a.templates["sub"]) == list(b.templates["sub"]) and all(np.allclose(a.templates["class"][k], b.templates["class"][k], atol=1e-9) for k in a.templates["class"])
    relabelled = [(f, s, (c + 1) % 3 if fold == 2 else c, fold, y) for f, s, c, fold, y in rows]
    preds = []
    for x in (rows, relabelled):
        df = frame(spark, x)
        fold_fits = refit.fit_folds(df, "y", AXIS, "fold", "cls", "sub", components=3, iterations=4)
        table, names = refit.fold_features(df, "y", AXIS, fold_fits, "file", ["fold", "cls"], [ft.wavelet_family(40, 2)])
        assert all(len(names[r["fit"]]) == len(r["x"]) for r in table.collect())
        out = refit.evaluate(table, "file", "fold", "cls", 3, seeds=(1,), rounds=4, depth=2).where("fold = 2")
        preds.append({(r["algorithm"], r["file"]): [round(r[f"p{i}"], 6) for i in range(3)] for r in out.collect()})
    assert preds[0] == preds[1] and len(preds[0]) == 3 * len({r[0] for r in rows if r[3] == 2})


def test_evaluation_learns_the_classes(spark):
    df = frame(spark, corpus(2, files=24))
    fits = refit.fit_folds(df, "y", AXIS, "fold", "cls", "sub", components=3, iterations=4)
    table, _ = refit.fold_features(df, "y", AXIS, fits, "file", ["fold", "cls"])
    out = refit.evaluate(table, "file", "fold", "cls", 3, seeds=(1, 2), rounds=5, depth=2).collect()
    assert len(out) == 3 * 2 * 24
    for a in refit.ALGORITHMS:
        assert np.mean([r["pred"] == r["y_true"] for r in out if r["algorithm"] == a]) > 0.9


def test_softmax_models_are_at_their_optimum(spark):
    r = np.random.default_rng(3)
    x, fold = r.standard_normal((300, 4)), np.arange(300) % 3
    y = (x[:, 0] + 0.8 * r.standard_normal(300) > 0).astype(int) + (x[:, 1] > 0.7)
    df = spark.createDataFrame([([float(v) for v in x[i]], int(y[i]), int(fold[i])) for i in range(300)], "x array<double>, y int, fold int").repartition(4)
    models = [softmax.Softmax((f, reg), frozenset([f]), reg=reg) for f in range(3) for reg in (0.01, 1.0)]
    softmax.fit_many(df, "x", "y", "fold", models, 3)
    for m in models:
        on = fold != m.name[0]
        w = (on.sum() / (3 * np.bincount(y[on])))[y[on]]
        miss = m.probabilities(x[on]) - np.eye(3)[y[on]]
        g = (miss * w[:, None]).T @ m.prepared(x[on]) / w.sum() + m.theta * np.append(np.full(4, m.name[1]), 0.0)
        assert np.abs(g).max() < 1e-8


@pytest.mark.parametrize("share", [1.0, 0.7])
def test_boosted_trees_do_not_depend_on_partitions(spark, share):
    r = np.random.default_rng(4)
    x = r.standard_normal((240, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 0.5)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), i % 3) for i in range(240)], "k long, x array<double>, y int, fold int")
    make = lambda: Boosted("m", frozenset([0]), rounds=12, depth=3, rate=0.3, rows=share, features=share, seed=5)
    a, b = (fit_boosted(df.repartition(n), "x", "y", "fold", "k", [make()], 3)[0] for n in (1, 6))
    assert all(np.array_equal(u, v) for s, t in zip(a.trees, b.trees, strict=True) for u, v in zip(s, t, strict=True))
    seen = np.arange(240) % 3 != 0
    losses = []
    for n in (0, 3, 12):
        z = a.margins(a.binned(x[seen]), upto=n)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(seen.sum()), y[seen]]).mean())
    assert losses[0] > losses[1] > losses[2] and (a.probabilities(x[~seen]).argmax(1) == y[~seen]).mean() > 0.6


def test_calibrated_margins_are_optimal_and_monotone(spark):
    from wavetable.operators import margins

    r = np.random.default_rng(6)
    x, fold = r.standard_normal((240, 3)), np.arange(240) % 3
    y = ((x[:, 0] + 0.7 * r.standard_normal(240)) > 0).astype(int)
    df = spark.createDataFrame([([float(v) for v in np.round(x[i], 1)], int(y[i]), int(fold[i])) for i in range(240)], "x array<double>, y int, f int").repartition(5).cache()
    x = np.round(x, 1)
    models = [margins.Margins(softmax.Softmax(f, frozenset([f])), 0.5) for f in range(3)]
    margins.fit_margins(df, "x", "y", "f", models, 2, width=3)
    margins.calibrate(df, "x", "y", "f", models, 2)
    for m in models:
        on = fold != m.side.name
        w = (on.sum() / (2 * np.bincount(y[on])))[y[on]]
        z = m.side.prepared(x[on])
        for k in range(2):
            sign = np.where(y[on] == k, 1.0, -1.0)
            gap = np.maximum(0, 1 - sign * (z @ m.theta[k]))
            assert np.abs(m.theta[k] - 2 * 0.5 * z.T @ (w * sign * gap)).max() < 1e-4
            s, hit = m.scores(x[~on])[:, k], (y[~on] == k).astype(float)
            values = np.unique(s)
            blocks = [[hit[s == v].sum(), (s == v).sum(), v, v] for v in values]
            i = 0
            while i < len(blocks) - 1:  # the plain pooling of all points
                if blocks[i][0] * blocks[i + 1][1] >= blocks[i + 1][0] * blocks[i][1]:
                    a, b = blocks[i], blocks.pop(i + 1)
                    blocks[i] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
                    i = max(i - 1, 0)
                else:
                    i += 1
            want = ([v for b in blocks for v in b[2:]], [b[0] / b[1] for b in blocks for _ in (0, 1)])
            assert np.allclose(m.curves[k][0], want[0]) and np.allclose(m.curves[k][1], want[1])
    p = df.select(margins.probabilities(models)("x").alias("p"), "y").collect()
    assert np.mean([int(np.argmax(q["p"])) == q["y"] for q in p]) > 0.7 and all(abs(sum(q["p"]) - 1) < 1e-9 for q in p)
