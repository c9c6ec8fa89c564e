"""Literal fixtures and invariants for series functions and features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.functions import linear as ln
from wavetable.functions import series as fs
from wavetable.operators import augment, clean
from wavetable.operators import features as ft


def one(spark, values, expr, **cols):
    df = spark.createDataFrame([(1, [float(v) for v in values])], "id long, y array<double>")
    return df.select(expr.alias("r")).first()["r"]


def test_snv(spark):
    assert one(spark, [1, 2, 3, 6], fs.snv("y")) == pytest.approx([-1.069045, -0.534522, 0, 1.603567], abs=1e-6)


def test_snv_or_zero_and_min_max_on_constant(spark):
    assert one(spark, [3, 3, 3], fs.snv_or_zero("y")) == [0, 0, 0]
    assert one(spark, [3, 3, 3], fs.min_max("y")) == [0, 0, 0]


def test_ragged_and_null_series(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "id long, y array<double>").coalesce(1)
    got = {r.id: r.m for r in df.select("id", fs.mean_centre("y").alias("m")).collect()}
    assert got == {1: [-0.5, 0.5], 2: [-1.0, 0.0, 1.0], 3: None}


def test_despike_removes_one_bin_spike_only(spark):
    y = [10 + 0.1 * (i % 3) for i in range(40)]
    y[20] = 50.0
    out = one(spark, y, fs.despike("y"))
    assert out[20] < 11 and out[10] == y[10]


def test_despike_leaves_flat_series(spark):
    assert one(spark, [5.0] * 20, fs.despike("y")) == [5.0] * 20


def test_savgol_keeps_a_cubic_exactly(spark):
    t = np.arange(30.0)
    y = 0.01 * t**3 - t**2 + 3
    assert one(spark, y, ln.savgol("y", window=9, polyorder=3)) == pytest.approx(list(y), abs=1e-8)
    d2 = one(spark, y, ln.savgol("y", window=9, polyorder=3, deriv=2))
    assert d2 == pytest.approx(list(0.06 * t - 2), abs=1e-8)


def test_savgol_column_equals_its_matrix(spark):
    y = np.random.default_rng(0).normal(size=25)
    assert one(spark, y, ln.savgol("y", window=7, polyorder=2)) == pytest.approx(list(y @ ln.savgol_matrix(25, 7, 2)), abs=1e-10)


def test_wavelet_bank_is_energy_preserving_inside():
    n = 512
    y = np.zeros(n)
    y[200:312] = np.hanning(112)
    lo, hi = np.array(ln.DB4_DEC_LO), None
    bank = ln.wavelet_bank(n, 1)
    detail = y @ bank[0]
    approx = y @ ln._dwt_step(n, lo)
    assert (detail**2).sum() + (approx**2).sum() == pytest.approx((y**2).sum(), rel=1e-9)
    assert np.abs(np.ones(n) @ bank[0]).max() < 1e-12


def test_trapezoid(spark):
    w = ln.trapezoid_weights([10.0, 11.0, 13.0], 10, 13)
    assert one(spark, [1, 2, 4], ln.dot("y", w)) == pytest.approx(7.5)
    assert ln.trapezoid_weights([10.0, 11.0, 13.0], 12, 13) is None


def test_flat_signal_gives_band_width(spark):
    axis = [1000.0 + i for i in range(21)]
    df = spark.createDataFrame([(1, [1.0] * 21)], "id long, y array<double>")
    out = ft.band_auc(df, "y", axis, {"a": 1010.0}, half_width=5.0).first()
    assert out.auc_a == pytest.approx(10.0)


def test_self_ratio_is_one(spark):
    df = spark.createDataFrame([(1, 3.5)], "id long, auc_a double")
    assert ft.named_ratios(df, {"s": ("band:a", "band:a")}).first().ratio_s == 1.0


def test_signed_ratio_of_tiny_negative_denominator_is_infinite(spark):
    from wavetable.functions.stats import signed_ratio

    df = spark.createDataFrame([(1.0, -1e-12), (1.0, 1e-12), (0.0, -1e-12)], "n double, d double")
    a, b, c = [r[0] for r in df.select(signed_ratio(F.col("n"), F.col("d"))).collect()]
    assert a == float("inf") and b == pytest.approx(5e8) and c != c


def test_roi_moments_corrected(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0, 9.0, 20.0])], "id long, y array<double>")
    r = ft.roi_moments(df, "y", [1.0, 2, 3, 4, 5], {"a": (0.0, 9.0)}).first()
    assert r.roi_a_skew == pytest.approx(1.490120, abs=1e-6) and r.roi_a_kurt == pytest.approx(1.895432, abs=1e-6)


def test_roi_moments_flat_and_short_regions(spark):
    df = spark.createDataFrame([(1, [2.0] * 5)], "id long, y array<double>")
    r = ft.roi_moments(df, "y", [1.0, 2, 3, 4, 5], {"a": (0.0, 9.0), "b": (1.0, 2.0)}).first()
    assert r.roi_a_skew is None and r.roi_a_std == 0.0 and r.roi_b_mean is None


def test_column_counts_of_the_reference_frames(spark):
    axis = catalog.crop_axis(catalog.reference_axis())
    assert len(axis) == 987
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, f"c{i % 4}", f"s{i % 10}", [float(v) for v in rng.normal(size=987)]) for i in range(20)], "id long, cls string, sub string, y array<double>")
    bands = ft.band_frame(df, "y", axis)
    assert len(bands.columns) - len(df.columns) == 166
    spectral = ft.spectral_frame(df, "y", axis, label="cls", sublabel="sub")
    assert len(spectral.columns) - len(df.columns) == 51
    assert bands.count() == 20 and spectral.select("dwt_energy_L6").first()[0] > 0


def test_clean_chain_switches(spark):
    axis = catalog.reference_axis()
    y = [float(np.sin(i / 40) + 2) for i in range(2048)]
    df = spark.createDataFrame([(1, y)], "id long, y array<double>")
    out, kept = clean.clean(df, axis)
    v = np.array(out.first().y)
    assert len(v) == len(kept) == 987 and abs(v.mean()) < 1e-9 and abs(v.std() - 1) < 1e-6
    same, axis_same = clean.clean(df, axis, steps=())
    assert same.first().y == y and len(axis_same) == 2048


def test_augmentations_off_change_nothing(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.0])], "k long, y array<double>")
    out = augment.noise(df, "k", "y", p=0.0, lo=0.1, hi=0.2, salt=1)
    out = augment.scale(out, "k", "y", p=0.0, lo=0.5, hi=2.0, salt=2)
    out = augment.shift(out, "k", "y", p=0.0, max_bins=2, salt=3)
    out = augment.drift(out, "k", "y", p=0.0, amp_max=1.0, period=(10.0, 20.0), salt=4)
    assert out.first().y == [1.0, 2.0, 3.0, 4.0]


def test_roll(spark):
    assert one(spark, [1, 2, 3, 4], fs.roll("y", F.lit(1))) == [4, 1, 2, 3]
    assert one(spark, [1, 2, 3, 4], fs.roll("y", F.lit(-1))) == [2, 3, 4, 1]


def test_penalised_baseline_equals_a_dense_solve(spark):
    from wavetable.functions.series import penalised_baselines, penalised_fit

    r = np.random.default_rng(0)
    b, lam = 40, 50.0
    x = np.sin(np.arange(b) / 15.0)[None] * 3 + r.standard_normal((6, b)) * 0.05
    x[:, 18:22] += 5
    d = np.diff(np.eye(b), n=2, axis=0)
    w = r.random((6, b))
    dense = np.stack([np.linalg.solve(np.diag(w[i]) + lam * d.T @ d, w[i] * x[i]) for i in range(6)])
    assert np.allclose(penalised_fit(x, w, lam), dense, atol=1e-8)

    def one(y):
        w = np.ones(b)
        for _ in range(50):
            z = np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)
            gap = y - z
            low = gap[gap < 0]
            m, s = low.mean(), low.std(ddof=1)
            new = 1 / (1 + np.exp(2 * (gap - (2 * s - m)) / s))
            if np.linalg.norm(new - w) / np.linalg.norm(w) < 1e-3:
                break
            w = new
        return z

    got = penalised_baselines(x, lam, 50, 1e-3)
    assert np.allclose(got, np.stack([one(y) for y in x]), atol=1e-8)
    assert np.abs(x - got)[:, [0, 5, 30]].max() < 0.5 and (x - got)[:, 20].min() > 3
    assert np.array_equal(penalised_baselines(x[:, :2], lam, 5, 1e-3), x[:, :2])


def test_line_shapes_find_planted_peaks():
    from wavetable.functions import lineshapes as ls

    axis = np.arange(970.0, 1040.0)
    r = np.random.default_rng(1)
    n = 40
    t = np.stack([r.uniform(1, 4, n) * r.choice([-1, 1], n), r.uniform(995, 1012, n), r.uniform(3, 12, n), r.uniform(-1, 1, n)], axis=1)
    y = ls.lorentz(t, axis)[0]
    got = ls.fit_windows(y, axis, 1004.0, 30.0, 12.0, "lorentz")
    assert (got[:, -1] == 1).all() and np.allclose(got[:, :3], np.stack([t[:, 1], t[:, 0], 2 * t[:, 2]], axis=1), atol=1e-4) and got[:, 5].max() < 1e-6
    v = np.stack([r.uniform(2, 4, n), r.uniform(-5, 5, n), r.uniform(3, 8, n), r.uniform(3, 8, n), r.uniform(0.2, 0.8, n), r.uniform(-0.01, 0.01, n), r.uniform(-1, 1, n)], axis=1)
    z = ls.voigt_like(v, axis - 1004.0)[0] + 0.001 * r.standard_normal((n, len(axis)))
    fit = ls.fit_windows(z, axis, 1004.0, 30.0, 12.0, "voigt")
    assert (fit[:, -1] == 1).mean() > 0.9 and np.nanmax(np.abs(fit[:, 0] - 1004 - v[:, 1])) < 0.1 and np.nanmedian(fit[:, 9]) < 0.0012 and np.nanmax(fit[:, 9]) < 0.05
    z[0, 30] = np.nan
    assert ls.fit_windows(z[:1], axis, 1004.0, 30.0, 12.0, "voigt")[0, -1] == 0 and ls.fit_windows(z, axis, 1004.0, 2.0, 12.0, "lorentz")[:, -1].max() == 1
    assert (ls.fit_windows(z, axis, 2000.0, 30.0, 12.0, "lorentz")[:, -1] == 0).all()
    eps = 1e-6
    for shape, p in ((ls.lorentz, t), (ls.voigt_like, v)):
        x = axis if shape is ls.lorentz else axis - 1004.0
        for i in range(p.shape[1]):
            q = p.copy()
            q[:, i] += eps
            assert np.allclose((shape(q, x)[0] - shape(p, x)[0]) / eps, shape(p, x)[1][:, :, i], atol=1e-3)
