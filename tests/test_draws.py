"""Pseudo-random draws: spread, moments, independence."""

import numpy as np
from pyspark.sql import functions as F

from wavetable.operators import augment
from wavetable.operators.splits import fingerprint
from wavetable.operators.statistics import bootstrap_means


def test_bootstrap_spread_is_the_standard_error(spark):
    x = np.random.default_rng(0).standard_normal(200)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    means = np.array([r["mean"] for r in bootstrap_means(df, ["k"], "i", "v", 400).collect()])
    assert len(means) == 400 and 0.85 < means.std() / (x.std() / np.sqrt(200)) < 1.15
    assert abs(means.mean() - x.mean()) < 0.3 * x.std() / np.sqrt(200)


def test_noise_is_gaussian_and_salts_are_independent(spark):
    y = [float(v) for v in np.sin(np.arange(200.0))]
    df = spark.range(60).select("id", F.lit(y).alias("y"))
    out = augment.noise(df, "id", "y", p=1.0, lo=0.5, hi=0.5, salt=3).orderBy("id").toPandas()
    z = (np.stack(out.y) - np.array(y)) / (0.5 * np.std(y, ddof=1))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z**3).mean()) < 0.1
    assert abs((z[:, 1:] * z[:, :-1]).mean()) < 0.03 and abs(np.corrcoef(z[:-1].ravel(), z[1:].ravel())[0, 1]) < 0.03
    u = spark.range(4000).select(*[augment.uniform("id", s).alias(f"u{s}") for s in range(2)]).toPandas()
    assert abs(np.corrcoef(u.u0, u.u1)[0, 1]) < 0.05 and abs(u.u0.mean() - 0.5) < 0.02


def test_fingerprint_sees_a_value_that_moves_to_a_null_column(spark):
    a, b = (spark.createDataFrame([r], "k int, a int, b int") for r in ((1, None, 2), (1, 2, None)))
    assert fingerprint(a, "k", ["a", "b"]).first() != fingerprint(b, "k", ["a", "b"]).first()
