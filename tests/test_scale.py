"""Skew-safe building blocks against brute force, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.operators import scale as sc


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(np.round(v, 1)), i) for i, (k, v) in enumerate(zip(np.where(rng.random(30_000) < 0.6, 0, rng.integers(1, 40, 30_000)), rng.normal(size=30_000)))]
    return spark.createDataFrame(rows, "k long, v double, id long").cache()


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_percentiles(skewed, accuracy):
    qs = {"lo": 0.0, "a": 0.1, "m": 0.5, "z": 0.933, "hi": 1.0}
    got = {r.k: r for r in sc.exact_percentiles(skewed, ["k"], "v", qs, accuracy=accuracy).collect()}
    pdf = skewed.toPandas()
    for k, g in pdf.groupby("k"):
        for n, q in qs.items():
            assert got[k][n] == pytest.approx(np.quantile(g.v, q), abs=1e-12)


def test_exact_percentiles_distinct_values(spark):
    df = spark.range(20_001).select((F.col("id") * 7919 % 20_001).cast("double").alias("v"))
    r = sc.exact_percentiles(df, [], "v", {"m": 0.5, "q": 0.333}, accuracy=100).first()
    assert r.m == 10_000 and r.q == pytest.approx(np.quantile(np.arange(20_001), 0.333))


def test_percentile_fixture_and_small_groups(spark):
    df = spark.createDataFrame([(1, float(x)) for x in [1, 2, 4, 9, 20]] + [(2, 5.0), (3, None), (4, float("nan"))], "k long, v double")
    got = {r.k: r.p for r in sc.exact_percentiles(df, ["k"], "v", {"p": 0.1}).collect()}
    assert got == {1: pytest.approx(1.4), 2: 5.0}


def test_percentile_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, v double")
    assert {r.k: r.p for r in sc.exact_percentiles(df, ["k"], "v", {"p": 0.5}).collect()} == {None: 2.0, "a": 2.0}


def test_ranked_equals_row_number(skewed):
    h = skewed.withColumn("h", sc.hash_key("id", seed=1))
    got = sc.ranked(h, ["k"], [F.col("h"), F.col("id")], sc.hash_bucket(F.col("h"))).toPandas()
    want = got.sort_values(["k", "h", "id"]).groupby("k").cumcount() + 1
    assert (got.rn == want.reindex(got.index)).all() and len(got) == 30_000


def test_running_totals(skewed):
    got = sc.running_totals(skewed, ["k"], "v", {"n": F.lit(1)}, buckets=16).toPandas()
    pdf = skewed.toPandas()
    for k in (0, 5):
        v = pdf[pdf.k == k].v.to_numpy()
        for r in got[got.k == k].itertuples():
            assert r.n_before == (v < r.v).sum() and r.n == (v == r.v).sum()


def test_checked_broadcast_gives_up_beyond_the_bound(spark):
    small = sc.checked_broadcast(spark.range(5), 10)._jdf.queryExecution().toString()
    large = sc.checked_broadcast(spark.range(50), 10)._jdf.queryExecution().toString()
    assert "broadcast" in small.lower() and "strategy=broadcast" not in large.lower()
