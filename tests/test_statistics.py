"""Published and hand-worked numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.functions.stats import binomial_two_sided, binomial_two_sided_value
from wavetable.operators import evaluate as ev
from wavetable.operators import statistics as st


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([(1, float(v)) for v in [1, 2, 3, 4]] + [(0, float(v)) for v in [2, 4, 6, 8, 10]], "side int, value double").withColumn("f", F.lit("x"))


def test_effect_sizes(spark, groups):
    e = st.effect_sizes(groups.withColumn("cls", F.col("side")), ["value"], "cls", {"c": ([1], [0])}).first()
    assert e.d == pytest.approx(-1.380419, abs=1e-6) and e.d_unweighted == pytest.approx(-1.449138, abs=1e-6)


def test_auroc(groups):
    r = st.rank_sums(groups, ["f"]).first()
    assert r.auroc == pytest.approx(0.15) and r.auroc_sym == pytest.approx(0.85)


def test_welch(groups):
    assert st.welch(groups, ["f"]).first().t == pytest.approx(-2.251436, abs=1e-6)


def test_anova(spark):
    rows = [("f", k, float(v)) for k, vs in enumerate([[1, 2, 3], [2, 3, 4, 5], [6, 7]]) for v in vs]
    assert st.anova(spark.createDataFrame(rows, "name string, k int, value double"), ["name"], "k").first().f == pytest.approx(9.8)


@pytest.mark.parametrize("a,b,p", [(10, 0, 0.001953125), (24, 7, 0.003326893), (17, 10, 0.247788563)])
def test_exact_binomial(spark, a, b, p):
    df = spark.createDataFrame([(min(a, b), a + b)], "k long, n long")
    got = df.select(binomial_two_sided(F.col("k"), F.col("n"))).first()[0]
    assert got == pytest.approx(p, abs=1e-9) and binomial_two_sided_value(min(a, b), a + b) == pytest.approx(p, abs=1e-9)


def test_exact_binomial_large_and_empty(spark):
    df = spark.createDataFrame([(0, 0), (480, 1000), (0, 3000)], "k long, n long")
    a, b, c = [r[0] for r in df.select(binomial_two_sided(F.col("k"), F.col("n"))).collect()]
    assert a == 1.0 and b == pytest.approx(binomial_two_sided_value(480, 1000), rel=1e-9) and c == pytest.approx(0.0, abs=1e-300)


def test_confusion_metrics(spark):
    counts = [[18, 5, 4, 0], [4, 10, 11, 0], [7, 9, 11, 0], [8, 0, 0, 0]]
    rows = [(t, p) for t, line in enumerate(counts) for p, n in enumerate(line) for _ in range(n)]
    df = spark.createDataFrame(rows, "y_true long, pred long")
    m = {r.cls: r for r in ev.class_metrics(ev.confusion(df, "y_true", [0, 1, 2, 3], 4)).collect()}
    assert [m[k].recall for k in range(4)] == pytest.approx([18 / 27, 0.4, 11 / 27, 0.0])
    assert [m[k].precision for k in range(4)] == pytest.approx([0.486486, 0.416667, 0.423077, 0.0], abs=1e-6)


def test_brier(spark):
    df = spark.createDataFrame([(0, 0.7, 0.2, 0.1), (2, 0.2, 0.5, 0.3), (2, 0.1, 0.3, 0.6)], "y_true long, p0 double, p1 double, p2 double")
    assert ev.brier(df, 3).first().brier == pytest.approx(0.393333, abs=1e-6)


def test_pairless_similarity_equals_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 5)) + 1
    lab = [i % 3 for i in range(12)]
    df = spark.createDataFrame([(lab[i], [float(v) for v in x[i]]) for i in range(12)], "k long, y array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in st.class_cosine(df, "k").collect():
        want = [u[i] @ u[j] for i in range(12) for j in range(i + 1, 12) if {lab[i], lab[j]} == {r.a, r.b}]
        assert r.n_pairs == len(want) and r.mean_cosine == pytest.approx(np.mean(want))
    b = st.batch_effect(df, "k").first()
    d = {True: [], False: []}
    for i in range(12):
        for j in range(i + 1, 12):
            d[lab[i] == lab[j]].append(((x[i] - x[j]) ** 2).sum())
    assert b.same_batch_squared == pytest.approx(np.mean(d[True])) and b.other_batch_squared == pytest.approx(np.mean(d[False]))


def test_verdict(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", False), ("c", False)], "c string, ok boolean")
    assert {r.c: r.branch for r in st.verdict(df, F.col("ok"), ["c"], 2).collect()} == {"a": "A", "b": "B", "c": "C"}


def test_nearest_information_equals_brute_force(spark, monkeypatch):
    from wavetable.operators import statistics

    monkeypatch.setattr(statistics, "NEIGHBOUR_BLOCK", 7)
    r = np.random.default_rng(0)
    rows = [("a", int(i % 3), float(r.standard_normal() + (i % 3))) for i in range(150)] + [("b", int(i % 2), float(np.round(r.standard_normal() * 8) / 8)) for i in range(90)]  # ties, exact in binary
    rows += [("a", 9, 5.0), ("a", 8, 1.5), ("a", 8, 1.7), ("a", 0, None), ("b", 1, float("nan"))]
    df = spark.createDataFrame(rows, "feature string, cls int, value double").repartition(4)
    got = {x["feature"]: x["mi"] for x in statistics.nearest_information(df, ["feature"], "cls").collect()}
    psi = lambda n: sum(1.0 / i for i in range(1, int(n))) - statistics.EULER
    for f in ("a", "b"):
        pts = [(k, v) for g, k, v in rows if g == f and v is not None and v == v]
        pts = [(k, v) for k, v in pts if sum(q == k for q, _ in pts) > 1]
        ks, ns, ms = [], [], []
        for i, (k, v) in enumerate(pts):
            d = sorted(abs(v - u) for j, (q, u) in enumerate(pts) if q == k and j != i)
            kk = min(3, len(d))
            radius = d[kk - 1]
            ks.append(psi(kk)), ns.append(psi(len(d) + 1))
            ms.append(psi(sum(abs(v - u) <= 0 if radius == 0 else abs(v - u) < radius for _, u in pts)))
        assert got[f] == pytest.approx(max(0.0, psi(len(pts)) + np.mean(ks) - np.mean(ns) - np.mean(ms)), abs=1e-6)
