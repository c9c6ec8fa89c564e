"""Statistics (S1-S18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.operators import ranking as rk
from wavetable.operators import rollup as ru
from wavetable.operators import statistics as st
from wavetable.plans.join_queries import CORRECT
from wavetable.plans.registry import query
from wavetable.plans.rollup_queries import COLS, REG, WIDE, areas
from wavetable.plans.tables import long, prediction, r, series, sql, table

CONTRASTS = {"0_vs_1": ([0], [1]), "01_vs_2": ([0, 1], [2]), "3_vs_rest": ([3], [0, 1, 2])}
CONTRAST_SQL = "CT(contrast, cls, side) AS (VALUES " + ", ".join(f"('{n}', {k}, {s})" for n, (a, b) in CONTRASTS.items() for s, g in ((1, a), (0, b)) for k in g) + ")"
FILES = "FM AS (SELECT sample_id, cls, feature, avg(value) AS value FROM LW GROUP BY ALL)"
SIDED = "SD AS (SELECT feature, contrast, side, value FROM FM JOIN CT USING (cls))"
MOM = """MO AS (SELECT feature, contrast, avg(value) FILTER (side = 1) AS ma, var_samp(value) FILTER (side = 1) AS va, count(*) FILTER (side = 1) AS na,
  avg(value) FILTER (side = 0) AS mb, var_samp(value) FILTER (side = 0) AS vb, count(*) FILTER (side = 0) AS nb FROM SD GROUP BY ALL)"""
BASE = (*WIDE, FILES, CONTRAST_SQL, SIDED)


def sample_features(spark, sf):
    return ru.mean_pool(areas(spark, sf), ["sample_id", "cls"], COLS)


def sided(spark, sf):
    u = ru.unpivot(sample_features(spark, sf), ["cls"], COLS)
    return st.sides(u, "cls", CONTRASTS)


D = "round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) + 0.0"


@query("s1_cohens_d", sql("L", f"SELECT feature, {D} AS d, round((ma - mb) / sqrt((va + vb) / 2), 6) + 0.0 AS d_unweighted FROM MO WHERE contrast = '0_vs_1'", *BASE, MOM))
def s1(spark, sf):
    e = st.effect_sizes(sample_features(spark, sf), COLS, "cls", {"0_vs_1": CONTRASTS["0_vs_1"]})
    return e.select("feature", r("d").alias("d"), r("d_unweighted").alias("d_unweighted"))


@query("s2_effect_table", sql("L", f"SELECT feature, contrast, {D} AS d, na, nb FROM MO", *BASE, MOM))
def s2(spark, sf):
    return st.effect_sizes(sample_features(spark, sf), COLS, "cls", CONTRASTS).select("feature", "contrast", r("d").alias("d"), "na", "nb")


RANK = """RK AS (SELECT feature, contrast, side, rank() OVER w + (count(*) OVER (PARTITION BY feature, contrast, value) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY feature, contrast, value) AS t FROM SDR WINDOW w AS (PARTITION BY feature, contrast ORDER BY value))"""
# ties are made by rounding the areas
SDR = "SDR AS (SELECT feature, contrast, side, round(value, 0) + 0.0 AS value FROM SD)"
UU = """UU AS (SELECT feature, contrast, sum(rk) FILTER (side = 1) - count(*) FILTER (side = 1) * (count(*) FILTER (side = 1) + 1) / 2.0 AS u, count(*) FILTER (side = 1) AS na, count(*) FILTER (side = 0) AS nb,
  sum(t * t - 1.0) AS ties FROM RK GROUP BY feature, contrast)"""


@query(
    "s3_auroc",
    sql("L", "SELECT feature, contrast, round(u / (na * nb), 6) AS auroc, round(greatest(u / (na * nb), 1 - u / (na * nb)), 6) AS auroc_sym FROM UU", *BASE, SDR, RANK, UU),
)
def s3(spark, sf):
    u = st.rank_sums(sided(spark, sf).withColumn("value", r("value", 0)), ["feature", "contrast"])
    return u.select("feature", "contrast", F.round("auroc", 6).alias("auroc"), F.round("auroc_sym", 6).alias("auroc_sym"))


@query(
    "s4_anova_f",
    sql("L", """SELECT pos, round((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 5) AS f, CAST(sum(n) AS BIGINT) AS n
       FROM (SELECT pos, cls, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM L GROUP BY ALL) GROUP BY pos"""),
)
def s4(spark, sf):
    a = st.anova(long(series(spark, sf).select("cls", "y")).withColumnRenamed("y", "value"), ["pos"], "cls")
    return a.select(F.col("pos").cast("long").alias("pos"), F.round("f", 5).alias("f"), "n")


@query(
    "s5_welch_t",
    sql("L", """SELECT pos, round((ma - mb) / sqrt(va / na + vb / nb), 5) + 0.0 AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df
       FROM (SELECT pos, avg(y) FILTER (cls = 1) AS ma, var_samp(y) FILTER (cls = 1) AS va, count(*) FILTER (cls = 1) AS na, avg(y) FILTER (cls = 2) AS mb, var_samp(y) FILTER (cls = 2) AS vb, count(*) FILTER (cls = 2) AS nb FROM L GROUP BY pos)"""),
)
def s5(spark, sf):
    s = st.sides(series(spark, sf).select("cls", "y"), "cls", {"1_vs_2": ([1], [2])})
    w = st.welch(s.select("side", F.posexplode_outer("y").alias("pos", "value")), ["pos"])
    return w.select(F.col("pos").cast("long").alias("pos"), r("t", 5).alias("t"), F.round("df", 4).alias("df"))


@query(
    "s6_mann_whitney",
    sql("L", """SELECT feature, contrast, round(u, 2) AS u, round(greatest(abs(u - na * nb / 2.0) - 0.5, 0) / sqrt(na * nb / 12e0 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1e0)))), 5) AS z, na, nb FROM UU""", *BASE, SDR, RANK, UU),
)
def s6(spark, sf):
    u = st.rank_sums(sided(spark, sf).withColumn("value", r("value", 0)), ["feature", "contrast"])
    return u.select("feature", "contrast", F.round("u", 2).alias("u"), F.round("z", 5).alias("z"), "na", "nb")


@query(
    "s7_mutual_information",
    sql(
        "L",
        """SELECT feature, round(mi, 6) AS mi, row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS mi_rank FROM (
        SELECT feature, sum(n / nt * ln(n * nt / (nb * nl))) AS mi FROM (SELECT feature, n, sum(n) OVER (PARTITION BY feature) * 1e0 AS nt, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, cls) AS nl FROM CELLS) GROUP BY feature)""",
        *WIDE,
        "ED AS (SELECT feature, " + ", ".join(f"quantile_cont(value, {i / 10}) AS e{i}" for i in range(11)) + " FROM LW GROUP BY feature)",
        "CELLS AS (SELECT feature, bin, cls, count(*) AS n FROM (SELECT feature, cls, least(9, " + " + ".join(f"CASE WHEN value >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + ") AS bin FROM LW JOIN ED USING (feature)) GROUP BY ALL)",
    ),
)
def s7(spark, sf):
    mi = st.mutual_information(areas(spark, sf).select("cls", *COLS), COLS, "cls")
    return rk.top_k(mi, [F.round("mi", 9).desc(), F.col("feature")], 35, "mi_rank").select("feature", F.round("mi", 6).alias("mi"), "mi_rank")


def digamma_sql(n: str) -> str:
    small = " ".join(f"WHEN {n} = {m} THEN {sum(1.0 / i for i in range(1, m)) - st.EULER!r}e0" for m in range(1, 6))
    x = f"CAST({n} AS DOUBLE)"
    return f"CASE {small} ELSE ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) END"


@query(
    "s7_nearest_information",
    sql(
        "L",
        f"SELECT feature, round(greatest(0, any_value(pn) + avg({digamma_sql('3')}) - avg({digamma_sql('nc')}) - avg({digamma_sql('m')})), 6) AS mi FROM C GROUP BY feature",
        *WIDE,
        "PR AS (SELECT a.feature, a.vec_id, a.value AS x, abs(a.value - b.value) AS d, a.cls = b.cls AND a.vec_id <> b.vec_id AS own FROM LW a JOIN LW b ON a.feature = b.feature)",
        "RD AS (SELECT feature, vec_id, list_sort(list(d) FILTER (own))[3] AS r FROM PR GROUP BY ALL)",
        f"C AS (SELECT w.feature, w.vec_id, count(*) FILTER (p.d < RD.r) AS m, any_value(n.nc) AS nc, any_value(t.pn) AS pn FROM LW w JOIN PR p ON p.feature = w.feature AND p.vec_id = w.vec_id JOIN RD ON RD.feature = w.feature AND RD.vec_id = w.vec_id "
        f"JOIN (SELECT feature, cls, count(*) AS nc FROM LW GROUP BY ALL) n ON n.feature = w.feature AND n.cls = w.cls JOIN (SELECT feature, {digamma_sql('count(*)')} AS pn FROM LW GROUP BY feature) t ON t.feature = w.feature GROUP BY w.feature, w.vec_id)",
    ),
)
def s7_nearest(spark, sf):
    flat = ru.unpivot(areas(spark, sf).select("cls", *COLS), ["cls"], COLS)
    return st.nearest_information(flat, ["feature"], "cls").select("feature", F.round("mi", 6).alias("mi"))


@query(
    "s8_correlations",
    sql("L", " UNION ALL ".join(f"SELECT 'auc_{a}' AS a, 'auc_{b}' AS b, round(corr(auc_{a}, auc_{b}), 6) + 0.0 AS r, abs(corr(auc_{a}, auc_{b})) > 0.85 AS redundant FROM WD" for i, a in enumerate(REG) for b in REG[i + 1 :]), *WIDE),
)
def s8(spark, sf):
    m = st.correlations(areas(spark, sf), COLS)
    return m.select("a", "b", r("r").alias("r"), (F.abs("r") > 0.85).alias("redundant"))


@query(
    "s9_class_cosine",
    sql(
        "L",
        """SELECT least(x.cls, z.cls) AS a, greatest(x.cls, z.cls) AS b, count(*) AS n_pairs, round(avg(cs), 6) + 0.0 AS mean_cosine FROM (
        SELECT p.sample_id AS i, q.sample_id AS j, sum(p.y * q.y) / (sqrt(sum(p.y * p.y)) * sqrt(sum(q.y * q.y))) AS cs FROM FMN p JOIN FMN q ON p.pos = q.pos AND p.sample_id < q.sample_id GROUP BY ALL)
        JOIN (SELECT DISTINCT sample_id, cls FROM S) x ON x.sample_id = i JOIN (SELECT DISTINCT sample_id, cls FROM S) z ON z.sample_id = j GROUP BY ALL""",
        "FMN AS (SELECT sample_id, pos, avg(y) AS y FROM L GROUP BY ALL)",
    ),
)
def s9(spark, sf):
    m = ru.mean_series(series(spark, sf), ["sample_id", "cls"])
    return st.class_cosine(m, "cls").select("a", "b", "n_pairs", r("mean_cosine").alias("mean_cosine"))


@query(
    "s10_batch_effect",
    sql(
        "L",
        """SELECT round(avg(d) FILTER (i % 5 = j % 5), 6) AS same_batch_squared, round(avg(d) FILTER (i % 5 <> j % 5), 6) AS other_batch_squared, round(avg(d) FILTER (i % 5 = j % 5) / avg(d) FILTER (i % 5 <> j % 5), 6) AS squared_ratio FROM (
        SELECT p.sample_id AS i, q.sample_id AS j, sum(pow(p.y - q.y, 2)) AS d FROM FMN p JOIN FMN q ON p.pos = q.pos AND p.sample_id < q.sample_id GROUP BY ALL)""",
        "FMN AS (SELECT sample_id, pos, avg(y) AS y FROM L GROUP BY ALL)",
    ),
)
def s10(spark, sf):
    m = ru.mean_series(series(spark, sf), ["sample_id"]).withColumn("batch", F.col("sample_id") % 5)
    b = st.batch_effect(m, "batch")
    return b.select(*[F.round(x, 6).alias(x) for x in ("same_batch_squared", "other_batch_squared", "squared_ratio")])


@query(
    "s11_silhouette",
    sql(
        "L",
        """SELECT coalesce(CAST(cls AS VARCHAR), 'all') AS scope, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS mean_silhouette FROM (
          SELECT vec_id, cls, max(md * n / (n - 1)) FILTER (k = cls) AS a, min(md) FILTER (k <> cls) AS b FROM (
            SELECT L.vec_id, L.cls, M.k, any_value(n) AS n, sum(y * y - 2 * y * m + q) AS md FROM L JOIN M USING (pos) GROUP BY L.vec_id, L.cls, M.k) GROUP BY ALL) GROUP BY GROUPING SETS ((cls), ())""",
        "M AS (SELECT cls AS k, pos, avg(y) AS m, avg(y * y) AS q, count(*) AS n FROM L GROUP BY ALL)",
    ),
)
def s11(spark, sf):
    s = st.silhouette(series(spark, sf).select("vec_id", "cls", "y"), "vec_id", "cls")
    return s.cube("cls").agg(F.count(F.lit(1)).alias("n"), r(F.avg("silhouette")).alias("mean_silhouette")).select(F.coalesce(F.col("cls").cast("string"), F.lit("all")).alias("scope"), "n", "mean_silhouette")


@query(
    "s12_variance_ratio",
    sql("L", """SELECT round((SELECT sum(b) FROM (SELECT sum(n * pow(m - g, 2)) AS b FROM (SELECT pos, subclass, count(*) AS n, avg(y) AS m FROM L GROUP BY ALL) JOIN (SELECT pos, avg(y) AS g FROM L GROUP BY pos) USING (pos)))
       / (SELECT sum(pow(y - g, 2)) FROM L JOIN (SELECT pos, avg(y) AS g FROM L GROUP BY pos) USING (pos)), 6) AS ratio"""),
)
def s12(spark, sf):
    return st.variance_ratio(series(spark, sf), "subclass").select(F.round("ratio", 6).alias("ratio"))


@query(
    "s13_standardised_components",
    """SELECT CAST(20 AS BIGINT) AS components, true AS ordered, true AS at_most_one, CAST(count(*) AS BIGINT) AS n FROM embeddings""",
)
def s13(spark, sf):
    from wavetable.operators.models import standardised_components

    s = series(spark, sf).select("vec_id", "y")
    scores, share = standardised_components(s, "y", 20)
    falling = all(b <= a + 1e-12 for a, b in zip(share, share[1:]))
    return scores.agg(
        F.max(F.size("scores")).cast("long").alias("components"), F.lit(falling).alias("ordered"), F.lit(sum(share) <= 1 + 1e-9).alias("at_most_one"), F.count(F.lit(1)).alias("n")
    )


BOOT = 400


@query(
    "s14_bootstrap_interval",
    sql(
        "P",
        """SELECT O.model, round(O.mean, 6) AS mean, O.n, round(B.lo, 6) AS lo, round(B.hi, 6) AS hi FROM (SELECT model, avg(ok) AS mean, count(*) AS n FROM RW GROUP BY model) O JOIN
        (SELECT model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT model, b, sum(w * ok) / sum(w) AS m FROM DR GROUP BY ALL) GROUP BY model) B USING (model)""",
        CORRECT,
        "RW AS (SELECT model, file_id, CASE WHEN pred = y_true THEN 1e0 ELSE 0e0 END AS ok FROM OK)",
        f"""DR AS (SELECT model, b, ok, len(list_filter([{', '.join(f'{e!r}e0' for e in st.POISSON_EDGES)}], lambda e: e <= u)) AS w FROM
          (SELECT model, b.b AS b, ok, CAST('0x' || substr(md5(concat('3|', b.b, '|', file_id)), 1, 13) AS BIGINT) / 4503599627370496e0 AS u FROM RW, range({BOOT}) b(b)))""",
    ),
)
def s14(spark, sf):
    from wavetable.operators.evaluate import soft_vote

    v = soft_vote(prediction(spark, sf), ["model", "file_id"], 4).select("model", "file_id", (F.col("pred") == F.col("y_true")).cast("double").alias("ok"))
    b = st.bootstrap_interval(v, ["model"], "file_id", "ok", BOOT, seed=3)
    return b.select("model", F.round("mean", 6).alias("mean"), "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    "s15_mcnemar",
    sql(
        "P",
        """SELECT both_ok AS both, only_a, only_b, neither, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)))
          FROM range(100000) t(i) WHERE i <= least(only_a, only_b))) END, 8) AS p FROM N""",
        CORRECT,
        """N AS (SELECT count(*) FILTER (a.pred = a.y_true AND b.pred = b.y_true) AS both_ok, count(*) FILTER (a.pred = a.y_true AND b.pred <> b.y_true) AS only_a, count(*) FILTER (a.pred <> a.y_true AND b.pred = b.y_true) AS only_b,
          count(*) FILTER (a.pred <> a.y_true AND b.pred <> b.y_true) AS neither FROM OK a JOIN OK b USING (file_id) WHERE a.model = 0 AND b.model = 2)""",
    ),
)
def s15(spark, sf):
    from wavetable.operators.evaluate import soft_vote

    v = soft_vote(prediction(spark, sf), ["model", "file_id"], 4).withColumn("ok", F.col("pred") == F.col("y_true"))
    return st.mcnemar(v, "file_id", "model", "ok", 0, 2).withColumn("p", F.round("p", 8))


@query("s16_permutation_importance")
def s16(spark, sf):
    from wavetable.operators.models import permuted_importance

    s = sample_features(spark, sf)
    return permuted_importance(s, COLS, "cls", "sample_id", seed=11)


@query(
    "s17_overlap_interval",
    sql("L", """SELECT round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, count(*) FILTER (cls = 0 AND auc_silent BETWEEN lo AND hi) AS n_a, count(*) FILTER (cls = 3 AND auc_silent BETWEEN lo AND hi) AS n_b FROM WD,
       (SELECT greatest(min(auc_silent) FILTER (cls = 0), min(auc_silent) FILTER (cls = 3)) AS lo, least(max(auc_silent) FILTER (cls = 0), max(auc_silent) FILTER (cls = 3)) AS hi FROM WD) GROUP BY lo, hi""", *WIDE),
)
def s17(spark, sf):
    o = st.overlap_interval(areas(spark, sf), "cls", "auc_silent", 0, 3)
    return o.select(r("lo").alias("lo"), r("hi").alias("hi"), "n_a", "n_b")


@query(
    "s18_verdict",
    sql("L", f"""SELECT contrast, n_clear, CASE WHEN n_clear = 3 THEN 'A' WHEN n_clear IN (1, 2) THEN 'B' ELSE 'C' END AS branch FROM (
       SELECT contrast, count(*) FILTER (abs({D.removesuffix(' + 0.0')}) >= 0.3) AS n_clear FROM MO GROUP BY contrast)""", *BASE, MOM),
)
def s18(spark, sf):
    e = st.effect_sizes(sample_features(spark, sf), COLS, "cls", CONTRASTS)
    return st.verdict(e, F.abs(F.round("d", 6)) >= 0.3, ["contrast"], 3)
