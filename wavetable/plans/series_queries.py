"""Projections and scalar functions on series (P1-P18)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.functions import series as fs
from wavetable.functions.linear import savgol, savgol_matrix
from wavetable.functions.stats import cohens_d, safe_ratio, signed_ratio
from wavetable.operators import augment, clean
from wavetable.operators.relate import batch_and_domain, name_family, search_catalog
from wavetable.plans.registry import query
from wavetable.plans.tables import AXIS, BINS, long, r, series, sql, table

REGIONS = {"fingerprint": (400.0, 1800.0), "ch_stretch": (2800.0, 3050.0), "lps": (800.0, 1200.0), "full": (76.0, 3499.0)}


def points(df: DataFrame, y="y", key=("vec_id",), digits=6) -> DataFrame:
    """Exploded result: key, pos, rounded value."""
    return df.select(*key, F.posexplode_outer(y).alias("pos", "v")).select(
        *key, F.col("pos").cast("long").alias("pos"), r("v", digits).alias("y")
    )


def weights_sql(name: str, matrix) -> str:
    rows = ", ".join(
        f"({i},{j},{matrix[i, j]!r}e0)".replace("e0e0", "e0") if "e" not in repr(float(matrix[i, j])) else f"({i},{j},{float(matrix[i, j])!r})"
        for i in range(matrix.shape[0])
        for j in range(matrix.shape[1])
        if matrix[i, j] != 0
    )
    rows = rows.replace("np.float64(", "").replace(")e0", "e0")
    return f"{name}(pos_in, pos_out, w) AS (VALUES {rows})"


NORM_CTE = "N AS (SELECT vec_id, avg(y) AS m, stddev_pop(y) AS s, min(y) AS lo, max(y) AS hi FROM L GROUP BY vec_id)"


@query("p1_snv", sql("L", "SELECT vec_id, pos, round((y - m) / (s + 1e-8), 6) + 0.0 AS y FROM L JOIN N USING (vec_id)", NORM_CTE))
def p1(spark, sf):
    return points(series(spark, sf).select("vec_id", fs.snv("y").alias("y")))


@query(
    "p2_normalise_modes",
    sql(
        "L",
        """SELECT vec_id, pos, round(y, 6) + 0.0 AS y_raw, round(CASE WHEN s > 0 THEN (y - m) / s ELSE 0 END, 6) + 0.0 AS y_snv,
        round(CASE WHEN hi > lo THEN (y - lo) / (hi - lo) ELSE 0 END, 6) + 0.0 AS y_minmax, round(y - m, 6) + 0.0 AS y_mean
        FROM L JOIN N USING (vec_id)""",
        NORM_CTE,
    ),
)
def p2(spark, sf):
    df = series(spark, sf).select("vec_id", *[fs.normalise("y", m).alias(f"y_{m}") for m in fs.NORMALISERS])
    z = F.arrays_zip(*[f"y_{m}" for m in fs.NORMALISERS])
    return df.select("vec_id", F.posexplode_outer(z).alias("pos", "z")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), *[r(f"z.y_{m}").alias(f"y_{m}") for m in fs.NORMALISERS]
    )


@query(
    "p3_crop_two_regions",
    sql("L", """SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS pos, round(y, 6) + 0.0 AS y
        FROM L WHERE wn BETWEEN 400 AND 1800 OR wn BETWEEN 2800 AND 3050"""),
)
def p3(spark, sf):
    return points(series(spark, sf).select("vec_id", clean.crop("y", AXIS).alias("y")))


@query(
    "p4_region_presets",
    sql(
        "L",
        """SELECT vec_id, region, count(*) AS n, round(avg(y), 6) + 0.0 AS mean_y FROM L
        JOIN (VALUES """
        + ", ".join(f"('{n}', {a}e0, {b}e0)" for n, (a, b) in REGIONS.items())
        + ") R(region, lo, hi) ON wn BETWEEN lo AND hi GROUP BY ALL",
    ),
)
def p4(spark, sf):
    df = series(spark, sf)
    parts = [
        F.struct(F.lit(n).alias("region"), clean.crop("y", AXIS, (w,)).alias("part")) for n, w in REGIONS.items()
    ]
    return df.select("vec_id", F.explode(F.array(*parts)).alias("p")).select(
        "vec_id",
        "p.region",
        F.size("p.part").cast("long").alias("n"),
        r(fs.total("p.part") / F.size("p.part")).alias("mean_y"),
    )


@query(
    "p5_despike",
    sql(
        "L",
        """SELECT vec_id, pos, round(CASE WHEN sigma >= 1e-6 AND res > 2.0 * sigma THEN med ELSE y END, 6) + 0.0 AS y
        FROM R JOIN G USING (vec_id)""",
        """M AS (SELECT a.vec_id, a.pos, any_value(a.y) AS y, median(coalesce(b.y, 0)) AS med
           FROM L a CROSS JOIN range(-3, 4) d(d) LEFT JOIN L b ON b.vec_id = a.vec_id AND b.pos = a.pos + d.d GROUP BY a.vec_id, a.pos)""",
        "R AS (SELECT vec_id, pos, y, med, y - med AS res FROM M)",
        "RM AS (SELECT vec_id, median(res) AS rmed FROM R GROUP BY vec_id)",
        "G AS (SELECT vec_id, 1.4826 * median(abs(res - rmed)) AS sigma FROM R JOIN RM USING (vec_id) GROUP BY vec_id)",
    ),
)
def p5(spark, sf):
    return points(series(spark, sf).select("vec_id", fs.despike("y", threshold=2.0, window=7).alias("y")))


@query(
    "p6_remove_baseline",
    sql(
        "L",
        """SELECT vec_id, pos, round(y - avg(q) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), 6) + 0.0 AS y FROM Q""",
        """Q AS (SELECT vec_id, pos, y, quantile_cont(y, 0.1) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS q FROM L)""",
    ),
)
def p6(spark, sf):
    return points(series(spark, sf).select("vec_id", fs.remove_baseline("y", half_width=8, quantile=0.1).alias("y")))


def lin_sql(matrix, digits=6) -> str:
    return sql(
        "L",
        f"SELECT vec_id, CAST(pos_out AS BIGINT) AS pos, round(sum(w * y), {digits}) + 0.0 AS y FROM L JOIN W ON W.pos_in = L.pos GROUP BY vec_id, pos_out",
        weights_sql("W", matrix),
    )


LAM = 100.0


def penalty_inverse() -> np.ndarray:
    """(I + LAM D'D)^-1 as a dense matrix: the first step of the penalised baseline, where all weights are 1."""
    d = np.diff(np.eye(BINS), n=2, axis=0)
    return np.linalg.inv(np.eye(BINS) + LAM * d.T @ d)


@query("p6_penalised_first_step", lin_sql(np.eye(BINS) - penalty_inverse()))
def p6_first(spark, sf):
    return points(series(spark, sf).select("vec_id", fs.remove_penalised_baseline("y", lam=LAM, max_iter=1).alias("y")))


@query("p6_penalised_baseline")
def p6_penalised(spark, sf):
    return points(series(spark, sf).select("vec_id", fs.remove_penalised_baseline("y", lam=LAM).alias("y")))


@query("p7_savgol_smooth", lin_sql(savgol_matrix(BINS, 9, 3)))
def p7(spark, sf):
    return points(series(spark, sf).select("vec_id", savgol("y", window=9, polyorder=3).alias("y")))


@query("p8_savgol_second_derivative", lin_sql(savgol_matrix(BINS, 9, 3, deriv=2)))
def p8(spark, sf):
    return points(series(spark, sf).select("vec_id", savgol("y", window=9, polyorder=3, deriv=2).alias("y")))


@query("p8_savgol_first_derivative_dx", lin_sql(savgol_matrix(BINS, 11, 3, deriv=1, delta=AXIS[1] - AXIS[0]), 8))
def p8b(spark, sf):
    d = savgol("y", window=11, polyorder=3, deriv=1, delta=AXIS[1] - AXIS[0])
    return points(series(spark, sf).select("vec_id", d.alias("y")), digits=8)


CLEAN_CTES = (
    """M AS (SELECT a.vec_id, a.cls, a.pos, any_value(a.y) AS y, median(coalesce(b.y, 0)) AS med
       FROM L a CROSS JOIN range(-3, 4) d(d) LEFT JOIN L b ON b.vec_id = a.vec_id AND b.pos = a.pos + d.d GROUP BY a.vec_id, a.cls, a.pos)""",
    "RM AS (SELECT vec_id, median(y - med) AS rmed FROM M GROUP BY vec_id)",
    "G AS (SELECT vec_id, 1.4826 * median(abs(y - med - rmed)) AS sigma FROM M JOIN RM USING (vec_id) GROUP BY vec_id)",
    "D AS (SELECT vec_id, cls, pos, CASE WHEN sigma >= 1e-6 AND y - med > 2.0 * sigma THEN med ELSE y END AS y FROM M JOIN G USING (vec_id))",
    """Q AS (SELECT *, quantile_cont(y, 0.1) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS q FROM D)""",
    """B AS (SELECT vec_id, cls, pos, y - avg(q) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS y FROM Q)""",
    weights_sql("W", savgol_matrix(BINS, 9, 3)),
    "SM AS (SELECT vec_id, cls, CAST(pos_out AS BIGINT) AS pos, sum(w * y) AS y FROM B JOIN W ON W.pos_in = B.pos GROUP BY vec_id, cls, pos_out)",
    """C AS (SELECT vec_id, cls, row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS pos, y FROM SM
       WHERE 76e0 + pos * 3423e0 / 63 BETWEEN 400 AND 1800 OR 76e0 + pos * 3423e0 / 63 BETWEEN 2800 AND 3050)""",
    "CN AS (SELECT vec_id, avg(y) AS m, stddev_pop(y) AS s FROM C GROUP BY vec_id)",
    "Z AS (SELECT vec_id, cls, pos, (y - m) / (s + 1e-8) AS y FROM C JOIN CN USING (vec_id))",
)


@query("p9_clean_chain", sql("L", "SELECT vec_id, pos, round(y, 5) + 0.0 AS y FROM Z", *CLEAN_CTES))
def p9(spark, sf):
    out, _ = clean.clean(series(spark, sf).select("vec_id", "y"), AXIS, threshold=2.0, half_width=8)
    return points(out, digits=5)


@query(
    "p10_stage_trace",
    sql(
        "L",
        " UNION ALL ".join(
            f"SELECT cls, vec_id, '{s}' AS stage, CAST(pos AS BIGINT) AS pos, round(y, 5) + 0.0 AS y FROM {t} WHERE vec_id IN (SELECT vec_id FROM X)"
            for s, t in (("raw", "L"), ("despike", "D"), ("baseline", "B"), ("smooth", "SM"), ("crop", "C"), ("snv", "Z"))
        ),
        *CLEAN_CTES,
        "X AS (SELECT cls, min(vec_id) AS vec_id FROM S GROUP BY cls)",
    ),
)
def p10(spark, sf):
    s = series(spark, sf)
    picked = s.groupBy("cls").agg(F.min_by(F.struct("vec_id", "y"), "vec_id").alias("e")).select("cls", "e.vec_id", "e.y")
    traced, _ = clean.clean(picked.withColumn("stage_raw", F.col("y")), AXIS, threshold=2.0, half_width=8, keep_stages=True)
    stages = ["raw", *clean.STEPS]
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"stage_{s}").alias("y")) for s in stages]))
    return points(traced.select("cls", "vec_id", parts.alias("e")).select("cls", "vec_id", "e.stage", "e.y"), key=("cls", "vec_id", "stage"), digits=5)


@query(
    "p11_safe_ratios",
    """SELECT vec_id, round(CASE WHEN abs(d) > 0.05 THEN n / d END, 6) + 0.0 AS ratio_or_null,
    round(n / CASE WHEN abs(d) < 0.05 THEN sign(d) * 0.05 + 0.05 ELSE d END, 6) + 0.0 AS ratio_signed
    FROM (SELECT vec_id, CAST(embedding[4] AS DOUBLE) AS n, abs(CAST(embedding[8] AS DOUBLE)) AS d FROM embeddings)""",
)
def p11(spark, sf):
    n, d = F.col("y")[3], F.abs(F.col("y")[7])
    return series(spark, sf).select(
        "vec_id", r(safe_ratio(n, d, 0.05)).alias("ratio_or_null"), r(signed_ratio(n, d, 0.05)).alias("ratio_signed")
    )


@query(
    "p12_batch_and_domain",
    """WITH K AS (SELECT doc_id, concat('R', doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('_100_', 260301 + n_chars % 28) END) AS file_key,
      CASE WHEN lang = 'en' THEN NULL ELSE lang END AS subclass FROM documents)
    SELECT doc_id, file_key, nullif(regexp_extract(file_key, '_(\\d{6})$', 1), '') AS batch_date, file_key AS by_file,
      coalesce(subclass, 'H2O') AS by_subclass, coalesce(nullif(regexp_extract(file_key, '_(\\d{6})$', 1), ''), 'unknown') AS by_date FROM K""",
)
def p12(spark, sf):
    d = table(spark, sf, "documents")
    key = F.concat(F.lit("R"), "doc_id", F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("_100_"), (F.lit(260301) + F.col("n_chars") % 28).cast("string"))))
    k = d.select("doc_id", key.alias("file_key"), F.when(F.col("lang") != "en", F.col("lang")).alias("subclass"))
    return batch_and_domain(k, "file_key", "subclass").drop("subclass")


@query(
    "p13_name_family",
    """SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'std' WHEN starts_with(p_type, 'SMALL') THEN 'small'
      WHEN starts_with(p_type, 'PROMO') THEN 'promo' ELSE 'other' END AS family,
      CASE WHEN contains(p_type, 'COPPER') THEN 'copper' WHEN contains(p_type, 'STEEL') THEN 'steel'
      WHEN contains(p_type, 'BRASS') THEN 'brass' ELSE 'mixed' END AS region FROM part""",
)
def p13(spark, sf):
    p = table(spark, sf, "part")
    family = name_family("p_type", prefixes={"STANDARD": "std", "SMALL": "small", "PROMO": "promo"}, default="other")
    region = name_family("p_type", keywords={"COPPER": "copper", "STEEL": "steel", "BRASS": "brass"}, default="mixed")
    return p.select("p_partkey", family.alias("family"), region.alias("region"))


def effect_by_position(spark, sf) -> DataFrame:
    """Effect size between class 0 and class 1 at every axis position."""
    g = long(series(spark, sf).where("cls in (0, 1)").select("vec_id", "cls", "y")).groupBy("pos").agg(
        *[f(F.when(F.col("cls") == k, F.col("y"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    )
    c = F.col
    return g.select(
        F.concat(F.lit("y_"), F.lpad(c("pos").cast("string"), 2, "0")).alias("feature"),
        F.when(c("pos") < 16, "low").when(c("pos") < 40, "mid").otherwise("high").alias("family"),
        cohens_d(c("m0"), c("v0"), c("n0"), c("m1"), c("v1"), c("n1")).alias("effect"),
    )


EFFECT_CTE = (
    """EA AS (SELECT pos, avg(y) FILTER (cls = 0) AS m0, var_samp(y) FILTER (cls = 0) AS v0, count(*) FILTER (cls = 0) AS n0,
      avg(y) FILTER (cls = 1) AS m1, var_samp(y) FILTER (cls = 1) AS v1, count(*) FILTER (cls = 1) AS n1 FROM L GROUP BY pos)""",
    """E AS (SELECT concat('y_', lpad(CAST(pos AS VARCHAR), 2, '0')) AS feature, CASE WHEN pos < 16 THEN 'low' WHEN pos < 40 THEN 'mid' ELSE 'high' END AS family,
      (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS effect FROM EA)""",
)


@query(
    "p14_search_catalog",
    sql("L", """SELECT row_number() OVER (ORDER BY abs(effect) DESC NULLS LAST, feature) AS place, feature, family, round(effect, 6) + 0.0 AS effect
       FROM E WHERE family IN ('low', 'mid') AND contains(lower(feature), '1')""", *EFFECT_CTE),
)
def p14(spark, sf):
    hits = search_catalog(effect_by_position(spark, sf), families=["low", "mid"], text="1", sort="effect")
    return hits.select("place", "feature", "family", r("effect").alias("effect"))


@query(
    "p15_sanitise",
    """SELECT vec_id, round(CASE WHEN y1 > 0 THEN ln(y1) ELSE 0 END, 6) + 0.0 AS log_y, round(CASE WHEN y2 > 0.1 THEN y1 / y2 ELSE 0 END, 6) + 0.0 AS ratio_y, 0.0e0 AS missing_a, 0.0e0 AS missing_b
    FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS y1, CAST(embedding[2] AS DOUBLE) AS y2 FROM embeddings)""",
)
def p15(spark, sf):
    from wavetable.operators.relate import pad_columns, sanitise

    y1, y2 = F.col("y")[0], F.col("y")[1]
    raw = series(spark, sf).select(
        "vec_id",
        F.when(y1 > 0, F.log(y1)).otherwise(F.lit(float("nan"))).alias("log_y"),
        F.when(y2 > 0.1, y1 / y2).otherwise(F.lit(float("inf"))).alias("ratio_y"),
    )
    out = pad_columns(sanitise(raw, ["log_y", "ratio_y"]), ["log_y", "ratio_y", "missing_a", "missing_b"])
    return out.select("vec_id", r("log_y").alias("log_y"), r("ratio_y").alias("ratio_y"), "missing_a", "missing_b")


@query(
    "p16_impute_median",
    """WITH X AS (SELECT vec_id, nullif(greatest(CAST(embedding[1] AS DOUBLE), -0.05), -0.05) AS a, nullif(least(CAST(embedding[2] AS DOUBLE), 0.02), 0.02) AS b FROM embeddings)
    SELECT vec_id, round(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM X), 0), 6) + 0.0 AS a, round(coalesce(b, (SELECT quantile_cont(b, 0.5) FROM X), 0), 6) + 0.0 AS b FROM X""",
)
def p16(spark, sf):
    from wavetable.operators.relate import impute_median

    a, b = F.col("y")[0], F.col("y")[1]
    raw = series(spark, sf).select(
        "vec_id", F.when(a > -0.05, a).alias("a"), F.when(b < 0.02, b).alias("b"), F.lit(None).cast("double").alias("gone")
    )
    out = impute_median(raw, ["a", "b", "gone"])
    return out.select("vec_id", *[r(c).alias(c) for c in out.columns if c != "vec_id"])


U = "(CAST(CAST('0x' || substr(md5(concat({s}, '|', {k}, '|', {p})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0)"


def u_sql(key: str, pos: str, salt: int) -> str:
    return "(" + U.format(k=key, p=pos, s=salt) + ")"


@query(
    "p17_augment_scale_shift_drift",
    sql(
        "L",
        """SELECT a.vec_id, a.pos, round(b.y * a.scale + CASE WHEN u_drift < 0.3 THEN amp * mx * sin(2 * pi() * a.pos / period + phase) ELSE 0 END, 6) + 0.0 AS y
        FROM A a JOIN L b ON b.vec_id = a.vec_id AND b.pos = ((a.pos - a.shift) % 64 + 64) % 64 JOIN MX ON MX.vec_id = a.vec_id""",
        "MX AS (SELECT L.vec_id, max(abs(y) * scale) AS mx FROM L JOIN (SELECT DISTINCT vec_id, "
        + f"CASE WHEN {u_sql('vec_id', '0', 11)} < 0.5 THEN 0.8 + 0.4 * {u_sql('vec_id', '0', 12)} ELSE 1.0 END AS scale FROM S) USING (vec_id) GROUP BY L.vec_id)",
        f"""A AS (SELECT vec_id, pos, CASE WHEN {u_sql('vec_id', '0', 11)} < 0.5 THEN 0.8 + 0.4 * {u_sql('vec_id', '0', 12)} ELSE 1.0 END AS scale,
          CASE WHEN {u_sql('vec_id', '0', 21)} < 0.5 THEN CAST(floor({u_sql('vec_id', '0', 22)} * 7) AS BIGINT) - 3 ELSE 0 END AS shift,
          {u_sql('vec_id', '0', 31)} AS u_drift, 0.1 * {u_sql('vec_id', '0', 32)} AS amp, 20 + 40 * {u_sql('vec_id', '0', 33)} AS period, 2 * pi() * {u_sql('vec_id', '0', 34)} AS phase FROM L)""",
    ),
)
def p17(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    out = augment.drift(
        augment.shift(augment.scale(s, "vec_id", "y", p=0.5, lo=0.8, hi=1.2, salt=11), "vec_id", "y", p=0.5, max_bins=3, salt=21),
        "vec_id", "y", p=0.3, amp_max=0.1, period=(20.0, 60.0), salt=31,
    )
    return points(out)


@query(
    "p17_augment_noise",
    sql(
        "L",
        f"""SELECT L.vec_id, L.pos, round(y + CASE WHEN {u_sql('L.vec_id', '0', 1)} < 0.5 THEN (0.01 + 0.04 * {u_sql('L.vec_id', '0', 2)}) * sd
          * sqrt(-2 * ln({u_sql('L.vec_id', '(L.pos + 1)', 3)} + 1e-12)) * cos(2 * pi() * {u_sql('L.vec_id', '(L.pos + 1)', 4)}) ELSE 0 END, 6) + 0.0 AS y
        FROM L JOIN (SELECT vec_id, stddev_samp(y) AS sd FROM L GROUP BY vec_id) USING (vec_id)""",
    ),
)
def p17_noise(spark, sf):
    return points(augment.noise(series(spark, sf).select("vec_id", "y"), "vec_id", "y", p=0.5, lo=0.01, hi=0.05, salt=1))


@query(
    "p17_augment_mixup",
    sql(
        "L",
        """SELECT a.vec_id, a.label_a, b.label_a AS label_b, L.pos, round(0.7 * L.y + 0.3 * M.y, 6) + 0.0 AS y
        FROM R a JOIN R b ON b.rn = a.rn % (SELECT count(*) FROM R) + 1 JOIN L ON L.vec_id = a.vec_id JOIN L M ON M.vec_id = b.vec_id AND M.pos = L.pos""",
        "R AS (SELECT vec_id, cls AS label_a, row_number() OVER (ORDER BY md5(concat('5|', vec_id)), vec_id) AS rn FROM S)",
    ),
)
def p17_mixup(spark, sf):
    out = augment.mixup(series(spark, sf).select("vec_id", "cls", "y"), "vec_id", "cls", "y", lam=0.7, seed=5)
    return points(out, key=("vec_id", "label_a", "label_b"))


BAND_SQL = "BANDS(name, center, grp) AS (VALUES " + ", ".join(f"('{n}', {c}e0, '{g}')" for n, (c, g) in catalog.BANDS.items()) + ")"


@query(
    "p18_band_catalog_by_group",
    sql(
        "L",
        """SELECT grp, count(*) AS n_bands, string_agg(name, ',' ORDER BY center, name) AS names, round(max(abs(effect)), 6) + 0.0 AS max_effect
        FROM B GROUP BY grp""",
        *EFFECT_CTE,
        BAND_SQL,
        """B AS (SELECT grp, name, center, effect FROM BANDS LEFT JOIN E ON feature = concat('y_', lpad(CAST(CAST(round((center - 76) * 63e0 / 3423) AS BIGINT) AS VARCHAR), 2, '0')))""",
    ),
)
def p18(spark, sf):
    bands = spark.createDataFrame([(n, c, g) for n, (c, g) in catalog.BANDS.items()], "name string, center double, grp string")
    near = F.concat(F.lit("y_"), F.lpad(F.round((F.col("center") - 76) * 63.0 / 3423).cast("long").cast("string"), 2, "0"))
    b = bands.withColumn("feature", near).join(effect_by_position(spark, sf).select("feature", "effect"), "feature", "left")
    return b.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_bands"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("center", "name"))), lambda s: s["name"]), ",").alias("names"),
        r(F.max(F.abs("effect"))).alias("max_effect"),
    )
