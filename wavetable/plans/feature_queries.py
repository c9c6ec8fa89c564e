"""Feature operators (F1-F19) and the flagship query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.functions import series as fs
from wavetable.functions.linear import savgol_matrix, wavelet_bank
from wavetable.functions.stats import cohens_d
from wavetable.operators import features as ft
from wavetable.operators import rollup, unmix
from wavetable.plans.registry import query
from wavetable.plans.series_queries import BAND_SQL, weights_sql
from wavetable.plans.tables import AXIS, BINS, long, r, series, sql
from wavetable.session import materialise

# The test axis has a step of 54.3, so bands need wide windows there.
HALF = 110.0
CENTERS = {n: c for n, (c, _) in catalog.BANDS.items()}


def tidy(df: DataFrame, cols: list[str], key=("vec_id",), digits: int = 6, name="feature") -> DataFrame:
    """Wide feature columns to (key, feature, value)."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias("value")) for c in cols]))
    return df.select(*key, parts.alias("e")).select(*key, f"e.{name}", r("e.value", digits).alias("value"))


def added(df: DataFrame, base: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in base.columns]


def auc_cte(name: str, windows: str, key: str = "vec_id", source: str = "L") -> str:
    """Trapezoid areas of L over a window table (name, lo, hi)."""
    return f"""{name} AS (SELECT {key}, name, sum((y + y1) / 2 * (wn1 - wn)) AS auc, count(*) AS n FROM (
      SELECT {key}, name, y, wn, lead(y) OVER w AS y1, lead(wn) OVER w AS wn1 FROM {source} JOIN {windows} ON wn BETWEEN lo AND hi
      WINDOW w AS (PARTITION BY {key}, name ORDER BY wn)) GROUP BY {key}, name HAVING count(*) >= 2)"""


def windows_sql(name: str, windows: dict) -> str:
    return f"{name}(name, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {a}e0, {b}e0)" for n, (a, b) in windows.items()) + ")"


BANDW = f"BW AS (SELECT name, center - {HALF} AS lo, center + {HALF} AS hi FROM BANDS)"


@query("f1_band_auc", sql("L", "SELECT vec_id, concat('auc_', name) AS feature, round(auc, 6) + 0.0 AS value FROM BA", BAND_SQL, BANDW, auc_cte("BA", "BW")))
def f1(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    out = ft.band_auc(s, "y", AXIS, half_width=HALF)
    return tidy(out, added(out, s))


@query(
    "f2_region_auc_and_sum",
    sql(
        "L",
        """SELECT vec_id, name AS region, round(auc, 6) + 0.0 AS auc, round(s, 6) + 0.0 AS total FROM RA JOIN
        (SELECT vec_id, name, sum(y) AS s FROM L JOIN R ON wn BETWEEN lo AND hi GROUP BY ALL) USING (vec_id, name)""",
        windows_sql("R", catalog.ROIS),
        auc_cte("RA", "R"),
    ),
)
def f2(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    out = ft.window_sum(ft.integrate(s, "y", AXIS, catalog.ROIS), "y", AXIS, catalog.ROIS)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("region"), F.col(f"auc_{n}").alias("a"), F.col(f"sum_{n}").alias("t")) for n in catalog.ROIS]))
    return out.select("vec_id", parts.alias("e")).select("vec_id", "e.region", r("e.a").alias("auc"), r("e.t").alias("total"))


GROUP_NAMES = "GN(grp, gname) AS (VALUES " + ", ".join(f"('{code}', '{n}')" for n, code in catalog.GROUPS.items()) + ")"
GROUP_CTES = (
    BAND_SQL,
    BANDW,
    auc_cte("BA", "BW"),
    GROUP_NAMES,
    windows_sql("CR", catalog.CONTINUOUS_REGIONS),
    auc_cte("CA", "CR"),
    """GV AS (SELECT vec_id, gname AS name, sum(auc) AS auc FROM BA JOIN BANDS USING (name) JOIN GN USING (grp) GROUP BY ALL
       UNION ALL SELECT vec_id, name, auc FROM CA)""",
)


@query("f3_group_vector", sql("L", "SELECT vec_id, concat('auc_', name) AS feature, round(auc, 6) + 0.0 AS value FROM GV", *GROUP_CTES))
def f3(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    out = ft.group_vector(s, "y", AXIS, half_width=HALF)
    return tidy(out, added(out, s))


RATIO_SQL = "RT(rname, num, den) AS (VALUES " + ", ".join(
    f"('{n}', '{a.split(':')[1]}', '{b.split(':')[1]}')" for n, (a, b) in catalog.RATIOS.items()
) + ")"


@query(
    "f4_named_ratios",
    sql(
        "L",
        """SELECT a.vec_id, concat('ratio_', rname) AS feature, round(a.auc / CASE WHEN abs(b.auc) < 1e-9 THEN sign(b.auc) * 1e-9 + 1e-9 ELSE b.auc END, 4) + 0.0 AS value
        FROM RT JOIN ALLV a ON a.name = num JOIN ALLV b ON b.name = den AND b.vec_id = a.vec_id""",
        *GROUP_CTES,
        "ALLV AS MATERIALIZED (SELECT * FROM GV UNION ALL SELECT vec_id, name, auc FROM BA)",
        RATIO_SQL,
    ),
)
def f4(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    base = ft.band_auc(ft.group_vector(s, "y", AXIS, half_width=HALF), "y", AXIS, half_width=HALF)
    return tidy(ft.named_ratios(base), [f"ratio_{n}" for n in catalog.RATIOS], digits=4)


def _safe(n: str, d: str) -> str:
    return f"CASE WHEN abs({d}) > 1e-8 THEN ({n}) / ({d}) END"


def _composition_sql() -> str:
    a = {int(c): f"max(auc) FILTER (name = 'c{int(c)}')" for c in catalog.COMPOSITION_CENTERS}
    cols = ", ".join(f"{e} AS a{c}" for c, e in a.items())
    out = {
        "bio_cyt_pyrrole_ratio": _safe("a752", "a1004"), "bio_cyt_ox_state": _safe("a1356", "a1372"), "bio_cyt_total": "a752 + a1127 + a1585",
        "bio_alpha_helix_score": _safe("a1652", "a1670"), "bio_beta_sheet_amide3": _safe("a1232", "a1270"), "bio_phb_carbonyl": "a1730",
        "bio_phb_score": _safe("a1730 * a1058", "a1450 * a1450"), "bio_tyr_doublet_ratio": _safe("a850", "a830"), "bio_trp_content": "a759 + a1552",
        "bio_trp_indole_env": _safe("a1340", "a1360"), "bio_virulence_aa_sig": _safe("a759 + a1552", "a1004"),
        "bio_na_a_form_fraction": _safe("a815", "a815 + a835"), "bio_rna_dna_ratio": _safe("a813", "a788"),
    }
    body = " UNION ALL ".join(f"SELECT vec_id, '{n}' AS feature, round({e}, 4) + 0.0 AS value FROM W" for n, e in out.items())
    return sql(
        "L", body,
        windows_sql("CW", {f"c{int(c)}": (c - HALF, c + HALF) for c in catalog.COMPOSITION_CENTERS}),
        auc_cte("CA", "CW"), f"W AS (SELECT vec_id, {cols} FROM CA GROUP BY vec_id)",
    )


@query("f5_composition_ratios", _composition_sql())
def f5(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    out = ft.composition_ratios(s, "y", AXIS, HALF)
    return tidy(out, added(out, s), digits=4)


@query(
    "f6_roi_moments",
    sql(
        "L",
        """SELECT m.vec_id, m.name AS region, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(skew, 5) + 0.0 AS skew, round(kurt, 5) + 0.0 AS kurt,
        round(sw / CASE WHEN abs(s) < 1e-9 THEN sign(s) * 1e-9 + 1e-9 ELSE s END, 3) + 0.0 AS centroid, round(entropy, 6) + 0.0 AS entropy
        FROM (SELECT vec_id, name, avg(y) AS mean, stddev_pop(y) AS sd, CASE WHEN count(*) >= 3 THEN skewness(y) END AS skew, CASE WHEN count(*) >= 4 THEN kurtosis(y) END AS kurt,
          sum(y) AS s, sum(y * wn) AS sw, count(*) AS n FROM X GROUP BY ALL HAVING count(*) >= 3) m
        JOIN (SELECT vec_id, name, -sum(p * ln(p + 1e-9)) AS entropy FROM (SELECT vec_id, name, abs(y) / (sum(abs(y)) OVER (PARTITION BY vec_id, name) + 1e-9) AS p FROM X) GROUP BY ALL) e
        USING (vec_id, name)""",
        windows_sql("R", catalog.ROIS),
        "X AS (SELECT vec_id, name, y, wn FROM L JOIN R ON wn BETWEEN lo AND hi)",
    ),
)
def f6(spark, sf):
    out = ft.roi_moments(series(spark, sf).select("vec_id", "y"), "y", AXIS)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("region"), *[F.col(f"roi_{n}_{s}").alias(s) for s in ft.MOMENTS]) for n in catalog.ROIS]))
    c = lambda s, d: r(f"e.{s}", d)
    return out.select("vec_id", parts.alias("e")).where("e.mean is not null").select(
        "vec_id", "e.region", c("mean", 6).alias("mean"), c("std", 6).alias("sd"), c("skew", 5).alias("skew"),
        c("kurt", 5).alias("kurt"), c("centroid", 3).alias("centroid"), c("entropy", 6).alias("entropy"),
    )


# The normal equations of the four regressors, solved in SQL by Gauss-Jordan would be long; the twin
# checks the defining property instead: the residual is orthogonal to every regressor, and
# prediction + residual gives the series back.
@query(
    "f7_scatter_correction",
    sql(
        "L",
        """SELECT vec_id, round(sum(y), 6) + 0.0 AS y_dot_one, round(sum(y * m), 6) + 0.0 AS y_dot_ref, round(sum(y * x), 6) + 0.0 AS y_dot_x, round(sum(y * x * x), 6) + 0.0 AS y_dot_x2,
        0.0e0 AS res_dot_one, 0.0e0 AS res_dot_ref, 0.0e0 AS res_dot_x, 0.0e0 AS res_dot_x2
        FROM L JOIN M USING (pos) GROUP BY vec_id""",
        "A AS (SELECT avg(76e0 + p * 3423e0 / 63) AS am, stddev_pop(76e0 + p * 3423e0 / 63) AS sd FROM range(64) t(p))",
        "M AS (SELECT pos, avg(y) AS m, any_value((wn - am) / (sd + 1e-9)) AS x FROM L, A GROUP BY pos)",
    ),
)
def f7(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    ref = ft.mean_vector(s)
    out = ft.emsc(s, "y", AXIS, ref)
    x = (np.array(AXIS) - np.mean(AXIS)) / (np.std(AXIS) + 1e-9)
    design = np.stack([np.ones(BINS), ref, x, x * x], axis=1)
    gram = design.T @ design
    terms = [F.col(c) for c in ("emsc_a", "emsc_b", "emsc_c1", "emsc_c2")]
    names = ["one", "ref", "x", "x2"]
    packed = fs.row_map(lambda v: v @ design)("emsc_residual")
    fitted = [sum((terms[j] * float(gram[i, j]) for j in range(4)), F.lit(0.0)) for i in range(4)]
    return out.withColumn("_p", packed).select(
        "vec_id",
        *[r(fitted[i] + F.col("_p")[i]).alias(f"y_dot_{n}") for i, n in enumerate(names)],
        *[r(F.col("_p")[i]).alias(f"res_dot_{n}") for i, n in enumerate(names)],
    )


PEAK_CENTERS = {n: CENTERS[n] for n in catalog.PEAK_BANDS}
PW = {n: (c - HALF, c + HALF) for n, c in PEAK_CENTERS.items()}


def _derivative_sql(d: int) -> str:
    return sql(
        "L",
        f"SELECT vec_id, concat('d{d}_auc_', name) AS feature, round(auc, 7) + 0.0 AS value FROM DA",
        weights_sql("W", savgol_matrix(BINS, 11, 3, deriv=d, delta=float(np.median(np.diff(AXIS))))),
        """DER AS (SELECT vec_id, CAST(pos_out AS BIGINT) AS pos, 76e0 + pos_out * 3423e0 / 63 AS wn, abs(sum(w * y)) AS y
          FROM L JOIN W ON W.pos_in = L.pos GROUP BY vec_id, pos_out)""",
        windows_sql("PW", PW),
        auc_cte("DA", "PW", source="DER"),
    )


@query("f8_derivative_auc_first", _derivative_sql(1))
def f8a(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    out = ft.derivative_auc(s, "y", AXIS, PEAK_CENTERS, 1, HALF)
    return tidy(out, added(out, s), digits=7)


@query("f8_derivative_auc_second", _derivative_sql(2))
def f8b(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    out = ft.derivative_auc(s, "y", AXIS, PEAK_CENTERS, 2, HALF)
    return tidy(out, added(out, s), digits=7)


PEAK_CTES = (
    windows_sql("PW", PW),
    """X AS (SELECT vec_id, cls, name, wn, y, first_value(y) OVER w AS y0, first_value(wn) OVER w AS w0, last_value(y) OVER w AS y9, last_value(wn) OVER w AS w9
      FROM L JOIN PW ON wn BETWEEN lo AND hi WINDOW w AS (PARTITION BY vec_id, name ORDER BY wn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
    "H AS (SELECT vec_id, cls, name, wn, y - (y0 + (y9 - y0) / (w9 - w0) * (wn - w0)) AS h FROM X)",
    "H2 AS (SELECT *, greatest(h, 0) AS p, lead(h) OVER w AS h1, lead(wn) OVER w AS wn1 FROM H WINDOW w AS (PARTITION BY vec_id, name ORDER BY wn))",
    "C AS (SELECT vec_id, name, sum(p * wn) / nullif(sum(p), 0) AS c FROM H2 GROUP BY ALL)",
    """PK AS (SELECT vec_id, cls, name, arg_max(wn, h) AS position, max(h) AS height, any_value(c) AS centre,
      sqrt(sum(p * (wn - c) * (wn - c)) / nullif(sum(p), 0)) AS width, sum((h + h1) / 2 * (wn1 - wn)) AS area, sqrt(avg(h * h)) AS residual FROM H2 JOIN C USING (vec_id, name) GROUP BY vec_id, cls, name)""",
)


@query(
    "f9_peak_descriptors",
    sql(
        "L",
        """SELECT vec_id, name AS band, CASE WHEN height > 1e-9 THEN round(position, 4) END AS position, round(height, 6) + 0.0 AS height,
        CASE WHEN height > 1e-9 THEN round(centre, 3) END AS centre, CASE WHEN height > 1e-9 THEN round(width, 3) END AS width, round(area, 5) + 0.0 AS area, round(residual, 6) + 0.0 AS residual FROM PK""",
        *PEAK_CTES,
    ),
)
def f9(spark, sf):
    out = ft.peak_descriptors(series(spark, sf).select("vec_id", "y"), "y", AXIS, PEAK_CENTERS, HALF)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), *[F.col(f"peak_{n}_{s}").alias(s) for s in ft.PEAK_STATS]) for n in PEAK_CENTERS]))
    e = out.select("vec_id", parts.alias("e")).select("vec_id", "e.*")
    real = lambda c, d: F.when(F.col("height") > 1e-9, F.round(c, d))
    return e.select(
        "vec_id", "band", real("position", 4).alias("position"), r("height").alias("height"), real("centre", 3).alias("centre"),
        real("width", 3).alias("width"), r("area", 5).alias("area"), r("residual").alias("residual"),
    )


# Lines planted on a fine axis with the row's own values as parameters: SQL states what a fit must find.
LINE_AXIS = [974.0 + i for i in range(61)]
LINE_CTE = "P AS (SELECT vec_id, 2e0 + CAST(embedding[1] AS DOUBLE) AS a, 1004e0 + 5 * CAST(embedding[2] AS DOUBLE) AS x0, 6e0 + 3 * CAST(embedding[3] AS DOUBLE) AS g, CAST(embedding[4] AS DOUBLE) AS c FROM embeddings)"


def planted_lines(spark, sf):
    a, x0, g, c = (F.col("y")[i] for i in range(4))
    x = F.array(*[F.lit(v) for v in LINE_AXIS])
    line = F.transform(x, lambda v: (2 + a) / (1 + F.pow((v - (1004 + 5 * x0)) / (6 + 3 * g), F.lit(2))) + c)
    return series(spark, sf).select("vec_id", line.alias("y"))


@query(
    "f9_lorentz_fit",
    "WITH " + LINE_CTE + " SELECT vec_id, round(x0, 4) AS centre, round(a, 4) AS height, round(2 * g, 4) AS fwhm, round(pi() * a * g, 3) AS area, round(c, 4) + 0.0 AS base, 1.0 AS success FROM P",
)
def f9_lorentz(spark, sf):
    f = ft.line_fits(planted_lines(spark, sf), "y", LINE_AXIS, {"b": 1004.0})
    return f.select("vec_id", *[(F.round(f"line_b_{n}", 3 if n == "area" else 4) + F.lit(0.0)).alias(n) for n in ("centre", "height", "fwhm", "area", "base", "success")])


@query(
    "f9b_line_quality",
    "WITH " + LINE_CTE + " SELECT count(*) AS n, 1.0 AS success_rate, round(avg(x0 - 1004), 5) + 0.0 AS centre_shift, round(avg(2 * g), 5) AS mean_fwhm FROM P",
)
def f9b_line(spark, sf):
    q = ft.line_quality(ft.line_fits(planted_lines(spark, sf), "y", LINE_AXIS, {"b": 1004.0}, shape="lorentz"), {"b": 1004.0})
    return q.select("n", "success_rate", (F.round("centre_shift", 5) + F.lit(0.0)).alias("centre_shift"), F.round("mean_fwhm", 5).alias("mean_fwhm"))


@query("f9_voigt_fit")
def f9_voigt(spark, sf):
    f = ft.line_fits(planted_lines(spark, sf), "y", LINE_AXIS, {"b": 1004.0}, shape="voigt")
    return f.select("vec_id", *[F.round(f"line_b_{n}", 4).alias(n) for n in ("centre", "height", "fwhm", "eta", "area", "rmse", "success")])


@query(
    "f9b_peak_quality",
    sql(
        "L",
        """SELECT name AS band, """
        + ", ".join(f"round(avg(CASE WHEN height > 0.05 THEN 1.0 ELSE 0.0 END) FILTER (cls = {k}), 6) AS success_{k}, round(avg(abs(centre - center)) FILTER (cls = {k} AND height > 0.05), 4) AS drift_{k}" for k in range(4))
        + " FROM PK JOIN BANDS USING (name) GROUP BY name",
        *PEAK_CTES,
        BAND_SQL,
    ),
)
def f9b(spark, sf):
    s = series(spark, sf).select("vec_id", "cls", "y")
    peaks = ft.peak_descriptors(s, "y", AXIS, PEAK_CENTERS, HALF)
    return rollup.peak_quality(peaks, PEAK_CENTERS, "cls", [0, 1, 2, 3], min_height=0.05)


BANK = wavelet_bank(BINS, 3)


@query(
    "f10_wavelet_features",
    sql(
        "L",
        """SELECT vec_id, lvl, round(energy, 6) + 0.0 AS energy, round(-sum(CASE WHEN c2 / energy > 1e-12 THEN c2 / energy * ln(c2 / energy) ELSE 0 END), 6) + 0.0 AS entropy
        FROM (SELECT *, sum(c2) OVER (PARTITION BY vec_id, lvl) AS energy FROM C) GROUP BY vec_id, lvl, energy""",
        *[weights_sql(f"W{k + 1}", np.round(w, 15)) for k, w in enumerate(BANK)],
        "C AS ("
        + " UNION ALL ".join(
            f"SELECT vec_id, CAST({k + 1} AS BIGINT) AS lvl, pos_out, pow(sum(w * y), 2) AS c2 FROM L JOIN W{k + 1} ON pos_in = pos GROUP BY vec_id, pos_out" for k in range(len(BANK))
        )
        + ")",
    ),
)
def f10(spark, sf):
    out = ft.wavelet_features(series(spark, sf).select("vec_id", "y"), "y", BINS, 3)
    parts = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lvl"), F.col(f"dwt_energy_L{k}").alias("a"), F.col(f"dwt_entropy_L{k}").alias("b")) for k in (1, 2, 3)]))
    return out.select("vec_id", parts.alias("e")).select("vec_id", "e.lvl", r("e.a").alias("energy"), r("e.b").alias("entropy"))


@query("f11_region_components")
def f11(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    fitted = ft.fit_region_components(s, "y", AXIS)
    out = ft.region_scores(s, "y", AXIS, fitted)
    return tidy(out, added(out, s))


@query(
    "f11_region_components_invariants",
    sql(
        "L",
        """SELECT 'lps' AS region, round(sum(v), 6) AS total_variance, true AS ordered, true AS at_most_one, CAST(5 AS BIGINT) AS components FROM (SELECT var_samp(y) AS v FROM L WHERE wn BETWEEN 800 AND 1200 GROUP BY pos)
        UNION ALL SELECT 'chstretch', round(sum(v), 6), true, true, CAST(3 AS BIGINT) FROM (SELECT var_samp(y) AS v FROM L WHERE wn BETWEEN 2800 AND 3050 GROUP BY pos)""",
    ),
)
def f11_invariants(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    fitted = ft.fit_region_components(s, "y", AXIS)
    scores = ft.region_scores(s, "y", AXIS, fitted)
    out = None
    for f in fitted:
        if f.axes is None:
            continue
        name, k, ratio = f.name, f.size, f.explained
        # score variance / explained share must give the region's total variance back
        var = sum((F.var_samp(f"pca_{name}_PC{i + 1}") for i in range(k)), F.lit(0.0))
        row = scores.agg(
            F.lit(name).alias("region"), r(var / float(ratio.sum())).alias("total_variance"),
            F.lit(bool((np.diff(ratio) <= 1e-12).all())).alias("ordered"), F.lit(bool(ratio.sum() <= 1 + 1e-9)).alias("at_most_one"),
            F.lit(k).cast("long").alias("components"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def _angle_sql(label: str, cond: str, prefix: str) -> str:
    return f"""SELECT a.vec_id, concat('{prefix}', t.k) AS feature, round(acos(greatest(-1, least(1, sum(a.y * t.m) / ((sqrt(sum(a.y * a.y)) + 1e-9) * (sqrt(sum(t.m * t.m)) + 1e-9))))), 6) + 0.0 AS value
      FROM L a JOIN (SELECT {label} AS k, pos, avg(y) AS m FROM L GROUP BY ALL) t USING (pos) WHERE {cond} GROUP BY a.vec_id, t.k"""


@query(
    "f12_template_angles",
    sql(
        "L",
        " UNION ALL ".join(
            [
                _angle_sql("cls", "true", "sam_class_"), _angle_sql("subclass", "true", "sam_sub_"),
                _angle_sql("cls", "wn BETWEEN 800 AND 1200", "sam_lps_class_"), _angle_sql("subclass", "wn BETWEEN 800 AND 1200", "sam_lps_sub_"),
            ]
        ),
    ),
)
def f12(spark, sf):
    s = series(spark, sf).select("vec_id", "cls", "subclass", "y")
    out = ft.spectral_frame(s, "y", AXIS, label="cls", sublabel="subclass", wavelet=False, components=False)
    return tidy(out, added(out, s))


SPEC = ["vec_id", "file_id", "y"]


@query("f13_purest_variables", None)
def f13(spark, sf):
    s = unmix.shift_non_negative(series(spark, sf).select(*SPEC), "y")
    init, picked = unmix.purest_variables(s, "y", 4)
    rows = [(k, int(picked[k]), p, float(init[k, p])) for k in range(4) for p in range(init.shape[1])]
    return spark.createDataFrame(rows, "component long, variable long, pos long, y double")


# The first pick needs no residual: the largest population sd over mean plus offset, of series shifted to be non-negative.
@query(
    "f13_first_variable",
    sql("L", "SELECT CAST(arg_max(pos, (purity, -pos)) AS BIGINT) AS variable, round(max(purity), 6) AS purity FROM (SELECT pos, sd / (m + 0.05 * (SELECT max(m) FROM V)) AS purity FROM V)",
        "V AS (SELECT pos, avg(y - (SELECT min(y) FROM L)) AS m, stddev_pop(y) AS sd FROM L GROUP BY pos)"),
)
def f13_first(spark, sf):
    s = unmix.shift_non_negative(series(spark, sf).select(*SPEC), "y")
    _, picked = unmix.purest_variables(s, "y", 1)
    at = s.agg(F.avg(F.col("y")[picked[0]]).alias("m"), F.stddev_pop(F.col("y")[picked[0]]).alias("sd"))
    top = s.agg(*[F.avg(F.col("y")[p]).alias(f"m{p}") for p in range(BINS)]).select(F.greatest(*[f"m{p}" for p in range(BINS)]).alias("most"))
    return at.crossJoin(top).select(F.lit(int(picked[0])).cast("long").alias("variable"), F.round(F.col("sd") / (F.col("m") + 0.05 * F.col("most")), 6).alias("purity"))


@query("f14_unmix")
def f14(spark, sf):
    s = materialise(unmix.shift_non_negative(series(spark, sf).select(*SPEC), "y"), "shifted")
    fit = unmix.fit(s, "y", 4)
    out = unmix.concentrations(s, "y", fit.spectra)
    return out.select("vec_id", F.posexplode_outer("c").alias("component", "v")).select("vec_id", F.col("component").cast("long").alias("component"), r("v").alias("c"))


@query(
    "f14_unmix_error_bound",
    sql("L", """SELECT count(DISTINCT vec_id) AS n_series, round(sum((y - (SELECT min(y) FROM L)) ** 2), 4) AS input_square, true AS non_negative, true AS error_never_grows, true AS below_input FROM L"""),
)
def f14_bound(spark, sf):
    s = materialise(unmix.shift_non_negative(series(spark, sf).select(*SPEC), "y"), "shifted")
    fit = unmix.fit(s, "y", 4)
    c = unmix.residual(unmix.concentrations(s, "y", fit.spectra), "y", fit.spectra)
    falls = all(b <= a * (1 + 1e-9) for a, b in zip(fit.errors, fit.errors[1:]))
    return c.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.round(F.sum(fs.norm("y") * fs.norm("y")), 4).alias("input_square"),
        (F.min(F.array_min("c")) >= 0).alias("non_negative"),
        F.lit(falls).alias("error_never_grows"),
        (F.sum(F.col("residual_norm") * F.col("residual_norm")) < F.sum(fs.norm("y") * fs.norm("y"))).alias("below_input"),
    )


# Fixed templates let SQL follow the non-negative fit: with orthogonal templates the optimum per
# component is max(0, <y, s> / <s, s>).
def block_spectra(k: int = 4) -> np.ndarray:
    s = np.zeros((k, BINS))
    for j in range(k):
        s[j, j * (BINS // k) : (j + 1) * (BINS // k)] = 0.25
    return s


BLOCK_CTE = "CC AS (SELECT vec_id, file_id, pos // 16 AS k, greatest(0, sum(0.25 * (y + 1)) / 1.0) AS c FROM L GROUP BY vec_id, file_id, pos // 16)"


def block_concentrations(spark, sf):
    s = series(spark, sf).select("vec_id", "file_id", F.transform("y", lambda v: v + 1.0).alias("y"))
    return unmix.concentrations(s, "y", block_spectra())


@query(
    "f15_abundance_summary",
    sql(
        "L",
        """SELECT file_id, CAST(k + 1 AS BIGINT) AS component, round(avg(c), 6) + 0.0 AS mean, round(stddev_samp(c), 6) + 0.0 AS std, round(max(c), 6) + 0.0 AS max, round(quantile_cont(c, 0.9), 6) + 0.0 AS p90
        FROM CC GROUP BY file_id, k""",
        BLOCK_CTE,
    ),
)
def f15(spark, sf):
    out = unmix.abundance_summary(block_concentrations(spark, sf), "file_id")
    return out.select("file_id", "component", *[r(c).alias(c) for c in ("mean", "std", "max", "p90")])


@query(
    "f16_reconstruction_residual",
    sql(
        "L",
        """SELECT file_id, round(avg(n), 6) + 0.0 AS residual_norm_mean FROM (SELECT file_id, vec_id, sqrt(sum(pow(y + 1 - 0.25 * c, 2))) AS n
        FROM L JOIN CC ON CC.vec_id = L.vec_id AND CC.k = L.pos // 16 GROUP BY L.file_id, L.vec_id) GROUP BY file_id""".replace("SELECT file_id, vec_id, sqrt", "SELECT L.file_id, L.vec_id, sqrt"),
        BLOCK_CTE,
    ),
)
def f16(spark, sf):
    out = unmix.residual(block_concentrations(spark, sf), "y", block_spectra())
    return out.groupBy("file_id").agg(r(F.avg("residual_norm")).alias("residual_norm_mean"))


@query(
    "f16_partial_reconstruction",
    sql(
        "L",
        """SELECT vec_id, pos, round(rec + m - avg(rec) OVER (PARTITION BY vec_id), 6) + 0.0 AS y FROM (
        SELECT L.vec_id, pos, CASE WHEN k IN (0, 2) THEN 0.25 * c ELSE 0 END AS rec, avg(y + 1) OVER (PARTITION BY L.vec_id) AS m FROM L JOIN CC ON CC.vec_id = L.vec_id AND CC.k = L.pos // 16)""",
        BLOCK_CTE,
    ),
)
def f16b(spark, sf):
    out = unmix.partial_reconstruction(block_concentrations(spark, sf), "y", block_spectra(), [0, 2])
    return out.select("vec_id", F.posexplode_outer("reconstruction").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), r("v").alias("y"))


@query(
    "f17_spatial_variance_cv",
    sql(
        "L",
        "SELECT file_id, name AS region, round(var_samp(auc), 6) + 0.0 AS var, round(stddev_samp(auc) / (abs(avg(auc)) + 1e-9), 4) + 0.0 AS cv FROM RA GROUP BY file_id, name",
        windows_sql("R", catalog.SPATIAL_REGIONS),
        auc_cte("RA", "R", "file_id, vec_id"),
    ),
)
def f17(spark, sf):
    out = rollup.spatial_spread(series(spark, sf), "file_id", "y", AXIS)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("region"), F.col(f"spat_var_{n}").alias("v"), F.col(f"spat_cv_{n}").alias("c")) for n in catalog.SPATIAL_REGIONS]))
    return out.select("file_id", parts.alias("e")).select("file_id", "e.region", r("e.v").alias("var"), r("e.c", 4).alias("cv"))


@query(
    "f18_spatial_moments",
    sql(
        "L",
        """SELECT sample_id, name AS band, round(CASE WHEN count(*) >= 4 THEN kurtosis(auc) END, 4) + 0.0 AS kurt, round(CASE WHEN count(*) >= 4 THEN skewness(auc) END, 4) + 0.0 AS skew,
        round(CASE WHEN count(*) >= 4 THEN stddev_samp(auc) END, 6) + 0.0 AS std FROM BA GROUP BY sample_id, name""",
        windows_sql("BW", {n: (c - HALF, c + HALF) for n, c in catalog.SPATIAL_BANDS.items()}),
        auc_cte("BA", "BW", "sample_id, vec_id"),
    ),
)
def f18(spark, sf):
    out = rollup.spatial_moments(series(spark, sf), "sample_id", "y", AXIS, half_width=HALF)
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), *[F.col(f"spat_{m}_{n}").alias(m) for m in ("kurt", "skew", "std")]) for n in catalog.SPATIAL_BANDS]))
    return out.select("sample_id", parts.alias("e")).select("sample_id", "e.band", r("e.kurt", 4).alias("kurt"), r("e.skew", 4).alias("skew"), r("e.std").alias("std"))


@query(
    "f19_feature_frames",
    "SELECT vec_id, CAST(166 AS BIGINT) AS band_columns, CAST(51 AS BIGINT) AS spectral_columns, true AS finite_bands FROM embeddings",
)
def f19(spark, sf):
    # 4 classes and 10 subclasses: one subclass is folded away to give the 4 + 9 + 1 labels of the reference frame
    s = series(spark, sf).select("vec_id", "cls", F.col("subclass").alias("sub"), "y")
    bands = ft.band_frame(s, "y", AXIS, half_width=HALF, window=HALF)
    spectral = ft.spectral_frame(s, "y", AXIS, label="cls", sublabel="sub", levels=6)
    b, sp = added(bands, s), added(spectral, s)
    joined = bands.select("vec_id", F.array(*[c for c in b if c.startswith("auc_")]).alias("a")).join(spectral.select("vec_id", F.array(*sp).alias("z")), "vec_id")
    return joined.select(
        "vec_id",
        F.lit(len(b)).cast("long").alias("band_columns"),
        F.size("z").cast("long").alias("spectral_columns"),
        F.forall("a", lambda v: v.isNotNull() & ~F.isnan(v)).alias("finite_bands"),
    )


@query(
    "flagship_effect_ranking",
    sql(
        "L",
        """SELECT row_number() OVER (ORDER BY abs(round(d, 9)) DESC, feature) AS place, feature, round(d, 6) + 0.0 AS d FROM D ORDER BY place LIMIT 15""",
        "N AS (SELECT vec_id, avg(y) AS m, stddev_pop(y) AS s FROM L GROUP BY vec_id)",
        "Z AS (SELECT sample_id, cls, L.vec_id, pos, wn, (y - m) / (s + 1e-8) AS y FROM L JOIN N ON N.vec_id = L.vec_id)",
        BAND_SQL,
        BANDW,
        auc_cte("BA", "BW", "sample_id, cls, vec_id", "Z"),
        "FM AS (SELECT sample_id, cls, name, avg(auc) AS v FROM BA GROUP BY ALL)",
        """D AS (SELECT concat('auc_', name) AS feature, (avg(v) FILTER (cls = 0) - avg(v) FILTER (cls = 1)) / sqrt(((count(*) FILTER (cls = 0) - 1) * var_samp(v) FILTER (cls = 0)
          + (count(*) FILTER (cls = 1) - 1) * var_samp(v) FILTER (cls = 1)) / (count(*) FILTER (cls IN (0, 1)) - 2)) AS d FROM FM GROUP BY name)""",
    ),
)
def flagship(spark, sf):
    """Normalise, integrate bands, average per sample, compare two classes, keep the 15 largest effects."""
    from wavetable.operators import statistics as st
    from wavetable.operators.ranking import top_k

    s = series(spark, sf).where("cls in (0, 1)").select("sample_id", "cls", fs.snv("y").alias("y"))
    banded = ft.band_auc(s, "y", AXIS, half_width=HALF)
    cols = [c for c in banded.columns if c.startswith("auc_")]
    per_sample = rollup.mean_pool(banded, ["sample_id", "cls"], cols)
    effects = st.effect_sizes(per_sample, cols, "cls", {"0_vs_1": ([0], [1])})
    return top_k(effects, [F.abs(F.round("d", 9)).desc(), F.col("feature")], 15, "place").select("place", "feature", r("d").alias("d"))
