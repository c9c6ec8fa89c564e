"""Quality control (Q1-Q5).  The test series are unit vectors, so the threshold is lowered to 0.2."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.functions.linear import savgol, savgol_matrix
from wavetable.operators import quality as qc
from wavetable.plans.registry import query
from wavetable.plans.series_queries import weights_sql
from wavetable.plans.tables import AXIS, BINS, r, series, sql

THRESHOLD = 0.2

SNR = "SN AS (SELECT vec_id, file_id, cls, avg(y) FILTER (wn BETWEEN 900 AND 1700) / (stddev_pop(y) FILTER (wn BETWEEN 1800 AND 2500) + 1e-8) AS snr, sum(y) FILTER (wn BETWEEN 600 AND 1700) AS intensity, median(y) AS med FROM L GROUP BY ALL)"
MAD = "MD AS (SELECT vec_id, median(abs(y - med)) AS spread FROM L JOIN SN USING (vec_id) GROUP BY vec_id)"
LIM = "LM AS (SELECT file_id, quantile_cont(intensity, 0.1) AS dim, median(spread) AS flat, count(*) AS n FROM SN JOIN MD USING (vec_id) GROUP BY file_id)"
MASK = f"""MK AS (SELECT vec_id, file_id, cls, snr, intensity, spread, n >= 5 AND intensity <= dim AND spread < 2.0 * flat AS background,
  snr >= {THRESHOLD} AND NOT (n >= 5 AND intensity <= dim AND spread < 2.0 * flat) AS keep FROM SN JOIN MD USING (vec_id) JOIN LM USING (file_id))"""
MASK_CTES = (SNR, MAD, LIM, MASK)


def masked(spark, sf):
    return qc.with_keep(series(spark, sf), "file_id", "y", AXIS, snr_threshold=THRESHOLD)


@query("q1_snr", sql("L", "SELECT vec_id, round(snr, 6) + 0.0 AS snr FROM SN", SNR))
def q1(spark, sf):
    return qc.with_snr(series(spark, sf).select("vec_id", "y"), "y", AXIS).select("vec_id", r("snr").alias("snr"))


@query("q2_background_mask", sql("L", "SELECT vec_id, file_id, round(intensity, 6) + 0.0 AS intensity, round(spread, 6) + 0.0 AS spread, background FROM MK", *MASK_CTES))
def q2(spark, sf):
    d = qc.with_background(series(spark, sf).select("vec_id", "file_id", "y"), "file_id", "y", AXIS)
    return d.select("vec_id", "file_id", r("intensity").alias("intensity"), r("spread").alias("spread"), "background")


@query(
    "q3_keep_mask_per_file",
    sql("L", """SELECT file_id, count(*) AS n, count(*) FILTER (keep) AS kept, round(avg(CASE WHEN keep THEN 1.0 ELSE 0.0 END), 6) AS retention, count(*) FILTER (background) AS n_bg, round(median(snr), 6) + 0.0 AS median_snr
       FROM MK GROUP BY file_id""", *MASK_CTES),
)
def q3(spark, sf):
    return qc.per_file(masked(spark, sf), "file_id").withColumns({"retention": F.round("retention", 6), "median_snr": r("median_snr")})


@query(
    "q3_funnel",
    sql("L", f"""SELECT count(*) AS n_input, count(*) FILTER (keep) AS n_keep, count(*) FILTER (snr < {THRESHOLD}) AS n_drop_snr, count(*) FILTER (background) AS n_drop_bg,
       count(*) FILTER (background AND snr < {THRESHOLD}) AS n_drop_both FROM MK""", *MASK_CTES),
)
def q3_funnel(spark, sf):
    return qc.funnel(masked(spark, sf), THRESHOLD)


@query(
    "q4_snr_on_smoothed",
    sql(
        "L",
        "SELECT vec_id, round(avg(y) FILTER (wn BETWEEN 900 AND 1700) / (stddev_pop(y) FILTER (wn BETWEEN 1800 AND 2500) + 1e-8), 6) + 0.0 AS snr FROM SM GROUP BY vec_id",
        weights_sql("W", savgol_matrix(BINS, 9, 3)),
        "SM AS (SELECT vec_id, 76e0 + pos_out * 3423e0 / 63 AS wn, sum(w * y) AS y FROM L JOIN W ON W.pos_in = L.pos GROUP BY vec_id, pos_out)",
    ),
)
def q4(spark, sf):
    s = series(spark, sf).select("vec_id", savgol("y", window=9, polyorder=3).alias("y"))
    return qc.with_snr(s, "y", AXIS).select("vec_id", r("snr").alias("snr"))


@query("q5_retention_by_class", sql("L", "SELECT cls, count(*) AS n, count(*) FILTER (keep) AS kept, round(avg(CASE WHEN keep THEN 1.0 ELSE 0.0 END), 6) AS retention FROM MK GROUP BY cls", *MASK_CTES))
def q5(spark, sf):
    return qc.retention_by(masked(spark, sf), "cls").withColumn("retention", F.round("retention", 6))


@query("q5_worst_files", sql("L", "SELECT file_id, count(*) AS n, count(*) FILTER (keep) AS kept, round(avg(CASE WHEN keep THEN 1.0 ELSE 0.0 END), 6) AS retention FROM MK GROUP BY file_id ORDER BY avg(CASE WHEN keep THEN 1.0 ELSE 0.0 END), file_id LIMIT 8", *MASK_CTES))
def q5_worst(spark, sf):
    return qc.worst_files(qc.retention_by(masked(spark, sf), "file_id"), "file_id").withColumn("retention", F.round("retention", 6))
