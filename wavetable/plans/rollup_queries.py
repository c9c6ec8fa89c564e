"""Aggregations (A1-A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.operators import features as ft
from wavetable.operators import rollup as ru
from wavetable.operators.scale import exact_percentiles
from wavetable.plans.feature_queries import auc_cte, windows_sql
from wavetable.plans.quality_queries import MASK_CTES, masked
from wavetable.plans.registry import query
from wavetable.plans.tables import AXIS, long, r, series, sql, table

REG = ["fingerprint_low", "lps_chain", "silent"]
WIN = {n: catalog.ROIS[n] for n in REG}
COLS = [f"auc_{n}" for n in REG]
WIDE = (
    windows_sql("R", WIN),
    auc_cte("RA", "R", "vec_id, file_id, sample_id, subclass, cls"),
    "WD AS (SELECT vec_id, file_id, sample_id, subclass, cls, " + ", ".join(f"max(auc) FILTER (name = '{n}') AS auc_{n}" for n in REG) + " FROM RA GROUP BY ALL)",
    "LW AS (" + " UNION ALL ".join(f"SELECT vec_id, file_id, sample_id, subclass, cls, 'auc_{n}' AS feature, auc_{n} AS value FROM WD" for n in REG) + ")",
)


def areas(spark, sf):
    """Region areas per series, with all keys."""
    s = series(spark, sf)
    return ft.integrate(s, "y", AXIS, WIN).drop("y")


@query("a1_mean_pool", sql("L", "SELECT file_id, " + ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in COLS) + " FROM WD GROUP BY file_id", *WIDE))
def a1(spark, sf):
    return ru.mean_pool(areas(spark, sf), ["file_id"], COLS).select("file_id", *[r(c).alias(c) for c in COLS])


@query("a2_group_constant", sql("S", "SELECT sample_id, any_value(subclass) AS subclass FROM S GROUP BY sample_id"))
def a2(spark, sf):
    return ru.group_constant(series(spark, sf), ["sample_id"], "subclass")


def _mean_sql(key: str) -> str:
    return sql("L", f"SELECT {key}, pos, round(avg(y), 6) + 0.0 AS y FROM L GROUP BY {key}, pos")


def _points(df, key):
    return df.select(key, F.posexplode_outer("y").alias("pos", "v")).select(key, F.col("pos").cast("long").alias("pos"), r("v").alias("y"))


@query("a3_mean_series_per_file", _mean_sql("file_id"))
def a3_file(spark, sf):
    return _points(ru.mean_series(series(spark, sf), ["file_id"]), "file_id")


@query("a3_mean_series_per_subclass", _mean_sql("subclass"))
def a3_sub(spark, sf):
    return _points(ru.mean_series(series(spark, sf), ["subclass"]), "subclass")


@query(
    "a3_mean_series_kept_rows",
    sql("L", "SELECT L.file_id, pos, round(coalesce(avg(y) FILTER (keep AND L.file_id <> 3), avg(y)), 6) + 0.0 AS y FROM L JOIN MK USING (vec_id) GROUP BY L.file_id, pos", *MASK_CTES),
)
def a3_kept(spark, sf):
    m = masked(spark, sf).withColumn("keep", F.col("keep") & (F.col("file_id") != 3))
    return _points(ru.mean_series_kept(m, ["file_id"], "keep"), "file_id")


@query(
    "a4_envelope",
    sql("L", """SELECT cls, pos, round(avg(y), 6) + 0.0 AS mean, round(stddev_pop(y), 6) AS std, round(quantile_cont(y, 0.05), 6) + 0.0 AS p_lo, round(quantile_cont(y, 0.95), 6) + 0.0 AS p_hi FROM L GROUP BY cls, pos"""),
)
def a4(spark, sf):
    e = ru.envelope(series(spark, sf), ["cls"])
    return e.select("cls", F.col("pos").cast("long").alias("pos"), *[r(c).alias(c) for c in ("mean", "std", "p_lo", "p_hi")])


@query("a5_feature_stats", sql("L", "SELECT feature, cls, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) AS sd, count(value) AS n FROM LW GROUP BY ALL", *WIDE))
def a5(spark, sf):
    return ru.feature_stats(areas(spark, sf), COLS, "cls").select("feature", "cls", r("mean").alias("mean"), r("sd").alias("sd"), "n")


@query("a6_value_counts", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def a6(spark, sf):
    return ru.value_counts(table(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 6))


@query(
    "a6_value_counts_within",
    "SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)",
)
def a6_within(spark, sf):
    return ru.value_counts(table(spark, sf, "events"), "event_type", ["user_id"]).withColumn("share", F.round("share", 6))


@query(
    "a7_distinct_counts",
    "SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(DISTINCT value) AS n_values FROM events GROUP BY event_type",
)
def a7(spark, sf):
    e = table(spark, sf, "events")
    # one two-step count per column: each distinct pair is counted once, so no task holds a group's values
    out = None
    for name, col in (("n_users", F.col("user_id")), ("n_days", F.to_date("ts")), ("n_values", F.col("value"))):
        one = e.select("event_type", col.alias("_v")).where("_v is not null").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one, "event_type")
    return out


@query(
    "a8_standardised_means",
    sql("L", "SELECT cls, " + ", ".join(f"round((avg({c}) - (SELECT avg({c}) FROM WD)) / (SELECT stddev_pop({c}) FROM WD), 6) + 0.0 AS {c}" for c in COLS) + " FROM WD GROUP BY cls", *WIDE),
)
def a8(spark, sf):
    return ru.standardised_means(areas(spark, sf), COLS, ["cls"]).select("cls", *[r(c).alias(c) for c in COLS])


@query(
    "a9_pivot",
    sql("L", "SELECT file_id, " + ", ".join(f"round(avg(auc_silent) FILTER (cls = {k}), 6) + 0.0 AS c{k}" for k in range(4)) + " FROM WD GROUP BY file_id", *WIDE),
)
def a9(spark, sf):
    p = areas(spark, sf).groupBy("file_id").pivot("cls", [0, 1, 2, 3]).agg(F.avg("auc_silent"))
    return p.select("file_id", *[r(F.col(str(k))).alias(f"c{k}") for k in range(4)])


@query("a10_custom_aggregate_p90", "SELECT user_id, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY user_id")
def a10(spark, sf):
    e = table(spark, sf, "events")
    g = e.groupBy("user_id").agg(r(F.avg("value")).alias("mean"), r(F.max("value")).alias("max"))
    return g.join(exact_percentiles(e, ["user_id"], "value", {"p90": 0.9}).withColumn("p90", r("p90")), "user_id")


@query("a11_percentile_floor", "SELECT event_type, round(quantile_cont(value, 0.02), 6) AS floor, round(median(value), 6) AS median FROM events GROUP BY event_type")
def a11(spark, sf):
    q = exact_percentiles(table(spark, sf, "events"), ["event_type"], "value", {"floor": 0.02, "median": 0.5})
    return q.select("event_type", r("floor").alias("floor"), r("median").alias("median"))


@query(
    "a12_class_roll_in",
    sql("L", """SELECT CASE WHEN cls IN (1, 2) THEN 'both' ELSE concat('c', cls) END AS grp, CASE WHEN grouping(cls) = 1 THEN -1 ELSE cls END AS cls, round(avg(auc_silent), 6) + 0.0 AS mean, count(*) AS n
       FROM WD GROUP BY GROUPING SETS ((CASE WHEN cls IN (1, 2) THEN 'both' ELSE concat('c', cls) END, cls), (CASE WHEN cls IN (1, 2) THEN 'both' ELSE concat('c', cls) END))""", *WIDE),
)
def a12(spark, sf):
    a = areas(spark, sf).withColumn("grp", F.when(F.col("cls").isin(1, 2), "both").otherwise(F.concat(F.lit("c"), F.col("cls").cast("string"))))
    g = a.groupingSets([["grp", "cls"], ["grp"]], "grp", "cls").agg(F.grouping("cls").alias("_g"), r(F.avg("auc_silent")).alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select("grp", F.when(F.col("_g") == 1, F.lit(-1).cast("long")).otherwise(F.col("cls")).alias("cls"), "mean", "n")


@query(
    "a13_two_level_mean",
    sql("L", "SELECT cls, round(avg(m), 6) + 0.0 AS by_group, round(sum(s) / sum(n), 6) + 0.0 AS by_row FROM (SELECT cls, sample_id, avg(auc_silent) AS m, sum(auc_silent) AS s, count(*) AS n FROM WD GROUP BY ALL) GROUP BY cls", *WIDE),
)
def a13(spark, sf):
    return ru.two_level_mean(areas(spark, sf), ["cls", "sample_id"], ["cls"], "auc_silent").select("cls", r("by_group").alias("by_group"), r("by_row").alias("by_row"))


@query(
    "a14_box_stats",
    """WITH Q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, round(min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_lo,
    round(max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_hi, count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS n_out
    FROM orders JOIN Q USING (o_orderpriority) GROUP BY o_orderpriority, q1, med, q3""",
)
def a14(spark, sf):
    b = ru.box_stats(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return b.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("q1", "med", "q3", "whisker_lo", "whisker_hi")], "n_out")


@query(
    "a15_histogram",
    "SELECT o_orderpriority, CAST(least(floor(o_totalprice / (600000e0 / 15)), 14) AS BIGINT) AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 600000 GROUP BY ALL",
)
def a15(spark, sf):
    return ru.histogram(table(spark, sf, "orders"), "o_totalprice", 0.0, 600_000.0, 15, ["o_orderpriority"])


@query(
    "a15_peak_position_histogram",
    sql("L", "SELECT cls, CAST(least(floor((wn - 0) / (3500e0 / 35)), 34) AS BIGINT) AS bin, count(*) AS n FROM (SELECT vec_id, cls, arg_max(wn, y) AS wn FROM L GROUP BY ALL) GROUP BY ALL"),
)
def a15_peaks(spark, sf):
    top = series(spark, sf).select("cls", (F.lit(76.0) + (F.array_position("y", F.array_max("y")) - 1) * F.lit(3423.0) / F.lit(63)).alias("wn"))
    return ru.histogram(top, "wn", 0.0, 3500.0, 35, ["cls"])


def _docs(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "lang", F.when(F.col("source") != "src0", F.col("source")).alias("source"), "n_chars",
        F.when(F.col("n_chars") > 300, 0.75).otherwise(0.5).alias("pass_rate"),
    )


@query(
    "a16_breakdown",
    """SELECT row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, lang, source) AS place, lang, source, n_files, est_kept FROM (
      SELECT lang, coalesce(nullif(source, 'src0'), 'none') AS source, count(*) AS n_files, round(sum(n_chars * CASE WHEN n_chars > 300 THEN 0.75e0 ELSE 0.5e0 END), 4) AS est_kept FROM documents GROUP BY ALL)""",
)
def a16(spark, sf):
    b = ru.breakdown(_docs(spark, sf), "lang", "source", "n_chars", "pass_rate", ["en", "fr", "de"], "none")
    return b.select("place", "lang", "source", "n_files", F.round("est_kept", 4).alias("est_kept"))


@query(
    "a16_breakdown_members",
    "SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS member FROM (SELECT doc_id, lang, coalesce(nullif(source, 'src0'), 'none') AS source FROM documents)",
)
def a16_members(spark, sf):
    return ru.breakdown_members(_docs(spark, sf), "lang", "source", "doc_id", "none", 256)
