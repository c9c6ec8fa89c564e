"""Window, ranking, sort and top-k (W1-W13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.functions import series as fs
from wavetable.operators import ranking as rk
from wavetable.operators import rollup as ru
from wavetable.operators import statistics as st
from wavetable.operators.scale import with_totals
from wavetable.plans.registry import query
from wavetable.plans.rollup_queries import COLS, WIDE, areas
from wavetable.plans.tables import AXIS, P_SQL, long, prediction, r, series, sql, table

ANOVA_POS = """FP AS (SELECT pos, any_value(wn) AS wn, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f
  FROM (SELECT pos, any_value(wn) AS wn, cls, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM L GROUP BY pos, cls) GROUP BY pos)"""
TOP = "TP AS (SELECT row_number() OVER (ORDER BY round(f, 9) DESC, pos) AS place, pos, wn, f FROM FP ORDER BY place LIMIT 30)"


def positions_by_f(spark, sf):
    f = st.anova(long(series(spark, sf).select("cls", "y")).withColumnRenamed("y", "value"), ["pos", "wn"], "cls")
    return rk.top_k(f, [F.round("f", 9).desc(), F.col("pos")], 30)


@query("w1_top_positions", sql("L", "SELECT place, CAST(pos AS BIGINT) AS pos, round(wn, 1) AS wn, round(f, 5) AS f FROM TP", ANOVA_POS, TOP))
def w1(spark, sf):
    return positions_by_f(spark, sf).select("place", F.col("pos").cast("long").alias("pos"), F.round("wn", 1).alias("wn"), F.round("f", 5).alias("f"))


@query(
    "w1_region_hits",
    sql("L", """SELECT count(*) FILTER (wn BETWEEN 1100 AND 1750) AS fingerprint, count(*) FILTER (wn BETWEEN 2800 AND 3000) AS ch, count(*) FILTER (wn BETWEEN 800 AND 1200) AS lps,
       coalesce(bool_or(abs(wn - 1338) <= 15), false) AS near_1338, coalesce(bool_or(abs(wn - 1454) <= 15), false) AS near_1454, coalesce(bool_or(abs(wn - 1658) <= 15), false) AS near_1658 FROM TP""", ANOVA_POS, TOP),
)
def w1_hits(spark, sf):
    w = F.col("wn")
    near = lambda c: F.coalesce(F.bool_or(F.abs(w - c) <= 15), F.lit(False)).alias(f"near_{c}")
    return positions_by_f(spark, sf).agg(
        F.count_if(w.between(1100, 1750)).alias("fingerprint"), F.count_if(w.between(2800, 3000)).alias("ch"),
        F.count_if(w.between(800, 1200)).alias("lps"), near(1338), near(1454), near(1658),
    )


@query(
    "w2_top_effects_per_contrast",
    sql("L", """SELECT contrast, place, pos, round(d, 6) + 0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY abs(round(d, 9)) DESC, pos) AS place FROM (
      SELECT 'c' || k.k || '_vs_rest' AS contrast, pos, (avg(y) FILTER (cls = k.k) - avg(y) FILTER (cls <> k.k)) / sqrt(((count(*) FILTER (cls = k.k) - 1) * var_samp(y) FILTER (cls = k.k)
       + (count(*) FILTER (cls <> k.k) - 1) * var_samp(y) FILTER (cls <> k.k)) / (count(*) - 2)) AS d FROM L, range(4) k(k) GROUP BY ALL)) WHERE place <= 10"""),
)
def w2(spark, sf):
    contrasts = {f"c{k}_vs_rest": ([k], [j for j in range(4) if j != k]) for k in range(4)}
    s = st.sides(series(spark, sf).select("cls", "y"), "cls", contrasts)
    m = st.two_group_moments(s.select("contrast", "side", F.posexplode_outer("y").alias("pos", "value")), ["contrast", "pos"])
    from wavetable.functions.stats import cohens_d

    d = m.select("contrast", F.col("pos").cast("long").alias("pos"), cohens_d(*st.moment_args()).alias("d"))
    top = rk.top_k_per(d, ["contrast"], [F.abs(F.round("d", 9)).desc(), F.col("pos")], 10)
    return top.select("contrast", "place", "pos", r("d").alias("d"))


# Prominence in SQL: for each local maximum the nearest higher point on each side bounds its base.
@query(
    "w3_top_peaks",
    sql(
        "L",
        """SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY prom DESC, pos) AS place, CAST(pos AS BIGINT) AS pos, round(wn, 1) AS wn, round(y, 6) + 0.0 AS y, round(prom, 6) AS prominence
        FROM PR WHERE prom >= 0.005 QUALIFY row_number() OVER (PARTITION BY cls ORDER BY prom DESC, pos) <= 10""",
        "ME AS (SELECT cls, pos, any_value(wn) AS wn, avg(y) AS y FROM L GROUP BY cls, pos)",
        "PM AS (SELECT *, lag(y) OVER w AS yl, lead(y) OVER w AS yr FROM ME WINDOW w AS (PARTITION BY cls ORDER BY pos))",
        "PK AS (SELECT * FROM PM WHERE y > yl AND y > yr)",
        """BS AS (SELECT p.cls, p.pos, p.wn, p.y, coalesce(max(m.pos) FILTER (m.pos < p.pos AND m.y > p.y), -1) AS lb, coalesce(min(m.pos) FILTER (m.pos > p.pos AND m.y > p.y), 64) AS rb
          FROM PK p JOIN ME m ON m.cls = p.cls GROUP BY p.cls, p.pos, p.wn, p.y)""",
        """PR AS (SELECT b.cls, b.pos, b.wn, b.y, b.y - greatest(min(m.y) FILTER (m.pos > lb AND m.pos <= b.pos), min(m.y) FILTER (m.pos >= b.pos AND m.pos < rb)) AS prom
          FROM BS b JOIN ME m ON m.cls = b.cls GROUP BY b.cls, b.pos, b.wn, b.y)""",
    ),
)
def w3(spark, sf):
    m = long(series(spark, sf).select("cls", "y")).groupBy("cls", "pos", "wn").agg(F.avg("y").alias("y"))
    p = rk.local_peaks(m, ["cls"], min_prominence=0.005, min_distance=1, n=10)
    return p.select("cls", "place", "pos", F.round("wn", 1).alias("wn"), r("y").alias("y"), F.round("prominence", 6).alias("prominence"))


PR = ["p0", "p1", "p2", "p3"]
TOP2 = """T2 AS (SELECT *, list_sort([{'p': p0, 'k': 0}, {'p': p1, 'k': -1}, {'p': p2, 'k': -2}, {'p': p3, 'k': -3}], 'DESC') AS v FROM P)"""


@query(
    "w4_top_two_classes",
    sql("P", "SELECT model, spectrum_id, CAST(-v[1].k AS BIGINT) AS pred, round(v[1].p, 6) AS top_p, CAST(-v[2].k AS BIGINT) AS second, round(v[2].p, 6) AS second_p FROM T2", TOP2),
)
def w4(spark, sf):
    t = rk.top_two(prediction(spark, sf), PR)
    return t.select("model", "spectrum_id", "pred", F.round("top_p", 6).alias("top_p"), "second", F.round("second_p", 6).alias("second_p"))


@query("w5_margin", sql("P", "SELECT model, spectrum_id, round(v[1].p - v[2].p, 6) + 0.0 AS margin, round(v[1].p, 6) AS max_proba FROM T2", TOP2))
def w5(spark, sf):
    return rk.top_two(prediction(spark, sf), PR).select("model", "spectrum_id", r("margin").alias("margin"), F.round("top_p", 6).alias("max_proba"))


MEANS = "ME AS (SELECT subclass, pos, avg(y) AS y FROM L GROUP BY subclass, pos)"


@query(
    "w6_waterfall_offset",
    sql("L", """SELECT subclass, pos, round((y - lo) / (hi - lo) + st * 1.1, 6) + 0.0 AS y FROM ME JOIN (SELECT subclass, min(y) AS lo, max(y) AS hi, row_number() OVER (ORDER BY subclass) - 1 AS st FROM ME GROUP BY subclass) USING (subclass)""", MEANS),
)
def w6(spark, sf):
    m = ru.mean_series(series(spark, sf), ["subclass"]).select("subclass", fs.min_max("y").alias("y"))
    return _points(rk.waterfall(m, "subclass", "y", 1.1), "subclass")


def _points(df, key):
    return df.select(key, F.posexplode_outer("y").alias("pos", "v")).select(key, F.col("pos").cast("long").alias("pos"), r("v").alias("y"))


@query(
    "w7_diff_to_reference",
    sql("L", "SELECT L.vec_id, L.pos, round(L.y - m.y, 6) + 0.0 AS y FROM L JOIN (SELECT pos, avg(y) AS y FROM L WHERE subclass = 0 GROUP BY pos) m USING (pos) WHERE L.pos < 60"),
)
def w7(spark, sf):
    s = series(spark, sf)
    ref = ru.mean_series(s.where("subclass = 0"), ["subclass"]).select(F.slice("y", 1, 60).alias("ref"))
    return _points(with_totals(s.select("vec_id", "y"), ref).select("vec_id", fs.subtract_series("y", "ref").alias("y")), "vec_id")


@query(
    "w8_heatmap_order",
    sql("L", "SELECT file_id, vec_id, row_number() OVER (PARTITION BY file_id ORDER BY round(t, 9) DESC, vec_id) AS place FROM (SELECT file_id, vec_id, sum(y) AS t FROM L GROUP BY ALL)"),
)
def w8(spark, sf):
    s = series(spark, sf).select("file_id", "vec_id", fs.total("y").alias("t"))
    return rk.intensity_order(s, "file_id", "vec_id", F.round("t", 9)).select("file_id", "vec_id", "place")


@query("w9_intensity_map", sql("L", "SELECT file_id, pixel_idx % 5 AS x, pixel_idx // 5 AS y, round(sum(y), 6) + 0.0 AS intensity FROM L GROUP BY file_id, pixel_idx"))
def w9(spark, sf):
    s = series(spark, sf)
    return s.select("file_id", (F.col("pixel_idx") % 5).alias("x"), F.floor(F.col("pixel_idx") / 5).alias("y"), r(fs.total(s["y"])).alias("intensity"))


@query(
    "w10_consensus_features",
    sql("L", """SELECT row_number() OVER (ORDER BY n DESC, pos) AS place, CAST(pos AS BIGINT) AS pos, n FROM (SELECT pos, count(*) AS n FROM (
      SELECT fold, pos FROM (SELECT k.k AS fold, pos, (avg(y) FILTER (cls = 0) - avg(y) FILTER (cls = 1)) AS d FROM L, range(5) k(k) WHERE L.vec_id % 5 <> k.k GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY fold ORDER BY abs(round(d, 9)) DESC, pos) <= 10) GROUP BY pos) ORDER BY place LIMIT 10"""),
)
def w10(spark, sf):
    s = series(spark, sf).where("cls in (0, 1)").select("vec_id", "cls", "y")
    folds = s.withColumn("fold", F.explode(F.array_except(F.array(*[F.lit(k).cast("long") for k in range(5)]), F.array(F.col("vec_id") % 5))))
    m = folds.select("fold", "cls", F.posexplode_outer("y").alias("pos", "v")).groupBy("fold", "pos").agg(
        (F.avg(F.when(F.col("cls") == 0, F.col("v"))) - F.avg(F.when(F.col("cls") == 1, F.col("v")))).alias("d")
    )
    chosen = rk.top_k_per(m, ["fold"], [F.abs(F.round("d", 9)).desc(), F.col("pos")], 10)
    return rk.consensus(chosen, "pos", 10).select("place", F.col("pos").cast("long").alias("pos"), "n")


@query(
    "w11_stratified_sample",
    sql("S", "SELECT cls, vec_id, draw FROM (SELECT cls, vec_id, row_number() OVER (PARTITION BY cls ORDER BY md5(concat('7|', vec_id)), vec_id) AS draw FROM S) WHERE draw <= 50"),
)
def w11(spark, sf):
    return rk.stratified_sample(series(spark, sf).select("cls", "vec_id"), ["cls"], "vec_id", 50, seed=7)


@query(
    "w12_quantile_bins",
    """WITH E AS (SELECT event_type, """
    + ", ".join(f"quantile_cont(value, {i / 10}) AS e{i}" for i in range(11))
    + """ FROM events GROUP BY event_type)
    SELECT event_type, bin, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, CAST(least(9, """
    + " + ".join(f"CASE WHEN value >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10))
    + """) AS BIGINT) AS bin FROM events JOIN E USING (event_type)) GROUP BY ALL""",
)
def w12(spark, sf):
    b = rk.quantile_bins(table(spark, sf, "events").select("event_type", "value"), "value", 10, ["event_type"])
    return b.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "w13_dense_index",
    "SELECT event_id, CASE WHEN value > 5 THEN sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT - 1 ELSE -1 END AS new_index FROM events",
)
def w13(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rk.dense_index(e, "event_id", F.col("value") > 5, chunk=1024).select("event_id", "new_index")
