"""Joins (J1-J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.operators import features as ft
from wavetable.operators import relate, rollup
from wavetable.operators.scale import checked_broadcast
from wavetable.operators.statistics import mcnemar
from wavetable.plans.feature_queries import CENTERS, HALF, auc_cte
from wavetable.plans.registry import query
from wavetable.plans.rollup_queries import COLS, WIDE, areas
from wavetable.plans.series_queries import BAND_SQL
from wavetable.plans.tables import AXIS, S_SQL, long, prediction, r, series, sql, table


@query(
    "j1_checked_inner_join",
    sql("P", "SELECT a.spectrum_id, a.file_id, round(a.p0, 6) AS p0_a, round(b.p0, 6) AS p0_b FROM P a JOIN P b USING (spectrum_id, file_id) WHERE a.model = 0 AND b.model = 1"),
)
def j1(spark, sf):
    p = prediction(spark, sf)
    side = lambda m, n: p.where(F.col("model") == m).select("spectrum_id", "file_id", F.round("p0", 6).alias(n))
    return relate.join_checked(side(0, "p0_a"), side(1, "p0_b"), ["spectrum_id", "file_id"])


@query(
    "j2_wide_over_models",
    sql("P", "SELECT fold_id, file_id, subclass, y_true, " + ", ".join(f"round(avg(p{k}) FILTER (model = {m}), 6) AS m{m}_p{k}" for m in range(3) for k in range(4)) + " FROM P GROUP BY fold_id, file_id, subclass, y_true"),
)
def j2(spark, sf):
    from wavetable.operators.combine import wide_over_models

    w = wide_over_models(prediction(spark, sf), ["fold_id", "file_id", "subclass", "y_true"], [0, 1, 2], 4)
    return w.select("fold_id", "file_id", "subclass", "y_true", *[F.round(f"m{m}_p{k}", 6).alias(f"m{m}_p{k}") for m in range(3) for k in range(4)])


@query(
    "j3_left_joins",
    """SELECT c_custkey, n_name, coalesce(n_orders, 0) AS n_orders, last_order FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def j3(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_order"))
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return (
        c.join(checked_broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "last_order")
    )


@query(
    "j4_keyed_concat",
    sql("L", "SELECT file_id, pixel_idx, cls, round(auc_silent, 6) + 0.0 AS auc_silent, round(m, 6) + 0.0 AS mean_y FROM WD JOIN (SELECT vec_id, pixel_idx, avg(y) AS m FROM L GROUP BY ALL) USING (vec_id)", *WIDE),
)
def j4(spark, sf):
    s = series(spark, sf)
    index = s.select("file_id", "pixel_idx", "cls")
    feats = ft.integrate(s, "y", AXIS, {"silent": catalog.ROIS["silent"]}).select("file_id", "pixel_idx", r("auc_silent").alias("auc_silent"))
    means = s.select("file_id", "pixel_idx", r(F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y")).alias("mean_y"))
    return index.join(feats, ["file_id", "pixel_idx"]).join(means, ["file_id", "pixel_idx"])


@query("j5_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j5(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("j6_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j6(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(
        table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"
    )


@query(
    "j7_series_by_template",
    sql("L", "SELECT a.vec_id, concat('t', t.k) AS template, round(sum(a.y * t.m), 6) + 0.0 AS product FROM L a JOIN (SELECT cls AS k, pos, avg(y) AS m FROM L GROUP BY ALL) t USING (pos) GROUP BY a.vec_id, t.k"),
)
def j7(spark, sf):
    import numpy as np

    from wavetable.functions.linear import linear_map

    s = series(spark, sf).select("vec_id", "cls", "y")
    t = ft.fit_templates(s, "y", "cls")
    m = np.stack(list(t.values()), axis=1)
    parts = s.withColumn("_p", linear_map("y", m)).select("vec_id", F.explode(F.array(*[F.struct(F.lit(f"t{k}").alias("template"), F.col("_p")[i].alias("v")) for i, k in enumerate(t)])).alias("e"))
    return parts.select("vec_id", "e.template", r("e.v").alias("product"))


@query("j8_positions_in_bands", sql("L", f"SELECT vec_id, name, count(*) AS n, round(max(y), 6) + 0.0 AS top FROM L JOIN BANDS ON wn BETWEEN center - {HALF} AND center + {HALF} GROUP BY vec_id, name", BAND_SQL))
def j8(spark, sf):
    from wavetable.functions.linear import window_mask
    import numpy as np

    s = series(spark, sf).select("vec_id", "y")
    parts = []
    for n, ctr in CENTERS.items():
        idx = np.flatnonzero(window_mask(AXIS, ctr - HALF, ctr + HALF))
        if len(idx):
            cut = F.slice("y", int(idx[0]) + 1, len(idx))  # a window on a sorted axis is one run
            parts.append(F.struct(F.lit(n).alias("name"), F.lit(len(idx)).cast("long").alias("n"), F.array_max(cut).alias("top")))
    return s.select("vec_id", F.explode(F.array(*parts)).alias("e")).select("vec_id", "e.name", "e.n", r("e.top").alias("top"))


CORRECT = "CR AS (SELECT model, file_id, any_value(y_true) AS y_true, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2, avg(p3) AS p3 FROM P GROUP BY model, file_id), OK AS (SELECT model, file_id, y_true, CASE WHEN p0 >= greatest(p1, p2, p3) THEN 0 WHEN p1 >= greatest(p2, p3) THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS pred FROM CR)"


@query(
    "j9_self_join_models",
    sql("P", "SELECT file_id, a.pred = a.y_true AS ok_a, b.pred = b.y_true AS ok_b FROM OK a JOIN OK b USING (file_id) WHERE a.model = 0 AND b.model = 1", CORRECT),
)
def j9(spark, sf):
    from wavetable.operators.evaluate import soft_vote

    v = soft_vote(prediction(spark, sf), ["model", "file_id"], 4).select("model", "file_id", (F.col("pred") == F.col("y_true")).alias("ok"))
    a = v.where("model = 0").select("file_id", F.col("ok").alias("ok_a"))
    return a.join(v.where("model = 1").select("file_id", F.col("ok").alias("ok_b")), "file_id")


@query("j10_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def j10(spark, sf):
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    look = n.join(g, n.n_regionkey == g.r_regionkey).select("n_nationkey", "n_name", "r_name")
    s = table(spark, sf, "supplier")
    return s.join(checked_broadcast(look), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


NEAREST = sql(
    "L",
    """SELECT T.vec_id, round(T.wn, 4) AS wn, arg_min(name, (abs(center - T.wn), name)) AS band, round(min(abs(center - T.wn)), 4) AS distance
    FROM (SELECT vec_id, arg_max(wn, y) AS wn FROM L GROUP BY vec_id) T LEFT JOIN BANDS ON abs(center - T.wn) <= 25 GROUP BY T.vec_id, T.wn""",
    BAND_SQL,
)


def _tops(spark, sf):
    return series(spark, sf).select("vec_id", (F.lit(76.0) + (F.array_position("y", F.array_max("y")) - 1) * F.lit(3423.0) / F.lit(63)).alias("wn"))


@query("j11_nearest_band", NEAREST)
def j11(spark, sf):
    n = relate.nearest_band(_tops(spark, sf), "wn", CENTERS, 25.0)
    return n.select("vec_id", F.round("wn", 4).alias("wn"), "band", F.round("distance", 4).alias("distance"))


@query("j11_nearest_band_by_cells", NEAREST)
def j11_cells(spark, sf):
    bands = spark.createDataFrame(list(CENTERS.items()), "name string, center double")
    n = relate.nearest_band_by_cells(_tops(spark, sf), "wn", bands, 25.0)
    return n.select("vec_id", F.round("wn", 4).alias("wn"), "band", F.round("distance", 4).alias("distance"))
