"""Contract gates (G1-G14) on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.operators import features as ft
from wavetable.operators import gates as gt
from wavetable.operators import quality as qc
from wavetable.operators import rollup as ru
from wavetable.operators.clean import clean, crop
from wavetable.operators.ranking import stratified_sample
from wavetable.plans.quality_queries import MASK_CTES, THRESHOLD, masked
from wavetable.plans.registry import query
from wavetable.plans.rollup_queries import COLS, WIDE, areas
from wavetable.plans.tables import AXIS, long, r, series, sql, table

OUT = ["gate", "severity", "passed", "detail"]


def gate_sql(gate: str, passed: str, detail: str, frm: str, severity: str = "ERROR") -> str:
    return f"SELECT '{gate}' AS gate, '{severity}' AS severity, {passed} AS passed, {detail} AS detail {frm}"


@query("g1_axis_declared", sql("L", gate_sql("axis_declared", "count(*) = 64 AND max(abs(wn - (76 + pos * 3423e0 / 63))) <= 0.01", "concat('points ', count(*))", "FROM (SELECT DISTINCT pos, wn FROM L)")))
def g1(spark, sf):
    return gt.axis_declared(long(series(spark, sf)).select("pos", "wn").distinct(), 76.0, 3499.0, 64)


CROPPED = [x for x in AXIS if catalog.in_regions(x)]


@query("g1_cropped_axis", sql("L", gate_sql("cropped_axis", "count(*) = 30 AND min(wn) >= 399 AND max(wn) <= 3051", "concat('points ', count(*))", "FROM (SELECT DISTINCT pos, wn FROM L WHERE wn BETWEEN 400 AND 1800 OR wn BETWEEN 2800 AND 3050)")))
def g1_cropped(spark, sf):
    axis = long(series(spark, sf)).select("pos", "wn").distinct().where("wn between 400 and 1800 or wn between 2800 and 3050")
    return gt.cropped_axis(axis, len(CROPPED), 400.0, 3050.0)


@query("g2_series_width", gate_sql("series_width", "count(*) FILTER (len(embedding) <> 64) = 0", "concat('bad rows ', count(*) FILTER (len(embedding) <> 64), ' of ', count(*))", "FROM embeddings"))
def g2(spark, sf):
    return gt.width(series(spark, sf), "y", 64)


@query("g2_clean_rows_match", gate_sql("rows_match", "true", "concat(count(*), ' rows and ', count(*))", "FROM embeddings"))
def g2_rows(spark, sf):
    s = series(spark, sf).select("vec_id", "y")
    return gt.rows_match(clean(s, AXIS, half_width=8)[0].where(F.size("y") == len(CROPPED)), s)


@query("g3_no_fatal_errors", gate_sql("no_fatal_errors", "sum(k) = 0", "concat(sum(k), ' errors in ', count(*), ' files')", "FROM (SELECT CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 95 THEN 1 ELSE 0 END AS k FROM events)"))
def g3(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    files = table(spark, sf, "events").select(F.when(k > 95, F.to_json(F.array(F.lit("bad")))).otherwise(F.lit("[]")).alias("errors"))
    return gt.no_fatal_errors(files, "errors")


@query(
    "g4_funnel_reconciles",
    sql("L", gate_sql("funnel_reconciles", "n - a - b + ab = k", "concat(n, ' - ', a, ' - ', b, ' + ', ab, ' = ', k)", f"FROM (SELECT count(*) AS n, count(*) FILTER (snr < {THRESHOLD}) AS a, count(*) FILTER (background) AS b, count(*) FILTER (background AND snr < {THRESHOLD}) AS ab, count(*) FILTER (keep) AS k FROM MK)"), *MASK_CTES),
)
def g4(spark, sf):
    m = masked(spark, sf)
    return gt.funnel_reconciles(qc.funnel(m, THRESHOLD), m)


@query("g5_mask_reproducible", gate_sql("mask_reproducible", "true", "'agreement 100.0 %'", ""))
def g5(spark, sf):
    from wavetable.session import shared_folder
    from wavetable.sources.sinks import write_parquet

    m = masked(spark, sf).select("vec_id", "keep")
    path = f"{shared_folder(spark)}/mask_{abs(hash(sf)) % 10**8}"
    write_parquet(m, path)
    return gt.reproducible(spark.read.parquet(path), m, "vec_id")


@query(
    "g6_retention_floor",
    sql("L", gate_sql("retention_floor", "sum(kept) / sum(n) >= 0.8", "concat('worst file ', arg_min(file_id, (ret, file_id)))", "FROM (SELECT file_id, count(*) AS n, count(*) FILTER (keep) AS kept, avg(CASE WHEN keep THEN 1e0 ELSE 0e0 END) AS ret FROM MK GROUP BY file_id)", "WARN"), *MASK_CTES),
)
def g6(spark, sf):
    return gt.retention_floor(qc.retention_by(masked(spark, sf), "file_id"), "file_id")


@query(
    "g7_feature_rows_and_nulls",
    sql("L", gate_sql("rows_match", "true", "concat(count(*), ' rows and ', count(*))", "FROM MK WHERE keep") + " UNION ALL " + gate_sql("null_rows", "true", "concat('null rows 0 of ', count(*))", "FROM MK WHERE keep"), *MASK_CTES),
)
def g7(spark, sf):
    kept = masked(spark, sf).where("keep")
    feats = ft.integrate(kept, "y", AXIS, {n: catalog.ROIS[n] for n in ("silent", "lps_chain")})
    return gt.report([gt.rows_match(feats, kept), gt.no_nulls(feats, ["auc_silent", "auc_lps_chain"])])


@query("g8_per_file_integrity", gate_sql("per_file_integrity", "true", "'unique true subset true full true'", ""))
def g8(spark, sf):
    a = areas(spark, sf)
    return gt.per_file_integrity(ru.mean_pool(a, ["file_id"], COLS), series(spark, sf).select("file_id").distinct(), "file_id")


@query("g8_per_file_integrity_fault", gate_sql("per_file_integrity", "false", "'unique true subset true full false'", ""))
def g8_fault(spark, sf):
    a = areas(spark, sf).where("file_id <> 4")
    return gt.per_file_integrity(ru.mean_pool(a, ["file_id"], COLS), series(spark, sf).select("file_id").distinct(), "file_id")


STORES = (
    gt.Store("features", ("vec_id",), ("cls",), 0.01, 8),
    gt.Store("index", ("file_id", "pixel_idx"), ("cls", "subclass")),
)


def contract(spark, sf):
    a, s = areas(spark, sf), series(spark, sf).select("vec_id", "file_id", "pixel_idx", "cls", "subclass")
    frames = {"features": a.drop("pixel_idx").withColumn("_x", F.lit(1)), "index": s}
    return gt.report([gt.store_gates(frames[st.name], st) for st in STORES])


N = "(SELECT count(*) FROM embeddings)"
CONTRACT_SQL = "CO(gate, severity, passed, detail) AS (" + " UNION ALL ".join(
    [
        gate_sql("features.key_unique", "true", "'repeated keys 0'", ""), gate_sql("features.not_null", "true", f"concat('null rows 0 of ', {N})", ""),
        gate_sql("features.null_rows", "true", f"concat('null rows 0 of ', {N})", "", "WARN"), gate_sql("features.columns", "false", f"concat('9 columns, ', {N}, ' rows')", ""),
        gate_sql("index.key_unique", "true", "'repeated keys 0'", ""), gate_sql("index.not_null", "true", f"concat('null rows 0 of ', {N})", ""),
        gate_sql("index.null_rows", "true", f"concat('null rows 0 of ', {N})", "", "WARN"),
    ]
) + ")"


@query("g9_contract_consistent", "WITH " + CONTRACT_SQL + " " + gate_sql("contract_consistent", "count(*) FILTER (severity = 'ERROR' AND NOT passed) = 0", "concat(count(*) FILTER (severity = 'ERROR' AND NOT passed), ' of ', count(*), ' gates failed')", "FROM CO"))
def g9(spark, sf):
    return gt.consistent(contract(spark, sf))


@query(
    "g10_profile",
    """SELECT 'file_id' AS "column", 'bigint' AS dtype, count(*) - count(vec_id) AS nulls, count(*) AS rows FROM embeddings UNION ALL SELECT 'value', 'double', count(*) - count(v), count(*) FROM (SELECT CASE WHEN embedding[1] > 0 THEN ln(embedding[1]) END AS v FROM embeddings)""",
)
def g10(spark, sf):
    y = F.col("y")[0]
    return gt.profile(series(spark, sf).select("file_id", F.when(y > 0, F.log(y)).otherwise(F.lit(float("nan"))).alias("value")))


@query("g11_contract_report", "WITH " + CONTRACT_SQL + " SELECT gate, severity, passed, detail FROM CO")
def g11(spark, sf):
    return contract(spark, sf)


@query("g11_contract_markdown", "WITH " + CONTRACT_SQL + " SELECT concat('| ', gate, ' | ', severity, ' | ', CASE WHEN passed THEN 'pass' ELSE 'FAIL' END, ' | ', detail, ' |') AS line FROM CO")
def g11_markdown(spark, sf):
    return gt.to_markdown(contract(spark, sf))


@query("g12_blocking", "SELECT true AS blocked, CAST(1 AS BIGINT) AS failed_errors FROM (SELECT count(*) FROM embeddings)")
def g12(spark, sf):
    rep = contract(spark, sf)
    try:
        gt.enforce(rep)
        blocked = False
    except gt.GateFailure:
        blocked = True
    return rep.agg(F.lit(blocked).alias("blocked"), F.count_if((F.col("severity") == "ERROR") & ~F.col("passed")).alias("failed_errors"))


@query(
    "g13_training_matrix",
    sql("L", "SELECT vec_id, cls, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in COLS) + ", round(m, 6) + 0.0 AS mean_y FROM WD JOIN (SELECT vec_id, avg(y) AS m FROM L GROUP BY vec_id) USING (vec_id)", *WIDE),
)
def g13(spark, sf):
    s = series(spark, sf)
    band = areas(spark, sf).select("vec_id", *[r(c).alias(c) for c in COLS])
    mean = s.select("vec_id", r(F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y")).alias("mean_y"))
    return gt.training_matrix(s.select("vec_id", "cls"), [band, mean], ["vec_id"])


@query("g13_file_table", sql("L", "SELECT file_id, n, round(a, 6) + 0.0 AS auc_silent FROM (SELECT file_id, count(*) AS n FROM S GROUP BY file_id) LEFT JOIN (SELECT file_id, avg(auc_silent) AS a FROM WD WHERE file_id <> 7 GROUP BY file_id) USING (file_id)", *WIDE))
def g13_files(spark, sf):
    meta = series(spark, sf).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    pooled = ru.mean_pool(areas(spark, sf).where("file_id <> 7"), ["file_id"], ["auc_silent"])
    return gt.file_table(meta, [pooled.select("file_id", r("auc_silent").alias("auc_silent"))], "file_id")


RANGE = "RG AS (SELECT o_orderkey AS file, 300 + (o_orderkey % 7) * 50 AS lo, 3100 - (o_orderkey % 11) * 20 AS hi FROM orders)"


@query(
    "g14_in_distribution",
    "WITH " + RANGE + " " + gate_sql("in_distribution", "count(*) FILTER (lo > 400 OR hi < 3050) = 0", "concat(count(*) FILTER (lo > 400 OR hi < 3050), ' of ', count(*), ' files not covered')", "FROM RG"),
)
def g14(spark, sf):
    k = F.col("o_orderkey")
    files = table(spark, sf, "orders").select((300 + (k % 7) * 50).cast("double").alias("lo"), (3100 - (k % 11) * 20).cast("double").alias("hi"))
    return gt.coverage_gate(files, "lo", "hi", {"fingerprint": (400.0, 1800.0), "ch": (2800.0, 3050.0)})
