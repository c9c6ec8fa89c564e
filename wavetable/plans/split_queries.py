"""Splits and leakage control (K1-K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.operators import splits as sp
from wavetable.operators.scale import with_totals
from wavetable.plans.quality_queries import MASK_CTES, masked
from wavetable.plans.registry import query
from wavetable.plans.tables import series, sql

FILES = "FF AS (SELECT DISTINCT sample_id, cls, subclass FROM S)"
DEAL = """DL AS (SELECT sample_id, cls, subclass, (row_number() OVER (PARTITION BY cls ORDER BY md5(concat('42|', sample_id)), sample_id) - 1
  + (SELECT count(*) FROM FF f WHERE f.cls < FF.cls)) % 5 AS test_fold FROM FF)"""
ROLES = "RO AS (SELECT k.k AS fold, sample_id, cls, CASE WHEN k.k = test_fold THEN 'test' ELSE 'train' END AS role FROM DL, range(5) k(k))"
LOSO = "LO AS (SELECT s.subclass AS fold, f.sample_id, f.cls, CASE WHEN f.subclass = s.subclass THEN 'test' ELSE 'train' END AS role FROM FF f, (SELECT DISTINCT subclass FROM FF WHERE cls <> 0) s)"
KEEP = "KP AS (SELECT S.vec_id, S.sample_id, MK.keep FROM S JOIN MK USING (vec_id))"


def files(spark, sf):
    return sp.file_frame(series(spark, sf), "sample_id", "cls", "subclass")


def kfold(spark, sf):
    return sp.kfold_roles(sp.stratified_folds(files(spark, sf), "sample_id", "cls", 5), "sample_id", 5)


def loso(spark, sf):
    return sp.leave_one_subclass_out(files(spark, sf), "sample_id", "cls", "subclass", always_train=[0])


@query("k1_stratified_group_folds", sql("S", "SELECT fold, sample_id, role FROM RO", FILES, DEAL, ROLES))
def k1(spark, sf):
    return kfold(spark, sf).select("fold", "sample_id", "role")


@query("k2_leave_one_subclass_out", sql("S", "SELECT fold, sample_id, role FROM LO", FILES, LOSO))
def k2(spark, sf):
    return loso(spark, sf).select("fold", "sample_id", "role")


@query("k3_resolve_rows", sql("L", "SELECT fold, vec_id, role FROM RO JOIN KP USING (sample_id) WHERE keep", FILES, DEAL, ROLES, *MASK_CTES, KEEP))
def k3(spark, sf):
    return sp.fold_rows(kfold(spark, sf), masked(spark, sf).select("vec_id", "sample_id", "keep"), "sample_id").select("fold", "vec_id", "role")


@query(
    "k4_fold_report",
    sql("S", "SELECT fold, count(*) FILTER (role = 'test') AS n_test_files, count(*) FILTER (role = 'train') AS n_train_files, " + ", ".join(f"count(*) FILTER (role = 'test' AND cls = {k}) AS test_{k}" for k in range(4)) + " FROM RO GROUP BY fold", FILES, DEAL, ROLES),
)
def k4(spark, sf):
    return sp.fold_report(kfold(spark, sf), files(spark, sf), "sample_id", "cls", [0, 1, 2, 3])


@query(
    "k4_date_overlap",
    sql("S", "SELECT fold, concat('2603', lpad(CAST(sample_id % 7 AS VARCHAR), 2, '0')) AS date, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'train') AS n_train FROM LO GROUP BY ALL HAVING count(*) FILTER (role = 'test') > 0 AND count(*) FILTER (role = 'train') > 0", FILES, LOSO),
)
def k4_dates(spark, sf):
    dates = files(spark, sf).select("sample_id", F.concat(F.lit("2603"), F.lpad((F.col("sample_id") % 7).cast("string"), 2, "0")).alias("date"))
    return sp.date_overlap(loso(spark, sf), dates, "sample_id", "date")


@query("k5_leakage", sql("S", "SELECT fold, 0 AS shared_rows, 0 AS shared_files, 0 AS unknown_rows, 0 AS rejected_rows FROM (SELECT DISTINCT fold FROM LO)".replace("0 AS", "CAST(0 AS BIGINT) AS"), FILES, LOSO))
def k5(spark, sf):
    rows = masked(spark, sf).select("vec_id", "sample_id", "keep")
    return sp.leakage(sp.fold_rows(loso(spark, sf), rows, "sample_id"), rows, "vec_id", "sample_id")


@query("k6_fold_seeds", sql("S", "SELECT CAST(k AS BIGINT) AS fold, (42 * 31337 + k) % 2147483648 AS fold_seed, (SELECT count(*) FROM S) AS n_rows FROM range(5) t(k)"))
def k6(spark, sf):
    n = sp.fingerprint(series(spark, sf), "vec_id", ["cls", "subclass"]).select("n_rows")
    seeds = kfold(spark, sf).select("fold").distinct().select("fold", sp.fold_seed(F.col("fold")).alias("fold_seed"))
    return with_totals(seeds, n)


@query("k6_fingerprint")
def k6_fingerprint(spark, sf):
    return sp.fingerprint(masked(spark, sf), "vec_id", ["cls", "subclass", "keep"])


@query(
    "k7_within_group_split",
    sql("S", "SELECT vec_id, file_id, CASE WHEN row_number() OVER (PARTITION BY file_id ORDER BY md5(concat('42|', vec_id)), vec_id) <= greatest(1, floor(0.2 * count(*) OVER (PARTITION BY file_id))) THEN 'test' ELSE 'train' END AS role FROM S"),
)
def k7(spark, sf):
    return sp.within_group_split(series(spark, sf).select("vec_id", "file_id"), "file_id", "vec_id")


@query(
    "k8_inner_validation",
    sql(
        "S",
        "SELECT sample_id, CASE WHEN (row_number() OVER (PARTITION BY cls ORDER BY md5(concat('7|', sample_id)), sample_id) - 1 + (SELECT count(*) FROM TR t WHERE t.cls < TR.cls)) % 4 = 0 THEN 'validation' ELSE 'train' END AS role FROM TR",
        FILES, DEAL, "TR AS (SELECT sample_id, cls FROM DL WHERE test_fold <> 0)",
    ),
)
def k8(spark, sf):
    train = sp.stratified_folds(files(spark, sf), "sample_id", "cls", 5).where("test_fold <> 0").drop("test_fold")
    inner = sp.stratified_folds(train, "sample_id", "cls", 4, seed=7)
    return inner.select("sample_id", F.when(F.col("test_fold") == 0, "validation").otherwise("train").alias("role"))
