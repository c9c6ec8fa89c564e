"""Set operations (U1-U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.operators import sets
from wavetable.plans.registry import query
from wavetable.plans.tables import prediction, series, sql, table


@query("u1_union_folds", sql("P", "SELECT model, spectrum_id, round(p0, 6) AS p0 FROM P"))
def u1(spark, sf):
    p = prediction(spark, sf)
    return sets.union_all([p.where(F.col("fold_id") == k) for k in range(10)]).select("model", "spectrum_id", F.round("p0", 6).alias("p0"))


@query(
    "u2_common_keys",
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
)
def u2(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return sets.common([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), c], ["o_custkey"])


@query("u3_all_minus_test", sql("S", "SELECT vec_id, subclass FROM S WHERE sample_id NOT IN (SELECT sample_id FROM S WHERE vec_id % 5 = 2)"))
def u3(spark, sf):
    s = series(spark, sf).select("vec_id", "subclass", "sample_id")
    return sets.remainder(s, s.where("vec_id % 5 = 2"), "sample_id").select("vec_id", "subclass")


@query(
    "u4_set_checks",
    """SELECT (SELECT count(*) = count(DISTINCT o_custkey) FROM orders) AS left_unique, NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AS left_in_right,
    NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AND NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) AS same_set""",
)
def u4(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return sets.set_checks(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")
