"""Views on the test tables in the roles the operators expect, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 64
AXIS = [76.0 + p * 3423.0 / (BINS - 1) for p in range(BINS)]
CLASSES = ["0", "1", "2", "3"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed series: file of mixed classes (file_id), file of one class (sample_id), class, subclass."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.pmod("vec_id", F.lit(25)).alias("file_id"),
        F.floor(F.col("vec_id") / 25).alias("pixel_idx"),
        (F.col("label") * 5 + F.pmod("vec_id", F.lit(5))).cast("long").alias("sample_id"),
        F.col("label").cast("long").alias("subclass"),
        F.pmod("label", F.lit(4)).cast("long").alias("cls"),
        F.col("embedding").cast("array<double>").alias("y"),
    )


S_SQL = """S AS (SELECT vec_id, vec_id % 25 AS file_id, vec_id // 25 AS pixel_idx,
  CAST(label * 5 + vec_id % 5 AS BIGINT) AS sample_id, CAST(label AS BIGINT) AS subclass,
  CAST(label % 4 AS BIGINT) AS cls, embedding FROM embeddings)"""
L_SQL = (
    S_SQL
    + """,
L AS (SELECT S.* EXCLUDE (embedding), p.pos AS pos, 76e0 + p.pos * 3423e0 / 63 AS wn,
  CAST(embedding[p.pos + 1] AS DOUBLE) AS y FROM S, range(64) p(pos))"""
)


def long(df: DataFrame, y: str = "y", axis: list[float] = AXIS) -> DataFrame:
    """Long form: one row per (key, pos) with its axis value."""
    keep = [c for c in df.columns if c != y]
    step = (axis[-1] - axis[0]) / (len(axis) - 1)
    return df.select(*keep, F.posexplode_outer(y).alias("pos", "y")).withColumn(
        "wn", F.lit(axis[0]) + F.col("pos") * F.lit(3423.0) / F.lit(63) if axis is AXIS else F.lit(axis[0]) + F.col("pos") * step
    )


def r(c: Column | str, digits: int = 6) -> Column:
    """Round, with negative zero folded into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def prediction(spark: SparkSession, sf: str, models: int = 3) -> DataFrame:
    """Class probabilities of several models: softmax of four series values plus a truth-dependent boost."""
    s = series(spark, sf)
    m = F.explode(F.array(*[F.lit(i).cast("long") for i in range(models)])).alias("model")
    base = s.select("vec_id", "sample_id", "subclass", "cls", "y", m)
    hit = F.pmod(F.col("vec_id"), F.lit(3)) != F.col("model")
    raw = base.select(
        "model",
        F.col("subclass").alias("fold_id"),
        F.col("sample_id").alias("file_id"),
        F.col("vec_id").alias("spectrum_id"),
        "subclass",
        F.col("cls").alias("y_true"),
        *[
            F.exp(
                F.element_at("y", (F.col("model") * 4 + k + 1).cast("int")) * 4.0
                + F.when((F.col("cls") == k) & hit, 1.0).otherwise(0.0)
            ).alias(f"e{k}")
            for k in range(4)
        ],
    )
    total = F.col("e0") + F.col("e1") + F.col("e2") + F.col("e3")
    keep = ["model", "fold_id", "file_id", "spectrum_id", "subclass", "y_true"]
    return raw.select(*keep, *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in range(4)])


def _prediction_sql(models: int = 3) -> str:
    e = ", ".join(
        f"exp(CAST(embedding[m.model * 4 + {k + 1}] AS DOUBLE) * 4 + CASE WHEN cls = {k} AND vec_id % 3 <> m.model THEN 1.0 ELSE 0.0 END) AS e{k}"
        for k in range(4)
    )
    p = ", ".join(f"e{k} / (e0 + e1 + e2 + e3) AS p{k}" for k in range(4))
    return (
        S_SQL
        + f""",
P0 AS (SELECT m.model, subclass AS fold_id, sample_id AS file_id, vec_id AS spectrum_id, subclass, cls AS y_true, {e}
  FROM S, range({models}) m(model)),
P AS (SELECT model, fold_id, file_id, spectrum_id, subclass, y_true, {p} FROM P0)"""
    )


P_SQL = _prediction_sql()


def sql(base: str, body: str, *ctes: str) -> str:
    """A full statement: base views, extra CTEs, then the final select."""
    head = {"S": S_SQL, "L": L_SQL, "P": P_SQL, "": ""}[base]
    parts = [x for x in (head, *ctes) if x]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
