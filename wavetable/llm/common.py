"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.session import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a thin query over the given tables."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_bytes(text: str | Column) -> Column:
    """UTF-8 length of a text; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")


def learn(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, parts: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (unique in ``keys``) when very many rows may share a key.

    Rows are dealt in ``parts`` by the hash of column ``by``; each part asks for every key it holds once, so a hot key meets
    ``parts`` askers and the rows of one key are spread over as many groups.
    """
    (part,) = fresh(rows, "_part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(F.col(by), F.lit(11)), F.lit(parts)).cast("int"))
    told = dealt.select(part, *keys).distinct().join(facts, keys)
    return dealt.join(told, [part, *keys]).drop(part)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``: later joins and groups by the key read it without a shuffle."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table_name}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table_name)
    return spark.table(table_name)
