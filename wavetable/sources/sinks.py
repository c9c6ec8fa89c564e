"""Writers of the feature store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array columns are written as JSON text."""
    nested = {x for x, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    df.select(*[F.to_json(x).alias(x) if x in nested else F.col(x) for x in df.columns]).write.mode("overwrite").option("header", True).csv(path)
