"""Set operations on keys and frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def common(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Distinct keys present in every frame: one group-by instead of a chain of intersects."""
    tagged = union_all([f.select(*columns, F.lit(i).alias("_src")) for i, f in enumerate(frames)])
    return tagged.groupBy(*columns).agg(F.count_distinct("_src").alias("_n")).where(F.col("_n") == len(frames)).drop("_n")


def remainder(everything: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``taken``."""
    return everything.join(taken.select(key).distinct(), key, "left_anti")


def set_checks(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Is ``left`` unique, a subset of ``right``, and equal to it as a set of keys? One row."""
    n = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    g = n.groupBy(key).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return g.agg(
        (F.coalesce(F.max("l"), F.lit(0)) <= 1).alias("left_unique"),
        (F.count_if((F.col("l") > 0) & (F.col("r") == 0)) == 0).alias("left_in_right"),
        (F.count_if((F.col("l") > 0) != (F.col("r") > 0)) == 0).alias("same_set"),
    )
