"""First and second moments of a series table, as driver-side arrays of axis size."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.operators.vectorsums import vector_sums


def mean_vector(df: DataFrame, y: str = "y") -> np.ndarray:
    """Mean series of a table.  Partial sums per position leave each task."""
    total = vector_sums(df, [], y).first()  # one row
    return np.array(total.s) / np.array(total.n) if total else np.zeros(0)


def second_moments(df: DataFrame, y: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Row count, mean, population sd and cross-moment matrix X'X / n of a series table (B x B)."""
    v = df.select(array_to_vector(y).alias("v"))
    s = v.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).first()["s"]
    n, mean = int(s["count"]), s["mean"].toArray()
    sd = np.sqrt(s["variance"].toArray() * (n - 1) / n)
    corr = np.nan_to_num(Correlation.corr(v, "v").first()[0].toArray())
    return n, mean, sd, corr * np.outer(sd, sd) + np.outer(mean, mean)
