"""Series augmentations as row transforms.

Random numbers are integer arithmetic on the row key, not ``rand()``: a task that is run again after
an executor loss draws the same values, whatever the partitioning.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.functions.series import norm, roll, row_reduce
from wavetable.operators.scale import hash_bucket, hash_key, ranked, with_totals

def uniform(key: str, salt: int, pos: Column | int = 0) -> Column:
    """Uniform number in [0, 1) from a key, a position and a salt: 52 bits of an md5, so neighbours and salts are independent."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    digest = F.md5(F.concat_ws("|", F.lit(str(salt)), F.col(key).cast("string"), pos.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def noise(df: DataFrame, key: str, y: str, *, p: float, lo: float, hi: float, salt: int) -> DataFrame:
    """Gaussian noise with a sigma drawn as a share of the series' own standard deviation."""
    d = df.withColumn("_sd", row_reduce(lambda x: x.std(1, ddof=1))(y)).withColumn(
        "_sigma", F.when(uniform(key, salt) < p, (F.lit(lo) + (hi - lo) * uniform(key, salt + 1)) * F.col("_sd")).otherwise(0.0)
    )

    def add(v: Column, i: Column) -> Column:
        u, w = uniform(key, salt + 2, i + 1), uniform(key, salt + 3, i + 1)
        return v + F.col("_sigma") * F.sqrt(-2 * F.log(u + 1e-12)) * F.cos(2 * pi * w)

    return d.withColumn(y, F.transform(y, add)).drop("_sd", "_sigma")


def scale(df: DataFrame, key: str, y: str, *, p: float, lo: float, hi: float, salt: int) -> DataFrame:
    """Multiply a series by one factor in [lo, hi)."""
    f = F.when(uniform(key, salt) < p, F.lit(lo) + (hi - lo) * uniform(key, salt + 1)).otherwise(1.0)
    return df.withColumn(y, F.transform(y, lambda v: v * f))


def shift(df: DataFrame, key: str, y: str, *, p: float, max_bins: int, salt: int) -> DataFrame:
    """Roll a series by up to ``max_bins`` positions either way."""
    k = F.when(uniform(key, salt) < p, F.floor(uniform(key, salt + 1) * (2 * max_bins + 1)).cast("long") - max_bins).otherwise(F.lit(0))
    return df.withColumn(y, roll(y, k))


def drift(df: DataFrame, key: str, y: str, *, p: float, amp_max: float, period: tuple[float, float], salt: int) -> DataFrame:
    """Add a slow sine whose amplitude is a share of the series' largest absolute value."""
    d = df.withColumn("_top", row_reduce(lambda x: abs(x).max(1))(y))
    amp = F.when(uniform(key, salt) < p, amp_max * uniform(key, salt + 1)).otherwise(0.0) * F.col("_top")
    per = F.lit(period[0]) + (period[1] - period[0]) * uniform(key, salt + 2)
    phase = 2 * pi * uniform(key, salt + 3)
    return d.withColumn(y, F.transform(y, lambda v, i: v + amp * F.sin(2 * pi * i / per + phase))).drop("_top")


def mixup(df: DataFrame, key: str, label: str, y: str, *, lam: float, seed: int) -> DataFrame:
    """Blend every series with the next one in a hash-shuffled order; keeps both labels."""
    order = hash_key(key, seed=seed)
    rows = ranked(df.select(key, label, y).withColumn("_h", order), [], [F.col("_h"), F.col(key)], hash_bucket(F.col("_h"))).drop("_h")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    partner = rows.select(F.col("rn").alias("_rn"), F.col(label).alias("label_b"), F.col(y).alias("_y2"))
    nxt = with_totals(rows, n).withColumn("_rn", F.col("rn") % F.col("_n") + 1)
    return nxt.join(partner, "_rn").select(
        key, F.col(label).alias("label_a"), "label_b", F.zip_with(y, "_y2", lambda a, b: lam * a + (1 - lam) * b).alias(y)
    )
