"""Aggregations from series rows to samples, classes and positions.

Every group-by here has map-side partial aggregation, so a class or file holding a third of all rows
costs its tasks nothing extra.  Percentiles go through ``exact_percentiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.functions.series import exploded
from wavetable.functions.stats import corrected_kurtosis, corrected_skew
from wavetable.operators import features as ft
from wavetable.operators.scale import checked_broadcast, exact_percentiles, null_safe_join, ranked, with_totals
from wavetable.operators.vectorsums import position_sums, vector_sums


def mean_pool(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of every feature column per key."""
    return df.groupBy(*keys).agg(*[F.expr(f"avg(`{c}`) AS `{c}`") for c in columns])


def group_constant(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Value of a column that must be constant per key; raises on a key with two values."""
    g = df.groupBy(*keys).agg(F.min(column).alias(column), F.max(column).alias("_hi"))
    bad = F.raise_error(F.concat(F.lit(f"{column} is not constant for "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))
    return g.where(F.when(F.col(column).eqNullSafe(F.col("_hi")), F.lit(True)).otherwise(bad)).drop("_hi")


def mean_series(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Vector mean per key as an array in position order (group size is the axis length)."""
    sums = vector_sums(df, keys, y)
    return sums.where("exists(n, x -> x > 0)").select(*keys, means("s", "n").alias(y))


def means(s: str, n: str) -> Column:
    """Position-wise s / n where n is above 0."""
    held = F.filter(F.arrays_zip(F.col(s).alias("s"), F.col(n).alias("n")), lambda p: p["n"] > 0)
    return F.transform(held, lambda p: p["s"] / p["n"])


def mean_series_kept(df: DataFrame, keys: Sequence[str], keep: str, y: str = "y") -> DataFrame:
    """As :func:`mean_series` over kept rows, or over all rows of a key that kept none. One pass."""
    e = position_sums(df, [*keys, keep], y)
    kept = F.try_divide(F.sum(F.when(F.col(keep), F.col("s"))), F.sum(F.when(F.col(keep), F.col("n"))))
    m = e.groupBy(*keys, "pos").agg(F.coalesce(kept, F.sum("s") / F.sum("n")).alias("m"))
    packed = m.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s"))
    return packed.select(*keys, F.transform("s", lambda p: p["m"]).alias(y))


def envelope(df: DataFrame, keys: Sequence[str], y: str = "y", lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Mean, population sd and a percentile band per (key, position)."""
    e = exploded(df, keys, y)
    by = [*keys, "pos"]
    base = position_sums(df, keys, y).select(*by, (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.col("m2") / F.col("n")).alias("std"))
    return null_safe_join(base, exact_percentiles(e, by, "v", {"p_lo": lo, "p_hi": hi}), by)


def feature_stats(df: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """Mean, sd and finite count of every feature per class."""
    u = unpivot(df, [by], features)
    ok = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    return u.groupBy("feature", by).agg(F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("sd"), F.count(ok).alias("n"))


def unpivot(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Feature columns to (keys, feature, value)."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    return df.select(*keys, F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)"))


def value_counts(df: DataFrame, column: str, within: Sequence[str] = ()) -> DataFrame:
    """Count per value and its share of the enclosing group."""
    n = df.groupBy(*within, column).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*within).agg(F.sum("n").alias("_t"))
    return null_safe_join(n, total, list(within)).select(*within, column, "n", (F.col("n") / F.col("_t")).alias("share"))


def standardised_means(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Z-score every feature over all rows, then average per group.

    The mean of z-scores is the z-score of the mean, so rows are aggregated once per group and the
    global moments come from the same group table.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}")]
    g = df.groupBy(*by).agg(*aggs)
    total = F.sum("n")
    glob = []
    for f in features:
        mean = F.sum(F.col("n") * F.col(f"m_{f}")) / total
        second = F.sum(F.col("n") * (F.col(f"v_{f}") + F.col(f"m_{f}") * F.col(f"m_{f}"))) / total
        glob += [mean.alias(f"gm_{f}"), F.sqrt(second - mean * mean).alias(f"gs_{f}")]
    one = g.agg(*glob)
    return with_totals(g, one).select(
        *by, *[F.try_divide(F.col(f"m_{f}") - F.col(f"gm_{f}"), F.col(f"gs_{f}")).alias(f) for f in features]
    )


def two_level_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str) -> DataFrame:
    """Outer mean weighted by inner groups and by rows, side by side."""
    g = df.groupBy(*inner).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return g.groupBy(*outer).agg(F.avg("_m").alias("by_group"), (F.sum("_s") / F.sum("_n")).alias("by_row"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the last value within 1.5 times the interquartile range."""
    keys = list(keys)
    q = exact_percentiles(df, keys, value, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    j = null_safe_join(df, checked_broadcast(q), keys)
    span = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return j.groupBy(*keys, "q1", "med", "q3").agg(
        F.min(F.when(v >= F.col("q1") - span, v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("q3") + span, v)).alias("whisker_hi"),
        F.count_if((v < F.col("q1") - span) | (v > F.col("q3") + span)).alias("n_out"),
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts per group; the last bin includes the upper edge."""
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(value).between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def peak_quality(df: DataFrame, centers: dict[str, float], by: str, classes: Sequence, min_height: float) -> DataFrame:
    """Per band and class: share of usable peaks and their mean drift from the catalog center."""
    parts = F.explode(
        F.array(*[
            F.struct(F.lit(n).alias("band"), F.col(f"peak_{n}_height").alias("h"), F.abs(F.col(f"peak_{n}_centre") - c).alias("d"))
            for n, c in centers.items()
        ])
    )
    e = df.select(by, parts.alias("e")).select(by, "e.*")
    ok = F.col("h") > min_height
    cols = []
    for k in classes:
        here = F.col(by) == k
        cols.append(F.round(F.avg(F.when(here, ok.cast("double"))), 6).alias(f"success_{k}"))
        cols.append(F.round(F.avg(F.when(here & ok, F.col("d"))), 4).alias(f"drift_{k}"))
    return e.groupBy("band").agg(*cols)


def spatial_spread(df: DataFrame, file: str, y: str, axis, regions: dict | None = None, eps: float = 1e-9) -> DataFrame:
    """Sample variance and coefficient of variation of region areas within each file."""
    regions = regions or catalog.SPATIAL_REGIONS
    a = ft.integrate(df, y, axis, regions, "_a_")
    var = [F.var_samp(f"_a_{n}").alias(f"spat_var_{n}") for n in regions]
    cv = [(F.stddev_samp(f"_a_{n}") / (F.abs(F.avg(f"_a_{n}")) + eps)).alias(f"spat_cv_{n}") for n in regions]
    return a.groupBy(file).agg(*var, *cv)


def spatial_moments(df: DataFrame, file: str, y: str, axis, bands: dict[str, float] | None = None, half_width: float = 10.0) -> DataFrame:
    """Corrected kurtosis and skew, and sample sd, of band areas within each file of at least 4 rows."""
    bands = bands or catalog.SPATIAL_BANDS
    a = ft.integrate(df, y, axis, ft.band_windows(bands, half_width), "_a_")
    enough = lambda c, x: F.when(F.count(c) >= 4, x)
    cols = []
    for n in bands:
        c = f"_a_{n}"
        cols += [
            corrected_kurtosis(c).alias(f"spat_kurt_{n}"),
            enough(c, corrected_skew(c)).alias(f"spat_skew_{n}"),
            enough(c, F.stddev_samp(c)).alias(f"spat_std_{n}"),
        ]
    return a.groupBy(file).agg(*cols)


def spatial_frame(df: DataFrame, file: str, y: str, axis, half_width: float = 10.0) -> DataFrame:
    """The ten spatial columns per file."""
    moments = spatial_moments(df, file, y, axis, half_width=half_width)
    kept = [c for c in moments.columns if c == file or c.startswith(("spat_kurt", "spat_skew"))]
    return spatial_spread(df, file, y, axis).join(moments.select(*kept), file)


def breakdown(df: DataFrame, cls: str, sub: str, n: str, rate: str, order: Sequence[str], no_sub: str) -> DataFrame:
    """Files and estimated kept rows per (class, subclass), in class order then label."""
    from pyspark.sql import Window

    g = df.withColumn(sub, F.coalesce(sub, F.lit(no_sub))).groupBy(cls, sub).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.col(n) * F.col(rate)).alias("est_kept")
    )
    rank = F.coalesce(*[F.when(F.col(cls) == v, F.lit(i)) for i, v in enumerate(order)], F.lit(len(order)))
    # one row per label of the vocabulary is numbered here
    return g.withColumn("place", F.row_number().over(Window.orderBy(rank, cls, sub)).cast("long"))


def breakdown_members(df: DataFrame, cls: str, sub: str, file: str, no_sub: str, chunk: int = 65_536) -> DataFrame:
    """The member list of every (class, subclass) as rows with their place, so no list is collected."""
    d = df.select(cls, F.coalesce(sub, F.lit(no_sub)).alias(sub), file)
    return ranked(d, [cls, sub], [F.col(file)], F.floor(F.col(file) / chunk), "member")
