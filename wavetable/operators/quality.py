"""Quality control of series rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.functions.linear import window_mask
from wavetable.functions.series import mad, row_reduce
from wavetable.operators.scale import checked_broadcast, exact_percentiles, null_safe_join
from wavetable.session import materialise


def with_snr(
    df: DataFrame, y: str, axis: Sequence[float], signal: tuple[float, float] = (900.0, 1700.0), noise: tuple[float, float] = (1800.0, 2500.0)
) -> DataFrame:
    """Mean of the signal band over the population sd of the noise band."""
    s, n = window_mask(axis, *signal), window_mask(axis, *noise)
    if not s.any() or not n.any():
        raise ValueError(f"empty band: signal {int(s.sum())} points, noise {int(n.sum())} points")
    return df.withColumn("snr", row_reduce(lambda x: x[:, s].mean(1) / (x[:, n].std(1) + 1e-8))(y))


def with_background(
    df: DataFrame, file: str, y: str, axis: Sequence[float], band: tuple[float, float] = (600.0, 1700.0),
    pct: float = 0.1, flatness: float = 2.0, min_rows: int = 5,
) -> DataFrame:
    """Mark rows that are both dim (band sum in the file's lowest share) and flat (small spread)."""
    m = window_mask(axis, *band)
    d = df.withColumn("intensity", row_reduce(lambda x: x[:, m].sum(1))(y)).withColumn("spread", mad(y))
    limits = _file_limits(materialise(d.select(file, "intensity", "spread"), "qc"), file, pct)
    marked = (F.col("_rows") >= min_rows) & (F.col("intensity") <= F.col("_dim")) & (F.col("spread") < flatness * F.col("_flat"))
    # the limits are one row per file; broadcasting them keeps the series where they are
    return null_safe_join(d, checked_broadcast(limits, 100_000), [file]).withColumn("background", marked).drop("_dim", "_flat", "_rows")


def _file_limits(scalars: DataFrame, file: str, pct: float) -> DataFrame:
    """Dimness limit, median spread and row count per file, from two scalars per series.

    The series themselves are read twice (here and for the mask) and never shuffled.
    """
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("v")) for n in ("intensity", "spread")]))
    flat = scalars.select(file, both.alias("e")).select(file, "e.what", "e.v")
    p = exact_percentiles(flat, [file, "what"], "v", {"dim": pct, "mid": 0.5})
    pick = lambda what, col: F.max(F.when(F.col("what") == what, F.col(col)))
    limits = p.groupBy(file).agg(pick("intensity", "dim").alias("_dim"), pick("spread", "mid").alias("_flat"))
    return null_safe_join(limits, scalars.groupBy(file).agg(F.count(F.lit(1)).alias("_rows")), [file])


def with_keep(df: DataFrame, file: str, y: str, axis: Sequence[float], *, snr_threshold: float = 5.0, drop_background: bool = True, **bands) -> DataFrame:
    """The full mask: enough signal and not background."""
    d = with_snr(df, y, axis, **bands)
    d = with_background(d, file, y, axis) if drop_background else d.withColumn("background", F.lit(False))
    return d.withColumn("keep", (F.col("snr") >= snr_threshold) & ~F.col("background"))


def funnel(masked: DataFrame, snr_threshold: float = 5.0) -> DataFrame:
    """Row counts through the mask."""
    return masked.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if("keep").alias("n_keep"),
        F.count_if(F.col("snr") < snr_threshold).alias("n_drop_snr"),
        F.count_if("background").alias("n_drop_bg"),
        F.count_if((F.col("snr") < snr_threshold) & F.col("background")).alias("n_drop_both"),
    )


def per_file(masked: DataFrame, file: str) -> DataFrame:
    """Rows, kept rows, retention, median signal-to-noise and background count per file."""
    g = masked.groupBy(file).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("keep").alias("kept"),
        F.avg(F.col("keep").cast("double")).alias("retention"),
        F.count_if("background").alias("n_bg"),
    )
    return null_safe_join(g, exact_percentiles(masked, [file], "snr", {"median_snr": 0.5}), [file])


def retention_by(masked: DataFrame, column: str) -> DataFrame:
    return masked.groupBy(column).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"), F.avg(F.col("keep").cast("double")).alias("retention")
    )


def worst_files(per_file_table: DataFrame, file: str, n: int = 8) -> DataFrame:
    """Files with the lowest retention."""
    return per_file_table.orderBy("retention", file).limit(n)
