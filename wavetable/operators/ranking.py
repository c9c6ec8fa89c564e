"""Top-k, peaks, display orders and bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.operators.scale import exact_percentiles, hash_bucket, hash_key, ranked


def top_k(df: DataFrame, order: list[Column], k: int, out: str = "place") -> DataFrame:
    """The first k rows with their place.  Each task keeps k rows; only those are numbered."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_k_per(df: DataFrame, keys: Sequence[str], order: list[Column], k: int, out: str = "place") -> DataFrame:
    """The first k rows per key.  Spark cuts every partition to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k).withColumn(out, F.col(out).cast("long"))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """At most n rows per stratum in hash order."""
    h = df.withColumn("_h", hash_key(key, seed=seed))
    return top_k_per(h, strata, [F.col("_h"), F.col(key)], n, "draw").drop("_h")


def dense_index(df: DataFrame, order: str, keep: Column, chunk: int = 65_536) -> DataFrame:
    """New dense position of the kept rows in ``order``, -1 for the others."""
    kept = ranked(df.where(keep), [], [F.col(order)], F.floor(F.col(order) / chunk), "new_index")
    kept = kept.withColumn("new_index", F.col("new_index") - 1)
    return kept.unionByName(df.where(~keep | keep.isNull()).withColumn("new_index", F.lit(-1).cast("long")))


def quantile_bins(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-frequency bin of every row by exact percentile edges (not ``ntile``: ties stay together).

    A value equal to an inner edge belongs to the bin above it; the outer edges are widened by 1e-9.
    """
    from wavetable.operators.scale import with_percentiles

    edges = {f"_e{i}": i / bins for i in range(bins + 1)}
    j = with_percentiles(df, list(keys), value, edges)
    v = F.col(value)
    at_or_above = [F.when(v >= F.col(f"_e{i}"), 1).otherwise(0) for i in range(1, bins)]
    b = reduce(lambda a, c: a + c, at_or_above, F.lit(0))
    top = F.when(v >= F.col(f"_e{bins}") + 1e-9, 1).otherwise(0)
    return j.withColumn("bin", F.least(b + top, F.lit(bins - 1)).cast("long")).drop(*edges)


def local_peaks(df: DataFrame, keys: Sequence[str], *, min_prominence: float, min_distance: int, n: int) -> DataFrame:
    """Largest local maxima of aggregated series in long form (key, pos, wn, y), by prominence.

    Groups are single series, so a window holds one axis length.  Prominence is the height over the
    higher of the two minima between the peak and the nearest higher point on either side.  Among
    peaks closer than ``min_distance`` positions the higher one survives, highest first.
    """
    y = F.collect_list(F.struct("pos", "wn", "y"))
    packed = df.groupBy(*keys).agg(F.sort_array(y).alias("s"))
    points = packed.select(*keys, F.transform("s", lambda p: p["y"]).alias("ys"), F.transform("s", lambda p: p["wn"]).alias("ws"))

    @F.arrow_udf("array<struct<pos:int,prominence:double>>")
    def find(series):
        import numpy as np
        import pyarrow as pa

        out = []
        for line in series:
            v = np.array(line.as_py())
            inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
            kept = np.ones(len(v), dtype=bool)
            for i in sorted(inner, key=lambda i: (-v[i], -i)):
                if kept[i]:
                    close = inner[(np.abs(inner - i) < min_distance) & (inner != i)]
                    kept[close] = False
            rows = []
            for i in inner[kept[inner]]:
                higher = np.flatnonzero(v > v[i])
                left = higher[higher < i].max(initial=-1)
                right = higher[higher > i].min(initial=len(v))
                rows.append({"pos": int(i), "prominence": float(v[i] - max(v[left + 1 : i + 1].min(), v[i:right].min()))})
            out.append(rows)
        return pa.array(out, type=pa.list_(pa.struct([("pos", pa.int32()), ("prominence", pa.float64())])))

    hits = points.select(*keys, "ys", "ws", F.explode(find("ys")).alias("p")).select(
        *keys,
        F.col("p.pos").cast("long").alias("pos"),
        F.col("ws")[F.col("p.pos")].alias("wn"),
        F.col("ys")[F.col("p.pos")].alias("y"),
        "p.prominence",
    )
    return top_k_per(hits.where(F.col("prominence") >= min_prominence), keys, [F.col("prominence").desc(), F.col("pos")], n)


def class_vector(probabilities: Sequence[str]) -> Column:
    """Probabilities as (p, -class order) structs, best first; ties go to the earlier class."""
    return F.reverse(F.array_sort(F.array(*[F.struct(F.col(c).alias("p"), F.lit(-i).alias("k")) for i, c in enumerate(probabilities)])))


def top_two(df: DataFrame, probabilities: Sequence[str]) -> DataFrame:
    """Best and second class with their probabilities, the margin and the top probability."""
    v = class_vector(probabilities)
    return df.withColumn("_v", v).select(
        *df.columns,
        (-F.col("_v")[0]["k"]).cast("long").alias("pred"),
        F.col("_v")[0]["p"].alias("top_p"),
        (-F.col("_v")[1]["k"]).cast("long").alias("second"),
        F.col("_v")[1]["p"].alias("second_p"),
        (F.col("_v")[0]["p"] - F.col("_v")[1]["p"]).alias("margin"),
    )


def waterfall(df: DataFrame, stage: str, y: str, step: float) -> DataFrame:
    """Lift the i-th staged series by i steps.  The table holds the few series staged for display."""
    w = Window.orderBy(stage)
    lifted = df.withColumn("_i", F.row_number().over(w) - 1)
    return lifted.withColumn(y, F.transform(y, lambda v: v + F.col("_i") * step)).drop("_i")


def intensity_order(df: DataFrame, file: str, key: str, score: Column, chunk: int = 65_536) -> DataFrame:
    """Rows of every file ordered by a score, highest first, then by the integer key.

    The score gives a running count over the file, the key a row number among equal scores; both are
    computed in parts, so a large file or one very common score does not end up in one task.
    """
    from wavetable.operators.scale import null_safe_join, running_totals

    d = df.withColumn("_neg", -score)
    t = running_totals(d, [file], "_neg", {"_k": F.lit(1).cast("long")}).select(file, "_neg", "_k_before")
    tied = ranked(d, [file, "_neg"], [F.col(key)], F.floor(F.col(key) / chunk), "_tie")
    return null_safe_join(tied, t, [file, "_neg"]).withColumn("place", F.col("_k_before") + F.col("_tie")).drop("_neg", "_k_before", "_tie")


def consensus(chosen: DataFrame, feature: str, k: int) -> DataFrame:
    """Most often chosen features over folds."""
    n = chosen.groupBy(feature).agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, [F.col("n").desc(), F.col(feature)], k)
