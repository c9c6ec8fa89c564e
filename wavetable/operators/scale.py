"""Building blocks that stay exact when one key holds a large share of all rows.

``ranked``            row numbers inside a group, computed bucket by bucket
``running_totals``    running sums by value inside a group (rank sums, cumulative counts)
``exact_percentiles`` interpolated percentiles: a sketch brackets each rank, a second pass finds it
``checked_broadcast`` broadcast of a table whose row count was checked

A plain ``row_number() over (partition by key)`` or ``percentile`` would pull a whole group into one
task; here a task sees one bucket of a group, plus at most a few hundred bucket totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.session import materialise

BROADCAST_ROWS = 10_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches null keys to null keys and keeps the left copy of the keys."""
    if not keys:
        return with_totals(left, right)  # without keys the right side is a global aggregate
    renamed = right.select(*[F.col(k).alias(f"_rk_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_rk_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_rk_{k}" for k in keys])


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a small table once and broadcast it, if it has at most ``max_rows`` rows.

    Never more than ``max_rows`` + 1 rows are fetched.  A larger table is returned as it is, and Spark
    joins it by shuffling (with its run-time skew handling).
    """
    head = df.limit(max_rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema)) if head.num_rows <= max_rows else df


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach a global aggregate, which has exactly one row, to every row."""
    return df.crossJoin(F.broadcast(totals))


def hash_key(*cols: Column | str, seed: int = 0) -> Column:
    """Reproducible pseudo-random sort key: the md5 of the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def hash_bucket(key: Column) -> Column:
    """One of 4096 equal buckets of a :func:`hash_key`, in its sort order."""
    return F.substring(key, 1, 3)


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str = "rn") -> DataFrame:
    """``row_number`` per ``keys`` in ``order``.

    ``bucket`` must be non-decreasing along ``order`` and split a large group into many parts.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        null_safe_join(b, offsets, [*keys, "_bucket"])
        .withColumn(out, (F.row_number().over(within) + F.col("_before")).cast("long"))
        .drop("_bucket", "_before")
    )


def running_totals(
    df: DataFrame, keys: list[str], value: str, measures: dict[str, Column], buckets: int = 256
) -> DataFrame:
    """One row per (keys, value) with each measure summed, and ``<measure>_before`` over smaller values."""
    per_value = materialise(df.groupBy(*keys, value).agg(*[F.sum(c).alias(m) for m, c in measures.items()]), "totals")
    probes = [i / buckets for i in range(1, buckets)]
    edges = per_value.groupBy(*keys).agg(F.percentile_approx(value, probes, 10_000).alias("_edges"))
    b = null_safe_join(per_value, checked_broadcast(edges), keys).withColumn(
        "_bucket", F.size(F.filter("_edges", lambda e: e < F.col(value)))
    ).drop("_edges")
    totals = b.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_join(b, offsets, [*keys, "_bucket"])
    return joined.select(
        *keys,
        value,
        *measures,
        *[(F.coalesce(F.sum(m).over(within), F.lit(0)) + F.col(f"_o_{m}")).alias(f"{m}_before") for m in measures],
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], *, accuracy: int = 10_000
) -> DataFrame:
    """Linear-interpolation percentiles per group; nulls and NaN are ignored.

    Pass 1 keeps a bounded sketch per group, whose rank error is at most n/accuracy, and asks it for
    a value below and above each wanted rank.  Pass 2 keeps the distinct values inside these brackets
    (about 4n/accuracy per quantile) with their counts, and of every gap between brackets its count,
    minimum and maximum.  In value order the running counts give the exact rank of each.
    """
    names = list(quantiles)
    delta = 2.0 / accuracy
    probes = [p for q in quantiles.values() for p in (max(q - delta, 0.0), min(q + delta, 1.0))]
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    v = v.withColumn("_v", F.col("_v") + F.lit(0.0))  # one zero, not two
    sketch = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", probes, accuracy).alias("_e")
    )
    brackets = [(F.col("_e")[2 * i], F.col("_e")[2 * i + 1]) for i in range(len(names))]
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(lo, hi) for lo, hi in brackets])
    gap = reduce(lambda a, b: a + b, [F.when(F.col("_v") > hi, 1).otherwise(0) for _, hi in brackets])
    runs = (
        null_safe_join(v, checked_broadcast(sketch), keys)
        .groupBy(*keys, "_n", F.when(inside, F.col("_v")).alias("_x"), F.when(~inside, gap).alias("_g"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_end", F.sum("_c").over(order)).withColumn("_start", F.col("_end") - F.col("_c"))
    lost = F.raise_error(F.lit("percentile rank outside its bracket")).cast("double")

    def value_at(k: Column) -> Column:
        at = (
            F.when(F.col("_x").isNotNull(), F.col("_x"))
            .when(k == F.col("_start"), F.col("_lo"))
            .when(k == F.col("_end") - 1, F.col("_hi"))
            .otherwise(lost)
        )
        return F.max(F.when((F.col("_start") <= k) & (k < F.col("_end")), at))

    aggs = []
    for i, name in enumerate(names):
        rank = (F.col("_n").cast("double") - 1.0) * quantiles[name]
        aggs += [value_at(F.floor(rank)).alias(f"_l{i}"), value_at(F.ceil(rank)).alias(f"_h{i}")]
        aggs.append(F.max(rank - F.floor(rank)).alias(f"_f{i}"))
    blend = [
        (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(name)
        for i, name in enumerate(names)
    ]
    return runs.groupBy(*keys).agg(*aggs).select(*keys, *blend)


def with_percentiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], how: str = "left"
) -> DataFrame:
    """Attach group percentiles to every row of the group."""
    return null_safe_join(df, checked_broadcast(exact_percentiles(df, keys, value, quantiles)), keys, how)
