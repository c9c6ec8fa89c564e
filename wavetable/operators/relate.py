"""Joins, lookups and column housekeeping between keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.operators.scale import exact_percentiles

CATALOG_ROWS = 1_000


def batch_and_domain(df: DataFrame, key: str, subclass: str, no_subclass: str = "H2O") -> DataFrame:
    """Batch date from the key's ``_dddddd`` suffix and the three domain labels built from it."""
    date = F.nullif(F.regexp_extract(key, r"_(\d{6})$", 1), F.lit(""))
    return df.select(
        "*",
        date.alias("batch_date"),
        F.col(key).alias("by_file"),
        F.coalesce(subclass, F.lit(no_subclass)).alias("by_subclass"),
        F.coalesce(date, F.lit("unknown")).alias("by_date"),
    )


def name_family(name: str, *, prefixes: dict[str, str] | None = None, keywords: dict[str, str] | None = None, default: str) -> Column:
    """Family of a name: first matching prefix, then first matching keyword, else the default."""
    tests = [(F.startswith(F.col(name), F.lit(p)), v) for p, v in (prefixes or {}).items()]
    tests += [(F.contains(F.col(name), F.lit(k)), v) for k, v in (keywords or {}).items()]
    return reduce(lambda acc, t: acc.when(t[0], t[1]), tests[1:], F.when(*tests[0])).otherwise(default)


def search_catalog(df: DataFrame, *, families: Sequence[str] | None = None, text: str = "", sort: str = "effect") -> DataFrame:
    """Filter a feature catalog by family and text and number the hits in the chosen order."""
    from pyspark.sql import Window

    hits = df.where(F.col("family").isin(list(families))) if families else df
    hits = hits.where(F.contains(F.lower("feature"), F.lit(text.lower()))) if text else hits
    order = {
        "effect": [F.abs("effect").desc_nulls_last(), F.col("feature")],
        "mi": [F.col("mi_rank").asc_nulls_last(), F.col("feature")],
        "name": [F.col("feature")],
    }[sort]
    # one row per feature column of the store, so the numbering is over a schema-sized table
    return hits.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def sanitise(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Replace null, NaN and infinities."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return df.withColumns({c: F.when(ok(c), F.col(c)).otherwise(F.lit(fill)) for c in columns})


def pad_columns(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Add the expected columns that are absent."""
    return df.withColumns({c: F.lit(fill) for c in columns if c not in df.columns}) if set(columns) - set(df.columns) else df


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop all-null columns, fill the other gaps with the exact column median, then with zero."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns])).alias("e")).select("e.*")
    medians = {r["name"]: r["med"] for r in exact_percentiles(stacked, ["name"], "v", {"med": 0.5}).collect()}  # one row per column
    gone = [c for c in columns if medians.get(c) is None]
    return df.drop(*gone).fillna({c: m for c, m in medians.items() if c in columns}).fillna(0.0, subset=[c for c in columns if c not in gone])


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that fails the job if a left row finds no partner or more than one.

    The check is part of the plan: an unmatched or doubled key raises when its row is read.
    """
    counted = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in right.columns if c not in on])
    joined = left.join(counted, list(on), "left")
    ok = F.coalesce(F.col("_copies"), F.lit(0)) == 1
    verdict = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("join lost or doubled key "), F.concat_ws(",", *[F.col(c).cast("string") for c in on]))))
    return joined.where(verdict).drop("_copies")


def nearest_band(df: DataFrame, position: str, bands: dict[str, float] | DataFrame, tolerance: float = 25.0) -> DataFrame:
    """Closest named band within a tolerance, else null.

    A catalog of at most ``CATALOG_ROWS`` bands becomes a literal array searched inside the row.  A
    larger catalog table is joined on position cells of the tolerance's width, three cells per band.
    """
    if isinstance(bands, DataFrame):
        rows = bands.select("name", "center").limit(CATALOG_ROWS + 1).collect()
        if len(rows) > CATALOG_ROWS:
            return nearest_band_by_cells(df, position, bands, tolerance)
        bands = {r["name"]: r["center"] for r in rows}
    cat = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for n, c in bands.items()])
    scored = F.transform(cat, lambda b: F.struct(F.abs(b["c"] - F.col(position)).alias("distance"), b["n"].alias("band")))
    best = F.array_min(F.filter(scored, lambda s: s["distance"] <= tolerance))
    return df.withColumn("_best", best).select(*df.columns, F.col("_best.band").alias("band"), F.col("_best.distance").alias("distance"))


def nearest_band_by_cells(df: DataFrame, position: str, bands: DataFrame, tolerance: float) -> DataFrame:
    cell = F.floor(F.col("center") / tolerance)
    near = bands.select("name", "center", F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    spots = df.select(F.col(position).alias("_p")).distinct().withColumn("_cell", F.floor(F.col("_p") / tolerance))
    hit = spots.join(near, "_cell").where(F.abs(F.col("center") - F.col("_p")) <= tolerance)
    best = hit.groupBy("_p").agg(F.min(F.struct(F.abs(F.col("center") - F.col("_p")).alias("distance"), F.col("name").alias("band"))).alias("_b"))
    return df.join(best, F.col(position) == F.col("_p"), "left").select(*df.columns, "_b.band", "_b.distance")
