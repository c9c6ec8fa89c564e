"""Data-contract gates.  Every gate is one row (gate, severity, passed, detail) computed from data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable.operators.scale import with_totals
from wavetable.operators.sets import set_checks

c = F.col
ERROR, WARN = "ERROR", "WARN"


class GateFailure(RuntimeError):
    """A blocking gate failed; downstream work must not run."""


def row(df: DataFrame, gate: str, passed: Column, detail: Column | str, severity: str = ERROR) -> DataFrame:
    """Turn a one-row table into a gate row; an unknown verdict counts as failed."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def text(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def axis_declared(axis: DataFrame, start: float, stop: float, n: int, tol: float = 1e-2, gate: str = "axis_declared") -> DataFrame:
    """Axis table (pos, wn) equals the declared even spacing."""
    want = F.lit(start) + c("pos") * F.lit((stop - start) / (n - 1))
    g = axis.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(c("wn") - want)).alias("off"))
    return row(g, gate, (c("n") == n) & (c("off") <= tol), text("points", c("n")))


def cropped_axis(axis: DataFrame, n: int, lo: float, hi: float) -> DataFrame:
    g = axis.agg(F.count(F.lit(1)).alias("n"), F.min("wn").alias("lo"), F.max("wn").alias("hi"))
    return row(g, "cropped_axis", (c("n") == n) & (c("lo") >= lo - 1) & (c("hi") <= hi + 1), text("points", c("n")))


def width(df: DataFrame, y: str, n: int) -> DataFrame:
    """Every series has the declared number of points."""
    g = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.size(y) != n) | c(y).isNull()).alias("bad"))
    return row(g, "series_width", c("bad") == 0, text("bad rows", c("bad"), "of", c("rows")))


def rows_match(a: DataFrame, b: DataFrame, gate: str = "rows_match") -> DataFrame:
    g = with_totals(a.agg(F.count(F.lit(1)).alias("a")), b.agg(F.count(F.lit(1)).alias("b")))
    return row(g, gate, c("a") == c("b"), text(c("a"), "rows and", c("b")))


def no_fatal_errors(files: DataFrame, errors: str) -> DataFrame:
    """``errors`` is an array column or a JSON list in a string."""
    is_text = dict(files.dtypes)[errors] == "string"
    n = F.json_array_length(errors) if is_text else F.size(errors)
    g = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.coalesce(n, F.lit(0))), F.lit(0)).alias("n"))
    return row(g, "no_fatal_errors", c("n") == 0, text(c("n"), "errors in", c("files"), "files"))


def funnel_reconciles(funnel: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """in - low signal - background = keep, a row that is both being counted once; the mask agrees."""
    f = funnel if "n_drop_both" in funnel.columns else funnel.withColumn("n_drop_both", F.lit(0))
    ok = c("n_input") - c("n_drop_snr") - c("n_drop_bg") + c("n_drop_both") == c("n_keep")
    if masked is not None:
        f = with_totals(f, masked.agg(F.count(F.lit(1)).alias("_rows"), F.count_if("keep").alias("_kept")))
        ok = ok & (c("_rows") == c("n_input")) & (c("_kept") == c("n_keep"))
    return row(f, "funnel_reconciles", ok, text(c("n_input"), "-", c("n_drop_snr"), "-", c("n_drop_bg"), "+", c("n_drop_both"), "=", c("n_keep")))


def reproducible(stored: DataFrame, live: DataFrame, key: str, keep: str = "keep") -> DataFrame:
    """Two masks agree in counts; the share of agreeing rows is reported."""
    j = stored.select(key, c(keep).alias("_a")).join(live.select(key, c(keep).alias("_b")), key, "full")
    g = j.agg(
        F.count_if(c("_a")).alias("a"), F.count_if(c("_b")).alias("b"), F.count_if(c("_a").isNull() | c("_b").isNull()).alias("lost"),
        F.round(100 * F.avg(F.coalesce(c("_a") == c("_b"), F.lit(False)).cast("double")), 4).alias("agree"),
    )
    return row(g, "mask_reproducible", (c("a") == c("b")) & (c("lost") == 0), text("agreement", c("agree"), "%"))


def retention_floor(per_file: DataFrame, file: str, floor: float = 0.8) -> DataFrame:
    g = per_file.agg(F.try_divide(F.sum("kept"), F.sum("n")).alias("r"), F.min_by(c(file), F.struct("retention", file)).alias("worst"))
    return row(g, "retention_floor", c("r") >= floor, text("worst file", c("worst")), WARN)


def no_nulls(df: DataFrame, columns: Sequence[str], tolerance: float = 0.0, gate: str = "null_rows", severity: str = ERROR) -> DataFrame:
    """Share of rows with any null or NaN in the columns stays within the tolerance."""
    types = dict(df.dtypes)
    bad = reduce(lambda a, b: a | b, [c(x).isNull() | (F.isnan(x) if types[x] in ("double", "float") else F.lit(False)) for x in columns])
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return row(g, gate, c("bad") <= tolerance * c("n"), text("null rows", c("bad"), "of", c("n")), severity)


def per_file_integrity(features: DataFrame, files: DataFrame, file: str, gate: str = "per_file_integrity") -> DataFrame:
    """One feature row per known file: unique, no stranger, none missing."""
    g = set_checks(features, files, file)
    return row(g, gate, c("left_unique") & c("left_in_right") & c("same_set"), text("unique", c("left_unique"), "subset", c("left_in_right"), "full", c("same_set")))


def coverage_gate(files: DataFrame, lo: str, hi: str, regions: dict[str, tuple[float, float]], acknowledged: bool = False) -> DataFrame:
    """Block scoring unless every file measured the whole of every region, or that was acknowledged."""
    from wavetable.sources.instrument import coverage_pct

    short = reduce(lambda a, b: a | b, [coverage_pct(c(lo), c(hi), *r) < 100.0 for r in regions.values()])
    g = files.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(short, F.lit(True))).alias("short"))
    return row(g, "in_distribution", (c("short") == 0) | F.lit(acknowledged), text(c("short"), "of", c("n"), "files not covered"), WARN if acknowledged else ERROR)


# ---------------------------------------------------------------- contract

@dataclass(frozen=True)
class Store:
    """Declared shape of one table of the feature store."""

    name: str
    key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    max_null_row_share: float = 0.0
    columns: int | None = None


def profile(df: DataFrame) -> DataFrame:
    """Observed type and null count of every column."""
    types = dict(df.dtypes)
    nan = lambda x: F.isnan(x) if types[x] in ("double", "float") else F.lit(False)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(c(x).isNull() | nan(x)).alias(f"n_{i}") for i, x in enumerate(df.columns)])
    parts = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.lit(types[x]).alias("dtype"), c(f"n_{i}").alias("nulls")) for i, x in enumerate(df.columns)]))
    return counts.select("_rows", parts.alias("e")).select("e.column", "e.dtype", "e.nulls", c("_rows").alias("rows"))


def store_gates(df: DataFrame, store: Store) -> DataFrame:
    """Key unique, declared columns not null, null rows within tolerance, column count as declared."""
    dup = df.groupBy(*store.key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(c("_n") > 1).alias("dup"))
    out = [row(dup, f"{store.name}.key_unique", c("dup") == 0, text("repeated keys", c("dup")))]
    if store.not_null:
        out.append(no_nulls(df, store.not_null, 0.0, f"{store.name}.not_null"))
    scalars = [x for x, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    out.append(no_nulls(df, scalars, store.max_null_row_share, f"{store.name}.null_rows", WARN))
    if store.columns is not None:
        n = len(df.columns)
        out.append(row(df.agg(F.count(F.lit(1)).alias("n")), f"{store.name}.columns", F.lit(n == store.columns), text(str(n), "columns,", c("n"), "rows")))
    return report(out)


def report(gates: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), gates)


def consistent(rep: DataFrame) -> DataFrame:
    """One row: do all blocking gates hold?"""
    g = rep.agg(F.count_if((c("severity") == ERROR) & ~c("passed")).alias("bad"), F.count(F.lit(1)).alias("n"))
    return row(g, "contract_consistent", c("bad") == 0, text(c("bad"), "of", c("n"), "gates failed"))


def enforce(rep: DataFrame) -> list[str]:
    """Raise on a failed ERROR gate; return the failed WARN gates."""
    failed = rep.where(~c("passed")).select("gate", "severity", "detail").collect()  # one row per gate
    blocking = [r for r in failed if r["severity"] == ERROR]
    if blocking:
        raise GateFailure("; ".join(f"{r['gate']}: {r['detail']}" for r in blocking))
    return [r["gate"] for r in failed]


def to_markdown(rep: DataFrame) -> DataFrame:
    """The report as Markdown table lines in gate order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "gate", "severity", F.when(c("passed"), "pass").otherwise("FAIL"), "detail"), F.lit(" |"))
    return rep.orderBy("gate").select(line.alias("line"))


# ---------------------------------------------------------------- hand-off

def training_matrix(index: DataFrame, frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Index joined with every feature frame on the key; a missing key is an error, not a null row."""
    from wavetable.operators.relate import join_checked

    return reduce(lambda a, b: join_checked(a, b, key), frames, index)


def file_table(meta: DataFrame, frames: Sequence[DataFrame], file: str) -> DataFrame:
    """Metadata with per-file frames, files without features kept."""
    return reduce(lambda a, b: a.join(b, file, "left"), frames, meta)
