"""Ingest of instrument text exports: headers, axis row and pixel rows to keyed series.

Input of every step is a table of lines (file_path, ord, line); ``ord`` is the number of a line in its file.
A file larger than a block is read by several tasks; nothing here needs a file in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetable import catalog
from wavetable.functions.series import ARRAY, _by_width
from wavetable.operators.ranking import top_k_per
from wavetable.operators.scale import checked_broadcast, hash_key, ranked
from wavetable.session import materialise

c = F.col
GLOB = "*.{xls,txt}"
TAB = "\t"
LINES_PER_BUCKET = 65_536  # lines of one file that one task numbers


# ---------------------------------------------------------------- reading

def discover(spark: SparkSession, root: str) -> DataFrame:
    """All export files under a root: path, size, modification time.  The content column is pruned.

    Spark's file sources do not list files of zero bytes, so those never appear.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(root)
    return f.select(c("path").alias("file_path"), c("length").alias("file_size_bytes"), c("modificationTime").alias("file_mtime"))


def plain_path() -> Column:
    """Path of the file a row comes from, spelled as :func:`discover` spells it (not percent-encoded)."""
    return F.url_decode(F.replace(c("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file_path")


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, ord, line) of all export files; ``ord`` is the number of the line in its file.

    The text is read once, into a stored table, and all later steps read that.
    """
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).text(root)
    return numbered_lines(t.select(plain_path(), c("_metadata.file_block_start").alias("block"), c("value").alias("line")))


def numbered_lines(scan: DataFrame) -> DataFrame:
    """Dense line numbers per file for (file_path, block, line) rows in the order of the file source.

    A task reads the lines of a block one after the other, so inside a block numbers follow the row counter; each block
    starts behind the lines of the blocks before it.  The numbers are those of the file, however it was split.
    """
    t = materialise(scan.select("file_path", "block", F.monotonically_increasing_id().alias("at"), "line"), "lines")
    blocks = t.groupBy("file_path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    ahead = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = blocks.select("file_path", "block", (F.coalesce(F.sum("size").over(ahead), F.lit(0)) - c("first")).alias("start"))
    return t.join(checked_broadcast(start, 100_000), ["file_path", "block"]).select("file_path", (c("at") + c("start")).alias("ord"), "line")


def classify(files: DataFrame, root: str = "", class_of: dict[str, str] | None = None, with_subclass: Sequence[str] | None = None) -> DataFrame:
    """Class and subclass from the folders of ``file_path``; an unknown layout becomes a fatal error."""
    class_of = class_of or catalog.CLASS_OF_FOLDER
    with_subclass = with_subclass or catalog.FOLDERS_WITH_SUBCLASS
    prefix = root.rstrip("/") + "/" if root else ""
    rel = F.when(F.startswith("file_path", F.lit(prefix)), F.substr("file_path", F.lit(len(prefix) + 1))).otherwise(c("file_path"))
    parts = F.split(rel, "/")
    top = parts[0]
    known = F.coalesce(*[F.when(top == k, v) for k, v in class_of.items()], F.lit(None).cast("string"))
    need_sub = top.isin(list(with_subclass))
    fatal = (
        F.when(F.size(parts) < 2, F.lit("unexpected_layout"))
        .when(known.isNull(), F.concat(F.lit("unknown_class_folder:"), top))
        .when(need_sub & (F.size(parts) < 3), F.lit("missing_subclass_folder"))
    )
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return files.select(
        "*", stem.alias("file_id"), known.alias("primary_class"), F.when(need_sub & (F.size(parts) >= 3), parts[1]).alias("subclass"), fatal.alias("layout_error")
    )


# ---------------------------------------------------------------- header and axis

def number(token: Column) -> Column:
    """`1,034.00` to 1034.0; blank or non-numeric to null."""
    return F.replace(F.trim(token), F.lit(",")).try_cast("double")


def body_start(lines: DataFrame) -> DataFrame:
    """Per file: number and text of the first line that is not a header.

    The smallest number is a hash aggregate of longs; only the lines that have it are then looked up.
    """
    at = materialise(lines.groupBy("file_path").agg(F.min(F.when(~F.startswith("line", F.lit("#")), c("ord"))).alias("axis_ord")), "starts")
    found = lines.join(checked_broadcast(at.select("file_path", c("axis_ord").alias("ord")).where("ord is not null"), 100_000), ["file_path", "ord"], "left_semi")
    return at.join(found.select("file_path", c("line").alias("axis_line")), "file_path", "left")


def header_entries(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, key, value) of `#KEY=<tab>VALUE` lines before the body; the last entry of a key wins."""
    h = lines.where(F.startswith("line", F.lit("#"))).join(checked_broadcast(starts.select("file_path", "axis_ord"), 100_000), "file_path")
    h = h.where(c("axis_ord").isNull() | (c("ord") < c("axis_ord"))).where(F.contains("line", F.lit("=")))
    body = F.ltrim(c("line"), F.lit("#"))
    key = F.trim(F.substring_index(body, "=", 1))
    value = F.trim(F.ltrim(F.substr(body, F.instr(body, "=") + 1), F.lit(TAB)))
    e = h.select("file_path", "ord", key.alias("key"), value.alias("value"))
    last = e.groupBy("file_path", "key").agg(F.max("ord").alias("ord"))
    return e.join(last, ["file_path", "key", "ord"]).select("file_path", "key", "value")


# fixed values of the export format and of its error report
HEADER_KEYS = ("NUMX", "NUMY", "XSIZE", "YSIZE", "Laser", "ExposureTime", "Aquired", "Date", "AC")


def header_fields(entries: DataFrame) -> DataFrame:
    """Typed header columns per file; a value that does not parse is null."""
    p = entries.groupBy("file_path").pivot("key", list(HEADER_KEYS)).agg(F.first("value"))
    text = lambda k: F.nullif(c(f"`{k}`"), F.lit(""))
    whole = lambda k: text(k).try_cast("double").cast("int")
    real = lambda k: text(k).try_cast("double")
    ac = text("AC")
    stamp = F.nullif(F.regexp_extract(ac, r"(\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}:\d{2})", 1), F.lit(""))
    return p.select(
        "file_path", whole("NUMX").alias("header_numx"), whole("NUMY").alias("header_numy"), real("XSIZE").alias("xsize"), real("YSIZE").alias("ysize"),
        text("Laser").alias("laser"), real("ExposureTime").alias("exposure_ms"), F.coalesce(text("Aquired"), text("Date")).alias("acquisition_date"),
        F.coalesce(stamp, ac).alias("ac_calibration_date"),
        F.array_compact(F.array(F.when(text("NUMX").isNull(), F.lit("missing_numx_header")), F.when(text("NUMY").isNull(), F.lit("missing_numy_header")))).alias("header_warnings"),
    )


def parse_axis(starts: DataFrame, n: int | None) -> DataFrame:
    """Axis values of the axis line; a wrong count, bad number or non-increasing axis is a fatal error."""
    cells = F.filter(F.slice(F.split("axis_line", TAB), 3, F.greatest(F.size(F.split("axis_line", TAB)) - 2, F.lit(0))), lambda t: F.trim(t) != "")
    a = starts.withColumn("axis", F.transform(cells, lambda t: number(t)))
    rising = F.forall(F.zip_with(F.slice("axis", 1, F.greatest(F.size("axis") - 1, F.lit(0))), F.slice("axis", 2, F.greatest(F.size("axis") - 1, F.lit(0))), lambda u, v: v > u), lambda ok: F.coalesce(ok, F.lit(False)))
    size_bad = (F.size("axis") != n) if n is not None else (F.size("axis") < 2)
    fatal = (
        F.when(c("axis_line").isNull(), F.lit("no_data_rows"))
        .when(F.exists("axis", lambda v: v.isNull()), F.lit("wn_parse_error"))
        .when(size_bad, F.concat(F.lit("wn_axis_size:"), F.size("axis").cast("string"), F.lit(f"!={n}")))
        .when(~rising, F.lit("wn_not_monotonic"))
    )
    return a.withColumn("axis_error", fatal)


# ---------------------------------------------------------------- pixel rows

def parse_pixels(lines: DataFrame, axes: DataFrame) -> DataFrame:
    """Every data line as x, y, values or a reject reason.  Blank and one-cell lines are ignored."""
    good = axes.where("axis_error is null").select("file_path", "axis_ord", F.size("axis").alias("_n"))
    # one short row per file: broadcast it if the number of files allows, else Spark shuffles by file
    d = lines.join(checked_broadcast(good, 100_000), "file_path").where((c("ord") > c("axis_ord")) & (F.trim(F.replace("line", F.lit(TAB), F.lit(" "))) != ""))
    d = d.withColumn("_t", F.split("line", TAB)).where(F.size("_t") >= 3)
    d = d.select(
        "file_path", "ord", number(c("_t")[0]).alias("x_um"), number(c("_t")[1]).alias("y_um"), F.size("_t").alias("_cells"), "_n",
        F.transform(F.slice("_t", F.lit(3), c("_n")), lambda t: number(t)).alias("y"),
    )
    finite = F.forall("y", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    reason = (
        F.when(c("x_um").isNull() | c("y_um").isNull(), F.lit("bad_coord_row"))
        .when(c("_cells") < c("_n") + 2, F.lit("truncated_pixel_row"))
        .when(~finite, F.lit("nan_in_raw_spectrum"))
    )
    return d.select("file_path", "ord", "x_um", "y_um", "y", reason.alias("reject"))


# fixed values: the names of the reasons in the report
REJECT_REASONS = ("bad_coord_row", "truncated_pixel_row", "nan_in_raw_spectrum")


def file_stats(parsed: DataFrame) -> DataFrame:
    """Per file in one pass: accepted rows, distinct coordinates, rows per reject reason.

    Spark counts the distinct values per (file, value) first, so a file's values never meet in a task.
    """
    ok = c("reject").isNull()
    g = parsed.groupBy("file_path").agg(
        F.count_if(ok).alias("n_pixels"),
        F.count_distinct(F.when(ok, c("x_um"))).alias("grid_nx"),
        F.count_distinct(F.when(ok, c("y_um"))).alias("grid_ny"),
        *[F.count_if(c("reject") == reason).alias(f"n_{reason}") for reason in REJECT_REASONS],
    )
    full = c("grid_nx") * c("grid_ny")
    entry = lambda reason: F.when(c(f"n_{reason}") > 0, F.concat(F.lit(f"{reason}:"), c(f"n_{reason}").cast("string")))
    return g.withColumn("is_complete_scan", c("n_pixels") >= full).select(
        "*",
        F.when(c("n_pixels") < full, F.concat(F.lit("partial_scan:"), c("n_pixels").cast("string"), F.lit("/"), full.cast("string"))).alias("scan_warning"),
        F.array_compact(F.array(*[entry(reason) for reason in REJECT_REASONS])).alias("row_warnings"),
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """Rows per file and reject reason."""
    return parsed.where("reject is not null").groupBy("file_path", "reject").agg(F.count(F.lit(1)).alias("n"))


def grid(parsed: DataFrame) -> DataFrame:
    """Grid size from distinct coordinates, pixel count and completeness of the files with accepted rows."""
    g = file_stats(parsed).where("n_pixels > 0")
    return g.select("file_path", "n_pixels", "grid_nx", "grid_ny", "is_complete_scan", "scan_warning")


def cap_rows(parsed: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` accepted rows per file, chosen in hash order; file order is kept by ``ord``."""
    ok = parsed.where("reject is null").drop("reject").withColumn("_h", hash_key("file_path", F.to_json(F.struct("ord")), seed=seed))
    return top_k_per(ok, ["file_path"], [c("_h"), c("ord")], cap, "_draw").drop("_h", "_draw")


def number_rows(rows: DataFrame, bucket: Column, out: str = "pixel_idx") -> DataFrame:
    """Dense index of the rows of a file in line order, from 0; ``bucket`` follows that order."""
    return ranked(rows, ["file_path"], [c("ord")], bucket, out).withColumn(out, c(out) - 1)


# ---------------------------------------------------------------- common axis

def resample(rows: DataFrame, axes: DataFrame, target: Sequence[float], y: str = "y") -> DataFrame:
    """Linear interpolation of every series to the target axis, clamped at the ends.

    The bracket search runs once per distinct axis; unsorted axes are sorted there.  Rows then need
    two lookups and one blend per target point.
    """
    x = np.asarray(target, dtype=np.float64)
    plan_type = T.StructType([T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("j", T.ArrayType(T.IntegerType())), T.StructField("w", ARRAY)])

    @F.arrow_udf(plan_type)
    def search(axis: pa.Array) -> pa.Array:
        out: list = [None] * len(axis)
        for which, batch in _by_width(axis):
            for r, a in zip(which, batch):
                order = np.argsort(a, kind="stable")
                s = a[order]
                k = np.clip(np.searchsorted(s, x, side="right") - 1, 0, max(len(s) - 2, 0))
                nxt = np.minimum(k + 1, len(s) - 1)
                span = s[nxt] - s[k]
                w = np.clip(np.where(span > 0, (x - s[k]) / np.where(span > 0, span, 1.0), 0.0), 0.0, 1.0)
                out[r] = {"i": order[k] + 1, "j": order[nxt] + 1, "w": w}
        return pa.array(out, type=pa.struct([("i", pa.list_(pa.int32())), ("j", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))]))

    # files share few axes: rows first look up their axis, then the plan of that axis
    known = axes.where("axis is not null").select("file_path", F.md5(F.array_join(c("axis").cast("array<string>"), ",")).alias("_axis"), "axis")
    plans = known.groupBy("_axis").agg(F.first("axis").alias("axis")).select("_axis", search("axis").alias("_plan"))
    j = rows.join(checked_broadcast(known.select("file_path", "_axis"), 100_000), "file_path").join(checked_broadcast(plans, 200), "_axis").drop("_axis")
    blend = F.zip_with(
        F.arrays_zip(c("_plan.i").alias("i"), c("_plan.j").alias("j")), c("_plan.w"),
        lambda ij, w: F.element_at(y, ij["i"]) + w * (F.element_at(y, ij["j"]) - F.element_at(y, ij["i"])),
    )
    return j.withColumn(y, blend).drop("_plan")


def coverage_pct(lo: Column, hi: Column, a: float, b: float) -> Column:
    """Share of the region [a, b] inside the measured range, in percent."""
    return F.greatest(F.lit(0.0), F.least(F.lit(b), hi) - F.greatest(F.lit(a), lo)) / F.lit(b - a) * 100.0


def two_column_series(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Files whose first body line has two numeric cells: one series, points sorted by axis value."""
    first = F.split("axis_line", TAB)
    single = starts.where((F.size(first) == 2) & number(first[0]).isNotNull() & number(F.get(first, F.lit(1))).isNotNull()).select("file_path", "axis_ord")
    cells = F.split("line", TAB)
    p = lines.join(single, "file_path").where((c("ord") >= c("axis_ord")) & (F.size(cells) >= 2)).select("file_path", number(cells[0]).alias("wn"), number(cells[1]).alias("v"))
    s = p.where("wn is not null and v is not null").groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("wn", "v"))).alias("s"))
    return s.select("file_path", F.transform("s", lambda t: t["wn"]).alias("axis"), F.transform("s", lambda t: t["v"]).alias("y"), F.lit(0.0).alias("x_um"), F.lit(0.0).alias("y_um"))


# ---------------------------------------------------------------- whole files

def metadata(files: DataFrame, lines: DataFrame, n_bins: int, cap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata per file, accepted parsed rows, and axes.  ``files`` comes from ``classify``."""
    starts = body_start(lines)
    axes = materialise(parse_axis(starts, n_bins), "axes")  # one row per file, read by every later step
    parsed = parse_pixels(lines, axes)
    head = header_fields(header_entries(lines, axes))
    m = (
        files.join(axes.select("file_path", "axis_error", F.element_at("axis", 1).alias("wn_start"), F.element_at("axis", -1).alias("wn_end"), F.lit(True).alias("_read")), "file_path", "left")
        .join(head, "file_path", "left").join(file_stats(parsed).drop(*[f"n_{x}" for x in REJECT_REASONS]), "file_path", "left")
    )
    empty = F.when(c("_read").isNull(), F.lit("empty_file"))  # listed, but without a single line
    none = F.when(c("_read") & c("axis_error").isNull() & (F.coalesce("n_pixels", F.lit(0)) == 0), F.lit("no_valid_pixel_rows"))
    capped = F.when(c("n_pixels") > cap, F.concat(F.lit("pixel_capped:"), c("n_pixels").cast("string"), F.lit(f"->{cap}"))) if cap else F.lit(None).cast("string")
    null = F.array().cast("array<string>")
    m = m.withColumns({
        "fatal_errors": F.array_compact(F.array("layout_error", empty, "axis_error", none)),
        "warnings": F.concat(F.coalesce("header_warnings", null), F.coalesce("row_warnings", null), F.array_compact(F.array("scan_warning", capped))),
        "is_complete_scan": F.coalesce("is_complete_scan", F.lit(True)),
        "n_pixels_read": F.coalesce("n_pixels", F.lit(0)),
        "n_pixels": F.coalesce(F.least(c("n_pixels"), F.lit(cap)) if cap else c("n_pixels"), F.lit(0)),
        "grid_nx": F.coalesce("grid_nx", F.lit(0)), "grid_ny": F.coalesce("grid_ny", F.lit(0)),
    })
    return m.drop("_read", "layout_error", "axis_error", "header_warnings", "row_warnings", "scan_warning"), parsed, axes


def build_summary(meta: DataFrame) -> DataFrame:
    """Files, fatal files, warned files and spectra of a build."""
    fatal = F.size("fatal_errors") > 0
    return meta.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(fatal).alias("n_fatal"),
        F.count_if(~fatal & (F.size("warnings") > 0)).alias("n_warned"), F.sum(F.when(~fatal, c("n_pixels")).otherwise(0)).alias("n_spectra"),
    )


def inventory(meta: DataFrame) -> DataFrame:
    """Per class: files, capped, partial and header-mismatch counts."""
    has = lambda p: F.exists("warnings", lambda w: F.startswith(w, F.lit(p)))
    return meta.groupBy("primary_class").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(has("pixel_capped")).alias("n_capped"), F.count_if(has("partial_scan")).alias("n_partial"),
        F.count_if((c("header_numx") != c("grid_nx")) | (c("header_numy") != c("grid_ny"))).alias("n_header_mismatch"),
    )
