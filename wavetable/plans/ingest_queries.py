"""Ingest (I1-I16) on instrument-style text derived from the series table by Spark.

A sample becomes a file: header lines, an axis line shifted per sample, one line per series with
thousands commas.  Some lines are damaged on purpose: every 17th is cut short, every 19th holds a
word, every 23rd has a bad coordinate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.operators.scale import hash_key
from wavetable.plans.registry import query
from wavetable.plans.tables import AXIS, BINS, r, series, sql, table
from wavetable.session import shared_folder
from wavetable.sources import instrument as ins
from wavetable.sources import manifest as mf
from wavetable.sources import sinks

TAB = "\t"
FOLDERS = ["H20", "STEC", "Non STEC", "Salmonella", "Unknown"]


def path_of(sample, sub):
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.when(sample % 13 == 12, F.lit(4)).otherwise(sub % 4) + 1).cast("int"))
    name = F.concat(F.lit("R"), sample.cast("string"), F.lit("_100_"), (F.lit(260301) + sample % 7).cast("string"), F.lit(".txt"))
    return F.when(folder == "H20", F.concat(folder, F.lit("/"), name)).otherwise(F.concat(folder, F.lit("/S"), sub.cast("string"), F.lit("/"), name))


def lines(spark, sf) -> DataFrame:
    s = series(spark, sf).withColumn("file_path", path_of(F.col("sample_id"), F.col("subclass")))
    v, k = F.col("vec_id"), F.col("sample_id")
    cells = F.transform("y", lambda x: F.format_number(F.round(1500 + 5000 * x, 2), 2))
    cells = F.when(v % 17 == 0, F.slice(cells, 1, BINS - 2)).when(v % 19 == 0, F.concat(F.slice(cells, 1, 3), F.array(F.lit("abc")), F.slice(cells, 5, BINS - 4))).otherwise(cells)
    x = F.when(v % 23 == 0, F.lit("x?")).otherwise((F.col("pixel_idx") % 5).cast("string"))
    pixel = F.concat_ws(TAB, x, F.floor(F.col("pixel_idx") / 5).cast("string"), F.array_join(cells, TAB))
    body = s.select("file_path", (F.col("pixel_idx") + 100).alias("ord"), pixel.alias("line"))
    f = s.select("file_path", "sample_id").distinct()
    head = [
        (0, F.when(k % 9 != 3, F.lit("#NUMX=\t5"))), (1, F.lit("#NUMY=\t4")), (2, F.lit("#Laser=\t785nm")),
        (3, F.concat(F.lit("#ExposureTime=\t"), (k * 10).cast("string"))), (4, F.lit("#no key here")),
        (5, F.when(k % 4 == 1, F.lit("#AC=\tmanual")).otherwise(F.concat(F.lit("#AC=\tCalibrated "), F.lpad((k % 7 + 1).cast("string"), 2, "0"), F.lit(".03.2026 07:48:36")))),
        (6, F.lit("#Date=\t2026-03-01")), (7, F.lit("#XSIZE=\tn/a")),
    ]
    axis = F.concat_ws(TAB, F.lit(""), F.lit(""), *[(F.lit(a) + 3.0 * (k % 3)).cast("string") for a in AXIS], F.lit(""))
    axis = F.when(k % 25 == 24, F.concat_ws(TAB, F.lit(""), F.lit(""), F.lit("1.0"), F.lit("2.0"))).otherwise(axis)
    parts = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), line.alias("line")) for i, line in head], F.struct(F.lit(50).cast("long").alias("ord"), axis.alias("line"))))
    top = f.select("file_path", parts.alias("e")).select("file_path", "e.ord", "e.line").where("line is not null")
    return top.unionByName(body)


PATHS = f"""FP AS (SELECT *, CASE WHEN folder = 'H20' THEN concat('H20/R', sample_id, '_100_', 260301 + sample_id % 7, '.txt') ELSE concat(folder, '/S', subclass, '/R', sample_id, '_100_', 260301 + sample_id % 7, '.txt') END AS file_path,
  sample_id % 25 <> 24 AS axis_ok, CASE WHEN vec_id % 23 = 0 THEN 'bad_coord_row' WHEN vec_id % 17 = 0 THEN 'truncated_pixel_row' WHEN vec_id % 19 = 0 THEN 'nan_in_raw_spectrum' END AS reject
  FROM (SELECT *, [{', '.join(repr(f) for f in FOLDERS)}][CASE WHEN sample_id % 13 = 12 THEN 5 ELSE subclass % 4 + 1 END] AS folder FROM S))"""
KNOWN = "CASE folder WHEN 'H20' THEN 'H2O' WHEN 'STEC' THEN 'STEC' WHEN 'Non STEC' THEN 'Non-STEC' WHEN 'Salmonella' THEN 'Salmonella' END"


def written(spark, sf, name: str) -> str:
    """Write the derived lines as real files, one folder per sample, and return the root."""
    root = f"{shared_folder(spark)}/{name}_{abs(hash(sf)) % 10**8}"
    d = lines(spark, sf).withColumn("sample", F.regexp_extract("file_path", r"R(\d+)_", 1))
    d.repartition("sample").sortWithinPartitions("sample", "ord").select("sample", F.col("line").alias("value")).write.mode("overwrite").partitionBy("sample").text(root)
    return root


@query("i1_discover_files", sql("S", "SELECT DISTINCT CAST(sample_id AS BIGINT) AS sample FROM S"))
def i1(spark, sf):
    f = ins.discover(spark, written(spark, sf, "i1"))
    return f.select(F.regexp_extract("file_path", r"sample=(\d+)", 1).cast("long").alias("sample")).distinct()


@query("i1_read_lines", sql("S", "SELECT CAST(sample_id AS BIGINT) AS sample, 8 + count(*) + CASE WHEN sample_id % 9 = 3 THEN 0 ELSE 1 END AS n_lines, true AS in_order FROM S GROUP BY sample_id"))
def i1_lines(spark, sf):
    t = ins.read_lines(spark, written(spark, sf, "i1b")).withColumn("sample", F.regexp_extract("file_path", r"sample=(\d+)", 1).cast("long"))
    starts = ins.body_start(t).select("file_path", "axis_ord", "axis_line")
    last_header = t.where("line like '#%'").groupBy("file_path").agg(F.max("ord").alias("h"))
    n = t.groupBy("sample", "file_path").agg(F.count(F.lit(1)).alias("n_lines"))
    j = n.join(starts, "file_path").join(last_header, "file_path")
    return j.select("sample", "n_lines", ((F.col("h") < F.col("axis_ord")) & F.startswith("axis_line", F.lit(TAB))).alias("in_order"))


@query("i2_classify_path", sql("S", f"SELECT DISTINCT file_path, concat('R', sample_id, '_100_', 260301 + sample_id % 7) AS file_id, {KNOWN} AS primary_class, CASE WHEN folder IN ('STEC', 'Non STEC', 'Salmonella') THEN concat('S', subclass) END AS subclass, CASE WHEN {KNOWN} IS NULL THEN concat('unknown_class_folder:', folder) END AS layout_error FROM FP", PATHS))
def i2(spark, sf):
    return ins.classify(lines(spark, sf).select("file_path").distinct())


@query(
    "i3_header_fields",
    sql("S", """SELECT DISTINCT file_path, CAST(CASE WHEN sample_id % 9 <> 3 THEN 5 ELSE -1 END AS INTEGER) AS header_numx, 4 AS header_numy, '785nm' AS laser, CAST(sample_id * 10 AS DOUBLE) AS exposure_ms, '2026-03-01' AS acquisition_date,
       CAST(NULL AS DOUBLE) AS xsize, CASE WHEN sample_id % 9 = 3 THEN 'missing_numx_header' ELSE '' END AS warnings FROM FP""", PATHS),
)
def i3(spark, sf):
    t = lines(spark, sf)
    h = ins.header_fields(ins.header_entries(t, ins.body_start(t)))
    return h.select("file_path", F.coalesce("header_numx", F.lit(-1)).alias("header_numx"), "header_numy", "laser", "exposure_ms", "acquisition_date", "xsize", F.array_join("header_warnings", ",").alias("warnings"))


@query("i4_date_from_text", sql("S", "SELECT DISTINCT file_path, CASE WHEN sample_id % 4 = 1 THEN 'manual' ELSE concat(lpad(CAST(sample_id % 7 + 1 AS VARCHAR), 2, '0'), '.03.2026 07:48:36') END AS ac_calibration_date FROM FP", PATHS))
def i4(spark, sf):
    t = lines(spark, sf)
    return ins.header_fields(ins.header_entries(t, ins.body_start(t))).select("file_path", "ac_calibration_date")


@query("i5_axis_row", sql("S", "SELECT DISTINCT file_path, CAST(CASE WHEN axis_ok THEN 64 ELSE 2 END AS INT) AS n, CASE WHEN axis_ok THEN 76e0 + 3 * (sample_id % 3) ELSE 1 END AS wn_start, CASE WHEN NOT axis_ok THEN 'wn_axis_size:2!=64' END AS axis_error FROM FP", PATHS))
def i5(spark, sf):
    a = ins.parse_axis(ins.body_start(lines(spark, sf)), BINS)
    return a.select("file_path", F.size("axis").alias("n"), F.element_at("axis", 1).alias("wn_start"), "axis_error")


def parsed(spark, sf):
    t = lines(spark, sf)
    axes = ins.parse_axis(ins.body_start(t), BINS)
    return ins.parse_pixels(t, axes), axes


@query("i6_pixel_rows", sql("S", "SELECT file_path, pixel_idx, CASE WHEN vec_id % 23 <> 0 THEN CAST(pixel_idx % 5 AS DOUBLE) END AS x_um, CAST(pixel_idx // 5 AS DOUBLE) AS y_um, CASE WHEN reject IS NULL THEN round((SELECT sum(round(1500 + 5000 * CAST(v AS DOUBLE), 2)) FROM unnest(embedding) t(v)), 2) END AS total, reject FROM FP WHERE axis_ok", PATHS))
def i6(spark, sf):
    p, _ = parsed(spark, sf)
    total = F.when(F.col("reject").isNull(), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 2))
    return p.select("file_path", (F.col("ord") - 100).alias("pixel_idx"), "x_um", "y_um", total.alias("total"), "reject")


@query("i6_rejects", sql("S", "SELECT file_path, reject, count(*) AS n FROM FP WHERE axis_ok AND reject IS NOT NULL GROUP BY ALL", PATHS))
def i6_rejects(spark, sf):
    return ins.rejects(parsed(spark, sf)[0])


GRID = "GR AS (SELECT file_path, count(*) AS n_pixels, count(DISTINCT pixel_idx % 5) AS grid_nx, count(DISTINCT pixel_idx // 5) AS grid_ny FROM FP WHERE axis_ok AND reject IS NULL GROUP BY file_path)"


@query("i7_grid", sql("S", "SELECT file_path, n_pixels, grid_nx, grid_ny, n_pixels >= grid_nx * grid_ny AS is_complete_scan, CASE WHEN n_pixels < grid_nx * grid_ny THEN concat('partial_scan:', n_pixels, '/', grid_nx * grid_ny) END AS scan_warning FROM GR", PATHS, GRID))
def i7(spark, sf):
    return ins.grid(parsed(spark, sf)[0])


RESAMPLED = """RS AS (SELECT file_path, pixel_idx, pos, CASE WHEN sample_id % 3 = 0 OR pos = 0 THEN v1 ELSE v0 + ((3423e0 / 63) - 3 * (sample_id % 3)) / (3423e0 / 63) * (v1 - v0) END AS y FROM (
  SELECT file_path, pixel_idx, sample_id, p.pos AS pos, round(1500 + 5000 * CAST(embedding[p.pos + 1] AS DOUBLE), 2) AS v1, round(1500 + 5000 * CAST(embedding[greatest(p.pos, 1)] AS DOUBLE), 2) AS v0
  FROM FP, range(64) p(pos) WHERE axis_ok AND reject IS NULL))"""


@query("i8_resample", sql("S", "SELECT file_path, pixel_idx, pos, round(y, 4) AS y FROM RS", PATHS, RESAMPLED))
def i8(spark, sf):
    p, axes = parsed(spark, sf)
    out = ins.resample(p.where("reject is null"), axes, AXIS)
    return out.select("file_path", (F.col("ord") - 100).alias("pixel_idx"), F.posexplode_outer("y").alias("pos", "v")).select("file_path", "pixel_idx", F.col("pos").cast("long").alias("pos"), F.round("v", 4).alias("y"))


@query(
    "i8b_resample_unsorted_axis",
    sql("S", "SELECT vec_id, p.pos AS pos, round(CAST(embedding[64 - p.pos] AS DOUBLE), 6) + 0.0 AS y FROM S, range(64) p(pos)"),
)
def i8b(spark, sf):
    s = series(spark, sf).select("vec_id", "y", (F.col("vec_id") % 2).cast("string").alias("file_path"))
    falling = F.array(*[F.lit(a) for a in reversed(AXIS)])
    axes = s.select("file_path").distinct().withColumn("axis", falling)
    out = ins.resample(s, axes, AXIS)
    return out.select("vec_id", F.posexplode_outer("y").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), r("v").alias("y"))


@query("i9_cap_rows", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat('0|', user_id, '|{"ord":', event_id, '}')), event_id) AS rn FROM events) WHERE rn <= 20""")
def i9(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("file_path"), F.col("event_id").alias("ord"), F.lit(None).cast("string").alias("reject"))
    return ins.cap_rows(e, 20).select(F.col("file_path").alias("user_id"), F.col("ord").alias("event_id"))


@query("i9_pixel_index", sql("S", "SELECT file_path, pixel_idx AS ord, row_number() OVER (PARTITION BY file_path ORDER BY pixel_idx) - 1 AS pixel_idx FROM FP WHERE axis_ok AND reject IS NULL", PATHS))
def i9_index(spark, sf):
    p = parsed(spark, sf)[0].where("reject is null")
    n = ins.number_rows(p, F.floor(F.col("ord") / 8))
    return n.select("file_path", (F.col("ord") - 100).alias("ord"), "pixel_idx")


@query("i10_two_column_series", sql("S", "SELECT vec_id, p.pos AS pos, 76e0 + p.pos * 3423e0 / 63 AS wn, round(1500 + 5000 * CAST(embedding[p.pos + 1] AS DOUBLE), 2) AS y FROM S, range(64) p(pos)"))
def i10(spark, sf):
    s = series(spark, sf).select(F.col("vec_id").cast("string").alias("file_path"), F.posexplode_outer("y").alias("pos", "v"))
    wn = F.lit(76.0) + F.col("pos") * F.lit(3423.0) / F.lit(63)
    # points come in falling order and must be sorted
    t = s.select("file_path", (F.lit(1000) - F.col("pos")).alias("ord"), F.concat_ws(TAB, wn.cast("string"), F.format_number(F.round(1500 + 5000 * F.col("v"), 2), 2)).alias("line"))
    t = t.unionByName(s.select("file_path").distinct().select("file_path", F.lit(0).alias("ord"), F.lit("#Laser=\t785nm").alias("line")))
    out = ins.two_column_series(t, ins.body_start(t))
    return out.select(F.col("file_path").cast("long").alias("vec_id"), F.posexplode_outer(F.arrays_zip("axis", "y")).alias("pos", "e")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("e.axis").alias("wn"), F.col("e.y").alias("y"))


@query("i11_region_coverage", "SELECT o_orderkey, round(greatest(0, least(1800, hi) - greatest(400, lo)) / 1400e0 * 100, 6) AS fingerprint, round(greatest(0, least(3050, hi) - greatest(2800, lo)) / 250e0 * 100, 6) AS ch FROM (SELECT o_orderkey, 300 + o_orderkey % 900 AS lo, 1500 + o_orderkey % 1700 AS hi FROM orders)")
def i11(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", (300 + k % 900).cast("double").alias("lo"), (1500 + k % 1700).cast("double").alias("hi"))
    cov = lambda a, b: F.round(ins.coverage_pct(F.col("lo"), F.col("hi"), a, b), 6)
    return o.select("o_orderkey", cov(400.0, 1800.0).alias("fingerprint"), cov(2800.0, 3050.0).alias("ch"))


@query("i12_changed_files", sql("S", "SELECT DISTINCT sample_id AS sample, CASE WHEN sample_id % 5 = 0 THEN 'new' ELSE 'changed' END AS why FROM S WHERE sample_id % 5 IN (0, 1)"))
def i12(spark, sf):
    found = ins.discover(spark, written(spark, sf, "i12")).withColumn("sample", F.regexp_extract("file_path", r"sample=(\d+)", 1).cast("long"))
    known = found.where("sample % 5 <> 0").withColumn("file_size_bytes", F.when(F.col("sample") % 5 == 1, F.col("file_size_bytes") + 1).otherwise(F.col("file_size_bytes")))
    return mf.changed(found, known).select("sample", F.when(F.col("sample") % 5 == 0, "new").otherwise("changed").alias("why")).distinct()


@query("i12_content_hash", "SELECT doc_id, sha256(text) AS file_sha256 FROM documents")
def i12_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_sha256"))


SINK_SQL = sql("S", "SELECT vec_id, cls, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS y0 FROM S")


def _sink(spark, sf):
    return series(spark, sf).select("vec_id", "cls", r(F.col("y")[0]).alias("y0"))


@query("i13_sink_parquet", SINK_SQL)
def i13_parquet(spark, sf):
    path = f"{shared_folder(spark)}/sink_parquet_{abs(hash(sf)) % 10**8}"
    sinks.write_parquet(_sink(spark, sf), path, ["cls"])
    return spark.read.parquet(path).select("vec_id", F.col("cls").cast("long").alias("cls"), "y0")


@query("i13_sink_json_lines", SINK_SQL)
def i13_json(spark, sf):
    path = f"{shared_folder(spark)}/sink_json_{abs(hash(sf)) % 10**8}"
    sinks.write_json_lines(_sink(spark, sf), path)
    return spark.read.schema("vec_id long, cls long, y0 double").json(path)


@query("i13_sink_csv", SINK_SQL)
def i13_csv(spark, sf):
    path = f"{shared_folder(spark)}/sink_csv_{abs(hash(sf)) % 10**8}"
    sinks.write_csv(_sink(spark, sf), path)
    return spark.read.option("header", True).schema("vec_id long, cls long, y0 double").csv(path)


def meta(spark, sf):
    t = lines(spark, sf)
    files = ins.classify(t.select("file_path").distinct())
    return ins.metadata(files, t, BINS, cap=8)[0]


META = f"""ME AS (SELECT file_path, any_value({KNOWN}) AS primary_class, any_value(sample_id) AS sample_id, bool_and({KNOWN} IS NULL OR NOT axis_ok) OR count(*) FILTER (reject IS NULL) = 0 AS fatal,
  count(*) FILTER (reject IS NULL AND axis_ok) AS n, count(*) FILTER (reject IS NOT NULL AND axis_ok) AS n_bad, count(DISTINCT pixel_idx % 5) FILTER (reject IS NULL AND axis_ok) AS nx, count(DISTINCT pixel_idx // 5) FILTER (reject IS NULL AND axis_ok) AS ny FROM FP GROUP BY file_path)"""


@query("i14_build_summary", sql("S", "SELECT count(*) AS n_files, count(*) FILTER (fatal) AS n_fatal, count(*) FILTER (NOT fatal AND (n_bad > 0 OR n > 8 OR n < nx * ny OR sample_id % 9 = 3)) AS n_warned, CAST(coalesce(sum(least(n, 8)) FILTER (NOT fatal), 0) AS BIGINT) AS n_spectra FROM ME", PATHS, META))
def i14(spark, sf):
    return ins.build_summary(meta(spark, sf))


@query("i15_inventory", sql("S", "SELECT primary_class, count(*) AS n_files, count(*) FILTER (n > 8) AS n_capped, count(*) FILTER (n < nx * ny) AS n_partial, count(*) FILTER ((sample_id % 9 <> 3 AND nx <> 5) OR ny <> 4) AS n_header_mismatch FROM ME GROUP BY primary_class", PATHS, META))
def i15(spark, sf):
    return ins.inventory(meta(spark, sf))


@query("i16_run_log", "SELECT DISTINCT lang AS model, source AS protocol, CAST(doc_id % 3 AS BIGINT) AS seed, substr(sha1(concat(lang, '|', source, '|', doc_id % 3)), 1, 8) AS run_id FROM documents")
def i16(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("model"), F.col("source").alias("protocol"), (F.col("doc_id") % 3).alias("seed")).distinct()
    return d.withColumn("run_id", mf.run_id("model", "protocol", "seed"))
