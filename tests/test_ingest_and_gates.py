"""Ingest of real text files, manifest, sinks and blocking gates."""

import pytest
from pyspark.sql import functions as F

from wavetable.operators import gates as gt
from wavetable.operators import relate
from wavetable.sources import instrument as ins
from wavetable.sources import manifest as mf
from wavetable.sources import sinks

AXIS = ["1", "2", "3", "4"]


def write(root, rel, *rows, header=("#NUMX=\t2", "#NUMY=\t2", "#AC=\tCalibrated 05.03.2026 07:48:36", "#XSIZE=\tbad", "#Note=\ta=b")):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join([*header, *rows]) + ("\n" if rows or header else ""))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("maps")
    axis = "\t".join(["", "", *AXIS, ""])
    write(r, "STEC/O1/R1_100_260306.txt", axis, "0\t0\t10\t20\t40\t1,034.00", "0\t1\t1\t2\t3\t4\t", "1\t0\t1\t2\t3", "1\t1\t1\t\t3\t4", "x\t1\t1\t2\t3\t4", "", "#\tlate\tline\t1\t2\t3\t4")
    write(r, "H20/W1.xls", axis, *[f"{i}\t0\t1\t2\t3\t{i}" for i in range(5)], header=("#Laser=\t785",))
    write(r, "Other/X.txt", axis, "0\t0\t1\t2\t3\t4")
    write(r, "STEC/O1/short.txt", "\t\t1\t2", "0\t0\t1\t2")
    write(r, "STEC/O1/falling.txt", "\t\t4\t3\t2\t1", "0\t0\t1\t2\t3\t4")
    write(r, "STEC/O1/empty.txt", header=("#NUMX=\t2",))
    write(r, "STEC/O1/ignored.csv", "a")
    return r


@pytest.fixture(scope="module")
def built(spark, root):
    lines = ins.read_lines(spark, str(root))
    files = ins.classify(ins.discover(spark, str(root)), f"file:{root}")
    meta, parsed, axes = ins.metadata(files, lines, 4, cap=3)
    return {r.file_id: r for r in meta.collect()}, parsed, axes


def test_files_classes_and_fatal_errors(built):
    m, _, _ = built
    assert set(m) == {"R1_100_260306", "W1", "X", "short", "falling", "empty"}
    assert (m["R1_100_260306"].primary_class, m["R1_100_260306"].subclass) == ("STEC", "O1")
    assert (m["W1"].primary_class, m["W1"].subclass) == ("H2O", None)
    assert m["X"].fatal_errors == ["unknown_class_folder:Other"]
    assert m["short"].fatal_errors == ["wn_axis_size:2!=4"]
    assert m["falling"].fatal_errors == ["wn_not_monotonic"]
    assert m["empty"].fatal_errors == ["no_data_rows"]


def test_header_and_warnings(built):
    m, _, _ = built
    r = m["R1_100_260306"]
    assert r.ac_calibration_date == "05.03.2026 07:48:36" and r.xsize is None and r.header_numx == 2
    assert sorted(r.warnings) == ["bad_coord_row:2", "nan_in_raw_spectrum:1", "truncated_pixel_row:1"]
    assert r.n_pixels == 2 and r.grid_nx == 1 and r.grid_ny == 2 and r.is_complete_scan
    w = m["W1"]
    assert "missing_numx_header" in w.warnings and "pixel_capped:5->3" in w.warnings and w.n_pixels == 3


def test_cells(built):
    _, parsed, _ = built
    got = {(r.x_um, r.y_um): r for r in parsed.where("file_path like '%R1_100%'").collect()}
    assert got[(0.0, 0.0)].y == [10.0, 20.0, 40.0, 1034.0] and got[(0.0, 0.0)].reject is None
    assert got[(1.0, 1.0)].reject == "nan_in_raw_spectrum" and got[(1.0, 0.0)].reject == "truncated_pixel_row"


def test_number(spark):
    df = spark.createDataFrame([("1,034.00",), ("",), ("abc",)], "t string")
    assert [r[0] for r in df.select(ins.number(F.col("t"))).collect()] == [1034.0, None, None]


def test_resample_fixture(spark):
    rows = spark.createDataFrame([("f", [10.0, 20.0, 40.0, 80.0])], "file_path string, y array<double>")
    axes = spark.createDataFrame([("f", [1.0, 2.0, 3.0, 4.0])], "file_path string, axis array<double>")
    assert ins.resample(rows, axes, [0.0, 1.0, 2.5, 9.0]).first().y == [10.0, 10.0, 30.0, 80.0]
    falling = spark.createDataFrame([("f", [4.0, 3.0, 2.0, 1.0])], "file_path string, axis array<double>")
    back = spark.createDataFrame([("f", [80.0, 40.0, 20.0, 10.0])], "file_path string, y array<double>")
    assert ins.resample(back, falling, [0.0, 1.0, 2.5, 9.0]).first().y == [10.0, 10.0, 30.0, 80.0]


def test_coverage_fixture(spark):
    r = spark.range(1).select(ins.coverage_pct(F.lit(502.0), F.lit(2699.0), 400.0, 1800.0), ins.coverage_pct(F.lit(502.0), F.lit(2699.0), 2800.0, 3050.0)).first()
    assert r[0] == pytest.approx(92.714286, abs=1e-6) and r[1] == 0


def test_cap_keeps_everything_below_and_exactly_n_above(spark):
    d = spark.createDataFrame([("a", i, None) for i in range(500)] + [("b", i, None) for i in range(7)], "file_path string, ord long, reject string")
    n = {r.file_path: r["count"] for r in ins.cap_rows(d, 200).groupBy("file_path").count().collect()}
    assert n == {"a": 200, "b": 7}


def test_manifest(spark, root):
    found = ins.discover(spark, str(root))
    assert mf.changed(found, found).count() == 0
    touched = found.withColumn("file_size_bytes", F.col("file_size_bytes") + F.when(F.col("file_path").endswith("W1.xls"), 1).otherwise(0))
    assert [r.file_path.rsplit("/", 1)[1] for r in mf.changed(found, touched).collect()] == ["W1.xls"]
    hashes = mf.content_hashes(spark, str(root))
    assert mf.differing_content(hashes, hashes).count() == 0


def test_streaming_reads_each_file_once(spark, tmp_path):
    from wavetable.streaming.ingest import ingest_new_files

    def run():
        ingest_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b.select("file_path", "line"))

    write(tmp_path / "in", "a.txt", "1\t2", header=())
    run()
    write(tmp_path / "in", "b.txt", "3\t4", "5\t6", header=())
    run()
    run()
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1\t2", "3\t4", "5\t6"]


def test_csv_sink_writes_arrays_as_text(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, ["a", "b"])], "id long, w array<string>"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["w"] == '["a","b"]'


def test_run_log_appends(spark, tmp_path):
    runs = spark.createDataFrame([("m", "loso", 1)], "model string, protocol string, seed long").withColumn("run_id", mf.run_id("model", "protocol", "seed"))
    mf.append_runs(runs, str(tmp_path / "log"))
    mf.append_runs(runs, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_dropping_five_feature_rows_blocks(spark):
    rows = spark.range(100)
    ok = gt.report([gt.rows_match(rows, rows)])
    assert gt.enforce(ok) == []
    with pytest.raises(gt.GateFailure, match="95 rows and 100"):
        gt.enforce(gt.report([gt.rows_match(rows.where("id >= 5"), rows)]))


def test_warnings_do_not_block(spark):
    rep = gt.row(spark.range(1), "soft", F.lit(False), "x", gt.WARN)
    assert gt.enforce(rep) == ["soft"]


def test_published_funnel_reconciles(spark):
    f = spark.createDataFrame([(7999, 6, 871, 7122)], "n_input long, n_drop_snr long, n_drop_bg long, n_keep long")
    assert gt.funnel_reconciles(f).first().passed
    assert not gt.funnel_reconciles(f.withColumn("n_keep", F.lit(7121))).first().passed


def test_join_checked_fails_on_a_lost_or_doubled_key(spark):
    a, b = spark.range(3).withColumn("u", F.lit(1)), spark.range(2).withColumn("v", F.lit(2))
    with pytest.raises(Exception, match="lost or doubled"):
        relate.join_checked(a, b, ["id"]).collect()
    with pytest.raises(Exception, match="lost or doubled"):
        relate.join_checked(spark.range(2).withColumn("u", F.lit(1)), b.unionByName(b), ["id"]).collect()


def test_nearest_band_both_ways(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 112.0), (3, 200.0)], "id long, p double")
    cat = {"a": 95.0, "b": 110.0, "c": 500.0}
    small = {r.id: r.band for r in relate.nearest_band(df, "p", cat).collect()}
    table = spark.createDataFrame(list(cat.items()), "name string, center double")
    cells = {r.id: r.band for r in relate.nearest_band_by_cells(df, "p", table, 25.0).collect()}
    assert small == cells == {1: "a", 2: "b", 3: None}


def test_line_numbers_and_samples_do_not_depend_on_the_split(spark, tmp_path):
    import random

    r = random.Random(1)
    body = [f"{i}\t{i % 7}\t" + "\t".join(f"{r.random():.4f}" for _ in range(30)) for i in range(900)]
    (tmp_path / "H20").mkdir()
    for name in ("a", "b"):
        (tmp_path / "H20" / f"{name}.txt").write_text("\n".join(["#NUMX=\t2", "\t\t" + "\t".join(map(str, range(30))), *body]) + "\n")
    seen, samples = [], []
    for size in ("128m", "9k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = ins.read_lines(spark, str(tmp_path))
            seen.append(sorted((x.file_path, x.ord, x.line) for x in lines.collect()))
            parsed = ins.parse_pixels(lines, ins.parse_axis(ins.body_start(lines), 30))
            samples.append(sorted((x.file_path, x.ord, x.x_um) for x in ins.cap_rows(parsed, 50).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and [x[1] for x in seen[0][:902]] == list(range(902)) and seen[0][2][2] == body[0]
    assert samples[0] == samples[1] and len(samples[0]) == 100


def test_no_sort_or_shuffle_carries_text(spark, root):
    lines = ins.read_lines(spark, str(root))
    plan = ins.parse_axis(ins.body_start(lines), 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and not any("Exchange hash" in x and "line#" in x for x in plan.splitlines())
