"""Text files to decisions, end to end, on a short axis."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.operators import gates as gt
from wavetable.operators import models as ml
from wavetable.plans import flows, scoring

AXIS = [float(x) for x in np.linspace(76, 3499, 420)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("maps"), tmp_path_factory.mktemp("store")
    rng = np.random.default_rng(0)
    x = np.array(AXIS)
    centers = {"H20": 1640, "STEC/O1": 1004, "Non STEC/N1": 1450, "Salmonella/D1": 1100}
    for folder, ctr in centers.items():
        for f in range(4):
            p = root / folder / f"R{f}_{folder[:2]}_260301.txt"
            p.parent.mkdir(parents=True, exist_ok=True)
            lines = ["#NUMX=\t3", "#NUMY=\t2", "#AC=\tCalibrated 05.03.2026 07:48:36", "\t".join(["", "", *[f"{a:.3f}" for a in x]])]
            for i in range(8):
                y = 1000 + 4000 * np.exp(-(((x - ctr) / 40) ** 2)) + 2000 * np.exp(-(((x - 2900) / 60) ** 2)) + rng.normal(0, 10, len(x))
                lines.append("\t".join([str(i % 3), str(i // 3), *[f"{v:,.2f}" for v in y]]))
            p.write_text("\n".join(lines) + "\n")
    report = flows.build_store(
        spark, str(root), str(out), axis=AXIS, n_bins=len(AXIS), cap=6, components=3, half_width=20.0, window=40.0,
    )
    return str(out), report


def test_store_passes_its_contract(spark, store):
    out, report = store
    rows = {r.gate: r for r in report.collect()}
    assert all(r.passed for r in rows.values() if r.severity == gt.ERROR), rows
    assert spark.read.parquet(f"{out}/spectra").count() == 16 * 6
    assert spark.read.parquet(f"{out}/metadata").where("array_contains(warnings, 'pixel_capped:8->6')").count() == 16
    assert len(spark.read.parquet(f"{out}/band_features").columns) == 166 + 2


SHORT = catalog.crop_axis(AXIS)
WIDTHS = {"half_width": 20.0, "window": 40.0}


def test_leak_free_folds_find_the_planted_classes(spark, store):
    pred = flows.evaluate_folds(spark, store[0], SHORT, catalog.CLASS_ORDER, k=2, components=3, iterations=10, rounds=5, depth=2, **WIDTHS).collect()
    assert len(pred) == 3 * 16
    for a in ("latent", "logistic"):
        assert sum(r["pred"] == r["y_true"] for r in pred if r["algorithm"] == a) >= 14


def test_feature_table_of_the_store_scores(spark, store):
    table, names = flows.file_features(spark, store[0])
    table = table.cache()
    t = flows.sanitise(flows.with_labels(table, catalog.CLASS_ORDER), names)
    model = ml.logistic().fit(ml.balanced(ml.assembled(t, names, "y_true"), "label"))
    out = flows.score(table.drop(names[0]), names, model, 4)
    assert out.count() == 16 and set(r.decision for r in out.collect()) <= {"0", "1", "2", "3", "abstain"}


@pytest.fixture(scope="module")
def saved(spark, store, tmp_path_factory):
    kept = flows.kept_series(spark, store[0], catalog.CLASS_ORDER)
    model = scoring.train(kept, AXIS, SHORT, catalog.CLASS_ORDER, components=3, iterations=10, **WIDTHS)
    path = str(tmp_path_factory.mktemp("model") / "m")
    scoring.save(spark, model, path)
    return model, path


def test_a_saved_model_is_the_trained_one(spark, store, saved):
    model, path = saved
    back = scoring.load(spark, path)
    kept = flows.kept_series(spark, store[0], catalog.CLASS_ORDER)
    a, b = ({r["file_id"]: r for r in scoring.score(kept, m, preprocess=False).collect()} for m in (model, back))
    assert a == b and len(a) == 16
    truth = {r["file_id"]: r["y_true"] for r in kept.select("file_id", "y_true").distinct().collect()}
    assert sum(a[f]["pred"] == t for f, t in truth.items()) == 16


def test_a_file_scores_alike_alone_and_in_a_batch(spark, store, saved):
    model, _ = saved
    raw = spark.read.parquet(f"{store[0]}/spectra").select("file_id", "y")
    whole = {r["file_id"]: r for r in scoring.score(raw, model).collect()}
    name = sorted(whole)[3]
    alone = scoring.score(raw.where(F.col("file_id") == name), model).first()
    assert [alone[f"p{i}"] for i in range(4)] == pytest.approx([whole[name][f"p{i}"] for i in range(4)], abs=1e-9)
    assert alone["decision"] == whole[name]["decision"]


def test_new_files_are_scored_once(spark, saved, tmp_path):
    _, path = saved
    rng = np.random.default_rng(7)
    x = np.array(AXIS)

    def drop(name, center):
        lines = ["\t".join(["", "", *[f"{a:.3f}" for a in x]])]
        for i in range(8):
            y = 1000 + 4000 * np.exp(-(((x - center) / 40) ** 2)) + 2000 * np.exp(-(((x - 2900) / 60) ** 2)) + rng.normal(0, 10, len(x))
            lines.append("\t".join([str(i), "0", *[f"{v:,.2f}" for v in y]]))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    run = lambda: scoring.score_stream(spark, str(tmp_path / "in"), path, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = lambda: {r["file_path"].rsplit("/", 1)[1]: r["decision"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    drop("one.txt", 1004)
    run()
    assert got() == {"one.txt": "STEC"}
    drop("two.txt", 1100)
    run()
    assert got() == {"one.txt": "STEC", "two.txt": "Salmonella"}


def test_a_damaged_feature_table_blocks(spark, store):
    out = store[0]
    kept = spark.read.parquet(f"{out}/clean").where("keep")
    cut = spark.read.parquet(f"{out}/band_features").limit(kept.count() - 5)
    with pytest.raises(gt.GateFailure):
        gt.enforce(gt.rows_match(cut, kept, "band_rows_equal_kept"))
