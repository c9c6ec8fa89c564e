"""The three end-to-end jobs: files to feature store, fold evaluation, scoring of new files.

Every stage is one table written to the store, so a later stage starts from a file, not from a long
lineage, and a lost executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.operators import features as ft
from wavetable.operators import gates as gt
from wavetable.operators import models as ml
from wavetable.operators import quality as qc
from wavetable.operators import refit, rollup, splits, unmix
from wavetable.operators.clean import clean
from wavetable.operators.relate import pad_columns, sanitise
from wavetable.plans import scoring
from wavetable.session import materialise
from wavetable.sources import instrument as ins
from wavetable.sources.sinks import write_json_lines, write_parquet

c = F.col
KEY = ["file_id", "pixel_idx"]
LABELS = ["primary_class", "subclass"]


def ingest(spark: SparkSession, root: str, *, axis: Sequence[float] | None = None, n_bins: int = catalog.AXIS_POINTS, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata per file and keyed series on the common axis."""
    axis = axis or catalog.reference_axis()
    files = ins.classify(ins.discover(spark, root), root if "://" in root or root.startswith("file:") else f"file:{root}")
    meta, parsed, axes = ins.metadata(files, ins.read_lines(spark, root), n_bins, cap)
    good = parsed.where("reject is null").drop("reject")
    rows = ins.cap_rows(parsed, cap) if cap else good
    rows = ins.number_rows(rows, F.floor(c("ord") / ins.LINES_PER_BUCKET))
    named = meta.where(F.size("fatal_errors") == 0).select("file_path", "file_id", *LABELS)
    spectra = ins.resample(rows, axes, axis).join(named, "file_path")
    return meta, spectra.select(*KEY, *LABELS, "x_um", "y_um", "y")


def build_store(
    spark: SparkSession, root: str, out: str, *, axis: Sequence[float] | None = None, n_bins: int = catalog.AXIS_POINTS, cap: int | None = None,
    snr_threshold: float = 5.0, components: int = 8, half_width: float = 10.0, window: float = 30.0, enforce: bool = True, **clean_options,
) -> DataFrame:
    """Files to feature store: metadata, spectra, clean (with keep), four feature tables, contract report."""
    axis = list(axis or catalog.reference_axis())
    read = lambda name: spark.read.parquet(f"{out}/{name}")

    meta, spectra = ingest(spark, root, axis=axis, n_bins=n_bins, cap=cap)
    write_parquet(meta, f"{out}/metadata")
    write_parquet(spectra, f"{out}/spectra")

    masked = qc.with_keep(read("spectra"), "file_id", "y", axis, snr_threshold=snr_threshold)
    cleaned, short = clean(masked, axis, **clean_options)
    write_parquet(cleaned.select(*KEY, *LABELS, "x_um", "y_um", "y", "snr", "background", "keep"), f"{out}/clean")

    kept = read("clean").where("keep").select(*KEY, *LABELS, "y")
    write_parquet(ft.band_frame(kept, "y", short, half_width=half_width, window=window).drop("y", *LABELS), f"{out}/band_features")
    labelled = kept.withColumn("subclass", F.coalesce("subclass", F.lit("H2O")))
    write_parquet(ft.spectral_frame(labelled, "y", short, label="primary_class", sublabel="subclass").drop("y", *LABELS), f"{out}/spectral_features")
    write_parquet(rollup.spatial_frame(kept, "file_id", "y", short, half_width), f"{out}/spatial_features")

    shifted = unmix.shift_non_negative(kept, "y")
    fit = unmix.fit(shifted, "y", components)
    write_parquet(unmix_frame(shifted, fit), f"{out}/unmix_features")

    report = contract(spark, out, axis, short, snr_threshold)
    write_json_lines(report, f"{out}/contract")
    if enforce:
        gt.enforce(report)
    return report


def unmix_frame(shifted: DataFrame, fit: unmix.Unmixing) -> DataFrame:
    """Abundance summary per file, one column per component and statistic, and the mean residual."""
    scored = unmix.residual(unmix.concentrations(shifted, "y", fit.spectra), "y", fit.spectra)
    k = len(fit.spectra)
    stats = unmix.abundance_summary(scored, "file_id")
    wide = stats.groupBy("file_id").agg(
        *[F.max(F.when(c("component") == i + 1, c(s))).alias(f"mcr_C{i + 1}_{s}") for i in range(k) for s in ("mean", "std", "max", "p90")]
    )
    return wide.join(scored.groupBy("file_id").agg(F.avg("residual_norm").alias("mcr_residual_norm_mean")), "file_id")


def contract(spark: SparkSession, out: str, axis: Sequence[float], short: Sequence[float], snr_threshold: float = 5.0) -> DataFrame:
    """All gates over the stored tables."""
    t = {n: spark.read.parquet(f"{out}/{n}") for n in ("metadata", "spectra", "clean", "band_features", "spectral_features", "unmix_features", "spatial_features")}
    kept = t["clean"].where("keep")
    files = kept.select("file_id").distinct()
    per_row = [x for x in t["band_features"].columns if x not in KEY]
    gates = [
        gt.width(t["spectra"], "y", len(axis)),
        gt.width(t["clean"], "y", len(short)),
        gt.no_fatal_errors(t["metadata"], "fatal_errors"),
        gt.rows_match(t["clean"], t["spectra"], "clean_rows_match"),
        gt.funnel_reconciles(qc.funnel(t["clean"], snr_threshold), t["clean"]),
        gt.retention_floor(qc.retention_by(t["clean"], "file_id"), "file_id"),
        gt.rows_match(t["band_features"], kept, "band_rows_equal_kept"),
        gt.no_nulls(t["band_features"], per_row, 0.01, "band_null_rows", gt.WARN),
        gt.rows_match(t["spectral_features"], kept, "spectral_rows_equal_kept"),
        gt.per_file_integrity(t["unmix_features"], files, "file_id", "unmix_per_file"),
        gt.per_file_integrity(t["spatial_features"], files, "file_id", "spatial_per_file"),
        gt.store_gates(t["clean"], gt.Store("clean", tuple(KEY), ("primary_class",), 1.0)),
    ]
    return gt.report(gates)


def file_features(spark: SparkSession, out: str) -> tuple[DataFrame, list[str]]:
    """One feature row per file: pooled row features, unmixing and spatial columns; labels kept."""
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    labels = read("metadata").where(F.size("fatal_errors") == 0).select("file_id", *LABELS)
    table, names = labels, []
    for name in ("band_features", "spectral_features"):
        t = read(name)
        cols = [x for x in t.columns if x not in KEY]
        table, names = table.join(rollup.mean_pool(t, ["file_id"], cols), "file_id"), names + cols
    for name in ("unmix_features", "spatial_features"):
        t = read(name)
        cols = [x for x in t.columns if x != "file_id"]
        table, names = table.join(t, "file_id", "left"), names + cols
    return table, names


def with_labels(table: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Class index in canonical order as ``y_true``."""
    return table.withColumn("y_true", F.coalesce(*[F.when(c("primary_class") == k, F.lit(i)) for i, k in enumerate(classes)]).cast("long"))


def kept_series(spark: SparkSession, out: str, classes: Sequence[str]) -> DataFrame:
    """Clean series that passed the quality gate, with the class index; files without subclass count as one of their class."""
    kept = spark.read.parquet(f"{out}/clean").where("keep").withColumn("subclass", F.coalesce("subclass", "primary_class"))
    return with_labels(kept, classes).where("y_true is not null").select("file_id", "pixel_idx", "primary_class", "subclass", "y_true", "x_um", "y_um", "y")


def evaluate_folds(spark: SparkSession, out: str, axis: Sequence[float], classes: Sequence[str], *, k: int = 5, half_width: float = 10.0, window: float = 30.0, regions: dict | None = None, components: int = 8, iterations: int = 80, **options) -> DataFrame:
    """File-level k-fold without leaks: everything that learns (components, templates, scatter reference, unmixing, feature choice, models)
    is fitted on each training side only.  ``axis``: that of the clean series.  One row per algorithm, seed and file.
    """
    kept = kept_series(spark, out, classes)
    folds = splits.stratified_folds(kept.select("file_id", "primary_class").distinct(), "file_id", "primary_class", k).select("file_id", "test_fold")
    s = materialise(kept.join(folds, "file_id"), "folded")
    fits = refit.fit_folds(s, "y", axis, "test_fold", "y_true", "subclass", regions=regions, components=components, iterations=iterations)
    table, _ = refit.fold_features(s, "y", axis, fits, "file_id", ["test_fold", "y_true"], scoring.fixed_families(axis, half_width, window))
    return refit.evaluate(table, "file_id", "test_fold", "y_true", len(classes), **options)


def score(table: DataFrame, features: Sequence[str], model, k: int, abstain_below: float = ml.ABSTAIN_BELOW) -> DataFrame:
    """Decision per file of a fitted model; absent or broken feature values count as zero."""
    t = sanitise(pad_columns(table, features), features).withColumn("label", F.lit(0.0))
    d = ml.assembled(t, features, "label")
    return ml.score_files(ml.probabilities(model.transform(d), k), "file_id", k, abstain_below)
