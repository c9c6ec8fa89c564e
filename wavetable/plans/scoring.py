"""A trained model with all its fits on disk, and the scoring of new files with it.

``train``         fit everything on a table of kept series and return a :class:`SavedModel`
``save, load``    the model as a small table of named JSON values
``score``         series of any number of files to one decision per file
``score_stream``  new export files under a folder to decisions, each file once

A file's features depend on its own rows and on the saved fits only, so a file scored alone and in a batch gets the
same probabilities.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.functions.series import row_map
from wavetable.operators import features as ft
from wavetable.operators import quality as qc
from wavetable.operators import refit
from wavetable.operators.clean import clean
from wavetable.operators.models import ABSTAIN_BELOW
from wavetable.operators.softmax import Softmax, fit_many, fold_moments, standardised, training_side
from wavetable.session import materialise
from wavetable.sources import instrument as ins
from wavetable.streaming.ingest import ingest_new_files


def fixed_families(axis: Sequence[float], half_width: float = 10.0, window: float = 30.0, levels: int = 6) -> list[ft.Family]:
    """Row features that learn nothing: band and group areas, peaks, region moments, derivative areas, wavelet energies."""
    picked = ft.on_axis(ft.band_centers(catalog.PEAK_BANDS), axis)
    areas = ft.area_weights(axis, ft.band_windows(ft.on_axis(ft.band_centers(), axis), half_width))
    linear = ft.linear_family({**ft.group_weights(axis, half_width=half_width), **areas}, len(axis))
    return [linear, ft.peak_family(axis, picked, window), ft.moments_family(axis), *[ft.derivative_family(axis, picked, d, half_width) for d in (1, 2)], ft.wavelet_family(len(axis), levels)]


@dataclass
class SavedModel:
    axis: list  # of the raw series; cleaning shortens it
    short: list
    classes: list
    fit: refit.FoldFit
    model: Softmax
    names: list
    options: dict = field(default_factory=dict)  # half_width, window, levels, snr_threshold, clean

    def families(self) -> list[ft.Family]:
        return fixed_families(self.short, self.options["half_width"], self.options["window"], self.options["levels"])


def train(df: DataFrame, axis: Sequence[float], short: Sequence[float], classes: Sequence[str], *, file: str = "file_id", label: str = "y_true", sublabel: str = "subclass", regions: dict | None = None, components: int = 8, iterations: int = 80, top: int = refit.TOP_FEATURES, reg: float = 0.01, half_width: float = 10.0, window: float = 30.0, levels: int = 6, snr_threshold: float = 5.0, clean_options: dict | None = None) -> SavedModel:
    """Fit on cleaned, kept series (file, label, sublabel, y on ``short``): fits of the features, their choice, and a balanced multinomial logistic on file means."""
    fold = "_part"
    s = materialise(df.select(file, label, sublabel, "y").withColumn(fold, F.lit(0)), "train")
    fit = refit.fit_folds(s, "y", short, fold, label, sublabel, regions=regions, components=components, iterations=iterations, everything=True)[refit.ALL]
    fixed = fixed_families(short, half_width, window, levels)
    table, names = refit.fold_features(s, "y", short, {refit.ALL: fit}, file, [label], fixed)
    table = table.withColumn(fold, F.lit("rows"))
    selected = refit.select_features(table, fold, label, top)[refit.ALL]
    n, mean, cov = training_side(fold_moments(table, "x", fold))
    shift, matrix = standardised(n, mean[selected], cov[np.ix_(selected, selected)])
    model = Softmax(refit.ALL, columns=selected, shift=shift, matrix=matrix, reg=reg)
    fit_many(table, "x", label, fold, [model], len(classes))
    options = {"half_width": half_width, "window": window, "levels": levels, "snr_threshold": snr_threshold, "clean": clean_options or {}}
    return SavedModel(list(axis), list(short), list(classes), fit, model, names[refit.ALL], options)


def save(spark: SparkSession, m: SavedModel, path: str) -> None:
    """Write the model as rows (name, value) of JSON; replaces what is there."""
    plain = lambda a: None if a is None else np.asarray(a).tolist()
    parts = {
        "axis": list(map(float, m.axis)), "short": list(map(float, m.short)), "classes": m.classes, "names": m.names, "options": m.options,
        "low": float(m.fit.low), "mean": plain(m.fit.mean), "spectra": plain(m.fit.spectra), "variables": list(map(int, m.fit.variables)),
        "templates": {kind: [[k, plain(v)] for k, v in t.items()] for kind, t in m.fit.templates.items()},
        "components": [[c.name, c.size, plain(c.mask), plain(c.axes), plain(c.mean), plain(c.explained)] for c in m.fit.components],
        "model": {"columns": plain(m.model.columns), "shift": plain(m.model.shift), "matrix": plain(m.model.matrix), "theta": plain(m.model.theta), "weights": plain(m.model.weights), "reg": m.model.reg},
    }
    spark.createDataFrame([(k, json.dumps(v)) for k, v in parts.items()], "name string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> SavedModel:
    p = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(path).collect()}  # a dozen rows
    array = lambda v: None if v is None else np.array(v)
    parts = [ft.RegionComponents(name, size, array(mask), array(axes), array(mean), array(explained)) for name, size, mask, axes, mean, explained in p["components"]]
    templates = {kind: {k: np.array(v) for k, v in t} for kind, t in p["templates"].items()}
    fit = refit.FoldFit(refit.ALL, p["low"], array(p["mean"]), parts, templates, array(p["spectra"]), p["variables"])
    m = p["model"]
    model = Softmax(refit.ALL, columns=array(m["columns"]), shift=array(m["shift"]), matrix=array(m["matrix"]), theta=array(m["theta"]), weights=array(m["weights"]), reg=m["reg"])
    return SavedModel(p["axis"], p["short"], p["classes"], fit, model, p["names"], p["options"])


def score(df: DataFrame, m: SavedModel, file: str = "file_id", *, preprocess: bool = True, abstain_below: float = ABSTAIN_BELOW) -> DataFrame:
    """(file, p0.., pred, top_p, decision, n_rows) of series ``y``.

    With ``preprocess``, ``y`` lies on the saved raw axis: rows pass the quality gate of their file and the saved cleaning steps first; a file of
    which no row passes has no decision row.  Otherwise ``y`` is clean and on the short axis.
    """
    if preprocess:
        kept = qc.with_keep(df, file, "y", m.axis, snr_threshold=m.options["snr_threshold"]).where("keep")
        df, _ = clean(kept, m.axis, **m.options["clean"])
    table, _ = refit.fold_features(df.select(file, "y"), "y", m.short, {refit.ALL: m.fit}, file, [], m.families())
    n = df.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"))
    k = len(m.classes)
    scored = table.withColumn("_p", row_map(m.model.probabilities)("x")).join(n, file)
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    name = F.element_at(F.array(*[F.lit(str(x)) for x in m.classes]), best + 1)
    top = F.array_max("_p")
    return scored.select(file, *[F.col("_p")[i].alias(f"p{i}") for i in range(k)], best.cast("long").alias("pred"), top.alias("top_p"), F.when(top < abstain_below, "abstain").otherwise(name).alias("decision"), "n_rows")


def score_stream(spark: SparkSession, root: str, model: str, out: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Score every export file under ``root`` that was not scored yet, and stop; decisions go to ``out``.

    A batch holds whole files, so quality gate, resampling and file means are those of the file scored alone.
    """
    m = load(spark, model)

    def decisions(lines: DataFrame) -> DataFrame:
        axes = materialise(ins.parse_axis(ins.body_start(lines), None), "axes").where("axis_error is null")
        rows = ins.parse_pixels(lines, axes).where("reject is null").drop("reject")
        return score(ins.resample(rows, axes, m.axis), m, "file_path")

    ingest_new_files(spark, root, out, checkpoint, decisions, files_per_batch)
