"""Cleaning of series tables.  All steps are row maps: nothing here shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.functions import series as fs
from wavetable.functions.linear import savgol

STEPS = ("despike", "baseline", "smooth", "crop", "snv")


def kept_runs(axis: Sequence[float], regions=catalog.CROP_REGIONS) -> list[tuple[int, int]]:
    """Contiguous position runs [start, stop) of the axis that fall in any region."""
    keep = [i for i, x in enumerate(axis) if catalog.in_regions(x, regions)]
    runs = []
    for _, grp in groupby(enumerate(keep), lambda t: t[1] - t[0]):
        idx = [i for _, i in grp]
        runs.append((idx[0], idx[-1] + 1))
    return runs


def crop(c: Column | str, axis: Sequence[float], regions=catalog.CROP_REGIONS) -> Column:
    """Keep the positions inside the regions: one ``slice`` per contiguous run."""
    parts = [F.slice(c, a + 1, b - a) for a, b in kept_runs(axis, regions)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def step_column(step: str, c: Column | str, axis: Sequence[float], **opts) -> Column:
    if step == "despike":
        return fs.despike(c, threshold=opts.get("threshold", 5.0), window=opts.get("median_window", 7))
    if step == "baseline" and "lam" in opts:
        return fs.remove_penalised_baseline(c, lam=opts["lam"], max_iter=opts.get("max_iter", 50))
    if step == "baseline":
        return fs.remove_baseline(c, half_width=opts.get("half_width", 50), quantile=opts.get("quantile", 0.1))
    if step == "smooth":
        return savgol(c, window=opts.get("window", 9), polyorder=opts.get("polyorder", 3))
    if step == "crop":
        return crop(c, axis, opts.get("regions", catalog.CROP_REGIONS))
    if step == "snv":
        return fs.snv(c)
    raise ValueError(f"unknown step {step!r}")


def clean(
    df: DataFrame, axis: Sequence[float], *, y: str = "y", steps: Sequence[str] = STEPS, keep_stages: bool = False, **opts
) -> tuple[DataFrame, list[float]]:
    """Run the chosen steps in their fixed order; returns the table and the axis of the result.

    With ``keep_stages`` every intermediate series stays as a column ``stage_<step>``.
    """
    chosen = [s for s in STEPS if s in steps]
    regions = opts.get("regions", catalog.CROP_REGIONS)
    current: Column | str = y
    for step in chosen:
        if step == "crop" and len(chosen) > 1 and not keep_stages:
            # between matrix steps the crop is one too, so the chain is a single Arrow pass
            mask = np.array([catalog.in_regions(x, regions) for x in axis])
            current = fs.row_map(lambda x: x[:, mask])(current)
        else:
            current = step_column(step, current, axis, **opts)
        if keep_stages:
            df = df.withColumn(f"stage_{step}", current)
            current = f"stage_{step}"
    out_axis = catalog.crop_axis(axis, regions) if "crop" in chosen else list(axis)
    return df.withColumn(y, F.col(current) if isinstance(current, str) else current), out_axis
