"""Per-series features.  Catalogs are dict arguments; results are new columns in the same row.

The axis is a plan-time list, so every integral is a fixed dot product and nothing shuffles.  A
feature family is a matrix kernel with column names; a frame of many families runs them in one Arrow
pass, so a series is handed to Python once.  Only the corpus-level fits (mean series, class templates,
region components) aggregate rows; what they bring to the driver has axis size times class count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetable import catalog
from wavetable.functions import lineshapes
from wavetable.functions.linear import dot, is_narrow, linear_map, savgol_kernel, trapezoid_weights, wavelet_bank, window_mask
from wavetable.functions.series import row_map
from wavetable.functions.stats import safe_ratio, signed_ratio
from wavetable.operators.moments import mean_vector, second_moments
from wavetable.operators.vectorsums import vector_sums

MAX_TEMPLATES = 10_000


@dataclass(frozen=True)
class Family:
    """Feature columns computed together: (n, B) series to (n, len(names)) values; NaN means null."""

    names: list[str]
    kernel: Callable[[np.ndarray], np.ndarray]


def with_families(df: DataFrame, y: str, families: Sequence[Family]) -> DataFrame:
    """Add the columns of all families in one pass over the series."""
    kernels = [f.kernel for f in families]
    packed = row_map(lambda x: np.concatenate([k(x) for k in kernels], axis=1))(y)
    return _columns_from_array(df, packed, [n for f in families for n in f.names])


def _columns_from_array(df: DataFrame, packed: Column, names: Sequence[str]) -> DataFrame:
    """Spread an array column over named columns; NaN becomes null."""
    df = df.withColumn("_packed", packed)
    return df.select(
        *[c for c in df.columns if c != "_packed"],
        *[F.expr(f"nanvl(_packed[{i}], CAST(NULL AS DOUBLE)) AS `{n}`") for i, n in enumerate(names)],
    )


def linear_family(weights: dict[str, np.ndarray | None], size: int) -> Family:
    """Weighted sums; a missing weight vector gives a null column."""
    matrix = np.stack([w if w is not None else np.full(size, np.nan) for w in weights.values()], axis=1)
    return Family(list(weights), lambda x: x @ matrix)


# ---------------------------------------------------------------- areas and ratios

def band_windows(bands: dict[str, float], half_width: float) -> dict[str, tuple[float, float]]:
    return {n: (c - half_width, c + half_width) for n, c in bands.items()}


def area_weights(axis: Sequence[float], windows: dict[str, tuple[float, float]], prefix: str = "auc_") -> dict:
    return {f"{prefix}{n}": trapezoid_weights(axis, lo, hi) for n, (lo, hi) in windows.items()}


def integrate(df: DataFrame, y: str, axis: Sequence[float], windows: dict[str, tuple[float, float]], prefix: str = "auc_") -> DataFrame:
    """Trapezoid area over each window; null where fewer than two axis points fall in it."""
    weights = area_weights(axis, windows, prefix)
    usable = [w for w in weights.values() if w is not None]
    if usable and is_narrow(np.stack(usable, axis=1)):
        return df.withColumns({n: dot(y, w) if w is not None else F.lit(None).cast("double") for n, w in weights.items()})
    return with_families(df, y, [linear_family(weights, len(axis))])


def on_axis(bands: dict[str, float], axis: Sequence[float]) -> dict[str, float]:
    return {n: c for n, c in bands.items() if axis[0] <= c <= axis[-1]}


def band_centers(names=None) -> dict[str, float]:
    return {n: catalog.BANDS[n][0] for n in (names or catalog.BANDS)}


def band_auc(df, y, axis, bands: dict[str, float] | None = None, half_width: float = 10.0) -> DataFrame:
    """Area of every catalog band whose center lies on the axis."""
    return integrate(df, y, axis, band_windows(on_axis(bands or band_centers(), axis), half_width))


def window_sum(df: DataFrame, y: str, axis: Sequence[float], windows: dict[str, tuple[float, float]], prefix: str = "sum_") -> DataFrame:
    """Plain sum of the values in each window."""
    masks = {n: window_mask(axis, lo, hi).astype(float) for n, (lo, hi) in windows.items()}
    return _columns_from_array(df, linear_map(y, np.stack(list(masks.values()), axis=1)), [f"{prefix}{n}" for n in masks])


def group_weights(axis, bands=None, groups=None, regions=None, half_width: float = 10.0) -> dict:
    bands, groups = bands or catalog.BANDS, groups or catalog.GROUPS
    regions = catalog.CONTINUOUS_REGIONS if regions is None else regions
    outs: dict = {}
    for name, code in groups.items():
        ws = [
            trapezoid_weights(axis, c - half_width, c + half_width)
            for c, g in bands.values()
            if g == code and axis[0] <= c <= axis[-1]
        ]
        outs[f"auc_{name}"] = np.sum(ws, axis=0) if ws and all(w is not None for w in ws) else None
    for name, (lo, hi) in regions.items():
        outs[f"auc_{name}"] = trapezoid_weights(axis, max(lo, axis[0]), min(hi, axis[-1]))
    return outs


def group_vector(df, y, axis, bands=None, groups=None, regions=None, half_width: float = 10.0) -> DataFrame:
    """Summed band areas per group, and the area of each continuous region cut to the axis."""
    return with_families(df, y, [linear_family(group_weights(axis, bands, groups, regions, half_width), len(axis))])


def named_ratios(df: DataFrame, ratios: dict | None = None, eps: float = 1e-9) -> DataFrame:
    """Ratios between ``auc_*`` columns already in the table, named by a ratio catalog."""
    source = lambda spec: F.col("auc_" + spec.split(":", 1)[1])
    return df.withColumns(
        {f"ratio_{n}": signed_ratio(source(a), source(b), eps) for n, (a, b) in (ratios or catalog.RATIOS).items()}
    )


def composition_family(axis, half_width: float = 10.0) -> Family:
    """Hidden areas ``_a<center>`` the composition ratios read."""
    windows = band_windows({f"{int(c)}": c for c in catalog.COMPOSITION_CENTERS}, half_width)
    return linear_family(area_weights(axis, windows, "_a"), len(axis))


def composition_columns() -> dict[str, Column]:
    a = lambda c: F.col(f"_a{c}")
    indole = a(759) + a(1552)
    return {
        "bio_cyt_pyrrole_ratio": safe_ratio(a(752), a(1004)),
        "bio_cyt_ox_state": safe_ratio(a(1356), a(1372)),
        "bio_cyt_total": a(752) + a(1127) + a(1585),
        "bio_alpha_helix_score": safe_ratio(a(1652), a(1670)),
        "bio_beta_sheet_amide3": safe_ratio(a(1232), a(1270)),
        "bio_phb_carbonyl": a(1730),
        "bio_phb_score": safe_ratio(a(1730) * a(1058), a(1450) * a(1450)),
        "bio_tyr_doublet_ratio": safe_ratio(a(850), a(830)),
        "bio_trp_content": indole,
        "bio_trp_indole_env": safe_ratio(a(1340), a(1360)),
        "bio_virulence_aa_sig": safe_ratio(indole, a(1004)),
        "bio_na_a_form_fraction": safe_ratio(a(815), a(815) + a(835)),
        "bio_rna_dna_ratio": safe_ratio(a(813), a(788)),
    }


def composition_ratios(df: DataFrame, y: str, axis: Sequence[float], half_width: float = 10.0) -> DataFrame:
    """Thirteen fixed composition features in five families."""
    base = with_families(df, y, [composition_family(axis, half_width)])
    return base.select(*df.columns, *[c.alias(n) for n, c in composition_columns().items()])


# ---------------------------------------------------------------- moments and peaks

MOMENTS = ("mean", "std", "skew", "kurt", "centroid", "entropy")


def _moments(x: np.ndarray, axis: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    if n < 3:
        return np.full((len(x), 6), np.nan)
    eps = 1e-9
    mean = x.mean(1)
    d = x - mean[:, None]
    m2 = (d**2).mean(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        flat = m2 <= (np.finfo(float).eps * mean) ** 2
        g1 = np.where(flat, np.nan, (d**3).mean(1) / m2**1.5)
        g2 = np.where(flat, np.nan, (d**4).mean(1) / m2**2 - 3.0)
        skew = np.sqrt(n * (n - 1.0)) / (n - 2.0) * g1
        kurt = (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0) if n > 3 else np.full(len(x), np.nan)
    s = x.sum(1)
    s = np.where(np.abs(s) < eps, np.sign(s) * eps + eps, s)
    p = np.abs(x) / (np.abs(x).sum(1, keepdims=True) + eps)
    return np.stack([mean, np.sqrt(m2), skew, kurt, (x * axis).sum(1) / s, -(p * np.log(p + eps)).sum(1)], axis=1)


def moments_family(axis: Sequence[float], rois: dict | None = None) -> Family:
    rois = rois or catalog.ROIS
    axis = np.asarray(axis)
    masks = [window_mask(axis, lo, hi) for lo, hi in rois.values()]
    names = [f"roi_{n}_{s}" for n in rois for s in MOMENTS]
    return Family(names, lambda x: np.concatenate([_moments(x[:, m], axis[m]) for m in masks], axis=1))


def roi_moments(df: DataFrame, y: str, axis: Sequence[float], rois: dict | None = None) -> DataFrame:
    """Mean, population sd, bias-corrected skew and excess kurtosis, centroid and entropy per region."""
    return with_families(df, y, [moments_family(axis, rois)])


PEAK_STATS = ("position", "height", "centre", "width", "area", "residual")


def _peak(x: np.ndarray, axis: np.ndarray) -> np.ndarray:
    if len(axis) < 3:
        return np.full((len(x), 6), np.nan)
    slope = (x[:, -1] - x[:, 0]) / (axis[-1] - axis[0])
    h = x - (x[:, :1] + slope[:, None] * (axis - axis[0])[None, :])
    top = h.argmax(1)
    pos = np.maximum(h, 0.0)
    mass = pos.sum(1)
    mass = np.where(mass > 0, mass, np.nan)
    centre = (pos * axis).sum(1) / mass
    width = np.sqrt((pos * (axis[None, :] - centre[:, None]) ** 2).sum(1) / mass)
    area = ((h[:, 1:] + h[:, :-1]) / 2 * np.diff(axis)).sum(1)
    return np.stack([axis[top], h.max(1), centre, width, area, np.sqrt((h**2).mean(1))], axis=1)


def peak_family(axis: Sequence[float], bands: dict[str, float], window: float = 30.0) -> Family:
    axis = np.asarray(axis)
    masks = [window_mask(axis, c - window, c + window) for c in bands.values()]
    names = [f"peak_{n}_{s}" for n in bands for s in PEAK_STATS]
    return Family(names, lambda x: np.concatenate([_peak(x[:, m], axis[m]) for m in masks], axis=1))


def peak_descriptors(df: DataFrame, y: str, axis: Sequence[float], bands: dict[str, float], window: float = 30.0) -> DataFrame:
    """Six shape numbers per band above the straight line through the window's end points."""
    return with_families(df, y, [peak_family(axis, bands, window)])


def line_family(axis: Sequence[float], bands: dict[str, float], window: float = 30.0, width: float = 12.0, shape: str = "lorentz") -> Family:
    """A line shape fitted around every band: its parameters, area, error and ``success``; null where no fit was found."""
    axis = np.asarray(axis, dtype=np.float64)
    names = [f"line_{n}_{s}" for n in bands for s in (*lineshapes.SHAPES[shape].columns, "success")]
    return Family(names, lambda x: np.concatenate([lineshapes.fit_windows(x, axis, c, window, width, shape) for c in bands.values()], axis=1))


def line_fits(df: DataFrame, y: str, axis: Sequence[float], bands: dict[str, float], window: float = 30.0, width: float = 12.0, shape: str = "lorentz") -> DataFrame:
    return with_families(df, y, [line_family(axis, bands, window, width, shape)])


def line_quality(df: DataFrame, bands: dict[str, float]) -> DataFrame:
    """Per band: rows, share of fits that succeeded, mean shift from the band's centre, mean width and error of those."""
    good = lambda n, c: F.when(F.col(f"line_{n}_success") == 1, c)
    parts = []
    for n, centre in bands.items():
        parts.append(F.struct(
            F.lit(n).alias("band"), F.count(F.lit(1)).alias("n"), F.avg(f"line_{n}_success").alias("success_rate"),
            F.avg(good(n, F.col(f"line_{n}_centre") - centre)).alias("centre_shift"), F.avg(good(n, F.col(f"line_{n}_fwhm"))).alias("mean_fwhm"), F.avg(good(n, F.col(f"line_{n}_rmse"))).alias("mean_rmse"),
        ))
    return df.agg(F.array(*parts).alias("b")).select(F.explode("b").alias("b")).select("b.*")


def derivative_family(axis, bands: dict[str, float], deriv: int, half_width: float = 10.0, window: int = 11, polyorder: int = 3) -> Family:
    slope = savgol_kernel(window, polyorder, deriv, float(np.median(np.diff(axis))))
    areas = linear_family(area_weights(axis, band_windows(bands, half_width), f"d{deriv}_auc_"), len(axis))
    return Family(areas.names, lambda x: areas.kernel(np.abs(slope(x))))


def derivative_auc(df, y, axis, bands: dict[str, float], deriv: int, half_width: float = 10.0, window: int = 11, polyorder: int = 3) -> DataFrame:
    """Area of the absolute Savitzky-Golay derivative over each band."""
    return with_families(df, y, [derivative_family(axis, bands, deriv, half_width, window, polyorder)])


def wavelet_family(n: int, levels: int = 6) -> Family:
    bank = wavelet_bank(n, levels)
    eps = 1e-12

    def kernel(x):
        out = []
        for w in bank:
            c2 = (x @ w) ** 2
            energy = c2.sum(1)
            p = c2 / np.where(energy < eps, 1.0, energy)[:, None]
            safe = np.where(p > eps, p, 1.0)
            out += [energy, np.where(energy < eps, 0.0, -(safe * np.log(safe)).sum(1))]
        return np.stack(out, axis=1)

    return Family([f"dwt_{s}_L{k}" for k in range(1, levels + 1) for s in ("energy", "entropy")], kernel)


def wavelet_features(df: DataFrame, y: str, n: int, levels: int = 6) -> DataFrame:
    """Energy and entropy of the detail coefficients per level (1 = finest)."""
    return with_families(df, y, [wavelet_family(n, levels)])


# ---------------------------------------------------------------- corpus-level fits

def scatter_design(axis: Sequence[float], reference: np.ndarray, degree: int = 2) -> np.ndarray:
    x = np.asarray(axis)
    x = (x - x.mean()) / (x.std() + 1e-9)
    return np.stack([np.ones(len(x)), reference, *[x**k for k in range(1, degree + 1)]], axis=1)


def scatter_family(axis, reference: np.ndarray, degree: int = 2) -> Family:
    solve = np.linalg.pinv(scatter_design(axis, reference, degree)).T
    return Family(["emsc_a", "emsc_b", *[f"emsc_c{k}" for k in range(1, degree + 1)]], lambda x: x @ solve)


def emsc(df: DataFrame, y: str, axis: Sequence[float], reference: np.ndarray | None = None, degree: int = 2) -> DataFrame:
    """Regress each series on [1, reference, x, x^2, ...]; adds the coefficients and the residual series."""
    reference = mean_vector(df, y) if reference is None else reference
    design = scatter_design(axis, reference, degree)
    solve = np.linalg.pinv(design).T
    out = with_families(df, y, [scatter_family(axis, reference, degree)])
    return out.withColumn("emsc_residual", row_map(lambda v: v - (v @ solve) @ design.T)(y))


def fit_templates(df: DataFrame, y: str, label: str) -> dict:
    """Mean series per label.  The number of labels is checked before anything reaches the driver."""
    rows = vector_sums(df.where(F.col(label).isNotNull()), [label], y).limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} distinct values of {label}")
    return {r[label]: np.array(r.s) / np.array(r.n) for r in sorted(rows, key=lambda r: r[label])}


def angle_family(templates: dict, prefix: str, axis=None, region: tuple[float, float] | None = None) -> Family:
    m = np.stack(list(templates.values()))
    mask = window_mask(axis, *region) if region else np.ones(m.shape[1], dtype=bool)
    m = m[:, mask]
    m = (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)).T

    def kernel(x):
        x = x[:, mask]
        return np.arccos(np.clip((x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)) @ m, -1.0, 1.0))

    return Family([f"{prefix}{k}" for k in templates], kernel)


def angles(df: DataFrame, y: str, templates: dict, prefix: str, axis=None, region: tuple[float, float] | None = None) -> DataFrame:
    """Angle in radians between each series and each template, on the whole axis or one region."""
    return with_families(df, y, [angle_family(templates, prefix, axis, region)])


@dataclass(frozen=True)
class RegionComponents:
    """Principal components of one region; ``axes`` is None where the region is too short."""

    name: str
    size: int
    mask: np.ndarray
    axes: np.ndarray | None = None
    mean: np.ndarray | None = None
    explained: np.ndarray | None = None


def fit_region_components(df: DataFrame, y: str, axis: Sequence[float], regions: dict | None = None) -> list[RegionComponents]:
    """Components of every region from one pass over the series: the region blocks of the covariance matrix.

    The sign of a component is free; the largest loading is made positive.
    """
    _, mean, _, moments = second_moments(df, y)
    return region_components(mean, moments - np.outer(mean, mean), axis, regions)


def region_components(mean: np.ndarray, cov: np.ndarray, axis: Sequence[float], regions: dict | None = None) -> list[RegionComponents]:
    """The same from moments that are already known."""
    out = []
    for name, (lo, hi, k) in (regions or catalog.PCA_REGIONS).items():
        mask = window_mask(axis, lo, hi)
        if mask.sum() < k + 1:
            out.append(RegionComponents(name, k, mask))
            continue
        block = cov[np.ix_(mask, mask)]
        values, vectors = np.linalg.eigh(block)
        pc = vectors[:, ::-1][:, :k]
        pc = pc * np.sign(pc[np.abs(pc).argmax(0), np.arange(k)])
        out.append(RegionComponents(name, k, mask, pc, mean[mask], values[::-1][:k] / np.trace(block)))
    return out


def component_family(fitted: Sequence[RegionComponents]) -> Family:
    def scores(x, f):
        return (x[:, f.mask] - f.mean) @ f.axes if f.axes is not None else np.full((len(x), f.size), np.nan)

    names = [f"pca_{f.name}_PC{i + 1}" for f in fitted for i in range(f.size)]
    return Family(names, lambda x: np.concatenate([scores(x, f) for f in fitted], axis=1))


def region_scores(df: DataFrame, y: str, axis: Sequence[float], fitted: Sequence[RegionComponents]) -> DataFrame:
    """Scores of the fitted components: a linear map of the centred region."""
    return with_families(df, y, [component_family(fitted)])


# ---------------------------------------------------------------- whole frames

def band_frame(
    df: DataFrame, y: str, axis: Sequence[float], *, half_width: float = 10.0, window: float = 30.0,
    ratios=True, peaks=True, rois=True, scatter=True, derivatives=True, composition=True, reference=None,
) -> DataFrame:
    """All band-level features, families switchable."""
    picked = on_axis(band_centers(catalog.PEAK_BANDS), axis)
    areas = area_weights(axis, band_windows(on_axis(band_centers(), axis), half_width))
    families = [linear_family({**group_weights(axis, half_width=half_width), **areas}, len(axis))]
    if peaks:
        families.append(peak_family(axis, picked, window))
    if rois:
        families.append(moments_family(axis))
    if scatter:
        families.append(scatter_family(axis, mean_vector(df, y) if reference is None else reference))
    if derivatives:
        families += [derivative_family(axis, picked, d, half_width) for d in (1, 2)]
    if composition:
        families.append(composition_family(axis, half_width))
    out = with_families(df, y, families)
    if ratios:
        out = named_ratios(out)
    extra = composition_columns() if composition else {}
    return out.select(*[c for c in out.columns if not c.startswith("_a")], *[c.alias(n) for n, c in extra.items()])


def spectral_frame(
    df: DataFrame, y: str, axis: Sequence[float], *, label: str | None = None, sublabel: str | None = None,
    wavelet=True, components=True, levels: int = 6, fitted=None, templates=None,
) -> DataFrame:
    """Wavelet, region-component and template-angle features, families switchable."""
    families = [wavelet_family(len(axis), levels)] if wavelet else []
    if components:
        families.append(component_family(fitted or fit_region_components(df, y, axis)))
    for kind, name in (("class", label), ("sub", sublabel)):
        if name:
            t = (templates or {}).get(kind) or fit_templates(df, y, name)
            families.append(angle_family(t, f"sam_{kind}_"))
            families.append(angle_family(t, f"sam_lps_{kind}_", axis, catalog.ANGLE_REGION))
    return with_families(df, y, families)
