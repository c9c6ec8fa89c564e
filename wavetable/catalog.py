"""Band, region and ratio tables, class order and reference axis.

All of these must equal the published ones for equal results; they are plain data and every operator
takes its catalog as an argument, so callers can pass their own.
"""

from __future__ import annotations

# Reference axis: 2048 points from 76 to 3499; two kept regions after the crop (987 points).
AXIS_START, AXIS_STOP, AXIS_POINTS = 76.0, 3499.0, 2048
CROP_REGIONS = ((400.0, 1800.0), (2800.0, 3050.0))

CLASS_ORDER = ("H2O", "Non-STEC", "STEC", "Salmonella")
CLASS_OF_FOLDER = {"H20": "H2O", "STEC": "STEC", "Non STEC": "Non-STEC", "Salmonella": "Salmonella"}
FOLDERS_WITH_SUBCLASS = ("STEC", "Non STEC", "Salmonella")

# name -> (center, group)
BANDS = {
    "lps_1050": (1050.0, "lipid_carb"),
    "lps_1117": (1117.0, "lipid_carb"),
    "lps_1194": (1194.0, "lipid_carb"),
    "aa_762": (762.0, "aromatic_aa"),
    "aa_831": (831.0, "aromatic_aa"),
    "aa_855": (855.0, "aromatic_aa"),
    "aa_1004": (1004.0, "aromatic_aa"),
    "aa_1014": (1014.0, "aromatic_aa"),
    "aa_1176": (1176.0, "aromatic_aa"),
    "aa_1212": (1212.0, "aromatic_aa"),
    "aa_1617": (1617.0, "aromatic_aa"),
    "na_720": (720.0, "nucleic_acid"),
    "na_786": (786.0, "nucleic_acid"),
    "na_1335": (1335.0, "nucleic_acid"),
    "na_1338": (1338.0, "nucleic_acid"),
    "na_1362": (1362.0, "nucleic_acid"),
    "na_1485": (1485.0, "nucleic_acid"),
    "na_1530": (1530.0, "nucleic_acid"),
    "na_1575": (1575.0, "nucleic_acid"),
    "amide_iii_1242": (1242.0, "protein_amide"),
    "amide_i_1658": (1658.0, "protein_amide"),
    "amide_i_1662": (1662.0, "protein_amide"),
    "lipid_1080": (1080.0, "lipid_carb"),
    "lipid_1451": (1451.0, "lipid_carb"),
    "lipid_1454": (1454.0, "lipid_carb"),
    "lipid_1585": (1585.0, "lipid_carb"),
    "lipid_2850": (2850.0, "lipid_carb"),
    "lipid_2930": (2930.0, "lipid_carb"),
    "salm_616": (616.0, "metabolite"),
    "salm_925": (925.0, "metabolite"),
    "salm_1486": (1486.0, "nucleic_acid"),
    "salm_1542": (1542.0, "metabolite"),
}

# reported group name -> group code used in BANDS
GROUPS = {
    "aromatic_aa": "aromatic_aa",
    "protein_amide": "protein_amide",
    "nucleic_acid": "nucleic_acid",
    "lipid_carbohydrate": "lipid_carb",
    "metabolite": "metabolite",
}

CONTINUOUS_REGIONS = {"lps_o_antigen_full": (400.0, 900.0), "lps_chain_discrim": (800.0, 1200.0)}

# ratio name -> (numerator, denominator); prefix says where the value comes from
RATIOS = {
    "amide_over_na": ("group:protein_amide", "group:nucleic_acid"),
    "aa_over_amide": ("group:aromatic_aa", "group:protein_amide"),
    "lipid_over_protein": ("group:lipid_carbohydrate", "group:protein_amide"),
    "na_over_lipid": ("group:nucleic_acid", "group:lipid_carbohydrate"),
    "lps_chain_over_protein": ("lps:lps_chain_discrim", "group:protein_amide"),
    "lps_1117_over_1050": ("band:lps_1117", "band:lps_1050"),
    "lps_1194_over_1050": ("band:lps_1194", "band:lps_1050"),
    "amide_1658_over_na_1338": ("band:amide_i_1658", "band:na_1338"),
    "phe_1004_over_amide_1658": ("band:aa_1004", "band:amide_i_1658"),
    "na_786_over_phe_1004": ("band:na_786", "band:aa_1004"),
}

ROIS = {
    "fingerprint_low": (400.0, 800.0),
    "lps_chain": (800.0, 1200.0),
    "protein_amide_extended": (1200.0, 1500.0),
    "amide_aromatic": (1500.0, 1700.0),
    "silent": (1700.0, 2800.0),
    "ch_stretch": (2800.0, 3050.0),
}

PEAK_BANDS = (
    "lps_1050", "lps_1117", "lps_1194", "na_1338", "lipid_1454", "amide_i_1658", "aa_1004", "amide_iii_1242",
)

# region -> (lo, hi, components)
PCA_REGIONS = {"lps": (800.0, 1200.0, 5), "amide": (1500.0, 1700.0, 3), "chstretch": (2800.0, 3050.0, 3)}
ANGLE_REGION = (800.0, 1200.0)
SPATIAL_REGIONS = {"lps_chain": (800.0, 1200.0), "ch_stretch": (2800.0, 3000.0)}
SPATIAL_BANDS = {"lps_1050": 1050.0, "lps_1117": 1117.0, "lps_1194": 1194.0}

# Band centers read by the composition ratios.
COMPOSITION_CENTERS = (
    752.0, 759.0, 788.0, 813.0, 815.0, 830.0, 835.0, 850.0, 1004.0, 1058.0, 1127.0, 1232.0, 1270.0, 1340.0,
    1356.0, 1360.0, 1372.0, 1450.0, 1552.0, 1585.0, 1652.0, 1670.0, 1730.0,
)


def reference_axis() -> list[float]:
    step = (AXIS_STOP - AXIS_START) / (AXIS_POINTS - 1)
    return [AXIS_START + i * step for i in range(AXIS_POINTS - 1)] + [AXIS_STOP]


def in_regions(x: float, regions=CROP_REGIONS) -> bool:
    return any(lo <= x <= hi for lo, hi in regions)


def crop_axis(axis, regions=CROP_REGIONS) -> list[float]:
    return [x for x in axis if in_regions(x, regions)]
