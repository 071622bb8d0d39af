"""Names of bands, sensors and columns.

An observation table is long: one row per pixel and acquisition, one nullable double per band. A masked value is NULL; the
mask column stays beside it, 1 for valid.
"""

from __future__ import annotations

OPTICAL = ("BLU", "GRN", "RED", "NIR", "SW1", "SW2")
KEYS = ("px", "py")


# Each sensor's own column names, and the band names that they get.
_TM = {"SR_B1": "BLU", "SR_B2": "GRN", "SR_B3": "RED", "SR_B4": "NIR", "SR_B5": "SW1", "SR_B7": "SW2"}
_OLI = {"SR_B1": "CLU", "SR_B2": "BLU", "SR_B3": "GRN", "SR_B4": "RED", "SR_B5": "NIR", "SR_B6": "SW1", "SR_B7": "SW2", "ST_B10": "LST"}
_MSI = {"B1": "AER", "B2": "BLU", "B3": "GRN", "B4": "RED", "B5": "RE1", "B6": "RE2", "B7": "RE3", "B8": "NIR", "B8A": "RE4", "B9": "WV", "B11": "SW1", "B12": "SW2"}
_LANDSAT_QA = {"QA_PIXEL": "QA_PIXEL", "QA_RADSAT": "QA_RADSAT"}
SENSOR_BANDS: dict[str, dict[str, str]] = {
    "L4": _TM | _LANDSAT_QA,
    "L5": _TM | {"ST_B6": "LST"} | _LANDSAT_QA,
    "L7": _TM | {"ST_B6": "LST"} | _LANDSAT_QA,
    "L8": _OLI | _LANDSAT_QA,
    "L9": _OLI | _LANDSAT_QA,
    "S2": _MSI | {"QA60": "QA", "SCL": "SCL"},
    "S2_L1C": _MSI | {"QA60": "QA"},
    "HLSS30": _MSI | {"Fmask": "Fmask"},
    "HLSL30": {"B1": "CLU", "B2": "BLU", "B3": "GRN", "B4": "RED", "B5": "NIR", "B6": "SW1", "B7": "SW2", "B10": "LST", "Fmask": "Fmask"},
}
LANDSAT, HLS = ("L9", "L8", "L7", "L5", "L4"), ("HLSL30", "HLSS30")
#: Columns that hold flags or probabilities, not reflectance.
QA_BANDS = ("QA_PIXEL", "QA_RADSAT", "QA", "SCL", "Fmask", "cs", "cs_cdf", "probability")
#: The scene property that holds the cloud cover.
CLOUD_PROPERTY = dict.fromkeys(LANDSAT, "CLOUD_COVER_LAND") | dict.fromkeys(HLS, "CLOUD_COVERAGE") | {"S2": "CLOUDY_PIXEL_PERCENTAGE"}
MS_DAY = 86_400_000
#: Milliseconds of a mean Gregorian year.
MS_YEAR = int(365.2425 * MS_DAY)
