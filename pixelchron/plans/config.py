"""Parameters: defaults, loading from YAML, JSON or a dictionary, merging and checks."""

from __future__ import annotations

import json
import math
import urllib.request
from copy import deepcopy
from pathlib import Path

# Names and defaults of the parameters that users' files refer to.
DEFAULTS: dict[str, object] = {
    # time and region
    "YEAR_MIN": 2023, "YEAR_MAX": 2023, "MONTH_MIN": 1, "MONTH_MAX": 12, "DOY_MIN": 1, "DOY_MAX": 366, "DATE_MIN": None, "DATE_MAX": None,
    "ROI": [12.9, 52.2, 13.9, 52.7], "ROI_SIMPLIFY_GEOM_TO_BBOX": True, "ROI_TILES": False, "ROI_TILES_ATTRIBUTE_COLUMN": None, "ROI_TILES_ATTRIBUTE_LIST": None,
    # sensors and masks
    "SENSORS": ["L9", "L8", "L7", "L5", "L4"], "MAX_CLOUD": 75, "EXCLUDE_SLCOFF": False, "GCP_MIN_LANDSAT": 1,
    "MASKS_LANDSAT": ["cloud", "cshadow", "snow", "fill", "dilated"], "MASKS_LANDSAT_CONF": "Medium",
    "MASKS_S2": "CPLUS", "MASKS_S2_CPLUS": 0.6, "MASKS_S2_PROB": 30, "MASKS_S2_NIR_THRESH_SHADOW": 0.2, "MASKS_HLS": ["cloud", "cshadow", "snow"],
    "ERODE_DILATE": False, "ERODE_RADIUS": 60, "DILATE_RADIUS": 120, "ERODE_DILATE_SCALE": 60, "BLUE_MAX_MASKING": None,
    # features
    "FEATURES": ["BLU", "GRN", "RED", "NIR", "SW1", "SW2", "NDVI"], "CUSTOM_FORMULAS": None,
    "UMX": None, "UMX_SUM_TO_ONE": True, "UMX_NON_NEGATIVE": True, "UMX_REMOVE_INPUT_FEATURES": True,
    # collections
    "CIC": None, "CIC_FEATURES": None, "TSM": False, "TSM_BASE_IMGCOL": "TSS",
    # folds
    "FOLD_YEAR": False, "FOLD_MONTH": False, "FOLD_CUSTOM": {"year": None, "month": None, "doy": None, "date": None},
    # products over time
    "NVO": False, "NVO_FOLDING": False,
    "TSI": None, "TSI_BASE_IMGCOL": "TSS", "INTERVAL": 16, "INTERVAL_UNIT": "day", "INIT_JANUARY_1ST": False,
    "SIGMA1": 16, "SIGMA2": 32, "SIGMA3": 64, "WIN1": 16, "WIN2": 32, "WIN3": 64, "BW1": 4, "BW2": 8,
    "STM": None, "STM_BASE_IMGCOL": "TSS", "STM_FOLDING": False, "STM_FOLDING_LIST_ITER": False,
    "PBC": None, "PBC_BASE_IMGCOL": "TSS", "PBC_FOLDING": False, "PBC_INVERT_QUALITY_METRIC": False,
    "PBC_BAP_DOY_EQ_YEAR": 30, "PBC_BAP_MAX_CLOUDDISTANCE": 500, "PBC_BAP_MIN_CLOUDDISTANCE": 0, "PBC_BAP_WEIGHT_DOY": 0.6, "PBC_BAP_WEIGHT_YEAR": 0.2, "PBC_BAP_WEIGHT_CLOUD": 0.2,
    "LSP": None, "LSP_BASE_IMGCOL": "TSI", "LSP_BAND": "NDVI", "LSP_YEAR_MIN": None, "LSP_YEAR_MAX": None, "LSP_ADJUST_SEASONAL": False, "LSP_ADJUST_SEASONAL_MAX_DAYS": 40,
    # images
    "PIX_RES": 30, "CRS": None, "CRS_TRANSFORM": None, "IMG_DIMENSIONS": None, "RESAMPLING_METHOD": None, "DATATYPE": "int16", "DATATYPE_SCALE": 10000, "NODATA_VALUE": -9999,
    # export
    "EXPORT_IMAGE": False, "EXPORT_TABLE": False, "EXPORT_TSS": False, "EXPORT_CIC": False, "EXPORT_TSM": False, "EXPORT_NVO": False, "EXPORT_TSI": False, "EXPORT_STM": False, "EXPORT_PBC": False, "EXPORT_LSP": False,
    "EXPORT_LOCATION": "Drive", "EXPORT_DIRECTORY": None, "EXPORT_DESC": "PXC", "EXPORT_DESC_DETAIL_TIME": False, "EXPORT_BANDNAMES_AS_CSV": False,
    "EXPORT_TABLE_FORMAT": "CSV", "EXPORT_TABLE_METHOD": "reduceRegions", "EXPORT_TABLE_TILE_SCALE": 1, "EXPORT_TABLE_BUFFER": None, "EXPORT_TABLE_REDUCER": "first", "EXPORT_TABLE_DROP_NODATA": False,
    "EXPORT_PER_FEATURE": False, "EXPORT_PER_TIME": False,
}
#: Products that stages add to the parameters.
PRODUCTS = ("TSS", "CIC_COLLECTION", "TSM_COLLECTION", "NVO_IMAGE", "TSI_COLLECTION", "STM_IMAGE", "PBC_IMAGE", "LSP_COLLECTION", "LSP_IMAGE")


def load_parameters(source: str | Path | dict) -> dict:
    """Parameters from a dictionary, a YAML or JSON file, or the http(s) address of one."""
    if isinstance(source, dict):
        return dict(source)
    text = str(source)
    if text.startswith(("http://", "https://")):
        with urllib.request.urlopen(text, timeout=60) as r:
            text = r.read().decode()
    elif not text.lstrip().startswith("{"):
        text = Path(source).read_text()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def merge_parameters(given: dict | None) -> dict:
    """The defaults with what is given in their place; an unknown name is an error."""
    given = given or {}
    if unknown := [k for k in given if k not in DEFAULTS]:
        raise ValueError(f"unknown parameters: {unknown}")
    return deepcopy(DEFAULTS) | given


def check_parameters(p: dict) -> None:
    """Refuses what this engine doesn't do, so that no parameter is accepted and then passed over.

    Tables are on the grid that they were written on, so nothing is projected, aligned or resampled on the way, and files go to EXPORT_DIRECTORY alone. CRS says
    what coordinates are: None, or EPSG:4326, for degrees, anything else for metres. STM_FOLDING_LIST_ITER chose between two ways to one result and may have either value.
    """
    for name, why in (("CRS_TRANSFORM", "tables keep their grid"), ("IMG_DIMENSIONS", "tables keep their grid"), ("RESAMPLING_METHOD", "use operators.spatial.resample")):
        if p[name] is not None:
            raise ValueError(f"{name} isn't supported: {why}")
    if p["EXPORT_LOCATION"] != DEFAULTS["EXPORT_LOCATION"]:
        raise ValueError("EXPORT_LOCATION isn't supported: files go to EXPORT_DIRECTORY")
    if p["EXPORT_TABLE_METHOD"] not in ("reduceRegions", "reduceRegion"):
        raise ValueError(f"unknown EXPORT_TABLE_METHOD {p['EXPORT_TABLE_METHOD']}")
    if p["INTERVAL_UNIT"] not in ("day", "month", "year"):
        raise ValueError(f"unknown INTERVAL_UNIT {p['INTERVAL_UNIT']}")
    if not isinstance(p["STM_FOLDING_LIST_ITER"], bool):
        raise ValueError("STM_FOLDING_LIST_ITER is true or false")
    if not 1 <= p["EXPORT_TABLE_TILE_SCALE"] <= 64:
        raise ValueError("EXPORT_TABLE_TILE_SCALE is a number from 1 to 64")


def create_parameter_file(path: str | Path, overwrite: bool = False) -> Path:
    """A file of all parameters with their defaults, to edit."""
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    import yaml

    path.write_text(yaml.safe_dump(DEFAULTS, sort_keys=False))
    return path


def image_size_mb(box: tuple[float, float, float, float], pixel: float, bands: int, dtype: str = "int16", degrees: bool = True) -> float:
    """Megabytes that an image of a box takes uncompressed; a degree is measured at the middle latitude."""
    x0, y0, x1, y1 = box
    kx, ky = (111_320 * math.cos(math.radians((y0 + y1) / 2)), 110_574) if degrees else (1, 1)
    size = {"int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "float": 4, "double": 8}[dtype]
    return math.ceil((x1 - x0) * kx / pixel) * math.ceil((y1 - y0) * ky / pixel) * bands * size / 1e6
