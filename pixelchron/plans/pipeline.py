"""The whole chain from parameters to products: collections, products per pixel, phenology, export.

A stage takes and returns a dictionary of parameters and products; every product is a lazy DataFrame, and Catalyst sees the chain from scan to
product as one plan. One thing runs as a plan is made: interpolation reads the first and last time of its collection, to know its grid.
"""

from __future__ import annotations

import math
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indices import add_features
from ..functions.reducers import check
from ..functions.times import parse_day, yyyymmdd
from ..operators import composite, export, interpolation, masking, phenology, series, spatial
from ..operators.unmix import unmix
from ..schema import HLS, LANDSAT, OPTICAL, QA_BANDS
from ..sources import roi as regions
from ..sources import scans
from .config import check_parameters, load_parameters, merge_parameters
from .folds import Fold, make_folds

Table = DataFrame | str
KERNELS = {"1RBF": 1, "2RBF": 2, "3RBF": 3}


def _period(p: dict) -> scans.Period:
    if p["DATE_MIN"] and p["DATE_MAX"]:
        return scans.Period.of_dates(p["DATE_MIN"], p["DATE_MAX"])
    return scans.Period((p["YEAR_MIN"], p["YEAR_MAX"]), (p["MONTH_MIN"], p["MONTH_MAX"]), (p["DOY_MIN"], p["DOY_MAX"]))


def keys_of(df: DataFrame) -> tuple[str, ...]:
    """A pixel's key: its tile too, where the table has tiles."""
    return ("tile_id", "px", "py") if "tile_id" in df.columns else ("px", "py")


def _images_of(df: DataFrame) -> tuple[str, ...]:
    return ("tile_id", "scene_id") if "tile_id" in df.columns else ("scene_id",)


def _grown(df: DataFrame, p: dict) -> DataFrame:
    """The mask with small clouds gone and others grown, on a grid as coarse as ERODE_DILATE_SCALE."""
    if p["ERODE_DILATE_SCALE"] > p["PIX_RES"]:
        return _coarse(df, p)
    return masking.erode_dilate(df, p["ERODE_RADIUS"], p["DILATE_RADIUS"], p["PIX_RES"], _images_of(df))


def _coarse(df: DataFrame, p: dict) -> DataFrame:
    """Growing on coarse pixels: the least of the mask in each, then back to the pixels in it."""
    images, n = list(_images_of(df)), max(1, round(p["ERODE_DILATE_SCALE"] / p["PIX_RES"]))
    cells = df.withColumns({"_cx": F.floor(F.col("px") / n), "_cy": F.floor(F.col("py") / n)})
    coarse = cells.groupBy(*images, F.col("_cx").alias("px"), F.col("_cy").alias("py")).agg(F.min("mask").alias("mask"))
    coarse = masking.erode_dilate(coarse, p["ERODE_RADIUS"], p["DILATE_RADIUS"], p["ERODE_DILATE_SCALE"], tuple(images))
    coarse = coarse.select(*images, F.col("px").alias("_cx"), F.col("py").alias("_cy"), F.col("mask").alias("_m"))
    return cells.join(coarse, [*images, "_cx", "_cy"], "left").withColumn("mask", F.coalesce("_m", "mask")).drop("_cx", "_cy", "_m")


def _masked(df: DataFrame, p: dict, valid) -> DataFrame:
    """Sets the mask and NULLs all bands outside it; without masks every row is valid."""
    bands = [c for c, t in df.dtypes if t == "double" and c not in ("x", "y", *QA_BANDS)]
    df = df.withColumn("mask", F.lit(1) if valid is None else F.coalesce(valid, F.lit(False)).cast("int"))
    if valid is not None and p["ERODE_DILATE"]:
        df = _grown(df, p)
    return masking.blue_filter(masking.apply_mask(df, bands), bands, p["BLUE_MAX_MASKING"])


def _table(spark: SparkSession, tables: dict[str, Table], name: str) -> DataFrame:
    if name not in tables:
        raise ValueError(f"no table for {name}; given: {sorted(tables)}")
    return spark.read.parquet(tables[name]) if isinstance(tables[name], str) else tables[name]


def _sentinel2(spark: SparkSession, p: dict, tables: dict[str, Table], rois: list, period: scans.Period) -> DataFrame:
    how = p["MASKS_S2"]
    if how not in (None, "CPLUS", "PROB"):
        raise ValueError(f"unsupported MASKS_S2 {how}")
    linked = {"CPLUS": ("CS_PLUS", ("cs", "cs_cdf")), "PROB": ("CLOUD_PROBABILITY", ("probability",))}.get(how)
    df = scans.scan_sentinel2(_table(spark, tables, "S2"), rois, period, p["MAX_CLOUD"], *((_table(spark, tables, linked[0]), linked[1]) if linked else ()), box_only=p["ROI_SIMPLIFY_GEOM_TO_BBOX"])
    if how == "CPLUS":
        return _masked(df, p, masking.cloud_score_valid("cs", p["MASKS_S2_CPLUS"]))
    if how == "PROB":
        df = df.withColumn("mask", F.coalesce(masking.probability_valid(p["MASKS_S2_PROB"]), F.lit(False)).cast("int"))
        if scans.AZIMUTH_PROPERTY in df.columns and "SCL" in df.columns:
            df = masking.project_shadows(df, p["MASKS_S2_NIR_THRESH_SHADOW"], scale=max(120, p["PIX_RES"]), azimuth=scans.AZIMUTH_PROPERTY, image=_images_of(df))
        return _masked(df, p, F.col("mask") == 1)
    return _masked(df, p, None)


def run_level2(params: dict | str, tables: dict[str, Table], spark: SparkSession | None = None) -> dict:
    """Adds TSS (and CIC_COLLECTION, TSM_COLLECTION) to the parameters: observations with masked bands, features and mask."""
    spark = spark or SparkSession.active()
    p = merge_parameters(load_parameters(params))
    check_parameters(p)
    rois, period = regions.parse_roi(p["ROI"]) if p["ROI"] is not None else [], _period(p)
    sensors = list(p["SENSORS"] or [])
    landsat, hls = [s for s in sensors if s in LANDSAT], [s for s in sensors if s in HLS or s == "HLS"]
    if unknown := [s for s in sensors if s not in (*LANDSAT, *HLS, "HLS", "S2")]:
        raise ValueError(f"unknown sensors: {unknown}")
    frames = []
    if landsat:
        df = scans.scan_landsat({s: _table(spark, tables, s) for s in landsat}, landsat, rois, period, p["MAX_CLOUD"], p["GCP_MIN_LANDSAT"], p["EXCLUDE_SLCOFF"], box_only=p["ROI_SIMPLIFY_GEOM_TO_BBOX"])
        frames.append(_masked(df, p, masking.landsat_valid(p["MASKS_LANDSAT"], p["MASKS_LANDSAT_CONF"]) if p["MASKS_LANDSAT"] else None))
    if "S2" in sensors:
        frames.append(_sentinel2(spark, p, tables, rois, period))
    satellite = "LSS2" if len(frames) == 2 else "LSAT" if landsat else "SEN2"
    if not frames and hls:
        satellite = "HLS" if "HLS" in hls or len(hls) == 2 else {"HLSL30": "HLSL", "HLSS30": "HLSS"}[hls[0]]
        collection = "HLS" if satellite == "HLS" else hls[0]
        df = scans.scan_hls({s: _table(spark, tables, s) for s in (HLS if collection == "HLS" else [collection])}, collection, rois, period, p["MAX_CLOUD"], box_only=p["ROI_SIMPLIFY_GEOM_TO_BBOX"])
        frames.append(_masked(df, p, masking.hls_valid(p["MASKS_HLS"]) if p["MASKS_HLS"] else None))
    if not frames and not p["CIC"]:
        raise ValueError("SENSORS names no sensor")
    out = dict(p, SATELLITE=satellite, ROIS=rois, PERIOD=period)
    if frames:
        tss, features = scans.union(frames), list(p["FEATURES"])
        tss = add_features(tss, features, p["CUSTOM_FORMULAS"])
        fixed = [c for c in ("tile_id", "px", "py", "x", "y", "scene_id", "ts", "sensor", "mask") if c in tss.columns]
        tss = tss.select(*fixed, *features)
        if p["UMX"]:
            tss = unmix(tss, features, p["UMX"], p["UMX_SUM_TO_ONE"], p["UMX_NON_NEGATIVE"], p["UMX_REMOVE_INPUT_FEATURES"])
            features = [*([] if p["UMX_REMOVE_INPUT_FEATURES"] else features), *p["UMX"]]
        out |= {"TSS": tss, "FEATURES": features}
    if p["CIC"]:
        out["CIC_COLLECTION"] = scans.scan_custom(spark.read.parquet(p["CIC"]) if isinstance(p["CIC"], str) else p["CIC"], p["CIC_FEATURES"], rois, period, box_only=p["ROI_SIMPLIFY_GEOM_TO_BBOX"])
    if p["TSM"]:
        base, bands = base_of(out, p["TSM_BASE_IMGCOL"])
        out["TSM_COLLECTION"] = series.daily_mosaic(base, bands, keys_of(base))
    return out


def base_of(p: dict, name: str) -> tuple[DataFrame, list[str]]:
    """The collection a parameter names, and its bands."""
    df = p.get({"TSS": "TSS", "CIC": "CIC_COLLECTION", "TSM": "TSM_COLLECTION", "TSI": "TSI_COLLECTION"}.get(name, name))
    if not isinstance(df, DataFrame):
        raise ValueError(f"the collection {name} isn't there")
    if name == "CIC":
        return df, p["CIC_FEATURES"] or [c for c, t in df.dtypes if t in ("double", "float") and c not in ("x", "y")]
    return df, p["FEATURES"]


def folds_of(p: dict) -> list[Fold]:
    dates = (p["DATE_MIN"], p["DATE_MAX"]) if p["DATE_MIN"] and p["DATE_MAX"] else None
    return make_folds((p["YEAR_MIN"], p["YEAR_MAX"]), (p["MONTH_MIN"], p["MONTH_MAX"]), (p["DOY_MIN"], p["DOY_MAX"]), dates, p["FOLD_YEAR"], p["FOLD_MONTH"], p["FOLD_CUSTOM"])


def _composite(p: dict, base: DataFrame, bands: list[str], folds: list[Fold] | None) -> DataFrame:
    keys, kind = keys_of(base), p["PBC"]
    if kind == "BAP":
        pixels = base.select(*_images_of(base), "px", "py", "mask").distinct()
        near = masking.cloud_distance(pixels, p["PBC_BAP_MAX_CLOUDDISTANCE"], p["PIX_RES"], _images_of(base)).drop("mask")
        rows = base.join(near, [*_images_of(base), "px", "py"], "left")
        return composite.composite_bap(rows, bands, folds or folds_of(p), keys, equal_year=p["PBC_BAP_DOY_EQ_YEAR"], min_cloud=p["PBC_BAP_MIN_CLOUDDISTANCE"], max_cloud=p["PBC_BAP_MAX_CLOUDDISTANCE"], weight_doy=p["PBC_BAP_WEIGHT_DOY"], weight_year=p["PBC_BAP_WEIGHT_YEAR"], weight_cloud=p["PBC_BAP_WEIGHT_CLOUD"])
    if kind == "NLCD":
        return composite.composite_nlcd(base, bands, keys, folds, centre=tuple(b for b in OPTICAL if b in base.columns))
    feature = {"MAX-NDVI": "NDVI", "MAX-RNB": "RNB"}.get(kind, kind)
    if feature not in base.columns and feature not in ("NDVI", "RNB"):
        raise ValueError(f"PBC {kind} is neither a method nor a feature")
    return composite.composite_feature(base, feature, bands, keys, folds, p["PBC_INVERT_QUALITY_METRIC"])


def run_level3(p: dict) -> dict:
    """Adds the products that the parameters ask for: NVO_IMAGE, TSI_COLLECTION, STM_IMAGE, PBC_IMAGE."""
    out = dict(p)
    folds = folds_of(p)
    if p["NVO"]:
        base, bands = base_of(out, "TSS" if "TSS" in out else "CIC")
        out["NVO_IMAGE"] = series.valid_observations(base, bands, keys_of(base), folds if p["NVO_FOLDING"] else None)
    if p["TSI"]:
        base, bands = base_of(out, p["TSI_BASE_IMGCOL"])
        if p["TSI"] in KERNELS:
            n = KERNELS[p["TSI"]]
            tsi = interpolation.rbf(base, bands, (p["SIGMA1"], p["SIGMA2"], p["SIGMA3"])[:n], (p["WIN1"], p["WIN2"], p["WIN3"])[:n], p["INTERVAL"], p["BW1"], p["BW2"], keys_of(base), january=p["INIT_JANUARY_1ST"], unit=p["INTERVAL_UNIT"])
        elif p["TSI"] == "WLIN":
            tsi = interpolation.linear(base, bands, p["INTERVAL"], p["WIN1"], keys_of(base), january=p["INIT_JANUARY_1ST"], unit=p["INTERVAL_UNIT"])
        else:
            raise ValueError(f"unknown TSI {p['TSI']}")
        out["TSI_COLLECTION"] = tsi.withColumn("ts", F.timestamp_millis("t_ms")).withColumn("scene_id", yyyymmdd("ts"))
    if p["STM"]:
        check(p["STM"])
        base, bands = base_of(out, p["STM_BASE_IMGCOL"])
        out["STM_IMAGE"] = series.temporal_metrics(base, bands, p["STM"], keys_of(base), folds if p["STM_FOLDING"] else None)
    if p["PBC"]:
        base, bands = base_of(out, p["PBC_BASE_IMGCOL"])
        out["PBC_IMAGE"] = _composite(p, base, bands, folds if p["PBC_FOLDING"] else None)
    return out


def run_level4(p: dict) -> dict:
    """Adds LSP_COLLECTION, a row per pixel and year, and LSP_IMAGE, a row per pixel."""
    out = dict(p)
    if p["LSP"] is None:
        return out
    if p["LSP"] != "POLAR":
        raise ValueError(f"unknown LSP {p['LSP']}")
    base, _ = base_of(out, p["LSP_BASE_IMGCOL"])
    low, high = (parse_day(p["DATE_MIN"]).year, parse_day(p["DATE_MAX"]).year) if p["DATE_MIN"] and p["DATE_MAX"] else (p["YEAR_MIN"], p["YEAR_MAX"])
    years = (p["LSP_YEAR_MIN"] or low, p["LSP_YEAR_MAX"] or high)
    lsp = phenology.phenology(base, p["LSP_BAND"], years, keys_of(base), adjust=p["LSP_ADJUST_SEASONAL"], max_days=p["LSP_ADJUST_SEASONAL_MAX_DAYS"])
    return out | {"LSP_COLLECTION": lsp, "LSP_IMAGE": phenology.by_year(lsp, years, keys_of(base))}


def _time_text(p: dict) -> str:
    if p["DATE_MIN"] and p["DATE_MAX"]:
        return f"{p['DATE_MIN']}-{p['DATE_MAX']}"
    text = f"{p['YEAR_MIN']}-{p['YEAR_MAX']}"
    return text + f"_{p['MONTH_MIN']:02d}-{p['MONTH_MAX']:02d}_{p['DOY_MIN']:03d}-{p['DOY_MAX']:03d}" if p["EXPORT_DESC_DETAIL_TIME"] else text


def run_export(p: dict) -> dict:
    """Writes the products asked for under EXPORT_DIRECTORY, and adds EXPORTED, the paths.

    An image is Parquet with a row per pixel and time or fold, partitioned by tile where there are tiles and by day with
    EXPORT_PER_TIME, scaled and cast. A table is what the region's features hold: reduced by EXPORT_TABLE_REDUCER, complete rows only.
    """
    written: dict[str, str] = {}
    if not (p["EXPORT_IMAGE"] or p["EXPORT_TABLE"]):
        return dict(p, EXPORTED=written)
    if not p["EXPORT_DIRECTORY"]:
        raise ValueError("EXPORT_DIRECTORY is needed to export")
    products = {"TSS": "TSS", "CIC": "CIC_COLLECTION", "TSM": "TSM_COLLECTION", "NVO": "NVO_IMAGE", "TSI": "TSI_COLLECTION", "STM": "STM_IMAGE", "PBC": "PBC_IMAGE", "LSP": "LSP_COLLECTION"}
    for name, key in products.items():
        if not p[f"EXPORT_{name}"]:
            continue
        df = p.get(key)
        if not isinstance(df, DataFrame):
            raise ValueError(f"{name} is to be exported but wasn't made")
        keys, fixed = keys_of(df), ("tile_id", "px", "py", "x", "y", "scene_id", "ts", "sensor", "mask", "day", "fold_key", "k", "t_ms", "year", "SCORE")
        bands = [c for c in df.columns if c not in fixed]
        plain = name in ("NVO", "LSP")
        how = {} if plain else {"scale": p["DATATYPE_SCALE"], "dtype": p["DATATYPE"], "nodata": p["NODATA_VALUE"]}
        path = "_".join(x for x in (f"{p['EXPORT_DIRECTORY']}/{name}", p["EXPORT_DESC"], _time_text(p), p["SATELLITE"]) if x)
        parts = [c for c in ("tile_id",) if c in df.columns]
        if p["EXPORT_IMAGE"]:
            rows = df
            if p["EXPORT_PER_TIME"] and "ts" in df.columns:
                rows, parts = df.withColumn("date", yyyymmdd("ts")), [*parts, "date"]
            groups = [[b] for b in bands] if p["EXPORT_PER_FEATURE"] else [bands]
            staged = f"{path}_staged" if len(groups) > 1 else None
            if staged:  # computed once, whatever the number of bands
                rows.write.mode("overwrite").parquet(staged)
                rows = rows.sparkSession.read.schema(rows.schema).parquet(staged)
            for group in groups:
                to = f"{path}_{group[0]}" if p["EXPORT_PER_FEATURE"] else path
                rest = [c for c in rows.columns if c not in bands]
                export.export_image(rows.select(*rest, *group), to, group, keys, partition=parts or None, bandnames_csv=p["EXPORT_BANDNAMES_AS_CSV"], **how)
                written[Path(to).name] = to
            if staged:
                gone = df.sparkSession._jvm.org.apache.hadoop.fs.Path(staged)
                gone.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(gone, True)
        if p["EXPORT_TABLE"]:
            table = _extracted(p, df, bands)
            names = [f"{b}_{p['EXPORT_TABLE_REDUCER']}" for b in bands]
            export.export_table(table, f"{path}_table", names, p["EXPORT_TABLE_FORMAT"], drop_nodata=p["EXPORT_TABLE_DROP_NODATA"], **how)
            written[f"{Path(path).name}_table"] = f"{path}_table"
    return dict(p, EXPORTED=written)


def _lengths(p: dict, y: Column, metres: float) -> tuple[Column, Column]:
    """A length in the units of either axis: degrees at latitude y unless CRS says that coordinates are metres."""
    if p["CRS"] in (None, "EPSG:4326"):
        return metres / (111_320 * F.cos(F.radians(y))), F.lit(metres / 110_574)
    return F.lit(float(metres)), F.lit(float(metres))


def _placed(p: dict, df: DataFrame) -> DataFrame:
    """A product with the coordinates of its pixels as px, py. Products of aggregations have none: they get those of their pixels, one row each, within the region's box."""
    if not {"x", "y"} <= set(df.columns):
        base = next((p[k] for k in ("TSS", "CIC_COLLECTION") if isinstance(p.get(k), DataFrame) and {"x", "y"} <= set(p[k].columns)), None)
        if base is None:
            return df
        keys, (x0, y0, x1, y1) = [*keys_of(df)], regions.bounds(p["ROIS"])
        if p["EXPORT_TABLE_BUFFER"] is None:
            base = base.filter(F.col("x").between(x0 - 0.01, x1 + 0.01) & F.col("y").between(y0 - 0.01, y1 + 0.01)) if p["CRS"] in (None, "EPSG:4326") else base
        df = df.join(base.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y")), keys)
    return df.drop("px", "py").withColumnsRenamed({"x": "px", "y": "py"})


def _extracted(p: dict, df: DataFrame, bands: list[str]) -> DataFrame:
    """The product at the region's features: by their polygons, or boxes with ROI_SIMPLIFY_GEOM_TO_BBOX, grown by EXPORT_TABLE_BUFFER metres. A point without a buffer is the pixel round it."""
    rois, image = p["ROIS"], tuple(c for c in ("tile_id", "fold_key", "year", "k", "t_ms", "scene_id", "ts") if c in df.columns)
    features = regions.features_table(df.sparkSession, rois).drop("attributes", *(["rings"] if p["ROI_SIMPLIFY_GEOM_TO_BBOX"] else []))
    y = (F.col("ymin") + F.col("ymax")) / 2
    buffer = _lengths(p, y, p["EXPORT_TABLE_BUFFER"] or 0)
    features = features.withColumns({"buffer_x": buffer[0], "buffer_y": buffer[1]})
    if not p["EXPORT_TABLE_BUFFER"]:
        half, point = dict(zip("xy", _lengths(p, y, p["PIX_RES"] / 2), strict=True)), (F.col("xmin") == F.col("xmax")) & (F.col("ymin") == F.col("ymax"))
        box = {f"{a}{m}": F.col(f"{a}{m}") + F.when(point, s * half[a]).otherwise(0.0) for a in "xy" for m, s in (("min", -1), ("max", 1))}
        if "rings" in features.columns:
            corner = lambda a, b: F.struct(box[f"x{a}"].alias("x"), box[f"y{b}"].alias("y"))
            box["rings"] = F.when(point, F.array(F.array(*(corner(a, b) for a, b in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max")))))).otherwise(F.col("rings"))
        features = features.withColumns(box)
    # Blocks of some pixels, but so many that no list of features makes more than a few hundred thousand of them.
    sides = [(r.box[2] - r.box[0], r.box[3] - r.box[1]) for r in rois]
    pixel = p["PIX_RES"] / 111_320 if p["CRS"] in (None, "EPSG:4326") else p["PIX_RES"]
    block = max(64 * pixel, math.sqrt(sum(a * b for a, b in sides) / 100_000), sum(map(sum, sides)) / 100_000)
    return spatial.zonal(_placed(p, df), features, bands, [p["EXPORT_TABLE_REDUCER"]], block=block, image=image, parts=p["EXPORT_TABLE_TILE_SCALE"])


def run_param(params: dict | str, tables: dict[str, Table], spark: SparkSession | None = None) -> dict:
    """Parameters to products; tables has a DataFrame or Parquet path for each sensor.

    With ROI_TILES the result has an entry for each feature of the region, by the attribute that ROI_TILES_ATTRIBUTE_COLUMN names. Each is a set of lazy plans. One run over a
    table with a tile_id column does the same without a loop.
    """
    p = merge_parameters(load_parameters(params))
    check_parameters(p)
    if not p["ROI_TILES"]:
        return reduce(lambda x, stage: stage(x), (run_level3, run_level4, run_export), run_level2(p, tables, spark))
    column = p["ROI_TILES_ATTRIBUTE_COLUMN"]
    if not column:
        raise ValueError("ROI_TILES needs ROI_TILES_ATTRIBUTE_COLUMN")
    if p["ROI"] is None:
        raise ValueError("ROI_TILES needs ROI")
    tiles = regions.select_features(regions.parse_roi(p["ROI"]), column, p["ROI_TILES_ATTRIBUTE_LIST"])
    return {t.attributes[column]: run_param(p | {"ROI": t, "ROI_TILES": False, "EXPORT_DESC": f"{p['EXPORT_DESC']}_{t.attributes[column]}"}, tables, spark) for t in tiles}
