"""Quality masks: expressions on flag bands, and neighbourhood operations on the mask."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OPTICAL

CONFIDENCE = {"Low": 1, "Medium": 2, "High": 3}
LANDSAT_BITS = {"fill": 0, "dilated": 1, "cirrus": 2, "cloud": 3, "cshadow": 4, "snow": 5, "water": 7}
HLS_BITS = {"cloud": 1, "cshadow": 3, "snow": 4}


def qa_bits(qa: Column, start: int, end: int) -> Column:
    """The number in bits start to end, both included."""
    return F.shiftright(qa, start).bitwiseAND(F.lit((1 << (end - start + 1)) - 1))


def in_range(bands: tuple[str, ...] = OPTICAL) -> Column:
    """All bands above 0 and below 1; missing ones are passed over."""
    return (F.least(*bands) > 0) & (F.greatest(*bands) < 1)


def landsat_valid(masks: list[str], confidence: str = "Medium", bands: tuple[str, ...] = OPTICAL) -> Column:
    """No named flag set, cloud and cirrus confidence below the level, no saturation, and bands in range."""
    if unknown := [m for m in masks if m not in LANDSAT_BITS]:
        raise ValueError(f"unknown mask names: {unknown}")
    bits, level, qa = sum(1 << LANDSAT_BITS[m] for m in set(masks)), CONFIDENCE[confidence], F.col("QA_PIXEL")
    return (qa.bitwiseAND(F.lit(bits)) == 0) & (qa_bits(qa, 8, 9) < level) & (qa_bits(qa, 14, 15) < level) & (F.col("QA_RADSAT") == 0) & in_range(bands)


def hls_valid(masks: list[str], bands: tuple[str, ...] = OPTICAL) -> Column:
    """No named Fmask flag and, always, not the lowest bit; unknown names are passed over."""
    bits = 1 | sum(1 << HLS_BITS[m] for m in set(masks) if m in HLS_BITS)
    return (F.col("Fmask").bitwiseAND(F.lit(bits)) == 0) & in_range(bands)


def cloud_score_valid(band: str = "cs", threshold: float = 0.6) -> Column:
    return F.col(band) >= threshold


def probability_valid(threshold: float = 30) -> Column:
    return F.col("probability") < threshold


def blue_filter(df: DataFrame, bands: list[str], threshold: float | None) -> DataFrame:
    """NULLs the bands where blue isn't between 0 and threshold; a threshold outside 0 to 1 changes nothing."""
    if threshold is None or not 0 < threshold < 1:
        return df
    keep = (F.col("BLU") > 0) & (F.col("BLU") < threshold)
    return df.select(*(F.when(keep, F.col(c)).alias(c) if c in bands else F.col(c) for c in df.columns))


def apply_mask(df: DataFrame, bands: list[str], valid: Column | None = None) -> DataFrame:
    """Sets mask (1 valid, 0 not) from valid, or takes the one there, and NULLs the bands where it isn't 1. Rows stay."""
    if valid is not None:
        df = df.withColumn("mask", F.coalesce(valid, F.lit(False)).cast("int"))
    return df.select(*(F.when(F.col("mask") == 1, F.col(c)).alias(c) if c in bands else F.col(c) for c in df.columns))


def disc(radius: float) -> list[tuple[int, int]]:
    """Pixel offsets within a radius in pixels."""
    r = int(radius)
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= radius * radius + 1e-9]


def _spread(df: DataFrame, offsets: list[tuple[int, int]], image: list[str]) -> DataFrame:
    """Each pixel once for each offset, at the place it reaches."""
    kernel = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets))
    out = df.withColumn("_o", F.explode(kernel))
    return out.select(*image, (F.col("px") + F.col("_o.dx")).alias("px"), (F.col("py") + F.col("_o.dy")).alias("py"), "_v", "_o")


def focal(df: DataFrame, radius: float, how: str, image: tuple[str, ...] = ("scene_id",), value: str = "mask") -> DataFrame:
    """The max or min of value over a disc round each pixel of df(image, px, py, value).

    Only the pixels that can change a neighbour are spread: zeros for a min, ones for a max. They are summed map-side by the place they
    reach and joined to the pixels on an equality of image and place; no pixel pairs are enumerated beyond the kernel.
    """
    wins = 0 if how == "min" else 1
    image = list(image)
    reach = _spread(df.filter(F.col(value) == wins).select(*image, "px", "py", F.col(value).alias("_v")), disc(radius), image)
    reach = reach.groupBy(*image, "px", "py").agg(F.first("_v").alias("_r"))
    return df.join(reach, [*image, "px", "py"], "left").withColumn(value, F.coalesce(F.col("_r"), F.col(value)).cast("int")).drop("_r")


def erode_dilate(df: DataFrame, erode_radius: float = 60, dilate_radius: float = 120, pixel: float = 30, image: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Validity first grows by erode_radius (small clouds go), then shrinks by dilate_radius (clouds that stay grow). Radii in metres, pixel the side of one."""
    return focal(focal(df, erode_radius / pixel, "max", image), dilate_radius / pixel, "min", image)


def cloud_distance(df: DataFrame, max_distance: float, pixel: float = 30, image: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Adds distance: metres to the nearest pixel with mask 0 of the image, NULL if none is within max_distance."""
    image = list(image)
    clouds = df.filter("mask = 0").select(*image, "px", "py", F.lit(0).alias("_v"))
    reach = _spread(clouds, disc(max_distance / pixel), image)
    square = F.col("_o.dx") * F.col("_o.dx") + F.col("_o.dy") * F.col("_o.dy")
    reach = reach.groupBy(*image, "px", "py").agg(F.min(square).alias("_d"))
    return df.join(reach, [*image, "px", "py"], "left").withColumn("distance", F.sqrt("_d") * pixel).drop("_d")


def project_shadows(df: DataFrame, nir_dark: float = 0.2, max_km: float = 5, scale: float = 120, azimuth: float | str = "solar_azimuth", image: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Clears mask where a cloud's shadow can fall: dark in NIR, not water (SCL 6), and on the line from a cloud away from the sun.

    The line is followed for max_km in pixels of scale. azimuth is a number or the column with the scene's value.
    """
    image = list(image)
    steps = round(max_km * 1000 / scale)
    angle = F.radians(F.lit(90.0) - (F.col(azimuth) if isinstance(azimuth, str) else F.lit(float(azimuth))))
    clouds = df.filter("mask = 0").select(*image, "px", "py", angle.alias("_a")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    x, y = F.col("px") + F.round(F.col("_k") * F.cos("_a")).cast("int"), F.col("py") + F.round(F.col("_k") * F.sin("_a")).cast("int")
    reach = clouds.select(*image, x.alias("px"), y.alias("py")).distinct().withColumn("_s", F.lit(1))
    out = df.join(reach, [*image, "px", "py"], "left")
    dark = (F.col("NIR") < nir_dark) & (F.col("SCL") != 6)
    return out.withColumn("mask", F.when(F.coalesce((F.col("_s") == 1) & dark, F.lit(False)), 0).otherwise(F.col("mask")).cast("int")).drop("_s")


def metres_to_pixels(metres: float, pixel: float) -> int:
    return math.ceil(metres / pixel)
