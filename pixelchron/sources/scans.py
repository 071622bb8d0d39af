"""Scans of sensor tables into observations: filters, band names, scaling, and unions of sensors.

A sensor table has one row per pixel and scene: px, py, x, y (the pixel's coordinate), scene_id, ts, the sensor's own band columns and the
scene's properties. Filters are on stored columns and go to the Parquet scan; tables partitioned by tile and year are pruned by them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import cyclic_between, parse_day
from ..schema import CLOUD_PROPERTY, HLS, LANDSAT, QA_BANDS, SENSOR_BANDS
from .roi import Roi, in_region

GCP_PROPERTY = "GROUND_CONTROL_POINTS_MODEL"
AZIMUTH_PROPERTY = "MEAN_SOLAR_AZIMUTH_ANGLE"
#: When the scan line corrector of sensor L7 worked, half-open.
SLC_ON = (date(1999, 4, 15), date(2003, 5, 30))
OPTICAL_SCALE, OPTICAL_OFFSET = 0.0000275, -0.2
THERMAL_SCALE, THERMAL_OFFSET = 0.00341802, 149.0
MSI_SCALE = 0.0001


@dataclass(frozen=True)
class Period:
    """A half-open range of dates, or years, months and days of year, all inclusive; months and days may wrap round the year's end."""

    years: tuple[int, int] = (1970, 2100)
    months: tuple[int, int] = (1, 12)
    doys: tuple[int, int] = (1, 366)
    dates: tuple[date, date] | None = None

    @classmethod
    def of_dates(cls, low: str | int, high: str | int) -> Period:
        return cls(dates=(parse_day(low), parse_day(high)))

    def holds(self, ts: str = "ts") -> Column:
        """The test for a time column. Years also give a range of times, which Parquet's statistics can prune."""
        t = F.col(ts)
        if self.dates:
            return (t >= F.lit(self.dates[0]).cast("timestamp")) & (t < F.lit(self.dates[1]).cast("timestamp"))
        low, high = date(self.years[0], 1, 1), date(self.years[1], 12, 31) + timedelta(1)
        test = (t >= F.lit(low).cast("timestamp")) & (t < F.lit(high).cast("timestamp"))
        if self.months != (1, 12):
            test = test & cyclic_between(F.month(t), *self.months)
        if self.doys != (1, 366):
            test = test & cyclic_between(F.dayofyear(t), *self.doys)
        return test


def filtered(df: DataFrame, sensor: str, rois: list[Roi] | None, period: Period | None, cloud_max: float | None, gcp_min: float = 0, box_only: bool = True) -> DataFrame:
    """Region, time, cloud cover and ground control points, where the table has such columns."""
    if rois:
        df = in_region(df, rois, box_only)
    if period:
        df = df.filter(period.holds())
    prop = CLOUD_PROPERTY.get(sensor)
    if cloud_max is not None and prop in df.columns:
        df = df.filter(F.col(prop) <= cloud_max)
    if sensor in LANDSAT and gcp_min and GCP_PROPERTY in df.columns:
        df = df.filter(F.col(GCP_PROPERTY) >= gcp_min)
    return df


def renamed(df: DataFrame, sensor: str) -> DataFrame:
    """The sensor's columns under common band names, with keys, scene columns and sensor; other columns go."""
    names = SENSOR_BANDS[sensor]
    fixed = [c for c in ("tile_id", "px", "py", "x", "y", "scene_id", "ts", AZIMUTH_PROPERTY) if c in df.columns]
    bands = [F.col(a).alias(b) for a, b in names.items() if a in df.columns]
    return df.select(*fixed, F.lit(sensor).alias("sensor"), *bands)


def scaled(df: DataFrame, bands: list[str], scale: float, offset: float = 0.0) -> DataFrame:
    return df.withColumns({b: F.col(b) * scale + offset for b in bands if b in df.columns})


def scan_landsat(tables: dict[str, DataFrame], sensors: list[str], rois: list[Roi] | None = None, period: Period | None = None, cloud_max: float = 75, gcp_min: float = 0, exclude_slc_off: bool = False, box_only: bool = True) -> DataFrame:
    """Observations of L4 to L9 as surface reflectance and temperature (kelvin)."""
    frames = []
    for s in sensors:
        df = filtered(tables[s], s, rois, period, cloud_max, gcp_min, box_only)
        if s == "L7" and exclude_slc_off:
            df = df.filter(Period(dates=SLC_ON).holds())
        df = renamed(df, s)
        df = scaled(df, [b for b in SENSOR_BANDS[s].values() if b not in QA_BANDS and b != "LST"], OPTICAL_SCALE, OPTICAL_OFFSET)
        frames.append(scaled(df, ["LST"], THERMAL_SCALE, THERMAL_OFFSET))
    return union(frames)


def scan_sentinel2(table: DataFrame, rois: list[Roi] | None = None, period: Period | None = None, cloud_max: float = 75, mask_table: DataFrame | None = None, mask_bands: tuple[str, ...] = ("cs", "cs_cdf"), box_only: bool = True) -> DataFrame:
    """Observations of S2 as reflectance (WV as stored), with a mask collection's bands linked by scene and pixel."""
    df = renamed(filtered(table, "S2", rois, period, cloud_max, box_only=box_only), "S2")
    df = scaled(df, [b for b in SENSOR_BANDS["S2"].values() if b not in QA_BANDS and b != "WV"], MSI_SCALE)
    return df if mask_table is None else link(df, mask_table, mask_bands)


def link(df: DataFrame, other: DataFrame, bands: tuple[str, ...], keys: tuple[str, ...] = ("scene_id", "px", "py")) -> DataFrame:
    """Bands of another collection at the same scene and pixel; rows without a partner keep NULLs."""
    on = [k for k in ("tile_id", *keys) if k in df.columns and k in other.columns]
    return df.join(other.select(*on, *bands), on, "left")


def scan_hls(tables: dict[str, DataFrame], collection: str = "HLS", rois: list[Roi] | None = None, period: Period | None = None, cloud_max: float = 75, box_only: bool = True) -> DataFrame:
    """Observations of HLSL30, HLSS30 or both; their values are reflectance already."""
    if collection not in ("HLS", *HLS):
        raise ValueError(f"unknown collection {collection}")
    wanted = HLS if collection == "HLS" else (collection,)
    return union([renamed(filtered(tables[s], s, rois, period, cloud_max, box_only=box_only), s) for s in wanted])


def scan_custom(table: DataFrame, features: list[str] | None = None, rois: list[Roi] | None = None, period: Period | None = None, box_only: bool = True) -> DataFrame:
    """A user's own collection: region and time only. Its bands are those named, or all columns but the keys."""
    df = filtered(table, "CIC", rois if {"x", "y"} <= set(table.columns) else None, period, None, box_only=box_only)
    fixed = [c for c in ("tile_id", "px", "py", "x", "y", "scene_id", "ts", "sensor", "mask") if c in df.columns]
    return df.select(*fixed, *(features or [c for c in df.columns if c not in fixed]))


def scan_static(table: DataFrame, band: str, rois: list[Roi] | None = None, box_only: bool = True) -> DataFrame:
    """A static layer such as elevation: one value per pixel, the mean of what overlaps."""
    df = in_region(table, rois, box_only) if rois else table
    return df.groupBy("px", "py").agg(F.avg(band).alias(band))


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows; a band that a sensor lacks is NULL."""
    if not frames:
        raise ValueError("no sensor is selected")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pixel_series(df: DataFrame, bands: list[str], px: int, py: int) -> DataFrame:
    """All times of a pixel in order: id, time (ms), bands."""
    return df.filter((F.col("px") == px) & (F.col("py") == py)).select(F.col("scene_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), *bands).orderBy("time", "id")


def read_series_csv(spark: SparkSession, path: str, values: list[str], date_column: str = "YYYYMMDD", nodata: float = -9999, keys: list[str] | None = None) -> DataFrame:
    """A long table from CSV: ts from date_column (rows without a valid date go), nodata as NULL."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=False)
    day = F.coalesce(F.try_to_timestamp(date_column, F.lit("yyyyMMdd")), F.try_to_timestamp(date_column, F.lit("yyyy-MM-dd")))
    picked = [F.when(F.col(v).try_cast("double") != nodata, F.col(v).try_cast("double")).alias(v) for v in values]
    return raw.select(*(keys or [c for c in raw.columns if c not in values and c != date_column]), day.alias("ts"), *picked).filter("ts is not null")


def read_band_names(spark: SparkSession, path: str) -> list[str]:
    """Names from a table of band and name, a list as long as an image has bands."""
    rows = spark.read.csv(path, header=True).collect()
    return [r["name"] for r in sorted(rows, key=lambda r: int(r["band"]))]


def dated_columns(df: DataFrame, prefix: str | None = None) -> list[tuple[str, str]]:
    """Columns whose name ends in eight digits, with those digits, by date."""
    found = [(c, re.findall(r"\d{8}", c)[-1]) for c in df.columns if re.search(r"\d{8}", c) and (prefix is None or c.startswith(prefix))]
    return sorted(found, key=lambda x: (x[1], x[0]))
