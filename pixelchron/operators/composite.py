"""Pixel-based composites: the observation with the best score, per pixel and fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import INDICES
from ..functions.reducers import round_half_away
from ..functions.times import doy0, ms
from ..plans.folds import Fold, join_folds
from ..schema import KEYS, OPTICAL


def best_pixel(df: DataFrame, score: str, bands: list[str], keys: list[str], ts: str = "ts", invert: bool = False) -> DataFrame:
    """The bands of the row with the greatest score (invert: least); of equals the earliest (ts, scene_id). Rows without a score don't count.

    A minimum by one struct: partial ones are taken before the shuffle and one row per key crosses it for each task. Rows without a score are passed over by the
    minimum and not by a filter: Spark would push that below the masks and compute the score's whole expression once more, in code too large to compile.
    """
    s = -F.col(score) if invert else F.col(score)
    least = F.when(s.isNotNull(), F.struct((-s).alias("s"), ms(ts).alias("t"), F.col("scene_id").alias("i")))
    row = F.struct(*(F.col(c) for c in dict.fromkeys([*bands, ts, "scene_id", score])))
    out = df.groupBy(*keys).agg(F.min_by(row, least).alias("_r")).filter("_r is not null")
    return out.select(*keys, "_r.*")


def composite_feature(df: DataFrame, feature: str, bands: list[str], keys: tuple[str, ...] = KEYS, folds: list[Fold] | None = None, invert: bool = False, ts: str = "ts") -> DataFrame:
    """By the greatest or, inverted, least value of a feature, a column or a known index (MAX-NDVI, MAX-RNB and so on)."""
    if feature not in df.columns:
        df = df.withColumn(feature, INDICES[feature]())
    rows, groups = (df, [*keys]) if folds is None else (join_folds(df, folds, ts), [*keys, "fold_key"])
    return best_pixel(rows, feature, bands, groups, ts, invert)


def composite_nlcd(df: DataFrame, bands: list[str], keys: tuple[str, ...] = KEYS, folds: list[Fold] | None = None, ts: str = "ts", centre: tuple[str, ...] = OPTICAL) -> DataFrame:
    """The observation nearest to the median of six bands (Jin 2023). Medians are one aggregation, joined back on the same keys.

    Scores are rounded to 12 places: two observations as far from the median on either side tie, whatever the last bits of their differences.
    """
    rows, groups = (df, [*keys]) if folds is None else (join_folds(df, folds, ts), [*keys, "fold_key"])
    medians = rows.groupBy(*groups).agg(*(F.median(b).alias(f"_m_{b}") for b in centre))
    score = F.lit(0.0)
    for b in centre:
        d = F.col(b) - F.col(f"_m_{b}")
        score = score - d * d
    rows = rows.join(medians, groups).withColumn("SCORE", round_half_away(score, 12)).drop(*(f"_m_{b}" for b in centre))
    return best_pixel(rows, "SCORE", bands, groups, ts)


def bap_scores(df: DataFrame, equal_year: float = 30, min_cloud: float = 0, max_cloud: float = 500, weight_doy: float = 0.6, weight_year: float = 0.2, weight_cloud: float = 0.2, ts: str = "ts") -> DataFrame:
    """Adds DOY_SCORE, YEAR_SCORE, CLOUD_SCORE and SCORE (Griffiths 2013) to rows with their fold's centers and offsets, mask and distance.

    Without a day-of-year fold the day scores 1; without a year center every year scores 0; without a cloud near the distance scores 1.
    """
    third = F.col("doy_offset") / 3.0

    def bell(x: Column) -> Column:
        z = F.try_divide(x, third)
        return F.when(third.isNull() | (third == 0), F.lit(1.0)).otherwise(F.exp(-0.5 * z * z))

    doy = bell(doy0(ts) - F.col("doy_center"))
    equal = bell(F.lit(-float(equal_year)))
    gap = F.abs(F.year(ts) - F.coalesce("year_center", F.lit(0)))
    off = F.coalesce("year_offset", F.lit(0))
    year = F.when(gap > off, 0.0).when(gap > 1, equal * (1 - F.coalesce(F.try_divide(gap - 1, off - 1), F.lit(0.0)))).when(gap == 1, equal).otherwise(1.0)
    d = F.col("distance")
    cloud = F.when((F.col("mask") == 0) | (d <= min_cloud), 0.0).when(d <= max_cloud, (d - min_cloud) / (max_cloud - min_cloud)).otherwise(1.0)
    df = df.withColumns({"DOY_SCORE": doy, "YEAR_SCORE": year, "CLOUD_SCORE": cloud})
    return df.withColumn("SCORE", weight_cloud * F.col("CLOUD_SCORE") + weight_doy * F.col("DOY_SCORE") + weight_year * F.col("YEAR_SCORE"))


def composite_bap(df: DataFrame, bands: list[str], folds: list[Fold], keys: tuple[str, ...] = KEYS, ts: str = "ts", **weights: float) -> DataFrame:
    """Best available pixel; df has mask and distance (see cloud_distance). Masked rows don't compete."""
    rows = bap_scores(join_folds(df, folds, ts), ts=ts, **weights)
    return best_pixel(rows.filter("mask = 1"), "SCORE", bands, [*keys, "fold_key"], ts)
