"""Products per pixel over time: mosaics, valid observations, spectral-temporal metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reducers import reduce_bands
from ..plans.folds import Fold, join_folds
from ..schema import KEYS


def daily_mosaic(df: DataFrame, bands: list[str], keys: tuple[str, ...] = KEYS, ts: str = "ts", order: tuple[str, ...] = ("ts", "scene_id")) -> DataFrame:
    """One row per pixel and calendar day; each band from the latest acquisition that has it. TSM."""
    by = F.struct(*order)
    picks = [F.max_by(F.col(b), F.when(F.col(b).isNotNull(), by)).alias(b) for b in bands]
    out = df.withColumn("day", F.to_date(ts)).groupBy(*keys, "day").agg(F.min(ts).alias(ts), *picks)
    return out.withColumn("scene_id", F.date_format("day", "yyyyMMdd"))


def valid_observations(df: DataFrame, bands: list[str], keys: tuple[str, ...] = KEYS, folds: list[Fold] | None = None, ts: str = "ts") -> DataFrame:
    """NVO: how many calendar days have all bands, per pixel and, with folds, per fold."""
    full = reduce(lambda a, b: a & b, (F.col(b).isNotNull() for b in bands))
    day = F.when(full, F.to_date(ts))
    if folds is None:
        return df.groupBy(*keys).agg(F.countDistinct(day).alias("NVO"))
    return join_folds(df, folds, ts).groupBy(*keys, "fold_key").agg(F.countDistinct(day).alias("NVO"))


def clear_observations(df: DataFrame, band: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """CSO: observations of a band per pixel."""
    return df.groupBy(*keys).agg(F.count(band).alias("CSO"))


def temporal_metrics(df: DataFrame, bands: list[str], reducers: list[str], keys: tuple[str, ...] = KEYS, folds: list[Fold] | None = None, ts: str = "ts") -> DataFrame:
    """STM: <band>_<reducer> per pixel and, with folds, per fold."""
    if folds is None:
        return reduce_bands(df, list(keys), bands, reducers, (ts, "scene_id"))
    return reduce_bands(join_folds(df, folds, ts), [*keys, "fold_key"], bands, reducers, (ts, "scene_id"))


def nth_observation(df: DataFrame, n: int, keys: tuple[str, ...] = KEYS, ts: str = "ts") -> DataFrame:
    """The n-th observation of each pixel in time, from 0; -1 is the last."""
    order = [F.col(ts), F.col("scene_id")] if n >= 0 else [F.col(ts).desc(), F.col("scene_id").desc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") == (n + 1 if n >= 0 else -n)).drop("_i")


def unmatched(df: DataFrame, other: DataFrame, keys: tuple[str, ...] = (*KEYS, "scene_id")) -> DataFrame:
    """Rows of df whose keys other doesn't have."""
    return df.join(other.select(*keys).distinct(), [*keys], "left_anti")


def stack_bands(products: list[DataFrame], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Products of one row per pixel side by side; a pixel that one lacks has NULLs there. Products made by the same keys are already dealt out by them."""
    return reduce(lambda a, b: a.join(b, [*keys], "full"), products)


def attach_attributes(df: DataFrame, attributes: DataFrame, key: str, order: str) -> DataFrame:
    """Adds a table's attributes by key; of several rows with a key the first by order counts. Rows without a partner keep NULLs."""
    rest = [c for c in attributes.columns if c != key]
    one = attributes.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_a")).select(key, "_a.*")
    return df.join(one, key, "left")


def display_range(df: DataFrame, bands: list[str], low: float = 0.02, high: float = 0.98, accuracy: int | None = 10_000) -> DataFrame:
    """band, low, high: the values between which a display is stretched. Approximate, with a sketch of bounded size; exact without accuracy."""
    both = F.array(F.lit(low), F.lit(high))
    row = df.agg(*((F.percentile(b, both) if accuracy is None else F.percentile_approx(b, both, accuracy)).alias(b) for b in bands))
    return row.select(F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.get(b, F.lit(0)).alias("low"), F.get(b, F.lit(1)).alias("high")) for b in bands))))


def seasonal_metrics(df: DataFrame, bands: list[str], seasons: dict[str, tuple[int, ...]], key: str = "id", year: str = "year", window: int = 1, ts: str = "ts") -> DataFrame:
    """<season>_<band>_<metric> (p5 p25 p50 p75 p95 stdDev) per plot, within window years of its reference year; one pass for all seasons."""
    quantiles = [0.05, 0.25, 0.5, 0.75, 0.95]
    rows = df.filter(F.abs(F.year(ts) - F.col(year)) <= window)
    aggregates, out = [], []
    for season, months in seasons.items():
        inside = F.month(ts).isin(*months)
        for b in bands:
            v = F.when(inside, F.col(b))
            aggregates += [F.percentile(v, F.array(*map(F.lit, quantiles))).alias(f"_q_{season}_{b}"), F.stddev_pop(v).alias(f"_s_{season}_{b}")]
            out += [F.get(F.col(f"_q_{season}_{b}"), F.lit(i)).alias(f"{season}_{b}_p{int(q * 100)}") for i, q in enumerate(quantiles)]
            out.append(F.col(f"_s_{season}_{b}").alias(f"{season}_{b}_stdDev"))
    return rows.groupBy(key).agg(*aggregates).select(key, *out)
