"""Named reducers, one aggregation for many of them over many bands, and rounding."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENTILES = {f"p{q}": q / 100 for q in (1, *range(5, 100, 5), 99)}
SIMPLE: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max, "stdDev": F.stddev_pop, "variance": F.var_pop,
    "skew": F.skewness, "kurtosis": F.kurtosis, "count": F.count, "mode": lambda c: F.mode(c, True), "countDistinct": F.countDistinct,
}
ORDERED = {"first": F.min_by, "last": F.max_by}
NAMES = [*SIMPLE, *ORDERED, *PERCENTILES]


def round_half_away(c: Column, places: int) -> Column:
    """A double rounded as C does it, on the scaled number; Spark's round goes by the shortest decimal text, which can fall to the other side of a half."""
    return F.round(c * 10.0**places) / 10.0**places


def check(reducers: list[str]) -> None:
    if unknown := [r for r in reducers if r not in NAMES]:
        raise ValueError(f"unknown reducers: {unknown}")


def reduce_bands(df: DataFrame, keys: list[str], bands: list[str], reducers: list[str], order: tuple[str, ...] = ("ts", "scene_id"), suffix: bool = True) -> DataFrame:
    """One row per key with <band>_<reducer>, from a single pass and a single shuffle.

    All percentiles of a band are one exact aggregate. first and last are the non-null values that come first or last by order.
    """
    check(reducers)
    wanted = [r for r in reducers if r in PERCENTILES]
    aggregates = []
    for b in bands:
        c = F.col(b)
        if wanted:
            aggregates.append(F.percentile(c, F.array(*(F.lit(PERCENTILES[r]) for r in wanted))).alias(f"_q_{b}"))
        for r in reducers:
            if r in SIMPLE:
                aggregates.append(SIMPLE[r](c).alias(f"_{r}_{b}"))
            elif r in ORDERED:
                by = F.struct(*(F.col(o) for o in order if o in df.columns))
                aggregates.append(ORDERED[r](c, F.when(c.isNotNull(), by)).alias(f"_{r}_{b}"))
    grouped = df.groupBy(*keys).agg(*aggregates)
    out = []
    for b in bands:
        for r in reducers:
            value = F.get(F.col(f"_q_{b}"), F.lit(wanted.index(r))) if r in PERCENTILES else F.col(f"_{r}_{b}")
            out.append(value.alias(f"{b}_{r}" if suffix else b))
    return grouped.select(*keys, *out)


def split_name(column: str) -> tuple[str, str] | None:
    """Band and reducer of a column name."""
    m = re.fullmatch(rf"(.+)_({'|'.join(sorted(NAMES, key=len, reverse=True))})", column)
    return (m[1], m[2]) if m else None
