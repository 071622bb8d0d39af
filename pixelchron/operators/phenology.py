"""Land-surface phenology in polar coordinates (after Brooks 2020): the year is a circle, and the season starts opposite to the mean vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import doy0, doy_to_radians, ms, radians_to_doy
from ..schema import KEYS, MS_DAY, MS_YEAR

PERCENTILES = {"SOS": 0.15, "SOP": 0.25, "MOS": 0.50, "EOP": 0.75, "EOS": 0.80}


def _mean_vector(band: str, ts: str) -> tuple[Column, Column]:
    angle = doy_to_radians(doy0(ts))
    return F.avg(F.col(band) * F.cos(angle)), F.avg(F.when(F.col(band).isNotNull(), F.col(band) * F.sin(angle)))


def _vector_days(x: Column, y: Column) -> tuple[Column, Column]:
    """The day of a vector and the day opposite to it."""
    r = F.atan2(y, x)
    r = F.when(r <= 0, r + 2 * F.pi()).otherwise(r)
    return radians_to_doy(r), radians_to_doy(F.when(r >= F.pi(), r - F.pi()).otherwise(r + F.pi()))


def polar_vector(df: DataFrame, band: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Per key RAVG, the day of the mean vector, and THETA, the day opposite to it."""
    x, y = _mean_vector(band, ts)
    out = df.filter(F.col(band).isNotNull()).groupBy(*keys).agg(x.alias("_x"), y.alias("_y"))
    day, opposite = _vector_days(F.col("_x"), F.col("_y"))
    return out.select(*keys, day.alias("RAVG"), opposite.alias("THETA"))


def with_vector(df: DataFrame, band: str, keys: list[str], ts: str, names: tuple[str, str]) -> DataFrame:
    """The same beside each row, under names; rows of keys without a value go. A window, so that df is computed once and nothing is joined back."""
    over = Window.partitionBy(*keys)
    x, y = _mean_vector(band, ts)
    df = df.withColumns({"_x": x.over(over), "_y": y.over(over)}).filter("_x is not null")
    day, opposite = _vector_days(F.col("_x"), F.col("_y"))
    return df.withColumns({names[0]: day, names[1]: opposite}).drop("_x", "_y")


def season_bounds(year: Column, theta: Column, first: Column) -> tuple[Column, Column]:
    """Milliseconds of start and end of the season counted to a year: it starts in the year before if THETA is in the second half."""
    since = (year - F.when(first == 1, 0).otherwise(1) - 1970).cast("long")
    start = since * F.lit(MS_YEAR) + theta.cast("long") * F.lit(MS_DAY)
    return start, start + MS_YEAR


def season_windows(df: DataFrame, band: str, years: tuple[int, int], keys: tuple[str, ...] = KEYS, ts: str = "ts", adjust: bool = False, max_days: int = 40) -> DataFrame:
    """Observations with their season: year, RAVG, THETA, valid_firstyear, t_start, t_end (ms), and with adjust the season's own vector and window.

    Years are exploded from a literal sequence, which each observation leaves by its season's bounds: at most two stay. With adjust the window moves by the difference of the
    season's own THETA, at most max_days, and what stays is in both windows.
    """
    rows = with_vector(df, band, list(keys), ts, ("RAVG", "THETA")).withColumns({"valid_firstyear": (F.col("THETA") < 183).cast("int"), "_t": ms(ts)})
    # The only candidates are the calendar year and its neighbours.
    rows = rows.withColumn("year", F.explode(F.sequence(F.greatest(F.year(ts) - 1, F.lit(years[0])), F.greatest(F.least(F.year(ts) + 1, F.lit(years[1])), F.greatest(F.year(ts) - 1, F.lit(years[0]))))))
    rows = rows.filter(F.col("year").between(*years))
    start, end = season_bounds(F.col("year"), F.col("THETA"), F.col("valid_firstyear"))
    rows = rows.withColumns({"t_start": start, "t_end": end}).filter("_t >= t_start and _t < t_end")
    if not adjust:
        return rows
    rows = with_vector(rows, band, [*keys, "year"], ts, ("RAVG_s", "THETA_s"))
    turn = F.pmod(F.col("THETA_s") - F.col("THETA") + 183, F.lit(365)) - 183
    shift = F.least(F.greatest(turn, F.lit(-max_days)), F.lit(max_days)).cast("long") * MS_DAY
    rows = rows.withColumns({"t_start_adj": F.col("t_start") + shift, "t_end_adj": F.col("t_end") + shift})
    return rows.filter("_t >= t_start_adj and _t < t_end_adj")


def cumulative(df: DataFrame, band: str, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("_t", "scene_id")) -> DataFrame:
    """Adds CUM, the running sum of band * 10000 cut to whole numbers, over the season; a missing value leaves the sum as it was. NULL where it is 0 and after it first reached its total."""
    w = Window.partitionBy(*keys, "year").orderBy(*(o for o in order if o in df.columns))
    every = Window.partitionBy(*keys, "year")
    rows = df.withColumn("_c", F.sum(F.coalesce((F.col(band) * 10000).cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_top", F.max("_c").over(every))
    rows = rows.withColumn("_full", F.min(F.when(F.col("_c") == F.col("_top"), F.col("_t"))).over(every))
    return rows.withColumn("CUM", F.when((F.col("_c") != 0) & (F.col("_t") <= F.col("_full")), F.col("_c"))).drop("_c", "_top", "_full")


def phenology(df: DataFrame, band: str = "NDVI", years: tuple[int, int] = (2020, 2021), keys: tuple[str, ...] = KEYS, ts: str = "ts", adjust: bool = False, max_days: int = 40) -> DataFrame:
    """LSP: per pixel and year THETA, RAVG, valid_firstyear, t_start, t_end (days since 1970), and SOS, SOP, MOS, EOP, EOS.

    Each metric is the day of year (1 on January 1st) of the observation whose cumulative value is nearest to the 15th, 25th, 50th, 75th or 80th percentile of the
    cumulative values; of equals the last day. All windows share one partitioning by pixel and year.
    """
    rows = cumulative(season_windows(df, band, years, keys, ts, adjust, max_days), band, keys)
    groups = [*keys, "year"]
    every = Window.partitionBy(*groups)
    rows = rows.withColumn("_q", F.percentile("CUM", F.array(*map(F.lit, PERCENTILES.values()))).over(every))
    day = F.dayofyear(ts)
    for i, name in enumerate(PERCENTILES):
        gap = F.abs(F.col("CUM") - F.get(F.col("_q"), F.lit(i)))
        rows = rows.withColumn(f"_d_{name}", F.when(gap.isNotNull(), F.struct(F.round(-gap, 6).alias("g"), day.alias("d"))))
    extra = ["THETA_s", "RAVG_s", "t_start_adj", "t_end_adj"] if adjust else []
    fixed = ["THETA", "RAVG", "valid_firstyear", "t_start", "t_end", *extra]
    out = rows.groupBy(*groups).agg(*(F.first(c).alias(c) for c in fixed), *(F.max(f"_d_{n}")["d"].alias(n) for n in PERCENTILES))
    days = [c for c in fixed if c.startswith("t_")]
    return out.withColumns({c: (F.col(c) / MS_DAY).cast("int") for c in days})


def by_year(df: DataFrame, years: tuple[int, int], keys: tuple[str, ...] = KEYS, metrics: tuple[str, ...] = tuple(PERCENTILES)) -> DataFrame:
    """The image form: <metric>_<year> columns, one row per pixel."""
    wanted = [F.max(F.when(F.col("year") == y, F.col(m))).alias(f"{m}_{y}") for m in metrics for y in range(years[0], years[1] + 1)]
    return df.groupBy(*keys).agg(*wanted)
