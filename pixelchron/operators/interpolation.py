"""Time-series interpolation on a regular grid: Gaussian kernels, linear, means; and the outlier envelope.

The grid is regular, so an observation reaches the steps of an interval that arithmetic gives. It is exploded to those steps and aggregated by
pixel and step: a range join without a join, with a map-side combine.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import ms
from ..schema import KEYS, MS_DAY


def grid_bounds(df: DataFrame, ts: str = "ts", january: bool = False) -> tuple[int, int]:
    """First and last milliseconds of the grid: of all observations, or from January 1st of the first year."""
    first, last = df.agg(F.min(ms(ts)), F.max(ms(ts))).first()
    if first is None:
        raise ValueError("there is no observation to interpolate")
    if january:
        year = date.fromordinal(date(1970, 1, 1).toordinal() + first // MS_DAY).year
        first = (date(year, 1, 1).toordinal() - date(1970, 1, 1).toordinal()) * MS_DAY
    return first, last


def time_grid(df: DataFrame, step: int = 16, unit: str = "day", ts: str = "ts", january: bool = False) -> DataFrame:
    """k, t: the steps from first to last observation, in days, months or years."""
    first, last = grid_bounds(df, ts, january)
    interval = F.expr(f"interval {int(step)} {unit}")
    rows = df.sparkSession.range(1).select(F.posexplode(F.sequence(F.timestamp_millis(F.lit(first)), F.timestamp_millis(F.lit(last)), interval)).alias("k", "t"))
    return rows.select(F.col("k").cast("int").alias("k"), "t")


def step_at(start: Column, k: Column, step: int, unit: str) -> Column:
    """Milliseconds of step k. Months and years are those of the calendar, with the start's day and time of day; a month without that day gives its last."""
    if unit == "day":
        return start + k.cast("long") * step * MS_DAY
    day = F.floor(start / MS_DAY)
    months = (k * step * (12 if unit == "year" else 1)).cast("int")
    moved = F.add_months(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), months)
    return F.datediff(moved, F.lit("1970-01-01").cast("date")).cast("long") * MS_DAY + (start - day * MS_DAY)


def reach(df: DataFrame, start: Column, end: Column, step: int, window_ms: int, ts: str = "ts", unit: str = "day") -> DataFrame:
    """Each observation once for each step k of the grid from start, up to end, that is at most window_ms away: k, delta (days, signed).

    For months and years the steps come from the calendar months between, one more on either side, and those out of reach go.
    """
    t = ms(ts)
    if unit == "day":
        low, high = F.ceil((t - window_ms - start) / (step * MS_DAY)), F.least(F.floor((t + window_ms - start) / (step * MS_DAY)), F.floor((end - start) / (step * MS_DAY)))
    else:
        months = step * (12 if unit == "year" else 1)

        def since(x: Column) -> Column:
            day, first = (F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / MS_DAY).cast("int")) for c in (x, start))
            return (F.year(day) - F.year(first)) * 12 + F.month(day) - F.month(first)

        low, high = F.floor(since(t - window_ms) / months), F.ceil(since(t + window_ms) / months)
    rows = df.withColumns({"_lo": F.greatest(low, F.lit(0)).cast("int"), "_hi": high.cast("int"), "_t": t}).filter("_lo <= _hi")
    rows = rows.withColumn("k", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    rows = rows.withColumn("t_ms", step_at(start, F.col("k"), step, unit)).withColumn("delta", (F.col("_t") - F.col("t_ms")) / float(MS_DAY))
    if unit != "day":
        rows = rows.filter((F.abs(F.col("_t") - F.col("t_ms")) <= window_ms) & (F.col("t_ms") <= end))
    return rows.drop("_t")


def gaussian(delta: Column, sigma: float) -> Column:
    z = delta / float(sigma)
    return F.exp(-0.5 * z * z)


def blend(values: list[Column], counts: list[Column], bw1: float, bw2: float, renormalise: bool) -> Column:
    """One, two or three kernels' values as one, the narrow ones weighing by how many observations they have.

    As it stands a narrow value that is missing counts as 0 and the widest has to be there. renormalise leaves missing ones out and
    divides by the weights that remain.
    """
    first = F.least(F.greatest(counts[0] / float(bw1), F.lit(0.0)), F.lit(1.0))
    if len(values) == 1:
        return values[0]
    if len(values) == 2:
        weights = [first, 1 - first]
    else:
        second = F.least(F.greatest(counts[1] / float(bw2), F.lit(0.0)), F.lit(1.0)) * (1 - first)
        weights = [first, second, 1 - first - second]
    if not renormalise:
        out = weights[-1] * values[-1]
        for w, v in zip(weights[:-1], values[:-1], strict=True):
            out = out + F.coalesce(w * v, F.lit(0.0))
        return out
    top, bottom = F.lit(0.0), F.lit(0.0)
    for w, v in zip(weights, values, strict=True):
        top, bottom = top + F.coalesce(w * v, F.lit(0.0)), bottom + F.when(v.isNull(), 0.0).otherwise(w)
    return F.when(bottom > 0, top / bottom)


def rbf(df: DataFrame, bands: list[str], sigmas: tuple[float, ...] = (16,), windows: tuple[float, ...] = (16,), step_days: int = 16, bw1: float = 4, bw2: float = 8, keys: tuple[str, ...] = KEYS, ts: str = "ts", january: bool = False, bounds: tuple[int, int] | None = None, renormalise: bool = False, per_key: bool = False, whole_days: bool = False, unit: str = "day", every_window: bool = True) -> DataFrame:
    """1RBF, 2RBF and 3RBF by the number of sigmas: per pixel and step k, t_ms, the band's weighted means, blended.

    Each band is divided by the weights of its own valid observations. A step stays if every window holds an observation of the pixel, valid or not; with every_window false, if any does. The grid is that of all
    observations, of bounds, or, with per_key, of each key, with one step beyond its last observation. whole_days measures from calendar day to calendar day.
    """
    if whole_days:
        df = df.withColumn(ts, F.date_trunc("day", ts))
    if per_key:
        spans = df.groupBy(*keys).agg(F.min(ms(ts)).alias("_s"), F.max(ms(ts)).alias("_e"))
        df = df.join(spans, [*keys])
        step = step_days * MS_DAY
        start, end = F.col("_s"), F.col("_s") + F.ceil((F.col("_e") - F.col("_s")) / step) * step
    else:
        a, b = bounds or grid_bounds(df, ts, january)
        start, end = F.lit(a).cast("long"), F.lit(b).cast("long")
    rows = reach(df, start, end, step_days, int(max(windows) * MS_DAY), ts, unit)
    sums = [F.max((F.abs(F.col("delta")) <= float(w)).cast("int")).alias(f"_in{i}") for i, w in enumerate(windows)]
    for i, (s, w) in enumerate(zip(sigmas, windows, strict=True)):
        inside = F.abs(F.col("delta")) <= float(w)
        for b in bands:
            weight = F.when(inside & F.col(b).isNotNull(), gaussian(F.col("delta"), s))
            sums += [F.sum(F.col(b) * weight).alias(f"_v{i}_{b}"), F.sum(weight).alias(f"_w{i}_{b}"), F.count(weight).alias(f"_n{i}_{b}")]
    out = rows.groupBy(*keys, "k", "t_ms").agg(*sums)
    n = range(len(sigmas))
    if every_window:
        out = out.filter(" and ".join(f"_in{i} = 1" for i in n))
    return out.select(*keys, "k", "t_ms", *(blend([F.try_divide(F.col(f"_v{i}_{b}"), F.col(f"_w{i}_{b}")) for i in n], [F.col(f"_n{i}_{b}") for i in n], bw1, bw2, renormalise).alias(b) for b in bands))


def rbf_frame(df: DataFrame, group: str, bands: list[str], mode: str = "1RBF", step_days: int = 16, sigmas: tuple[float, ...] = (16, 32, 64), windows: tuple[float, ...] = (16, 32, 64), bw1: float = 4, bw2: float = 8, ts: str = "ts", drop_all_null: bool = True) -> DataFrame:
    """Long-table interpolation: a grid of its own for each group, whole days, weights over the kernels that have a value, and every step of the grid."""
    n = {"1RBF": 1, "2RBF": 2, "3RBF": 3}[mode]
    if drop_all_null:
        df = df.na.drop("all", subset=bands)
    values = rbf(df, bands, sigmas[:n], windows[:n], step_days, bw1, bw2, (group,), ts, renormalise=True, per_key=True, whole_days=True, every_window=False)
    step = step_days * MS_DAY
    spans = df.groupBy(group).agg(F.min(ms(F.date_trunc("day", ts))).alias("_s"), F.max(ms(F.date_trunc("day", ts))).alias("_e"))
    grid = spans.select(group, "_s", F.explode(F.sequence(F.lit(0), F.ceil((F.col("_e") - F.col("_s")) / step).cast("int"))).alias("k"))
    grid = grid.select(group, "k", (F.col("_s") + F.col("k").cast("long") * step).alias("t_ms"))
    return grid.join(values.drop("t_ms"), [group, "k"], "left")


def rbf_arrays(df: DataFrame, values: str, days: str, targets: list[int], sigma: float | tuple[float, ...], window: float | tuple[float, ...], bw1: float = 4, bw2: float = 8, nodata: float | None = None) -> DataFrame:
    """Adds rbf: a row's array of values at an array of days, interpolated at target days by one to three kernels; no explode and no shuffle.

    NULL, NaN and nodata are no observations. Where no kernel has one, the result is nodata, or NULL without it.
    """
    sigmas, windows = (x if isinstance(x, tuple) else (x,) for x in (sigma, window))

    def seen(p: Column) -> Column:
        there = p["v"].isNotNull() & ~F.isnan(p["v"].cast("double"))
        return there if nodata is None else there & (p["v"] != nodata)

    def kernel(t: Column, s: float, w: float) -> tuple[Column, Column]:
        pairs = F.filter(F.arrays_zip(F.col(values).alias("v"), F.col(days).alias("d")), lambda p: seen(p) & (F.abs(p["d"] - t) <= w))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        total = F.aggregate(pairs, zero, lambda a, p: F.struct((a["s"] + p["v"] * gaussian((p["d"] - t).cast("double"), s)).alias("s"), (a["w"] + gaussian((p["d"] - t).cast("double"), s)).alias("w")))
        return F.try_divide(total["s"], total["w"]), F.size(pairs)

    def at(t: Column) -> Column:
        means, counts = zip(*(kernel(t, s, w) for s, w in zip(sigmas, windows, strict=True)), strict=True)
        value = blend(list(means), list(counts), bw1, bw2, renormalise=True)
        return value if nodata is None else F.coalesce(value, F.lit(float(nodata)))

    return df.withColumn("rbf", F.transform(F.array(*map(F.lit, targets)), at))


def linear(df: DataFrame, bands: list[str], step_days: int = 16, window_days: int = 16, keys: tuple[str, ...] = KEYS, ts: str = "ts", january: bool = False, bounds: tuple[int, int] | None = None, half: bool = False, unit: str = "day") -> DataFrame:
    """WLIN: per pixel and step the line between the nearest valid observations before and after, each within the window.

    An observation on the step counts on both sides and is the value. half takes the mean of both instead of the line. An as-of join
    on both sides at once: observations are exploded to the steps they reach, and each side keeps the nearest by a struct maximum.
    """
    a, b = bounds or grid_bounds(df, ts, january)
    rows = reach(df, F.lit(a).cast("long"), F.lit(b).cast("long"), step_days, window_days * MS_DAY, ts, unit)
    picks = []
    tie = [F.col("scene_id")] if "scene_id" in df.columns else []
    for x in bands:
        v, d = F.col(x), F.col("delta")
        picks += [F.max(F.when(v.isNotNull() & (d <= 0), F.struct(d.alias("d"), *tie, v.alias("v")))).alias(f"_b_{x}"), F.max(F.when(v.isNotNull() & (d >= 0), F.struct((-d).alias("d"), *tie, v.alias("v")))).alias(f"_a_{x}")]
    out = rows.groupBy(*keys, "k", "t_ms").agg(*picks)

    def line(x: str) -> Column:
        before, after, t1, t2 = F.col(f"_b_{x}.v"), F.col(f"_a_{x}.v"), F.col(f"_b_{x}.d"), -F.col(f"_a_{x}.d")
        if half:
            return (before + after) / 2
        return F.when(t2 == t1, before).otherwise(before + (after - before) * F.try_divide(-t1, t2 - t1))

    return out.select(*keys, "k", "t_ms", *(line(x).alias(x) for x in bands))


def _ordered(keys: tuple[str, ...], ts: str, before_ms: int, after_ms: int):
    return Window.partitionBy(*keys).orderBy(ms(ts)).rangeBetween(-before_ms, after_ms)


def moving_mean(df: DataFrame, bands: list[str], window_days: float = 20, keys: tuple[str, ...] = KEYS, ts: str = "ts", half_open: bool = False) -> DataFrame:
    """Adds <band>_mean over the window round each observation; half_open leaves out the far end."""
    w = _ordered(keys, ts, int(window_days * MS_DAY), int(window_days * MS_DAY) - half_open)
    return df.withColumns({f"{b}_mean": F.avg(b).over(w) for b in bands})


def outlier_envelope(df: DataFrame, band: str, window_days: float = 30, deviations: float = 3, keys: tuple[str, ...] = KEYS, ts: str = "ts") -> DataFrame:
    """Adds <band>_mean, _low, _high (deviations times the moving standard deviation away) and _outlier."""
    w = _ordered(keys, ts, int(window_days * MS_DAY), int(window_days * MS_DAY))
    mean, spread = F.avg(band).over(w), F.stddev_pop(band).over(w)
    df = df.withColumns({f"{band}_mean": mean, f"{band}_low": mean - deviations * spread, f"{band}_high": mean + deviations * spread})
    return df.withColumn(f"{band}_outlier", (F.col(band) < F.col(f"{band}_low")) | (F.col(band) > F.col(f"{band}_high")))
