"""Folds: named sub-windows of the time of interest, and membership of observations in them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import day_ms, parse_day


@dataclass(frozen=True)
class Fold:
    """A sub-window; a field that is None puts no condition. date is half-open and stands for all other fields."""

    key: str
    years: tuple[int, ...] | None
    months: tuple[int, ...] | None
    doys: tuple[int, ...] | None
    date: tuple[date, date] | None
    time_start: int
    year_center: int | None
    year_offset: int | None
    doy_center: int | None
    doy_offset: int | None

    def holds(self, day: date) -> bool:
        if self.date:
            return self.date[0] <= day < self.date[1]
        tests = ((self.years, day.year), (self.months, day.month), (self.doys, day.timetuple().tm_yday))
        return all(allowed is None or value in allowed for allowed, value in tests)


def cyclic(low: int, high: int, top: int) -> tuple[int, ...]:
    return tuple(range(low, high + 1)) if low <= high else (*range(low, top + 1), *range(1, high + 1))


def parse_ranges(texts: Iterable[str] | None, top: int = 0) -> list[tuple[int, int]]:
    """Ranges written a-b or center+-offset; with top they wrap round the year."""
    out = []
    for text in texts or []:
        text = str(text)
        if "+-" in text:
            center, offset = map(int, text.split("+-"))
            low, high = center - offset, center + offset
            out.append(((low - 1) % top + 1, (high - 1) % top + 1) if top else (low, high))
        elif "-" in text:
            low, high = map(int, text.split("-"))
            out.append((low, high))
    return out


def parse_days(texts: Iterable[str] | None) -> list[tuple[date, date]]:
    """Date ranges written YYYYMMDD-YYYYMMDD or YYYYMMDD+-days."""
    out = []
    for text in texts or []:
        if "+-" in text:
            center, days = text.split("+-")
            out.append((parse_day(center) - timedelta(int(days)), parse_day(center) + timedelta(int(days))))
        else:
            out.append(tuple(map(parse_day, text.split("-"))))
    return out


def _middle(low: int, high: int) -> tuple[int, int]:
    return (low + high) // 2, (high - low) // 2


def _dated(low: date, high: date) -> Fold:
    key = f"Y{low.year}-{high.year}_M00-00_D{low.timetuple().tm_yday:03d}-{high.timetuple().tm_yday:03d}"
    return Fold(key, tuple(range(low.year, high.year + 1)), None, None, (low, high), day_ms(low), *_middle(low.year, high.year), None, None)


def make_folds(year: tuple[int, int], month: tuple[int, int] = (1, 12), doy: tuple[int, int] = (1, 366), dates: tuple[str | int, str | int] | None = None, fold_year: bool = False, fold_month: bool = False, custom: dict | None = None) -> list[Fold]:
    """The folds that the parameters ask for; the last of equal keys stays.

    Custom date ranges stand alone. Otherwise a fold is a choice for each of year, month and day of year: custom ranges or
    the whole, taken apart into single years and months where folding by them is on. Without any request there is one fold.
    """
    custom = custom or {}
    if dates:
        first, last = map(parse_day, dates)
        year, month = (first.year, last.year), (first.month, last.month)
    else:
        first = date(year[0], month[0], 1)
        last = date(year[1] + month[1] // 12, month[1] % 12 + 1, 1) - timedelta(1)
    years, months = parse_ranges(custom.get("year")), parse_ranges(custom.get("month"), 12)
    doys, spans = parse_ranges(custom.get("doy"), 366), parse_days(custom.get("date"))
    for name, ranges, (low, high) in (("year", years, year), ("month", months, month), ("day of year", doys, doy), ("date", spans, (first, last))):
        if bad := [r for r in ranges if r[0] < low or r[1] > high]:
            raise ValueError(f"custom {name} ranges {bad} are outside {low} to {high}")
    if spans:
        return [*{f.key: f for f in (_dated(*s) for s in spans)}.values()]
    if doys and (months or fold_month):
        raise ValueError("days of year can't be combined with months or with folding by month")
    asked = years or months or doys or fold_year or fold_month
    if not asked and dates:
        return [_dated(first, last)]

    all_years = tuple(range(year[0], year[1] + 1))
    # With custom years and folding by month alone, months of the whole range also take the years apart; months given as ranges stay whole.
    each_year = fold_year or bool(years and fold_month and not months)
    each_month = fold_month and not (years and months and not fold_year)
    # Days of year alone, and single months alone, hold in any year.
    any_year = not each_year and not years and ((doys and not months) or (fold_month and not months))
    year_choices = [tuple(range(a, b + 1)) for a, b in years] or [None if any_year else all_years]
    if each_year:
        year_choices = [(y,) for choice in year_choices for y in choice or all_years]
    month_choices: list = [cyclic(a, b, 12) for a, b in months] or [cyclic(*month, 12) if each_month or not asked else None]
    if each_month:
        month_choices = [(m,) for choice in month_choices for m in choice]
    doy_choices = [cyclic(a, b, 366) for a, b in doys] or [None]

    out: dict[str, Fold] = {}
    for ys, ms, ds in product(year_choices, month_choices, doy_choices):
        low, high = (ys or all_years)[0], (ys or all_years)[-1]
        center, offset = _middle(low, high)
        if any_year and fold_month:
            center, offset = None, 0
        start = date(low, 1, 1) + timedelta(ds[0] - 1) if ds else date(low, ms[0] if ms else (month[0] if not years and asked else 1), 1)
        doy_text = f"{ds[0]:03d}-{ds[-1]:03d}" if ds else "001-366"
        month_text = f"{ms[0]:02d}-{ms[-1]:02d}" if ms else "01-12"
        key = f"Y{low}-{high}_M{month_text}_D{doy_text}"
        out[key] = Fold(key, ys, ms, ds, None, day_ms(start), center, offset, *(_middle(ds[0], ds[-1]) if ds else (None, None)))
    return [*out.values()]


def folds_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    """One row per fold; a list that the parameters bound."""
    rows = [(f.key, f.time_start, f.years and list(f.years), f.months and list(f.months), f.doys and list(f.doys), *(f.date or (None, None)), f.year_center, f.year_offset, f.doy_center, f.doy_offset) for f in folds]
    return spark.createDataFrame(rows, "fold_key string, time_start bigint, years array<int>, months array<int>, doys array<int>, date_lo date, date_hi date, year_center int, year_offset int, doy_center int, doy_offset int")


def _fields(f: Fold) -> tuple:
    return f.key, f.time_start, f.year_center, f.year_offset, f.doy_center, f.doy_offset


FIELDS = "fold_key string, time_start bigint, year_center int, year_offset int, doy_center int, doy_offset int"
#: More days of folds than this are joined as Spark sees fit; fewer are broadcast.
BROADCAST_DAYS = 200_000


def _days(low: date, high: date) -> Iterable[date]:
    return (low + timedelta(n) for n in range((high - low).days + 1))


def fold_days(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    """day, fold_key (and centers and offsets): the days of folds that name their years or dates."""
    rows = []
    for f in folds:
        low, high = f.date or (date(f.years[0], 1, 1), date(f.years[-1], 12, 31))
        rows += [(day, *_fields(f)) for day in _days(low, high) if f.holds(day)]
    return spark.createDataFrame(rows, f"day date, {FIELDS}")


def fold_year_days(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    """month, doy, fold_key and so on, of folds that hold in any year: the days of a common and of a leap year."""
    days = sorted({(d.month, d.timetuple().tm_yday, d) for y in (2023, 2024) for d in _days(date(y, 1, 1), date(y, 12, 31))})
    rows = {(m, n, *_fields(f)) for f in folds for m, n, d in days if f.holds(d)}
    return spark.createDataFrame(sorted(rows, key=lambda r: r[:3]), f"_month int, _doy int, {FIELDS}")


def join_folds(df: DataFrame, folds: list[Fold], ts: str = "ts") -> DataFrame:
    """Each observation once for each fold that holds its day; those in none are left out.

    Membership is an equality join on the day, or for folds of any year on month and day of year, with a table whose size is days times folds, whatever the data.
    """
    spark = df.sparkSession
    if all(f.years is None and f.date is None for f in folds):
        return df.withColumns({"_month": F.month(ts), "_doy": F.dayofyear(ts)}).join(F.broadcast(fold_year_days(spark, folds)), ["_month", "_doy"]).drop("_month", "_doy")
    days = fold_days(spark, folds)
    span = sum((f.date[1] - f.date[0]).days if f.date else 366 * len(f.years) for f in folds)
    return df.withColumn("day", F.to_date(ts)).join(F.broadcast(days) if span <= BROADCAST_DAYS else days, "day").drop("day")
