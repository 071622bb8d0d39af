"""Time as milliseconds since 1970 and as calendar fields; all in UTC."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def ms(ts: str | Column = "ts") -> Column:
    """Epoch milliseconds, floored; takes timestamps with and without time zone."""
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def doy0(ts: str | Column = "ts") -> Column:
    """Days since January 1st."""
    return F.dayofyear(ts) - 1


def yyyymmdd(ts: str | Column = "ts") -> Column:
    return F.date_format(ts, "yyyyMMdd")


def calendar(df, ts: str = "ts"):
    """Adds year, month, doy (0-based) and date (YYYYMMDD)."""
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "doy": doy0(ts), "date": yyyymmdd(ts)})


def cyclic_between(value: Column, low: int, high: int) -> Column:
    """low <= value <= high, or for low > high what wraps round the end of the year."""
    return value.between(low, high) if low <= high else (value >= low) | (value <= high)


def parse_day(text: str | int) -> date:
    return datetime.strptime(str(text).replace("-", ""), "%Y%m%d").date()


def day_ms(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)


def doy_to_radians(doy: Column) -> Column:
    return doy / F.lit(365.0) * 2 * F.pi()


def radians_to_doy(radians: Column) -> Column:
    """Day of year 1 to 365, truncated."""
    return F.least(F.greatest(radians * 365 / (2 * F.pi()), F.lit(1.0)), F.lit(365.0)).cast("int")
