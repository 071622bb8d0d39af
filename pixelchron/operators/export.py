"""Reshaping and writing: time to columns and back, scaling and types, completeness, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = {"int8": ("tinyint", -128, 127), "uint8": ("smallint", 0, 255), "int16": ("smallint", -32768, 32767), "uint16": ("int", 0, 65535), "int32": ("int", -(2**31), 2**31 - 1), "uint32": ("bigint", 0, 2**32 - 1), "float": ("float", None, None), "double": ("double", None, None)}


def scale_and_cast(df: DataFrame, bands: list[str], scale: float = 1, dtype: str | None = None, nodata: float | None = None) -> DataFrame:
    """Bands times scale, missing ones as nodata, clamped to the type's range and cast; fractions are cut. Unsigned types use the next wider one."""
    if dtype is not None and dtype not in TYPES:
        raise ValueError(f"unknown data type {dtype}")

    def one(b: str):
        v = F.col(b) * scale if scale != 1 else F.col(b)
        if nodata is not None:
            v = F.coalesce(v, F.lit(float(nodata)))
        if dtype:
            kind, low, high = TYPES[dtype]
            if low is not None:
                v = F.greatest(F.least(v, F.lit(float(high))), F.lit(float(low)))
                v = F.when(F.isnan(v), None).otherwise(v)
            v = v.cast(kind)
        return v.alias(b)

    return df.select(*(one(c) if c in bands else F.col(c) for c in df.columns))


def complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows that have all features."""
    return df.na.drop("any", subset=features)


def drop_all_nodata(df: DataFrame, features: list[str], nodata: float) -> DataFrame:
    """Rows with a feature that isn't nodata."""
    keep = F.lit(False)
    for f in features:
        keep = keep | (F.col(f) != nodata)
    return df.filter(keep)


def to_wide(df: DataFrame, bands: list[str], labels: list[str], label: str = "date", keys: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """<band>_<label> columns, one row per pixel: conditional maxima, so that the labels given fix the schema and the data is read once."""
    wanted = [F.max(F.when(F.col(label) == x, F.col(b))).alias(f"{b}_{x}") for x in labels for b in bands]
    return df.groupBy(*keys).agg(*wanted)


def dated_bands(df: DataFrame, bands: list[str], dates: list[str], ts: str = "ts", keys: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """A series as one image: <band>_<YYYYMMDD> for the dates given, as an interpolated grid has them."""
    return to_wide(df.withColumn("_date", F.date_format(ts, "yyyyMMdd")).filter(F.col("_date").isin(dates)), bands, dates, "_date", keys)


def to_long(df: DataFrame, prefix: str | None = None, keys: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """Rows of band, date, value from columns whose names end in eight digits; with prefix only those that begin with it."""
    import re

    found = [(c, m[1], m[2]) for c in df.columns if c not in keys and (m := re.fullmatch(r"(.*?)_?(\d{8})", c)) and (prefix is None or c.startswith(prefix))]
    cells = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(d).alias("date"), F.col(c).cast("double").alias("value")) for c, b, d in found))
    return df.select(*keys, F.inline(cells)).withColumn("date", F.to_date("date", "yyyyMMdd"))


def export_image(df: DataFrame, path: str, bands: list[str], keys: tuple[str, ...] = ("px", "py"), scale: float = 1, dtype: str | None = None, nodata: float | None = None, partition: list[str] | None = None, max_records: int = 0, bandnames_csv: bool = False) -> None:
    """Writes a product as Parquet, by partition columns such as tile_id; band names beside it as CSV if asked for."""
    out = scale_and_cast(df, bands, scale, dtype, nodata)
    writer = out.write.mode("overwrite").option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    if bandnames_csv:
        df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(bands)], "band int, name string").coalesce(1).write.mode("overwrite").csv(f"{path}_bandnames", header=True)


def table_rows(df: DataFrame, features: list[str], scale: float = 1, dtype: str | None = None, nodata: float | None = None, drop_nodata: bool = False) -> DataFrame:
    """What a table export writes: scaled, complete, and without rows of nodata alone."""
    out = complete_rows(scale_and_cast(df, features, scale, dtype, nodata), features)
    return drop_all_nodata(out, features, nodata) if drop_nodata and nodata is not None else out


def export_table(df: DataFrame, path: str, features: list[str], fmt: str = "CSV", **options) -> None:
    writer = table_rows(df, features, **options).write.mode("overwrite")
    writer.csv(path, header=True) if fmt.upper() == "CSV" else writer.parquet(path)


def band_statistics(df: DataFrame, bands: list[str]) -> DataFrame:
    """band, min, max, mean, std in one pass."""
    row = df.agg(*(f(b).alias(f"{n}_{b}") for b in bands for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))))
    return row.select(F.inline(F.array(*(F.struct(F.lit(b).alias("band"), *(F.col(f"{n}_{b}").cast("double").alias(n) for n in ("min", "max", "mean", "std"))) for b in bands))))
