"""Observation tables over the star-schema test tables, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indices import add_features
from ..operators.masking import apply_mask, landsat_valid
from ..schema import OPTICAL

MASKS = ["cloud", "cshadow", "snow", "fill", "dilated"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a multi-band series: a supplier is a pixel, a line an acquisition, its numbers are reflectances."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey % 10 as int) px", "cast(l_suppkey div 10 as int) py",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) scene_id", "cast(l_shipdate as timestamp) ts", "l_returnflag sensor",
        "0.01D + l_tax BLU", "0.02D + l_tax + l_discount GRN", "0.02D + 2 * l_discount RED", "l_quantity / 50 NIR", "l_extendedprice / 200000 SW1", "l_extendedprice / 400000 SW2",
        "(case when l_orderkey % 16 < 6 then shiftleft(1, cast(l_orderkey % 16 as int)) else 0 end) + shiftleft(cast(case when l_partkey % 5 = 0 then 3 else l_partkey % 2 end as int), 8) + shiftleft(case when l_linenumber = 7 then 2 else 0 end, 14) QA_PIXEL",
        "case when l_orderkey % 37 = 0 then 1 else 0 end QA_RADSAT", "cast((l_orderkey * 7) % 100 as double) cloud_cover",
    )


def masked_observations(spark: SparkSession, sf_dir: str, features: list[str] | None = None) -> DataFrame:
    """Observations of scenes with at most 75 % cloud, masked, with mask and features."""
    df = observations(spark, sf_dir).filter("cloud_cover <= 75")
    df = apply_mask(df, list(OPTICAL), landsat_valid(MASKS, "Medium"))
    return add_features(df, features or ["NDVI"])


def landsat_table(spark: SparkSession, sf_dir: str, sensor: str) -> DataFrame:
    """The same in a sensor's own columns: numbers as stored, with scene properties and coordinates."""
    df = observations(spark, sf_dir).filter(F.col("sensor") == {"L8": "A", "L9": "N", "L7": "R", "L5": "R"}[sensor])
    names = ("SR_B2 SR_B3 SR_B4 SR_B5 SR_B6 SR_B7" if sensor in ("L8", "L9") else "SR_B1 SR_B2 SR_B3 SR_B4 SR_B5 SR_B7").split()
    stored = [F.floor((F.col(b) + 0.2) / 0.0000275).cast("int").alias(c) for b, c in zip(OPTICAL, names, strict=True)]
    thermal = F.floor(F.col("NIR") * 1000 + 40000).cast("int").alias("ST_B10" if sensor in ("L8", "L9") else "ST_B6")
    return df.select("px", "py", (12.9 + F.col("px") * 0.05).alias("x"), (52.2 + F.col("py") * 0.05).alias("y"), "scene_id", "ts", *stored, thermal, "QA_PIXEL", "QA_RADSAT", F.col("cloud_cover").alias("CLOUD_COVER_LAND"), (F.col("px") % 4).alias("GROUND_CONTROL_POINTS_MODEL"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a single-band series: a user is a pixel, value is the band, the number in props a cloud probability."""
    return read(spark, sf_dir, "events").selectExpr("cast(user_id as int) px", "0 py", "cast(event_id as string) scene_id", "cast(ts as timestamp) ts", "event_type sensor", "value / 500 NDVI", "cast(get_json_object(props, '$.k') as double) probability")


def part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as one image, 50 pixels wide: value, a mask with clouds, NIR and SCL."""
    return read(spark, sf_dir, "part").selectExpr(
        "'dem' scene_id", "cast(p_partkey % 50 as int) px", "cast(p_partkey div 50 as int) py", "cast(p_size as double) value",
        "case when ((p_partkey % 50) div 6 + (p_partkey div 50) div 5) % 3 = 0 or p_size % 9 = 0 then 0 else 1 end mask", "p_size / 50D NIR", "p_size % 8 SCL",
    )
