"""The queries of the engine's own operators over the test tables, each with the SQL that says the same in another engine.

Doubles are rounded to six places and lose a negative zero, as sums come in another order elsewhere; a shift of 1e-10 keeps halves from
falling either way.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import indices
from .functions.reducers import reduce_bands, round_half_away
from .functions.times import calendar, cyclic_between, ms, yyyymmdd
from .operators import composite, export, interpolation, masking, model, phenology, series, spatial
from .operators.unmix import unmix as unmix_bands
from .plans.folds import join_folds, make_folds
from .plans.pipeline import run_param
from .schema import OPTICAL
from .sources import roi, scans
from .sources.tables import event_series, landsat_table, masked_observations, observations, part_grid, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((round_half_away(F.col(c) + 1e-10, places) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def R(x: str, name: str = "", places: int = 6) -> str:
    return f"round({x} + 1e-10, {places}) + 0.0 AS {name or x}"


OBS = """obs AS (
  SELECT (l_suppkey % 10)::INT AS px, (l_suppkey // 10)::INT AS py, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS scene_id,
         l_shipdate::TIMESTAMP AS ts, l_returnflag AS sensor, 0.01::DOUBLE + l_tax AS BLU, 0.02::DOUBLE + l_tax + l_discount AS GRN, 0.02::DOUBLE + 2 * l_discount AS RED,
         l_quantity / 50 AS NIR, l_extendedprice / 200000 AS SW1, l_extendedprice / 400000 AS SW2,
         ((CASE WHEN l_orderkey % 16 < 6 THEN 1 << (l_orderkey % 16)::INT ELSE 0 END) + ((CASE WHEN l_partkey % 5 = 0 THEN 3 ELSE l_partkey % 2 END)::INT << 8)
          + ((CASE WHEN l_linenumber = 7 THEN 2 ELSE 0 END) << 14))::INT AS QA_PIXEL,
         (CASE WHEN l_orderkey % 37 = 0 THEN 1 ELSE 0 END)::INT AS QA_RADSAT, ((l_orderkey * 7) % 100)::DOUBLE AS cloud_cover FROM lineitem)"""
VALID = """(QA_PIXEL & 59) = 0 AND ((QA_PIXEL >> 8) & 3) < 2 AND ((QA_PIXEL >> 14) & 3) < 2 AND QA_RADSAT = 0
           AND least(BLU, GRN, RED, NIR, SW1, SW2) > 0 AND greatest(BLU, GRN, RED, NIR, SW1, SW2) < 1"""
ND = "CASE WHEN {a} >= 0 AND {b} >= 0 AND {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END"
NDVI = ND.format(a="NIR", b="RED")
TSS = OBS + f""", msk AS (SELECT *, CASE WHEN {VALID} THEN 1 ELSE 0 END AS mask FROM obs WHERE cloud_cover <= 75), tss AS (
  SELECT px, py, scene_id, ts, sensor, mask, """ + ", ".join(f"CASE WHEN mask = 1 THEN {b} END AS {b}" for b in OPTICAL) + f""", CASE WHEN mask = 1 THEN {NDVI} END AS NDVI FROM msk)"""
EVENTS = "ev AS (SELECT user_id::INT AS px, 0 AS py, event_id::VARCHAR AS scene_id, ts, event_type AS sensor, value / 500 AS NDVI, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS probability, epoch_us(ts) // 1000 AS t FROM events)"
GRID = """g AS (SELECT (p_partkey % 50)::INT AS px, (p_partkey // 50)::INT AS py, p_size::DOUBLE AS value,
  (CASE WHEN ((p_partkey % 50) // 6 + (p_partkey // 50) // 5) % 3 = 0 OR p_size % 9 = 0 THEN 0 ELSE 1 END)::INT AS mask, p_size / 50.0::DOUBLE AS NIR, p_size % 8 AS SCL FROM part)"""


# Scans, filters and masks


@query(f"WITH {TSS} SELECT px, py, scene_id, mask, {R('BLU')}, {R('NIR')}, {R('NDVI')} FROM tss")
def tss_scan_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masked_observations(spark, sf_dir).select("px", "py", "scene_id", "mask", "BLU", "NIR", "NDVI"))


def _landsat_sql(where: str = "true") -> str:
    names = ", ".join(f"floor(({b} + 0.2) / 0.0000275)::INT * 0.0000275::DOUBLE + (-0.2)::DOUBLE AS {b}" for b in OPTICAL)
    return f"SELECT px, py, scene_id, ts, sensor, {names}, floor(NIR * 1000 + 40000)::INT * 0.00341802::DOUBLE + 149.0::DOUBLE AS LST, QA_PIXEL, QA_RADSAT FROM obs WHERE cloud_cover <= 75 AND px % 4 >= 1 AND {where}"


@query(f"WITH {OBS}, s AS ({_landsat_sql('ts >= TIMESTAMP $$1996-01-01$$ AND ts < TIMESTAMP $$2000-01-01$$ AND (sensor = $$A$$ OR sensor = $$R$$ AND ts >= TIMESTAMP $$1999-04-15$$ AND ts < TIMESTAMP $$2003-05-30$$)').replace('$$', chr(39))}) SELECT CASE sensor WHEN 'A' THEN 'L8' ELSE 'L7' END AS sensor, scene_id, {R('BLU')}, {R('NIR')}, {R('LST')} FROM s")
def tss_landsat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {s: landsat_table(spark, sf_dir, s) for s in ("L7", "L8")}
    df = scans.scan_landsat(tables, ["L8", "L7"], None, scans.Period((1996, 1999)), 75, 1, exclude_slc_off=True)
    return rounded(df.select("sensor", "scene_id", "BLU", "NIR", "LST"))


@query("""WITH e AS (SELECT event_id::VARCHAR AS scene_id, user_id::INT AS px, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)
SELECT e.px, e.scene_id, round(value * 0.0001 + 1e-10, 6) + 0.0 AS RED, round(value + 1e-10, 6) + 0.0 AS WV, CASE WHEN e.k % 3 <> 0 THEN round(k / 100, 6) + 0.0 END AS cs FROM e WHERE e.k <= 75""")
def tss_sentinel2_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_series(spark, sf_dir)
    table = e.select("px", "py", "scene_id", "ts", (F.col("NDVI") * 500).alias("B4"), (F.col("NDVI") * 500).alias("B9"), F.col("probability").alias("CLOUDY_PIXEL_PERCENTAGE"))
    scores = e.filter("probability % 3 <> 0").select("scene_id", "px", "py", (F.col("probability") / 100).alias("cs"))
    df = scans.scan_sentinel2(table, None, None, 75, scores, ("cs",))
    return rounded(df.select("px", "scene_id", "RED", "WV", "cs"))


@query("""WITH e AS (SELECT event_id::VARCHAR AS scene_id, user_id % 2 AS s, value, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT scene_id, CASE s WHEN 0 THEN 'HLSL30' ELSE 'HLSS30' END AS sensor, (CASE WHEN (k & 27) = 0 AND value / 500 > 0 AND value / 500 < 1 THEN 1 ELSE 0 END)::INT AS mask FROM e""")
def tss_hls_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_series(spark, sf_dir).withColumn("Fmask", F.col("probability").cast("int"))
    tables = {"HLSL30": e.filter("px % 2 = 0").withColumn("B4", F.col("NDVI")), "HLSS30": e.filter("px % 2 = 1").withColumn("B4", F.col("NDVI"))}
    df = scans.scan_hls(tables, "HLS")
    return masking.apply_mask(df, ["RED"], masking.hls_valid(["cloud", "cshadow", "snow"], ("RED", "RED"))).select("scene_id", "sensor", "mask")


@query(f"WITH {OBS} SELECT scene_id, (QA_PIXEL & 63)::INT AS flags, ((QA_PIXEL >> 8) & 3)::INT AS cloud_confidence, ((QA_PIXEL >> 14) & 3)::INT AS cirrus_confidence FROM obs")
def qa_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = F.col("QA_PIXEL")
    return observations(spark, sf_dir).select("scene_id", masking.qa_bits(qa, 0, 5).alias("flags"), masking.qa_bits(qa, 8, 9).alias("cloud_confidence"), masking.qa_bits(qa, 14, 15).alias("cirrus_confidence"))


@query(f"WITH {OBS} SELECT scene_id, {R('CASE WHEN BLU > 0 AND BLU < 0.05 THEN NIR END', 'NIR')} FROM obs")
def blu_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masking.blue_filter(observations(spark, sf_dir), ["NIR"], 0.05).select("scene_id", "NIR"))


@query(f"WITH {EVENTS} SELECT scene_id, (CASE WHEN probability < 30 THEN 1 ELSE 0 END)::INT AS mask, {R('CASE WHEN probability < 30 THEN NDVI END', 'NDVI')} FROM ev")
def prob_mask_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = masking.apply_mask(event_series(spark, sf_dir), ["NDVI"], masking.probability_valid(30))
    return rounded(df.select("scene_id", "mask", "NDVI"))


@query(f"WITH {OBS} SELECT px, py, count(*) AS n FROM obs WHERE (month(ts) >= 11 OR month(ts) <= 2) AND year(ts) BETWEEN 1996 AND 1999 AND (dayofyear(ts) >= 330 OR dayofyear(ts) <= 45) GROUP BY px, py")
def calendar_wrap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).filter(scans.Period((1996, 1999), (11, 2), (330, 45)).holds()).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBS} SELECT px, py, count(*) AS n FROM obs WHERE px BETWEEN 1 AND 7 AND py BETWEEN 1 AND 7 AND (px - 1) * 6 >= (py - 1) * 7 AND ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1998-09-15' GROUP BY px, py")
def region_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    triangle = roi.parse_roi([[1, 1], [8, 1], [8, 7]])
    df = observations(spark, sf_dir).filter(scans.Period.of_dates(19970301, 19980915).holds()).withColumns({"x": F.col("px") + 1e-6, "y": F.col("py") + 1e-7})
    return roi.in_region(df, triangle, box_only=False).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT (l_suppkey % 10)::INT AS px, (l_suppkey // 10)::INT AS py, l_orderkey FROM lineitem)
SELECT px, py, count(o_orderkey) AS n, round(avg(CASE WHEN o_orderkey IS NOT NULL THEN o_totalprice END) + 1e-10, 4) + 0.0 AS cs FROM o LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' GROUP BY px, py""")
def link_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = read(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey % 10 as int) px", "cast(l_suppkey div 10 as int) py", "l_orderkey scene_id")
    scores = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").selectExpr("o_orderkey scene_id", "o_totalprice cs")
    return rounded(scans.link(obs, scores, ("cs",), ("scene_id",)).groupBy("px", "py").agg(F.count("cs").alias("n"), F.avg("cs").alias("cs")), 4)


@query("SELECT vec_id AS scene_id, label AS px, round(embedding[1]::DOUBLE + 1e-10, 6) + 0.0 AS A01, round(embedding[2]::DOUBLE + 1e-10, 6) + 0.0 AS A02 FROM embeddings")
def custom_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_id"), F.col("label").alias("px"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"A{i + 1:02d}") for i in range(8)))
    return rounded(scans.scan_custom(table, ["A01", "A02"]))


@query(f"WITH {TSS} SELECT scene_id AS id, epoch_ms(ts) AS time, {R('NDVI')} FROM tss WHERE px = 3 AND py = 4")
def pixel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.pixel_series(masked_observations(spark, sf_dir), ["NDVI"], 3, 4))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 END::INT AS class FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')")
def recode_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.recode(read(spark, sf_dir, "part"), "p_type", {"ECONOMY": 0, "STANDARD": 1, "PROMO": 2}, "class").select("p_partkey", "class")


# Bands and features

_PLAIN = {"NDVI": NDVI, "NDMI": ND.format(a="NIR", b="SW1"), "NDWI": ND.format(a="GRN", b="NIR"), "MNDWI": ND.format(a="GRN", b="SW1"), "NDBI": ND.format(a="SW1", b="NIR"), "NBR": ND.format(a="NIR", b="SW2"), "KNDVI": f"tanh(({NDVI}) * ({NDVI}))", "EVI": "2.5 * (NIR - RED) / nullif(NIR + 6 * RED - 7.5 * BLU + 1, 0)", "FVC": f"least(greatest(((({NDVI}) - 0.15) / 0.75) * ((({NDVI}) - 0.15) / 0.75), 0), 1)", "RNB": "NIR / nullif(BLU, 0)", "SWR": "SW2 / nullif(SW1, 0)"}
_CAPS = {"TCG": "-0.1603 * BLU - 0.2819 * GRN - 0.4934 * RED + 0.7940 * NIR - 0.0002 * SW1 - 0.1446 * SW2", "TCB": "0.2043 * BLU + 0.4158 * GRN + 0.5524 * RED + 0.5741 * NIR + 0.3124 * SW1 + 0.2303 * SW2", "TCW": "0.0315 * BLU + 0.2021 * GRN + 0.3102 * RED + 0.1594 * NIR - 0.6806 * SW1 - 0.6109 * SW2"}


@query(f"WITH {OBS} SELECT scene_id, " + ", ".join(R(v, k) for k, v in _PLAIN.items()) + " FROM obs")
def indices_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.add_features(observations(spark, sf_dir), list(_PLAIN)).select("scene_id", *_PLAIN))


@query(f"WITH {OBS} SELECT scene_id, " + ", ".join(R(v, k) for k, v in _CAPS.items()) + " FROM obs")
def tasseled_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.add_features(observations(spark, sf_dir), list(_CAPS)).select("scene_id", *_CAPS))


@query(f"WITH {OBS} SELECT scene_id, {R('(GRN - SW1) / nullif(GRN + SW1, 0)', 'F1')}, {R('((GRN - SW1) / nullif(GRN + SW1, 0)) / 2 + pow(NIR, 2)', 'F2')} FROM obs")
def custom_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    formulas = {"F1": {"formula": "(G-S)/(G+S)", "variable_map": {"G": "GRN", "S": "SW1"}}, "F2": {"formula": "F/2 + N**2", "variable_map": {"F": "F1", "N": "NIR"}}}
    return rounded(indices.add_features(observations(spark, sf_dir), ["F1", "F2"], formulas).select("scene_id", "F1", "F2"))


_SOIL, _GREEN = [0.1, 0.2, 0.3, 0.35, 0.5, 0.45], [0.02, 0.06, 0.04, 0.5, 0.2, 0.1]
_SHARE = "(" + " + ".join(f"({b} - {s}) * ({g} - {s})" for b, s, g in zip(OPTICAL, _SOIL, _GREEN, strict=True)) + ") / " + repr(sum((g - s) ** 2 for s, g in zip(_SOIL, _GREEN, strict=True)))


@query(f"WITH {OBS} SELECT scene_id, {R(f'1 - {_SHARE}', 'SOIL')}, {R(_SHARE, 'GREEN')} FROM obs")
def unmix_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(unmix_bands(observations(spark, sf_dir), list(OPTICAL), {"SOIL": _SOIL, "GREEN": _GREEN}, sum_to_one=True).select("scene_id", "SOIL", "GREEN"))


@query(f"WITH {OBS} SELECT scene_id, {R(f'1 - least(greatest({_SHARE}, 0), 1)', 'SOIL', 4)}, {R(f'least(greatest({_SHARE}, 0), 1)', 'GREEN', 4)} FROM obs")
def unmix_nonnegative(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir).select("scene_id", *OPTICAL)
    return rounded(unmix_bands(df, list(OPTICAL), {"SOIL": _SOIL, "GREEN": _GREEN}, sum_to_one=True, non_negative=True, drop_inputs=True), 4)


# Products per pixel


@query(f"WITH {TSS}, d AS (SELECT *, ts::DATE AS day FROM tss) SELECT px, py, strftime(day, '%Y%m%d') AS scene_id, {R('arg_max(NDVI, (ts, scene_id)) FILTER (NDVI IS NOT NULL)', 'NDVI')}, {R('arg_max(NIR, (ts, scene_id)) FILTER (NIR IS NOT NULL)', 'NIR')} FROM d GROUP BY px, py, day")
def tsm_daily_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.daily_mosaic(masked_observations(spark, sf_dir), ["NDVI", "NIR"]).select("px", "py", "scene_id", "NDVI", "NIR"))


@query(f"WITH {TSS} SELECT px, py, count(DISTINCT CASE WHEN NDVI IS NOT NULL AND BLU IS NOT NULL THEN ts::DATE END) AS NVO FROM tss GROUP BY px, py")
def nvo_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.valid_observations(masked_observations(spark, sf_dir), ["NDVI", "BLU"])


@query(f"WITH {TSS} SELECT px, py, format('Y{{0}}-{{0}}_M01-12_D001-366', year(ts)) AS fold_key, count(DISTINCT CASE WHEN NDVI IS NOT NULL AND BLU IS NOT NULL THEN ts::DATE END) AS NVO FROM tss WHERE year(ts) BETWEEN 1996 AND 1999 GROUP BY px, py, year(ts)")
def nvo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.valid_observations(masked_observations(spark, sf_dir), ["NDVI", "BLU"], folds=make_folds((1996, 1999), fold_year=True))


@query(f"WITH {TSS} SELECT px, py, count(NIR) AS CSO FROM tss GROUP BY px, py")
def cso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.clear_observations(masked_observations(spark, sf_dir), "NIR")


_MOMENTS = "avg(pow({b} - m_{b}, {k}))"
_REDUCERS = {"mean": "avg({b})", "median": "median({b})", "sum": "sum({b})", "min": "min({b})", "max": "max({b})", "stdDev": "stddev_pop({b})", "variance": "var_pop({b})", "skew": "avg(pow({b} - m, 3)) / pow(var_pop({b}), 1.5)", "kurtosis": "avg(pow({b} - m, 4)) / pow(var_pop({b}), 2) - 3", "count": "count({b})", "first": "arg_min({b}, (ts, scene_id)) FILTER ({b} IS NOT NULL)", "last": "arg_max({b}, (ts, scene_id)) FILTER ({b} IS NOT NULL)"} | {f"p{q}": f"quantile_cont({{b}}, {q / 100})" for q in (1, *range(5, 100, 5), 99)}


@query(f"WITH {TSS}, c AS (SELECT *, avg(NDVI) OVER (PARTITION BY px, py) AS m FROM tss) SELECT px, py, " + ", ".join(f"{v.format(b='NDVI')} AS NDVI_{k}" if k == "count" else R(v.format(b="NDVI"), f"NDVI_{k}") for k, v in _REDUCERS.items()) + " FROM c GROUP BY px, py")
def stm_global_all_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.temporal_metrics(masked_observations(spark, sf_dir), ["NDVI"], list(_REDUCERS)))


def _stm_sql(folds: dict[str, str], reducers: tuple[str, ...], bands: tuple[str, ...] = ("NDVI",)) -> str:
    columns = ", ".join(R(_REDUCERS[r].format(b=b), f"{b}_{r}") for b in bands for r in reducers)
    return f"WITH {TSS} " + " UNION ALL ".join(f"SELECT px, py, '{k}' AS fold_key, {columns} FROM tss WHERE {w} GROUP BY px, py" for k, w in folds.items())


_SEASONS = {"Y1995-2001_M03-05_D001-366": "month(ts) IN (3, 4, 5)", "Y1995-2001_M06-08_D001-366": "month(ts) IN (6, 7, 8)", "Y1995-2001_M09-11_D001-366": "month(ts) IN (9, 10, 11)", "Y1995-2001_M12-02_D001-366": "month(ts) IN (12, 1, 2)"}


@query(_stm_sql(_SEASONS, ("p10", "p50", "p90", "stdDev")))
def stm_fold_custom_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal NDVI percentiles per pixel, the introductory example."""
    folds = make_folds((1995, 2001), custom={"month": ["3-5", "6-8", "9-11", "12-2"]})
    return rounded(series.temporal_metrics(masked_observations(spark, sf_dir), ["NDVI"], ["p10", "p50", "p90", "stdDev"], folds=folds))


@query(_stm_sql({f"Y1995-2001_M{m:02d}-{m:02d}_D001-366": f"month(ts) = {m}" for m in range(1, 13)}, ("mean", "max"), ("NDVI", "NIR")))
def stm_fold_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.temporal_metrics(masked_observations(spark, sf_dir), ["NDVI", "NIR"], ["mean", "max"], folds=make_folds((1995, 2001), fold_month=True)))


def _fold_query(name: str, wanted: dict[str, str], **how) -> None:
    """A query of counts and means by the folds of one kind of request."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(series.temporal_metrics(masked_observations(spark, sf_dir), ["NDVI"], ["count", "mean"], folds=make_folds((1996, 1998), **how)))

    run.__name__ = name
    query(_stm_sql(wanted, ("count", "mean")))(run)


_TWO, _THREE, _YR, _MO, _DOY = (1996, 1997), (1996, 1997, 1998), ["1996-1997"], ["3-5", "11-12"], ["100+-20"]
_SPRING, _WINTER, _DAYS = "month(ts) BETWEEN 3 AND 5", "month(ts) BETWEEN 11 AND 12", "dayofyear(ts) BETWEEN 80 AND 120"
_months_of = lambda ys, ms: {f"Y{y}-{y}_M{m:02d}-{m:02d}_D001-366": f"year(ts) = {y} AND month(ts) = {m}" for y in ys for m in ms}
_ranges_of = lambda key, test: {f"{key}_M03-05_D001-366": f"{test} AND {_SPRING}", f"{key}_M11-12_D001-366": f"{test} AND {_WINTER}"}
_fold_query("fold_years_months_by_year_by_month", _months_of(_TWO, (3, 4, 5, 11, 12)), custom={"year": _YR, "month": _MO}, fold_year=True, fold_month=True)
_fold_query("fold_years_months_by_year", {k: v for y in _TWO for k, v in _ranges_of(f"Y{y}-{y}", f"year(ts) = {y}").items()}, custom={"year": _YR, "month": _MO}, fold_year=True)
_fold_query("fold_years_months_by_month", _ranges_of("Y1996-1997", "year(ts) BETWEEN 1996 AND 1997"), custom={"year": _YR, "month": _MO}, fold_month=True)
_fold_query("fold_years_months", _ranges_of("Y1996-1997", "year(ts) BETWEEN 1996 AND 1997"), custom={"year": _YR, "month": _MO})
_fold_query("fold_years_doys_by_year", {f"Y{y}-{y}_M01-12_D080-120": f"year(ts) = {y} AND {_DAYS}" for y in _TWO}, custom={"year": _YR, "doy": _DOY}, fold_year=True)
_fold_query("fold_years_doys", {"Y1996-1997_M01-12_D080-120": f"year(ts) BETWEEN 1996 AND 1997 AND {_DAYS}"}, custom={"year": _YR, "doy": _DOY})
_fold_query("fold_doys_by_year", {f"Y{y}-{y}_M01-12_D080-120": f"year(ts) = {y} AND {_DAYS}" for y in _THREE}, custom={"doy": _DOY}, fold_year=True)
_fold_query("fold_years_by_year_by_month", _months_of(_TWO, range(1, 13)), custom={"year": _YR}, fold_year=True, fold_month=True)
_fold_query("fold_years_by_year", {f"Y{y}-{y}_M01-12_D001-366": f"year(ts) = {y}" for y in _TWO}, custom={"year": _YR}, fold_year=True)
_fold_query("fold_years_by_month", _months_of(_TWO, range(1, 13)), custom={"year": _YR}, fold_month=True)
_fold_query("fold_years", {"Y1996-1997_M01-12_D001-366": "year(ts) BETWEEN 1996 AND 1997"}, custom={"year": _YR})
_fold_query("fold_months_by_year_by_month", _months_of(_THREE, (3, 4, 5, 11, 12)), custom={"month": _MO}, fold_year=True, fold_month=True)
_fold_query("fold_months_by_year", {k: v for y in _THREE for k, v in _ranges_of(f"Y{y}-{y}", f"year(ts) = {y}").items()}, custom={"month": _MO}, fold_year=True)
_fold_query("fold_months_by_month", {f"Y1996-1998_M{m:02d}-{m:02d}_D001-366": f"year(ts) BETWEEN 1996 AND 1998 AND month(ts) = {m}" for m in (3, 4, 5, 11, 12)}, custom={"month": _MO}, fold_month=True)
_fold_query("fold_by_year_by_month", _months_of(_THREE, range(1, 13)), fold_year=True, fold_month=True)
_fold_query("fold_none", {"Y1996-1998_M01-12_D001-366": "year(ts) BETWEEN 1996 AND 1998"})
_fold_query("fold_dates_of_interest", {"Y1996-1998_M00-00_D032-060": "ts >= TIMESTAMP '1996-02-01' AND ts < TIMESTAMP '1998-03-01'"}, dates=(19960201, 19980301))


@query(_stm_sql({f"Y{y}-{y}_M01-12_D001-366": f"year(ts) = {y}" for y in range(1996, 2001)}, ("median", "variance")))
def stm_fold_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.temporal_metrics(masked_observations(spark, sf_dir), ["NDVI"], ["median", "variance"], folds=make_folds((1996, 2000), fold_year=True)))


@query(_stm_sql({"Y1995-2001_M01-12_D162-222": "dayofyear(ts) BETWEEN 162 AND 222", "Y1995-2001_M01-12_D320-014": "(dayofyear(ts) >= 320 OR dayofyear(ts) <= 14)"}, ("p25", "p75")))
def stm_fold_doy_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = make_folds((1995, 2001), custom={"doy": ["192+-30", "350+-30"]})
    return rounded(series.temporal_metrics(masked_observations(spark, sf_dir), ["NDVI"], ["p25", "p75"], folds=folds))


@query(_stm_sql({"Y1996-1997_M00-00_D061-120": "ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1997-04-30'", "Y1999-1999_M00-00_D171-211": "ts >= TIMESTAMP '1999-06-20' AND ts < TIMESTAMP '1999-07-30'"}, ("mean", "min")))
def stm_fold_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = make_folds((1995, 2001), custom={"date": ["19960301-19970430", "19990710+-20"]})
    return rounded(series.temporal_metrics(masked_observations(spark, sf_dir), ["NDVI"], ["mean", "min"], folds=folds))


_LOCAL = {"full": tuple(range(1, 13)), "winter": (12, 1, 2), "summer": (6, 7, 8)}


@query(f"WITH {OBS}, l AS (SELECT (py * 10 + px)::INT AS id, 1996 + px % 5 AS y, ts, NIR, RED FROM obs), w AS (SELECT * FROM l WHERE abs(year(ts) - y) <= 1) SELECT id, " + ", ".join(f"{R(f'quantile_cont({b}, {q / 100}) FILTER (month(ts) IN ({', '.join(map(str, m))}))', f'{s}_{b}_p{q}')}" for s, m in _LOCAL.items() for b in ("NIR", "RED") for q in (5, 25, 50, 75, 95)) + ", " + ", ".join(R(f"stddev_pop({b}) FILTER (month(ts) IN ({', '.join(map(str, m))}))", f"{s}_{b}_stdDev") for s, m in _LOCAL.items() for b in ("NIR", "RED")) + " FROM w GROUP BY id")
def local_stm_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir).withColumns({"id": F.col("py") * 10 + F.col("px"), "year": 1996 + F.col("px") % 5})
    return rounded(series.seasonal_metrics(df, ["NIR", "RED"], _LOCAL))


# Composites


def _best_sql(score: str, source: str = "tss", keys: str = "px, py") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, ts, scene_id) AS rn FROM {source} WHERE {score} IS NOT NULL"


@query(f"WITH {TSS}, b AS ({_best_sql('NDVI')}) SELECT px, py, scene_id, {R('NDVI')}, {R('NIR')} FROM b WHERE rn = 1")
def pbc_max_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composite.composite_feature(masked_observations(spark, sf_dir), "NDVI", ["NIR"]).select("px", "py", "scene_id", "NDVI", "NIR"))


@query(f"WITH {TSS}, n AS (SELECT *, {ND.format(a='NIR', b='SW2')} AS NBR FROM tss), b AS ({_best_sql('-NBR', 'n')}) SELECT px, py, scene_id, {R('NBR')}, {R('NIR')} FROM b WHERE rn = 1")
def pbc_min_nbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composite.composite_feature(masked_observations(spark, sf_dir), "NBR", ["NIR"], invert=True).select("px", "py", "scene_id", "NBR", "NIR"))


@query(f"WITH {TSS}, n AS (SELECT *, year(ts) AS y, NIR / nullif(BLU, 0) AS RNB FROM tss WHERE year(ts) BETWEEN 1996 AND 1999), b AS ({_best_sql('RNB', 'n', 'px, py, y')}) SELECT px, py, format('Y{{0}}-{{0}}_M01-12_D001-366', y) AS fold_key, scene_id, {R('RNB')} FROM b WHERE rn = 1")
def pbc_max_rnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composite.composite_feature(masked_observations(spark, sf_dir), "RNB", ["NIR"], folds=make_folds((1996, 1999), fold_year=True)).select("px", "py", "fold_key", "scene_id", "RNB"))


_NLCD = " + ".join(f"pow({b} - m_{b}, 2)" for b in OPTICAL)


@query(f"WITH {TSS}, n AS (SELECT *, " + ", ".join(f"median({b}) OVER (PARTITION BY px, py) AS m_{b}" for b in OPTICAL) + f" FROM tss), s AS (SELECT *, round(-({_NLCD}), 12) AS score FROM n), b AS ({_best_sql('score', 's')}) SELECT px, py, scene_id, {R('NIR')}, {R('score', 'SCORE')} FROM b WHERE rn = 1")
def pbc_nlcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composite.composite_nlcd(masked_observations(spark, sf_dir), ["NIR"]).select("px", "py", "scene_id", "NIR", "SCORE"))


_BAP = """gg AS (SELECT o.*, ((px * 7 + py * 13 + dayofyear(ts)) % 20) * 30.0 AS distance FROM tss o WHERE year(ts) BETWEEN 1996 AND 2000 AND dayofyear(ts) BETWEEN 162 AND 222),
sc AS (SELECT *, exp(-0.5 * pow((dayofyear(ts) - 1 - 192) / 10.0, 2)) AS d, abs(year(ts) - 1998) AS dy,
  CASE WHEN mask = 0 OR distance <= 0 THEN 0.0 WHEN distance <= 500 THEN distance / 500 ELSE 1.0 END AS c FROM gg),
bs AS (SELECT *, 0.2::DOUBLE * c + 0.6::DOUBLE * d + 0.2::DOUBLE * (CASE WHEN dy > 2 THEN 0.0 WHEN dy > 1 THEN exp(-0.5 * 9.0) * (1 - (dy - 1) / 1.0) WHEN dy = 1 THEN exp(-0.5 * 9.0) ELSE 1.0 END) AS score FROM sc WHERE mask = 1)"""


@query(f"WITH {TSS}, {_BAP}, rs AS (SELECT * REPLACE (round(score, 9) AS score) FROM bs), b AS ({_best_sql('score', 'rs')}) SELECT px, py, 'Y1996-2000_M01-12_D162-222' AS fold_key, scene_id, {R('score', 'SCORE')}, {R('NIR')} FROM b WHERE rn = 1")
def pbc_bap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = masked_observations(spark, sf_dir).withColumn("distance", ((F.col("px") * 7 + F.col("py") * 13 + F.dayofyear("ts")) % 20) * 30.0)
    folds = make_folds((1995, 2001), custom={"year": ["1996-2000"], "doy": ["192+-30"]})
    scored = composite.bap_scores(join_folds(df, folds)).withColumn("SCORE", F.round("SCORE", 9)).filter("mask = 1")
    return rounded(composite.best_pixel(scored, "SCORE", ["NIR"], ["px", "py", "fold_key"]).select("px", "py", "fold_key", "scene_id", "SCORE", "NIR"))


# Interpolation

DAY = 86_400_000


def _rbf_sql(step: int, kernels: list[tuple[float, float]], blend: str) -> str:
    """Range join of grid and observations; v1, w1, n1 and so on are a kernel's sums."""
    sums = ", ".join(f"sum(CASE WHEN abs(dl) <= {w} AND NDVI IS NOT NULL THEN NDVI * exp(-0.5 * pow(dl / {float(s)}, 2)) END) AS v{i}, sum(CASE WHEN abs(dl) <= {w} AND NDVI IS NOT NULL THEN exp(-0.5 * pow(dl / {float(s)}, 2)) END) AS w{i}, count(CASE WHEN abs(dl) <= {w} THEN NDVI END) AS n{i}, count(CASE WHEN abs(dl) <= {w} THEN 1 END) AS m{i}" for i, (s, w) in enumerate(kernels, 1))
    values = ", ".join(f"v{i} / w{i} AS r{i}" for i in range(1, len(kernels) + 1))
    return f"""WITH {EVENTS}, lim AS (SELECT min(t) AS a, max(t) AS b FROM ev), grid AS (SELECT k::INT AS k, a + k * {step * DAY} AS gt FROM lim, range(0, 1000) r(k) WHERE a + k * {step * DAY} <= b),
j AS (SELECT px, k, gt, NDVI, (t - gt) / {float(DAY)} AS dl FROM grid JOIN ev ON abs(t - gt) <= {int(max(w for _, w in kernels) * DAY)}),
s AS (SELECT px, k, gt, {sums} FROM j GROUP BY px, k, gt), q AS (SELECT *, {values} FROM s), c AS (SELECT *, least(n1 / 4.0, 1.0) AS c1{', least(n2 / 8.0, 1.0) * (1 - least(n1 / 4.0, 1.0)) AS c2' if len(kernels) == 3 else ''} FROM q)
SELECT px, k, gt AS t_ms, {R(blend, 'NDVI')} FROM c WHERE {' AND '.join(f'm{i} > 0' for i in range(1, len(kernels) + 1))}"""


@query(f"WITH {OBS}, lim AS (SELECT date_trunc('year', min(ts)) AS a, max(ts) AS b FROM obs) SELECT k::INT AS k, epoch_ms(a + to_months((k * 2)::INT)) AS t_ms FROM lim, range(0, 200) r(k) WHERE a + to_months((k * 2)::INT) <= b")
def time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.time_grid(observations(spark, sf_dir), 2, "month", january=True).select("k", F.unix_millis("t").alias("t_ms"))


@query(_rbf_sql(2, [(3, 4)], "r1"))
def tsi_1rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.rbf(event_series(spark, sf_dir), ["NDVI"], (3,), (4,), 2).drop("py"))


@query(_rbf_sql(2, [(2, 2), (6, 8)], "coalesce(r1 * c1, 0) + r2 * (1 - c1)"))
def tsi_2rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.rbf(event_series(spark, sf_dir), ["NDVI"], (2, 6), (2, 8), 2).drop("py"))


@query(f"""WITH {EVENTS}, lim AS (SELECT min(t) AS a, max(t) AS b FROM ev), grid AS (SELECT k::INT AS k, epoch_ms(epoch_ms(a) + to_months(k::INT)) AS gt FROM lim, range(0, 200) r(k) WHERE epoch_ms(epoch_ms(a) + to_months(k::INT)) <= b),
j AS (SELECT px, k, gt, NDVI, (t - gt) / {float(DAY)} AS dl FROM grid JOIN ev ON abs(t - gt) <= {10 * DAY})
SELECT px, k, gt AS t_ms, {R('sum(NDVI * exp(-0.5 * pow(dl / 5.0, 2))) / sum(CASE WHEN NDVI IS NOT NULL THEN exp(-0.5 * pow(dl / 5.0, 2)) END)', 'NDVI')} FROM j GROUP BY px, k, gt""")
def tsi_month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.rbf(event_series(spark, sf_dir), ["NDVI"], (5,), (10,), 1, unit="month").drop("py"))


@query(_rbf_sql(1, [(1, 1), (2, 3), (5, 6)], "coalesce(r1 * c1, 0) + coalesce(r2 * c2, 0) + r3 * (1 - c1 - c2)"))
def tsi_3rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.rbf(event_series(spark, sf_dir), ["NDVI"], (1, 2, 5), (1, 3, 6), 1).drop("py"))


@query("""WITH e AS (SELECT user_id::INT AS px, datediff('day', DATE '1970-01-01', ts::DATE) AS d, value / 500 AS v FROM events WHERE event_type <> 'view'),
lim AS (SELECT px, min(d) AS a, max(d) AS b FROM e GROUP BY px), grid AS (SELECT px, k, a + k * 3 AS g FROM lim, range(0, 400) r(k) WHERE k <= ceil((b - a) / 3.0)),
j AS (SELECT grid.px, grid.k, grid.g, v, d - grid.g AS dl FROM grid LEFT JOIN e ON e.px = grid.px AND abs(d - grid.g) <= 4),
s AS (SELECT px, k, g, sum(CASE WHEN abs(dl) <= 1 THEN v * exp(-0.5 * dl * dl) END) / sum(CASE WHEN abs(dl) <= 1 AND v IS NOT NULL THEN exp(-0.5 * dl * dl) END) AS r1,
      least(count(CASE WHEN abs(dl) <= 1 THEN v END) / 4.0, 1.0) AS c1, sum(v * exp(-0.5 * pow(dl / 3.0, 2))) / sum(CASE WHEN v IS NOT NULL THEN exp(-0.5 * pow(dl / 3.0, 2)) END) AS r2 FROM j GROUP BY px, k, g)
SELECT px, k::INT AS k, g * 86400000 AS t_ms, round((coalesce(r1 * c1, 0) + coalesce(r2 * (1 - c1), 0)) / nullif((CASE WHEN r1 IS NULL THEN 0 ELSE c1 END) + (CASE WHEN r2 IS NULL THEN 0 ELSE 1 - c1 END), 0) + 1e-10, 6) + 0.0 AS NDVI FROM s""")
def tsi_df_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_series(spark, sf_dir).filter("sensor <> 'view'")
    return rounded(interpolation.rbf_frame(df, "px", ["NDVI"], "2RBF", 3, (1, 3), (1, 4)))


@query("""WITH e AS (SELECT user_id::INT AS px, datediff('day', DATE '2024-01-01', ts::DATE) AS d, value / 500 AS v FROM events),
g AS (SELECT px, unnest([5, 15, 25]) AS g FROM (SELECT DISTINCT px FROM e)),
s AS (SELECT e.px, g.g, sum(v * exp(-0.5 * pow((d - g.g) / 4.0, 2))) / sum(exp(-0.5 * pow((d - g.g) / 4.0, 2))) AS r FROM g JOIN e ON e.px = g.px AND abs(d - g.g) <= 6 GROUP BY e.px, g.g)
SELECT px, round(max(r) FILTER (g = 5) + 1e-10, 6) + 0.0 AS d05, round(max(r) FILTER (g = 15) + 1e-10, 6) + 0.0 AS d15, round(max(r) FILTER (g = 25) + 1e-10, 6) + 0.0 AS d25 FROM s GROUP BY px""")
def tsi_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = event_series(spark, sf_dir).groupBy("px").agg(F.collect_list(F.struct("NDVI", day.alias("d"))).alias("s"))
    rows = interpolation.rbf_arrays(rows.select("px", F.col("s.NDVI").alias("v"), F.col("s.d").alias("d")), "v", "d", [5, 15, 25], 4, 6)
    return rounded(rows.select("px", *(F.get("rbf", F.lit(i)).alias(f"d{t:02d}") for i, t in enumerate((5, 15, 25)))))


def _wlin_sql(value: str) -> str:
    return f"""WITH {EVENTS}, lim AS (SELECT min(t) AS a, max(t) AS b FROM ev), grid AS (SELECT k::INT AS k, a + k * {2 * DAY} AS gt FROM lim, range(0, 1000) r(k) WHERE a + k * {2 * DAY} <= b),
j AS (SELECT px, k, gt, scene_id, NDVI, (t - gt) / {float(DAY)} AS dl FROM grid JOIN ev ON abs(t - gt) <= {3 * DAY}),
s AS (SELECT px, k, gt, max((dl, scene_id, NDVI)) FILTER (dl <= 0) AS b, max((-dl, scene_id, NDVI)) FILTER (dl >= 0) AS a FROM j GROUP BY px, k, gt),
v AS (SELECT px, k, gt, struct_extract_at(b, 3) AS vb, struct_extract_at(a, 3) AS va, struct_extract_at(b, 1) AS t1, -struct_extract_at(a, 1) AS t2 FROM s)
SELECT px, k, gt AS t_ms, {R(value, 'NDVI')} FROM v"""


@query(_wlin_sql("CASE WHEN t1 = t2 THEN vb ELSE vb + (va - vb) * (-t1 / (t2 - t1)) END"))
def tsi_wlin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.linear(event_series(spark, sf_dir), ["NDVI"], 2, 3).drop("py"))


@query(_wlin_sql("(vb + va) / 2"))
def tsi_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.linear(event_series(spark, sf_dir), ["NDVI"], 2, 3, half=True).drop("py"))


@query(f"WITH {EVENTS} SELECT scene_id, {R('avg(NDVI) OVER w', 'NDVI_mean')} FROM ev WINDOW w AS (PARTITION BY px ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND {5 * DAY} FOLLOWING)")
def tsi_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.moving_mean(event_series(spark, sf_dir), ["NDVI"], 5).select("scene_id", "NDVI_mean"))


@query(f"WITH {EVENTS} SELECT scene_id, {R('avg(NDVI) OVER w', 'NDVI_mean')} FROM ev WINDOW w AS (PARTITION BY px ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND {5 * DAY - 1} FOLLOWING)")
def temporal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.moving_mean(event_series(spark, sf_dir), ["NDVI"], 5, half_open=True).select("scene_id", "NDVI_mean"))


@query(f"WITH {EVENTS}, m AS (SELECT scene_id, NDVI, avg(NDVI) OVER w AS m, stddev_pop(NDVI) OVER w AS s FROM ev WINDOW w AS (PARTITION BY px ORDER BY t RANGE BETWEEN {10 * DAY} PRECEDING AND {10 * DAY} FOLLOWING)) SELECT scene_id, {R('m - 2.0 * s', 'NDVI_low')}, {R('m + 2.0 * s', 'NDVI_high')}, NDVI < m - 2.0 * s OR NDVI > m + 2.0 * s AS NDVI_outlier FROM m")
def moving_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolation.outlier_envelope(event_series(spark, sf_dir), "NDVI", 10, 2.0).select("scene_id", "NDVI_low", "NDVI_high", "NDVI_outlier"))


# Phenology

YEAR = 31_556_952_000


def _vector_sql(name: str, source: str, keys: str, suffix: str = "") -> str:
    return f"""{name}0 AS (SELECT {keys}, atan2(avg(NDVI * sin((dayofyear(ts) - 1) / 365.0 * 2 * pi())), avg(NDVI * cos((dayofyear(ts) - 1) / 365.0 * 2 * pi()))) AS r FROM {source} WHERE NDVI IS NOT NULL GROUP BY {keys}),
{name}1 AS (SELECT {keys}, CASE WHEN r <= 0 THEN r + 2 * pi() ELSE r END AS r FROM {name}0),
{name} AS (SELECT {keys}, floor(least(greatest(r * 365 / (2 * pi()), 1), 365))::INT AS RAVG{suffix}, floor(least(greatest((CASE WHEN r >= pi() THEN r - pi() ELSE r + pi() END) * 365 / (2 * pi()), 1), 365))::INT AS THETA{suffix} FROM {name}1)"""


_LSP_BASE = f"""WITH {TSS}, m AS (SELECT px, py, ts::DATE AS day, min(ts) AS ts, arg_max(NDVI, (ts, scene_id)) FILTER (NDVI IS NOT NULL) AS NDVI FROM tss GROUP BY px, py, ts::DATE),
{_vector_sql('v', 'm', 'px, py')}, f AS (SELECT *, (CASE WHEN THETA < 183 THEN 1 ELSE 0 END)::INT AS valid_firstyear FROM v),
w AS (SELECT m.*, RAVG, THETA, valid_firstyear, y::INT AS year, epoch_ms(ts) AS t, (y - (CASE valid_firstyear WHEN 1 THEN 0 ELSE 1 END) - 1970) * {YEAR} + THETA::BIGINT * {DAY} AS t_start FROM m JOIN f USING (px, py), range(1996, 2000) r(y)),
s AS (SELECT *, t_start + {YEAR} AS t_end FROM w WHERE t >= t_start AND t < t_start + {YEAR})"""
_LSP_ADJUST = f"""{_vector_sql('o', 's', 'px, py, year', '_s')},
d AS (SELECT s.*, RAVG_s, THETA_s, ((THETA_s - THETA + 183 + 730) % 365) - 183 AS turn FROM s JOIN o USING (px, py, year)),
a AS (SELECT *, t_start + least(greatest(turn, -40), 40)::BIGINT * {DAY} AS t_start_adj, t_end + least(greatest(turn, -40), 40)::BIGINT * {DAY} AS t_end_adj FROM d),
x AS (SELECT * FROM a WHERE t >= t_start_adj AND t < t_end_adj)"""


def _lsp_sql(source: str) -> str:
    return f"""c0 AS (SELECT *, sum(coalesce(trunc(NDVI * 10000)::BIGINT, 0)) OVER (PARTITION BY px, py, year ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS c FROM {source}),
c1 AS (SELECT *, max(c) OVER (PARTITION BY px, py, year) AS top FROM c0), c2 AS (SELECT *, min(CASE WHEN c = top THEN t END) OVER (PARTITION BY px, py, year) AS fl FROM c1),
cum AS (SELECT *, CASE WHEN c <> 0 AND t <= fl THEN c END AS CUM FROM c2)"""


_CROSSINGS = """q AS (SELECT px, py, year, quantile_cont(CUM, [0.15, 0.25, 0.5, 0.75, 0.8]) AS q FROM cum GROUP BY px, py, year),
e AS (SELECT px, py, year, u.i, dayofyear(ts) AS d, round(abs(CUM - q[u.i]), 6) AS gap FROM cum JOIN q USING (px, py, year), unnest([1, 2, 3, 4, 5]) AS u(i) WHERE CUM IS NOT NULL),
n AS (SELECT *, min(gap) OVER (PARTITION BY px, py, year, i) AS least_gap FROM e),
z AS (SELECT px, py, year, """ + ", ".join(f"max(d) FILTER (i = {i} AND gap = least_gap)::INT AS {m}" for i, m in enumerate(phenology.PERCENTILES, 1)) + " FROM n GROUP BY px, py, year)"


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_mosaic(masked_observations(spark, sf_dir), ["NDVI"])


@query(f"{_LSP_BASE} SELECT px, py, RAVG, THETA FROM v")
def lsp_polar_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenology.polar_vector(_mosaic(spark, sf_dir), "NDVI", ["px", "py"])


@query(f"{_LSP_BASE} SELECT px, py, year, strftime(day, '%Y%m%d') AS scene_id, RAVG, THETA, valid_firstyear, t_start, t_end FROM s")
def lsp_season_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenology.season_windows(_mosaic(spark, sf_dir), "NDVI", (1996, 1999)).select("px", "py", "year", "scene_id", "RAVG", "THETA", "valid_firstyear", "t_start", "t_end")


@query(f"{_LSP_BASE}, {_lsp_sql('s')} SELECT px, py, year, strftime(day, '%Y%m%d') AS scene_id, CUM FROM cum")
def lsp_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenology.cumulative(phenology.season_windows(_mosaic(spark, sf_dir), "NDVI", (1996, 1999)), "NDVI").select("px", "py", "year", "scene_id", "CUM")


def _lsp_out(source: str, extra: str = "", columns: str = "") -> str:
    return f"f1 AS (SELECT DISTINCT px, py, year, THETA, RAVG, valid_firstyear, t_start, t_end{extra} FROM {source}) SELECT f1.px, f1.py, f1.year, THETA, RAVG, valid_firstyear, trunc(t_start / {DAY}::DOUBLE)::INT AS t_start, trunc(t_end / {DAY}::DOUBLE)::INT AS t_end{columns}, SOS, SOP, MOS, EOP, EOS FROM f1 LEFT JOIN z USING (px, py, year)"


@query(f"{_LSP_BASE}, {_lsp_sql('s')}, {_CROSSINGS}, {_lsp_out('s')}")
def lsp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenology.phenology(_mosaic(spark, sf_dir), "NDVI", (1996, 1999))


@query(f"{_LSP_BASE}, {_LSP_ADJUST}, {_lsp_sql('x')}, {_CROSSINGS}, {_lsp_out('x', ', THETA_s, RAVG_s, t_start_adj, t_end_adj', f', THETA_s, RAVG_s, trunc(t_start_adj / {DAY}::DOUBLE)::INT AS t_start_adj, trunc(t_end_adj / {DAY}::DOUBLE)::INT AS t_end_adj')}")
def lsp_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenology.phenology(_mosaic(spark, sf_dir), "NDVI", (1996, 1999), adjust=True)


@query(f"{_LSP_BASE}, {_lsp_sql('s')}, {_CROSSINGS} SELECT f.px, f.py, " + ", ".join(f"max({m}) FILTER (year = {y}) AS {m}_{y}" for m in ("SOS", "EOS") for y in range(1996, 2000)) + " FROM (SELECT DISTINCT px, py FROM s) f LEFT JOIN z USING (px, py) GROUP BY f.px, f.py")
def lsp_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenology.by_year(phenology.phenology(_mosaic(spark, sf_dir), "NDVI", (1996, 1999)), (1996, 1999), metrics=("SOS", "EOS"))


# Reshaping and export

_DATES = [f"199607{d:02d}" for d in range(1, 15)]


@query(f"WITH {TSS} SELECT px, py, " + ", ".join(R(f"max(CASE WHEN strftime(ts, '%Y%m%d') = '{d}' THEN {b} END)", f"{b}_{d}") for d in _DATES for b in ("NDVI", "NIR")) + " FROM tss GROUP BY px, py")
def pivot_time_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = masked_observations(spark, sf_dir).withColumn("date", yyyymmdd("ts"))
    return rounded(export.to_wide(df, ["NDVI", "NIR"], _DATES))


@query(f"WITH {TSS}, d AS (SELECT px, py, strftime(ts, '%Y%m%d') AS d, max(NIR) AS v FROM tss GROUP BY px, py, strftime(ts, '%Y%m%d')), p AS (SELECT DISTINCT px, py FROM tss), l AS (SELECT px, py, unnest({_DATES}) AS d FROM p) SELECT px, py, 'NIR' AS band, d AS date, {R('v', 'value')} FROM l LEFT JOIN d USING (px, py, d)")
def unpivot_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = export.to_wide(masked_observations(spark, sf_dir).withColumn("date", yyyymmdd("ts")), ["NIR"], _DATES)
    return rounded(export.to_long(wide, "NIR").withColumn("date", F.date_format("date", "yyyyMMdd")))


@query(f"WITH {TSS} SELECT scene_id, trunc(least(greatest(coalesce(NDVI * 10000, -9999), -32768), 32767))::SMALLINT AS NDVI, trunc(least(greatest(coalesce(BLU * 10000, -9999), -32768), 32767))::SMALLINT AS BLU FROM tss")
def export_scale_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.scale_and_cast(masked_observations(spark, sf_dir).select("scene_id", "NDVI", "BLU"), ["NDVI", "BLU"], 10000, "int16", -9999)


@query(f"WITH {TSS} SELECT scene_id, trunc(NDVI * 100)::SMALLINT AS NDVI FROM tss WHERE NDVI IS NOT NULL")
def export_drop_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.table_rows(masked_observations(spark, sf_dir).select("scene_id", "NDVI"), ["NDVI"], 100, "int16", -9999, drop_nodata=True)


@query(f"WITH {TSS} " + " UNION ALL ".join(f"SELECT '{b}' AS band, {R(f'min({b})', 'min')}, {R(f'max({b})', 'max')}, {R(f'avg({b})', 'mean')}, {R(f'stddev_pop({b})', 'std')} FROM tss" for b in ("NDVI", "BLU")))
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.band_statistics(masked_observations(spark, sf_dir), ["NDVI", "BLU"]))


# Space

_ZONES = "z AS (SELECT n_name AS fid, (n_nationkey % 5 * 2)::DOUBLE AS x0, (n_nationkey // 5 * 2)::DOUBLE AS y0 FROM nation)"


def _zones(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    x, y = "cast(n_nationkey % 5 * 2 as double)", "cast(n_nationkey div 5 * 2 as double)"
    return read(spark, sf_dir, "nation").selectExpr("n_name fid", f"{x} xmin", f"{y} ymin", f"{x} + {side} xmax", f"{y} + {side} ymax")


@query(f"WITH {TSS}, {_ZONES} SELECT fid, (year(ts))::INT AS year, {R('avg(NDVI)', 'NDVI_mean')}, count(NDVI) AS NDVI_count, {R('quantile_cont(NIR, 0.9)', 'NIR_p90')}, {R('avg(NIR)', 'NIR_mean')}, count(NIR) AS NIR_count, {R('quantile_cont(NDVI, 0.9)', 'NDVI_p90')} FROM tss JOIN z ON px BETWEEN x0 AND x0 + 1 AND py BETWEEN y0 AND y0 + 1 GROUP BY fid, year(ts)")
def zonal_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = masked_observations(spark, sf_dir).withColumn("year", F.year("ts"))
    return rounded(spatial.zonal(df, _zones(spark, sf_dir, 1), ["NDVI", "NIR"], ["mean", "count", "p90"], block=4, image=("year",)))


@query(f"WITH {TSS}, {_ZONES} SELECT fid, scene_id, {R('NDVI', 'NDVI_first')} FROM tss JOIN z ON px = x0 AND py = y0")
def point_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.zonal(masked_observations(spark, sf_dir), _zones(spark, sf_dir, 0), ["NDVI"], ["first"], image=("scene_id",)))


@query(f"WITH {TSS}, {_ZONES} SELECT fid, (year(ts))::INT AS year, {R('avg(NDVI)', 'NDVI_mean')}, {R('max(NIR)', 'NIR_max')}, {R('max(NDVI)', 'NDVI_max')}, {R('avg(NIR)', 'NIR_mean')} FROM tss JOIN z ON pow(px - x0, 2) + pow(py - y0, 2) <= 2.25 GROUP BY fid, year(ts)")
def buffer_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = masked_observations(spark, sf_dir).withColumn("year", F.year("ts"))
    return rounded(spatial.zonal(df, _zones(spark, sf_dir, 0), ["NDVI", "NIR"], ["mean", "max"], buffer=1.5, block=4, image=("year",)))


def _in_ring_sql(x: str, y: str, rings: list[list[tuple[float, float]]]) -> str:
    edges = [(p, q) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True) if p[1] != q[1]]
    return "(" + " + ".join(f"(CASE WHEN ({p[1]} > {y}) <> ({q[1]} > {y}) AND {x} < ({q[0]} - {p[0]}) * ({y} - {p[1]}) / ({q[1]} - {p[1]}) + {p[0]} THEN 1 ELSE 0 END)" for p, q in edges) + ") % 2 = 1"


#: A polygon with a hole, a feature of two parts, and a triangle; their edges meet no pixel.
_SHAPES = {
    "hole": [[(0.3, 0.2), (8.7, 0.4), (7.6, 9.3), (1.2, 8.8)], [(2.4, 2.3), (5.6, 2.6), (4.4, 6.7)]],
    "parts": [[(0.1, 0.1), (2.2, 0.3), (1.4, 3.6)], [(6.3, 5.2), (9.4, 5.1), (9.2, 9.4), (6.1, 9.6)]],
    "triangle": [[(1.1, 1.2), (8.3, 1.3), (8.2, 7.4)]],
}


@query(f"WITH {TSS}, z AS (" + " UNION ALL ".join(f"SELECT '{n}' AS fid, tss.* FROM tss WHERE {_in_ring_sql('px', 'py', rings)}" for n, rings in _SHAPES.items()) + f") SELECT fid, year(ts)::INT AS year, {R('avg(NDVI)', 'NDVI_mean')}, count(NDVI) AS NDVI_count FROM z GROUP BY fid, year(ts)")
def zonal_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [roi.Roi(tuple(map(tuple, rings)), {"fid": n}) for n, rings in _SHAPES.items()]
    df = masked_observations(spark, sf_dir).withColumn("year", F.year("ts"))
    return rounded(spatial.zonal(df, roi.features_table(spark, shapes), ["NDVI"], ["mean", "count"], block=3, image=("year",), parts=2))


_TABLE_ROI = [[12.93, 52.19], [13.36, 52.18], [13.31, 52.64]]


@query(f"WITH {OBS}, s AS ({_landsat_sql('sensor = $$A$$ AND ts >= TIMESTAMP $$1996-01-01$$ AND ts < TIMESTAMP $$1998-01-01$$').replace('$$', chr(39))}), m AS (SELECT *, 12.9 + px * 0.05::DOUBLE AS x, 52.2 + py * 0.05::DOUBLE AS y FROM s WHERE {VALID}), p AS (SELECT px, py, any_value(x) AS x, any_value(y) AS y, avg({NDVI}) AS v FROM m GROUP BY px, py) SELECT '0' AS fid, {R('avg(v)', 'NDVI_mean_mean')} FROM p WHERE {_in_ring_sql('x', 'y', [[tuple(c) for c in _TABLE_ROI]])} HAVING count(*) > 0")
def export_table_stm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table export of STM writes before scaling: pixels' metrics, extracted by a polygon in degrees."""
    from .plans.pipeline import _extracted, run_level2, run_level3

    p = {"SENSORS": ["L8"], "YEAR_MIN": 1996, "YEAR_MAX": 1997, "ROI": _TABLE_ROI, "ROI_SIMPLIFY_GEOM_TO_BBOX": False, "FEATURES": ["NDVI"], "STM": ["mean"], "EXPORT_TABLE_REDUCER": "mean"}
    p = run_level3(run_level2(p, {"L8": landsat_table(spark, sf_dir, "L8")}, spark))
    return rounded(_extracted(p, p["STM_IMAGE"], ["NDVI_mean"]))


@query("""SELECT format('T_X{:03d}-Y{:03d}', x, y) AS ID, x::INT AS X, y::INT AS Y, (1000.0 + x * 75000)::DOUBLE AS xmin, (9000000.0 - (y + 1) * 75000)::DOUBLE AS ymin, (1000.0 + (x + 1) * 75000)::DOUBLE AS xmax, (9000000.0 - y * 75000)::DOUBLE AS ymax,
format('T_150_X{:03d}-Y{:03d}', x // 2, y // 2) AS ID150, format('T_300_X{:03d}-Y{:03d}', x // 4, y // 4) AS ID300 FROM range(0, 23) a(x), range(0, 17) b(y)""")
def tile_grid_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.tile_grid(spark, 1000.0, 9_000_000.0, 23, 17, 75_000.0, "T_", (150, 300))


@query("SELECT c AS continent, count(*) AS n, count(DISTINCT format('{}_{}', x // 2, y // 2)) AS n300 FROM (VALUES ('AF', 69, 58), ('AN', 50, 36), ('AS', 67, 62), ('EU', 61, 38), ('NA', 84, 62), ('OC', 90, 54), ('SA', 65 + 11, 65)) t(c, w, h), range(0, 90) a(x), range(0, 70) b(y) WHERE x < w AND y < h GROUP BY c".replace("65 + 11, 65", "76, 65"))
def continent_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.continent_tiles(spark, "ALL").groupBy("continent").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ID300").alias("n300"))


@query("""WITH b AS (SELECT n_nationkey * 7.5::DOUBLE AS x0, n_nationkey * 3.5::DOUBLE AS y0, n_nationkey * 7.5::DOUBLE + 12 AS x1, n_nationkey * 3.5::DOUBLE + 5 AS y1 FROM nation)
SELECT DISTINCT format('X{:03d}-Y{:03d}', x, y) AS ID, x::INT AS X, y::INT AS Y FROM range(0, 20) a(x), range(0, 10) c(y), b WHERE x BETWEEN floor(x0 / 10) AND floor(x1 / 10) AND y BETWEEN floor((100 - y1) / 10) AND floor((100 - y0) / 10)""")
def tile_spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = read(spark, sf_dir, "nation").selectExpr("n_nationkey * 7.5D xmin", "n_nationkey * 3.5D ymin", "n_nationkey * 7.5D + 12 xmax", "n_nationkey * 3.5D + 5 ymax")
    return spatial.tiles_touching(spatial.tile_grid(spark, 0.0, 100.0, 20, 10, 10.0), boxes, 10.0, 0.0, 100.0).select("ID", "X", "Y")


@query("""WITH p AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1000)::DOUBLE AS x, (abs(c_acctbal) / 10)::DOUBLE AS y FROM customer), c AS (SELECT s_suppkey AS block, ((s_suppkey * 613) % 1000)::DOUBLE AS cx, (abs(s_acctbal) / 10)::DOUBLE AS cy FROM supplier),
d AS (SELECT id, block, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS distance FROM p, c) SELECT id, block, round(distance + 1e-10, 6) + 0.0 AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, block) = 1""")
def nearest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").selectExpr("c_custkey id", "cast((c_custkey * 37) % 1000 as double) x", "abs(c_acctbal) / 10 y")
    centres = read(spark, sf_dir, "supplier").selectExpr("s_suppkey block", "cast((s_suppkey * 613) % 1000 as double) x", "abs(s_acctbal) / 10 y")
    return rounded(spatial.nearest(points, centres, cell=40.0))


@query("""WITH p AS (SELECT c_custkey AS id, ((c_custkey * c_custkey) % 1009)::DOUBLE AS x, (abs(c_acctbal) / 10)::DOUBLE AS y FROM customer), b AS (SELECT *, floor(x / 100)::INT AS bx, floor(y / 100)::INT AS bv FROM p),
n AS (SELECT bx, bv, count(*) AS n FROM b GROUP BY bx, bv), m AS (SELECT s.bx, s.bv, format('B{}_{}', l.bx, l.bv) AS t, row_number() OVER (PARTITION BY s.bx, s.bv ORDER BY sqrt(pow((s.bx - l.bx) * 100, 2) + pow((s.bv - l.bv) * 100, 2)), format('B{}_{}', l.bx, l.bv)) AS rn FROM n s, n l WHERE s.n < 14 AND l.n >= 14)
SELECT id, coalesce(t, format('B{}_{}', b.bx, b.bv)) AS block FROM b LEFT JOIN m ON m.bx = b.bx AND m.bv = b.bv AND rn = 1""")
def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "customer").selectExpr("c_custkey id", "cast((c_custkey * c_custkey) % 1009 as double) x", "abs(c_acctbal) / 10 y")
    return spatial.chunk_points(points, 100, 14).select("id", "block")


@query(f"""WITH {GRID}, o AS (SELECT dx, dy FROM range(-4, 5) a(dx), range(-4, 5) b(dy)), m1 AS (SELECT g.px, g.py, max(h.mask) AS mask FROM g, o JOIN g h ON h.px = g.px + dx AND h.py = g.py + dy WHERE dx * dx + dy * dy <= 4 GROUP BY g.px, g.py)
SELECT g.px, g.py, min(h.mask)::INT AS mask FROM m1 g, o JOIN m1 h ON h.px = g.px + dx AND h.py = g.py + dy WHERE dx * dx + dy * dy <= 16 GROUP BY g.px, g.py""")
def erode_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.erode_dilate(part_grid(spark, sf_dir).select("scene_id", "px", "py", "mask"), 60, 120, 30).drop("scene_id")


@query(f"WITH {GRID} SELECT g.px, g.py, {R('min(sqrt(pow(h.px - g.px, 2) + pow(h.py - g.py, 2))) * 30', 'distance')} FROM g LEFT JOIN g h ON h.mask = 0 AND h.px BETWEEN g.px - 5 AND g.px + 5 AND h.py BETWEEN g.py - 5 AND g.py + 5 AND pow(h.px - g.px, 2) + pow(h.py - g.py, 2) <= 25 GROUP BY g.px, g.py")
def cloud_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masking.cloud_distance(part_grid(spark, sf_dir), 150, 30).select("px", "py", "distance"))


@query(f"""WITH {GRID}, s AS (SELECT DISTINCT px + round(k * cos(radians(90 - 135.0)))::INT AS px, py + round(k * sin(radians(90 - 135.0)))::INT AS py FROM g, range(1, 6) r(k) WHERE mask = 0)
SELECT g.px, g.py, (CASE WHEN s.px IS NOT NULL AND NIR < 0.3 AND SCL <> 6 THEN 0 ELSE mask END)::INT AS mask FROM g LEFT JOIN s USING (px, py)""")
def shadow_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.project_shadows(part_grid(spark, sf_dir), 0.3, 0.6, 120, 135.0).select("px", "py", "mask")


@query(f"""WITH {GRID}, o AS (SELECT dx, dy, (CASE WHEN dx = 0 OR dy = 0 THEN 2 ELSE 1 END) AS w FROM range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0),
s AS (SELECT g.px, g.py, sum(h.value * dx * w) / 240.0 AS gx, sum(h.value * dy * w) / 240.0 AS gy FROM g, o JOIN g h ON h.px = g.px + dx AND h.py = g.py + dy GROUP BY g.px, g.py HAVING count(*) = 8),
t AS (SELECT g.px, g.py, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, degrees(atan2(-gx, gy)) AS a FROM g LEFT JOIN s USING (px, py)), u AS (SELECT *, CASE WHEN a < 0 THEN a + 360 ELSE a END AS aspect FROM t)
SELECT px, py, {R('slope')}, {R('aspect')}, {R('sin(radians(aspect))', 'eastness')}, {R('cos(radians(aspect))', 'northness')} FROM u""")
def dem_slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.terrain(part_grid(spark, sf_dir), 30).select("px", "py", "slope", "aspect", "eastness", "northness"))


@query(f"WITH {GRID} SELECT px // 4 AS px, py // 4 AS py, {R('avg(value)', 'value')} FROM g GROUP BY px // 4, py // 4")
def overview_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.overview(part_grid(spark, sf_dir), ["value"], 4).selectExpr("cast(px as int) px", "cast(py as int) py", "value"))


@query(f"""WITH {GRID}, e AS (SELECT (max(px) + 1) * 2 AS w, (max(py) + 1) * 2 AS h FROM g), t AS (SELECT g.*, tx, ty, greatest(1 - abs((tx + 0.5) / 2 - 0.5 - px), 0) * greatest(1 - abs((ty + 0.5) / 2 - 0.5 - py), 0) AS wt FROM g, range(-2, 4) a(i), range(-2, 4) b(j), LATERAL (SELECT px * 2 + i AS tx, py * 2 + j AS ty), e WHERE tx >= 0 AND ty >= 0 AND tx < w AND ty < h)
SELECT tx::INT AS px, ty::INT AS py, {R('sum(value * wt) / sum(wt)', 'value')} FROM t WHERE wt > 0 GROUP BY tx, ty""")
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.resample(part_grid(spark, sf_dir), ["value"], 2, "bilinear"))


_CUBIC = "CASE WHEN abs({d}) <= 1 THEN 1.5 * abs({d}) ** 3 - 2.5 * abs({d}) ** 2 + 1 WHEN abs({d}) < 2 THEN -0.5 * abs({d}) ** 3 + 2.5 * abs({d}) ** 2 - 4 * abs({d}) + 2 ELSE 0.0 END"


@query(f"""WITH {GRID}, e AS (SELECT (max(px) + 1) * 2 AS w, (max(py) + 1) * 2 AS h FROM g), t AS (SELECT g.*, tx, ty, ({_CUBIC.format(d="((tx + 0.5) / 2 - 0.5 - px)")}) * ({_CUBIC.format(d="((ty + 0.5) / 2 - 0.5 - py)")}) AS wt FROM g, range(-5, 8) a(i), range(-5, 8) b(j), LATERAL (SELECT px * 2 + i AS tx, py * 2 + j AS ty), e WHERE tx >= 0 AND ty >= 0 AND tx < w AND ty < h)
SELECT tx::INT AS px, ty::INT AS py, {R('sum(value * wt) / sum(wt)', 'value')} FROM t WHERE wt <> 0 GROUP BY tx, ty""")
def resample_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.resample(part_grid(spark, sf_dir), ["value"], 2, "bicubic"))


@query("SELECT c_custkey AS id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, floor((lon + 180) / 6)::INT + 1))::INT AS epsg FROM (SELECT c_custkey, (c_custkey * 37 % 36001) / 100.0 - 180 AS lon, (c_custkey * 53 % 16001) / 100.0 - 80 AS lat FROM customer)")
def utm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").selectExpr("c_custkey id", "(c_custkey * 37 % 36001) / 100D - 180 lon", "(c_custkey * 53 % 16001) / 100D - 80 lat")
    return df.select("id", spatial.utm_code(F.col("lon"), F.col("lat")).cast("int").alias("epsg"))


@query("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey IN (0, 2, 3) AND n_name <> 'CHINA' AND (n_nationkey IN (1, 5, 8, 9) OR n_regionkey = 3)")
def vector_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roi.features_where(read(spark, sf_dir, "nation"), within={"n_regionkey": [0, 2, 3]}, without={"n_name": ["CHINA"]}, either=[{"n_nationkey": [1, 5, 8, 9]}, {"n_regionkey": [3]}])
    return found.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


@query("SELECT n_name AS fid, min(c_acctbal) - 1 AS xmin, max(c_acctbal) + 1 AS xmax, -2.0::DOUBLE AS ymin, 3.0::DOUBLE AS ymax, 4 AS corners FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def feature_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of regions, a list as long as the nations."""
    spans = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).collect()
    shapes = [roi.Roi((((r["a"] - 1, -2.0), (r["b"] + 1, -2.0), (r["b"] + 1, 3.0), (r["a"] - 1, 3.0)),), {"fid": r["n_name"]}) for r in spans]
    return roi.features_table(spark, shapes).select("fid", "xmin", "xmax", "ymin", "ymax", F.size(F.get("rings", F.lit(0))).alias("corners"))


# Series and tables


@query(f"WITH {OBS} SELECT scene_id, year(ts)::INT AS year, month(ts)::INT AS month, (dayofyear(ts) - 1)::INT AS doy, strftime(ts, '%Y%m%d') AS date FROM obs")
def time_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(observations(spark, sf_dir)).select("scene_id", "year", "month", "doy", "date")


@query(f"WITH {EVENTS} SELECT scene_id, (CASE WHEN probability / 100 >= 0.6 THEN 1 ELSE 0 END)::INT AS mask, {R('CASE WHEN probability / 100 >= 0.6 THEN NDVI END', 'NDVI')} FROM ev")
def cloud_score_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_series(spark, sf_dir).withColumn("cs", F.col("probability") / 100)
    return rounded(masking.apply_mask(df, ["NDVI"], masking.cloud_score_valid("cs", 0.6)).select("scene_id", "mask", "NDVI"))


@query(f"WITH {GRID} SELECT px, py, value + 1 AS value FROM g")
def static_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = part_grid(spark, sf_dir).select("px", "py", "value")
    return scans.scan_static(grid.unionByName(grid.withColumn("value", F.col("value") + 2)), "value")


@query(f"WITH {OBS}, s AS ({_landsat_sql('true')}) SELECT v.name AS sensor, scene_id, {R('RED')}, {R('SW2')}, {R('CASE WHEN v.name <> $$L4$$ THEN LST END'.replace('$$', chr(39)), 'LST')} FROM s JOIN (VALUES ('R', 'L4'), ('R', 'L5'), ('N', 'L9')) v(flag, name) ON s.sensor = v.flag")
def tss_landsat_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"L4": landsat_table(spark, sf_dir, "L5"), "L5": landsat_table(spark, sf_dir, "L5"), "L9": landsat_table(spark, sf_dir, "L9")}
    return rounded(scans.scan_landsat(tables, ["L4", "L5", "L9"], None, None, 75, 1).select("sensor", "scene_id", "RED", "SW2", "LST"))


@query(f"""WITH {OBS}, {EVENTS}, s AS ({_landsat_sql('sensor = $$A$$ AND py <= 9').replace('$$', chr(39))}), l AS (SELECT 'L8' AS sensor, CASE WHEN {VALID} THEN NIR END AS NIR, CASE WHEN {VALID} THEN {NDVI} END AS NDVI FROM s), m AS (SELECT 'S2' AS sensor, NDVI * 0.8 AS NIR, NDVI * 0.2 AS RED FROM ev WHERE probability <= 75),
u AS (SELECT sensor, NIR, NDVI FROM l UNION ALL SELECT sensor, NIR, {NDVI} AS NDVI FROM m) SELECT 'LSS2' AS satellite, sensor, count(*) AS n, count(NDVI) AS valid, {R('avg(NIR)', 'NIR')}, {R('avg(NDVI)', 'NDVI')} FROM u GROUP BY sensor""")
def tss_landsat_sentinel2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.pipeline import run_level2

    e = event_series(spark, sf_dir).select("px", "py", "scene_id", "ts", F.lit(13.0).alias("x"), F.lit(52.3).alias("y"), (F.col("NDVI") * 8000).alias("B8"), (F.col("NDVI") * 2000).alias("B4"), F.col("probability").alias("CLOUDY_PIXEL_PERCENTAGE"))
    p = {"SENSORS": ["L8", "S2"], "MASKS_S2": None, "YEAR_MIN": 1990, "YEAR_MAX": 2040, "ROI": [12.9, 52.2, 13.9, 52.68], "FEATURES": ["NIR", "NDVI"]}
    p = run_level2(p, {"L8": landsat_table(spark, sf_dir, "L8"), "S2": e}, spark)
    return rounded(p["TSS"].groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count("NDVI").alias("valid"), F.avg("NIR").alias("NIR"), F.avg("NDVI").alias("NDVI")).withColumn("satellite", F.lit(p["SATELLITE"])))


@query(f"WITH {OBS}, c AS (SELECT px, py, RED, row_number() OVER (PARTITION BY px, py ORDER BY count(*) DESC, RED) AS k FROM obs GROUP BY px, py, RED) SELECT px, py, {R('RED', 'RED_mode')} FROM c WHERE k = 1")
def stm_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce_bands(observations(spark, sf_dir), ["px", "py"], ["RED"], ["mode"]))


@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY ts, scene_id) AS a, row_number() OVER (PARTITION BY px, py ORDER BY ts DESC, scene_id DESC) AS b FROM obs) SELECT px, py, scene_id, 'third' AS what FROM r WHERE a = 3 UNION ALL SELECT px, py, scene_id, 'last' FROM r WHERE b = 1")
def nth_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir).select("px", "py", "ts", "scene_id")
    picked = [series.nth_observation(df, n).select("px", "py", "scene_id", F.lit(w).alias("what")) for n, w in ((2, "third"), (-1, "last"))]
    return picked[0].unionByName(picked[1])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return series.unmatched(read(spark, sf_dir, "orders"), rich, ("o_custkey",)).select("o_orderkey", "o_custkey")


@query(f"WITH {TSS}, a AS (SELECT px, py, avg(NDVI) AS NDVI_mean FROM tss WHERE px < 7 GROUP BY px, py), b AS (SELECT px, py, count(NIR) AS CSO FROM tss WHERE px > 2 GROUP BY px, py) SELECT px, py, {R('NDVI_mean')}, CSO FROM a FULL JOIN b USING (px, py)")
def stack_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = masked_observations(spark, sf_dir)
    return rounded(series.stack_bands([series.temporal_metrics(df.filter("px < 7"), ["NDVI"], ["mean"]), series.clear_observations(df.filter("px > 2"), "NIR")]))


@query("WITH a AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT c_custkey AS id, o_orderpriority AS priority FROM customer LEFT JOIN a ON o_custkey = c_custkey AND k = 1")
def attribute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderpriority").alias("priority"))
    return series.attach_attributes(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), attributes, "id", "o_orderkey").select("id", "priority")


@query(f"WITH {TSS} " + " UNION ALL ".join(f"SELECT '{b}' AS band, {R(f'quantile_cont({b}, 0.02)', 'low')}, {R(f'quantile_cont({b}, 0.98)', 'high')} FROM tss" for b in ("NDVI", "NIR")))
def display_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.display_range(masked_observations(spark, sf_dir), ["NDVI", "NIR"], accuracy=None))


@query(f"SELECT px, 0 AS py, max(CASE WHEN k = 3 THEN NDVI END) AS a, max(CASE WHEN k = 9 THEN NDVI END) AS b FROM ({_rbf_sql(2, [(3, 4)], 'r1')}) WHERE k IN (3, 9) GROUP BY px")
def tsi_dated_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interpolated series as an image with a band for each of two dates."""
    df = event_series(spark, sf_dir)
    first = interpolation.grid_bounds(df)[0]
    dates = [datetime.fromtimestamp((first + k * 2 * DAY) / 1000, timezone.utc).strftime("%Y%m%d") for k in (3, 9)]
    tsi = interpolation.rbf(df, ["NDVI"], (3,), (4,), 2).withColumn("ts", F.timestamp_millis("t_ms"))
    return rounded(export.dated_bands(tsi, ["NDVI"], dates).withColumnsRenamed({f"NDVI_{d}": n for d, n in zip(dates, "ab", strict=True)}))


# Models

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) + 1e-10, 6) + 0.0 AS corr FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model.correlation(read(spark, sf_dir, "lineitem"), _NUMBERS))


_TREES = [["0 NIR <= 0.4", "1 RED <= 0.1", "2 = 1.0", "1 RED > 0.1", "2 = 0.0", "0 NIR > 0.4", "1 = 2.0"], ["0 RED <= 0.12", "1 = 2.0", "0 RED > 0.12", "1 NIR <= 0.7", "2 = 0.0", "1 NIR > 0.7", "2 = 1.0"], ["0 SW1 <= 0.2", "1 = 1.0", "0 SW1 > 0.2", "1 = 0.0"]]


@query(f"""WITH {OBS}, v AS (SELECT scene_id, [CASE WHEN NIR <= 0.4 THEN CASE WHEN RED <= 0.1 THEN 1 ELSE 0 END ELSE 2 END, CASE WHEN RED <= 0.12 THEN 2 WHEN NIR <= 0.7 THEN 0 ELSE 1 END, CASE WHEN SW1 <= 0.2 THEN 1 ELSE 0 END] AS v FROM obs)
SELECT scene_id, (CASE WHEN v[1] = v[2] OR v[1] = v[3] THEN v[1] WHEN v[2] = v[3] THEN v[2] ELSE list_min(v) END)::DOUBLE AS class FROM v""")
def tree_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.classify(observations(spark, sf_dir), _TREES).select("scene_id", "class")


@query()
def forest_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest trained on every other embedding and its label, written as rules, read back, and applied as expressions."""
    names = [f"A{i:02d}" for i in range(64)]
    df = read(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    forest = model.train(df.filter("vec_id % 2 = 0"), names, "label", numTrees=10, maxDepth=5, seed=7)
    rules = model.rules_from_table(model.rules_table(spark, model.ensemble_rules(forest, names)))
    return model.classify(df, rules).select("vec_id", "label", "class")


@query("SELECT vec_id, (CASE WHEN votes > 32 THEN 1 ELSE 0 END)::DOUBLE AS class FROM (SELECT vec_id, list_sum([CASE WHEN x > (i - 32.5) / 640.0 THEN 1 ELSE 0 END FOR x, i IN embedding]) AS votes FROM embeddings)")
def forest_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of 64 given trees, each with a cut of its own in a column of its own."""
    names = [f"A{i:02d}" for i in range(64)]
    df = read(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    cuts = [(i - 31.5) / 640 for i in range(64)]
    return model.classify(df, [[f"0 {n} <= {c}", "1 = 0.0", f"0 {n} > {c}", "1 = 1.0"] for n, c in zip(names, cuts, strict=True)]).select("vec_id", "class")


# The whole chain from parameters

_RUN = {"SENSORS": ["L8"], "YEAR_MIN": 1995, "YEAR_MAX": 2001, "ROI": [12.9, 52.2, 13.2, 52.75], "FEATURES": ["NDVI", "NIR"]}


def _run_sql(tail: str) -> str:
    valid = f"CASE WHEN {VALID} THEN 1 ELSE 0 END AS mask"
    where = "sensor = 'A' AND 12.9::DOUBLE + px * 0.05::DOUBLE BETWEEN 12.9 AND 13.2 AND 52.2::DOUBLE + py * 0.05::DOUBLE BETWEEN 52.2 AND 52.75"
    return f"WITH {OBS}, raw AS ({_landsat_sql(where)}), km AS (SELECT *, {valid} FROM raw), tss AS (SELECT px, py, scene_id, ts, mask, CASE WHEN mask = 1 THEN {NDVI} END AS NDVI, CASE WHEN mask = 1 THEN NIR END AS NIR FROM km) {tail}"


def _run(spark: SparkSession, sf_dir: str, **more: object) -> dict:
    return run_param(_RUN | more, {"L8": landsat_table(spark, sf_dir, "L8")}, spark)


@query(_run_sql(f"SELECT px, py, scene_id, mask, {R('NDVI')}, {R('NIR')} FROM tss"))
def run_param_tss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_run(spark, sf_dir)["TSS"].select("px", "py", "scene_id", "mask", "NDVI", "NIR"))


@query(_run_sql(" UNION ALL ".join(f"SELECT px, py, '{k}' AS fold_key, " + ", ".join(R(_REDUCERS[r].format(b=b), f"{b}_{r}") for b in ("NDVI", "NIR") for r in ("p10", "mean")) + f" FROM tss WHERE {w} GROUP BY px, py" for k, w in _SEASONS.items())))
def run_param_stm(spark: SparkSession, sf_dir: str) -> DataFrame:
    custom = {"month": ["3-5", "6-8", "9-11", "12-2"]}
    return rounded(_run(spark, sf_dir, STM=["p10", "mean"], STM_FOLDING=True, FOLD_CUSTOM=custom)["STM_IMAGE"])


@query(_run_sql("SELECT px, py, count(DISTINCT CASE WHEN NDVI IS NOT NULL AND NIR IS NOT NULL THEN ts::DATE END) AS NVO FROM tss GROUP BY px, py"))
def run_param_nvo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, NVO=True)["NVO_IMAGE"]


@query()
def run_param_lsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phenology of an interpolated series; small differences of sums may turn a cut number, so rows only."""
    return _run(spark, sf_dir, TSM=True, TSI="2RBF", TSI_BASE_IMGCOL="TSM", WIN1=32, WIN2=90, LSP="POLAR")["LSP_COLLECTION"]
