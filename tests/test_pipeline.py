"""The chain from parameters to products and files."""

import json

import pytest
from pyspark.sql import functions as F

from pixelchron.plans.config import DEFAULTS, create_parameter_file, image_size_mb, load_parameters, merge_parameters
from pixelchron.plans.pipeline import run_level2, run_level3, run_param
from pixelchron.sources.roi import parse_roi
from pixelchron.sources.tables import landsat_table

SF = "/root/testdata/sf0.001"
BASE = {"SENSORS": ["L8"], "YEAR_MIN": 1996, "YEAR_MAX": 1999, "ROI": [12.9, 52.2, 13.4, 52.8], "FEATURES": ["NDVI", "NIR"], "GCP_MIN_LANDSAT": 0}


@pytest.fixture(scope="module")
def tables(spark):
    return {s: landsat_table(spark, SF, s).cache() for s in ("L7", "L8")}


def test_parameters(tmp_path):
    with pytest.raises(ValueError):
        merge_parameters({"NO_SUCH": 1})
    p = load_parameters(create_parameter_file(tmp_path / "p.yml"))
    assert p == DEFAULTS
    with pytest.raises(FileExistsError):
        create_parameter_file(tmp_path / "p.yml")
    assert load_parameters('{"STM": ["p50"]}') == {"STM": ["p50"]}
    assert image_size_mb((0, 0, 300, 300), 30, 2, degrees=False) == pytest.approx(100 * 2 * 2 / 1e6)


def test_no_sensor_is_an_error(spark):
    with pytest.raises(ValueError):
        run_level2({"SENSORS": []}, {}, spark)
    with pytest.raises(ValueError):
        run_level2(BASE | {"SENSORS": ["S2"], "MASKS_S2": "SCL"}, {"S2": spark.range(1)}, spark)


def test_all_products(spark, tables):
    p = run_param(BASE | {"SENSORS": ["L8", "L7"], "TSM": True, "NVO": True, "NVO_FOLDING": True, "FOLD_YEAR": True, "FOLD_CUSTOM": {"month": ["1-6", "7-12"]}, "TSI": "1RBF", "WIN1": 64, "SIGMA1": 32, "STM": ["p5", "mean", "p95", "stdDev"], "STM_BASE_IMGCOL": "TSM", "STM_FOLDING": True, "PBC": "NLCD", "FEATURES": ["BLU", "GRN", "RED", "NIR", "SW1", "SW2", "NDVI"], "LSP": "POLAR"}, tables, spark)
    assert p["TSS"].count() > 0 and p["TSM_COLLECTION"].count() <= p["TSS"].count()
    folds = {r["fold_key"] for r in p["STM_IMAGE"].select("fold_key").distinct().collect()}
    assert len(folds) == 8 and "Y1996-1996_M01-06_D001-366" in folds
    for k in ("NVO_IMAGE", "TSI_COLLECTION", "PBC_IMAGE", "LSP_IMAGE"):
        assert p[k].count() > 0, k
    assert "NDVI_stdDev" in p["STM_IMAGE"].columns


@pytest.mark.parametrize("kind", ["BAP", "MAX-NDVI", "MAX-RNB", "NIR"])
def test_composites(spark, tables, kind):
    features = ["BLU", "NDVI", "NIR"]
    p = run_level3(run_level2(BASE | {"PBC": kind, "PBC_FOLDING": True, "FOLD_CUSTOM": {"doy": ["182+-60"]}, "FEATURES": features}, tables, spark))
    assert p["PBC_IMAGE"].count() > 0


def test_unknown_choices(spark, tables):
    p = run_level2(BASE, tables, spark)
    for bad in ({"TSI": "9RBF"}, {"PBC": "NOPE"}, {"STM": ["p42"]}, {"STM": ["mean"], "STM_BASE_IMGCOL": "TSM"}):
        with pytest.raises(ValueError):
            run_level3(p | bad)


def test_morphology_and_unmixing_in_the_chain(spark, tables):
    tss = run_level2(BASE | {"ERODE_DILATE": True, "BLUE_MAX_MASKING": 0.06, "FEATURES": ["NIR", "RED"], "UMX": {"A": [0.5, 0.1], "B": [0.1, 0.2]}}, tables, spark)["TSS"]
    assert {"A", "B"} <= set(tss.columns) and "NIR" not in tss.columns
    assert tss.filter("mask = 0 and A is not null").count() == 0


def test_export(spark, tables, tmp_path):
    p = run_param(BASE | {"STM": ["mean"], "EXPORT_IMAGE": True, "EXPORT_TABLE": True, "EXPORT_STM": True, "EXPORT_TSS": True, "EXPORT_PER_TIME": True, "DATE_MIN": 19960101, "DATE_MAX": 19960701, "EXPORT_DIRECTORY": str(tmp_path), "EXPORT_BANDNAMES_AS_CSV": True, "ROI": [13.0, 52.2, 13.1, 52.3]}, tables, spark)
    assert sorted(p["EXPORTED"]) == ["STM_PXC_19960101-19960701_LSAT", "STM_PXC_19960101-19960701_LSAT_table", "TSS_PXC_19960101-19960701_LSAT", "TSS_PXC_19960101-19960701_LSAT_table"]
    image = spark.read.parquet(p["EXPORTED"]["TSS_PXC_19960101-19960701_LSAT"])
    assert "date" in image.columns and dict(image.dtypes)["NDVI"] == "smallint" and image.filter("NDVI is null").count() == 0
    table = spark.read.csv(p["EXPORTED"]["TSS_PXC_19960101-19960701_LSAT_table"], header=True)
    assert {"fid", "NDVI_first"} <= set(table.columns) and table.count() > 0
    table = spark.read.csv(p["EXPORTED"]["STM_PXC_19960101-19960701_LSAT_table"], header=True)
    assert {"fid", "NDVI_mean_first"} <= set(table.columns) and table.count() == 1
    with pytest.raises(ValueError):
        run_param(BASE | {"EXPORT_IMAGE": True, "EXPORT_STM": True, "EXPORT_DIRECTORY": str(tmp_path)}, tables, spark)


def test_every_product_has_a_table(spark, tables, tmp_path):
    given = BASE | {"FEATURES": ["BLU", "GRN", "RED", "NIR", "SW1", "SW2", "NDVI"], "NVO": True, "STM": ["mean"], "PBC": "MAX-NDVI", "TSI": "1RBF", "WIN1": 64, "SIGMA1": 32, "INTERVAL": 2, "INTERVAL_UNIT": "month", "LSP": "POLAR", "EXPORT_TABLE": True, "EXPORT_TABLE_REDUCER": "mean", "EXPORT_TABLE_TILE_SCALE": 4, "EXPORT_DIRECTORY": str(tmp_path), "ROI": [[12.91, 52.19], [13.38, 52.21], [13.32, 52.66]], "ROI_SIMPLIFY_GEOM_TO_BBOX": False}
    p = run_param(given | {f"EXPORT_{k}": True for k in ("TSS", "NVO", "STM", "PBC", "TSI", "LSP")}, tables, spark)
    for name, path in p["EXPORTED"].items():
        assert spark.read.csv(path, header=True).count() > 0, name
    # The polygon, not its box, is what is scanned.
    assert p["TSS"].count() < run_param(given | {"EXPORT_TABLE": False, "ROI_SIMPLIFY_GEOM_TO_BBOX": True}, tables, spark)["TSS"].count()


def test_table_buffer_is_in_metres(spark, tables, tmp_path):
    given = BASE | {"STM": ["count"], "EXPORT_TABLE": True, "EXPORT_STM": True, "EXPORT_TABLE_REDUCER": "count", "EXPORT_DIRECTORY": str(tmp_path), "ROI": {"type": "Point", "coordinates": [13.05, 52.2]}, "DATATYPE": None}

    def pixels(metres, near):
        p = run_level3(run_level2(given | {"ROI": [12.9, 52.2, 13.4, 52.8]}, tables, spark)) | {"ROIS": parse_roi(given["ROI"]), "EXPORT_TABLE_BUFFER": metres}
        from pixelchron.plans.pipeline import _extracted

        assert sum(r["NDVI_count_count"] for r in _extracted(p, p["STM_IMAGE"], ["NDVI_count"]).collect()) == near

    # The smallest table has one row of pixels, 0.05 degrees or 3.4 km apart.
    pixels(None, 1)
    pixels(1000, 1)
    pixels(3500, 3)
    pixels(7000, 5)


def test_parameters_are_read_or_refused(spark, tables):
    from pathlib import Path

    import pixelchron

    code = "".join(f.read_text() for f in (Path(pixelchron.__file__).parent / "plans").glob("*.py")).split("PRODUCTS = ")[1]
    dynamic = {f"EXPORT_{k}" for k in ("TSS", "CIC", "TSM", "NVO", "TSI", "STM", "PBC", "LSP")}
    text = "".join(f.read_text() for f in (Path(pixelchron.__file__).parent / "plans").glob("*.py"))
    assert [k for k in DEFAULTS if k not in dynamic and f'"{k}"' not in code and text.count(f'"{k}"') < 2] == []
    for bad in ({"CRS_TRANSFORM": [1]}, {"IMG_DIMENSIONS": "1x1"}, {"RESAMPLING_METHOD": "bilinear"}, {"EXPORT_LOCATION": "Asset"}, {"EXPORT_TABLE_METHOD": "x"}, {"INTERVAL_UNIT": "week"}, {"STM_FOLDING_LIST_ITER": 3}, {"EXPORT_TABLE_TILE_SCALE": 0}):
        with pytest.raises(ValueError):
            run_param(BASE | bad, tables, spark)


def test_export_per_feature_computes_once(spark, tables, tmp_path):
    p = run_param(BASE | {"EXPORT_IMAGE": True, "EXPORT_TSS": True, "EXPORT_PER_FEATURE": True, "EXPORT_DIRECTORY": str(tmp_path)}, tables, spark)
    assert len(p["EXPORTED"]) == 2 and not [x for x in tmp_path.iterdir() if x.name.endswith("_staged")]
    assert {spark.read.parquet(x).count() for x in p["EXPORTED"].values()} == {p["TSS"].count()}


def test_region_tiles(spark, tables, tmp_path):
    box = lambda x: {"type": "Polygon", "coordinates": [[[x, 52.2], [x + 0.2, 52.2], [x + 0.2, 52.7], [x, 52.7], [x, 52.2]]]}
    file = tmp_path / "roi.geojson"
    file.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n}, "geometry": box(x)} for n, x in (("west", 12.9), ("east", 13.15))]}))
    given = BASE | {"ROI": str(file), "ROI_TILES": True, "ROI_TILES_ATTRIBUTE_COLUMN": "name", "NVO": True}
    got = run_param(given, tables, spark)
    assert set(got) == {"west", "east"}
    pixels = [got[k]["NVO_IMAGE"].select("px", "py") for k in got]
    assert pixels[0].intersect(pixels[1]).count() == 0 and pixels[0].count() > 0
    assert set(run_param(given | {"ROI_TILES_ATTRIBUTE_LIST": ["east"]}, tables, spark)) == {"east"}
    for bad in ({"ROI_TILES_ATTRIBUTE_LIST": ["north"]}, {"ROI_TILES_ATTRIBUTE_COLUMN": "none"}, {"ROI_TILES_ATTRIBUTE_COLUMN": None}):
        with pytest.raises(ValueError):
            run_param(given | bad, tables, spark)


def test_regions():
    assert parse_roi([1, 2])[0].box == (1, 2, 1, 2)
    assert parse_roi([0, 1, 2, 3])[0].rectangular and not parse_roi([[0, 0], [2, 0], [1, 1]])[0].rectangular
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    multi = {"type": "MultiPolygon", "coordinates": [square, [[[9, 9], [10, 9], [10, 10], [9, 9]]]]}
    assert [len(r.rings) for r in parse_roi({"type": "Polygon", "coordinates": square})] == [2] and [len(r.rings) for r in parse_roi(multi)] == [3]
    assert parse_roi(multi)[0].box == (0, 0, 10, 10)
    for bad in ([1, 2, 3], [], {"type": "LineString", "coordinates": []}):
        with pytest.raises(ValueError):
            parse_roi(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    landsat_table(spark, SF, "L8").write.parquet(str(tmp_path / "l8"))
    p = run_level2(BASE | {"ROI": [12.9, 52.2, 13.1, 52.4]}, {"L8": str(tmp_path / "l8")}, spark)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = p["TSS"].groupBy("px").agg(F.avg("NDVI"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(x" in pushed and "LessThanOrEqual(CLOUD_COVER_LAND" in pushed and "ST_B10" not in plan
