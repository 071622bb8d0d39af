"""Small hand-made cases for operators, many of them from first principles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelchron.functions import indices
from pixelchron.functions.reducers import reduce_bands, round_half_away, split_name
from pixelchron.operators import composite, export, interpolation, masking, model, phenology, series, spatial
from pixelchron.operators.unmix import best_subset, non_negative_fractions, unmix
from pixelchron.schema import MS_DAY


def series_of(spark, values, days, px=0):
    rows = [(px, 0, f"s{i}", d * MS_DAY, v) for i, (v, d) in enumerate(zip(values, days, strict=True))]
    return spark.createDataFrame(rows, "px int, py int, scene_id string, t long, v double").withColumn("ts", F.timestamp_millis("t"))


def test_landsat_mask_words(spark):
    words = {0: 1, 1: 0, 2: 0, 4: 1, 8: 0, 16: 0, 32: 0, 1 << 8: 1, 2 << 8: 0, 3 << 8: 0, 1 << 14: 1, 2 << 14: 0, 3 << 14: 0}
    bands = ("BLU", "GRN", "RED", "NIR", "SW1", "SW2")
    df = spark.createDataFrame([(w, 0, *[0.1] * 6) for w in words], "QA_PIXEL int, QA_RADSAT int, " + ", ".join(f"{b} double" for b in bands))
    got = masking.apply_mask(df, ["NIR"], masking.landsat_valid(["cloud", "cshadow", "snow", "fill", "dilated"]))
    assert {r["QA_PIXEL"]: r["mask"] for r in got.collect()} == words
    assert got.filter("mask = 0 and NIR is not null").count() == 0
    high = masking.apply_mask(df, ["NIR"], masking.landsat_valid(["cloud"], "High"))
    assert {r["QA_PIXEL"]: r["mask"] for r in high.collect()}[2 << 8] == 1


def test_erode_dilate_and_distance(spark):
    cells = [("s", x, y, 0 if (x, y) == (2, 2) else 1) for x in range(5) for y in range(5)]
    df = spark.createDataFrame(cells, "scene_id string, px int, py int, mask int")
    assert masking.focal(df, 1, "max").filter("mask = 0").count() == 0
    grown = {(r["px"], r["py"]) for r in masking.focal(df, 1, "min").filter("mask = 0").collect()}
    assert grown == {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)}
    d = {(r["px"], r["py"]): r["distance"] for r in masking.cloud_distance(df, 2, 1).collect()}
    assert d[2, 2] == 0 and d[2, 3] == 1 and d[3, 3] == pytest.approx(math.sqrt(2)) and d[0, 2] == 2 and d[0, 0] is None


def test_interpolation_of_a_constant_and_a_single_observation(spark):
    flat = interpolation.rbf(series_of(spark, [0.5] * 20, range(0, 100, 5)), ["v"], (4, 16), (8, 32), 10)
    assert all(r["v"] == pytest.approx(0.5) for r in flat.collect()) and flat.count() == 10
    one = interpolation.rbf(series_of(spark, [0.7], [50]), ["v"], (4,), (8,), 10, bounds=(0, 100 * MS_DAY))
    assert {r["k"]: round(r["v"], 9) for r in one.collect()} == {5: 0.7}


def test_linear_midpoint(spark):
    got = interpolation.linear(series_of(spark, [1.0, 3.0], [0, 10]), ["v"], 5, 10)
    assert {r["k"]: r["v"] for r in got.collect()} == {0: 1.0, 1: 2.0, 2: 3.0}


def test_long_table_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(5)
    days = np.sort(rng.choice(200, 40, replace=False))
    v = rng.random(40)
    got = {r["k"]: r["v"] for r in interpolation.rbf_frame(series_of(spark, v.tolist(), days.tolist()), "px", ["v"], "3RBF", 7, (4, 9, 20), (5, 12, 30)).collect()}
    grid = days[0] + np.arange(0, math.ceil((days[-1] - days[0]) / 7) + 1) * 7
    assert sorted(got) == list(range(len(grid)))
    for k, g in enumerate(grid):
        values, counts = [], []
        for s, w in ((4, 5), (9, 12), (20, 30)):
            near = np.abs(days - g) <= w
            wt = np.exp(-0.5 * ((days - g) / s) ** 2) * near
            values.append((wt * v).sum() / wt.sum() if near.any() else np.nan)
            counts.append(near.sum())
        c1 = min(counts[0] / 4, 1)
        c2 = min(counts[1] / 8, 1) * (1 - c1)
        c = np.where(np.isnan(values), 0, [c1, c2, 1 - c1 - c2])
        want = np.nansum(c * np.nan_to_num(values)) / c.sum() if c.sum() > 0 else None
        assert got[k] == (pytest.approx(want) if want is not None else None)


def cosine(spark, peak):
    days = list(range(0, 1460, 8))
    return series_of(spark, [0.5 + 0.4 * math.cos(2 * math.pi * (d % 365.25 - peak) / 365.25) for d in days], days)


@pytest.mark.parametrize(("peak", "theta", "first"), [(200, 17, 1), (20, 202, 0)])
def test_phenology_of_a_cosine(spark, peak, theta, first):
    (r,) = phenology.polar_vector(cosine(spark, peak), "v", ["px"]).collect()
    assert abs(r["RAVG"] - peak) <= 2 and abs(r["THETA"] - theta) <= 2
    got = phenology.phenology(cosine(spark, peak), "v", (1971, 1972)).collect()
    assert {x["valid_firstyear"] for x in got} == {first}
    for x in got:
        assert x["t_end"] - x["t_start"] in (365, 366) and None not in (x["SOS"], x["MOS"], x["EOS"])


def test_season_without_values_gives_nulls(spark):
    df = cosine(spark, 200).unionByName(series_of(spark, [0.5], [400], px=1))
    got = {(r["px"], r["year"]): r["MOS"] for r in phenology.phenology(df, "v", (1970, 1973)).collect()}
    assert got[1, 1971] is not None and (1, 1973) not in got


def test_mosaic_fills_bands_from_both_scenes(spark):
    df = spark.createDataFrame([(0, 0, "a", "2020-01-01 09:00:00", 1.0, None), (0, 0, "b", "2020-01-01 10:00:00", None, 2.0), (0, 0, "c", "2020-01-02 10:00:00", 3.0, 4.0)], "px int, py int, scene_id string, ts string, A double, B double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r["scene_id"], r["A"], r["B"]) for r in series.daily_mosaic(df, ["A", "B"]).orderBy("day").collect()]
    assert got == [("20200101", 1.0, 2.0), ("20200102", 3.0, 4.0)]
    assert series.valid_observations(df, ["A", "B"]).first()["NVO"] == 1


def test_composite_ties_go_to_the_earliest(spark):
    df = series_of(spark, [0.9, 0.9, 0.1], [5, 3, 1])
    assert composite.composite_feature(df, "v", ["v"]).first()["scene_id"] == "s1"
    assert composite.composite_feature(df, "v", ["v"], invert=True).first()["scene_id"] == "s2"


def test_year_scores(spark):
    rows = [(g, 2) for g in range(4)] + [(1, 0), (0, 0)]
    df = spark.createDataFrame(rows, "g int, year_offset int").selectExpr("make_timestamp(2000 + g, 7, 1, 0, 0, 0) ts", "g", "2000 year_center", "year_offset", "182 doy_center", "30 doy_offset", "1 mask", "cast(null as double) distance")
    got = {(r["g"], r["year_offset"]): (r["YEAR_SCORE"], r["CLOUD_SCORE"]) for r in composite.bap_scores(df, equal_year=10).collect()}
    d1 = math.exp(-0.5)
    assert got[0, 2] == (1, 1) and got[1, 2][0] == pytest.approx(d1) and got[2, 2][0] == 0 and got[3, 2][0] == 0 and got[1, 0][0] == 0 and got[0, 0][0] == 1


def test_reducers_reject_and_split():
    with pytest.raises(ValueError):
        reduce_bands(None, [], [], ["p42"])
    assert split_name("NDVI_p50") == ("NDVI", "p50") and split_name("x") is None


def test_percentiles_are_ordered(spark):
    r = series.temporal_metrics(series_of(spark, np.random.default_rng(0).random(50).tolist(), range(50)), ["v"], ["min", "p5", "p25", "p50", "p75", "p95", "max"]).first()
    values = [r[f"v_{x}"] for x in ("min", "p5", "p25", "p50", "p75", "p95", "max")]
    assert values == sorted(values)


def test_formula_language(spark):
    df = spark.createDataFrame([(2.0, 0.0)], "A double, B double")
    got = df.select(indices.formula("a**2 - -a/4 + max(a, b)", {"a": "A", "b": "B"}).alias("x"), indices.formula("a/b", {"a": "A", "b": "B"}).alias("y")).first()
    assert got["x"] == 6.5 and got["y"] is None
    for bad in ("a; drop", "c + 1", "__import__('os')"):
        with pytest.raises(ValueError):
            indices.formula(bad, {"a": "A"})
    with pytest.raises(ValueError):
        indices.add_features(df, ["NOPE"])


def test_export_types_and_rows(spark):
    df = spark.createDataFrame([(1.2,), (None,), (9.9,)], "v double")
    assert [r["v"] for r in export.scale_and_cast(df, ["v"], 100, "uint8", 255).collect()] == [120, 255, 255]
    with pytest.raises(ValueError):
        export.scale_and_cast(df, ["v"], 1, "int7")
    assert export.complete_rows(df, ["v"]).count() == 2


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, "20200101", 0.5), (0, 1, "20200101", None)], "px int, py int, date string, v double")
    export.export_image(df, str(tmp_path / "image"), ["v"], scale=10, dtype="int16", nodata=-99, partition=["date"], bandnames_csv=True)
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "image")).collect()) == [-99, 5]
    from pixelchron.sources.scans import read_band_names, read_series_csv

    assert read_band_names(spark, str(tmp_path / "image_bandnames")) == ["v"]
    (tmp_path / "s.csv").write_text("id,YYYYMMDD,NIR\n1,20200105,5\n1,oops,6\n2,20200106,-9999\n")
    assert [(r["id"], r["NIR"]) for r in read_series_csv(spark, str(tmp_path / "s.csv"), ["NIR"]).orderBy("id").collect()] == [("1", 5.0), ("2", None)]


def test_unmixing(spark):
    rng = np.random.default_rng(2)
    e = rng.random((6, 4))
    x = rng.random((50, 6))
    for one in (True, False):
        slow = np.array([non_negative_fractions(e, row, one) for row in x])
        assert np.abs(best_subset(e, x, one) - slow).max() < 1e-4
    bands = [f"b{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:5]] + [(None, *map(float, x[0][1:]))], ", ".join(f"{b} double" for b in bands))
    got = unmix(df, bands, {f"c{k}": e[:, k].tolist() for k in range(4)}, True, True, True).collect()
    assert sum(r["c0"] is None for r in got) == 1
    assert all(sum(r) == pytest.approx(1) for r in got if r["c0"] is not None)


def test_polygon_and_terrain(spark):
    ring = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))))
    df = spark.createDataFrame([(1.0, 1.0, True), (2.0, 3.0, False), (3.9, 3.0, True), (5.0, 1.0, False)], "x double, y double, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", spatial.inside_polygon(F.col("x"), F.col("y"), ring)).collect())
    plane = spark.createDataFrame([(x, y, 30.0 * x) for x in range(4) for y in range(4)], "px int, py int, value double")
    got = {(r["px"], r["py"]): r["slope"] for r in spatial.terrain(plane, 30).collect()}
    assert got[1, 1] == pytest.approx(45) and got[0, 0] is None


def test_zones_and_nearest_edge_cases(spark):
    assert spatial.utm_zone(13.4, 52.5) == 32633 and spatial.utm_zone(-70, -33) == 32719
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 500.0)], "id long, x double, y double")
    centres = spark.createDataFrame([(7, 3.0, 4.0), (8, 3.0, -4.0)], "block long, x double, y double")
    assert sorted((r["id"], r["block"]) for r in spatial.nearest(points, centres).collect()) == [(1, 7), (2, 7)]
    assert spatial.nearest(points, centres.limit(0)).count() == 0


def test_rules_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), int(a > 0.5) + int(b > 0.5)) for a, b in rng.random((200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    forest = model.train(df, ["a", "b"], "y", numTrees=5, maxDepth=4, seed=1)
    rules = model.rules_from_table(model.rules_table(spark, model.ensemble_rules(forest, ["a", "b"])))
    got = model.classify(df, rules)
    assert got.filter("class = y").count() > 190
    assert model.accuracy(got.withColumn("class", F.col("class").cast("double")), "y", "class")["balanced"] > 0.9
    tree = model.train(df, ["a", "b"], "y", "dt", "regressor", maxDepth=4)
    mine = model.classify(df, model.ensemble_rules(tree, ["a", "b"]), task="regressor")
    theirs = tree.transform(model.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(mine))
    assert theirs.filter("abs(class - prediction) > 1e-9").count() == 0
    assert model.select_features(df.withColumn("c", F.lit(1.0)), ["a", "b", "c"], "y", 2, numTrees=3) in (["a", "b"], ["b", "a"])
    assert model.drop_correlated(df.withColumn("c", F.col("a") * 2), ["a", "b", "c"]) == ["b", "c"]


def test_nearest_ends_on_missing_coordinates(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 900.0, 5.0)], "id int, x double, y double")
    centres = spark.createDataFrame([("a", 1.0, 0.0), ("b", 800.0, 0.0), ("c", None, None)], "block string, x double, y double")
    assert sorted((r["id"], r["block"]) for r in spatial.nearest(points, centres).collect()) == [(1, "a"), (4, "b")]
    assert spatial.nearest(points, centres.limit(0)).count() == 0
    assert spatial.nearest(points.filter("id = 2"), centres).count() == 0


def test_zonal_with_buffers_equals_plain(spark):
    import math

    from pixelchron.sources import roi

    rings = {"tri": [[(2.3, 2.1), (7.7, 3.2), (4.1, 8.6)]], "hole": [[(0.2, 0.2), (9.6, 0.3), (9.4, 9.7), (0.1, 9.5)], [(3.2, 3.1), (7.1, 3.3), (6.8, 7.2), (3.4, 6.9)]]}

    def parity(x, y, ring):
        return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:] + ring[:1]))

    def distance(x, y, ring):
        out = []
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            out.append(math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y))
        return min(out)

    grid = [(x, y) for x in range(-3, 14) for y in range(-3, 14)]
    df = spark.createDataFrame([(x, y, 1.0, "s") for x, y in grid], "px int, py int, v double, scene_id string")
    features = roi.features_table(spark, [roi.Roi(tuple(map(tuple, r)), {"fid": n}) for n, r in rings.items()])
    for buffer in (0, 1.3):
        want = {n: sum(sum(parity(x, y, ring) for ring in r) % 2 == 1 or buffer > 0 and min(distance(x, y, ring) for ring in r) <= buffer for x, y in grid) for n, r in rings.items()}
        got = spatial.zonal(df, features, ["v"], ["count"], buffer=buffer, block=4, image=("scene_id",), parts=3)
        assert {r["fid"]: r["v_count"] for r in got.collect()} == want


def test_phenology_reads_its_source_once(spark):
    from pixelchron.operators import phenology
    from pixelchron.sources.tables import event_series

    for adjust in (False, True):
        out = phenology.phenology(event_series(spark, "/root/testdata/sf0.001"), "NDVI", (2023, 2024), adjust=adjust)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_correlation_by_moments(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, (300, 3))
    rows = [tuple(None if rng.random() < 0.2 else float(v) for v in r) + (5.0,) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double").repartition(3)
    few = {(r["a"], r["b"]): r["corr"] for r in model.correlation(df, ["a", "b", "c"]).collect()}
    many = {(r["a"], r["b"]): r["corr"] for r in model.correlation(df, ["a", "b", "c", "same"], most_pairs=0).collect()}
    assert len(many) == 6 and all(many[p] is None for p in many if "same" in p)
    assert few == pytest.approx({p: c for p, c in many.items() if "same" not in p}, abs=1e-9)
    assert all(r["corr"] is None for r in model.correlation(df.limit(0), ["a", "b"], most_pairs=0).collect())


def test_cross_validated_elimination(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(a > 0.5)) for a, b, c in rng.random((120, 3))], "a double, b double, c double, y int")
    kept, scores = model.select_features_cv(df, ["a", "b", "c"], "y", folds=2, kind="dt", maxDepth=3)
    assert kept == ["a"] and sorted(scores) == [1, 2, 3] and scores[1] > 0.9


@pytest.mark.parametrize("kernels", [1, 2, 3])
def test_array_kernels_equal_long_form(spark, kernels):
    days, values = [0, 3, 9, 21, 40], [0.2, None, 0.5, 0.9, -9999.0]
    sigmas, windows = (4.0, 8.0, 16.0)[:kernels], (5.0, 10.0, 20.0)[:kernels]
    row = spark.createDataFrame([(1, values, days)], "g int, v array<double>, d array<int>")
    got = interpolation.rbf_arrays(row, "v", "d", [0, 10, 20, 30, 70], sigmas, windows, 2, 3, nodata=-9999.0).first()["rbf"]
    seen = [(d, v) for d, v in zip(days, values, strict=True) if v not in (None, -9999.0)]

    def plain(t):
        out = []
        for s, w in zip(sigmas, windows, strict=True):
            near = [(np.exp(-0.5 * ((d - t) / s) ** 2), v) for d, v in seen if abs(d - t) <= w]
            out.append((sum(g * v for g, v in near) / sum(g for g, _ in near) if near else None, len(near)))
        first = min(out[0][1] / 2, 1)
        second = min(out[1][1] / 3, 1) * (1 - first) if kernels == 3 else 0
        weights = {1: [1], 2: [first, 1 - first], 3: [first, second, 1 - first - second]}[kernels]
        total = sum(w for w, (v, _) in zip(weights, out, strict=True) if v is not None)
        return sum(w * v for w, (v, _) in zip(weights, out, strict=True) if v is not None) / total if total else -9999.0

    assert got == pytest.approx([plain(t) for t in (0, 10, 20, 30, 70)])


def test_nlcd_ties_go_to_the_earliest(spark):
    """Two observations are as far from their median; the last bits of the differences favour the later one, as (0.45 - 0.475) ** 2 < (0.5 - 0.475) ** 2."""
    rows = [(0, 0, i, t, 0.1, 0.1, 0.1, nir, 0.1, 0.1) for i, t, nir in (("early", "2020-01-01", 0.5), ("late", "2020-01-02", 0.45))]
    df = spark.createDataFrame(rows, "px int, py int, scene_id string, ts string, BLU double, GRN double, RED double, NIR double, SW1 double, SW2 double").withColumn("ts", F.to_timestamp("ts"))
    got = composite.composite_nlcd(df, ["NIR"]).collect()
    assert [(r["scene_id"], r["SCORE"]) for r in got] == [("early", -0.000625)]


def test_rounding_as_sql_does(spark):
    import duckdb

    values = [8318.8703555, 8396.8484445, -8318.8703555, 0.5, 2.5, 1e-7, None]
    got = [r["r"] for r in spark.createDataFrame([(v,) for v in values], "x double").select(round_half_away(F.col("x"), 6).alias("r")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_nearest_of_crowded_centres_meets_few(spark):
    """Centres crowd in a millionth of the area, others share a place: results are those of all pairs, though no point meets more than a small part of them."""
    rng = np.random.default_rng(4)
    places = np.concatenate([rng.random((300, 2)) * 1000, 500 + rng.random((300, 2)), np.repeat(rng.random((3, 2)) * 1000, 100, axis=0)])
    asked = np.concatenate([rng.random((200, 2)) * 1000, 500 + rng.random((200, 2)), [[499.0, 1e6]]])
    centres = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "_c long, x double, y double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asked)], "_id long, x double, y double")
    all_pairs = np.hypot(asked[:, None, 0] - places[None, :, 0], asked[:, None, 1] - places[None, :, 1])
    got = {r["id"]: (r["block"], r["distance"]) for r in spatial.nearest(points.withColumnRenamed("_id", "id"), centres.withColumnRenamed("_c", "block"), cell=40.0).collect()}
    assert {i: b for i, (b, _) in got.items()} == dict(enumerate(all_pairs.argmin(axis=1)))
    assert [got[i][1] for i in range(len(asked))] == pytest.approx(list(all_pairs.min(axis=1)))
    met = spatial._candidates(points.repartition(2), centres.dropDuplicates(["x", "y"]), 40.0).agg(F.count("_id"), F.max(F.size("_near")), F.avg(F.size("_near"))).first()
    assert met[0] == len(asked) and met[1] < 300 and met[2] < 90


@pytest.mark.parametrize("factor", [2, 1.5, 0.4])
def test_resample_sums_in_the_task_of_a_block(spark, monkeypatch, factor):
    """Over several blocks, with holes, values equal plain ones; only source pixels cross the shuffle, to more tasks where there are more pixels."""
    monkeypatch.setattr(spatial, "BLOCK", 8)
    monkeypatch.setattr(spatial, "TASK_TARGETS", 40)
    cells = [(x, y, None if (x, y) == (4, 4) else float((x * 7 + y * 3) % 11)) for x in range(13) for y in range(9) if (x + y) % 5]
    out = spatial.resample(spark.createDataFrame(cells, "px int, py int, value double"), ["value"], factor, "bicubic")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert out.rdd.getNumPartitions() == math.ceil(len(cells) * factor * factor / 40)

    def weight(d):
        t = abs(d)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0

    want = {}
    for tx in range(math.ceil(13 * factor)):
        for ty in range(math.ceil(9 * factor)):
            ws = [(weight((tx + 0.5) / factor - 0.5 - x) * weight((ty + 0.5) / factor - 0.5 - y), v) for x, y, v in cells]
            if any(w for w, _ in ws):
                total = sum(w for w, v in ws if v is not None)
                want[tx, ty] = sum(w * v for w, v in ws if v is not None) / total if total else None
    got = {(r["px"], r["py"]): r["value"] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_resample_of_nothing(spark):
    assert spatial.resample(spark.createDataFrame([], "px int, py int, value double"), ["value"], 2).count() == 0
