"""Tiles, zones, points, nearest blocks and terrain."""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reducers import reduce_bands

# Upper left corner in metres, columns and rows of continental 150 km grids in their own equal-area projections.
CONTINENT_GRIDS = {"AF": (-5312270.0, 3707205.0, 69, 58), "AN": (-3662210.0, 2654564.0, 50, 36), "AS": (-4805840.0, 5190735.0, 67, 62), "EU": (-5505560.0, 3346245.0, 61, 38), "NA": (-7633670.0, 5076465.0, 84, 62), "OC": (-6961010.0, 4078425.0, 90, 54), "SA": (-5918450.0, 3852105.0, 76, 65)}


def pixel_of(x: Column, y: Column, xmin: float, ymax: float, res: float) -> tuple[Column, Column]:
    """Column and row of a coordinate on a grid whose upper left corner is (xmin, ymax)."""
    return F.floor((x - xmin) / res).cast("int"), F.floor((ymax - y) / res).cast("int")


def grid_transform(xmin: float, ymin: float, xmax: float, ymax: float, res: float) -> tuple[list[float], str]:
    """Affine transform and WIDTHxHEIGHT of a bounding box."""
    return [res, 0, xmin, 0, -res, ymax], f"{math.ceil((xmax - xmin) / res)}x{math.ceil((ymax - ymin) / res)}"


def utm_zone(lon: float, lat: float) -> int:
    """EPSG code of the UTM zone of a point."""
    return (32600 if lat >= 0 else 32700) + min(60, int((lon + 180) // 6) + 1)


def utm_code(lon: Column, lat: Column) -> Column:
    """The same for columns."""
    return F.when(lat >= 0, 32600).otherwise(32700) + F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def tile_grid(spark: SparkSession, xmin: float, ymax: float, columns: int, rows: int, size: float, prefix: str = "", nested: tuple[int, ...] = ()) -> DataFrame:
    """One row per tile: ID (X000-Y000), X, Y, bounds, and for each nested size (km) the id of the larger tile it lies in. Made on the executors from a range."""
    cells = spark.range(columns * rows).select((F.col("id") % columns).cast("int").alias("X"), F.floor(F.col("id") / columns).cast("int").alias("Y"))

    def name(x: Column, y: Column, extra: str = "") -> Column:
        return F.format_string(f"{prefix}{extra}X%03d-Y%03d", x, y)

    out = cells.select(name(F.col("X"), F.col("Y")).alias("ID"), "X", "Y", (xmin + F.col("X") * size).alias("xmin"), (ymax - (F.col("Y") + 1) * size).alias("ymin"), (xmin + (F.col("X") + 1) * size).alias("xmax"), (ymax - F.col("Y") * size).alias("ymax"))
    for km in nested:
        n = int(km * 1000 / size)
        out = out.withColumn(f"ID{km}", name(F.floor(F.col("X") / n).cast("int"), F.floor(F.col("Y") / n).cast("int"), f"{km}_"))
    return out


def continent_tiles(spark: SparkSession, continent: str, size: float = 150_000) -> DataFrame:
    """The tiles of a continent's grid, or of all for "ALL", with ids of the 150, 300, 600 and 1200 km tiles round them."""
    if continent == "ALL":
        first, *rest = (continent_tiles(spark, c, size) for c in CONTINENT_GRIDS)
        for t in rest:
            first = first.unionByName(t)
        return first
    if continent not in CONTINENT_GRIDS:
        raise ValueError(f"unknown continent {continent}; known: {sorted(CONTINENT_GRIDS)}")
    x, y, columns, rows = CONTINENT_GRIDS[continent]
    per = 150_000 / size
    return tile_grid(spark, x, y, math.ceil(columns * per), math.ceil(rows * per), size, f"{continent}_", tuple(k for k in (150, 300, 600, 1200) if k * 1000 >= size)).withColumn("continent", F.lit(continent))


def _edges(ring: Column, per_edge) -> Column:
    """per_edge(p, q) of each vertex p of a ring, an array of structs x, y, and the next one."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: per_edge(p, F.get(ring, F.when(i == n - 1, 0).otherwise(i + 1))))


def _crossings(x: Column, y: Column, ring: Column) -> Column:
    def crosses(p: Column, q: Column) -> Column:
        return F.coalesce(((p["y"] > y) != (q["y"] > y)) & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"]), F.lit(False)).cast("int")

    return F.aggregate(_edges(ring, crosses), F.lit(0), lambda a, c: a + c)


def inside_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, an array of structs x, y (ray casting); an expression, so it stays on the JVM."""
    return _crossings(x, y, ring) % 2 == 1


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is inside a polygon of several rings: outer ones, holes and separate parts, by parity."""
    return F.aggregate(F.transform(rings, lambda r: _crossings(x, y, r)), F.lit(0), lambda a, c: a + c) % 2 == 1


def near_rings(x: Column, y: Column, rings: Column, reach_x: Column, reach_y: Column) -> Column:
    """Whether an edge of the rings is within reach of a point, where reach_x and reach_y are the same length along either axis."""

    def close(p: Column, q: Column) -> Column:
        ax, ay, bx, by = (p["x"] - x) / reach_x, (p["y"] - y) / reach_y, (q["x"] - p["x"]) / reach_x, (q["y"] - p["y"]) / reach_y
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-(ax * bx + ay * by), bx * bx + by * by))), F.lit(0.0))
        dx, dy = ax + t * bx, ay + t * by
        return dx * dx + dy * dy <= 1

    return F.exists(rings, lambda r: F.exists(_edges(r, close), lambda c: c))


def tiles_touching(tiles: DataFrame, boxes: DataFrame, size: float, xmin: float, ymax: float) -> DataFrame:
    """The tiles of a regular grid that a bounding box (xmin, ymin, xmax, ymax) touches: each box is exploded to the X, Y that it covers, then a semi join."""
    span = [F.floor((F.col("xmin") - xmin) / size), F.floor((F.col("xmax") - xmin) / size), F.floor((ymax - F.col("ymax")) / size), F.floor((ymax - F.col("ymin")) / size)]
    cells = boxes.select(F.explode(F.sequence(span[0].cast("int"), span[1].cast("int"))).alias("X"), span[2].cast("int").alias("_a"), span[3].cast("int").alias("_b"))
    cells = cells.select("X", F.explode(F.sequence("_a", "_b")).alias("Y")).distinct()
    return tiles.join(cells, ["X", "Y"], "left_semi")


def zonal(obs: DataFrame, features: DataFrame, bands: list[str], reducers: list[str], key: str = "fid", buffer: float = 0, block: float = 64, image: tuple[str, ...] = ("scene_id", "ts"), parts: int = 1) -> DataFrame:
    """Per feature and image <band>_<reducer> over the pixels whose place (px, py) lies in the feature, grown by buffer.

    features has key, xmin, ymin, xmax, ymax; with rings too (see roi.features_table) a feature is its polygons, else its box; a box without extent is a point. Columns
    buffer_x and buffer_y, where features has them, take the place of buffer: the same length in the units of either axis. To a point or polygon with a
    buffer belongs what is within that distance. Places without coordinates are in no feature.

    Both sides meet on blocks of side block, in the units of the coordinates: an equality join, whatever the features' sizes. A feature is sent to
    each block that it covers, parts times over; a block's pixels are dealt to the parts, which splits a block that holds very many.
    """
    reach = {a: F.col(f"buffer_{a}") if f"buffer_{a}" in features.columns else F.lit(float(buffer)) for a in "xy"}
    shaped = "rings" in features.columns
    grown = features.select(key, *((F.col(f"{a}{m}") + s * reach[a]).alias(f"_{a}{m}") for a in "xy" for m, s in (("min", -1), ("max", 1))), *(reach[a].alias(f"_r{a}") for a in "xy"), ((F.col("xmin") == F.col("xmax")) & (F.col("ymin") == F.col("ymax"))).alias("_point"), F.col("xmin").alias("_x"), F.col("ymin").alias("_y"), *([F.col("rings").alias("_rings")] if shaped else []))
    cells = grown.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("_xmin") / block), F.floor(F.col("_xmax") / block)))).withColumn("_by", F.explode(F.sequence(F.floor(F.col("_ymin") / block), F.floor(F.col("_ymax") / block))))
    on = ["_bx", "_by"]
    rows = obs.withColumns({"_bx": F.floor(F.col("px") / block), "_by": F.floor(F.col("py") / block)})
    if parts > 1:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("px", "py", *image), F.lit(parts)).cast("int"))
        cells, on = cells.withColumn("_part", F.explode(F.array(*map(F.lit, range(parts))))), [*on, "_part"]
    rows = rows.join(cells, on)
    rows = rows.filter(F.col("px").between(F.col("_xmin"), F.col("_xmax")) & F.col("py").between(F.col("_ymin"), F.col("_ymax")))
    dx, dy, some = (F.col("px") - F.col("_x")) / F.col("_rx"), (F.col("py") - F.col("_y")) / F.col("_ry"), (F.col("_rx") > 0) & (F.col("_ry") > 0)
    inside = F.when(F.col("_point"), F.coalesce(~some | (dx * dx + dy * dy <= 1), F.lit(True)))
    if shaped:
        at = (F.col("px").cast("double"), F.col("py").cast("double"), F.col("_rings"))
        inside = inside.otherwise(inside_rings(*at) | (some & F.coalesce(near_rings(*at, F.col("_rx"), F.col("_ry")), F.lit(False))))
    else:
        inside = inside.otherwise(F.lit(True))
    return reduce_bands(rows.filter(inside), [key, *image], bands, reducers)


def _written(df: DataFrame) -> DataFrame:
    """df, checkpointed where the session names a folder for that, else persisted: a loop's next round doesn't compute it again."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.DISK_ONLY)


# A cell of the nearest search is split further while it holds more distinct centres or more points than these; DEPTH halvings end it for those closer than doubles tell apart.
LEAF_CENTRES, LEAF_POINTS, DEPTH = 16, 2048, 40


def _candidates(points: DataFrame, centres: DataFrame, cell: float) -> DataFrame | None:
    """Points (_id, x, y) with _near, the centres (x, y, _c) of which one is the nearest; none without points or centres. See nearest."""
    if points.isEmpty() or centres.isEmpty():
        return None
    span = points.select("x", "y").unionByName(centres.select("x", "y")).agg(*(f(a) for a in "xy" for f in (F.min, F.max))).first()
    low, widest = {"x": span[0], "y": span[2]}, float(cell)
    reach = max(span[1] - span[0], span[3] - span[2])
    while widest <= reach:
        widest *= 2
    while widest > 4 * reach > 0:
        widest /= 2

    def place(a: str, level: int) -> Column:
        return F.floor((F.col(a) - low[a]) / (widest / 2**level))

    def cells(df: DataFrame, side: str, level: int) -> DataFrame:
        """Cells of a level, i and j, with the bounds and the number of what they hold."""
        bounds = (f(a).alias(f"{side}{a}{n}") for a in "xy" for n, f in enumerate((F.min, F.max)))
        return df.groupBy(place("x", level).alias(f"{side}i"), place("y", level).alias(f"{side}j")).agg(*bounds, F.count(F.lit(1)).alias(f"{side}n")).withColumn(f"{side}l", F.lit(level))

    def wide(side: str, most: int) -> Column:
        return (F.col(f"{side}n") > most) & ((F.col(f"{side}x0") < F.col(f"{side}x1")) | (F.col(f"{side}y0") < F.col(f"{side}y1")))

    def judged(pairs: DataFrame) -> DataFrame:
        """Pairs that can hold a nearest centre, and whether their point cell has to be split."""
        least = [F.greatest(F.lit(0.0), F.col(f"p{a}0") - F.col(f"c{a}1"), F.col(f"c{a}0") - F.col(f"p{a}1")) for a in "xy"]
        most = [F.greatest(F.col(f"p{a}1") - F.col(f"c{a}0"), F.col(f"c{a}1") - F.col(f"p{a}0")) for a in "xy"]
        own = Window.partitionBy("pi", "pj")
        pairs = pairs.withColumn("_most", F.min(most[0] * most[0] + most[1] * most[1]).over(own)).filter(least[0] * least[0] + least[1] * least[1] <= F.col("_most") * (1 + 1e-9)).drop("_most")
        return pairs.withColumn("cs", wide("c", LEAF_CENTRES)).withColumn("ps", F.max(F.col("cs") | wide("p", LEAF_POINTS)).over(own))

    ends, level = [], 0
    pairs = judged(cells(points, "p", 0).crossJoin(cells(centres, "c", 0)))
    while True:
        pairs = _written(pairs)
        split = pairs.filter("ps")
        if level == DEPTH or split.isEmpty():
            ends.append(pairs)
            break
        ends.append(pairs.filter("not ps"))
        level += 1
        inner, outer = cells(points, "p", level), cells(centres, "c", level)
        split = split.select(F.col("pi").alias("_pi"), F.col("pj").alias("_pj"), "cs", *(c for c in pairs.columns if c[0] == "c" and c != "cs"))
        split = split.join(inner, (F.shiftright("pi", 1) == F.col("_pi")) & (F.shiftright("pj", 1) == F.col("_pj"))).drop("_pi", "_pj")
        halves = split.filter("cs").select(F.col("ci").alias("_ci"), F.col("cj").alias("_cj"), *inner.columns)
        halves = halves.join(outer, (F.shiftright("ci", 1) == F.col("_ci")) & (F.shiftright("cj", 1) == F.col("_cj"))).drop("_ci", "_cj")
        pairs = judged(split.filter("not cs").drop("cs").unionByName(halves))
    left = reduce(DataFrame.unionByName, ends)

    def at_levels(df: DataFrame, side: str) -> DataFrame:
        """Rows with their cells of each level that has ends."""
        levels = sorted(r[0] for r in left.select(f"{side}l").distinct().collect())
        return df.withColumn("_o", F.explode(F.array(*(F.struct(F.lit(n).alias("l"), place("x", n).alias("i"), place("y", n).alias("j")) for n in levels)))).select(*df.columns, *(F.col(f"_o.{k}").alias(f"{side}{k}") for k in "lij"))

    near = left.select("pl", "pi", "pj", "cl", "ci", "cj").join(at_levels(centres, "c"), ["cl", "ci", "cj"]).groupBy("pl", "pi", "pj").agg(F.collect_list(F.struct("x", "y", "_c")).alias("_near"))
    return at_levels(points, "p").join(near, ["pl", "pi", "pj"]).select("_id", "x", "y", "_near")


def nearest(points: DataFrame, centres: DataFrame, point_key: str = "id", centre_key: str = "block", cell: float = 1.0) -> DataFrame:
    """For each point (x, y) the nearest centre (x, y) and the distance; of equals the smallest centre. Points and centres without both coordinates, or with infinite ones, take no part.

    Points and centres lie in cells of equal width, cell times a power of two. Beginning with one that holds all, a pair of cells is split on both
    sides while either holds many, and a pair goes as soon as another centre cell is sure to be nearer to all points of its cell, by the bounds of what the cells
    hold. So a point meets the few centres of the cells that are left, however many centres there are and however they crowd; centres at one place count once.
    """

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({a: F.col(a).cast("double") for a in "xy"}).filter((F.abs("x") < math.inf) & (F.abs("y") < math.inf))

    kind = centres.schema[centre_key].dataType
    points = _written(placed(points).select(F.col(point_key).alias("_id"), "x", "y"))
    centres = _written(placed(centres).groupBy("x", "y").agg(F.min(centre_key).alias("_c")))
    rows = _candidates(points, centres, cell)
    if rows is None:
        return points.limit(0).select(F.col("_id").alias(point_key), F.lit(None).cast(kind).alias(centre_key), F.lit(None).cast("double").alias("distance"))

    def reached(c: Column) -> Column:
        dx, dy = F.col("x") - c["x"], F.col("y") - c["y"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), c["_c"].alias("c"))

    found = rows.select("_id", F.array_min(F.transform("_near", reached)).alias("m"))
    return found.groupBy("_id").agg(F.min("m").alias("m")).select(F.col("_id").alias(point_key), F.col("m.c").alias(centre_key), F.col("m.d").alias("distance"))


def chunk_points(points: DataFrame, size: float = 10_000, least: int = 10) -> DataFrame:
    """Adds block to points (id, x, y): square blocks, those with fewer than least points joined to the nearest larger one. The merging loop runs over blocks, not points."""
    spark = points.sparkSession
    rows = points.withColumns({"_bx": F.floor(F.col("x") / size), "_by": F.floor(F.col("y") / size)})
    counts = rows.groupBy("_bx", "_by").count()
    big = counts.filter(F.col("count") >= least)
    names = F.format_string("B%d_%d", "_bx", "_by")
    small = counts.filter(F.col("count") < least)
    centre = {"x": (F.col("_bx") + 0.5) * size, "y": (F.col("_by") + 0.5) * size}
    moved = nearest(small.select(names.alias("id"), *(v.alias(k) for k, v in centre.items())), big.select(names.alias("block"), *(v.alias(k) for k, v in centre.items())), cell=size * 2) if not big.isEmpty() else spark.createDataFrame([], "id string, block string, distance double")
    return rows.withColumn("_own", names).join(moved.select(F.col("id").alias("_own"), F.col("block").alias("_to")), "_own", "left").withColumn("block", F.coalesce("_to", "_own")).drop("_own", "_to", "_bx", "_by")


def terrain(dem: DataFrame, pixel: float = 30, value: str = "value") -> DataFrame:
    """Adds slope and aspect (degrees), eastness and northness by Horn's 3 x 3 differences; NULL at the rim. Each pixel is spread to its eight neighbours and summed with weights: one shuffle."""
    weights = [(dx, dy, w) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0) for w in [2 if 0 in (dx, dy) else 1]]
    kernel = F.array(*(F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(float(dx * w)).alias("gx"), F.lit(float(dy * w)).alias("gy")) for dx, dy, w in weights))
    spread = dem.filter(F.col(value).isNotNull()).select("px", "py", value, F.explode(kernel).alias("_o"))
    spread = spread.groupBy((F.col("px") + F.col("_o.dx")).alias("px"), (F.col("py") + F.col("_o.dy")).alias("py")).agg(F.sum(F.col(value) * F.col("_o.gx")).alias("_gx"), F.sum(F.col(value) * F.col("_o.gy")).alias("_gy"), F.count(F.lit(1)).alias("_n"))
    gx, gy = F.col("_gx") / (8.0 * pixel), F.col("_gy") / (8.0 * pixel)
    out = dem.join(spread.filter("_n = 8"), ["px", "py"], "left")
    aspect = F.pmod(F.degrees(F.atan2(-gx, gy)) + 360, F.lit(360.0))
    out = out.withColumns({"slope": F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))), "aspect": F.when(gx.isNotNull(), aspect)})
    return out.withColumns({"eastness": F.sin(F.radians("aspect")), "northness": F.cos(F.radians("aspect"))}).drop("_gx", "_gy", "_n")


def overview(df: DataFrame, bands: list[str], factor: int) -> DataFrame:
    """Means over factor x factor pixels."""
    return df.groupBy(F.floor(F.col("px") / factor).alias("px"), F.floor(F.col("py") / factor).alias("py")).agg(*(F.avg(b).alias(b) for b in bands))


# Targets that one task of a resampling sums on average, and the side of the blocks of targets that are dealt to tasks.
TASK_TARGETS, BLOCK = 500_000, 128


def resample(df: DataFrame, bands: list[str], factor: float, method: str = "bilinear") -> DataFrame:
    """Values on a grid factor times finer, at pixel centres; bilinear or bicubic weights of what is there, renormalised at the rim.

    Each source pixel is sent to the blocks of targets it weighs on, then spread to the targets, and sums are taken in the block's task: one shuffle of source pixels.
    Blocks are dealt to as many tasks as the number of pixels asks for (counted in the pass that finds the rim), so a task's sums stay as many however large the image is.
    """
    radius = {"bilinear": 1, "bicubic": 2}[method]

    def weight(d: Column) -> Column:
        t = F.abs(d)
        if method == "bilinear":
            return F.greatest(1 - t, F.lit(0.0))
        return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(0.0)

    n, *last = df.agg(F.count(F.lit(1)), F.max("px"), F.max("py")).first()
    tasks = max(1, math.ceil(n * factor * factor / TASK_TARGETS))
    rows = df.select("px", "py", *bands)
    for a, most in zip("xy", last, strict=True):
        middle = (F.col(f"p{a}") + 0.5) * factor - 0.5
        end = math.ceil((most + 1) * factor) - 1 if most is not None else -1
        rows = rows.withColumns({f"_a{a}": F.greatest(F.ceil(middle - radius * factor).cast("int"), F.lit(0)), f"_z{a}": F.least(F.floor(middle + radius * factor).cast("int"), F.lit(end))}).filter(F.col(f"_a{a}") <= F.col(f"_z{a}"))
    for a in "xy":
        rows = rows.withColumn(f"_b{a}", F.explode(F.sequence(F.floor(F.col(f"_a{a}") / BLOCK).cast("int"), F.floor(F.col(f"_z{a}") / BLOCK).cast("int"))))
    rows = rows.repartition(tasks, "_bx", "_by")
    for a in "xy":
        rows = rows.withColumn(f"_t{a}", F.explode(F.sequence(F.greatest(F.col(f"_a{a}"), F.col(f"_b{a}") * BLOCK), F.least(F.col(f"_z{a}"), F.col(f"_b{a}") * BLOCK + BLOCK - 1))))
    w = weight((F.col("_tx") + 0.5) / factor - 0.5 - F.col("px")) * weight((F.col("_ty") + 0.5) / factor - 0.5 - F.col("py"))
    rows = rows.withColumn("_w", w).filter("_w <> 0")
    out = rows.groupBy("_bx", "_by", "_tx", "_ty").agg(*(F.try_divide(F.sum(F.col(b) * F.col("_w")), F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))).alias(b) for b in bands))
    return out.select(F.col("_tx").alias("px"), F.col("_ty").alias("py"), *bands)
