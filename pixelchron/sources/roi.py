"""Regions of interest: points, boxes, polygons and GeoJSON features, parsed on the driver and applied as predicates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import inside_rings

Ring = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Roi:
    """One feature: the rings of all its polygons, outer ones and holes alike (a point is a ring of one vertex), and attributes.

    A place is inside if it is inside an odd number of rings, which is right for holes and for separate parts.
    """

    rings: tuple[Ring, ...]
    attributes: dict = field(default_factory=dict, hash=False)

    @property
    def box(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(p for r in self.rings for p in r), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def rectangular(self) -> bool:
        x0, y0, x1, y1 = self.box
        return len(self.rings) == 1 and (len(self.rings[0]) < 3 or set(self.rings[0]) == {(x0, y0), (x0, y1), (x1, y0), (x1, y1)})

    def holds(self, x: Column, y: Column, box_only: bool = True) -> Column:
        """Whether a coordinate is inside; the box goes first, as a range predicate that a scan can use."""
        x0, y0, x1, y1 = self.box
        inside = x.between(x0, x1) & y.between(y0, y1)
        if box_only or self.rectangular:
            return inside
        rings = F.array(*(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring)) for ring in self.rings))
        return inside & inside_rings(x, y, rings)


def _box_ring(x0: float, y0: float, x1: float, y1: float) -> Ring:
    return ((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def _ring(points: list) -> Ring:
    ring = tuple((float(p[0]), float(p[1])) for p in points)
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def _geometry(g: dict) -> list[tuple[Ring, ...]]:
    """The rings of each feature that a geometry makes: points one each, polygons of several parts one for all."""
    kind, c = g["type"], g.get("coordinates")
    if kind == "Point":
        return [(_ring([c]),)]
    if kind == "MultiPoint":
        return [(_ring([p]),) for p in c]
    if kind == "Polygon":
        return [tuple(map(_ring, c))]
    if kind == "MultiPolygon":
        return [tuple(_ring(r) for p in c for r in p)]
    if kind == "GeometryCollection":
        return [r for x in g["geometries"] for r in _geometry(x)]
    raise ValueError(f"unsupported geometry {kind}")


def parse_roi(value: object) -> list[Roi]:
    """Features from [lon, lat], [lon, lat, lon, lat], [[lon, lat], ...], a GeoJSON object or the path of a GeoJSON file. Polygons keep their holes, and one of several parts is one feature."""
    if isinstance(value, Roi):
        return [value]
    if isinstance(value, (str, Path)):
        value = json.loads(Path(value).read_text())
    if isinstance(value, dict):
        if value.get("type") == "FeatureCollection":
            return [r for f in value["features"] for r in parse_roi(f)]
        if value.get("type") == "Feature":
            return [Roi(r, value.get("properties") or {}) for r in _geometry(value["geometry"])]
        return [Roi(r) for r in _geometry(value)]
    items = list(value)  # type: ignore[call-overload]
    if items and all(isinstance(x, Roi) for x in items):
        return items
    if items and all(isinstance(x, (int, float)) for x in items) and len(items) in (2, 4):
        return [Roi((_ring([items]) if len(items) == 2 else _box_ring(*map(float, items)),))]
    if len(items) >= 3 and all(isinstance(x, (list, tuple)) and len(x) == 2 for x in items):
        return [Roi((_ring(items),))]
    raise ValueError("a region is [lon, lat], [lon, lat, lon, lat], a polygon's vertices or GeoJSON")


def bounds(rois: list[Roi]) -> tuple[float, float, float, float]:
    """The box round all features."""
    boxes = [r.box for r in rois]
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def in_region(df: DataFrame, rois: list[Roi], box_only: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside any of the features; the box of all goes to the scan."""
    x0, y0, x1, y1 = bounds(rois)
    df = df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    if len(rois) == 1 and (box_only or rois[0].rectangular):
        return df
    test = F.lit(False)
    for r in rois:
        test = test | r.holds(F.col(x), F.col(y), box_only)
    return df.filter(test)


def select_features(rois: list[Roi], column: str, values: list | None = None) -> list[Roi]:
    """Features with an attribute, and one of values if given; none is an error."""
    if not any(r.attributes.get(column) is not None for r in rois):
        raise ValueError(f"attribute {column} has only null values")
    found = [r for r in rois if values is None or r.attributes.get(column) in values]
    if not found:
        raise ValueError("the attribute list matches no feature")
    return found


def features_where(features: DataFrame, *, within: dict[str, list] | None = None, without: dict[str, list] | None = None, either: list[dict[str, list]] | None = None) -> DataFrame:
    """Rows of a table of features by their attributes: within a list of values, without values (NULL isn't one), and either of several conditions of the first kind."""

    def all_of(conditions: dict[str, list]) -> Column:
        test = F.lit(True)
        for c, values in conditions.items():
            test = test & F.col(c).isin(values)
        return test

    out = features.filter(all_of(within or {}))
    for c, values in (without or {}).items():
        out = out.filter(F.coalesce(~F.col(c).isin(values), F.lit(True)))
    if either:
        test = F.lit(False)
        for conditions in either:
            test = test | all_of(conditions)
        out = out.filter(test)
    return out


def features_table(spark: SparkSession, rois: list[Roi], key: str = "fid") -> DataFrame:
    """key, box, rings and attributes (map of strings) of features; a list as long as the user's vector file."""
    rows = [(str(r.attributes.get(key, i)), *map(float, r.box), [[{"x": float(a), "y": float(b)} for a, b in ring] for ring in r.rings], {k: None if v is None else str(v) for k, v in r.attributes.items()}) for i, r in enumerate(rois)]
    return spark.createDataFrame(rows, f"{key} string, xmin double, ymin double, xmax double, ymax double, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>")
