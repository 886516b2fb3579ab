"""Polygon columns: centre, extent and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(bbox: Column, axis: int) -> Column:
    total = F.aggregate(bbox, F.lit(0.0), lambda acc, p: acc + p[axis])
    return F.when(F.size(bbox) > 0, total / F.size(bbox))


def _extreme(bbox: Column, axis: int, pick) -> Column:
    return pick(F.transform(bbox, lambda p: p[axis]))


def box_geometry(bbox: Column) -> dict[str, Column]:
    """Centre, left and right edge and height of a polygon; null when it has no points."""
    return {
        "cx": _mean(bbox, 0),
        "cy": _mean(bbox, 1),
        "x0": _extreme(bbox, 0, F.array_min),
        "x1": _extreme(bbox, 0, F.array_max),
        "h": _extreme(bbox, 1, F.array_max) - _extreme(bbox, 1, F.array_min),
    }


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def nearest_in(points: str, x: str = "cx", y: str = "cy") -> Column:
    """Distance to the nearest of an array of points, infinite when there is none."""
    return F.expr(
        f"coalesce(array_min(transform({points}, p -> "
        f"sqrt(({x} - p.cx) * ({x} - p.cx) + ({y} - p.cy) * ({y} - p.cy)))), double('infinity'))")
