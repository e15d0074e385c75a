"""Planar and spherical geometry as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: mean Earth radius in metres.
EARTH_RADIUS = 6_371_000.0
Ring = Sequence[Sequence[float]]


def planar(x: Column, y: Column, px: float, py: float) -> Column:
    """Euclidean distance to (px, py)."""
    return F.sqrt((x - F.lit(px)) * (x - F.lit(px)) + (y - F.lit(py)) * (y - F.lit(py)))


def haversine(lon: Column, lat: Column, plon: float, plat: float) -> Column:
    """Great-circle distance in metres to (plon, plat)."""
    dlat, dlon = F.radians(F.lit(plat) - lat) / 2, F.radians(F.lit(plon) - lon) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(plat))) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def _in_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Even-odd rule with half-open edges; a ring of fewer than three points holds nothing."""
    inside = F.lit(False)
    if len(ring) < 3:
        return inside
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
        if ay != by:  # a level edge crosses no ray
            crosses = (F.lit(ay) > y) != (F.lit(by) > y)
            inside = inside != (crosses & (x < F.lit(float(bx - ax)) * (y - F.lit(float(ay))) / F.lit(float(by - ay)) + F.lit(float(ax))))
    return inside


def in_polygon(x: Column, y: Column, rings: Sequence[Ring]) -> Column:
    """Inside the first ring and in none of the others; the bounding box comes first so that it can be pushed down."""
    outer, *holes = rings
    xs, ys = [p[0] for p in outer], [p[1] for p in outer]
    if not xs:
        return F.lit(False)
    box = x.between(float(min(xs)), float(max(xs))) & y.between(float(min(ys)), float(max(ys)))
    inside = box & _in_ring(x, y, outer)
    for hole in holes:
        inside = inside & ~_in_ring(x, y, hole)
    return inside


def in_box(x: Column, y: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    """Inside a box, its edges included."""
    return x.between(float(low[0]), float(high[0])) & y.between(float(low[1]), float(high[1]))


def valid_sphere(lon: Column, lat: Column) -> Column:
    """Whether a point is on the globe."""
    return lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def latitude_band(lat: Column, plat: float, metres: float) -> Column:
    """A latitude range that holds every point within ``metres``: a cheap filter that loses none, at any latitude."""
    degrees = metres / EARTH_RADIUS * 57.29577951308232 * 1.000001
    return lat.between(plat - degrees, plat + degrees)


def grid_cell(x: Column, y: Column, size: float = 1.0) -> Column:
    """The grid cell of a point, for partitioning by place."""
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def boxes_intersect(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> bool:
    """Whether two boxes ((lowx, lowy), (highx, highy)) share a point."""
    return all(a[0][k] <= b[1][k] and b[0][k] <= a[1][k] for k in (0, 1))


def polygon_bounds(rings: Sequence[Ring]) -> tuple[tuple[float, float], tuple[float, float]]:
    """The box around a polygon's outer ring."""
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return (min(xs), min(ys)), (max(xs), max(ys))


def point_of(column: Column, kind: T.DataType) -> tuple[Column, Column] | None:
    """(x, y) of a GeoJSON point struct, a lon/lat or x/y struct, or GeoJSON text; None for other types. Bad points are null."""
    if isinstance(kind, T.StringType):
        column = F.from_json(column, "coordinates array<double>")
        kind = T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
    if isinstance(kind, T.StructType):
        if "coordinates" in kind.names:
            pair = column.getField("coordinates")
            two = F.size(pair) == 2
            return F.when(two, F.get(pair, F.lit(0))).cast("double"), F.when(two, F.get(pair, F.lit(1))).cast("double")
        for a, b in (("lon", "lat"), ("x", "y")):
            if a in kind.names and b in kind.names:
                return column.getField(a).cast("double"), column.getField(b).cast("double")
    return None
