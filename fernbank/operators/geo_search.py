"""Geo queries over two coordinate columns or a point column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.filters import operand


def point(df: DataFrame, field: str | tuple[str, str]) -> tuple[Column, Column]:
    """(x, y) of a point field, or of two coordinate fields."""
    if isinstance(field, tuple):
        return F.col(field[0]).cast("double"), F.col(field[1]).cast("double")
    x = operand(df.schema, field)
    found = geo.point_of(x.column, x.kind) if x.column is not None else None
    if found is None:
        raise ValueError(f"{field} holds no points")
    return found


def build_index(df: DataFrame, field: str | tuple[str, str], *, id_field: str = "_id", spherical: bool = True) -> DataFrame:
    """``id, x, y`` of every point, sorted by grid cell (rows of cells of one latitude on the sphere), so that Parquet's statistics skip other places."""
    x, y = point(df, field)
    points = df.select(F.col(id_field).alias("id"), x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    cell = geo.grid_cell(F.col("x"), F.col("y"))
    keys = [cell["cy"], cell["cx"]] if spherical else [cell["cx"], cell["cy"]]
    return points.repartitionByRange(*keys).sortWithinPartitions(*keys, "id")


def near(df: DataFrame, field: str | tuple[str, str], centre: Sequence[float], max_distance: float, *, spherical: bool = True, limit: int = 0, id_field: str = "_id") -> DataFrame:
    """Rows within ``max_distance`` (metres on the sphere, else units), nearest first, with ``_distance``.

    A band around the centre is filtered first; on the sphere only by latitude, which
    holds at any longitude and latitude.
    """
    x, y = point(df, field)
    px, py = map(float, centre)
    if spherical:
        rows = df.where(geo.valid_sphere(x, y) & geo.latitude_band(y, py, max_distance)).withColumn("_distance", geo.haversine(x, y, px, py))
    else:
        r = float(max_distance)
        rows = df.where(x.between(px - r, px + r) & y.between(py - r, py + r)).withColumn("_distance", geo.planar(x, y, px, py))
    rows = rows.where(F.col("_distance") <= float(max_distance)).orderBy("_distance", id_field)
    return rows.limit(limit) if limit else rows


def within(df: DataFrame, field: str | tuple[str, str], polygon: Sequence[geo.Ring], *, skip: int = 0, limit: int = 0) -> DataFrame:
    """Rows inside a polygon and outside its holes."""
    rows = df.where(geo.in_polygon(*point(df, field), polygon))
    rows = rows.offset(skip) if skip else rows
    return rows.limit(limit) if limit else rows


def intersects(df: DataFrame, field: str | tuple[str, str], low: Sequence[float], high: Sequence[float], *, skip: int = 0, limit: int = 0) -> DataFrame:
    """Rows whose point is in a box, its edges included."""
    rows = df.where(geo.in_box(*point(df, field), low, high))
    rows = rows.offset(skip) if skip else rows
    return rows.limit(limit) if limit else rows
