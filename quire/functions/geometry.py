"""Polygons written as ``x,y x,y ...``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon(points: Column) -> Column:
    """array<struct<x,y>>; pairs that cannot be read go."""
    pairs = F.transform(F.split(F.trim(points), r"\s+"), lambda p: F.struct(F.try_element_at(F.split(p, ","), F.lit(1)).try_cast("int").alias("x"), F.try_element_at(F.split(p, ","), F.lit(2)).try_cast("int").alias("y")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def bbox(shape: Column) -> Column:
    """struct<min_x, max_x, min_y, max_y>."""
    xs, ys = F.transform(shape, lambda p: p["x"]), F.transform(shape, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))


def shifted(shape: Column, dx: Column, dy: Column) -> Column:
    return F.transform(shape, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def sheared_rotated(shape: Column, shear: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """Points after a horizontal shear and then a rotation, both about (cx, cy), as doubles."""
    angle = F.radians(degrees)

    def move(p: Column) -> Column:
        y = p["y"] - cy
        x = p["x"] - cx + shear * y
        return F.struct((F.cos(angle) * x - F.sin(angle) * y + cx).alias("x"), (F.sin(angle) * x + F.cos(angle) * y + cy).alias("y"))

    return F.transform(shape, move)


def sheared_rotated_back(shape: Column, shear: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """The points that ``sheared_rotated`` moved to these: the rotation is undone, then the shear."""
    angle = F.radians(degrees)

    def move(p: Column) -> Column:
        x, y = p["x"] - cx, p["y"] - cy
        level = F.cos(angle) * y - F.sin(angle) * x
        return F.struct((F.cos(angle) * x + F.sin(angle) * y - shear * level + cx).alias("x"), (level + cy).alias("y"))

    return F.transform(shape, move)
