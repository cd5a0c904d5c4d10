"""Polygons given as arrays of [x, y] arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_points(polygon: Column) -> Column:
    """The points with exactly two coordinates; null for a null polygon."""
    return F.filter(polygon, lambda p: F.size(p) == 2)


def shoelace_area(points: Column) -> Column:
    """Area by the shoelace formula in one pass; 0 for fewer than three points,
    null for a null array."""
    start = F.struct(
        F.lit(0).alias("n"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x", "y", "twice")]
    )

    def step(a: Column, p: Column) -> Column:
        x, y, first = F.coalesce(p[0], F.lit(0.0)), F.coalesce(p[1], F.lit(0.0)), a["n"] == 0
        return F.struct(
            (a["n"] + 1).alias("n"),
            F.when(first, x).otherwise(a["x0"]).alias("x0"),
            F.when(first, y).otherwise(a["y0"]).alias("y0"),
            x.alias("x"),
            y.alias("y"),
            F.when(first, F.lit(0.0)).otherwise(a["twice"] + (a["x"] * y - x * a["y"])).alias("twice"),
        )

    def close(a: Column) -> Column:
        whole = F.abs(a["twice"] + (a["x"] * a["y0"] - a["x0"] * a["y"])) / 2
        return F.when(a["n"] < 3, F.lit(0.0)).otherwise(whole)

    return F.aggregate(points, start, step, close)
