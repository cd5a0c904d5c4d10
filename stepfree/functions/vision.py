"""Widths from polygons in a picture: pinhole projection and kerb height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfree.functions.tags import width_bucket

CAMERA_M = 1.5
FOV_DEG = 65.0
KERB_M = 0.15
KERB_LEAST_PX = 2


def focal_px(height: Column, fov: float = FOV_DEG) -> Column:
    return (height / 2) / F.tan(F.radians(F.lit(fov)) / 2)


def ground_distance_m(row: Column, height: Column) -> Column:
    """Distance to the ground seen at a pixel row; null at or above the horizon."""
    angle = F.atan((row - height / 2) / focal_px(height))
    return F.when(angle > 0, CAMERA_M / F.tan(angle))


def _axis(points: Column, i: int) -> Column:
    return F.transform(points, lambda p: p[i])


def bottom_band(points: Column, height: Column) -> Column:
    """Points near the lower edge; all points if fewer than two are near."""
    low = F.array_max(_axis(points, 1))
    band = F.filter(points, lambda p: low - p[1] <= F.greatest(F.lit(2.0), height * 0.02))
    return F.when(F.size(band) >= 2, band).otherwise(points)


def _extent(points: Column, i: int) -> Column:
    return F.array_max(_axis(points, i)) - F.array_min(_axis(points, i))


def pinhole_width(points: Column, height: Column) -> Column:
    """Width bucket of a mask; null for fewer than three points or above the horizon."""
    metres_per_px = ground_distance_m(F.array_max(_axis(points, 1)), height) / focal_px(height)
    return F.when(F.size(points) >= 3, width_bucket(_extent(bottom_band(points, height), 0) * metres_per_px))


def kerb_width(points: Column, kerb: Column, height: Column) -> Column:
    """Width bucket with the kerb's height as the scale; null for a kerb under two pixels."""
    kerb_px = _extent(kerb, 1)
    return F.when(kerb_px >= KERB_LEAST_PX, width_bucket(_extent(bottom_band(points, height), 0) * (KERB_M / kerb_px)))


# fixed value: the steepest ramp, in percent, that the accessibility standard allows in general
MOST_RAMP_PCT = 8.33


def ramp_compliance(slope_pct: Column) -> Column:
    """compliant up to `MOST_RAMP_PCT`, else excessive; null for no slope."""
    return F.when(slope_pct <= MOST_RAMP_PCT, "compliant").when(slope_pct.isNotNull(), "excessive")
