"""Positions as column expressions: validity, unit vectors, great-circle distance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def usable(lat: Column, lon: Column) -> Column:
    """Both coordinates present, not NaN, in range and not both zero; never null."""
    inside = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.coalesce(
        lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & inside & ~((lat == 0) & (lon == 0)),
        F.lit(False),
    )


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord(metres: float) -> float:
    """Straight-line distance of two unit vectors `metres` apart on the sphere."""
    return 2.0 * math.sin(min(metres / EARTH_RADIUS_M, math.pi) / 2.0)


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


# --- transverse Mercator (Krueger series, published coefficients, GRS80) -----------

_F = 1 / 298.257222101
_N = _F / (2 - _F)
_A = 6_378_137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0


def _d(x: float) -> str:
    """A double literal both Spark SQL and other engines read the same."""
    return f"cast('{x!r}' as double)"


def zone_meridian(lon: str) -> str:
    """SQL of the central meridian of the 6-degree zone of a longitude."""
    return f"(least(floor(({lon} + 180) / 6), 59) * 6 - 177)"


def projected(rows: str, lat: str, lon: str, meridian: str) -> str:
    """SQL that adds east, north (metres) to the relation `rows`, by transverse
    Mercator about `meridian`; null positions give nulls."""
    east = " + ".join(f"{_d(a)} * cos({2 * j} * tm_xi) * sinh({2 * j} * tm_eta)" for j, a in enumerate(_ALPHA, 1))
    north = " + ".join(f"{_d(a)} * sin({2 * j} * tm_xi) * cosh({2 * j} * tm_eta)" for j, a in enumerate(_ALPHA, 1))
    return f"""
    select *, {_d(FALSE_EAST)} + {_d(SCALE * _A)} * (tm_eta + {east}) as east,
           {_d(FALSE_NORTH)} + {_d(SCALE * _A)} * (tm_xi + {north}) as north
    from (select *, atan2(tm_t, cos(tm_dl)) as tm_xi, atanh(sin(tm_dl) / sqrt(1 + tm_t * tm_t)) as tm_eta
          from (select *, radians({lon} - {meridian}) as tm_dl,
                       sinh(atanh(sin(radians({lat}))) - {_d(_E)} * atanh({_d(_E)} * sin(radians({lat})))) as tm_t from {rows}) tm_1) tm_2"""


def project(lat: np.ndarray, lon: np.ndarray, meridian: np.ndarray | float) -> np.ndarray:
    """(east, north) in metres of arrays of positions, as `projected` has them."""
    dl, phi = np.radians(lon - meridian), np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(phi) - _E * np.arctanh(_E * phi))
    xi, eta = np.arctan2(t, np.cos(dl)), np.arctanh(np.sin(dl) / np.sqrt(1 + t * t))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return np.column_stack([FALSE_EAST + SCALE * _A * east, FALSE_NORTH + SCALE * _A * north])


def unprojected(rows: str, east: str, north: str, meridian: str) -> str:
    """SQL that adds lat, lon (degrees) to `rows`: the inverse of `projected`."""
    xi = " - ".join(["tm_x0", *[f"{_d(b)} * sin({2 * j} * tm_x0) * cosh({2 * j} * tm_e0)" for j, b in enumerate(_BETA, 1)]])
    eta = " - ".join(["tm_e0", *[f"{_d(b)} * cos({2 * j} * tm_x0) * sinh({2 * j} * tm_e0)" for j, b in enumerate(_BETA, 1)]])
    lat = " + ".join(["tm_chi", *[f"{_d(d)} * sin({2 * j} * tm_chi)" for j, d in enumerate(_DELTA, 1)]])
    return f"""
    select *, degrees({lat}) as lat, {meridian} + degrees(atan2(sinh(tm_eta), cos(tm_xi))) as lon
    from (select *, asin(sin(tm_xi) / cosh(tm_eta)) as tm_chi
          from (select *, {xi} as tm_xi, {eta} as tm_eta
                from (select *, ({north} - {_d(FALSE_NORTH)}) / {_d(SCALE * _A)} as tm_x0, ({east} - {_d(FALSE_EAST)}) / {_d(SCALE * _A)} as tm_e0 from {rows}) tm_1) tm_2) tm_3"""


def add_projection(df: DataFrame, lat: str, lon: str, meridian: str | None = None) -> DataFrame:
    """`df` with zone, east, north; the zone is the row's own 6-degree zone unless
    a meridian is given."""
    keep = df.columns
    sql = projected("{df}", lat, lon, meridian or zone_meridian(lon))
    out = df.sparkSession.sql(sql, df=df)
    return out.select(*[c for c in keep if c != "zone"], F.expr(meridian or zone_meridian(lon)).cast("int").alias("zone"), "east", "north")
