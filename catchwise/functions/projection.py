"""Map projections and great-circle distance as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM zone 49 south (fixed values)
A_M = 6378137.0
FLATTENING = 1 / 298.257223563
LON0_DEG = 111.0
SCALE0 = 0.9996
FALSE_E = 500000.0
FALSE_N = 10000000.0
EARTH_RADIUS_M = 6371008.8

_n = FLATTENING / (2 - FLATTENING)
_RECT = A_M / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
# Krueger series coefficients to fourth order in the third flattening
_ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
_BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)
_DELTA = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to easting and northing in metres."""
    phi = F.radians(lat)
    dlam = F.radians(lon - LON0_DEG)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi0 = F.atan2(t, F.cos(dlam))
    eta0 = F.atanh(F.sin(dlam) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, c in enumerate(_ALPHA, 1):
        xi = xi + c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return FALSE_E + SCALE0 * _RECT * eta, FALSE_N + SCALE0 * _RECT * xi


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """Easting and northing in metres to longitude and latitude in degrees."""
    xi = (y - FALSE_N) / (SCALE0 * _RECT)
    eta = (x - FALSE_E) / (SCALE0 * _RECT)
    xi0, eta0 = xi, eta
    for j, c in enumerate(_BETA, 1):
        xi0 = xi0 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, c in enumerate(_DELTA, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return LON0_DEG + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(phi)


def to_equal_area(lon: Column, lat: Column, standard_parallel: float = 0.0) -> tuple[Column, Column]:
    """Ellipsoidal cylindrical equal-area coordinates (standard parallel 0 or 30 degrees)."""
    e2 = _E * _E
    ts = math.radians(standard_parallel)
    k0 = math.cos(ts) / math.sqrt(1 - e2 * math.sin(ts) ** 2)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(_E * s) / _E)
    return A_M * k0 * F.radians(lon), A_M * q / (2 * k0)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    dp = F.radians(lat2 - lat1)
    dl = F.radians(lon2 - lon1)
    h = F.pow(F.sin(dp / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), F.lit(2))
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))
