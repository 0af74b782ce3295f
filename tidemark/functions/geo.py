"""Column functions on the sphere and on latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
OMEGA = 7.2921150e-5
GRAVITY = 9.81


def lon_180(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def lon_360(lon: Column) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, NULL where a coordinate is; the argument of the arc sine is clamped to 1
    (not by ``least``, which would take a NULL for 1)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when((a > 1.0) & ~F.isnan(a), F.lit(1.0)).otherwise(a)))


def coriolis(lat: Column) -> Column:
    return 2 * OMEGA * F.sin(F.radians(lat))


def geostrophic_velocity(slope: Column, lat: Column, min_abs_lat: float = 2.0) -> Column:
    """g / f times the slope; NULL near the equator, where f vanishes."""
    return F.when(F.abs(lat) >= min_abs_lat, F.try_divide(F.lit(GRAVITY) * slope, coriolis(lat)))


def signed_cross_track(xt: Column, swath: Column) -> Column:
    """Distance from the track, negative on the left."""
    return F.when(swath == "left", -F.abs(xt)).otherwise(F.abs(xt))


def local_xy_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular kilometres about a reference point."""
    km = math.pi / 180 * 6371.0
    return (lon - lon0) * km * F.cos(F.radians(lat0)), (lat - lat0) * km


def white_noise(swh: Column, width: float = 15.0, cell: float = 0.5, scale: float = 2.3) -> Column:
    """Level of the noise that a wave height brings: 2 (width / cell) (1 / scale)**2 (swh / 2)**1.5."""
    return 2 * width / cell * (1 / scale) ** 2 * F.pow(F.when(swh >= 0, swh) / 2, 1.5)
