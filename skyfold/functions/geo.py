"""Great-circle geometry on a sphere."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

# The sphere's radius, a degree's length, and the sectors' width.
EARTH_KM, DEGREE_KM, SECTOR_DEG = 6371.0, 111.0, 30


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to below 360."""
    p, q, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    east = F.sin(d) * F.cos(q)
    north = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance; the argument is held to 1, as rounding may pass it at antipodes."""
    p, q = F.radians(col(lat1)), F.radians(col(lat2))
    s, t = F.sin((q - p) / 2), F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    a = s * s + F.cos(p) * F.cos(q) * t * t
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def sector(angle) -> Column:
    """The sector of a bearing: twelve of 30 degrees."""
    return F.pmod(F.floor(col(angle) / SECTOR_DEG), F.lit(360 // SECTOR_DEG)).cast("tinyint")


def within_box(lat, lon, lat0: float, lon0: float, radius_km: float) -> Column:
    """A box about a point; its width in degrees grows with the latitude."""
    tall = radius_km / DEGREE_KM
    wide = radius_km / (DEGREE_KM * max(0.1, cos(radians(lat0))))
    return (F.abs(col(lat) - lat0) < tall) & (F.abs(col(lon) - lon0) < wide)
