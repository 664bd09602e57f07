"""Distance on the sphere as plain column expressions (FN-16, FLT-10).

PostGIS measures on the spheroid; haversine with the mean Earth radius stays within 0.6 %
of it. Everything is built-in math, no UDF, so it runs in codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyhall.constants import EARTH_RADIUS_KM

KM_PER_DEG_LAT = EARTH_RADIUS_KM * math.pi / 180.0


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in km between two (lat, lng) points given in degrees."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = p2 - p1
    dl = F.radians(_c(lng2)) - F.radians(_c(lng1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


# WGS84 ellipsoid (fixed values of the geodesy the reference relies on)
WGS84_A_KM = 6378.137
WGS84_F = 1 / 298.257223563


def lambert_km(lat1, lng1, lat2, lng2) -> Column:
    """Lambert's formula: spherical angle on reduced latitudes with the flattening correction
    (within a few metres of the spheroid distance for city-scale ranges). Plain columns."""
    f = WGS84_F
    b1 = F.atan(F.lit(1 - f) * F.tan(F.radians(_c(lat1))))
    b2 = F.atan(F.lit(1 - f) * F.tan(F.radians(_c(lat2))))
    dl = F.radians(_c(lng2)) - F.radians(_c(lng1))
    a = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(dl / 2), 2)
    sigma = F.lit(2.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2) / F.pow(F.cos(sigma / 2), 2)
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2) / F.pow(F.sin(sigma / 2), 2)
    return F.when(sigma == 0, F.lit(0.0)).otherwise(F.lit(WGS84_A_KM) * (sigma - F.lit(f / 2) * (x + y)))


GEODESIC_STEPS = 15


def geodesic_km(lat1, lng1, lat2, lng2, steps: int = GEODESIC_STEPS) -> Column:
    """Length of the shortest line on the WGS84 ellipsoid (the inverse problem, by fixed-point iteration of the longitude
    difference on the auxiliary sphere), exact to some micrometres. One column expression: the iteration is an ``aggregate``
    over ``steps`` numbers. It does not converge for almost opposite points of the globe; those give NULL."""
    f, a = WGS84_F, WGS84_A_KM
    b = a * (1 - f)
    u1, u2 = (F.atan(F.lit(1 - f) * F.tan(F.radians(_c(x)))) for x in (lat1, lat2))
    s1, c1, s2, c2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)
    # The difference of longitudes the short way round.
    turn = F.radians(_c(lng2)) - F.radians(_c(lng1))
    gap = F.atan2(F.sin(turn), F.cos(turn))

    def arc(lam):
        """(sine, cosine, length of the arc; squared cosine of its azimuth at the equator; sine of that; its midpoint)"""
        sin2 = F.pow(c2 * F.sin(lam), 2) + F.pow(c1 * s2 - s1 * c2 * F.cos(lam), 2)
        sin, cos = F.sqrt(sin2), s1 * s2 + c1 * c2 * F.cos(lam)
        sin_az = F.coalesce(F.try_divide(c1 * c2 * F.sin(lam), sin), F.lit(0.0))
        cos2_az = F.lit(1.0) - sin_az * sin_az
        mid = F.coalesce(cos - F.try_divide(F.lit(2.0) * s1 * s2, cos2_az), F.lit(0.0))
        return sin, cos, F.atan2(sin, cos), cos2_az, sin_az, mid

    def step(state, _):
        lam = state["now"]
        sin, cos, sigma, cos2_az, sin_az, mid = arc(lam)
        c = F.lit(f / 16) * cos2_az * (F.lit(4.0) + F.lit(f) * (F.lit(4.0) - F.lit(3.0) * cos2_az))
        more = (F.lit(1.0) - c) * F.lit(f) * sin_az * (sigma + c * sin * (mid + c * cos * (F.lit(2.0) * mid * mid - F.lit(1.0))))
        return F.struct(lam.alias("before"), (gap + more).alias("now"))

    def length(state):
        sin, cos, sigma, cos2_az, _, mid = arc(state["now"])
        u = cos2_az * F.lit((a * a - b * b) / (b * b))
        big_a = F.lit(1.0) + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        mid2 = mid * mid
        less = big_b * sin * (mid + big_b / 4 * (cos * (2 * mid2 - 1) - big_b / 6 * mid * (4 * sin * sin - 3) * (4 * mid2 - 3)))
        settled = F.abs(state["now"] - state["before"]) < 1e-10
        return F.when(settled, F.lit(b) * big_a * (sigma - less))

    start = F.struct((gap + F.lit(1.0)).alias("before"), gap.alias("now"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, length)


def distance_km(lat1, lng1, lat2, lng2, method: str = "haversine") -> Column:
    """FN-16: ``haversine`` (sphere, R = 6371.0088 km), ``lambert`` (ellipsoid correction) or ``geodesic`` (ellipsoid)."""
    methods = {"haversine": haversine_km, "lambert": lambert_km, "geodesic": geodesic_km}
    if method not in methods:
        raise ValueError(f"unknown distance method {method!r}")
    return methods[method](lat1, lng1, lat2, lng2)


def bounding_box(lat_col, lng_col, lat: float, lng: float, km: float) -> Column:
    """Cheap pre-filter that never drops a point within ``km`` (pushed to parquet when stored).

    1 % wider than the sphere needs, so it also holds for the ellipsoid (a degree of latitude
    is 110.57 km at the equator)."""
    km = km * 1.01
    dlat = km / KM_PER_DEG_LAT
    cos_max = math.cos(math.radians(min(89.9, abs(lat) + dlat)))
    dlng = 180.0 if cos_max <= 0 else min(180.0, km / (KM_PER_DEG_LAT * cos_max))
    box = _c(lat_col).between(lat - dlat, lat + dlat)
    if dlng < 180.0:
        box = box & _c(lng_col).between(lng - dlng, lng + dlng)
    return box


def within_km(lat_col, lng_col, lat: float, lng: float, km: float, method: str = "haversine") -> Column:
    """FLT-10: ``ST_DWithin`` analogue: box pre-filter AND exact distance test."""
    return bounding_box(lat_col, lng_col, lat, lng, km) & (distance_km(lat_col, lng_col, lat, lng, method) <= km)


def valid_coordinates(lat, lng) -> Column:
    """FN-17: latitude in [-90, 90], longitude in [-180, 180], neither NULL/NaN."""
    la, ln = _c(lat), _c(lng)
    return (la.between(-90, 90) & ln.between(-180, 180) & ~F.isnan(la) & ~F.isnan(ln))
