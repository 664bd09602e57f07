"""Distances on the ellipsoid against published values and numerical integration."""

import math

from studyhall.functions.geo import distance_km, geodesic_km

A, FL = 6378.137, 1 / 298.257223563


def meridian_km(lat1, lat2, n=20000):
    """Length of a meridian by Simpson's rule over its radius of curvature."""
    e2 = FL * (2 - FL)
    x1, x2 = math.radians(lat1), math.radians(lat2)
    h = (x2 - x1) / n
    g = lambda x: A * (1 - e2) / (1 - e2 * math.sin(x) ** 2) ** 1.5
    return abs(h / 3 * (g(x1) + g(x2) + sum((4 if i % 2 else 2) * g(x1 + i * h) for i in range(1, n))))


def test_geodesic_is_exact_to_a_millimetre(spark):
    cases = [
        ((0.0, 10.0, 0.0, 11.0), A * math.radians(1)),                     # along the equator
        ((0.0, 179.5, 0.0, -179.5), A * math.radians(1)),                  # the short way round
        ((29.0, 31.0, 31.5, 31.0), meridian_km(29.0, 31.5)),
        ((-20.0, 5.0, 60.0, 5.0), meridian_km(-20.0, 60.0)),
        ((89.0, 0.0, 89.0, 180.0), 2 * meridian_km(89.0, 90.0)),           # over the pole
        ((30.0, 31.0, 30.0, 31.0), 0.0),
        ((40.6, -73.8, 51.6, -0.5), 5551.759400),                          # a published example, to 0.1 m
    ]
    df = spark.createDataFrame([c for c, _ in cases], "a double, b double, c double, d double")
    got = [r.d for r in df.select(geodesic_km("a", "b", "c", "d").alias("d")).collect()]
    for (case, want), d in zip(cases, got):
        assert abs(d - want) < (1e-4 if want == 5551.759400 else 1e-6), (case, d, want)
    flipped = [r.d for r in df.select(geodesic_km("c", "d", "a", "b").alias("d")).collect()]
    assert all(abs(x - y) < 1e-9 for x, y in zip(got, flipped))


def test_geodesic_of_opposite_points_is_null_and_nulls_stay(spark):
    df = spark.createDataFrame([(0.3, 0.0, -0.3, 179.9), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert [r.d for r in df.select(distance_km("a", "b", "c", "d", "geodesic").alias("d")).collect()] == [None, None]
