"""Pages of nearest places equal brute force, also where places crowd or share coordinates."""

import math
import random

import pytest

from studyhall.operators import nearest


def haversine(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    dl = math.radians(b[1]) - math.radians(a[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def brute(points, places, k, km):
    out = set()
    for p, *a in points:
        near = sorted((round(haversine(a, b), 6), q) for q, *b in places if haversine(a, b) <= km)[:k]
        out |= {(p, i, q, d) for i, (d, q) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("k, km", [(4, 30.0), (7, 300.0)])
def test_pages_equal_brute_force(spark, k, km):
    rng = random.Random(k)
    places = [(i, 30 + rng.gauss(0, 0.001), 31 + rng.gauss(0, 0.001)) for i in range(150)]            # a crowd
    places += [(200 + i, 30.2, 31.2) for i in range(60)]                                               # one spot
    places += [(300 + i, rng.uniform(28, 32), rng.uniform(29, 33)) for i in range(80)]
    places += [(400 + i, rng.uniform(-89.9, -89), rng.uniform(-180, 180)) for i in range(20)]          # a pole
    places += [(500 + i, rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179, 180)) for i in range(20)]
    points = [(i, 30 + rng.gauss(0, 0.2), 31 + rng.gauss(0, 0.2)) for i in range(60)]
    points += [(100 + i, -89.5, rng.uniform(-180, 180)) for i in range(8)] + [(200, 0.1, 179.99), (201, 0.0, -179.999)]
    points += [(300, 10.0, 10.0), (301, 30.2, 31.2)]
    odd = [(900, None, 3.0), (901, 91.0, 3.0), (None, 30.0, 31.0), (902, float("nan"), 1.0)]
    got = nearest.nearest_places(spark.createDataFrame(points + odd, "point_id long, lat double, lng double"),
                                 spark.createDataFrame(places + odd, "place_id long, lat double, lng double"), k, km, leaf=5)
    rows = {(r.point_id, r.position, r.place_id, round(r.distance_km, 6)) for r in got.collect()}
    assert rows == brute(points, places, k, km)


def test_lists_stay_short_in_a_crowd(spark, monkeypatch):
    rng = random.Random(1)
    places = [(i, 30 + rng.gauss(0, 0.01), 31 + rng.gauss(0, 0.01)) for i in range(2000)]
    points = [(i, 30 + rng.gauss(0, 0.01), 31 + rng.gauss(0, 0.01)) for i in range(200)]
    sizes, real = [], nearest.stored
    monkeypatch.setattr(nearest, "stored", lambda df: (lambda t: sizes.append(t) or t)(real(df)))
    got = nearest.nearest_places(spark.createDataFrame(points, "point_id long, lat double, lng double"),
                                 spark.createDataFrame(places, "place_id long, lat double, lng double"), 20, 25.0)
    assert got.count() == 200 * 20
    assert max(t.count() for t in sizes[2:]) < 200 * 40      # lists of cubes; all pairs in range are 400 000
