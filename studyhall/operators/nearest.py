"""JOIN-08 as pages: the k nearest places of every point within a radius, without building all pairs in range.

Places are put into a tree of cubes (latitude and longitude become points in space, so that neither the poles nor the
180th meridian are special and straight distances order like those on the sphere): a cube with more than ``LEAF`` places is split into
eight, however crowded it is. Every point then walks down the tree, all points in step:

1. it starts with the cubes of the top level that the radius reaches (eight at most);
2. the cubes on its list, by the farthest distance their places can have, give a distance within which k places surely are;
   cubes whose nearest place must be farther are dropped;
3. cubes that are not leaves are replaced by their parts, and 2 is repeated until all are leaves;
4. only the places of these leaves are compared with the point, and the first k stay.

A list holds some dozen cubes, so the rows of every step are linear in the points, whatever the density. Of places at one and the
same coordinates only the k smallest ids can be on a page, so no leaf is crowded. Each round is a join on (level, cube), salted since
a city's points share their cubes, and ends with a stored table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyhall.constants import EARTH_RADIUS_KM
from studyhall.functions.geo import haversine_km, valid_coordinates
from studyhall.operators.topn import top_k_per_group
from studyhall.session import stored

LEAF = 32
DEEPEST_KM = 0.001
SALTS = 8
SLACK_KM = 1e-5     # distances are compared after rounding to six decimals
AXES = ("x", "y", "z")


def _in_space(lat: Column, lng: Column) -> list[Column]:
    p, q = F.radians(lat), F.radians(lng)
    r = F.lit(EARTH_RADIUS_KM)
    return [r * F.cos(p) * F.cos(q), r * F.cos(p) * F.sin(q), r * F.sin(p)]


def _cube(size) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long").alias(f"c{a}") for a in AXES]


def place_tree(places: DataFrame, top_km: float, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of places (id, lat, lng, x, y, z). Nodes: level, cx, cy, cz, n, is_leaf and the box of their places;
    members: the leaf (level, cx, cy, cz) of each place."""
    deepest = max(1, math.ceil(math.log2(top_km / DEEPEST_KM)))
    cube = ["level", "cx", "cy", "cz"]
    size = F.lit(top_km) / F.pow(F.lit(2.0), F.col("level"))
    listed = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).select(
        "id", "lat", "lng", *AXES, "level", *_cube(size))
    boxes = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    cells = listed.groupBy(*cube).agg(F.count(F.lit(1)).alias("n"), *boxes)
    cells = cells.withColumn("is_leaf", (F.col("n") <= leaf) | (F.col("level") == deepest))
    # A cell belongs to the tree if its parent is split.
    parent = cells.filter(~F.col("is_leaf")).select((F.col("level") + 1).alias("level"), *[
        F.col(f"c{a}").alias(f"p{a}") for a in AXES])
    inside = cells.filter("level > 0").withColumns({f"p{a}": F.floor(F.col(f"c{a}") / 2).cast("long") for a in AXES}).join(
        parent, ["level", "px", "py", "pz"])
    nodes = stored(cells.filter("level = 0").unionByName(inside.select(*cells.columns)))
    leaves = nodes.filter("is_leaf").select(*cube, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = listed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(
        leaves, [*cube, "salt"]).select("id", "lat", "lng", *cube)
    return nodes, members


def _bounds(rows: DataFrame) -> DataFrame:
    """``near`` and ``far``: bounds of the straight distance from (x, y, z) to the places of the node's box."""
    near = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}")), 2) for a in AXES), F.lit(0.0))
    far = sum((F.pow(F.greatest(F.abs(F.col(f"lo{a}") - F.col(a)), F.abs(F.col(f"hi{a}") - F.col(a))), 2) for a in AXES),
              F.lit(0.0))
    return rows.withColumns({"near": F.sqrt(near), "far": F.sqrt(far)}).drop(
        *[f"{n}{a}" for a in AXES for n in ("lo", "hi")])


def nearest_places(points: DataFrame, places: DataFrame, k: int, km: float, *, leaf: int = LEAF) -> DataFrame:
    """(point_id, position, place_id, distance_km): the ``k`` nearest places within ``km`` of every point, by distance
    (six decimals), then place_id. ``points`` (point_id, lat, lng) and ``places`` (place_id, lat, lng) with unique ids;
    rows without id or valid coordinates take no part."""
    chord = 2 * EARTH_RADIUS_KM * math.sin(min(math.pi, km / EARTH_RADIUS_KM) / 2) + SLACK_KM
    top = 2 * chord
    shown = F.col("lat").cast("double"), F.col("lng").cast("double")
    places = places.filter(F.col("place_id").isNotNull() & valid_coordinates(*shown))
    places = top_k_per_group(places.select(F.col("place_id").alias("id"), shown[0].alias("lat"), shown[1].alias("lng")),
                             ["lat", "lng"], [F.col("id")], k).drop("position")
    spots = stored(places.select("*", *[c.alias(a) for c, a in zip(_in_space(F.col("lat"), F.col("lng")), AXES)]))
    nodes, members = place_tree(spots, top, leaf)
    points = points.filter(F.col("point_id").isNotNull() & valid_coordinates(*shown))
    points = points.select("point_id", shown[0].alias("lat"), shown[1].alias("lng"))
    points = points.select("*", *[c.alias(a) for c, a in zip(_in_space(F.col("lat"), F.col("lng")), AXES)])

    cube = ["level", "cx", "cy", "cz"]
    salt = F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int").alias("salt")
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = points.select("*", F.lit(0).alias("level"), salt)
    for a in AXES:
        first = first.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(a) - chord) / top), F.floor((F.col(a) + chord) / top))))
    lists = _bounds(first.join(salted, [*cube, "salt"])).drop("salt")

    def pruned(rows: DataFrame) -> DataFrame:
        mine = Window.partitionBy("point_id")
        sure = F.sum("n").over(mine.orderBy("far", *cube).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("sure", sure)
        reach = F.least(F.lit(chord), F.coalesce(F.min(F.when(F.col("sure") >= k, F.col("far"))).over(mine), F.lit(chord)))
        return rows.withColumn("reach", reach + SLACK_KM).filter("near <= reach").drop("sure", "reach")

    parts = salted.filter("level > 0").select("*", (F.col("level") - 1).alias("up"), *[
        F.floor(F.col(f"c{a}") / 2).cast("long").alias(f"p{a}") for a in AXES])
    while True:
        lists = stored(pruned(lists))
        open_ = lists.filter(~F.col("is_leaf"))
        if open_.isEmpty():
            break
        open_ = open_.select("point_id", "lat", "lng", *AXES, salt, F.col("level").alias("up"),
                             *[F.col(f"c{a}").alias(f"p{a}") for a in AXES])
        down = _bounds(open_.join(parts, ["up", "px", "py", "pz", "salt"])).select(*lists.columns)
        lists = lists.filter("is_leaf").unionByName(down)
    hot = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        *cube, "salt", F.col("id").alias("place_id"), F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"))
    met = lists.select("point_id", "lat", "lng", *cube, salt).join(hot, [*cube, "salt"])
    km_col = F.round(haversine_km("lat", "lng", "q_lat", "q_lng"), 6)
    exact = haversine_km("lat", "lng", "q_lat", "q_lng") <= km
    met = met.filter(exact).select("point_id", "place_id", km_col.alias("distance_km"))
    return top_k_per_group(met, ["point_id"], [F.col("distance_km"), F.col("place_id")], k).select(
        "point_id", "position", "place_id", "distance_km")
