"""JOIN-08: all (point, place) pairs within a radius, as an equi-join on grid cells.

A distance predicate alone plans as a nested-loop join (every point against every place).
Here latitude is cut into bands as high as the radius and each band into equal longitude cells, as
many as keep a cell at least as wide as the radius reaches anywhere in the band and its neighbours
(fewer and wider cells towards the poles). A point is listed in the 3 bands and, in each, the 3 cells
around it (wrapping at +-180), a place in its own cell; the two are hash-joined on the cell, and the
exact haversine test removes the candidates outside the circle. No pair is missed, none found
twice, and there is no special case near the poles or the antimeridian.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyhall.functions.geo import KM_PER_DEG_LAT, haversine_km


def _cell_deg(km: float) -> float:
    return km / KM_PER_DEG_LAT * (1 + 1e-9)


def within_radius_join(points: DataFrame, places: DataFrame, km: float, *,
                       p_lat="lat", p_lng="lng", q_lat="lat", q_lng="lng",
                       distance_col="distance_km") -> DataFrame:
    """Pairs (points row, places row) with haversine distance <= km, plus ``distance_col``.

    Column names of the two sides must not collide except for the coordinates, which are
    renamed ``_plat/_plng`` and ``_qlat/_qlng`` internally and dropped.
    """
    d = _cell_deg(km)
    pts = (points.filter(F.col(p_lat).isNotNull() & F.col(p_lng).isNotNull())
           .withColumnRenamed(p_lat, "_plat").withColumnRenamed(p_lng, "_plng"))
    plc = (places.filter(F.col(q_lat).isNotNull() & F.col(q_lng).isNotNull())
           .withColumnRenamed(q_lat, "_qlat").withColumnRenamed(q_lng, "_qlng"))

    half = math.sin(math.radians(d) / 2)

    def cells(band):
        """Cells of a band: the widest longitude reach of the radius within one band of it, at most."""
        worst = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(d), F.lit(90.0))
        reach = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(half) / F.greatest(F.cos(F.radians(worst)), F.lit(1e-9))))) * 2
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / (reach * (1 + 1e-9)))).cast("long")

    def column(lng, n):
        return F.pmod(F.floor((lng + 180.0) / 360.0 * n), n)

    plat, qlat = F.col("_plat"), F.col("_qlat")
    band = F.floor(plat / d)
    around = F.flatten(F.transform(F.sequence(band - 1, band + 1), lambda i: F.transform(
        F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)),
                                     lambda k: F.pmod(column(F.col("_plng"), cells(i)) + k, cells(i)))),
        lambda j: F.struct(i.alias("i"), j.alias("j")))))
    pts = pts.withColumn("_cell", F.explode(around))
    pts = pts.withColumn("_ci", F.col("_cell.i")).withColumn("_cj", F.col("_cell.j")).drop("_cell")
    own = F.floor(qlat / d)
    plc = plc.withColumn("_ci", own).withColumn("_cj", column(F.col("_qlng"), cells(own)))

    dist = haversine_km("_plat", "_plng", "_qlat", "_qlng")
    joined = pts.join(plc, ["_ci", "_cj"]).withColumn(distance_col, dist).filter(F.col(distance_col) <= km)
    return joined.drop("_ci", "_cj").withColumnRenamed("_plat", "point_lat").withColumnRenamed(
        "_plng", "point_lng").withColumnRenamed("_qlat", "place_lat").withColumnRenamed("_qlng", "place_lng")
