"""Points against areas and against each other: cell joins with an exact test behind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import AIS, Spec
from ..functions.exprs import haversine_m

METRES_PER_DEGREE = 111_194.9  # of latitude, on the sphere in use; cells are a little larger than the radius
EARTH_M = 6_371_008.8
BROADCAST_AREAS = 20_000


class Grid:
    """Cells that no two points within the radius skip over, on the whole sphere. Bands of latitude are a radius high; a band is cut into a whole number of
    cells, each as wide as the radius may reach in longitude anywhere in the band or beside it, so the cells wrap at the date line and are few near the poles."""

    def __init__(self, radius_m: float):
        self.height = radius_m / METRES_PER_DEGREE * 1.01
        self.half = math.sin(min(math.pi / 2, radius_m / (2 * EARTH_M))) * 1.01

    def band(self, lat):
        return F.floor(lat / self.height)

    def _across(self, band):
        edge = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(self.height))
        reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(self.half) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9)))))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / reach))

    def cell(self, lon, band):
        n = self._across(band)
        return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n), n - 1)

    def around(self, lon, band):
        """The cell and its neighbours in a band, each once."""
        c, n = self.cell(lon, band), self._across(band)
        return F.array_distinct(F.array(*[F.pmod(c + i, n) for i in (-1, 0, 1)]))


def pairs_within(df: DataFrame, radius_m: float, frame: str = "ts", s: Spec = AIS, legacy_axes: bool = False) -> DataFrame:
    """(frame, src, dst, metres), src < dst, of all pairs of objects of a frame strictly within the radius. Points meet those of their own
    and the neighbouring cells in an equi-join on frame and cell; a point goes to the cells around it in its own band and in the next one, so every pair meets once."""
    g, (lon, lat) = Grid(radius_m), (s.lat, s.lon) if legacy_axes else (s.lon, s.lat)
    p = df.select(F.col(frame).alias("frame"), F.col(s.oid).alias("o"), F.col(s.lon).alias("x"), F.col(s.lat).alias("y"), F.col(lon).alias("_lon"), g.band(F.col(lat)).alias("own"))
    a = p.select("frame", F.col("own").alias("band"), g.cell(F.col("_lon"), F.col("own")).alias("cell"), F.col("o").alias("oa"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.withColumn("band", F.explode(F.array("own", F.col("own") + 1))).withColumn("cell", F.explode(g.around(F.col("_lon"), F.col("band"))))
    b = b.select("frame", "band", "cell", F.col("o").alias("ob"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("band") == F.col("own")).alias("own"))
    met = a.join(b, ["frame", "band", "cell"]).filter(F.when(F.col("own"), F.col("oa") < F.col("ob")).otherwise(F.col("oa") != F.col("ob")))
    first = F.col("oa") < F.col("ob")
    side = lambda one, other: F.when(first, F.col(one)).otherwise(F.col(other))
    m = haversine_m(side("ax", "bx"), side("ay", "by"), side("bx", "ax"), side("by", "ay"), legacy_axes)
    return met.withColumn("metres", m).filter(F.col("metres") < radius_m).select("frame", F.least("oa", "ob").alias("src"), F.greatest("oa", "ob").alias("dst"), "metres")


def area_bounds(areas: DataFrame, radius_m: float) -> DataFrame:
    """Bounding boxes of circles about area centres: west, east, south, north."""
    dy = F.lit(radius_m / METRES_PER_DEGREE)
    dx = dy / F.greatest(F.lit(0.01), F.cos(F.radians(F.col("lat"))))
    return areas.select("area_id", (F.col("lon") - dx).alias("west"), (F.col("lon") + dx).alias("east"), (F.col("lat") - dy).alias("south"), (F.col("lat") + dy).alias("north"))


def classify_areas(df: DataFrame, areas: DataFrame, radius_m: float = 2000.0, s: Spec = AIS) -> DataFrame:
    """Adds area_id (the last area, by id, that holds the point) and label (-1 inside, 0 outside; later duplicates of object and time get 0).
    Areas go to the cells around them, a point looks up the list of its own cell: no row is multiplied. Few areas are broadcast after a count; many meet the points
    in a shuffle."""
    g = Grid(radius_m)
    grid = areas.select(F.col("area_id").alias("a"), F.col("lon").alias("x"), F.col("lat").alias("y")).withColumn("_band", F.explode(F.array(*[g.band(F.col("y")) + i for i in (-1, 0, 1)])))
    grid = grid.withColumn("_cell", F.explode(g.around(F.col("x"), F.col("_band")))).groupBy("_band", "_cell").agg(F.collect_list(F.struct("a", "x", "y")).alias("_near"))  # the areas around a cell
    if areas.limit(BROADCAST_AREAS + 1).count() <= BROADCAST_AREAS:
        grid = F.broadcast(grid)
    d = df.withColumn("_band", g.band(F.col(s.lat))).withColumn("_cell", g.cell(F.col(s.lon), F.col("_band"))).join(grid, ["_band", "_cell"], "left")
    here = F.filter("_near", lambda p: haversine_m(s.lon, s.lat, p["x"], p["y"]) <= radius_m)
    d = d.withColumn("area_id", F.array_max(F.transform(here, lambda p: p["a"]))).drop("_band", "_cell", "_near")
    again = F.coalesce(F.lag(s.ts).over(Window.partitionBy(s.oid).orderBy(s.ts, *s.tie)) == F.col(s.ts), F.lit(False))
    return d.withColumn("label", F.when(F.col("area_id").isNotNull() & ~again, -1).otherwise(0))


def nearest_area(df: DataFrame, areas: DataFrame, s: Spec = AIS, block: int = BROADCAST_AREAS) -> DataFrame:
    """Adds nearest: the least planar distance, in degrees, to any area (null without areas). Areas are folded into arrays of about `block` each, one broadcast row
    per array, and the rows pass by all of them."""
    blocks = max(1, -(-areas.count() // block))
    d = lambda p: F.sqrt((p["lon"] - F.col(s.lon)) * (p["lon"] - F.col(s.lon)) + (p["lat"] - F.col(s.lat)) * (p["lat"] - F.col(s.lat)))
    out = df.withColumn("nearest", F.lit(None).cast("double"))
    for i in range(blocks):
        here = areas.filter(F.pmod(F.xxhash64("lon", "lat"), F.lit(blocks)) == i)
        pts = here.agg(F.sort_array(F.collect_list(F.struct("lon", "lat"))).alias("_p"))
        out = out.crossJoin(F.broadcast(pts)).withColumn("nearest", F.least("nearest", F.array_min(F.transform("_p", d)))).drop("_p")
    return out


def in_polygons(df: DataFrame, polygons: DataFrame, s: Spec = AIS) -> DataFrame:
    """(row, area_id) of points inside rings (area_id, ring ARRAY<STRUCT<x, y>>), by ray casting; boxes are tested first."""
    r = polygons.select("area_id", "ring", *[f("ring." + c).alias(n) for c, f, n in (("x", F.array_min, "_w"), ("x", F.array_max, "_e"), ("y", F.array_min, "_s"), ("y", F.array_max, "_n"))])
    x, y = F.col(s.lon), F.col(s.lat)
    box = (x >= F.col("_w")) & (x <= F.col("_e")) & (y >= F.col("_s")) & (y <= F.col("_n"))
    turn = F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", 1, 1))
    cross = F.zip_with("ring", turn, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0))
    return df.join(F.broadcast(r), box).filter(F.aggregate(cross, F.lit(0), lambda t, v: t + v) % 2 == 1).drop("ring", "_w", "_e", "_s", "_n")
