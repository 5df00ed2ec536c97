"""Geometry as Column expressions over lon/lat pairs, Mercator metres and vertex arrays.

A ring is array<struct<x double, y double>>; a polygon is array<ring>, the outer ring first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MERCATOR = 6378137.0
#: Axial neighbours of a hexagon.
HEX_STEPS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.sqrt(F.pow(lon2 - lon1, 2) + F.pow(lat2 - lat1, 2)) * 111.0


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERCATOR


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / MERCATOR)) * 2 - math.pi / 2)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees clockwise from north, in the plane of the coordinates."""
    angle = F.degrees(F.atan2(lon2 - lon1, lat2 - lat1))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def cardinal(degrees: Column) -> Column:
    return F.when((degrees >= 315) | (degrees < 45), "North").when(degrees < 135, "East").when(degrees < 225, "South").otherwise("West")


def snap(value: Column, step: float) -> Column:
    return F.round(value / step) * step


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs (a, b); the ring closes itself."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def polygon_area(rings: Column) -> Column:
    """Outer ring less holes, in square units of the coordinates."""
    return F.aggregate(rings, F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s")), lambda a, r: F.struct((a["i"] + 1).alias("i"), (a["s"] + F.when(a["i"] == 0, 1).otherwise(-1) * F.abs(signed_area(r))).alias("s")), lambda a: a["s"])


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid as struct(x, y); the mean vertex for rings without area."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    sums = F.aggregate(
        _edges(ring), F.struct(*(F.lit(0.0).alias(k) for k in ("x", "y", "w"))),
        lambda s, e: F.struct((s["x"] + (e["a"]["x"] + e["b"]["x"]) * cross(e)).alias("x"), (s["y"] + (e["a"]["y"] + e["b"]["y"]) * cross(e)).alias("y"), (s["w"] + cross(e)).alias("w")),
    )
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, v: s + v[k]) / F.size(ring)
    return F.when(sums["w"] == 0, F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(F.struct((sums["x"] / (3 * sums["w"])).alias("x"), (sums["y"] / (3 * sums["w"])).alias("y")))


def line_length(line: Column) -> Column:
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e["a"]["x"] - e["b"]["x"], 2) + F.pow(e["a"]["y"] - e["b"]["y"], 2)))


def segments(line: Column) -> Column:
    """Consecutive vertex pairs as structs (x1, y1, x2, y2)."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over all rings, so that holes count; edges are half open: y1 <= y < y2."""

    def crossings(ring: Column) -> Column:
        def hit(e: Column) -> Column:
            y1, y2 = e["a"]["y"], e["b"]["y"]
            across = ((y1 <= y) & (y < y2)) | ((y2 <= y) & (y < y1))
            return F.when(across & (x < e["a"]["x"] + (y - y1) / (y2 - y1) * (e["b"]["x"] - e["a"]["x"])), 1).otherwise(0)

        return F.aggregate(_edges(ring), F.lit(0), lambda s, e: s + hit(e))

    return F.aggregate(rings, F.lit(0), lambda s, r: s + crossings(r)) % 2 == 1


def bounds(rings: Column) -> Column:
    all_ = F.flatten(rings)
    at = lambda k: F.transform(all_, lambda v: v[k])
    return F.struct(F.array_min(at("x")).alias("x0"), F.array_min(at("y")).alias("y0"), F.array_max(at("x")).alias("x1"), F.array_max(at("y")).alias("y1"))


def clean_ring(ring: Column) -> Column:
    """Without vertices equal to the one before or a closing repeat of the first, counter-clockwise."""
    kept = F.filter(ring, lambda v, i: (i == 0) | (v != F.get(ring, i - 1)))
    kept = F.when((F.size(kept) > 1) & (kept[0] == F.element_at(kept, -1)), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    return F.when(signed_area(kept) < 0, F.reverse(kept)).otherwise(kept)


def hex_q_r(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon (edge `size`) that holds a Mercator point, by cube rounding."""
    q, r = (x * math.sqrt(3) / 3 - y / 3) / size, y * 2 / 3 / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when((dr > ds) & ~((dq > dr) & (dq > ds)), -rq - rs).otherwise(rr).cast("long")


def cell_id(lon: Column, lat: Column, size: float) -> Column:
    q, r = hex_q_r(mercator_x(lon), mercator_y(lat), size)
    return F.concat_ws(":", q.cast("string"), r.cast("string"))


def cell_axial(cell: Column) -> tuple[Column, Column]:
    parts = F.split(cell, ":")
    return parts[0].cast("long"), parts[1].cast("long")


def cell_center(cell: Column, size: float) -> Column:
    """struct(lon, lat) of a cell's centre."""
    q, r = cell_axial(cell)
    return F.struct(mercator_lon((q + r / 2) * math.sqrt(3) * size).alias("lon"), mercator_lat(r * 1.5 * size).alias("lat"))


def cell_boundary(cell: Column, size: float) -> Column:
    q, r = cell_axial(cell)
    x, y = (q + r / 2) * math.sqrt(3) * size, r * 1.5 * size
    corner = [(math.cos(math.pi / 180 * (60 * i - 30)) * size, math.sin(math.pi / 180 * (60 * i - 30)) * size) for i in range(6)]
    return F.array(*(F.struct(mercator_lon(x + dx).alias("x"), mercator_lat(y + dy).alias("y")) for dx, dy in corner))


def cell_ring(cell: Column, k: int) -> Column:
    """Ids of all cells at most `k` steps away, the cell included."""
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a + b) <= k))
    move = lambda p, i, by: (p[i].cast("long") + by).cast("string")
    # `cell` is there once: a copy of its expression for each step would make a plan of many MB.
    return F.transform(F.array(F.split(cell, ":")), lambda p: F.transform(near, lambda o: F.concat_ws(":", move(p, 0, o["a"]), move(p, 1, o["b"]))))[0]


def cell_area_km2(lat: Column, size: float) -> Column:
    """Area of a hexagon of Mercator edge `size` at a latitude."""
    return F.lit(3 * math.sqrt(3) / 2 * size * size / 1e6) * F.pow(F.cos(F.radians(lat)), 2)
