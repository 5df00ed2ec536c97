"""Spatial joins through equal coarse cells, each with an exact test afterwards; nearest matches; contiguity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.functions import geo as g

#: Edge of the coarse cells in degrees.
CELL = 0.02
#: Keys of rows at one place that are kept in a list. A task holds the rows of two lists' pairs at once, which takes more time the more they are.
SLICE = 32


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def cover(polygons: DataFrame, rings: str, size: float) -> DataFrame:
    """A row for each polygon and coarse cell that its bounding box meets, with columns cx and cy."""
    b = g.bounds(F.col(rings))
    cells = lambda lo, hi: F.explode(F.sequence(_cell(b[lo], size), _cell(b[hi], size)))
    return polygons.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, lon: str = "lon", lat: str = "lat", rings: str = "rings", how: str = "inner", key: str = "point_id", size: float = CELL) -> DataFrame:
    """Points joined to the polygons that hold them; with how="left" points in none have null polygon columns."""
    at = points.withColumn("cx", _cell(F.col(lon), size)).withColumn("cy", _cell(F.col(lat), size))
    found = at.join(cover(polygons, rings, size), ["cx", "cy"]).where(g.contains(F.col(rings), F.col(lon), F.col(lat))).drop("cx", "cy", rings)
    if how == "inner":
        return found
    columns = [c for c in polygons.columns if c != rings]
    return points.join(found.select(key, *columns), key, "left")


def nearest(points: DataFrame, targets: DataFrame, *, key: str, target: str, lon: str = "lon", lat: str = "lat", out: str = "km", broadcast_rows: int = 2_000) -> DataFrame:
    """(key, target, km): each point's nearest target, ties to the least target. No targets: no rows.

    Up to `broadcast_rows` targets are compared with every point. More are met through cells, at first of about four
    targets each: a point looks into its own cell, or that of the targets' extent nearest to it, and the eight around. What
    it finds within one cell's width can't be beaten from outside; points without such a find look into cells four times
    as wide, until a cell holds all targets. Of targets at one place the least stands for all, and points at one place look once.
    """
    from urban_spark.operators.graph import _cut

    t = targets.select(target, F.col(lon).alias("_tx"), F.col(lat).alias("_ty")).groupBy("_tx", "_ty").agg(F.min(target).alias(target))
    p = points.select(key, F.col(lon).alias("_px"), F.col(lat).alias("_py"))
    km = g.haversine_km(F.col("_px"), F.col("_py"), F.col("_tx"), F.col("_ty"))
    best = lambda df: df.groupBy(key).agg(F.min(F.struct(km.alias("km"), F.col(target).alias("t"))).alias("_b")).select(key, F.col("_b.t").alias(target), F.col("_b.km").alias(out))
    if t.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return best(p.join(F.broadcast(t)))
    t = _cut(t)
    count, x0, x1, y0, y1 = t.agg(F.count(F.lit(1)), F.min("_tx"), F.max("_tx"), F.min("_ty"), F.max("_ty")).collect()[0]
    extent = max(x1 - x0, y1 - y0, 1e-9)
    size = max(math.sqrt(max((x1 - x0) * (y1 - y0), 1e-18) * 4 / count), extent / 4096)
    done, left = [], p.select("_px", "_py").distinct().where("_px IS NOT NULL AND _py IS NOT NULL")
    while True:
        last = size > extent
        low, high = (math.floor(x0 / size), math.floor(y0 / size)), (math.floor(x1 / size), math.floor(y1 / size))
        inside = lambda c, i: F.greatest(F.lit(low[i]), F.least(F.lit(high[i]), _cell(F.col(c), size)))  # noqa: E731, B023
        around = lambda c, i: F.explode(F.sequence(inside(c, i) - 1, inside(c, i) + 1))  # noqa: E731, B023
        near = left.withColumn("cx", around("_px", 0)).withColumn("cy", around("_py", 1))
        placed = t.withColumn("cx", _cell(F.col("_tx"), size)).withColumn("cy", _cell(F.col("_ty"), size))
        reach = size * 111.0 * F.greatest(F.lit(0.0), F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("_py")) + size))))
        found = near.join(placed, ["cx", "cy"]).groupBy("_px", "_py").agg(F.min(F.struct(km.alias("km"), F.col(target).alias("t"))).alias("_b"))
        found = _cut(found.select("_px", "_py", F.col("_b.t").alias(target), F.col("_b.km").alias(out), (F.lit(last) | (F.col("_b.km") <= reach)).alias("_sure")))
        done.append(found.where("_sure").select("_px", "_py", target, out))
        if last:
            break
        left = left.join(done[-1].select("_px", "_py"), ["_px", "_py"], "left_anti")
        if found.where("NOT _sure").isEmpty():  # those without any find are still to come
            left = _cut(left)
            if left.isEmpty():
                break
        size *= 4
    return p.distinct().join(reduce(DataFrame.unionByName, done), ["_px", "_py"]).select(key, target, out)


def join_with_nearest(points: DataFrame, polygons: DataFrame, *, key: str, polygon: str, rings: str = "rings", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, polygon, method): the polygon that holds a point (the least of several), else that with the nearest centroid."""
    inside = points_in_polygons(points, polygons, rings=rings, key=key, lon=lon, lat=lat).groupBy(key).agg(F.min(polygon).alias(polygon)).withColumn("method", F.lit("within"))
    centers = polygons.withColumn("_c", g.ring_centroid(F.col(rings)[0])).select(polygon, F.col("_c.x").alias(lon), F.col("_c.y").alias(lat))
    outside = points.join(inside, key, "left_anti")
    near = nearest(outside, centers, key=key, target=polygon, lon=lon, lat=lat).select(key, polygon, F.lit("nearest").alias("method"))
    return inside.unionByName(near)


def lattice(rings: Column, step: float) -> Column:
    """Lattice points (multiples of `step`) inside a polygon, as structs (x, y)."""
    b = g.bounds(rings)
    along = lambda lo, hi: F.sequence(F.ceil(b[lo] / step).cast("long"), F.floor(b[hi] / step).cast("long"))
    grid = F.flatten(F.transform(along("x0", "x1"), lambda i: F.transform(along("y0", "y1"), lambda j: F.struct((i * step).alias("x"), (j * step).alias("y")))))
    return F.filter(grid, lambda v: g.contains(rings, v["x"], v["y"]))


def cell_shares(polygons: DataFrame, *, key: str, step: float, size: float, rings: str = "rings") -> DataFrame:
    """(key, cell, points, share): the hexagons (Mercator edge `size`) that hold lattice points of a polygon, and their share of its points; shares of a polygon add
    up to 1, and a hexagon across a border has a share of each side. Polygons between the lattice's points have no row; `step` should be well below `size`."""
    points = polygons.select(key, F.explode(lattice(F.col(rings), step)).alias("_v"))
    counts = points.groupBy(key, g.cell_id(F.col("_v.x"), F.col("_v.y"), size).alias("cell")).agg(F.count(F.lit(1)).alias("points"))
    totals = counts.groupBy(key).agg(F.sum("points").alias("_all"))
    return counts.join(totals, key).select(key, "cell", "points", (F.col("points") / F.col("_all")).alias("share"))


def assign_polygons(small: DataFrame, large: DataFrame, *, key: str, to: str, rings: str = "rings", step: float = 0.01) -> DataFrame:
    """(key, to, share, method): the polygon with most of a polygon's lattice points (`within` if all, else `overlap`), else
    that with the nearest centroid. Overlap is counted on a lattice of `step`, not cut exactly."""
    points = small.select(key, F.explode(lattice(F.col(rings), step)).alias("v")).select(key, F.col("v.x").alias("lon"), F.col("v.y").alias("lat"))
    total = points.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counts = points_in_polygons(points, large.select(to, rings), key=key).groupBy(key, to).agg(F.count(F.lit(1)).alias("_k"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("_k")).alias("k"), F.col(to).alias("t"))).alias("_b")).join(total, key)
    share = -F.col("_b.k") / F.col("_n")
    overlap = best.select(key, F.col("_b.t").alias(to), share.alias("share"), F.when(share == 1, "within").otherwise("overlap").alias("method"))
    rest = small.join(overlap, key, "left_anti").withColumn("_c", g.ring_centroid(F.col(rings)[0])).select(key, F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat"))
    centers = large.withColumn("_c", g.ring_centroid(F.col(rings)[0])).select(to, F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat"))
    near = nearest(rest, centers, key=key, target=to).select(key, to, F.lit(0.0).alias("share"), F.lit("nearest").alias("method"))
    return overlap.unionByName(near)


def within_distance(a: DataFrame, *, key: str, km: float, lon: str = "lon", lat: str = "lat", digits: int | None = None) -> DataFrame:
    """(src, dst, km) for pairs of rows at most `km` apart, src < dst, through cells no smaller than the distance; km rounded to `digits`.

    Rows at one place go as lists of up to SLICE keys, so that a distance is computed once for all pairs of two lists; no side is broadcast.
    """
    size = km / 100.0
    at = a.select(F.col(key).alias("_k"), F.col(lon).alias("_x"), F.col(lat).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    at = at.withColumn("_n", F.floor((F.row_number().over(Window.partitionBy("_x", "_y").orderBy("_k")) - 1) / SLICE))
    slices = at.groupBy("_x", "_y", "_n").agg(F.collect_list("_k").alias("_k"))
    side = lambda i: slices.select(F.struct("_x", "_y", "_n").alias(f"_s{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("_k", "_x", "_y")))
    left = side(1).withColumn("cx", _cell(F.col("_x1"), size)).withColumn("cy", _cell(F.col("_y1"), size))
    wide = F.ceil(1 / F.greatest(F.lit(0.1), F.cos(F.radians(F.abs(F.col("_y2")))))).cast("long")
    right = side(2).withColumn("cx", F.explode(F.sequence(_cell(F.col("_x2"), size) - wide, _cell(F.col("_x2"), size) + wide)))
    right = right.withColumn("cy", F.explode(F.sequence(_cell(F.col("_y2"), size) - 1, _cell(F.col("_y2"), size) + 1)))
    d = g.haversine_km(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2"))
    near = left.hint("merge").join(right, ["cx", "cy"]).where("_s1 <= _s2").withColumn("km", d).where(F.col("km") <= km)
    near = near.select("_k1", "_k2", (F.col("km") if digits is None else F.round("km", digits) + F.lit(0.0)).alias("km"), (F.col("_s1") == F.col("_s2")).alias("_same"))
    pairs = near.withColumn("_a", F.explode("_k1")).drop("_k1").withColumn("_b", F.explode("_k2")).drop("_k2").where("_a < _b OR (_a > _b AND NOT _same)")
    return pairs.select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "km")


def queen_neighbours(polygons: DataFrame, *, key: str, rings: str = "rings", digits: int = 7) -> DataFrame:
    """(src, dst): polygons that share a vertex, coordinates rounded."""
    vertices = polygons.select(key, F.explode(F.flatten(rings)).alias("v")).select(key, F.round("v.x", digits).alias("x"), F.round("v.y", digits).alias("y")).distinct()
    a, b = vertices.withColumnRenamed(key, "src"), vertices.withColumnRenamed(key, "dst")
    return a.join(b, ["x", "y"]).where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def covering_cells(polygons: DataFrame, *, key: str, size: float, rings: str = "rings") -> DataFrame:
    """(key, cell): hexagons (Mercator edge `size`) whose centre a polygon holds."""
    b = g.bounds(F.col(rings))
    x0, x1, y0, y1 = (f(b[k]) for f, k in ((g.mercator_x, "x0"), (g.mercator_x, "x1"), (g.mercator_y, "y0"), (g.mercator_y, "y1")))
    rows = polygons.withColumn("r", F.explode(F.sequence(F.floor(y0 / (1.5 * size)).cast("long"), F.ceil(y1 / (1.5 * size)).cast("long"))))
    wide = math.sqrt(3) * size
    rows = rows.withColumn("q", F.explode(F.sequence(F.floor(x0 / wide - F.col("r") / 2).cast("long"), F.ceil(x1 / wide - F.col("r") / 2).cast("long"))))
    rows = rows.withColumn("cell", F.concat_ws(":", F.col("q").cast("string"), F.col("r").cast("string")))
    c = g.cell_center(F.col("cell"), size)
    return rows.where(g.contains(F.col(rings), c["lon"], c["lat"])).select(key, "cell")


def snap_ends(lines: DataFrame, nodes: DataFrame, *, key: str, line: str, most_km: float) -> DataFrame:
    """(key, end, node, km): the nearest node of each line end within `most_km`, null beyond."""
    ends = lines.select(key, F.explode(F.array(F.struct(F.lit("first").alias("end"), F.col(line)[0].alias("v")), F.struct(F.lit("last").alias("end"), F.element_at(line, -1).alias("v")))).alias("e"))
    ends = ends.select(F.struct(key, F.col("e.end").alias("end")).alias("_k"), F.col("e.v.x").alias("lon"), F.col("e.v.y").alias("lat"))
    found = nearest(ends, nodes, key="_k", target="node")
    near = F.col("km") <= most_km
    return found.select(F.col(f"_k.{key}").alias(key), F.col("_k.end").alias("end"), F.when(near, F.col("node")).alias("node"), F.when(near, F.col("km")).alias("km"))


def name_sectors(sectors: DataFrame, *, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, name): the sector nearest the mean of all is Central; the others are named by their bearing from it, and of those
    that share a name the nearest has it, the next ones with a number."""
    mean = sectors.agg(F.avg(lon).alias("_mx"), F.avg(lat).alias("_my")).withColumn("_one", F.lit(1))
    rows = sectors.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")
    d = F.pow(F.col(lon) - F.col("_mx"), 2) + F.pow(F.col(lat) - F.col("_my"), 2)
    center = rows.agg(F.min(F.struct(d.alias("d"), F.col(key).alias("k"), F.col(lon).alias("x"), F.col(lat).alias("y"))).alias("_c")).withColumn("_one", F.lit(1))
    named = rows.join(F.broadcast(center), "_one").withColumn("_b", g.cardinal(g.bearing(F.col("_c.x"), F.col("_c.y"), F.col(lon), F.col(lat))))
    base = F.when(F.col(key) == F.col("_c.k"), "Central").otherwise(F.col("_b"))
    placed = named.withColumn("_b", base).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(d, key)))
    return placed.select(key, F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat_ws(" ", "_b", F.col("_n").cast("string"))).alias("name"))


def group_polygons(polygons: DataFrame, by: str, *, rings: str = "rings") -> DataFrame:
    """One multi-part feature for each name; inner borders stay."""
    return polygons.groupBy(by).agg(F.flatten(F.collect_list(rings)).alias(rings), F.count(F.lit(1)).alias("parts"))


def nearest_pairs(a: DataFrame, k: int, *, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(src, dst, km): each row's k nearest others, ties to the least key; all others where there are fewer. Keys are distinct.

    Rows look into their own cell and the eight around, at first cells so small that occupied ones hold about eight rows, and keep the k best. If the last of
    these is within a cell's width it can't be beaten from outside; the other rows look into cells twice as wide, until one holds all. Of
    rows at one place the first k + 1 stand for all, so that places with many rows are no hot cells.
    """
    from urban_spark.operators.graph import _cut

    if k < 1:
        raise ValueError("k must be positive")
    rows = _cut(a.select(F.col(key).alias("src"), F.col(lon).cast("double").alias("_px"), F.col(lat).cast("double").alias("_py")).where("_px IS NOT NULL AND _py IS NOT NULL"))
    first = F.row_number().over(Window.partitionBy("_px", "_py").orderBy("src"))
    stand = _cut(rows.withColumn("_n", first).where(F.col("_n") <= k + 1).select(F.col("src").alias("dst"), F.col("_px").alias("_tx"), F.col("_py").alias("_ty")))
    count, x0, x1, y0, y1 = stand.agg(F.count(F.lit(1)), F.min("_tx"), F.max("_tx"), F.min("_ty"), F.max("_ty")).collect()[0]
    if not count:
        return rows.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("km")).limit(0)
    extent = max(x1 - x0, y1 - y0, 1e-9)
    size = extent
    while size > extent / (1 << 20):
        if count <= 8 * stand.select(_cell(F.col("_tx"), size), _cell(F.col("_ty"), size)).distinct().count():
            break
        size /= 2
    d = g.haversine_km(F.col("_px"), F.col("_py"), F.col("_tx"), F.col("_ty"))
    best = Window.partitionBy("src").orderBy("km", "dst")
    done, left = [], rows
    while True:
        last = size > extent
        # Near a pole or across all longitudes a cell's width says nothing; only the last cells settle such rows.
        reach = size * 111.0 * F.greatest(F.lit(0.0), F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("_py")) + size))))
        near = left.withColumn("cx", F.explode(F.sequence(_cell(F.col("_px"), size) - 1, _cell(F.col("_px"), size) + 1)))
        near = near.withColumn("cy", F.explode(F.sequence(_cell(F.col("_py"), size) - 1, _cell(F.col("_py"), size) + 1)))
        placed = stand.withColumn("cx", _cell(F.col("_tx"), size)).withColumn("cy", _cell(F.col("_ty"), size))
        found = near.join(placed, ["cx", "cy"]).where("src <> dst").withColumn("km", d).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
        full = F.max(F.when((F.col("_n") == k) & (F.col("km") <= reach), 1).otherwise(0)).over(Window.partitionBy("src"))
        found = _cut(found.withColumn("_sure", F.lit(last) | (full == 1)).select("src", "dst", "km", "_sure"))
        done.append(found.where("_sure").select("src", "dst", "km"))
        if last:
            return reduce(DataFrame.unionByName, done)
        left = _cut(left.join(done[-1].select("src").distinct(), "src", "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        size *= 2


def _crossed(polygons: DataFrame, key: str, rings: str, size: float) -> DataFrame:
    """(key, x1, y1, x2, y2, cx, cy): the edges of polygons in each cell that they run through, column by column."""
    edge = polygons.select(key, F.explode(F.flatten(F.transform(rings, g._edges))).alias("e"))
    rows = edge.select(key, *(F.col(f"e.{end}.{c}").alias(f"{c}{i}") for i, end in ((1, "a"), (2, "b")) for c in "xy"))
    pad = size * 1e-6  # what only touches a cell's border is in the cells on both sides
    rows = rows.withColumn("cx", F.explode(F.sequence(_cell(F.least("x1", "x2") - pad, size), _cell(F.greatest("x1", "x2") + pad, size))))
    dx = F.col("x2") - F.col("x1")
    at = lambda x: F.col("y1") + (x - F.col("x1")) / F.nullif(dx, F.lit(0.0)) * (F.col("y2") - F.col("y1"))
    within = lambda y: F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2"))
    steep, here, there = F.abs(dx) <= pad, within(at(F.col("cx") * size - pad)), within(at((F.col("cx") + 1) * size + pad))
    low, high = F.when(steep, F.least("y1", "y2")).otherwise(F.least(here, there)), F.when(steep, F.greatest("y1", "y2")).otherwise(F.greatest(here, there))
    return rows.withColumn("cy", F.explode(F.sequence(_cell(low - pad, size), _cell(high + pad, size))))


def polygons_meet(a: DataFrame, b: DataFrame, *, key: str, to: str, rings: str = "rings", size: float = CELL) -> DataFrame:
    """(key, to) for each polygon of `a` and polygon of `b` that share a point, borders included: edges of theirs cross or touch, which is
    tested where both run through a cell, or a ring of one lies inside the other. Polygons are outer rings and holes, or several parts."""
    one = _crossed(a.select(key, rings), key, rings, size)
    two = _crossed(b.select(to, rings), to, rings, size).select(to, "cx", "cy", *(F.col(f"{c}{i}").alias(f"{c}{i + 2}") for i in (1, 2) for c in "xy"))
    side = lambda p, q, r: (F.col(f"x{q}") - F.col(f"x{p}")) * (F.col(f"y{r}") - F.col(f"y{p}")) - (F.col(f"y{q}") - F.col(f"y{p}")) * (F.col(f"x{r}") - F.col(f"x{p}"))
    apart = reduce(Column.__or__, (F.greatest(f"{c}1", f"{c}2") < F.least(f"{c}3", f"{c}4") for c in "xy")) | reduce(Column.__or__, (F.greatest(f"{c}3", f"{c}4") < F.least(f"{c}1", f"{c}2") for c in "xy"))
    across = (F.signum(side(1, 2, 3)) * F.signum(side(1, 2, 4)) <= 0) & (F.signum(side(3, 4, 1)) * F.signum(side(3, 4, 2)) <= 0)
    borders = one.join(two, ["cx", "cy"]).where(~apart & across).select(key, to)

    def inside(p: DataFrame, name: str, q: DataFrame) -> DataFrame:
        corners = p.select(name, F.explode(F.transform(rings, lambda r: F.get(r, F.lit(0)))).alias("v")).select(name, F.col("v.x").alias("lon"), F.col("v.y").alias("lat"))
        return points_in_polygons(corners, q, rings=rings, key=name, size=size).select(key, to)

    return borders.unionByName(inside(a.select(key, rings), key, b.select(to, rings))).unionByName(inside(b.select(to, rings), to, a.select(key, rings))).distinct()


def join_meeting(a: DataFrame, b: DataFrame, *, key: str, to: str, rings: str = "rings", size: float = CELL, nearest_left: bool = False) -> DataFrame:
    """(key, to, method) for all rows of `a`: each polygon of `b` that a polygon meets (`intersects`), else that which holds its centroid
    (`centroid`; the least of several), else with `nearest_left` that whose centroid is nearest (`nearest`), else `UNMAPPED`. `to` is a string."""
    met = polygons_meet(a, b, key=key, to=to, rings=rings, size=size)
    parts = [met.select(key, F.col(to).cast("string").alias(to), F.lit("intersects").alias("method"))]
    center = lambda df, name: df.withColumn("_c", g.ring_centroid(F.col(rings)[0])).select(name, F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat"))
    left = center(a.join(met, key, "left_anti"), key)
    held = points_in_polygons(left, b.select(to, rings), rings=rings, key=key, size=size).groupBy(key).agg(F.min(to).cast("string").alias(to))
    parts.append(held.withColumn("method", F.lit("centroid")))
    left = left.join(held, key, "left_anti")
    if nearest_left:
        near = nearest(left, center(b, to), key=key, target=to)
        parts.append(near.select(key, F.col(to).cast("string").alias(to), F.lit("nearest").alias("method")))
        left = left.join(near, key, "left_anti")
    parts.append(left.select(key, F.lit("UNMAPPED").alias(to), F.lit("UNMAPPED").alias("method")))
    return reduce(DataFrame.unionByName, parts)


def segment_graph(lines: DataFrame, line: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines: ends of segments snapped to a tolerance are nodes, named by their place; edges (src, dst,
    length) keep the shortest of parallel ones."""
    s = lines.select(F.explode(g.segments(F.col(line))).alias("s"))
    at = lambda x, y: F.concat_ws(",", F.round(F.col(x) / tolerance).cast("long").cast("string"), F.round(F.col(y) / tolerance).cast("long").cast("string"))
    length = F.sqrt(F.pow(F.col("s.x1") - F.col("s.x2"), 2) + F.pow(F.col("s.y1") - F.col("s.y2"), 2))
    rows = s.select(at("s.x1", "s.y1").alias("a"), at("s.x2", "s.y2").alias("b"), length.alias("length")).where("a <> b")
    edges = rows.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "length").groupBy("src", "dst").agg(F.min("length").alias("length"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes, edges


def repair_contiguity(areas: DataFrame, edges: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(id, zone): parts of a zone apart from its largest take, all at once in each round, the zone that most neighbours outside
    the part have (ties to the least zone). areas (id, zone), edges (src, dst) both ways."""
    from urban_spark.operators.graph import _cut, components

    areas = areas.select("id", "zone")
    for _ in range(rounds):
        z = areas.select(F.col("id").alias("src"), F.col("zone").alias("_a")), areas.select(F.col("id").alias("dst"), F.col("zone").alias("_b"))
        pairs = edges.join(z[0], "src").join(z[1], "dst")
        parts = components(areas, pairs.where("_a = _b").select("src", "dst"))
        sized = areas.join(parts, "id").groupBy("zone", "component").agg(F.count(F.lit(1)).alias("n"))
        main = sized.groupBy("zone").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("component").alias("c"))).alias("m")).select("zone", F.col("m.c").alias("component"))
        loose = areas.join(parts, "id").join(main, ["zone", "component"], "left_anti")
        votes = loose.select(F.col("id").alias("src"), "component").join(pairs.where("_a <> _b"), "src").groupBy("component", F.col("_b").alias("zone")).count()
        best = votes.groupBy("component").agg(F.min(F.struct((-F.col("count")).alias("c"), F.col("zone").alias("z"))).alias("v")).select("component", F.col("v.z").alias("_new"))
        moved = _cut(loose.join(best, "component").select("id", "_new"))
        if moved.isEmpty():
            return areas
        areas = _cut(areas.join(moved, "id", "left").select("id", F.coalesce("_new", "zone").alias("zone")))
    raise RuntimeError("zones did not settle")
