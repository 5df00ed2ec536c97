"""Queries over places: distances, cells, polygons and what they hold. Polygons are the squares around ward points."""

from __future__ import annotations


from pyspark.sql import functions as F

from urban_spark.functions import geo as g
from urban_spark.operators import agg as a
from urban_spark.operators import spatial as s
from urban_spark.operators.sizes import small
from urban_spark.plans.base import HOMES, SITES, WARDS, query, rounded, tabled

HALF = 0.03


def _km(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2)))))"


def _mx(x: str) -> str:
    return f"(radians({x}) * 6378137.0)"


def _my(y: str) -> str:
    return f"(ln(tan(radians({y}) / 2 + pi() / 4)) * 6378137.0)"


def _hex(x: str, y: str, size: float) -> tuple[str, str]:
    """DuckDB's axial coordinates, with the fractional ones in q0 and r0."""
    q0, r0 = f"(({_mx(x)} * sqrt(3.0) / 3 - {_my(y)} / 3) / {size}::DOUBLE)", f"({_my(y)} * 2 / 3 / {size}::DOUBLE)"
    return q0, r0


def cell_sql(source: str, columns: str, size: float) -> str:
    q0, r0 = _hex("lon", "lat", size)
    return f"""(SELECT {columns}, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dr > ds AND NOT (dq > dr AND dq > ds) THEN -rq - rs ELSE rr END AS BIGINT) AS r
  FROM (SELECT *, abs(rq - q0) AS dq, abs(rr - r0) AS dr, abs(rs - (-q0 - r0)) AS ds FROM (SELECT *, round_even(q0, 0) AS rq, round_even(r0, 0) AS rr, round_even(-q0 - r0, 0) AS rs FROM (SELECT *, {q0} AS q0, {r0} AS r0 FROM {source}))))"""


def squares(t, half: float = HALF):
    x, y = F.col("lon"), F.col("lat")
    corner = lambda dx, dy: F.struct((x + dx * half).alias("x"), (y + dy * half).alias("y"))
    return t.wards.select("ward", "sector", F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("rings"))


def _in(p: str, w: str) -> str:
    return f"{p}.lon >= {w}.lon - {HALF} AND {p}.lon < {w}.lon + {HALF} AND {p}.lat >= {w}.lat - {HALF} AND {p}.lat < {w}.lat + {HALF}"


@query("g1_haversine", f"WITH {WARDS}, {SITES} SELECT site, round({_km('s.lon', 's.lat', 'w.lon', 'w.lat')}, 6) AS km FROM sites s JOIN wards w USING (ward)")
@tabled
def g1(t):
    w = t.wards.select("ward", F.col("lon").alias("wx"), F.col("lat").alias("wy"))
    return rounded(t.sites.join(small(w), "ward").select("site", g.haversine_km(F.col("lon"), F.col("lat"), F.col("wx"), F.col("wy")).alias("km")), "km", digits=6)


@query("g2_planar_minutes", f"WITH {WARDS}, {SITES} SELECT site, round(sqrt(pow(w.lon - s.lon, 2) + pow(w.lat - s.lat, 2)) * 111.0 / 25.0 * 60, 6) AS minutes FROM sites s JOIN wards w USING (ward)")
@tabled
def g2(t):
    w = t.wards.select("ward", F.col("lon").alias("wx"), F.col("lat").alias("wy"))
    return rounded(t.sites.join(small(w), "ward").select("site", (g.planar_km(F.col("lon"), F.col("lat"), F.col("wx"), F.col("wy")) / 25.0 * 60).alias("minutes")), "minutes", digits=6)


@query("g3_mercator", f"WITH {HOMES} SELECT home, round({_mx('lon')}, 3) AS x, round({_my('lat')}, 3) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat FROM homes")
@tabled
def g3(t):
    df = t.homes.select("home", g.mercator_x(F.col("lon")).alias("x"), g.mercator_y(F.col("lat")).alias("y"))
    df = df.withColumns({"lon": g.mercator_lon(F.col("x")), "lat": g.mercator_lat(F.col("y"))})
    return rounded(rounded(df, "x", "y", digits=3), "lon", "lat", digits=9)


@query(
    "g4_g5_g7_polygon_measures",
    f"WITH {WARDS} SELECT ward, round(CAST({2 * HALF} * {2 * HALF} * 111 * 111 AS DOUBLE), 6) AS km2, round(lon, 6) AS cx, round(lat, 6) AS cy, round(lon - {HALF}, 9) AS x0, round(lat + {HALF}, 9) AS y1 FROM wards",
)
@tabled
def g4(t):
    r = F.col("rings")
    c, b = g.ring_centroid(r[0]), g.bounds(r)
    df = squares(t).select("ward", (g.polygon_area(r) * 111 * 111).alias("km2"), c["x"].alias("cx"), c["y"].alias("cy"), b["x0"].alias("x0"), b["y1"].alias("y1"))
    return rounded(rounded(df, "km2", "cx", "cy", digits=6), "x0", "y1", digits=9)


@query(
    "g6_g19_line_segments",
    "SELECT conv_id, turn, round(length, 6) AS length FROM (SELECT conv_id, turn, sqrt(pow(turn - lag(turn) OVER w, 2) + pow(length(text) - lag(length(text)) OVER w, 2)) AS length FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, length(text))) WHERE length IS NOT NULL",
)
@tabled
def g6(t):
    vertex = F.struct(F.col("turn").cast("double").alias("x"), F.length("text").cast("double").alias("y"))
    lines = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(vertex)).alias("line"))
    parts = lines.select("conv_id", F.explode(g.segments(F.col("line"))).alias("p"))
    line = F.array(F.struct(F.col("p.x1").alias("x"), F.col("p.y1").alias("y")), F.struct(F.col("p.x2").alias("x"), F.col("p.y2").alias("y")))
    return rounded(parts.select("conv_id", F.col("p.x2").cast("long").alias("turn"), g.line_length(line).alias("length")), "length", digits=6)


@query("g8_cell_of_point", f"WITH {HOMES} SELECT home, CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS cell FROM {cell_sql('homes', 'home', 800)}")
@tabled
def g8(t):
    return t.homes.select("home", g.cell_id(F.col("lon"), F.col("lat"), 800).alias("cell"))


@query(
    "g9_g14_cell_center",
    f"WITH {HOMES}, c AS (SELECT DISTINCT q, r FROM {cell_sql('homes', 'home', 800)}), m AS (SELECT q, r, degrees((q + r / 2.0::DOUBLE) * sqrt(3.0) * 800 / 6378137.0) AS lon, degrees(atan(exp(r * 1.5 * 800 / 6378137.0)) * 2 - pi() / 2) AS lat FROM c) SELECT CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS cell, round(lon, 9) AS lon, round(lat, 9) AS lat, round(3 * sqrt(3.0) / 2 * 640000 / 1e6 * pow(cos(radians(lat)), 2), 9) AS km2 FROM m",
)
@tabled
def g9(t):
    cells = t.homes.select(g.cell_id(F.col("lon"), F.col("lat"), 800).alias("cell")).distinct().withColumn("c", g.cell_center(F.col("cell"), 800))
    return rounded(cells.select("cell", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"), g.cell_area_km2(F.col("c.lat"), 800).alias("km2")), "lon", "lat", "km2", digits=9)


@query(
    "g11_n12_cell_ring",
    f"WITH {SITES}, c AS (SELECT site, q, r FROM {cell_sql('sites', 'site', 2000)}) SELECT CAST(q + a AS VARCHAR) || ':' || CAST(r + b AS VARCHAR) AS cell, count(*) AS sites FROM c, range(-2, 3) x(a), range(-2, 3) y(b) WHERE abs(a + b) <= 2 GROUP BY 1",
)
@tabled
def g11(t):
    cells = t.sites.select(g.cell_id(F.col("lon"), F.col("lat"), 2000).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("sites"))
    return cells.select(F.explode(g.cell_ring(F.col("cell"), 2)).alias("cell"), "sites").groupBy("cell").agg(F.sum("sites").alias("sites"))


@query(
    "g12_covering_cells",
    f"""WITH {WARDS}, n AS (SELECT ward, lon, lat, CAST(unnest(range(CAST(floor({_my(f'(lat - {HALF})')} / 3000) AS BIGINT) - 1, CAST(ceil({_my(f'(lat + {HALF})')} / 3000) AS BIGINT) + 2)) AS BIGINT) AS r FROM wards),
m AS (SELECT *, CAST(unnest(range(CAST(floor({_mx(f'(lon - {HALF})')} / (sqrt(3.0) * 2000) - r / 2.0) AS BIGINT) - 1, CAST(ceil({_mx(f'(lon + {HALF})')} / (sqrt(3.0) * 2000) - r / 2.0) AS BIGINT) + 2)) AS BIGINT) AS q FROM n),
k AS (SELECT *, degrees((q + r / 2.0::DOUBLE) * sqrt(3.0) * 2000 / 6378137.0) AS x, degrees(atan(exp(r * 1.5 * 2000 / 6378137.0)) * 2 - pi() / 2) AS y FROM m)
SELECT ward, CAST(q AS VARCHAR) || ':' || CAST(r AS VARCHAR) AS cell FROM k WHERE x >= lon - {HALF} AND x < lon + {HALF} AND y >= lat - {HALF} AND y < lat + {HALF}""",
)
@tabled
def g12(t):
    return s.covering_cells(squares(t), key="ward", size=2000)


@query("g15_bearing", f"WITH {SITES}, b AS (SELECT site, degrees(atan2(lon - 77.6, lat - 12.95)) AS d FROM sites), c AS (SELECT site, CASE WHEN d < 0 THEN d + 360 ELSE d END AS d FROM b) SELECT site, round(d, 6) AS bearing, CASE WHEN d >= 315 OR d < 45 THEN 'North' WHEN d < 135 THEN 'East' WHEN d < 225 THEN 'South' ELSE 'West' END AS sector FROM c")
@tabled
def g15(t):
    d = g.bearing(F.lit(77.6), F.lit(12.95), F.col("lon"), F.col("lat"))
    return rounded(t.sites.select("site", d.alias("bearing"), g.cardinal(d).alias("sector")), "bearing", digits=6)


@query("g18_snap", f"WITH {HOMES} SELECT home, round(round(lon / 0.005) * 0.005, 9) AS x, round(round(lat / 0.005) * 0.005, 9) AS y FROM homes")
@tabled
def g18(t):
    return rounded(t.homes.select("home", g.snap(F.col("lon"), 0.005).alias("x"), g.snap(F.col("lat"), 0.005).alias("y")), "x", "y", digits=9)


@query("g20_g22_offsets_and_connectors", f"WITH {WARDS} SELECT w.ward, round(w.lon + dx, 6) AS x, round(w.lat + dy, 6) AS y, round({_km('77.6', '12.95', 'w.lon + dx', 'w.lat + dy')}, 6) AS km FROM wards w JOIN (VALUES (0, 0.01::DOUBLE, 0.0::DOUBLE), (1, 0.0, 0.01), (2, -0.01, 0.0)) o(sector, dx, dy) USING (sector)")
@tabled
def g20(t):
    offsets = t.spark.createDataFrame([(0, 0.01, 0.0), (1, 0.0, 0.01), (2, -0.01, 0.0)], "sector int, dx double, dy double")
    placed = t.wards.join(small(offsets), "sector").select("ward", (F.col("lon") + F.col("dx")).alias("x"), (F.col("lat") + F.col("dy")).alias("y"))
    return rounded(placed.withColumn("km", g.haversine_km(F.lit(77.6), F.lit(12.95), F.col("x"), F.col("y"))), "x", "y", "km", digits=6)


@query("g21_extreme_vertex", f"WITH {WARDS} SELECT ward, round(CASE WHEN lon < 77.6 THEN lon + {HALF} ELSE lon - {HALF} END, 6) AS x, round(CASE WHEN lat < 12.95 THEN lat + {HALF} ELSE lat - {HALF} END, 6) AS y FROM wards WHERE abs(lon - 77.6) > 1e-9 AND abs(lat - 12.95) > 1e-9")
@tabled
def g21(t):
    v = squares(t).select("ward", F.explode(F.flatten("rings")).alias("v"))
    d = F.pow(F.col("v.x") - 77.6, 2) + F.pow(F.col("v.y") - 12.95, 2)
    found = v.groupBy("ward").agg(F.min_by("v", d).alias("v")).select("ward", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    keep = t.wards.where((F.abs(F.col("lon") - 77.6) > 1e-9) & (F.abs(F.col("lat") - 12.95) > 1e-9)).select("ward")
    return rounded(found.join(keep, "ward", "left_semi"), "x", "y", digits=6)


@query("j1_point_in_polygon", f"WITH {WARDS}, {HOMES} SELECT h.home, w.ward FROM homes h JOIN wards w ON {_in('h', 'w')}")
@tabled
def j1(t):
    return s.points_in_polygons(t.homes.select("home", "lon", "lat"), squares(t).drop("sector"), key="home").select("home", "ward")


@query(
    "j2_nearest_fallback",
    f"""WITH {WARDS}, {HOMES}, i AS (SELECT h.home, min(w.ward) AS ward FROM homes h JOIN wards w ON {_in('h', 'w')} GROUP BY 1),
o AS (SELECT h.home, w.ward FROM homes h, wards w WHERE h.home NOT IN (SELECT home FROM i) QUALIFY row_number() OVER (PARTITION BY h.home ORDER BY round({_km('h.lon', 'h.lat', 'w.lon', 'w.lat')}, 9), w.ward) = 1)
SELECT home, ward, 'within' AS method FROM i UNION ALL SELECT home, ward, 'nearest' FROM o""",
)
@tabled
def j2(t):
    return s.join_with_nearest(t.homes.select("home", "lon", "lat"), squares(t).drop("sector"), key="home", polygon="ward")


@query("j5_nearest_target", f"WITH {SITES}, {HOMES} SELECT home, site, round(km, 6) AS km FROM (SELECT home, site, {_km('h.lon', 'h.lat', 's.lon', 's.lat')} AS km FROM homes h, sites s) QUALIFY row_number() OVER (PARTITION BY home ORDER BY km, site) = 1")
@tabled
def j5(t):
    return rounded(s.nearest(t.homes, t.sites, key="home", target="site", broadcast_rows=10), "km", digits=6)


@query("j15_within_distance", f"WITH {HOMES} SELECT a.home AS src, b.home AS dst, round({_km('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) AS km FROM homes a JOIN homes b ON a.home < b.home WHERE {_km('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1.5")
@tabled
def j15(t):
    return s.within_distance(t.homes, key="home", km=1.5, digits=6)


@query("j21_containment_count", f"WITH {WARDS}, {SITES} SELECT w.ward, count(s.site) AS sites FROM wards w LEFT JOIN sites s ON {_in('s', 'w')} GROUP BY 1")
@tabled
def j21(t):
    counts = s.points_in_polygons(t.sites.select("site", "lon", "lat"), squares(t).drop("sector"), key="site").groupBy("ward").count()
    return t.wards.select("ward").join(counts, "ward", "left").select("ward", F.coalesce("count", F.lit(0)).alias("sites"))


@query(
    "a9_inverse_distance",
    f"WITH {WARDS}, {SITES} SELECT w.ward, round(sum(s.capacity / pow(greatest({_km('s.lon', 's.lat', 'w.lon', 'w.lat')}, 1e-6), 2)) / sum(1 / pow(greatest({_km('s.lon', 's.lat', 'w.lon', 'w.lat')}, 1e-6), 2)), 5) AS capacity FROM wards w, sites s GROUP BY 1",
)
@tabled
def a9(t):
    w = t.wards.select("ward", F.col("lon").alias("wx"), F.col("lat").alias("wy"))
    pairs = t.sites.drop("ward").join(small(w)).withColumn("km", g.haversine_km(F.col("lon"), F.col("lat"), F.col("wx"), F.col("wy")))
    return rounded(a.inverse_distance(t.wards.select("ward"), pairs, ["capacity"], cell="ward"), "capacity", digits=5)


@query("j14_cross_with_few", f"WITH {WARDS}, {SITES} SELECT w.ward, s.site FROM wards w, sites s")
@tabled
def j14(t):
    return t.sites.select("site").join(small(t.wards.select("ward"))).select("ward", "site")


@query("j3_assign_polygons")
@tabled
def j3(t):
    """Squares around wards assigned to larger squares around the mean places of sectors, by shared lattice points."""
    centers = t.wards.groupBy("sector").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    corner = lambda dx, dy: F.struct((F.col("lon") + dx * 0.08).alias("x"), (F.col("lat") + dy * 0.08).alias("y"))
    zones = centers.select(F.col("sector").alias("zone"), F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("rings"))
    return rounded(s.assign_polygons(squares(t).drop("sector"), zones, key="ward", to="zone"), "share", digits=6)


@query("j18_queen_neighbours")
@tabled
def j18(t):
    """Hexagons of the homes that share a corner."""
    cells = t.homes.select(g.cell_id(F.col("lon"), F.col("lat"), 2000).alias("cell")).distinct()
    return s.queen_neighbours(cells.withColumn("rings", F.array(g.cell_boundary(F.col("cell"), 2000))), key="cell")




_LATTICE = f"""i AS (SELECT ward, lon AS x0, lat AS y0, unnest(range(CAST(floor((lon - {HALF}) / 0.005) AS BIGINT) - 1, CAST(ceil((lon + {HALF}) / 0.005) AS BIGINT) + 2)) AS i FROM wards),
j AS (SELECT *, unnest(range(CAST(floor((y0 - {HALF}) / 0.005) AS BIGINT) - 1, CAST(ceil((y0 + {HALF}) / 0.005) AS BIGINT) + 2)) AS j FROM i),
lattice AS (SELECT ward, i * 0.005::DOUBLE AS lon, j * 0.005::DOUBLE AS lat FROM j WHERE i * 0.005::DOUBLE >= x0 - {HALF} AND i * 0.005::DOUBLE < x0 + {HALF} AND j * 0.005::DOUBLE >= y0 - {HALF} AND j * 0.005::DOUBLE < y0 + {HALF})"""


@query(
    "a7_areal_weights",
    f"""WITH {WARDS}, {_LATTICE}, c AS (SELECT ward, q || ':' || r AS cell, count(*) AS points FROM {cell_sql('lattice', 'ward', 2000)} GROUP BY 1, 2), p AS (SELECT c_nationkey AS ward, count(*) * 1000.0::DOUBLE AS people FROM customer GROUP BY 1)
SELECT ward, cell, points, round(points / sum(points) OVER (PARTITION BY ward)::DOUBLE, 9) AS share, round(people * points / sum(points) OVER (PARTITION BY ward)::DOUBLE, 4) AS people FROM c JOIN p USING (ward)""",
)
@tabled
def a7_areal(t):
    """People of the wards over hexagons, by the share of the ward's area that lies in each."""
    people = t.customer.groupBy(F.col("c_nationkey").alias("ward")).agg((F.count(F.lit(1)) * 1000).cast("double").alias("people"))
    shares = s.cell_shares(squares(t), key="ward", step=0.005, size=2000)
    allocated = a.allocate_by_weight(people, shares, key="ward", value="people", weight="points")
    return rounded(rounded(allocated.select("ward", "cell", "points", "share", "people"), "share", digits=9), "people", digits=4)
