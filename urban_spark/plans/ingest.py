"""Queries over formats and record linkage: tables written in a format and read back, text that holds one, names to match."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from urban_spark.functions import geometry_text as gt
from urban_spark.functions.geo import clean_ring, polygon_area
from urban_spark.operators import clean as c
from urban_spark.operators import graph as g
from urban_spark.operators import linkage as l
from urban_spark.operators import risk as r
from urban_spark.operators import spatial as s
from urban_spark.plans.base import HOMES, SITES, WARDS, query, rounded, tabled
from urban_spark.plans.spatial import HALF, _km, squares
from urban_spark.sources import io


def _path(t, label: str) -> str:
    """A place in the folder that all executors share."""
    return f"{g.shared_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


@query("s1_s11_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"x\"' AS c_name FROM customer")
@tabled
def s1(t):
    path = _path(t, "customers") + ".csv"
    io.write_table(t.customer.select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("c_name")), path)
    return io.read_table(t.spark, path)


@query("s3_s13_parquet_chunks", "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
@tabled
def s3(t):
    path = _path(t, "balances") + ".parquet"
    io.append_chunks(t.customer.select("c_custkey", "c_acctbal"), path, 200)
    io.append_chunks(t.supplier.selectExpr("s_suppkey AS c_custkey", "s_acctbal AS c_acctbal"), path, 200)
    return io.read_table(t.spark, path)


@query("s4_json_lines", "SELECT n_nationkey, n_name FROM nation")
@tabled
def s4(t):
    path = _path(t, "nations") + ".ndjson"
    t.nation.select("n_nationkey", "n_name").write.json(path)
    return io.read_table(t.spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("s12_geojson_lines", f"WITH {WARDS} SELECT ward, round(lon - {HALF}, 9) AS x, round(lat - {HALF}, 9) AS y, 5 AS vertices FROM wards")
@tabled
def s12(t):
    path = _path(t, "features")
    io.write_geojson(squares(t).drop("sector"), path, "rings", "Polygon")
    lines = t.spark.read.text(path).select(F.from_json("value", "geometry struct<coordinates: array<array<array<double>>>>, properties struct<ward: int>").alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return rounded(lines.select("f.properties.ward", ring[0][0].alias("x"), ring[0][1].alias("y"), F.size(ring).alias("vertices")), "x", "y", digits=9)


@query("s14_one_folder_a_ward", "SELECT c_nationkey AS ward, count(*) AS n FROM customer GROUP BY 1")
@tabled
def s14(t):
    path = _path(t, "by-ward")
    io.write_by_ward(t.customer.select("c_custkey", F.col("c_nationkey").alias("ward")), path)
    return io.read_table(t.spark, path, "parquet").groupBy("ward").agg(F.count(F.lit(1)).alias("n"))


def _kml(t, shape: str):
    """One document for each sector, a placemark for each of its wards."""
    body = f"'<Placemark id=\"p\"><name><![CDATA[', name, ']]></name><description>Diameter mm: ', ward * 10, ', ward id: ward_', ward, '</description>{shape}</Placemark>'"
    marks = t.wards.withColumn("m", F.expr(f"concat({body})")).groupBy("sector").agg(F.array_join(F.array_sort(F.collect_list("m")), "\n").alias("m"))
    return marks.select(F.concat(F.lit("<kml><Document>"), "m", F.lit("<Placemark><name>none</name></Placemark></Document></kml>")).alias("value"))


@query("s6_kml_points", f"WITH {WARDS} SELECT name, round(lon, 9) AS lon, round(lat, 9) AS lat FROM wards")
@tabled
def s6(t):
    return rounded(io.kml_points(io.parse_kml(_kml(t, "<Point><coordinates> ', lon, ',', lat, ',0 </coordinates></Point>"), "value")), "lon", "lat", digits=9)


@query("s7_s8_p9_kml_lines", f"WITH {WARDS} SELECT name, CAST(ward * 10 AS VARCHAR) AS diameter, CAST(ward AS VARCHAR) AS ward, 2 AS vertices FROM wards")
@tabled
def s7(t):
    from urban_spark.functions.text import fields

    lines = io.kml_lines(io.parse_kml(_kml(t, "<LineString><coordinates>', lon, ',', lat, ',5 ', lon + 1, ',', lat, ' bad</coordinates></LineString>"), "value"))
    found = fields(F.col("description"), {"diameter": [r"(?i)diameter mm:\s*([0-9]+)"], "ward": [r"(?i)ward id:\s*ward_([0-9]+)"]})
    return lines.select("name", *found, F.size("line").alias("vertices"))


@query("s9_kml_polygons", f"WITH {WARDS} SELECT name, round(CAST(0.5 AS DOUBLE), 6) AS area FROM wards")
@tabled
def s9(t):
    ring = "<Polygon><outerBoundaryIs><LinearRing><coordinates>', lon, ',', lat, ' ', lon + 1, ',', lat, ' ', lon + 1, ',', lat + 1, ' ', lon, ',', lat, '</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    rows = io.parse_kml(_kml(t, ring), "value")
    return rounded(rows.select("name", polygon_area(F.transform("rings", clean_ring)).alias("area")), "area", digits=6)


@query("s10_hashed_sample")
@tabled
def s10(t):
    return c.hashed_sample(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", 100)


@query("s17_metric_documents", "SELECT CAST(c_nationkey AS VARCHAR) AS ward_id, 'pm25' AS target, round(avg(c_acctbal), 3) AS mae FROM customer GROUP BY 1")
@tabled
def s17(t):
    path = _path(t, "metrics")
    rows = t.customer.groupBy(F.col("c_nationkey").cast("string").alias("ward_id")).agg(F.avg("c_acctbal").alias("mae"))
    rows.select("ward_id", F.lit("pm25").alias("target"), F.lit("rf").alias("model"), F.struct(F.struct("mae").alias("metrics")).alias("backtest")).repartition("ward_id").write.option("maxRecordsPerFile", 1).json(path)
    return rounded(io.read_metrics(t.spark, path).select("ward_id", "target", "mae"), "mae", digits=3)


@query("s19_summary_record", "SELECT count(*) AS rows, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS max FROM customer")
@tabled
def s19(t):
    path = _path(t, "summary")
    t.customer.agg(F.count(F.lit(1)).alias("rows"), F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("max")).write.json(path)
    return rounded(t.spark.read.json(path).select("rows", "mean", "max"), "mean", digits=4)


@query("s20_fingerprints")
@tabled
def s20(t):
    return io.fingerprints(t.spark, f"{t.sf_dir}/*.parquet")


@query("s21_nested_documents", f"""WITH {WARDS} SELECT ward, '{{"ward":' || ward || ',"name":"' || name || '","sites":' || coalesce('[' || string_agg('{{"site":' || s_suppkey || '}}', ',' ORDER BY s_suppkey) || ']', 'x') || '}}' AS document FROM wards JOIN supplier ON s_nationkey = ward GROUP BY ward, name""")
@tabled
def s21(t):
    sites = t.sites.select("ward", "site")
    return io.nested_documents(t.wards.select("ward", "name").join(sites, "ward", "left_semi"), {"sites": sites}, "ward")


@query("p1_p2_p4_resolved_points", f"WITH {HOMES} SELECT CAST(home AS VARCHAR) AS id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM homes WHERE home % 5 <> 0")
@tabled
def p4(t):
    raw = t.homes.select(F.col("home").cast("string").alias("Ward No"), F.col("lon").cast("string").alias("Long (E)"), F.when(F.col("home") % 5 != 0, F.col("lat").cast("string")).otherwise("n/a").alias("LATITUDE"))
    df = c.resolve_columns(raw, {"id": ["ward", "id"], "longitude": ["long", "lon"], "latitude": ["lat"]})
    return rounded(c.point_table(df, ["long"], ["lat"]).select(F.col(c.ward_key(["id", "x"])).alias("id"), "lon", "lat"), "lon", "lat", digits=9)


@query("p5_p6_decoded_geometry", f"WITH {WARDS} SELECT ward, 'Polygon' AS type, round(CAST(1 AS DOUBLE), 6) AS area, 4 AS vertices FROM wards")
@tabled
def p5(t):
    x, y = F.col("lon"), F.col("lat")
    pt = lambda dx, dy, sep: F.concat((x + dx).cast("string"), F.lit(sep), (y + dy).cast("string"))
    corners = [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0), (0, 0)]
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *(pt(*k, " ") for k in corners)), F.lit("))"))
    json = F.concat(F.lit('{"type": "Polygon", "coordinates": [[['), F.concat_ws("], [", *(pt(*k, ", ") for k in corners)), F.lit("]]]}"))
    shape = gt.decode(F.when(F.col("ward") % 2 == 0, wkt).otherwise(json))
    rows = t.wards.select("ward", shape.alias("g")).withColumn("rings", F.transform("g.rings", clean_ring))
    return rounded(rows.select("ward", "g.type", polygon_area(F.col("rings")).alias("area"), F.size(F.col("rings")[0]).alias("vertices")), "area", digits=6)


@query("p16_short_lines", f"WITH {SITES} SELECT site, round(CAST(0.0001 AS DOUBLE), 6) AS length FROM sites")
@tabled
def p16(t):
    from urban_spark.functions.geo import line_length

    return rounded(t.sites.select("site", line_length(gt.short_line(F.col("lon"), F.col("lat"), 0.0001)).alias("length")), "length", digits=6)


@query("j7_ordinal_join", "WITH a AS (SELECT c_custkey, c_nationkey AS ward, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer), b AS (SELECT s_suppkey, s_nationkey AS ward, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) SELECT c_custkey, s_suppkey FROM a JOIN b USING (ward, n)")
@tabled
def j7(t):
    return l.ordinal_join(t.customer.withColumn("ward", F.col("c_nationkey")), t.supplier.withColumn("ward", F.col("s_nationkey")), group="ward", left_order="c_custkey", right_order="s_suppkey").select("c_custkey", "s_suppkey")


@query("j16_ordinal_band", f"WITH {SITES}, n AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY site) AS rn FROM sites) SELECT a.site AS src, b.site AS dst FROM n a JOIN n b ON a.ward = b.ward AND b.rn BETWEEN a.rn + 1 AND a.rn + 5")
@tabled
def j16(t):
    return l.ordinal_band(t.sites, group="ward", key="site", reach=5)


#: Names of three words for suppliers, and what customers write of those that they stand for: with a letter missing, a letter replaced and
#: the words turned round, more words, a number, or as they are in capitals.
_NAMED = """words AS (SELECT s_suppkey AS id, translate(CAST(s_suppkey * 7919 % 99991 + 100000 AS VARCHAR), '0123456789', 'balecimodu') AS u, translate(CAST(s_suppkey * 104729 % 99989 + 100000 AS VARCHAR), '0123456789', 'renastivop') AS v FROM supplier),
registry AS (SELECT id, u || ' ' || v || ' hall' AS name FROM words),
written AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN substr(u, 1, 2) || substr(u, 4) || ' ' || v || ' hall' WHEN 1 THEN v || ' Hall ' || substr(u, 1, 4) || 'x' || substr(u, 6)
  WHEN 2 THEN u || '-' || v || ' hall, ' || lower(c_mktsegment) WHEN 3 THEN 'No. ' || CAST(id AS VARCHAR) ELSE upper(name) END AS raw
  FROM customer JOIN words ON c_custkey % 1000 = id JOIN registry USING (id))"""
#: The full matrix of scores.
_SCORES = """plain AS (SELECT k, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS n FROM written), plain_b AS (SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM registry),
both_sets AS (SELECT k, id, a.n AS an, b.n AS bn, list_sort(list_distinct(string_split(a.n, ' '))) AS x, list_sort(list_distinct(string_split(b.n, ' '))) AS y FROM plain a, plain_b b),
parts AS (SELECT *, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS s, array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS p, array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS q FROM both_sets),
ends AS (SELECT *, trim(s || ' ' || p) AS one, trim(s || ' ' || q) AS two FROM parts),
scores AS (SELECT k AS a, id AS b, an, bn, greatest(CASE WHEN s <> '' THEN greatest(100.0::DOUBLE * (1 - levenshtein(s, one) / greatest(length(s), length(one))::DOUBLE), 100.0::DOUBLE * (1 - levenshtein(s, two) / greatest(length(s), length(two))::DOUBLE)) ELSE 0.0::DOUBLE END,
  100.0::DOUBLE * (1 - levenshtein(one, two) / greatest(length(one), length(two))::DOUBLE)) AS score FROM ends)"""


def _names(t):
    digits = lambda c, to: F.translate(c.cast("string"), "0123456789", to)
    k = F.col("s_suppkey")
    words = t.supplier.select(k.alias("id"), digits(k * 7919 % 99991 + 100000, "balecimodu").alias("u"), digits(k * 104729 % 99989 + 100000, "renastivop").alias("v"))
    registry = words.withColumn("name", F.concat("u", F.lit(" "), "v", F.lit(" hall")))
    kind, c, u, v = F.col("c_custkey") % 5, F.concat, F.col("u"), F.col("v")
    raw = (
        F.when(kind == 0, c(F.substring(u, 1, 2), F.substring(u, 4, 99), F.lit(" "), v, F.lit(" hall")))
        .when(kind == 1, c(v, F.lit(" Hall "), F.substring(u, 1, 4), F.lit("x"), F.substring(u, 6, 99)))
        .when(kind == 2, c(u, F.lit("-"), v, F.lit(" hall, "), F.lower("c_mktsegment")))
        .when(kind == 3, c(F.lit("No. "), F.col("id").cast("string")))
        .otherwise(F.upper("name"))
    )
    written = t.customer.join(registry, F.col("c_custkey") % 1000 == F.col("id")).select(F.col("c_custkey").alias("k"), raw.alias("raw"))
    return written, registry.select("id", "name")


@query("j9_fuzzy_pairs", f"WITH {_NAMED}, {_SCORES} SELECT a AS left, b AS right, round(score, 6) AS score FROM scores WHERE score >= 80")
@tabled
def j9_pairs(t):
    """All pairs of names that score 80 or more."""
    a, b = _names(t)
    return rounded(l.fuzzy_pairs(a, b, left_key="k", left_name="raw", right_key="id", right_name="name", least=80.0), "score", digits=6)


@query(
    "j8_j9_record_linkage",
    f"""WITH RECURSIVE {_NAMED}, {_SCORES},
numbered AS (SELECT k, try_cast(regexp_extract(raw, '[0-9]+') AS BIGINT) AS id FROM written WHERE regexp_matches(raw, '[0-9]')),
by_number AS (SELECT min(k) AS a, id AS b FROM numbered JOIN registry USING (id) GROUP BY id),
left_a AS (SELECT * FROM scores WHERE a NOT IN (SELECT a FROM by_number) AND b NOT IN (SELECT b FROM by_number)),
by_name AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY a) AS n FROM left_a WHERE an = bn) WHERE n = 1),
rounds AS (
  SELECT a, b, score, 0 AS step FROM left_a WHERE score >= 80 AND a NOT IN (SELECT a FROM by_name) AND b NOT IN (SELECT b FROM by_name)
  UNION ALL
  SELECT a, b, score, step + 1 FROM (SELECT *, bool_or(hit) OVER (PARTITION BY a) OR bool_or(hit) OVER (PARTITION BY b) AS gone FROM (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1 AND row_number() OVER (PARTITION BY b ORDER BY score DESC, a) = 1 AS hit FROM rounds)) WHERE NOT gone
),
by_score AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY step, a ORDER BY score DESC, b) = 1 AND row_number() OVER (PARTITION BY step, b ORDER BY score DESC, a) = 1 AS hit FROM rounds) WHERE hit)
SELECT a AS left, b AS right, 'number' AS method, 100.0::DOUBLE AS score FROM by_number UNION ALL SELECT a, b, 'name', 100.0::DOUBLE FROM by_name UNION ALL SELECT a, b, 'fuzzy', round(score, 6) FROM by_score""",
)
@tabled
def j9(t):
    """Names that customers write, matched to the suppliers' one to one: by number, by name, by similarity."""
    a, b = _names(t)
    return rounded(l.link(a, b, left_key="k", left_name="raw", right_key="id", right_name="name", least=80.0), "score", digits=6)


@query("j8_ordinal_last_stage", "WITH a AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), b AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) SELECT a.k AS left, b.k AS right, 'order' AS method FROM a JOIN b USING (n)")
@tabled
def j8_order(t):
    """Names that nothing else matches, paired in order."""
    a = t.customer.select(F.col("c_custkey").alias("k"), F.translate(F.concat(F.lit("left "), F.col("c_custkey").cast("string")), "0123456789", "abcdefghij").alias("name"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.translate(F.concat(F.lit("right"), F.col("s_suppkey").cast("string")), "0123456789", "klmnopqrst").alias("other"))
    return l.link(a, b, left_key="k", left_name="name", right_key="id", right_name="other", in_order=True).select("left", "right", "method")


@query("p5_wkb_round_trip", f"WITH {SITES} SELECT site, 'Point' AS type, lon, lat FROM sites")
@tabled
def p5_wkb(t):
    rows = t.sites.select("site", gt.point_wkb(F.col("lon"), F.col("lat")).alias("wkb"))
    v = F.col("g.rings")[0][0]
    return rows.select("site", gt.decode_wkb("wkb").alias("g")).select("site", "g.type", v["x"].alias("lon"), v["y"].alias("lat"))


@query("j17_nearest_pairs", f"WITH {SITES}, p AS (SELECT a.site AS src, b.site AS dst, {_km('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km FROM sites a JOIN sites b ON a.site <> b.site) SELECT src, dst, round(km, 6) AS km FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY p.km, dst) <= 3")
@tabled
def j17(t):
    return rounded(s.nearest_pairs(t.sites, 3, key="site"), "km", digits=6)


@query("j4_polygons_meet", f"WITH {WARDS} SELECT a.ward, b.ward AS zone FROM wards a JOIN wards b ON abs(a.lon - b.lon) < {2 * HALF} AND abs(a.lat - b.lat) < {2 * HALF}")
@tabled
def j4(t):
    return s.polygons_meet(squares(t), squares(t).withColumnRenamed("ward", "zone"), key="ward", to="zone")


#: Each site's plot in the form of an L, and each sector's ring road: a square frame around the mean place of its wards.
_L, _FRAME = [(-1, -1), (1, -1), (1, -0.5), (-0.5, -0.5), (-0.5, 1), (-1, 1)], [(-1, -1), (1, -1), (1, 1), (-1, 1)]
_L_HALF, _OUTER, _INNER = 0.02, 0.09, 0.06
_plots = " UNION ALL ".join(f"SELECT site, {i} AS i, lon + {x * _L_HALF} AS x, lat + {y * _L_HALF} AS y FROM sites" for i, (x, y) in enumerate(_L))
_frames = " UNION ALL ".join(f"SELECT sector, {r} AS r, {i} AS i, lon + {x * h} AS x, lat + {y * h} AS y FROM middle" for r, h in enumerate((_OUTER, _INNER)) for i, (x, y) in enumerate(_FRAME))
_turn = lambda a, b, c: f"sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


@query(
    "j4_join_meeting",
    f"""WITH {SITES}, {WARDS}, middle AS (SELECT sector, avg(lon) AS lon, avg(lat) AS lat FROM wards GROUP BY 1), pv AS ({_plots}), fv AS ({_frames}),
ps AS (SELECT a.site, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM pv a JOIN pv b ON a.site = b.site AND b.i = (a.i + 1) % 6), fs AS (SELECT a.sector, a.x AS rx, a.y AS ry, b.x AS sx, b.y AS sy FROM fv a JOIN fv b ON a.sector = b.sector AND a.r = b.r AND b.i = (a.i + 1) % 4),
crossing AS (SELECT DISTINCT site, sector FROM ps, fs WHERE {_turn('p', 'q', 'r')} * {_turn('p', 'q', 's')} <= 0 AND {_turn('r', 's', 'p')} * {_turn('r', 's', 'q')} <= 0
  AND greatest(px, qx) >= least(rx, sx) AND greatest(rx, sx) >= least(px, qx) AND greatest(py, qy) >= least(ry, sy) AND greatest(ry, sy) >= least(py, qy)),
within AS (SELECT site, sector FROM pv JOIN middle ON i = 0 AND abs(x - lon) < {_OUTER} AND abs(y - lat) < {_OUTER} AND NOT (abs(x - lon) < {_INNER} AND abs(y - lat) < {_INNER})
  UNION SELECT site, sector FROM fv JOIN sites ON i = 0 AND abs(x - lon) < {_L_HALF} AND abs(y - lat) < {_L_HALF} AND NOT (x > lon - {_L_HALF / 2} AND y > lat - {_L_HALF / 2})),
met AS (SELECT * FROM crossing UNION SELECT * FROM within)
SELECT site, CAST(sector AS VARCHAR) AS sector, 'intersects' AS method FROM met UNION ALL SELECT site, 'UNMAPPED', 'UNMAPPED' FROM sites WHERE site NOT IN (SELECT site FROM met)""",
)
@tabled
def j4_join(t):
    """Plots and the ring roads that they lie on; those inside or outside of all rings are unmapped."""
    ring = lambda shape, half: F.array(*(F.struct((F.col("lon") + x * half).alias("x"), (F.col("lat") + y * half).alias("y")) for x, y in shape))
    plots = t.sites.select("site", F.array(ring(_L, _L_HALF)).alias("rings"))
    middle = t.wards.groupBy("sector").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return s.join_meeting(plots, middle.select("sector", F.array(ring(_FRAME, _OUTER), ring(_FRAME, _INNER)).alias("rings")), key="site", to="sector")


@query("j23_snapped_ends")
@tabled
def j23(t):
    at = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    lines = t.homes.groupBy("ward").agg(F.transform(F.array_sort(F.collect_list(F.struct("home", at.alias("v")))), lambda x: x["v"]).alias("line"))
    return rounded(s.snap_ends(lines, t.sites.select(F.col("site").alias("node"), "lon", "lat"), key="ward", line="line", most_km=2.0), "km", digits=6)


@query("g16_named_sectors")
@tabled
def g16(t):
    sectors = t.wards.groupBy("sector").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return s.name_sectors(sectors, key="sector")


@query("g13_lattice_cover", f"WITH {WARDS}, i AS (SELECT ward, lon, lat, unnest(range(CAST(floor((lon - {HALF}) / 0.01) AS BIGINT) - 1, CAST(ceil((lon + {HALF}) / 0.01) AS BIGINT) + 2)) AS i FROM wards), j AS (SELECT *, unnest(range(CAST(floor((lat - {HALF}) / 0.01) AS BIGINT) - 1, CAST(ceil((lat + {HALF}) / 0.01) AS BIGINT) + 2)) AS j FROM i) SELECT ward, count(*) AS points FROM j WHERE i * 0.01::DOUBLE >= lon - {HALF} AND i * 0.01::DOUBLE < lon + {HALF} AND j * 0.01::DOUBLE >= lat - {HALF} AND j * 0.01::DOUBLE < lat + {HALF} GROUP BY 1")
@tabled
def g13(t):
    return squares(t).select("ward", F.size(s.lattice(F.col("rings"), 0.01)).cast("long").alias("points"))


@query("g17_grouped_polygons", "SELECT n_regionkey AS sector, count(*) AS parts, CAST(count(*) * 4 AS BIGINT) AS vertices FROM nation GROUP BY 1")
@tabled
def g17(t):
    df = s.group_polygons(squares(t), "sector")
    return df.select("sector", "parts", F.aggregate("rings", F.lit(0), lambda n, x: n + F.size(x)).cast("long").alias("vertices"))


@query("n3_segment_graph")
@tabled
def n3(t):
    vertex = F.struct((F.col("home") % 12).cast("double").alias("x"), (F.col("home") % 7).cast("double").alias("y"))
    lines = t.homes.groupBy("ward").agg(F.transform(F.array_sort(F.collect_list(F.struct("home", vertex.alias("v")))), lambda x: x["v"]).alias("line"))
    return rounded(s.segment_graph(lines, "line", 1.0)[1], "length", digits=6)


@query("n13_repaired_zones")
@tabled
def n13(t):
    k = F.col("n_nationkey")
    areas = t.nation.select(k.alias("id"), F.when(k.isin(7, 8), 9).otherwise(F.floor(k / 9)).cast("int").alias("zone"))
    edges = t.nation.where("n_nationkey > 0").select(k.alias("src"), (k - 1).alias("dst"))
    return s.repair_contiguity(areas, edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


@query("r14_r15_r16_flood_risk")
@tabled
def r16(t):
    """Cells are sites, heights their capacity, neighbours the sites within 3 km."""
    pairs = s.within_distance(t.sites, key="site", km=3.0)
    edges = g._cut(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km")))
    cells = t.sites.select(F.col("site").alias("cell"), (F.col("capacity") / 100).alias("elevation"))
    df = cells.join(r.slope(edges, cells), "cell", "left").join(r.flow_accumulation(edges, cells), "cell", "left").fillna(0.0)
    return rounded(r.flood_risk(df), "flood_risk", digits=6)




@query("s2_format_by_suffix", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, s AS format FROM nation, (VALUES ('csv'), ('jsonl'), ('parquet')) f(s)")
@tabled
def s2(t):
    rows, parts = t.nation.select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name")), []
    for suffix in ("csv", "jsonl", "parquet"):
        path = f"{_path(t, 'nations')}.{suffix}"
        rows.write.json(path) if suffix == "jsonl" else io.write_table(rows, path)
        parts.append(io.read_table(t.spark, path).select("k", "name", F.lit(suffix).alias("format")))
    return io.union_layers(parts)


@query("s5_geojson_collection", f"WITH {WARDS} SELECT name, 'Polygon' AS type, 5 AS vertices, round(lon - {HALF}, 9) AS x FROM wards")
@tabled
def s5(t):
    """One collection for each sector, written as text and read by the GeoJSON reader."""
    path = _path(t, "collections") + ".geojson"
    features = io.feature_json(squares(t).join(t.wards.select("ward", "name"), "ward"), "rings", "Polygon").withColumn("sector", F.get_json_object("value", "$.properties.sector"))
    whole = features.groupBy("sector").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
    whole.repartition("sector").select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = io.read_table(t.spark, path)
    return rounded(rows.select(F.col("properties")["name"].alias("name"), "type", F.size(F.col("rings")[0]).alias("vertices"), F.col("rings")[0][0]["x"].alias("x")), "x", digits=9)


@query("s18_keyed_csvs", "SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_mktsegment) AS target FROM customer")
@tabled
def s18(t):
    base = _path(t, "segments")
    names = [r[0] for r in t.customer.select(F.lower("c_mktsegment")).distinct().collect()]
    for name in names:
        io.write_table(t.customer.where(F.lower("c_mktsegment") == name).select(F.col("c_custkey").alias("id")), f"{base}/{name}.csv")
    return io.read_keyed_csvs(t.spark, f"{base}/*.csv")


@query("p14_first_present", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_brand END, CASE WHEN p_size > 20 THEN p_type END, p_name) AS tag FROM part")
@tabled
def p14(t):
    tags = F.create_map(F.lit("building"), F.when(F.col("p_size") > 40, F.col("p_brand")), F.lit("amenity"), F.when(F.col("p_size") > 20, F.col("p_type")), F.lit("shop"), F.col("p_name"))
    return t.part.select("p_partkey", F.coalesce(*(tags[k] for k in ("building", "amenity", "shop"))).alias("tag"))


@query("g10_cell_boundary", f"WITH {WARDS} SELECT ward, 6 AS corners, round(3 * sqrt(3.0) / 2 * 640000 / 1e6, 6) AS km2 FROM wards")
@tabled
def g10(t):
    """Corners of the hexagon of each ward's point, and the area they enclose in metres of the projection."""
    from urban_spark.functions import geo

    b = geo.cell_boundary(geo.cell_id(F.col("lon"), F.col("lat"), 800), 800)
    metres = F.transform(b, lambda v: F.struct(geo.mercator_x(v["x"]).alias("x"), geo.mercator_y(v["y"]).alias("y")))
    return rounded(t.wards.select("ward", F.size(b).alias("corners"), (polygon_area(F.array(metres)) / 1e6).alias("km2")), "km2", digits=6)
