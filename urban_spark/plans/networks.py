"""Queries over graphs, access, equity and investments."""

from __future__ import annotations

from pyspark.sql import functions as F

from urban_spark.functions import geo
from urban_spark.functions.geo import haversine_km
from urban_spark.operators import access as q
from urban_spark.operators import agg as a
from urban_spark.operators import graph as g
from urban_spark.operators import routes
from urban_spark.operators import spatial as s
from urban_spark.operators.clean import hashed_sample
from urban_spark.operators.sizes import small
from urban_spark.plans.base import HOMES, PANEL, SITES, WARDS, query, rounded, tabled
from urban_spark.plans.relational import od_flows
from urban_spark.plans.spatial import _km, cell_sql

FLOWS = "flows AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
ROADS = f"""roads AS (SELECT a.site AS src, b.site AS dst, {_km('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS weight FROM sites a JOIN sites b ON b.site IN (a.site + 1, a.site + 7) WHERE b.site % 10 <> 0)"""


def _roads(t):
    at = t.sites.select("site", "lon", "lat")
    pairs = at.select(F.col("site").alias("src"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.explode(F.array(F.lit(1), F.lit(7))).alias("k")).withColumn("dst", F.col("src") + F.col("k"))
    joined = pairs.join(at.withColumnRenamed("site", "dst"), "dst").where("dst % 10 <> 0")
    return joined.select("src", "dst", haversine_km(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")).alias("weight"))


def _site_nodes(t):
    return t.sites.select(F.col("site").alias("id"))


def _site_sources(t):
    nodes = _site_nodes(t)
    return hashed_sample(nodes, "id", g.source_count(nodes.count()))


@query("n1_s15_property_graph", "SELECT CAST(n_nationkey AS VARCHAR) AS id, 'Ward' AS label, '{\"n_name\":\"' || n_name || '\"}' AS props_json FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'Sector', '{\"r_name\":\"' || r_name || '\"}' FROM region")
@tabled
def n1(t):
    nodes, _ = g.property_graph({"Ward": (t.nation.select("n_nationkey", "n_name"), "n_nationkey"), "Sector": (t.region, "r_regionkey")}, {"IN": (t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey")})
    return nodes


@query("n1_property_graph_edges", "SELECT CAST(n_nationkey AS VARCHAR) AS src, CAST(n_regionkey AS VARCHAR) AS dst, 'IN' AS type, '{}' AS props_json FROM nation UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR), 'LIES_IN', '{\"s_name\":\"' || s_name || '\"}' FROM supplier")
@tabled
def n1_edges(t):
    suppliers = t.supplier.select("s_suppkey", "s_nationkey", "s_name")
    _, edges = g.property_graph({"Sector": (t.region, "r_regionkey")}, {"IN": (t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey"), "LIES_IN": (suppliers, "s_suppkey", "s_nationkey")})
    return edges


_CELLS = f"cells AS (SELECT DISTINCT q || ':' || r AS cell, ward FROM {cell_sql('homes', 'ward', 2000)})"
_KINDS = {"School": 0, "Health": 1, "Park": 2}


def _city(t):
    """Six kinds of nodes and four of edges: wards, sectors, three kinds of sites and cells; wards in sectors, sites in wards, cells of wards, flows between wards."""
    sites = t.sites.select(F.col("site"), "ward", (F.col("site") % 3).alias("kind"))
    cells = t.homes.select(geo.cell_id(F.col("lon"), F.col("lat"), 2000).alias("cell"), "ward").distinct()
    nodes = {"Ward": (t.nation.select("n_nationkey", "n_name"), "n_nationkey"), "Sector": (t.region, "r_regionkey"), "Cell": (cells.select("cell").distinct(), "cell")}
    nodes |= {name: (sites.where(F.col("kind") == k).select("site"), "site") for name, k in _KINDS.items()}
    edges = {
        "IN": (t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey"), "LIES_IN": (sites.select("site", "ward"), "site", "ward"),
        "CELL_OF": (cells, "cell", "ward"), "FLOW": (od_flows(t).select("src", "dst", "flow"), "src", "dst"),
    }
    return g.property_graph(nodes, edges)


@query(
    "n1_city_nodes",
    f"""WITH {SITES}, {HOMES}, {_CELLS} SELECT CAST(n_nationkey AS VARCHAR) AS id, 'Ward' AS label, '{{"n_name":"' || n_name || '"}}' AS props_json FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'Sector', '{{"r_name":"' || r_name || '"}}' FROM region
UNION ALL SELECT DISTINCT cell, 'Cell', '{{}}' FROM cells UNION ALL SELECT CAST(site AS VARCHAR), CASE site % 3 WHEN 0 THEN 'School' WHEN 1 THEN 'Health' ELSE 'Park' END, '{{}}' FROM sites""",
)
@tabled
def n1_city_nodes(t):
    return _city(t)[0]


@query(
    "n1_city_edges",
    f"""WITH {SITES}, {HOMES}, {_CELLS}, {FLOWS} SELECT CAST(n_nationkey AS VARCHAR) AS src, CAST(n_regionkey AS VARCHAR) AS dst, 'IN' AS type, '{{}}' AS props_json FROM nation UNION ALL SELECT CAST(site AS VARCHAR), CAST(ward AS VARCHAR), 'LIES_IN', '{{}}' FROM sites
UNION ALL SELECT cell, CAST(ward AS VARCHAR), 'CELL_OF', '{{}}' FROM cells UNION ALL SELECT CAST(src AS VARCHAR), CAST(dst AS VARCHAR), 'FLOW', '{{"flow":' || flow || '}}' FROM flows""",
)
@tabled
def n1_city_edges(t):
    return _city(t)[1]


@query("n2_s16_flow_graph", f"WITH {FLOWS} SELECT src, dst, flow FROM flows")
@tabled
def n2(t):
    return od_flows(t)


#: Roads between sites at 35 km/h, metro lines between the places of wards at 40, and walks of 5 km/h from a station to the nearest site.
LAYERED = f"""metro AS (SELECT a.ward AS src, b.ward AS dst, {_km('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km FROM wards a JOIN wards b ON b.ward = a.ward + 5 WHERE a.ward % 5 < 3),
walks AS (SELECT w.ward, s.site, {_km('w.lon', 'w.lat', 's.lon', 's.lat')} AS km FROM wards w, sites s QUALIFY row_number() OVER (PARTITION BY w.ward ORDER BY km, s.site) = 1),
every AS (SELECT 'road:' || src AS a, 'road:' || dst AS b, weight / 35.0::DOUBLE * 60 AS minutes, 'road' AS mode FROM roads UNION ALL SELECT 'metro:' || src, 'metro:' || dst, km / 40.0::DOUBLE * 60, 'metro' FROM metro
  UNION ALL SELECT 'metro:' || ward, 'road:' || site, km / 5.0::DOUBLE * 60, 'transfer' FROM walks WHERE ward IN (SELECT src FROM metro UNION SELECT dst FROM metro)),
layered AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min({{'minutes': minutes, 'mode': mode}}) AS m FROM every WHERE a <> b AND minutes > 0 GROUP BY 1, 2)"""
#: Times between all pairs of nodes, by squaring: after seven steps all ways of 128 edges.
_CLOSED = "t0 AS (SELECT src, dst, min(m) AS m FROM (SELECT src, dst, m.minutes AS m FROM layered UNION ALL SELECT dst, src, m.minutes FROM layered UNION ALL SELECT src, src, 0 FROM layered UNION ALL SELECT dst, dst, 0 FROM layered) GROUP BY 1, 2)" + "".join(
    f", t{k} AS MATERIALIZED (SELECT a.src, b.dst, min(a.m + b.m) AS m FROM t{k - 1} a JOIN t{k - 1} b ON a.dst = b.src GROUP BY 1, 2)" for k in range(1, 8)
)
NETWORK_TIMES = f"""{LAYERED}, {_CLOSED}, network_times AS (SELECT a.ward AS src, b.ward AS dst, CASE WHEN a.ward = b.ward THEN 0 ELSE coalesce(t.m, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) * 111 / 30.0::DOUBLE * 60) END AS minutes
  FROM wards a CROSS JOIN wards b JOIN walks x ON x.ward = a.ward JOIN walks y ON y.ward = b.ward LEFT JOIN t7 t ON t.src = 'road:' || x.site AND t.dst = 'road:' || y.site)"""


def _layered(t):
    """The graph (src, dst, minutes, mode), and the site next to each ward (ward, node)."""
    w = t.wards
    ends = w.select(F.col("ward").alias("src"), F.col("lon").alias("x"), F.col("lat").alias("y")).where("src % 5 < 3").withColumn("dst", F.col("src") + 5).join(w.withColumnRenamed("ward", "dst"), "dst")
    metro = ends.select("src", "dst", haversine_km(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")).alias("km"))
    walks = s.nearest(w, t.sites, key="ward", target="site")
    stations = metro.select(F.col("src").alias("ward")).union(metro.select("dst")).distinct()
    node = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    transfers = walks.join(stations, "ward", "left_semi").select(node("metro:", "ward").alias("src"), node("road:", "site").alias("dst"), (F.col("km") / 5.0 * 60).alias("minutes"))
    edges = routes.multimodal_graph({"road": (_roads(t).withColumnRenamed("weight", "km"), 35.0), "metro": (metro, 40.0)}, transfers)
    return edges, walks.select("ward", node("road:", "site").alias("node"))


def network_times(t):
    edges, snapped = _layered(t)
    return routes.travel_matrix(edges, t.wards, snapped, key="ward")


@query("n4_travel_minutes", f"WITH {SITES}, {WARDS}, {ROADS}, {LAYERED} SELECT src, dst, round(m.minutes, 6) AS minutes, m.mode AS mode FROM layered")
@tabled
def n4(t):
    return rounded(_layered(t)[0], "minutes", digits=6)


@query("q4_network_times", f"WITH {SITES}, {WARDS}, {ROADS}, {NETWORK_TIMES} SELECT src, dst, round(minutes, 6) AS minutes FROM network_times")
@tabled
def q4_times(t):
    """Minutes from ward to ward over roads and metro."""
    return rounded(network_times(t), "minutes", digits=6)


@query("q4_network_summary", f"WITH {SITES}, {WARDS}, {ROADS}, {NETWORK_TIMES} SELECT round(avg(minutes), 6) AS mean, round(quantile_cont(minutes, 0.5), 6) AS median, round(quantile_cont(minutes, 0.9), 6) AS p90, round(max(minutes), 6) AS most FROM network_times WHERE minutes > 0")
@tabled
def q4_summary(t):
    times = network_times(t).where("minutes > 0")
    return rounded(q.time_summary(times, "minutes").crossJoin(F.broadcast(times.agg(F.max("minutes").alias("most")))), "mean", "median", "p90", "most", digits=6)  # one row each


@query("n5_degrees", f"WITH {SITES}, {ROADS}, u AS (SELECT src, dst FROM roads UNION SELECT dst, src FROM roads), d AS (SELECT src, count(*) AS d FROM u GROUP BY 1) SELECT site AS id, coalesce(d, 0) AS degree, round(coalesce(d, 0) / greatest((SELECT count(*) FROM sites) - 1, 1)::DOUBLE, 9) AS centrality FROM sites LEFT JOIN d ON src = site")
@tabled
def n5(t):
    return rounded(g.degrees(_site_nodes(t), _roads(t)), "centrality", digits=9)


@query(
    "n6_components",
    "WITH RECURSIVE e AS (SELECT o_custkey AS src, o_custkey + 1 AS dst FROM orders WHERE o_totalprice > 460000 UNION SELECT o_custkey + 1, o_custkey FROM orders WHERE o_totalprice > 460000), r AS (SELECT c_custkey AS id, c_custkey AS reach FROM customer UNION SELECT r.id, e.dst FROM r JOIN e ON e.src = r.reach JOIN customer ON c_custkey = e.dst) SELECT id, min(reach) AS component FROM r GROUP BY id",
)
@tabled
def n6(t):
    nodes = t.customer.select(F.col("c_custkey").alias("id"))
    e = t.orders.where("o_totalprice > 460000").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"))
    return g.components(nodes, e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"))


@query(
    "n7_shortest_paths",
    f"""WITH RECURSIVE {SITES}, {ROADS}, p AS (SELECT site AS source, site AS id, 0.0::DOUBLE AS distance, 0 AS k FROM sites WHERE site IN (SELECT min(site) FROM sites GROUP BY ward) UNION ALL
SELECT source, id, distance, k FROM (SELECT source, r.dst AS id, min(p.distance + r.weight) AS distance, any_value(p.k) + 1 AS k FROM p JOIN roads r ON r.src = p.id GROUP BY source, r.dst, p.k))
SELECT source, id, round(min(distance), 6) AS distance FROM p GROUP BY 1, 2""",
)
@tabled
def n7(t):
    """From the first site of each ward to all sites."""
    first = t.sites.groupBy("ward").agg(F.min("site").alias("id")).select("id")
    found = routes.distances(routes.route_index(_roads(t), core=routes.CORE), first, _site_nodes(t))
    return rounded(found.withColumnRenamed("target", "id"), "distance", digits=6)


@query("n8_closeness")
@tabled
def n8(t):
    """By the ways from all sites."""
    return rounded(g.closeness_from(_roads(t), _site_nodes(t)), "closeness", digits=6)


@query("n9_betweenness")
@tabled
def n9(t):
    return rounded(g.betweenness(_site_nodes(t), _roads(t), _site_sources(t), weight="weight"), "betweenness", digits=6)


@query("n9_edge_betweenness")
@tabled
def n9_edges(t):
    return rounded(g.edge_betweenness(_roads(t), _site_sources(t), weight="weight"), "betweenness", digits=6)


@query("n10_o6_pagerank")
@tabled
def n10(t):
    nodes = t.nation.select(F.col("n_nationkey").alias("id"))
    return rounded(g.pagerank(nodes, od_flows(t), rounds=400, tolerance=1e-12), "rank", digits=9)


@query("n11_edge_means", f"WITH {SITES}, {ROADS} SELECT src, dst, round((a.capacity + b.capacity) / 2, 4) AS capacity FROM roads JOIN sites a ON a.site = src JOIN sites b ON b.site = dst")
@tabled
def n11(t):
    return rounded(g.edge_means(_roads(t).select("src", "dst"), t.sites.select(F.col("site").alias("id"), "capacity"), "capacity"), "capacity", digits=4)


@query("n14_normalized_weights", f"WITH {FLOWS} SELECT src, dst, round((flow - 20) / nullif(sum(abs(flow - 20)) OVER (PARTITION BY dst), 0)::DOUBLE, 9) AS weight FROM flows")
@tabled
def n14(t):
    return rounded(g.normalized_weights(od_flows(t).select("src", "dst", (F.col("flow") - 20).cast("double").alias("weight"))), "weight", digits=9)


@query("n15_spectral_radius")
@tabled
def n15(t):
    return t.spark.createDataFrame([(round(g.spectral_radius(od_flows(t).select("src", "dst", (F.col("flow") / 1000).alias("weight")), rounds=400, tolerance=1e-9), 4),)], "radius double")


@query("n16_gravity", f"WITH {WARDS}, p AS (SELECT c_nationkey AS ward, count(*) AS people FROM customer GROUP BY 1) SELECT a.ward AS src, b.ward AS dst, round(x.people * y.people / pow(greatest({_km('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 0.1), 2), 4) AS demand FROM wards a JOIN wards b ON a.ward <> b.ward JOIN p x ON x.ward = a.ward JOIN p y ON y.ward = b.ward")
@tabled
def n16(t):
    w = t.wards.join(t.customer.groupBy(F.col("c_nationkey").alias("ward")).agg(F.count(F.lit(1)).alias("people")), "ward")
    a_, b_ = w.selectExpr("ward AS src", "lon AS x1", "lat AS y1", "people AS p1"), w.selectExpr("ward AS dst", "lon AS x2", "lat AS y2", "people AS p2")
    pairs = a_.join(small(b_), F.col("src") != F.col("dst")).withColumn("km", haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return rounded(g.gravity(pairs, "p1", "p2", "km").select("src", "dst", "demand"), "demand", digits=4)


@query("n17_chain_transitions", "WITH c AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), s AS (SELECT src, dst, count(*) AS n FROM c WHERE dst IS NOT NULL GROUP BY 1, 2) SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src)::DOUBLE, 9) AS share FROM s")
@tabled
def n17(t):
    chains = t.events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ">").alias("chain"))
    return rounded(g.chain_transitions(chains.withColumn("w", F.lit(1)), "chain", "w"), "share", digits=9)


TIMES = f"times AS (SELECT w.ward, s.site, s.capacity, {_km('w.lon', 'w.lat', 's.lon', 's.lat')} * 1.25 / 25 * 60 AS travel_min, CASE s.site % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'clinic' ELSE 'park' END AS kind FROM wards w, sites s)"


def _times(t):
    df = q.travel_times(t.wards, t.sites, ward="ward", candidate="site").join(t.sites.select("site", "capacity"), "site")
    return df.withColumn("kind", F.when(F.col("site") % 3 == 0, "school").when(F.col("site") % 3 == 1, "clinic").otherwise("park"))


@query("q1_travel_times", f"WITH {WARDS}, {SITES}, {TIMES} SELECT ward, site, round(travel_min, 6) AS travel_min FROM times")
@tabled
def q1(t):
    return rounded(q.travel_times(t.wards, t.sites, ward="ward", candidate="site"), "travel_min", digits=6)


@query("q2_travel_matrix", f"WITH {WARDS}, {SITES}, {TIMES} SELECT ward, {', '.join(f'round(min(CASE WHEN kind = {k!r} THEN travel_min END), 6) AS {k}' for k in ('clinic', 'park', 'school'))} FROM times GROUP BY 1")
@tabled
def q2(t):
    return rounded(_times(t).groupBy("ward").pivot("kind", ["clinic", "park", "school"]).agg(F.min("travel_min")), "clinic", "park", "school", digits=6)


_MATRIX = ", ".join(f"round(min(CASE WHEN b.ward = {k} THEN {_km('a.lon', 'a.lat', 'b.lon', 'b.lat')} * 1.25 / 25 * 60 END), 6) AS to_{k}" for k in range(25))


@query("q2_ward_matrix", f"WITH {WARDS} SELECT a.ward, {_MATRIX} FROM wards a, wards b GROUP BY 1")
@tabled
def q2_matrix(t):
    """A row a ward and a column a candidate place, here the wards' own places."""
    places = t.wards.select(F.col("ward").alias("place"), "lon", "lat")
    return rounded(q.travel_matrix(q.travel_times(t.wards, places, ward="ward", candidate="place"), ward="ward", candidate="place"), *(f"to_{k}" for k in range(25)), digits=6)


@query("q3_tiered_minutes", f"WITH {WARDS}, {SITES}, k AS (SELECT w.ward, s.site, {_km('w.lon', 'w.lat', 's.lon', 's.lat')} * 1.2 AS way FROM wards w JOIN sites s USING (ward)) SELECT ward, site, round(way / CASE WHEN way <= 5 THEN 20.0 WHEN way <= 15 THEN 30.0 ELSE 40.0 END::DOUBLE * 60, 6) AS minutes FROM k")
@tabled
def q3(t):
    w = t.wards.select("ward", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rounded(t.sites.join(small(w), "ward").select("ward", "site", q.tiered_minutes(haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).alias("minutes")), "minutes", digits=6)


@query("q4_time_summary", f"WITH {WARDS}, {SITES}, {TIMES} SELECT ward, round(avg(travel_min), 6) AS mean, round(quantile_cont(travel_min, 0.5), 6) AS median, round(quantile_cont(travel_min, 0.9), 6) AS p90 FROM times GROUP BY 1")
@tabled
def q4(t):
    return rounded(q.time_summary(_times(t), "travel_min", ["ward"]), "mean", "median", "p90", digits=6)


PEOPLE = "people AS (SELECT c_nationkey AS ward, count(*) * 1000 AS population, avg(c_acctbal) AS income FROM customer GROUP BY 1)"


def _people(t):
    return t.customer.groupBy(F.col("c_nationkey").alias("ward")).agg((F.count(F.lit(1)) * 1000).alias("population"), F.avg("c_acctbal").alias("income"))


@query("q5_q11_needs", f"WITH {PEOPLE}, has AS (SELECT s_nationkey AS ward, count(*) AS h FROM supplier GROUP BY 1) SELECT ward, CAST(ceil(population / 5000.0) AS BIGINT) AS need_school, CAST(greatest(0, ceil(population / 5000.0) - coalesce(h, 0)) AS BIGINT) AS add_school FROM people LEFT JOIN has USING (ward)")
@tabled
def q5(t):
    has = t.supplier.groupBy(F.col("s_nationkey").alias("ward")).agg(F.count(F.lit(1)).alias("has_school"))
    df = q.additional_needs(q.facility_demand(_people(t), "population", {"school": 5000.0}).join(has, "ward", "left"), "population", {"school": 5000.0})
    return df.select("ward", F.col("need_school").cast("long").alias("need_school"), F.col("add_school").cast("long").alias("add_school"))


@query("q6_violations", f"WITH {PEOPLE} SELECT ward, 'crowded' AS rule FROM people WHERE NOT population <= 60000 UNION ALL SELECT ward, 'poor' FROM people WHERE NOT income >= 4500")
@tabled
def q6(t):
    return q.violations(_people(t), "ward", {"crowded": F.col("population") <= 60000, "poor": F.col("income") >= 4500})


@query("q7_composite_access", f"WITH {WARDS}, {SITES}, {TIMES}, m AS (SELECT ward, min(CASE WHEN kind = 'clinic' THEN travel_min END) AS clinic, min(CASE WHEN kind = 'park' THEN travel_min END) AS park, min(CASE WHEN kind = 'school' THEN travel_min END) AS school FROM times GROUP BY 1) SELECT ward, round(coalesce(clinic, 999) * 0.4::DOUBLE + coalesce(school, 999) * 0.3::DOUBLE + coalesce(park, 999) * 0.3::DOUBLE, 6) AS access FROM m")
@tabled
def q7(t):
    return rounded(q.composite_access(_times(t), {"clinic": 0.4, "school": 0.3, "park": 0.3}, ward="ward").select("ward", "access"), "access", digits=6)


@query("q7_access_by_large_sites", f"WITH {WARDS}, {SITES}, {TIMES}, m AS (SELECT ward, min(CASE WHEN kind = 'clinic' AND capacity > 4000 AND travel_min <= 40 THEN travel_min END) AS clinic, min(CASE WHEN kind = 'school' AND capacity > 4000 AND travel_min <= 40 THEN travel_min END) AS school FROM times GROUP BY 1) SELECT ward, round(coalesce(clinic, 999) * 0.4::DOUBLE + coalesce(school, 999) * 0.3::DOUBLE + 999 * 0.3::DOUBLE, 6) AS access FROM m WHERE clinic IS NOT NULL OR school IS NOT NULL")
@tabled
def q7_large(t):
    """Large sites within 40 minutes only, and a kind that there is none of: what is missing counts 999 minutes."""
    times = _times(t).where("capacity > 4000 AND travel_min <= 40 AND kind <> 'park'")
    return rounded(q.composite_access(times, {"clinic": 0.4, "school": 0.3, "emergency": 0.3}, ward="ward").select("ward", "access"), "access", digits=6)


@query("q8_income_estimate", f"WITH {PEOPLE} SELECT ward, round(greatest(0.2, least(1.0, 1 / ln(population / 1000.0::DOUBLE + 2.718281828459045))), 9) AS income FROM people")
@tabled
def q8(t):
    return rounded(_people(t).select("ward", q.income_from_density(F.col("population") / 1000.0).alias("income")), "income", digits=9)


GROUPS = """grouped AS (SELECT p.ward, population, income, access, CASE WHEN income <= lo THEN 'low' WHEN income >= hi THEN 'high' ELSE 'middle' END AS grp, income <= lo AND access >= m AS underserved FROM people p JOIN acc USING (ward),
  (SELECT quantile_cont(income, 0.4) AS lo, quantile_cont(income, 0.6) AS hi FROM people JOIN acc USING (ward)), (SELECT quantile_cont(access, 0.5) AS m FROM people JOIN acc USING (ward)))"""
ACC = "acc AS (SELECT ward, min(travel_min) AS access FROM times GROUP BY 1)"


def _grouped(t):
    acc = _times(t).groupBy("ward").agg(F.min("travel_min").alias("access"))
    return q.income_groups(_people(t).join(acc, "ward"), "income", "access", 0.4)


@query("q9_income_groups", f"WITH {WARDS}, {SITES}, {TIMES}, {PEOPLE}, {ACC}, {GROUPS} SELECT ward, grp AS \"group\", underserved FROM grouped")
@tabled
def q9(t):
    return _grouped(t).select("ward", "group", "underserved")


@query("q10_scorecard", f"WITH {WARDS}, {SITES}, {TIMES}, {PEOPLE}, {ACC}, {GROUPS} SELECT round(max(access) - min(access), 6) AS range, round(avg(CASE WHEN grp = 'low' THEN access END), 6) AS mean_low, round(avg(CASE WHEN grp = 'high' THEN access END), 6) AS mean_high, round(avg(CASE WHEN grp = 'low' THEN access END) - avg(CASE WHEN grp = 'high' THEN access END), 6) AS gap FROM grouped")
@tabled
def q10(t):
    return rounded(q.scorecard(_grouped(t), "access"), "range", "mean_low", "mean_high", "gap", digits=6)


_CARD = """SELECT '{0}' AS stage, round(max({0}) - min({0}), 6) AS range, round(avg(CASE WHEN grp = 'low' THEN {0} END), 6) AS mean_low, round(avg(CASE WHEN grp = 'high' THEN {0} END), 6) AS mean_high,
  round(avg(CASE WHEN grp = 'low' THEN {0} END) - avg(CASE WHEN grp = 'high' THEN {0} END), 6) AS gap, round((SELECT sum((2 * r - n - 1) * v) / (any_value(n) * sum(v)) FROM (SELECT {0} AS v, row_number() OVER (ORDER BY {0}) AS r, count(*) OVER () AS n FROM both_)), 6) AS gini,
  round(sum({0}) FILTER (WHERE income >= (SELECT quantile_cont(income, 0.9) FROM both_)) / sum({0}) FILTER (WHERE income <= (SELECT quantile_cont(income, 0.4) FROM both_)), 6) AS palma FROM both_"""


@query("q10_before_and_after", f"WITH {WARDS}, {SITES}, {TIMES}, {PEOPLE}, {ACC}, {GROUPS}, m AS (SELECT ward, min(CASE WHEN capacity > 5000 THEN travel_min END) AS before, min(travel_min) AS after FROM times GROUP BY 1), both_ AS (SELECT grp, income, before, after FROM grouped JOIN m USING (ward)) {_CARD.format('before')} UNION ALL {_CARD.format('after')}")
@tabled
def q10_both(t):
    near = _times(t).groupBy("ward").agg(F.min(F.when(F.col("capacity") > 5000, F.col("travel_min"))).alias("before"), F.min("travel_min").alias("after"))
    return rounded(q.before_and_after(_grouped(t).join(near, "ward"), "before", "after", "income"), "range", "mean_low", "mean_high", "gap", "gini", "palma", digits=6)


@query("q12_place_facilities", f"WITH {WARDS}, {SITES}, {TIMES}, {PEOPLE}, {ACC}, {GROUPS} SELECT ward, round(access, 6) AS access FROM grouped WHERE underserved ORDER BY population * grouped.access DESC, ward LIMIT 5")
@tabled
def q12(t):
    return rounded(q.place_facilities(_grouped(t), 5, population="population", access="access", key="ward").select("ward", "access"), "access", digits=6)


@query(
    "q13_suppress_close",
    f"""WITH RECURSIVE {SITES}, p AS (SELECT a.site AS a, b.site AS b FROM sites a JOIN sites b ON a.site <> b.site WHERE {_km('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 2),
o AS (SELECT site, row_number() OVER (ORDER BY capacity DESC, site) AS i FROM sites), n AS MATERIALIZED (SELECT o.site::BIGINT AS site, o.i, coalesce(list(p.b::BIGINT) FILTER (WHERE p.b IS NOT NULL), []) AS near FROM o LEFT JOIN p ON p.a = o.site GROUP BY 1, 2),
r(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.i, CASE WHEN list_has_any(near, kept) THEN kept ELSE list_append(kept, site) END FROM r JOIN n ON n.i = r.i + 1)
SELECT s.site FROM sites s WHERE s.site IN (SELECT unnest(kept) FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1))""",
)
@tabled
def q13(t):
    return q.suppress_near(t.sites, key="site", size="capacity", km=2.0).select("site")


@query("q14_weighted_time_change", f"WITH {WARDS}, {SITES}, {TIMES}, {PEOPLE}, m AS (SELECT ward, min(CASE WHEN capacity > 5000 THEN travel_min END) AS a, min(CASE WHEN capacity > 0 THEN travel_min END) AS b FROM times GROUP BY 1), w AS (SELECT sum(a * population) / sum(population) AS before, sum(b * population) / sum(population) AS after FROM m JOIN people USING (ward)) SELECT round(before, 6) AS before, round(after, 6) AS after, round((before - after) / before * 100, 6) AS reduction_pct FROM w")
@tabled
def q14(t):
    df = q.weighted_time_change(_times(t), _people(t), ward="ward", population="population", before=F.col("capacity") > 5000, after=F.col("capacity") > 0)
    return rounded(df, "before", "after", "reduction_pct", digits=6)


@query(
    "q16_transit_extensions",
    f"""WITH {SITES}, {WARDS}, {ROADS}, {NETWORK_TIMES}, {PEOPLE},
d AS (SELECT n.src, n.dst, n.minutes, x.population::DOUBLE * y.population / (n.minutes + 1) * 0.0001::DOUBLE AS demand FROM network_times n JOIN people x ON x.ward = n.src JOIN people y ON y.ward = n.dst WHERE n.src <> n.dst),
p AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(demand) AS demand, min(minutes) AS minutes FROM d GROUP BY 1, 2),
top AS (SELECT * FROM p QUALIFY row_number() OVER (ORDER BY demand DESC, src, dst) <= floor((SELECT count(*) FROM p) * 0.2::DOUBLE)),
k AS (SELECT top.*, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) * 111 AS km FROM top JOIN wards a ON a.ward = src JOIN wards b ON b.ward = dst),
s AS (SELECT *, greatest(0, minutes - km / 40 * 60) AS saved, km * 150e6::DOUBLE AS cost FROM k WHERE km > 1 AND km < 15), r AS (SELECT *, demand * 1.2::DOUBLE * saved * 1000 AS benefit FROM s)
SELECT src, dst, round(km, 6) AS km, round(saved, 6) AS saved_min, round(benefit, 1) AS benefit, round(benefit / cost, 9) AS bc_ratio FROM r ORDER BY r.benefit / cost DESC, src, dst LIMIT 100""",
)
@tabled
def q16(t):
    """Lines between the pairs of wards with the most trips."""
    demand = q.gravity_by_time(network_times(t), _people(t), key="ward", population="population")
    found = q.transit_extensions(demand, t.wards, key="ward")
    return rounded(rounded(rounded(found.select("src", "dst", "km", "saved_min", "benefit", "bc_ratio"), "km", "saved_min", digits=6), "benefit", digits=1), "bc_ratio", digits=9)


@query("q15_road_upgrades")
@tabled
def q15_roads(t):
    """Upgrades of the roads between wards, three of which lead on from each."""
    w = t.wards.select("ward", "lon", "lat")
    ends = w.select(F.col("ward").alias("src"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("k")).withColumn("dst", F.col("src") + F.col("k"))
    km = haversine_km(F.col("x"), F.col("y"), F.col("lon"), F.col("lat"))
    edges = ends.join(w.withColumnRenamed("ward", "dst"), "dst").select("src", "dst", km.alias("km"), (km / 35 * 60).alias("minutes"), F.lit(2).alias("lanes"))
    nodes = w.select(F.col("ward").alias("id"))
    importance = g.edge_betweenness(edges.select("src", "dst", F.col("minutes").alias("weight")), nodes, weight="weight")
    halves = importance.withColumn("betweenness", F.col("betweenness") / 2)  # each pair is met from both ends
    times = routes.distances(routes.route_index(routes.both_ways(edges, "minutes")), nodes, nodes).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("distance").alias("minutes"))
    demand = q.gravity_by_time(times, _people(t), key="ward", population="population")
    found = q.road_upgrades(edges, halves, demand).orderBy(F.desc("bc_ratio"), "src", "dst").limit(100)
    return rounded(found.select("src", "dst", "importance", "saved_min", "benefit", "bc_ratio"), "importance", "saved_min", "benefit", "bc_ratio", digits=6)


PROJECTS = f"projects AS (SELECT src, dst, src * 1000 + dst AS project, CASE WHEN src % 2 = 0 THEN 'road' ELSE 'transit' END AS type, flow * 3.0::DOUBLE AS benefit, 50.0::DOUBLE + (src * 7 + dst * 13) % 40 AS cost, flow * 3.0::DOUBLE / (50.0 + (src * 7 + dst * 13) % 40) AS bc_ratio FROM flows)"


def _projects(t):
    df = od_flows(t).withColumn("project", F.col("src") * 1000 + F.col("dst")).withColumn("type", F.when(F.col("src") % 2 == 0, "road").otherwise("transit"))
    return q.cost_benefit(df, F.col("flow") * 3.0, 50.0 + (F.col("src") * 7 + F.col("dst") * 13) % 40)


@query("q15_q16_project_catalogue", f"WITH {FLOWS}, {PROJECTS} SELECT project, type, round(bc_ratio, 9) AS bc_ratio FROM projects ORDER BY projects.bc_ratio DESC, project LIMIT 100")
@tabled
def q15(t):
    return rounded(q.best_projects(_projects(t), 100, key="project").select("project", "type", "bc_ratio"), "bc_ratio", digits=9)


@query(
    "q17_within_budget",
    f"""WITH RECURSIVE {FLOWS}, {PROJECTS}, c AS MATERIALIZED (SELECT project, cost::DOUBLE AS cost, row_number() OVER (ORDER BY bc_ratio DESC, project) AS i FROM projects QUALIFY i <= 100),
r(i, project, cost, spent, taken) AS (SELECT 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, FALSE UNION ALL SELECT c.i, c.project, c.cost, CASE WHEN r.spent + c.cost <= 2500 THEN r.spent + c.cost ELSE r.spent END, r.spent + c.cost <= 2500 FROM r JOIN c ON c.i = r.i + 1)
SELECT project, cost, spent FROM r WHERE taken""",
)
@tabled
def q17(t):
    return q.within_budget(q.best_projects(_projects(t), 100, key="project"), 2500.0, key="project").select("project", "cost", "spent")


@query("q18_portfolio", f"WITH {FLOWS}, {PROJECTS} SELECT type, count(*) AS projects, sum(cost) AS cost, sum(benefit) AS benefit, round(sum(benefit) / sum(cost), 9) AS bc_ratio, sum(benefit / 3 * 0.5) AS saved_min FROM projects GROUP BY 1")
@tabled
def q18(t):
    return rounded(q.portfolio(_projects(t).withColumn("saved_min", F.col("flow") * 0.5)), "bc_ratio", digits=9)


@query("q19_sector_counts", f"WITH {PEOPLE} SELECT n_regionkey AS sector, CAST(sum(population) AS BIGINT) AS population, CAST(ceil(sum(population) / 1000.0 * CASE n_regionkey WHEN 1 THEN 3.0 ELSE 2.0 END) AS BIGINT) AS beds FROM people JOIN nation ON n_nationkey = ward GROUP BY 1")
@tabled
def q19(t):
    df = _people(t).join(small(t.wards.select("ward", "sector")), "ward").groupBy("sector").agg(F.sum("population").alias("population"))
    return df.withColumn("beds", F.ceil(F.col("population") / 1000.0 * F.when(F.col("sector") == 1, 3.0).otherwise(2.0)))


@query("q20_population_lookup", f"WITH {PANEL}, {PEOPLE}, f AS (SELECT ward, CAST(sum(n) AS BIGINT) AS p FROM panel WHERE year(month) = 2001 AND demand > 400000 GROUP BY 1) SELECT p.ward, CAST(coalesce(f.p, p.population) AS BIGINT) AS population FROM people p LEFT JOIN f USING (ward)")
@tabled
def q20(t):
    f = t.panel.where("year(month) = 2001 AND demand > 400000").groupBy("ward").agg(F.sum("n").alias("p"))
    return _people(t).join(f, "ward", "left").select("ward", F.coalesce("p", "population").alias("population"))


@query("r18_sector_priority", f"WITH {PEOPLE}, x AS (SELECT ward, (population - min(population) OVER ()) / (max(population) OVER () - min(population) OVER () + 1e-9) AS p, greatest(0, income) / 10000 AS risk FROM people) SELECT ward, round(p * risk, 7) AS priority FROM x")
@tabled
def r18(t):
    df = a.min_max(_people(t).select("ward", F.col("population").cast("double").alias("population"), (F.greatest(F.lit(0.0), "income") / 10000).alias("risk")), ["population"])
    return rounded(df.select("ward", (F.col("population") * F.col("risk")).alias("priority")), "priority", digits=7)
