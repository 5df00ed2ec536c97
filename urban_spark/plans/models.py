"""Queries for statistics, clusters, forecasts and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urban_spark.operators import cluster as c
from urban_spark.operators import forecast as f
from urban_spark.operators import panel as w
from urban_spark.operators import stats as s
from urban_spark.plans.base import PANEL, query, rounded, tabled

X = ["l_quantity", "l_discount", "l_tax"]
#: Wards side by side in the order of their keys, as on a ring: neighbours are one and two steps away.
RING = """v AS (SELECT c_nationkey AS ward, avg(c_acctbal) AS x, count(*)::DOUBLE AS y FROM customer GROUP BY 1), e AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM
  (SELECT DISTINCT a.ward AS src, b.ward AS dst FROM v a JOIN v b ON (b.ward - a.ward + 25) % 25 IN (1, 2, 23)))"""


def _ring(t):
    v = t.customer.groupBy(F.col("c_nationkey").alias("ward")).agg(F.avg("c_acctbal").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    step = F.explode(F.array(F.lit(1), F.lit(2), F.lit(23)))
    e = v.select(F.col("ward").alias("src"), step.alias("k")).select("src", ((F.col("src") + F.col("k")) % 25).alias("dst"))
    return v, s.row_standardized(e.join(v.select(F.col("ward").alias("dst")), "dst", "left_semi"))


@query("m1_ols", "SELECT 'const' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem")
@tabled
def m1(t):
    return rounded(s.ols(t.lineitem, "l_extendedprice", ["l_quantity"]).table(t.lineitem).select("term", "coefficient"), "coefficient", digits=4)


@query(
    "m2_ols_hc3",
    """WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem),
r AS (SELECT l_quantity - m AS d, (l_extendedprice - a - b * l_quantity) / (1 - 1.0::DOUBLE / n - pow(l_quantity - m, 2) / sxx) AS u, sxx FROM lineitem, b)
SELECT 'l_quantity' AS term, round(sqrt(sum(d * d * u * u)) / any_value(sxx), 5) AS se FROM r""",
)
@tabled
def m2(t):
    return rounded(s.ols(t.lineitem, "l_extendedprice", ["l_quantity"], "HC3").table(t.lineitem).where("term = 'l_quantity'").select("term", "se"), "se", digits=5)


@query("m3_ols_clustered")
@tabled
def m3(t):
    return rounded(s.ols(t.lineitem, "l_extendedprice", X, "cluster", cluster="l_suppkey").table(t.lineitem), "coefficient", "se", "t", digits=4)


@query("m3_ols_hac")
@tabled
def m3_hac(t):
    months = t.panel.groupBy("month").agg(F.sum("demand").alias("y"), F.sum("n").alias("x"))
    return rounded(s.ols(months, "y", ["x"], "HAC", order="month").table(months), "coefficient", "se", "t", digits=3)


@query("m4_vif", "SELECT unnest(['l_quantity', 'l_extendedprice']) AS term, round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 5) AS vif FROM lineitem")
@tabled
def m4(t):
    return rounded(s.vif(t.lineitem, ["l_quantity", "l_extendedprice"]), "vif", digits=5)


@query("m5_condition_number", "SELECT round(sqrt((1 + abs(r)) / (1 - abs(r))), 5) AS condition_number FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)")
@tabled
def m5(t):
    return t.spark.createDataFrame([(round(s.condition_number(t.lineitem, ["l_quantity", "l_extendedprice"]), 5),)], "condition_number double")


@query("m6_glm_poisson", "WITH g AS (SELECT CAST(o_totalprice > 150000 AS INTEGER) AS x, avg(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS m FROM orders GROUP BY 1) SELECT 'const' AS term, round(ln(m), 6) AS coefficient FROM g WHERE x = 0 UNION ALL SELECT 'x', round(ln(a.m) - ln(b.m), 6) FROM g a, g b WHERE a.x = 1 AND b.x = 0")
@tabled
def m6(t):
    df = t.orders.select((F.col("o_totalprice") > 150000).cast("int").alias("x"), F.substring("o_orderpriority", 1, 1).cast("double").alias("y"))
    return rounded(s.glm(df, "y", ["x"]).table(df).select("term", "coefficient"), "coefficient", digits=6)


@query("m7_glm_negative_binomial", "WITH g AS (SELECT CAST(o_totalprice > 150000 AS INTEGER) AS x, avg(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) AS m FROM orders GROUP BY 1) SELECT 'const' AS term, round(ln(m), 6) AS coefficient FROM g WHERE x = 0 UNION ALL SELECT 'x', round(ln(a.m) - ln(b.m), 6) FROM g a, g b WHERE a.x = 1 AND b.x = 0")
@tabled
def m7(t):
    df = t.orders.select((F.col("o_totalprice") > 150000).cast("int").alias("x"), F.substring("o_orderpriority", 1, 1).cast("double").alias("y"))
    return rounded(s.glm(df, "y", ["x"], "negative_binomial").table(df).select("term", "coefficient"), "coefficient", digits=6)


@query("m8_spatial_lag", f"WITH {RING} SELECT v.ward, round(coalesce(sum(w * n.x), 0), 4) AS \"W_x\", round(coalesce(sum(w * n.y), 0), 6) AS \"W_y\" FROM v LEFT JOIN e ON e.src = v.ward LEFT JOIN v n ON n.ward = e.dst GROUP BY 1")
@tabled
def m8(t):
    v, e = _ring(t)
    return rounded(rounded(s.spatial_lag(v, e, ["x", "y"], key="ward").select("ward", "W_x", "W_y"), "W_x", digits=4), "W_y", digits=6)


@query("m9_spatial_lag_regression", f"WITH {RING}, l AS (SELECT v.ward, any_value(v.x) AS x, coalesce(sum(w * n.x), 0) AS wx FROM v LEFT JOIN e ON e.src = v.ward LEFT JOIN v n ON n.ward = e.dst GROUP BY 1) SELECT 'const' AS term, round(regr_intercept(x, wx), 3) AS coefficient FROM l UNION ALL SELECT 'W_x', round(regr_slope(x, wx), 6) FROM l")
@tabled
def m9(t):
    v, e = _ring(t)
    fit = s.ols(s.spatial_lag(v, e, ["x"], key="ward"), "x", ["W_x"]).table(v)
    return fit.select("term", F.when(F.col("term") == "const", F.round("coefficient", 3)).otherwise(F.round("coefficient", 6)).alias("coefficient"))


@query("m10_m13_moran", f"WITH {RING}, m AS (SELECT avg(x) AS m, var_pop(x) AS s, count(*) AS n FROM v) SELECT n, round(sum(e.w * (a.x - m) * (b.x - m)) / (any_value(s) * sum(e.w)), 7) AS i, round(-1.0::DOUBLE / (n - 1), 7) AS expected FROM e JOIN v a ON a.ward = e.src JOIN v b ON b.ward = e.dst, m GROUP BY n")
@tabled
def m10(t):
    v, e = _ring(t)
    return rounded(s.moran(v, e, "x", key="ward").select("n", "i", "expected"), "i", "expected", digits=7)


@query("m10_moran_permutations")
@tabled
def m10_p(t):
    v, e = _ring(t)
    return rounded(s.moran(v, e, "x", key="ward", permutations=999), "i", "expected", "z", "p", digits=6)


@query(
    "m11_local_moran",
    f"""WITH {RING}, m AS (SELECT avg(x) AS m, var_pop(x) AS s, count(*)::DOUBLE AS n FROM v),
l AS (SELECT v.ward, any_value(v.x - m) AS d, coalesce(sum(w * (o.x - m)), 0) AS wd, sum(w) AS w1, sum(w * w) AS w2, any_value(s) AS s, any_value(n) AS n FROM v LEFT JOIN e ON e.src = v.ward LEFT JOIN v o ON o.ward = e.dst, m GROUP BY 1),
k AS (SELECT *, d * wd / s AS i, CASE WHEN d > 0 AND wd > 0 THEN 'HH' WHEN d <= 0 AND wd <= 0 THEN 'LL' WHEN d > 0 THEN 'HL' ELSE 'LH' END AS quadrant,
  (wd + w1 * d / (n - 1)) / sqrt(((n * s - d * d) / (n - 1) - pow(d / (n - 1), 2)) * (w2 - w1 * w1 / (n - 1)) * (n - 1) / (n - 2)) AS z FROM l),
p AS (SELECT *, {s.NORMAL_P} AS p FROM k)
SELECT ward, round(i, 6) AS local_i, quadrant, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN p.p < 0.05 THEN quadrant ELSE 'NotSig' END AS label FROM p""",
)
@tabled
def m11(t):
    v, e = _ring(t)
    return rounded(s.local_moran(v, e, "x", key="ward"), "local_i", "z", "p", digits=6)


@query(
    "m12_getis_ord",
    f"""WITH {RING}, n AS (SELECT count(*) AS n, sum(x) AS s1, sum(x * x) AS s2 FROM v), k AS (SELECT e.src AS ward, sum(b.x) AS s, count(*)::DOUBLE AS k FROM e JOIN v b ON b.ward = e.dst GROUP BY 1),
g AS (SELECT ward, s / (s1 - x) AS g, k / (n - 1) AS ex, n, k, (s1 - x) / (n - 1) AS m, (s2 - x * x) / (n - 1) - pow((s1 - x) / (n - 1), 2) AS var FROM k JOIN v USING (ward), n),
h AS (SELECT ward, g, (g - ex) / sqrt(k * (n - 1 - k) * var / (pow(n - 1, 2) * (n - 2) * m * m)) AS z FROM g)
SELECT ward, round(g, 7) AS g, round(z, 6) AS z, round({s.NORMAL_P}, 6) AS p FROM h""",
)
@tabled
def m12(t):
    v, e = _ring(t)
    return rounded(rounded(s.getis_ord(v, e, "x", key="ward"), "g", digits=7), "z", "p", digits=6)


@query("m1_p_values")
@tabled
def m1_p(t):
    """Coefficients with p by Student's distribution, and with HC3 errors by the normal one."""
    plain, robust = (s.ols(t.customer, "c_acctbal", ["c_nationkey"], r).table(t.customer) for r in (None, "HC3"))
    return rounded(plain.withColumn("errors", F.lit("plain")).unionByName(robust.withColumn("errors", F.lit("HC3"))), "coefficient", "se", "t", "p", digits=6)


@query(
    "m14_influence",
    """WITH b AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m, regr_sxx(y, x) AS sxx, count(*) AS n, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS rss FROM (SELECT c_acctbal AS y, c_nationkey AS x FROM customer)),
h AS (SELECT c_custkey, 1.0::DOUBLE / n + pow(c_nationkey - m, 2) / sxx AS h, c_acctbal - a - b * c_nationkey AS e, n, rss FROM customer, b)
SELECT c_custkey, round(h, 9) AS leverage, round(e * e * h / (2 * rss / (n - 2) * pow(1 - h, 2)), 9) AS cooks_d FROM h""",
)
@tabled
def m14(t):
    fit = s.ols(t.customer, "c_acctbal", ["c_nationkey"])
    return rounded(s.influence(t.customer, fit, "c_acctbal").select("c_custkey", "leverage", "cooks_d"), "leverage", "cooks_d", digits=9)


M15 = """WITH x AS (SELECT replica, l_returnflag AS g, l_extendedprice AS y, l_quantity AS x, md5(l_orderkey || '-' || l_linenumber || '-' || replica) < '1' AS masked FROM lineitem, (SELECT unnest(range(1, 9)) AS replica)),
i AS (SELECT replica, y, masked, CASE WHEN masked THEN avg(x) FILTER (WHERE NOT masked) OVER (PARTITION BY replica, g) ELSE x END AS x FROM x),
f AS (SELECT CAST(replica AS INTEGER) AS replica, 'complete' AS arm, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM i WHERE NOT masked GROUP BY 1 UNION ALL SELECT CAST(replica AS INTEGER), 'imputed', regr_slope(y, x), regr_intercept(y, x) FROM i GROUP BY 1)
SELECT replica, arm, 'const' AS term, round(a, 3) AS coefficient FROM f UNION ALL SELECT replica, arm, 'l_quantity', round(b, 3) FROM f"""


@query("m15_masked_refits", M15)
@tabled
def m15(t):
    """Refits on eight replicas with a sixteenth of the values masked: complete rows only, and with group means put in."""
    mask = lambda replica: F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), replica.cast("string")).cast("binary")) < "1"
    return rounded(s.masked_refits(t.lineitem, "l_extendedprice", ["l_quantity"], "l_quantity", mask, replicas=8, group="l_returnflag"), "coefficient", digits=3)


@query(
    "m15_imputed_refits",
    """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS g, o_totalprice AS y, c_acctbal AS x, c_nationkey * 10.0::DOUBLE + c_acctbal / 100 AS z FROM orders JOIN customer ON o_custkey = c_custkey),
x AS (SELECT CAST(replica AS INTEGER) AS replica, g, y, x, z, md5(k || '-' || replica) < '1' AS masked FROM o, (SELECT unnest(range(1, 101)) AS replica)),
b AS (SELECT replica, g, regr_slope(x, z) AS slope, regr_intercept(x, z) AS start FROM x WHERE NOT masked GROUP BY 1, 2), i AS (SELECT x.replica, y, masked, CASE WHEN masked THEN start + slope * z ELSE x END AS x FROM x JOIN b ON b.replica = x.replica AND b.g = x.g),
f AS (SELECT replica, 'complete' AS arm, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM i WHERE NOT masked GROUP BY 1 UNION ALL SELECT replica, 'imputed', regr_slope(y, x), regr_intercept(y, x) FROM i GROUP BY 1)
SELECT replica, arm, 'const' AS term, round(a, 3) AS coefficient FROM f UNION ALL SELECT replica, arm, 'income', round(b, 3) FROM f""",
)
@tabled
def m15_imputed(t):
    """A hundred replicas with a sixteenth of the incomes taken away: complete rows only, and with a regression on another measure, by priority, put in."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("c_acctbal").alias("income"), (F.col("c_nationkey") * 10.0 + F.col("c_acctbal") / 100).alias("z"))
    mask = lambda replica: F.md5(F.concat_ws("-", F.col("o_orderkey").cast("string"), replica.cast("string")).cast("binary")) < "1"
    return rounded(s.imputed_refits(rows, "o_totalprice", ["income"], "income", mask, predictors=["z"], group="o_orderpriority"), "coefficient", digits=3)


@query("m11_local_moran_permuted")
@tabled
def m11_permuted(t):
    v, e = _ring(t)
    return rounded(s.local_moran_permuted(v, e, "x", key="ward"), "local_i", "p", "z", digits=6)


def _treated(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return df.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("treated"), (F.col("c_acctbal") / 1000).alias("x1"), (F.col("c_nationkey") / 10).alias("x2"), F.col("o_totalprice").alias("y"))


@query("m16_propensity_match")
@tabled
def m16(t):
    df = s.propensity(_treated(t), "treated", ["x1", "x2"])
    return rounded(s.att(df, s.nearest_scores(df, key="o_orderkey", treated="treated", score="score"), "y", key="o_orderkey"), "att", digits=1)


@query(
    "j22_nearest_score",
    """WITH r AS (SELECT c_custkey AS k, CAST(c_custkey % 7 = 0 AS INTEGER) AS treated, (c_acctbal + 1000) / 12000 AS score FROM customer)
SELECT a.k AS k, b.k AS match, round(abs(a.score - b.score), 9) AS gap FROM r a, r b WHERE a.treated = 1 AND b.treated = 0 QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY abs(a.score - b.score), CASE WHEN b.score <= a.score THEN 0 ELSE 1 END, CASE WHEN b.score <= a.score THEN -b.k ELSE b.k END) = 1""",
)
@tabled
def j22(t):
    df = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 7 == 0).cast("int").alias("treated"), ((F.col("c_acctbal") + 1000) / 12000).alias("score"))
    return rounded(s.nearest_scores(df, key="k", treated="treated", score="score"), "gap", digits=9)


M17 = """WITH r AS (SELECT c_custkey AS k, CAST(c_custkey % 7 = 0 AS INTEGER) AS treated, CAST(floor((c_acctbal + 1000) / 1200) AS BIGINT) AS stratum, c_acctbal + c_nationkey AS y FROM customer),
e AS (SELECT 0 AS run, k, treated, stratum, y FROM r UNION ALL
  SELECT run, k, CAST(row_number() OVER (PARTITION BY run, stratum ORDER BY md5(k || '-' || run), k) <= sum(treated) OVER (PARTITION BY run, stratum) AS INTEGER), stratum, y FROM r, (SELECT unnest(range(1, 100)) AS run)),
s AS (SELECT run, stratum, sum(treated) AS n, avg(CASE WHEN treated = 1 THEN y END) - avg(CASE WHEN treated = 0 THEN y END) AS d FROM e GROUP BY 1, 2),
a AS (SELECT run, sum(n * d) / sum(CASE WHEN d IS NOT NULL THEN n END) AS att FROM s GROUP BY 1)
SELECT round(any_value(b.att), 6) AS att, count(*) AS runs, (count(*) FILTER (WHERE abs(a.att) >= abs(b.att)) + 1) / (count(*) + 1.0)::DOUBLE AS p FROM a, (SELECT att FROM a WHERE run = 0) b WHERE a.run > 0"""


@query("m17_permuted_effect", M17)
@tabled
def m17(t):
    """Effect on the treated, matched within strata of a score, and its share among 99 reassignments within the strata."""
    k = F.col("c_custkey")
    df = t.customer.select(k.alias("k"), (k % 7 == 0).cast("int").alias("treated"), F.floor((F.col("c_acctbal") + 1000) / 1200).alias("stratum"), (F.col("c_acctbal") + F.col("c_nationkey")).alias("y"))
    order = lambda run: F.md5(F.concat_ws("-", F.col("k").cast("string"), run.cast("string")).cast("binary"))
    return rounded(s.permuted_att(df, "y", treated="treated", stratum="stratum", key="k", order=order, runs=99), "att", digits=6)


@query("m18_two_stage", "SELECT 'fitted' AS term, round(covar_pop(l_extendedprice, z) / covar_pop(l_quantity, z), 2) AS coefficient FROM (SELECT *, l_quantity + l_suppkey % 5 AS z FROM lineitem)")
@tabled
def m18(t):
    fit, _ = s.two_stage(t.lineitem.withColumn("z", F.col("l_quantity") + F.col("l_suppkey") % 5), "l_extendedprice", "l_quantity", [], ["z"])
    return rounded(fit.table(t.lineitem).where("term = 'fitted'").select("term", "coefficient"), "coefficient", digits=2)


@query("m19_difference_in_differences", "WITH g AS (SELECT CAST(o_custkey % 2 AS INTEGER) AS treated, CAST(year(o_orderdate) >= 1998 AS INTEGER) AS after, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT 'did' AS term, round(sum(CASE WHEN treated = after THEN m ELSE -m END), 3) AS coefficient FROM g")
@tabled
def m19(t):
    df = t.orders.select((F.col("o_custkey") % 2).cast("int").alias("treated"), (F.year("o_orderdate") >= 1998).cast("int").alias("after"), F.col("o_totalprice").alias("y"))
    return rounded(s.difference_in_differences(df, "y", "treated", "after").table(df).where("term = 'did'").select("term", "coefficient"), "coefficient", digits=3)


@query("m20_slopes", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
@tabled
def m20(t):
    return rounded(rounded(s.slopes(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice"), "slope", digits=4), "intercept", digits=3)


@query("m21_scaled", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer WHERE c_mktsegment <> 'BUILDING')) / (SELECT stddev_pop(c_acctbal) FROM customer WHERE c_mktsegment <> 'BUILDING'), 7) AS c_acctbal FROM customer")
@tabled
def m21(t):
    return rounded(s.scaled(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_acctbal"], F.col("c_mktsegment") != "BUILDING").drop("c_mktsegment"), "c_acctbal", digits=7)


def _points(t):
    return t.embeddings.select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)))


@query("m22_kmeans")
@tabled
def m22(t):
    return rounded(c.kmeans(_points(t), [f"e{i}" for i in range(8)], [2, 4])[0], "inertia", "silhouette", digits=1)


@query("m22_centroids")
@tabled
def m22_centroids(t):
    """Labels' sizes and their centres in the columns' own units, of groups found on scaled columns."""
    features = [f"e{i}" for i in range(8)]
    points = _points(t)
    scaled = s.scaled(points, features, F.lit(True))
    labels = c.kmeans(scaled, features, [4])[1][4].select("vec_id", "label")
    return rounded(c.centroids(points.join(labels, "vec_id"), features), *features, digits=4)


@query("m22_labels")
@tabled
def m22_labels(t):
    return c.kmeans(_points(t), [f"e{i}" for i in range(8)], [4])[1][4].select("vec_id", "label")


@query("m23_dbscan")
@tabled
def m23(t):
    return c.dbscan(t.homes.select("home", "lon", "lat"), ["lon", "lat"], key="home", eps=0.004, least=4)


@query("m24_hierarchy")
@tabled
def m24(t):
    return c.hierarchy(_points(t), [f"e{i}" for i in range(8)]).groupBy("label").count()


@query("m25_capped_assignment")
@tabled
def m25(t):
    """Homes to the sectors' middles, each with a fifth of the homes and of their incomes, within 5 %."""
    centers = t.wards.groupBy(F.col("sector").alias("center")).agg(F.avg("lon").alias("cx"), F.avg("lat").alias("cy"))
    rows = t.homes.select("home", F.lit(1.0).alias("people"), F.greatest(F.col("income"), F.lit(0.0)).alias("income"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return c.balanced_assignment(rows, centers, ("people", "income"), key="home")


@query("m26_sanity", "SELECT count(*) AS n, FALSE AS constant_target, 'k' AS constant_features FROM customer")
@tabled
def m26(t):
    return s.sanity(t.customer.withColumn("k", F.lit(3)), "c_acctbal", ["c_nationkey", "k"])


@query("a17_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in X for b in X))
@tabled
def a17(t):
    return rounded(s.correlations(t.lineitem, X), "r", digits=6)


@query("f1_time_split", f"WITH {PANEL} SELECT ward, month, CASE WHEN month <= DATE '2000-06-01' THEN 'train' ELSE 'test' END AS part FROM panel WHERE month <= DATE '2001-06-01'")
@tabled
def f1(t):
    return f.time_split(t.panel, "2000-06-01").select("ward", "month", "part")


FOLDS = (
    PANEL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY month) AS rn FROM panel), folds AS (SELECT a.ward, a.month AS origin, b.rn - a.rn AS horizon, b.month AS month, b.demand AS actual, a.demand AS forecast
  FROM r a JOIN r b ON a.ward = b.ward AND b.rn BETWEEN a.rn + 1 AND a.rn + 6 WHERE a.rn >= 24 AND (a.rn - 24) % 6 = 0)"""
)


def _folds(t):
    return f.rolling_origin(t.panel, "demand", horizon=6, step=6, least=24)


@query("f3_f4_rolling_origin", f"WITH {FOLDS} SELECT * FROM folds")
@tabled
def f4(t):
    return _folds(t).withColumn("horizon", F.col("horizon").cast("long"))


@query("f2_errors", f"WITH {FOLDS} SELECT ward, round(avg(abs(forecast - actual)), 4) AS mae, round(sqrt(avg(pow(forecast - actual, 2))), 3) AS rmse, round(avg(CASE WHEN abs(actual) > 1e-9 THEN abs((forecast - actual) / actual) END) * 100, 5) AS mape, count(*) AS n FROM folds GROUP BY 1")
@tabled
def f2(t):
    return rounded(rounded(rounded(f.errors(_folds(t), ["ward"]), "mae", digits=4), "rmse", digits=3), "mape", digits=5)


@query("f16_f17_horizon_errors", f"WITH {FOLDS}, u AS (SELECT upto, avg(abs(forecast - actual)) AS mae, sqrt(avg(pow(forecast - actual, 2))) AS rmse FROM folds, (VALUES (2), (4), (6)) e(upto) WHERE horizon <= upto GROUP BY 1) SELECT upto, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(rmse / lag(rmse) OVER (ORDER BY upto) - 1, 7) AS growth FROM u")
@tabled
def f16(t):
    return rounded(rounded(f.horizon_errors(_folds(t), [2, 4, 6]).select("upto", "mae", "rmse", "growth"), "mae", "rmse", digits=3), "growth", digits=7)


@query("f5_holt_winters")
@tabled
def f5(t):
    return rounded(f.holt_winters(t.panel, "demand"), "forecast", digits=1)


@query("f6_decompose")
@tabled
def f6(t):
    return rounded(f.decompose(t.panel, "demand").select("ward", "month", "trend", "seasonal", "residual"), "trend", "seasonal", "residual", digits=2)


@query("f8_tree_forecast")
@tabled
def f8(t):
    df = w.lags(t.panel, "demand", [1, 2, 3])
    out, _ = f.tree_forecast(df, "demand", [f"demand_lag_{k}" for k in (1, 2, 3)], F.col("month") < F.lit("2001-01-01").cast("date"))
    return f.errors(out.withColumn("actual", F.col("demand")), ["ward"])


@query("f10_feature_importance")
@tabled
def f10(t):
    df = w.lags(t.panel, "demand", [1, 2, 3])
    return rounded(f.tree_forecast(df, "demand", [f"demand_lag_{k}" for k in (1, 2, 3)], F.col("month") < F.lit("2001-01-01").cast("date"))[1], "importance", digits=3)


_LAGS, _MEANS = [1, 2, 3, 6, 12], [3, 12]


def _carried_on(t, value: str, kind: str, horizon: int):
    model = f.fit_lag_trees(t.panel, value, _LAGS, _MEANS, F.col("month") < F.lit("2001-01-01").cast("date"), kind=kind)
    return f.recursive_tree_forecast(t.panel, value, f.compiled(model), _LAGS, _MEANS, horizon).withColumns({"target": F.lit(value), "model": F.lit(kind)})


@query("f11_tree_forecast")
@tabled
def f11_trees(t):
    """Both targets of the panel carried on by five years, by a forest and by boosted trees."""
    parts = [_carried_on(t, value, kind, 60) for value in ("demand", "n") for kind in ("forest", "boosted")]
    return rounded(reduce(DataFrame.unionByName, parts), "forecast", digits=3)


@query("f8_boosted_forecast")
@tabled
def f8_boosted(t):
    """Errors of one-step forecasts by boosted trees, for each target."""
    parts = []
    for value in ("demand", "n"):
        train = F.col("month") < F.lit("2001-01-01").cast("date")
        trees = f.compiled(f.fit_lag_trees(t.panel, value, _LAGS, _MEANS, train, kind="boosted"))
        names = f._lag_names(value, _LAGS, _MEANS)
        rows = f.lag_features(t.panel, value, _LAGS, _MEANS).where(~train).dropna(subset=[value, *names])
        rows = rows.select(F.lit(value).alias("target"), F.col(value).cast("double").alias("actual"), trees.predicted(F.array(*names)).alias("forecast"))
        parts.append(f.errors(rows, ["target"]))
    return reduce(DataFrame.unionByName, parts)


@query(
    "f11_recursive_forecast",
    f"""WITH RECURSIVE {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY month DESC) AS rn FROM panel),
s AS (SELECT a.ward, a.month AS d, a.demand AS x1, b.demand AS x2 FROM r a JOIN r b ON a.ward = b.ward AND a.rn = 1 AND b.rn = 2),
f AS (SELECT ward, d, 0 AS h, x1, x2 FROM s UNION ALL SELECT ward, d, h + 1, x1 * 0.61 + x2 * 0.23 + 1000, x1 FROM f WHERE h < 12)
SELECT ward, CAST(d + to_months(h) AS DATE) AS month, h, round(x1, 7) AS forecast FROM f WHERE h > 0""",
)
@tabled
def f11(t):
    return rounded(f.recursive_forecast(t.panel, "demand", [0.61, 0.23], 1000.0, 12), "forecast", digits=7)


@query(
    "f12_f13_f14_f15_adjustments",
    f"""WITH {PANEL}, l AS (SELECT ward, month, n, demand, lag(demand, 12) OVER (PARTITION BY ward ORDER BY month) AS a, lag(demand) OVER (PARTITION BY ward ORDER BY month) AS b FROM panel),
e AS (SELECT *, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (coalesce(a * 0.6, 0) + coalesce(b * 0.4, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END)::DOUBLE END AS e FROM l),
j AS (SELECT *, e * CASE WHEN n > 6 THEN 1.1::DOUBLE WHEN n > 3 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS j FROM e), k AS (SELECT *, CASE WHEN b IS NULL THEN j ELSE greatest(b - abs(b) * 15 / 100, least(b + abs(b) * 15 / 100, j)) END AS k FROM j)
SELECT ward, month, round(k, 7) AS forecast, round(k - 0.1 * abs(k), 7) AS lower, round(k + 0.1 * abs(k), 7) AS upper FROM k""",
)
@tabled
def f14(t):
    df = w.lags(t.panel, "demand", [1, 12])
    e = f.ensemble([(F.col("demand_lag_12"), 0.6), (F.col("demand_lag_1"), 0.4)])
    k = f.clamped(f.adjusted(e, [(F.col("n") > 6, 1.1), (F.col("n") > 3, 1.05)]), F.col("demand_lag_1"), 15)
    low, high = f.bands(F.col("forecast"), 0.1)
    return rounded(df.withColumn("forecast", k).select("ward", "month", "forecast", low.alias("lower"), high.alias("upper")), "forecast", "lower", "upper", digits=7)


@query("f9_preferred_model", "SELECT event_type AS target, user_id AS ward, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 9 END = min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 9 END) OVER (PARTITION BY user_id) AND (event_type IN ('purchase', 'click') OR event_type = min(event_type) OVER (PARTITION BY user_id))")
@tabled
def f9(t):
    df = t.events.groupBy(F.col("event_type").alias("target"), F.col("user_id").alias("ward")).agg(F.count(F.lit(1)).alias("n"))
    return f.preferred(df, ["purchase", "click"], model="target", keys=["ward"])


@query("f18_first_crossing", f"WITH {PANEL} SELECT ward, min(CASE WHEN demand > (SELECT quantile_cont(demand, 0.95) FROM panel) THEN year(month) END) AS year FROM panel GROUP BY ward")
@tabled
def f18(t):
    return f.first_crossing(t.panel, "demand", threshold=0.95, kind="quantile")


@query("f19_combined_panel", f"WITH {PANEL} SELECT ward, month, a.n AS n, b.demand AS demand FROM (SELECT ward, month, n FROM panel WHERE n >= 3) a FULL JOIN (SELECT ward, month, demand FROM panel WHERE demand > 300000) b USING (ward, month)")
@tabled
def f19(t):
    return t.panel.where("n >= 3").select("ward", "month", "n").join(t.panel.where("demand > 300000").select("ward", "month", "demand"), ["ward", "month"], "full")
