"""Queries for cleaning, aggregation, ranks, sets and key joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from urban_spark.functions import text as tx
from urban_spark.operators import agg as a
from urban_spark.operators import clean as c
from urban_spark.operators.sizes import small
from urban_spark.plans.base import HOURLY, PANEL, query, rounded, tabled

DEC = "DECIMAL(18,2)"


def _cents(name: str):
    return F.col(name).cast("decimal(18,2)")


@query("a1_sum_measures", f"SELECT l_suppkey % 25 AS cell, CAST(sum(CAST(l_quantity AS {DEC})) AS DOUBLE) AS l_quantity, CAST(sum(CAST(l_extendedprice AS {DEC})) AS DOUBLE) AS l_extendedprice, count(*) AS n FROM lineitem GROUP BY 1")
@tabled
def a1(t):
    df = t.lineitem.select((F.col("l_suppkey") % 25).alias("cell"), _cents("l_quantity").alias("l_quantity"), _cents("l_extendedprice").alias("l_extendedprice"))
    return a.sum_measures(df, ["cell"], ["l_quantity", "l_extendedprice"]).withColumns({m: F.col(m).cast("double") for m in ("l_quantity", "l_extendedprice")})


@query("a2_count_sum_mean", f"SELECT c_nationkey AS ward, count(*) AS n, CAST(sum(CAST(c_acctbal AS {DEC})) AS DOUBLE) AS total, round(CAST(sum(CAST(c_acctbal AS {DEC})) AS DOUBLE) / count(*), 6) AS mean FROM customer GROUP BY 1")
@tabled
def a2(t):
    total = F.sum(_cents("c_acctbal")).cast("double")
    return t.customer.groupBy(F.col("c_nationkey").alias("ward")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"), F.round(total / F.count(F.lit(1)), 6).alias("mean"))


@query("a3_mean_numeric", "SELECT p_brand, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY 1")
@tabled
def a3(t):
    numeric = a.numeric_columns(t.part, "p_partkey")
    return rounded(rounded(a.mean_measures(t.part, ["p_brand"], numeric), "p_size", digits=6), "p_retailprice", digits=4)


MODE = "SELECT {0} AS k, {1} AS mode FROM (SELECT {0}, {1}, row_number() OVER (PARTITION BY {0} ORDER BY count(*) DESC, {1}) AS rn FROM {2} GROUP BY 1, 2) WHERE rn = 1"


@query("a4_mode", MODE.format("c_nationkey", "c_mktsegment", "customer"))
@tabled
def a4(t):
    return a.mode(t.customer, ["c_nationkey"], "c_mktsegment").withColumnRenamed("c_nationkey", "k")


@query("a5_dominant_key", MODE.format("l_suppkey", "l_shipmode", "(SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)"))
@tabled
def a5(t):
    return a.mode(t.lineitem.withColumn("f", F.concat("l_returnflag", "l_linestatus")), ["l_suppkey"], "f").withColumnRenamed("l_suppkey", "k")


@query(
    "a6_built_up_ratio",
    """WITH b AS (SELECT p_partkey, p_retailprice AS footprint, p_size AS floors, unnest(list_distinct([p_partkey % 40, p_partkey % 17])) AS cell, len(list_distinct([p_partkey % 40, p_partkey % 17])) AS k FROM part)
SELECT cell, round(least(100.0, 100 * sum(footprint / k) / 100000.0), 4) AS built_pct, round(avg(floors), 6) AS mean_floors, count(*) AS buildings FROM b GROUP BY cell""",
)
@tabled
def a6(t):
    k = F.col("p_partkey")
    df = t.part.select(F.array_distinct(F.array(k % 40, k % 17)).alias("cell_ids"), F.col("p_retailprice").alias("footprint"), F.col("p_size").alias("floors"))
    return rounded(rounded(a.built_up_ratio(df, 100000.0), "built_pct", digits=4), "mean_floors", digits=6)


ALLOC = """tot AS (SELECT c_nationkey AS ward, count(*)::DOUBLE * 1000 AS people FROM customer GROUP BY 1), cell AS (SELECT s_suppkey AS cell, s_nationkey AS ward, greatest(s_acctbal, 0) AS w FROM supplier),
alloc AS (SELECT cell, ward, CASE WHEN sum(w) OVER (PARTITION BY ward) > 0 THEN w / sum(w) OVER (PARTITION BY ward) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY ward) END * people AS people FROM cell JOIN tot USING (ward))"""


def _alloc(t):
    totals = t.customer.groupBy(F.col("c_nationkey").alias("ward")).agg((F.count(F.lit(1)).cast("double") * 1000).alias("people"))
    cells = t.supplier.select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("ward"), F.greatest("s_acctbal", F.lit(0.0)).alias("w"))
    return totals, a.allocate_by_weight(totals, cells, key="ward", value="people", weight="w")


@query("a7_allocate_by_weight", f"WITH {ALLOC} SELECT cell, ward, round(people, 4) AS people FROM alloc")
@tabled
def a7(t):
    return rounded(_alloc(t)[1].select("cell", "ward", "people"), "people", digits=4)


@query("a8_reconcile", f"WITH {ALLOC} SELECT ward, people AS source, round(s, 4) AS allocated, round(coalesce(s, 0) - people, 4) + 0.0 AS difference FROM tot LEFT JOIN (SELECT ward, sum(people) AS s FROM alloc GROUP BY 1) USING (ward)")
@tabled
def a8(t):
    totals, allocated = _alloc(t)
    return rounded(a.reconcile(allocated, totals, key="ward", value="people"), "allocated", "difference", digits=4)


@query(
    "a10_od_totals",
    """WITH f AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT coalesce(a.src, b.dst) AS place, coalesce(o, 0) AS outflow, coalesce(i, 0) AS inflow FROM (SELECT src, CAST(sum(flow) AS BIGINT) AS o FROM f GROUP BY 1) a FULL JOIN (SELECT dst, CAST(sum(flow) AS BIGINT) AS i FROM f GROUP BY 1) b ON a.src = b.dst""",
)
@tabled
def a10(t):
    return a.od_totals(od_flows(t))


def od_flows(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("flow"))


@query("a11_panel_summary", f"WITH {PANEL} SELECT ward, round(CAST(sum(CAST(demand AS {DEC})) AS DOUBLE) / count(*), 5) AS mean_demand, arg_min(demand, month) AS first_demand, max(demand) AS max_demand FROM panel GROUP BY ward")
@tabled
def a11(t):
    mean = F.round(F.sum(_cents("demand")).cast("double") / F.count(F.lit(1)), 5)
    return t.panel.groupBy("ward").agg(mean.alias("mean_demand"), F.min_by("demand", "month").alias("first_demand"), F.max("demand").alias("max_demand"))


@query("a12_year_slice", f"WITH {PANEL} SELECT ward, round(avg(n), 6) AS mean_n, CAST(sum(n) AS BIGINT) AS sum_n FROM panel WHERE year(month) = 1998 GROUP BY ward")
@tabled
def a12(t):
    return rounded(t.panel.where(F.year("month") == 1998).groupBy("ward").agg(F.avg("n").alias("mean_n"), F.sum("n").alias("sum_n")), "mean_n", digits=6)


@query(
    "a13_two_level_roll_up",
    f"""WITH {PANEL}, w AS (SELECT ward, arg_max(demand, month) AS last_demand, avg(n) AS mean_n, sum(n) AS people FROM panel GROUP BY ward)
SELECT ward % 5 AS sector, count(*) AS wards, round(CAST(sum(CAST(last_demand AS {DEC})) AS DOUBLE), 2) AS demand, round(avg(mean_n), 6) AS mean_n, CAST(sum(people) AS BIGINT) AS people FROM w GROUP BY 1""",
)
@tabled
def a13(t):
    wards = t.panel.groupBy("ward").agg(F.max_by("demand", "month").alias("last_demand"), F.avg("n").alias("mean_n"), F.sum("n").alias("people"))
    sectors = wards.groupBy((F.col("ward") % 5).alias("sector")).agg(F.count(F.lit(1)).alias("wards"), F.sum(_cents("last_demand")).cast("double").alias("demand"), F.avg("mean_n").alias("mean_n"), F.sum("people").alias("people"))
    return rounded(sectors, "mean_n", digits=6)


@query("a14_row_mean", "SELECT l_returnflag, round(avg((l_discount + l_tax) / 2), 7) AS mean_rate FROM lineitem GROUP BY 1")
@tabled
def a14(t):
    return rounded(t.lineitem.groupBy("l_returnflag").agg(F.avg((F.col("l_discount") + F.col("l_tax")) / 2).alias("mean_rate")), "mean_rate", digits=7)


@query("a15_share_of_total", f"WITH g AS (SELECT n_regionkey AS sector, CAST(sum(CAST(c_acctbal AS {DEC})) AS DOUBLE) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT sector, total, round(total / (SELECT CAST(sum(CAST(total AS {DEC})) AS DOUBLE) FROM g), 6) AS share FROM g")
@tabled
def a15(t):
    df = t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("sector"), _cents("c_acctbal").alias("total"))
    return a.shares(df, ["sector"], "total").select("sector", F.col("total").cast("double").alias("total"), F.round(F.col("share").cast("double"), 6).alias("share"))


PROFILED = ("l_quantity", "l_discount", "l_tax")


@query(
    "a16_profile",
    " UNION ALL ".join(
        f"SELECT '{k}' AS \"column\", count({k}) AS count, count(*) - count({k}) AS missing, round(avg({k}), 7) AS mean, round(stddev_samp({k}), 7) AS std, min({k}) AS min, quantile_cont({k}, 0.25) AS q25, quantile_cont({k}, 0.5) AS q50, quantile_cont({k}, 0.75) AS q75, max({k}) AS max FROM lineitem"
        for k in PROFILED
    ),
)
@tabled
def a16(t):
    return rounded(a.profile(t.lineitem, list(PROFILED)), "mean", "std", digits=7)


@query("a18_histogram", "SELECT CAST(least(floor(l_quantity / 5.0), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
@tabled
def a18(t):
    return a.histogram(t.lineitem, "l_quantity", 0, 50, 10).select("bin", "n")


@query("a19_exceedance", f"WITH {HOURLY}, u AS (SELECT station, CAST(round(total * 10000) AS BIGINT) - 250000 AS u FROM hourly) SELECT station, round(avg(u) / 500000, 5) AS mean, round(max(u) / 500000::DOUBLE, 5) AS max, round(avg(CAST(u > 0 AS DOUBLE)), 9) AS share_above_0, round(avg(CAST(u >= 500000 AS DOUBLE)), 9) AS share_from_1, round(avg(CAST(u >= 1000000 AS DOUBLE)), 9) AS share_from_2 FROM u GROUP BY 1")
@tabled
def a19(t):
    """Severity is total / 50 - 0.5, counted in whole steps of 1 / 500,000."""
    df = a.exceedance(t.hourly.withColumn("sev", F.round(F.col("total") * 10000).cast("long") - 250000), ["station"], "sev", 500000)
    return rounded(rounded(df, "mean", "max", digits=5), "share_above_0", "share_from_1", "share_from_2", digits=9)


@query("a20_quantiles", "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.2), 4) AS p20, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY 1")
@tabled
def a20(t):
    return rounded(a.quantiles(t.customer, "c_acctbal", [0.2, 0.9], ["c_nationkey"]), "p20", "p90", digits=4)


@query("a21_weighted_mean", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 8) AS weighted_mean FROM lineitem GROUP BY 1")
@tabled
def a21(t):
    return rounded(a.weighted_mean(t.lineitem, ["l_suppkey"], "l_discount", "l_quantity"), "weighted_mean", digits=8)


@query("a22_q10_gini", "WITH x AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) AS i, count(*) OVER () AS n FROM customer WHERE c_acctbal >= 0) SELECT any_value(n) AS n, round(sum((2 * i - n - 1) * v) / (any_value(n) * sum(v)), 8) AS gini FROM x")
@tabled
def a22(t):
    return rounded(a.gini(t.customer, "c_acctbal"), "gini", digits=8)


@query("a23_palma", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.9) AS hi, quantile_cont(c_acctbal, 0.4) AS lo FROM customer) SELECT round(sum(CASE WHEN c_acctbal >= hi THEN c_acctbal END) / nullif(sum(CASE WHEN c_acctbal <= lo THEN c_acctbal END), 0), 7) AS palma FROM customer, q")
@tabled
def a23(t):
    return rounded(a.palma(t.customer, "c_acctbal", "c_acctbal"), "palma", digits=7)


@query("a24_value_counts", "SELECT coalesce(o_orderpriority, 'null') AS o_orderpriority, count(*) AS count FROM orders GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM orders")
@tabled
def a24(t):
    return a.value_counts(t.orders, "o_orderpriority")


@query("a26_city_mean", f"WITH {PANEL} SELECT month, round(CAST(sum(CAST(demand AS {DEC})) AS DOUBLE) / count(*), 5) AS demand, count(*) AS wards FROM panel GROUP BY 1")
@tabled
def a26(t):
    return rounded(t.panel.groupBy("month").agg((F.sum(_cents("demand")).cast("double") / F.count(F.lit(1))).alias("demand"), F.count(F.lit(1)).alias("wards")), "demand", digits=5)


@query("a27_annual_by_kind", f"WITH {PANEL} SELECT year(month) AS year, CAST(sum(CAST(demand AS {DEC})) AS DOUBLE) AS demand_sum, round(avg(n), 7) AS n_mean FROM panel GROUP BY 1")
@tabled
def a27(t):
    return rounded(t.panel.groupBy(F.year("month").cast("long").alias("year")).agg(F.sum(_cents("demand")).cast("double").alias("demand_sum"), F.avg("n").alias("n_mean")), "n_mean", digits=7)


@query("a28_metric_summary", "SELECT event_type AS target, round(avg(value), 5) AS mean, round(median(value), 5) AS median, round(stddev_samp(value), 5) AS std FROM events GROUP BY 1")
@tabled
def a28(t):
    df = t.events.groupBy(F.col("event_type").alias("target")).agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"))
    return rounded(df, "mean", "median", "std", digits=5)


@query("a29_nested_mean", "WITH a AS (SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY 1, 2), b AS (SELECT event_type, avg(value) AS value FROM a GROUP BY 1) SELECT event_type, round(value, 5) AS value FROM b")
@tabled
def a29(t):
    return rounded(a.nested_mean(t.events, [["user_id", "event_type"], ["event_type"]], "value"), "value", digits=5)


@query("a30_missing_ratio", "WITH e AS (SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS v, ts FROM events) SELECT 'v' AS \"column\", round(avg(CAST(v IS NULL AS DOUBLE)), 9) AS missing_ratio, avg(CAST(v IS NULL AS DOUBLE)) > 0.1 AS alert FROM e UNION ALL SELECT 'ts', round(avg(CAST(ts IS NULL AS DOUBLE)), 9), avg(CAST(ts IS NULL AS DOUBLE)) > 0.1 FROM e")
@tabled
def a30(t):
    df = t.events.select(F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("v"), "ts")
    return rounded(a.missing_ratio(df, ["v", "ts"], 0.1), "missing_ratio", digits=9)


@query("a31_numeric_mean", "SELECT c_nationkey, round(avg(TRY_CAST(replace(replace(trim(x), ',', ''), ' ', '') AS DOUBLE)), 4) AS mean FROM (SELECT c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE ' ' || CAST(CAST(c_custkey AS BIGINT) AS VARCHAR) || ',000 ' END AS x FROM customer) GROUP BY 1")
@tabled
def a31(t):
    x = F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(",000 ")))
    return rounded(t.customer.select("c_nationkey", tx.to_number(x).alias("x")).groupBy("c_nationkey").agg(F.avg("x").alias("mean")), "mean", digits=4)


@query("o1_sorted_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
@tabled
def o1(t):
    return t.orders.select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("o2_top_by_group_max", f"WITH {PANEL} SELECT ward, max(demand) AS demand FROM panel GROUP BY ward ORDER BY demand DESC, ward LIMIT 20")
@tabled
def o2(t):
    return t.panel.groupBy("ward").agg(F.max("demand").alias("demand")).orderBy(F.desc("demand"), "ward").limit(20)


@query(
    "o3_best_and_worst",
    "WITH e AS (SELECT event_type, user_id, CAST(sum(CAST(value AS DECIMAL(14,4))) AS DOUBLE) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v, user_id) AS lo, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id) AS hi FROM e) SELECT event_type, user_id, v, CASE WHEN lo <= 5 THEN 'lowest' ELSE 'highest' END AS kind FROM r WHERE lo <= 5 OR hi <= 5",
)
@tabled
def o3(t):
    df = t.events.groupBy("event_type", "user_id").agg(F.sum(F.col("value").cast("decimal(14,4)")).cast("double").alias("v"))
    return a.best_and_worst(df, ["event_type"], "v", 5, ["user_id"])


@query("o4_top_fraction", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.7) FROM customer)")
@tabled
def o4(t):
    return a.top_fraction(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 0.3)


@query("o5_top_by_mean", "SELECT l_suppkey, round(avg(l_discount), 9) AS mean FROM lineitem GROUP BY 1 ORDER BY mean DESC, l_suppkey LIMIT 100")
@tabled
def o5(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 9).alias("mean")).orderBy(F.desc("mean"), "l_suppkey").limit(100)


@query("o7_arg_extremes", "SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS richest, arg_min(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY 1")
@tabled
def o7(t):
    return t.customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", "c_acctbal").alias("richest"), F.min_by("c_custkey", "c_acctbal").alias("poorest"))


@query("o8_head_cap", f"WITH {PANEL} SELECT ward, CAST(sum(n) AS BIGINT) AS n FROM panel GROUP BY ward ORDER BY n DESC, ward LIMIT 50")
@tabled
def o8(t):
    return t.panel.groupBy("ward").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ward").limit(50)


@query("u1_tagged_union", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL FROM part")
@tabled
def u1(t):
    return a.tagged_union(
        {
            "customer": t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance"),
            "supplier": t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance"),
            "part": t.part.selectExpr("p_partkey AS id", "p_name AS name"),
        }
    )


@query("u2_distinct_union", "SELECT c_nationkey AS node FROM customer UNION SELECT s_nationkey FROM supplier")
@tabled
def u2(t):
    return t.customer.select(F.col("c_nationkey").alias("node")).union(t.supplier.select("s_nationkey")).distinct()


@query("u3_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
@tabled
def u3(t):
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("u4_intersection", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
@tabled
def u4(t):
    return t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")).intersect(t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("j6_many_to_one", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM nation WHERE n_nationkey <> 3) USING (c_nationkey)")
@tabled
def j6(t):
    names = t.nation.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return a.join_many_to_one(t.customer.select("c_custkey", "c_nationkey"), names, ["c_nationkey"]).select("c_custkey", "n_name")


@query("j10_inner_keys", f"WITH {PANEL} SELECT p.ward, p.month, p.n, q.n AS other FROM panel p JOIN (SELECT ward + 1 AS ward, month, n FROM panel) q USING (ward, month)")
@tabled
def j10(t):
    return t.panel.select("ward", "month", "n").join(t.panel.select((F.col("ward") + 1).alias("ward"), "month", F.col("n").alias("other")), ["ward", "month"])


@query("j11_left_to_dimension", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
@tabled
def j11(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).count()
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("count", F.lit(0)).alias("orders"))


@query(
    "j12_outer_chain",
    f"WITH {PANEL} SELECT ward, month, a.n AS few, b.n AS many, c.demand AS large FROM (SELECT ward, month, n FROM panel WHERE n <= 2) a FULL JOIN (SELECT ward, month, n FROM panel WHERE n >= 2) b USING (ward, month) FULL JOIN (SELECT ward, month, demand FROM panel WHERE demand > 500000) c USING (ward, month)",
)
@tabled
def j12(t):
    p = t.panel
    parts = [p.where("n <= 2").selectExpr("ward", "month", "n AS few"), p.where("n >= 2").selectExpr("ward", "month", "n AS many"), p.where("demand > 500000").selectExpr("ward", "month", "demand AS large")]
    return a.outer_chain(parts, ["ward", "month"])


@query("j13_p19_rule_map", "SELECT c_custkey, CAST(coalesce(weight, 0.5) AS DOUBLE) AS weight, coalesce(label, 'other') AS label FROM customer LEFT JOIN (VALUES ('BUILDING', 1.5, 'built'), ('MACHINERY', 0.8, 'works')) r(seg, weight, label) ON c_mktsegment = seg")
@tabled
def j13(t):
    rules = t.spark.createDataFrame([("BUILDING", 1.5, "built"), ("MACHINERY", 0.8, "works")], "c_mktsegment string, weight double, label string")
    return c.map_by_rules(t.customer.select("c_custkey", "c_mktsegment"), rules, "c_mktsegment", {"weight": 0.5, "label": "other"}).select("c_custkey", "weight", "label")


@query("j19_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
@tabled
def j19(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j20_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
@tabled
def j20(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("p3_to_number", "SELECT c_custkey, TRY_CAST(replace(replace(trim(x), ',', ''), ' ', '') AS DOUBLE) AS v FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE ' 1,' || CAST(c_custkey AS VARCHAR) || '.5 ' END AS x FROM customer)")
@tabled
def p3(t):
    x = F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" 1,"), F.col("c_custkey").cast("string"), F.lit(".5 ")))
    return t.customer.select("c_custkey", tx.to_number(x).alias("v"))


@query("p7_normalized_text", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents")
@tabled
def p7(t):
    return t.documents.select("doc_id", tx.normalized(F.col("text")).alias("t"))


@query("p8_number_in_text", "SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 1000)[1] AS number FROM documents")
@tabled
def p8(t):
    return t.documents.select("doc_id", tx.number_between(F.col("text"), 1, 1000).alias("number"))


@query("p9_text_fields", "SELECT doc_id, nullif(regexp_extract(text, '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 1), '') AS mail, coalesce(nullif(regexp_extract(text, 'password=([a-z0-9]+)', 1), ''), nullif(regexp_extract(text, 'token = \"([a-z0-9]+)', 1), '')) AS secret FROM documents")
@tabled
def p9(t):
    return t.documents.select("doc_id", *tx.fields(F.col("text"), {"mail": ["([A-Za-z0-9._]+@[A-Za-z0-9.]+)"], "secret": ["password=([a-z0-9]+)", 'token = "([a-z0-9]+)']}))


@query("p10_without_tags", "SELECT page_id, md5(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) AS digest FROM pages")
@tabled
def p10(t):
    return t.pages.select("page_id", F.md5(tx.without_tags(F.col("html"))).alias("digest"))


@query("p11_fill_ids", "SELECT c_custkey, CASE WHEN x IS NULL OR trim(x) = '' THEN 'asset_' || c_nationkey || '_' || row_number() OVER (PARTITION BY c_nationkey, (x IS NULL OR trim(x) = '') ORDER BY c_custkey) ELSE x END AS id FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_name END AS x FROM customer)")
@tabled
def p11(t):
    x = F.when(F.col("c_custkey") % 3 == 1, " ").when(F.col("c_custkey") % 3 == 2, F.col("c_name"))
    return c.fill_ids(t.customer.withColumn("id", x), "id", "asset", order="c_custkey", group="c_nationkey").select("c_custkey", "id")


@query("p12_fixed_columns", "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(NULL AS DOUBLE) AS load, c_acctbal AS capacity FROM customer")
@tabled
def p12(t):
    return c.with_columns_in_order(t.customer.selectExpr("c_custkey AS id", "c_acctbal AS capacity"), {"id": "string", "load": "double", "capacity": "double"})


@query("p13_building_type", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'industrial' WHEN lower(p_type) LIKE '%brass%' THEN 'commercial' ELSE 'other' END AS kind FROM part")
@tabled
def p13(t):
    tags = F.create_map(F.lit("building"), F.lit(None).cast("string"), F.lit("amenity"), F.col("p_type"))
    return t.part.select("p_partkey", c.building_type(tags, ["building", "amenity"], [("steel", "industrial"), ("brass", "commercial")]).alias("kind"))


@query("p15_measurement", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(x, '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS v FROM (SELECT p_partkey, 'height: ' || CAST(p_size AS VARCHAR) || '.5 m' AS x FROM part)")
@tabled
def p15(t):
    return t.part.select("p_partkey", tx.measurement(F.concat(F.lit("height: "), F.col("p_size").cast("string"), F.lit(".5 m"))).alias("v"))


@query("p17_overload_flag", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'yes' ELSE 'no' END AS overloaded FROM lineitem")
@tabled
def p17(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 40, "yes").otherwise("no").alias("overloaded"))


@query("p18_fill_with_mean", "SELECT event_id, round(coalesce(v, avg(v) OVER ()), 5) AS v FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)")
@tabled
def p18(t):
    return rounded(c.fill_with_mean(t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v")), "v"), "v", digits=5)


@query("p21_min_max", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer) + 1e-9), 9) AS c_acctbal FROM customer")
@tabled
def p21(t):
    return rounded(a.min_max(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]), "c_acctbal", digits=9)


@query("p20_p22_suitability", "SELECT p_partkey, round(greatest(0.0, least(1.0, 0.5 * p_size / 50.0::DOUBLE + 0.4 * p_retailprice / 2000.0::DOUBLE - 0.1)), 9) AS score FROM part")
@tabled
def p22(t):
    return rounded(t.part.select("p_partkey", c.clipped(0.5 * F.col("p_size") / 50.0 + 0.4 * F.col("p_retailprice") / 2000.0 - 0.1, 0.0, 1.0).alias("score")), "score", digits=9)


@query("p23_p24_clip_and_growth", "SELECT c_custkey, greatest(0.0, least(5000.0, c_acctbal)) AS clipped, round(c_custkey * pow(1 + 0.015, 12)) AS grown FROM customer")
@tabled
def p24(t):
    return t.customer.select("c_custkey", c.clipped(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"), c.grown(F.col("c_custkey"), 0.015, 12).alias("grown"))


@query("p26_keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
@tabled
def p26(t):
    return a.keep_first(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("p28_parse_dates", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
@tabled
def p28(t):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", c.parse_date(raw).alias("month"))


@query("p31_filters", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IS NOT NULL AND strftime(o_orderdate, '%Y-%m') LIKE '1997-0%'")
@tabled
def p31(t):
    d = F.col("o_orderdate")
    return t.orders.where((d >= "1997-01-01") & (d < "1998-01-01") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderstatus").isNotNull() & F.date_format(d, "yyyy-MM").startswith("1997-0")).select("o_orderkey")


@query("p32_p33_quantile_flag", "SELECT c_custkey, CAST(c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.7) FROM customer) AS INTEGER) AS treated, round(ln(1 + greatest(0.0, c_acctbal)), 9) AS logged FROM customer")
@tabled
def p32(t):
    df = c.above_quantile(t.customer, "c_acctbal", 0.7, "treated")
    return df.select("c_custkey", "treated", F.round(c.logged(F.col("c_acctbal")), 9).alias("logged"))


@query("p25_indicators", "WITH f AS (SELECT c_nationkey AS ward, count(*) AS people, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS inflow FROM customer GROUP BY 1) SELECT ward, people / 1000.0::DOUBLE AS people_k, round(people / (10.0::DOUBLE + ward), 9) AS density, CAST(inflow - (people - inflow) AS BIGINT) AS net FROM f")
@tabled
def p25(t):
    f = t.customer.groupBy(F.col("c_nationkey").alias("ward")).agg(F.count(F.lit(1)).alias("people"), F.sum((F.col("c_acctbal") > 0).cast("long")).alias("inflow"))
    return f.select("ward", (F.col("people") / 1000.0).alias("people_k"), F.round(F.col("people") / (10.0 + F.col("ward")), 9).alias("density"), (2 * F.col("inflow") - F.col("people")).alias("net"))
