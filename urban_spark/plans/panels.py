"""Queries over monthly panels, risk and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from urban_spark.operators import panel as w
from urban_spark.operators import risk as r
from urban_spark.plans.base import HOURLY, PANEL, query, rounded, tabled

OVER = "OVER (PARTITION BY ward ORDER BY month)"


@query(
    "slice_panel_severity",
    f"""WITH {PANEL}, f AS (
  SELECT *, lag(demand) {OVER} AS demand_lag_1, avg(demand) OVER (PARTITION BY ward ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM panel
), b AS (SELECT ward, median(demand) AS baseline FROM panel WHERE month < DATE '2000-01-01' GROUP BY ward),
s AS (SELECT f.ward, month, round(demand, 2) AS demand, demand_lag_1, round(m, 5) AS demand_roll_mean_3,
  CASE WHEN baseline IS NULL OR baseline = 0 THEN 0 ELSE least(2.0, greatest(0.0, (demand - baseline) / baseline / 0.5)) END AS sev FROM f LEFT JOIN b USING (ward)),
k AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY sev DESC, month) AS place FROM s)
SELECT ward, month, demand, demand_lag_1, demand_roll_mean_3, round(sev, 6) AS sev, CASE WHEN sev <= 0 THEN 'healthy' WHEN sev < 0.5 THEN 'warning' WHEN sev < 1 THEN 'failure' ELSE 'severe' END AS label, place FROM k WHERE place <= 12""",
)
@tabled
def slice_panel_severity(t):
    """Panel, lag and leak-free mean, severity against the median before 2000, the twelve worst months of each ward."""
    from pyspark.sql import Window

    df = w.rolling_mean(w.lags(t.panel, "demand", [1]), "demand", [3], previous_only=True)
    base = t.panel.where("month < DATE'2000-01-01'").groupBy("ward").agg(F.median("demand").alias("baseline"))
    df = df.join(base, "ward", "left").withColumn("sev", r.severity_relative(F.col("demand"), F.col("baseline"), F.lit(0.5)))
    df = df.withColumn("place", F.row_number().over(Window.partitionBy("ward").orderBy(F.desc("sev"), "month"))).where("place <= 12")
    df = df.withColumn("label", r.severity_label(F.col("sev")))
    return rounded(rounded(rounded(df, "demand", digits=2), "demand_roll_mean_3", digits=5), "sev", digits=6).select("ward", "month", "demand", "demand_lag_1", "demand_roll_mean_3", "sev", "label", "place")


@query("w1_lags", f"WITH {PANEL} SELECT ward, month, {', '.join(f'lag(demand, {k}) {OVER} AS demand_lag_{k}' for k in (1, 2, 3, 6, 12))} FROM panel")
@tabled
def w1(t):
    return w.lags(t.panel, "demand", [1, 2, 3, 6, 12]).drop("demand", "n")


def _frame(a: str, b: str) -> str:
    return f"OVER (PARTITION BY ward ORDER BY month ROWS BETWEEN {a} AND {b})"


@query("w2_rolling_mean", f"WITH {PANEL} SELECT ward, month, {', '.join(f'round(avg(demand) {_frame(f'{k - 1} PRECEDING', 'CURRENT ROW')}, 5) AS demand_roll_mean_{k}' for k in (3, 6, 12, 24))} FROM panel")
@tabled
def w2(t):
    return rounded(w.rolling_mean(t.panel, "demand", [3, 6, 12, 24]), *(f"demand_roll_mean_{k}" for k in (3, 6, 12, 24)), digits=5).drop("demand", "n")


@query(
    "w3_rolling_mean_previous",
    f"WITH {PANEL} SELECT ward, month, {', '.join(f'round(CASE WHEN count(demand) {_frame(f'{k} PRECEDING', '1 PRECEDING')} = {k} THEN avg(demand) {_frame(f'{k} PRECEDING', '1 PRECEDING')} END, 5) AS demand_roll_mean_{k}' for k in (3, 12))} FROM panel",
)
@tabled
def w3(t):
    return rounded(w.rolling_mean(t.panel, "demand", [3, 12], previous_only=True, full_only=True), "demand_roll_mean_3", "demand_roll_mean_12", digits=5).drop("demand", "n")


@query("w4_rolling_std", f"WITH {PANEL} SELECT ward, month, {', '.join(f'round(coalesce(stddev_samp(demand) {_frame(f'{k - 1} PRECEDING', 'CURRENT ROW')}, 0), 1) AS demand_roll_std_{k}' for k in (3, 12))} FROM panel")
@tabled
def w4(t):
    return rounded(w.rolling_std(t.panel, "demand", [3, 12]), "demand_roll_std_3", "demand_roll_std_12", digits=1).drop("demand", "n")


@query(
    "w5_ema",
    f"""WITH RECURSIVE {PANEL}, p AS (SELECT *, row_number() {OVER} AS i FROM panel), e AS (
  SELECT ward, month, demand, i, demand AS ema FROM p WHERE i = 1 UNION ALL
  SELECT p.ward, p.month, p.demand, p.i, 2.0::DOUBLE / 13 * p.demand + (1 - 2.0::DOUBLE / 13) * e.ema FROM e JOIN p ON p.ward = e.ward AND p.i = e.i + 1)
SELECT ward, month, round(ema, 2) AS demand_ema_12 FROM e""",
)
@tabled
def w5(t):
    return rounded(w.ema(t.panel, "demand", 12), "demand_ema_12", digits=2).drop("demand")


@query("w6_differences", f"WITH {PANEL} SELECT ward, month, {', '.join(f'round(demand - lag(demand, {k}) {OVER}, 2) AS demand_diff_{k}' for k in (1, 12))} FROM panel")
@tabled
def w6(t):
    return rounded(w.differences(t.panel, "demand", [1, 12]), "demand_diff_1", "demand_diff_12", digits=2).drop("demand", "n")


@query("w7_position", f"WITH {PANEL} SELECT ward, month, row_number() {OVER} - 1 AS time_idx FROM panel")
@tabled
def w7(t):
    return w.position(t.panel).select("ward", "month", F.col("time_idx").cast("long").alias("time_idx"))


GAPPY = PANEL + ", gappy AS (SELECT ward, month, CASE WHEN n % 3 <> 0 THEN demand END AS demand FROM panel)"


def _gappy(t):
    return t.panel.select("ward", "month", F.when(F.col("n") % 3 != 0, F.col("demand")).alias("demand"))


@query(
    "w8_fill_both_ways",
    f"""WITH {GAPPY} SELECT ward, month, coalesce(last_value(demand IGNORE NULLS) OVER (PARTITION BY ward ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(demand IGNORE NULLS) OVER (PARTITION BY ward ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS demand FROM gappy""",
)
@tabled
def w8(t):
    return w.fill_both_ways(_gappy(t), "demand")


@query(
    "w9_fill_by_medians",
    f"WITH {GAPPY} SELECT ward, month, round(coalesce(demand, (SELECT median(demand) FROM gappy x WHERE x.ward = g.ward), (SELECT median(demand) FROM gappy), 0), 2) AS demand FROM gappy g",
)
@tabled
def w9(t):
    return rounded(w.fill_by_medians(_gappy(t), "demand"), "demand", digits=2)


@query("w10_last_rows", f"WITH {PANEL} SELECT ward, month, demand, n FROM panel QUALIFY row_number() OVER (PARTITION BY ward ORDER BY month DESC) <= 12")
@tabled
def w10(t):
    return w.last_rows(t.panel, 12)


@query(
    "w11_average_rank_percent",
    "WITH c AS (SELECT c_custkey, c_acctbal FROM customer) SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0::DOUBLE) / count(*) OVER () * 30, 6) AS pct FROM c",
)
@tabled
def w11(t):
    return rounded(w.average_rank_percent(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 30.0, "pct"), "pct", digits=6).select("c_custkey", "pct")


INDEXED = PANEL + ", indexed AS (SELECT *, (year(month) - (SELECT min(year(month)) FROM panel)) * 12 + month(month) - 1 AS idx FROM panel)"


@query(
    "w12_longest_runs",
    f"""WITH {INDEXED}, g AS (SELECT ward, idx, idx - row_number() OVER (PARTITION BY ward ORDER BY idx) AS g FROM indexed), r AS (SELECT ward, min(idx) AS begin, count(*) AS length FROM g GROUP BY ward, g)
SELECT ward, begin, length FROM r WHERE TRUE QUALIFY row_number() OVER (PARTITION BY ward ORDER BY length DESC, begin) = 1 AND length >= 6""",
)
@tabled
def w12(t):
    return w.longest_runs(w.month_index(t.panel), 6).select("ward", F.col("begin").cast("long").alias("begin"), "length")


@query(
    "w13_validation_windows",
    f"""WITH {PANEL}, x AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY month DESC) AS rn, count(*) OVER (PARTITION BY ward) AS c FROM panel)
SELECT ward, month, demand, n, CASE WHEN rn <= 12 THEN 'horizon' ELSE 'encoder' END AS part FROM x WHERE rn <= 36 AND c >= 36""",
)
@tabled
def w13(t):
    return w.validation_windows(t.panel, 24, 12)


@query(
    "w14_encoder_windows",
    f"""WITH {PANEL}, x AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ward ORDER BY month DESC) <= 60), y AS (SELECT ward, list(demand ORDER BY month) AS v FROM x GROUP BY ward)
SELECT ward, 60 AS size, v[1] AS first, v[len(v)] AS last, 60 - len(v) AS padded FROM y""",
)
@tabled
def w14(t):
    df = w.encoder_windows(t.panel, "demand", 60)
    size = F.size("window")
    padded = F.size("window") - F.size(F.array_distinct("window"))
    return df.select("ward", size.alias("size"), F.col("window")[0].alias("first"), F.element_at("window", -1).alias("last"), padded.cast("long").alias("padded"))


@query(
    "w15_sliding_windows",
    f"""WITH {PANEL}, x AS (SELECT ward, month, list(demand) OVER (PARTITION BY ward ORDER BY month ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v FROM panel)
SELECT ward, month, v[1:12] AS inputs, v[13:16] AS targets FROM x WHERE len(v) = 16""",
)
@tabled
def w15(t):
    return w.sliding_windows(t.panel, "demand", 12, 4)


@query("w16_step_changes", f"WITH {PANEL}, y AS (SELECT year(month) AS year, count(DISTINCT ward) AS wards FROM panel WHERE demand > 1000000 GROUP BY 1) SELECT year, wards, wards - lag(wards) OVER (ORDER BY year) AS change FROM y")
@tabled
def w16(t):
    years = t.panel.where("demand > 1000000").groupBy(F.year("month").cast("long").alias("year")).agg(F.count_distinct("ward").alias("wards"))
    return w.step_changes(years, "wards", "change", order="year")


@query("w17_first_when", f"WITH {PANEL} SELECT ward, min(CASE WHEN demand > 1500000 THEN month END) AS first_date FROM panel GROUP BY ward")
@tabled
def w17(t):
    return w.first_when(t.panel, F.col("demand") > 1500000, key="ward", date="month")


@query("w18_volatility", f"WITH {PANEL}, x AS (SELECT abs(demand - lag(demand) {OVER}) AS d, abs(n - lag(n) {OVER}) AS m FROM panel) SELECT round(avg(d), 2) AS demand_volatility, round(avg(m), 6) AS n_volatility FROM x")
@tabled
def w18(t):
    return rounded(rounded(w.volatility(t.panel, ["demand", "n"]), "demand_volatility", digits=2), "n_volatility", digits=6)


@query("w19_long_enough", f"WITH {PANEL} SELECT * FROM panel WHERE ward IN (SELECT ward FROM panel GROUP BY ward HAVING count(*) >= 40)")
@tabled
def w19(t):
    return w.long_enough(t.panel, 40)


@query("w20_month_spine", f"WITH {PANEL}, l AS (SELECT ward, max(month) AS m FROM panel GROUP BY ward) SELECT ward, CAST(m + to_months(CAST(i AS INTEGER)) AS DATE) AS month FROM l, range(1, 13) r(i)")
@tabled
def w20(t):
    return w.month_spine(t.panel, 12)


@query(
    "p27_p29_p30_month_features",
    f"""WITH {INDEXED} SELECT ward, month, idx, round(idx / (SELECT greatest(max(idx), 1) FROM indexed)::DOUBLE, 9) AS idx_norm, round(sin((month(month) - 1) * 2 * pi() / 12), 9) + 0.0 AS month_sin,
  round(cos((month(month) - 1) * 2 * pi() / 12), 9) + 0.0 AS month_cos, round(sin(quarter(month) * 2 * pi() / 4), 9) + 0.0 AS quarter_sin, round(cos(quarter(month) * 2 * pi() / 4), 9) + 0.0 AS quarter_cos,
  CAST(month(month) IN (6, 7, 8, 9) AS INTEGER) AS monsoon FROM indexed""",
)
@tabled
def month_features(t):
    df = w.cyclical(w.month_index(t.panel), phase=1)
    return rounded(df, "idx_norm", "month_sin", "month_cos", "quarter_sin", "quarter_cos", digits=9).select("ward", "month", F.col("idx").cast("long").alias("idx"), "idx_norm", "month_sin", "month_cos", "quarter_sin", "quarter_cos", "monsoon")


@query(
    "a25_monthly_resample",
    """WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM s), (SELECT max(month) FROM s), INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT month, last_value(total IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM spine LEFT JOIN s USING (month)""",
)
@tabled
def a25(t):
    df = t.orders.select("o_orderdate", F.col("o_totalprice").cast("decimal(14,2)").alias("total"))
    return w.monthly_resample(df, "total", date="o_orderdate").withColumn("total", F.col("total").cast("double"))


@query(
    "f7_seasonal_repeat",
    f"""WITH {PANEL}, x AS (SELECT ward, month, demand FROM panel QUALIFY row_number() OVER (PARTITION BY ward ORDER BY month DESC) <= 12), y AS (SELECT ward, list(demand ORDER BY month) AS v, max(month) AS m FROM x GROUP BY ward)
SELECT ward, CAST(m + to_months(CAST(h AS INTEGER)) AS DATE) AS month, v[1 + (h - 1) % len(v)] AS demand FROM y, range(1, 25) r(h)""",
)
@tabled
def f7(t):
    return w.seasonal_repeat(t.panel, "demand", 24)


def _steps(value: str, steps) -> str:
    return f"CASE WHEN {value} < 0 THEN NULL " + " ".join(f"WHEN {value} <= {hi} THEN {i} + ({value} - {lo}) * ({j} - {i}) / ({hi} - {lo})::DOUBLE" for lo, hi, i, j in steps) + f" WHEN {value} > {steps[-1][1]} THEN {steps[-1][3]} END"


@query(
    "r1_r2_aqi",
    f"""WITH {HOURLY}, x AS (SELECT station, hour, greatest({_steps('total', r.PM25_STEPS)}, {_steps('(total * 1.7)', r.PM10_STEPS)}) AS aqi FROM hourly)
SELECT station, hour, round(aqi, 4) AS aqi, CASE WHEN aqi IS NULL THEN NULL WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Satisfactory' WHEN aqi <= 200 THEN 'Moderate' WHEN aqi <= 300 THEN 'Poor' WHEN aqi <= 400 THEN 'Very Poor' ELSE 'Severe' END AS category FROM x""",
)
@tabled
def r1(t):
    df = t.hourly.withColumn("aqi", r.aqi(F.col("total"), F.col("total") * 1.7))
    return rounded(df.withColumn("category", r.aqi_category(F.col("aqi"))), "aqi", digits=4).select("station", "hour", "aqi", "category")


BASED = PANEL + ", based AS (SELECT p.ward, month, demand, n, b.baseline FROM panel p LEFT JOIN (SELECT ward, median(demand) AS baseline FROM panel WHERE month < DATE '2000-01-01' GROUP BY ward) b USING (ward))"


def _based(t):
    return t.panel.join(t.panel.where("month < DATE'2000-01-01'").groupBy("ward").agg(F.median("demand").alias("baseline")), "ward", "left")


@query(
    "r3_r4_r5_severity_rules",
    f"""WITH {BASED} SELECT ward, month, round(least(2.0, greatest(0.0, n / 6.0::DOUBLE - 1)), 6) AS sev_n,
  round(CASE WHEN baseline IS NULL OR baseline = 0 THEN 0 ELSE least(2.0, greatest(0.0, (demand - baseline) / baseline / 0.4)) END, 6) AS sev_demand, CAST(0 AS DOUBLE) AS sev_rain FROM based""",
)
@tabled
def r5(t):
    df = r.apply_rules(_based(t), {"n": {"threshold": 6}, "demand": {"baseline": "baseline", "limit": 0.4}, "rain": {"threshold": 1}})
    return rounded(df, "sev_n", "sev_demand", digits=6).select("ward", "month", "sev_n", "sev_demand", "sev_rain")


STATES = (
    PANEL
    + """, states AS (
  SELECT ward, month, (year(month) - 1990) * 12 + month(month) AS step, 'demand' AS indicator, demand > 600000 AS failed FROM panel UNION ALL
  SELECT ward, month, (year(month) - 1990) * 12 + month(month) AS step, 'orders' AS indicator, n > 4 AS failed FROM panel),
edges AS (SELECT * FROM (VALUES ('orders', 'demand', 0.6), ('demand', 'orders', 0.3), ('demand', 'demand', 0.05)) e(src, dst, weight))"""
)


def _states(t):
    step = ((F.year("month") - 1990) * 12 + F.month("month")).alias("step")
    one = t.panel.select("ward", "month", step, F.lit("demand").alias("indicator"), (F.col("demand") > 600000).alias("failed"))
    return one.unionByName(t.panel.select("ward", "month", step, F.lit("orders").alias("indicator"), (F.col("n") > 4).alias("failed")))


def _edges(t):
    return t.spark.createDataFrame([("orders", "demand", 0.6), ("demand", "orders", 0.3), ("demand", "demand", 0.05)], "src string, dst string, weight double")


@query(
    "r7_latched_accumulator",
    f"""WITH RECURSIVE {PANEL}, p AS (SELECT *, row_number() {OVER} AS i FROM panel), e AS (
  SELECT ward, month, demand, i, 0.0::DOUBLE AS stress, FALSE AS failed FROM p WHERE i = 1 UNION ALL
  SELECT p.ward, p.month, p.demand, p.i, e.stress * (1 - 1.0::DOUBLE / 7) + greatest(0.0, p.demand - e.demand), e.failed OR e.stress * (1 - 1.0::DOUBLE / 7) + greatest(0.0, p.demand - e.demand) > 2000000 FROM e JOIN p ON p.ward = e.ward AND p.i = e.i + 1)
SELECT ward, month, round(stress, 3) AS stress, failed FROM e""",
)
@tabled
def r7(t):
    return rounded(r.latched_accumulator(t.panel, "demand", keys=["ward"], date="month", decay=1 / 7, limit=2000000), "stress", digits=3).drop("demand")


@query(
    "r8_collapse_curve",
    f"""WITH {PANEL}, c AS (SELECT month AS date, avg(CAST(demand > 1400000 AS DOUBLE)) AS f, count(DISTINCT CASE WHEN demand > 1400000 THEN ward END) AS wards_failed, avg(n) AS s FROM panel GROUP BY 1)
SELECT date, round(f, 9) AS fraction_failed, wards_failed, round(s, 6) AS mean_stress, round(f - lag(f) OVER (ORDER BY date), 9) + 0.0 AS velocity FROM c""",
)
@tabled
def r8(t):
    states = t.panel.select(F.col("month").alias("date"), "ward", (F.col("demand") > 1400000).alias("failed"), F.col("n").alias("stress"))
    return rounded(rounded(r.collapse_curve(states), "fraction_failed", "velocity", digits=9), "mean_stress", digits=6)


@query("r9_failure_times", f"WITH {STATES} SELECT ward, min(CASE WHEN failed AND indicator = 'demand' THEN month END) AS demand, min(CASE WHEN failed AND indicator = 'orders' THEN month END) AS orders FROM states GROUP BY ward")
@tabled
def r9(t):
    return r.failure_times(_states(t), ["demand", "orders"], date="month")


SEQUENCES = (
    STATES
    + """, marked AS (SELECT *, coalesce(lag(failed) OVER (PARTITION BY ward, indicator ORDER BY step), FALSE) AS before FROM states),
seq AS (SELECT a.ward, a.step, b.indicator AS src, a.indicator AS dst, CAST(e.weight AS DOUBLE) AS weight FROM marked a JOIN edges e ON e.dst = a.indicator AND e.weight > 0.05
  JOIN marked b ON b.ward = a.ward AND b.step = a.step - 1 AND b.indicator = e.src AND b.failed WHERE a.failed AND NOT a.before)"""
)


@query("r10_failure_sequences", f"WITH {SEQUENCES} SELECT * FROM seq")
@tabled
def r10(t):
    return r.failure_sequences(_states(t), _edges(t)).withColumn("step", F.col("step").cast("long"))


@query("r11_frequent_chains", f"WITH {SEQUENCES} SELECT src, dst, count(*) AS frequency, count(DISTINCT ward) AS wards, any_value(weight) AS weight FROM seq GROUP BY src, dst HAVING count(*) >= 2")
@tabled
def r11(t):
    return r.frequent_chains(r.failure_sequences(_states(t), _edges(t)), 2)


@query("r12_first_failure_year", f"WITH {STATES} SELECT ward, min(CASE WHEN failed THEN year(month) END) AS first_year FROM states GROUP BY ward")
@tabled
def r12(t):
    return w.first_when(_states(t).withColumn("year", F.year("month").cast("long")), F.col("failed"), key="ward", date="year", out="first_year")


@query(
    "r13_ensemble_probability",
    "WITH e AS (SELECT o_orderkey % 20 AS run, o_custkey % 198 AS ward, max(CAST(o_totalprice > 250000 AS INTEGER)) AS failed FROM orders GROUP BY 1, 2) SELECT ward, round(avg(failed), 9) AS probability, count(*) AS runs FROM e GROUP BY ward",
)
@tabled
def r13(t):
    runs = t.orders.groupBy((F.col("o_orderkey") % 20).alias("run"), (F.col("o_custkey") % 198).alias("ward")).agg(F.max((F.col("o_totalprice") > 250000).cast("int")).alias("failed"))
    return rounded(runs.groupBy("ward").agg(F.avg("failed").alias("probability"), F.count(F.lit(1)).alias("runs")), "probability", digits=9)


_RUNS = "WITH e AS (SELECT o_orderkey % 20 AS run, o_custkey % 198 AS ward, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, max(CAST(o_totalprice > 250000 AS INTEGER)) AS failed FROM orders GROUP BY 1, 2, 3)"


def _ensemble(t):
    keys = [(F.col("o_orderkey") % 20).alias("run"), (F.col("o_custkey") % 198).alias("ward"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")]
    return t.orders.groupBy(*keys).agg((F.max("o_totalprice") > 250000).alias("failed"))


@query("r13_share_by_date", f"{_RUNS} SELECT month, round(sum(failed) / ((SELECT count(DISTINCT run) FROM e) * (SELECT count(DISTINCT ward) FROM e))::DOUBLE, 9) AS share, CAST(sum(failed) AS BIGINT) AS failures FROM e GROUP BY 1")
@tabled
def r13_dates(t):
    """Share of wards that fail at each date, over the runs of an ensemble."""
    return rounded(r.ensemble_shares(_ensemble(t), "month"), "share", digits=9)


@query("r13_top_wards", f"{_RUNS} SELECT ward, round(sum(failed) / ((SELECT count(DISTINCT run) FROM e) * (SELECT count(DISTINCT month) FROM e))::DOUBLE, 9) AS share, CAST(sum(failed) AS BIGINT) AS failures FROM e GROUP BY 1 ORDER BY failures DESC, ward LIMIT 100")
@tabled
def r13_wards(t):
    """The hundred wards with the highest mean probability over all dates."""
    shares = r.ensemble_shares(_ensemble(t), "ward", over="month")
    return rounded(shares.orderBy(F.desc("failures"), "ward").limit(100), "share", digits=9)


@query(
    "r17_failure_probability",
    f"""WITH {BASED} SELECT ward, month, round(1 - (1 - least(1.0, greatest(0.0, n / 6.0::DOUBLE - 1) / 2)) * (1 - CASE WHEN baseline IS NULL OR baseline = 0 THEN 0 ELSE least(2.0, greatest(0.0, (demand - baseline) / baseline / 0.4)) / 2 END), 6) AS probability FROM based""",
)
@tabled
def r17(t):
    df = r.apply_rules(_based(t), {"n": {"threshold": 6}, "demand": {"baseline": "baseline", "limit": 0.4}})
    return rounded(df.select("ward", "month", r.failure_probability([F.col("sev_n"), F.col("sev_demand")]).alias("probability")), "probability", digits=6)


@query("j24_lagged_edges", f"WITH {SEQUENCES} SELECT ward, step, src, dst FROM seq WHERE src <> dst")
@tabled
def j24(t):
    return r.failure_sequences(_states(t), _edges(t)).where("src <> dst").select("ward", F.col("step").cast("long").alias("step"), "src", "dst")


@query("r6_severity_label", f"WITH {BASED}, s AS (SELECT ward, month, CASE WHEN baseline IS NULL OR baseline = 0 THEN 0 ELSE least(2.0, greatest(0.0, (demand - baseline) / baseline / 0.4)) END AS sev FROM based) SELECT ward, month, CASE WHEN sev <= 0 THEN 'healthy' WHEN sev < 0.5 THEN 'warning' WHEN sev < 1 THEN 'failure' ELSE 'severe' END AS label FROM s")
@tabled
def r6(t):
    return _based(t).select("ward", "month", r.severity_label(r.severity_relative(F.col("demand"), F.col("baseline"), F.lit(0.4))).alias("label"))
