import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from urban_spark.operators import agg as a
from urban_spark.operators import clean as c
from urban_spark.operators import forecast as f
from urban_spark.operators import panel as w
from urban_spark.operators import risk as r


def month(k):
    return dt.date(2000 + k // 12, k % 12 + 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rows = [("a", month(k), float(10 + k + 5 * (k % 12 == 3))) for k in range(40)] + [("b", month(k), 7.0) for k in range(0, 12, 2)] + [("c", month(0), 1.0)]
    return spark.createDataFrame(rows, "ward string, month date, demand double")


def by(df, ward, value):
    return [r[value] for r in df.where(F.col("ward") == ward).orderBy("month").collect()]


def test_windows(series):
    x = np.array(by(series, "a", "demand"))
    out = w.rolling_mean(w.lags(series, "demand", [1, 12]), "demand", [3], previous_only=True, full_only=True)
    assert by(out, "a", "demand_lag_12")[12:] == x[:-12].tolist()
    assert by(out, "a", "demand_roll_mean_3")[:3] == [None] * 3 and np.allclose(by(out, "a", "demand_roll_mean_3")[3:], [x[k - 3 : k].mean() for k in range(3, 40)])
    ema = [x[0]]
    for v in x[1:]:
        ema.append(2 / 13 * v + 11 / 13 * ema[-1])
    assert np.allclose(by(w.ema(series, "demand", 12), "a", "demand_ema_12"), ema)
    assert by(w.rolling_std(series, "demand", [3]), "c", "demand_roll_std_3") == [0.0]
    assert [r.ward for r in w.long_enough(series, 6).select("ward").distinct().collect()] and w.encoder_windows(series, "demand", 4).where("ward = 'c'").collect()[0].window == [1.0] * 4
    assert {r.ward: (r.begin, r.length) for r in w.longest_runs(w.month_index(series), 1).collect()} == {"a": (0, 40), "b": (0, 1), "c": (0, 1)}


def test_fill_and_rank(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "ward string, month int, v double")
    assert sorted((r.ward, r.month, r.v) for r in w.fill_both_ways(df, "v").collect()) == [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None)]
    assert {r.v for r in w.fill_by_medians(df, "v").collect()} == {5.0}
    ranked = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0, None])], "i int, v double")
    assert {r.i: r.p for r in w.average_rank_percent(ranked, "v", 1.0, "p").collect()} == {0: 0.875, 1: 0.25, 2: 0.875, 3: 0.5, 4: None}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "ward string, month date, demand double")
    for df in (w.lags(empty, "demand", [1]), w.ema(empty, "demand", 3), w.month_spine(empty, 3), w.longest_runs(w.month_index(empty), 1), f.holt_winters(empty, "demand"), w.sliding_windows(empty, "demand", 2, 1)):
        assert df.collect() == []
    assert a.gini(empty, "demand").collect()[0].gini == 0.0


def test_gini_palma_and_counts(spark):
    v = [1.0, 2.0, 2.0, 7.0, 8.0, 10.0, 0.0, 3.0, 3.0, 4.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    x = np.sort(v)
    want = (2 * np.arange(1, 11) - 11) @ x / (10 * x.sum())
    assert np.isclose(a.gini(df, "v").collect()[0].gini, want)
    assert np.isclose(a.palma(df, "v", "v").collect()[0].palma, 10.0 / (0 + 1 + 2 + 2))
    with pytest.raises(ValueError):
        a.join_many_to_one(df, spark.createDataFrame([(1.0,), (1.0,)], "v double"), ["v"])


def test_risk_steps(spark):
    values = [None, -1.0, 0.0, 15.0, 30.0, 45.0, 250.0, 999.0]
    out = [row.i for row in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(r.sub_index(F.col("v"), r.PM25_STEPS).alias("i")).collect()]
    assert out == [None, None, 0.0, 25.0, 50.0, 75.0, 400.0, 500.0]
    row = spark.range(1).select(r.severity_relative(F.lit(15.0), F.lit(10.0), F.lit(0.5)).alias("a"), r.severity_relative(F.lit(15.0), F.lit(10.0), F.lit(0.5), rise=False).alias("b"), r.severity_absolute(F.lit(9.0), F.lit(2.0)).alias("c")).collect()[0]
    assert row[:] == (1.0, 0.0, 2.0)


def test_latch_and_chains(spark):
    rows = [("w", "a", s, v) for s, v in enumerate([1.0, 3.0, 2.0, 2.0])]
    out = r.latched_accumulator(spark.createDataFrame(rows, "ward string, ind string, step int, v double"), "v", keys=["ward", "ind"], date="step", decay=0.5, limit=1.5).orderBy("step").collect()
    assert [x.stress for x in out] == [0.0, 2.0, 1.0, 0.5] and [x.failed for x in out] == [False, True, True, True]
    states = [("w", i, s, s >= t) for i, t in (("a", 1), ("b", 2), ("c", 1), ("d", 0)) for s in range(4)]
    df = spark.createDataFrame(states, "ward string, indicator string, step int, failed boolean")
    edges = spark.createDataFrame([("a", "b", 0.5), ("c", "b", 0.05), ("a", "c", 0.9), ("d", "a", 0.2)], "src string, dst string, weight double")
    assert {(x.step, x.src, x.dst) for x in r.failure_sequences(df, edges).collect()} == {(2, "a", "b"), (1, "d", "a")}


def test_flow_keeps_its_total(spark):
    cells = spark.createDataFrame([(i, float(h)) for i, h in enumerate([5, 4, 4, 1, 3])], "cell int, elevation double")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(5) for j in range(5) if abs(i - j) == 1], "src int, dst int, km double")
    flow = {x.cell: x.flow for x in r.flow_accumulation(edges, cells).collect()}
    assert np.isclose(sum(flow.values()), 5) and max(flow, key=flow.get) == 3


def test_forecasts(spark, series):
    hw = f.holt_winters(series, "demand").collect()
    mine = sorted((x.month, x.forecast) for x in hw if x.ward == "a")
    assert mine[0][0] == month(40) and len(mine) == 12 and abs(np.mean([v for _, v in mine]) - 56) < 4 and [x.forecast for x in hw if x.ward == "c"] == [1.0] * 12
    parts = f.decompose(series, "demand").where("ward = 'a' AND trend IS NOT NULL").collect()
    assert all(np.isclose(x.trend + x.seasonal + x.residual, x.demand) for x in parts) and len(parts) == 28
    folds = f.rolling_origin(series, "demand", horizon=2, step=5, least=30).collect()
    assert {x.origin for x in folds} == {month(29), month(34), month(39)} - {month(39)} and all(x.month > x.origin for x in folds)
    split = f.time_split(series, "2001-06-01", 6)
    assert split.where("part = 'train'").agg(F.max("month")).collect()[0][0] == dt.date(2001, 6, 1) and split.where("part = 'test' AND ward = 'a'").count() == 6
    row = spark.range(1).select(f.ensemble([(F.lit(None).cast("double"), 0.6), (F.lit(4.0), 0.4)]), f.clamped(F.lit(9.0), F.lit(4.0), 25), f.adjusted(F.lit(2.0), [(F.lit(True), 3.0), (F.lit(True), 5.0)])).collect()[0]
    assert row[:] == (4.0, 5.0, 6.0)


def test_cleaning(spark):
    raw = spark.createDataFrame([("7", "12,345 ", None), ("8", "n/a", " "), ("9", None, "x9")], "`Ward No` string, `Total Population` string, id string")
    df = c.resolve_columns(raw, {"ward": ["ward"], "population": ["pop"], "id": ["id"], "rain": ["rain"]})
    from urban_spark.functions.text import measurement, number_between, to_number, token_set_ratio

    assert df.columns == ["ward", "population", "id", "rain"] and [x[0] for x in df.select(to_number(F.col("population"))).collect()] == [12345.0, None, None]
    assert [x.id for x in c.fill_ids(df, "id", "t", order="ward", group="ward").orderBy("ward").collect()] == ["t_7_1", "t_8_1", "x9"]
    assert c.ward_key(["x", "Ward No"]) == "Ward No" and c.ward_key(["x", "y"]) == "x"
    row = spark.range(1).select(measurement(F.lit("h=12.5 m")), number_between(F.lit("no 5000 ward 12 of 3"), 1, 1000), token_set_ratio(F.lit("New Ward (East)"), F.lit("east ward new")), c.parse_date(F.lit("946684800000")), c.parse_date(F.lit("2000-03-17"))).collect()[0]
    assert row[:] == (12.5, 12, 100.0, dt.date(2000, 1, 1), dt.date(2000, 3, 1))
