import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urban_spark.operators import cluster as c
from urban_spark.operators import forecast as f
from urban_spark.operators import stats as s
from urban_spark.operators.panel import fill_both_ways


def nearest(rows):
    controls = [(x, k) for k, t, x in rows if t == 0 and x is not None]
    best = lambda x: min(controls, key=lambda c: (abs(c[0] - x), c[0] > x, c[1] if c[0] > x else -c[1]))
    return {k: (best(x)[1], abs(best(x)[0] - x)) for k, t, x in rows if t == 1 and x is not None} if controls else {}


@pytest.mark.parametrize("crowded", [False, True])
def test_nearest_scores_as_brute_force(spark, crowded):
    deal = random.Random(5)
    score = (lambda: deal.choice([0.2, 0.2000001 + deal.random() * 1e-7, deal.random()])) if crowded else (lambda: round(deal.random(), 2))
    rows = [(i, int(deal.random() < 0.4), score()) for i in range(500)] + [(900, 1, None), (901, 0, None), (902, 1, -3.0), (903, 1, 7.0)]
    df = spark.createDataFrame(rows, "k int, treated int, score double")
    for ranges in (3, 64):
        assert {r.k: (r.match, r.gap) for r in s.nearest_scores(df, key="k", treated="treated", score="score", ranges=ranges).collect()} == nearest(rows)


def test_no_frame_is_computed_anew_for_each_row(spark):
    """A frame from a row to the end of its partition takes time that grows with the square of the partition."""
    df = spark.createDataFrame([(i, i % 2, i / 7, None if i < 3 else float(i)) for i in range(20)], "k int, treated int, score double, v double").withColumn("ward", F.lit(1))
    matched, filled = s.nearest_scores(df, key="k", treated="treated", score="score", ranges=2), fill_both_ways(df, "v", date="k")
    for out in (matched, filled):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RowFrame" in plan and "currentrow$(), unboundedfollowing$()" not in plan
    assert [r.v for r in filled.orderBy("k").collect()] == [3.0, 3.0, 3.0, *map(float, range(3, 20))]


def test_nearest_scores_without_controls(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "k int, treated int, score double")
    assert [tuple(r) for r in s.nearest_scores(df, key="k", treated="treated", score="score").collect()] in ([], [(1, None, None)])
    assert s.nearest_scores(df.limit(0), key="k", treated="treated", score="score").collect() == []


def test_local_moran_by_conditional_permutation(spark):
    rnd = np.random.default_rng(2)
    n = 60
    x = np.cumsum(rnd.normal(size=n)) + rnd.normal(size=n) * 0.2
    near = {i: [j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < n] for i in range(n - 1)}
    edges = [(i, j, 1.0 / len(js)) for i, js in near.items() for j in js]
    values = spark.createDataFrame([*((i, float(v)) for i, v in enumerate(x)), (n, None)], "k int, x double")
    got = {r.k: r for r in s.local_moran_permuted(values, spark.createDataFrame(edges, "src int, dst int, w double"), "x", key="k").collect()}
    d, var = x - x.mean(), x.var()
    for i, js in near.items():
        own = d[i] * d[js].mean() / var
        others = np.delete(d, i)
        draws = np.array([d[i] * rnd.choice(others, len(js), replace=False).mean() / var for _ in range(2000)])
        p = (min((draws >= own).sum(), (draws <= own).sum()) + 1) / 2001
        assert got[i].local_i == pytest.approx(own) and abs(got[i].p - p) < 0.06
        assert got[i].z == pytest.approx((own - draws.mean()) / draws.std(), rel=0.15, abs=0.1)
        assert got[i].label == (got[i].quadrant if got[i].p < 0.05 else "NotSig")
    assert {got[n - 1].label, got[n - 1].p} == {"NotSig", None} and sum(r.label != "NotSig" for r in got.values()) > 10


def test_imputed_refits_against_numpy(spark):
    rnd = np.random.default_rng(4)
    n, g = 400, rnd.integers(0, 3, 400)
    z, q = rnd.normal(100, 10, n), rnd.normal(size=n)
    x = 3 * g + 0.5 * z + rnd.normal(size=n)
    y = 7 + 2 * x - q + rnd.normal(size=n)
    rows = [(i, f"g{k}" if k else None, *map(float, v)) for i, (k, *v) in enumerate(zip(g, x, y, z, q, strict=True))] + [(n, "g1", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, g string, x double, y double, z double, q double")
    mask = lambda r: F.pmod(F.xxhash64("k", r), F.lit(7)) == 0
    gone = {(r.k, r.r) for r in df.select("k", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("r")).where(mask(F.col("r"))).collect()}
    got = {(r.replica, r.arm, r.term): r.coefficient for r in s.imputed_refits(df, "y", ["x", "q"], "x", mask, predictors=["z"], group="g", replicas=5).collect()}
    fit = lambda a, b: np.linalg.lstsq(np.column_stack([np.ones(len(b)), *a]), b, rcond=None)[0]
    for r in range(1, 6):
        lost = np.array([(i, r) in gone for i in range(n)])
        filled = x.copy()
        for k in range(3):
            a, b = fit([z[(g == k) & ~lost]], x[(g == k) & ~lost])
            filled[(g == k) & lost] = a + b * z[(g == k) & lost]
        for arm, want in (("complete", fit([x[~lost], q[~lost]], y[~lost])), ("imputed", fit([filled, q], y))):
            assert [got[r, arm, t] for t in ("const", "x", "q")] == pytest.approx(list(want), rel=1e-6)
    assert len(got) == 5 * 2 * 3


def test_two_totals_within_the_margin(spark):
    deal = random.Random(1)
    rows = [(i, deal.gauss(0, 1), deal.gauss(0, 2), deal.uniform(1, 10), deal.paretovariate(2) if i % 9 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, x double, y double, people double, jobs double")
    centers = spark.createDataFrame([(j, deal.gauss(0, 1), deal.gauss(0, 1)) for j in range(4)], "center int, cx double, cy double")
    for shares in (None, {0: 1, 1: 2, 2: 1, 3: 4}):
        out = c.balanced_assignment(df, centers, ("people", "jobs"), key="k", shares=shares).join(df, "k").groupBy("center").agg(F.sum("people").alias("people"), F.sum("jobs").alias("jobs"), F.count("*").alias("n")).collect()
        assert sum(r.n for r in out) == 1500
        weight = shares or dict.fromkeys(range(4), 1)
        for m, i in (("people", 3), ("jobs", 4)):
            total = sum(r[i] or 0.0 for r in rows)
            assert all(abs(r[m] / (total * weight[r.center] / sum(weight.values())) - 1) <= 0.05 + 1e-9 for r in out)


def test_near_rows_stay_and_what_cannot_be_is_said(spark):
    rows = [(i, float(i % 2) * 10, 0.0, 1.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, x double, y double, a double, b double")
    centers = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0)], "center int, cx double, cy double")
    assert all(r.center == r.k % 2 for r in c.balanced_assignment(df, centers, ("a", "b"), key="k").collect())
    one = df.withColumn("b", F.when(F.col("k") == 0, 1000.0).otherwise(1.0))
    with pytest.raises(RuntimeError):
        c.balanced_assignment(one, centers, ("a", "b"), key="k", rounds=30)
    assert c.balanced_assignment(one, centers, ("a", "b"), key="k", rounds=30, strict=False).count() == 40
    same = df.withColumn("x", F.lit(1.0))  # all rows at one place are told apart by the noise
    halves = c.balanced_assignment(same, centers, ("a", "b"), key="k").groupBy("center").count().collect()
    assert sorted(r["count"] for r in halves) in ([19, 21], [20, 20])
    assert c.balanced_assignment(df.limit(0), centers, ("a", "b"), key="k").collect() == []


@pytest.fixture(scope="module")
def panel(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for ward in range(8):
        level = rnd.uniform(50, 100)
        for t in range(60):
            level += rnd.normal()
            rows.append((ward, f"{2010 + t // 12}-{t % 12 + 1:02d}-01", float(level + 10 * np.sin(t / 2)), int(rnd.poisson(30))))
    rows.append((99, "2014-12-01", 5.0, 5))
    return spark.createDataFrame(rows, "ward int, d string, demand double, n int").withColumn("month", F.to_date("d")).drop("d")


@pytest.mark.parametrize("kind", ["forest", "boosted"])
@pytest.mark.parametrize("value", ["demand", "n"])
def test_recursive_trees_as_step_by_step(spark, panel, kind, value):
    from pyspark.ml.feature import VectorAssembler

    lags, means = [1, 2, 12], [3]
    model = f.fit_lag_trees(panel, value, lags, means, F.col("month") < F.lit("2014-06-01").cast("date"), kind=kind, trees=6, depth=4)
    trees = f.compiled(model)
    got = {(r.ward, r.h): (r.month, r.forecast) for r in f.recursive_tree_forecast(panel, value, trees, lags, means, 12).collect()}
    assert {w for w, _ in got} == set(range(8)) and len(got) == 8 * 12
    series = {w: [float(r[value]) for r in panel.where(F.col("ward") == w).orderBy("month").collect()] for w in range(8)}
    names = f._lag_names(value, lags, means)
    for h in range(1, 13):
        rows = [(w, *(v[-k] for k in lags), sum(v[-3:]) / 3, float((h - 1) % 12 + 1)) for w, v in series.items()]
        table = VectorAssembler(inputCols=names, outputCol="_x").transform(spark.createDataFrame(rows, ["ward", *names]))
        for r in model.transform(table).collect():
            series[r.ward].append(r.prediction)
            assert got[r.ward, h][1] == pytest.approx(r.prediction, rel=1e-9)
            assert str(got[r.ward, h][0]) == f"2015-{h:02d}-01"
