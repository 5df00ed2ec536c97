import numpy as np
import pytest
from pyspark.sql import functions as F

from urban_spark.operators import stats as s


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(300, 2))
    g = rnd.integers(0, 12, 300)
    y = 2 + x @ [1.5, -0.7] + rnd.normal(size=300) * (1 + abs(x[:, 0])) + 0.3 * g
    c = rnd.poisson(np.exp(0.4 + 0.3 * x[:, 0]))
    rows = [(i, float(a), float(b), float(v), int(k), int(n)) for i, ((a, b), v, k, n) in enumerate(zip(x, y, g, c, strict=True))]
    return spark.createDataFrame(rows, "t int, a double, b double, y double, g int, c int"), np.column_stack([np.ones(300), x]), y, g, c


def test_least_squares_and_covariances(data):
    df, x, y, g, _ = data
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    plain = inverse * (e @ e) / (300 - 3)
    hc3 = inverse @ (x.T * (e / (1 - h)) ** 2) @ x @ inverse
    sums = np.array([(x[g == k] * e[g == k, None]).sum(0) for k in range(12)])
    clustered = inverse @ (sums.T @ sums * 12 / 11 * 299 / 297) @ inverse
    u = x * e[:, None]
    meat = u.T @ u
    for lag in range(1, 5):
        cross = u[lag:].T @ u[:-lag]
        meat += (1 - lag / 5) * (cross + cross.T)
    for robust, want, more in ((None, plain, {}), ("HC3", hc3, {}), ("cluster", clustered, {"cluster": "g"}), ("HAC", inverse @ meat @ inverse, {"order": "t"})):
        fit = s.ols(df, "y", ["a", "b"], robust, **more)
        assert np.allclose(fit.beta, beta) and np.allclose(fit.covariance, want, rtol=1e-6), robust
    assert np.isclose(fit.r2, 1 - e @ e / ((y - y.mean()) ** 2).sum()) and np.isclose(fit.aic, 2 * 3 + 300 * (np.log(2 * np.pi) + np.log(e @ e / 300) + 1))
    out = s.influence(df, s.ols(df, "y", ["a", "b"]), "y").orderBy("t").collect()
    assert np.allclose([r.leverage for r in out], h) and np.allclose([r.cooks_d for r in out], e**2 * h / (3 * (e @ e) / 297 * (1 - h) ** 2))


def test_poisson(data):
    df, x, _, _, c = data
    fit = s.glm(df, "c", ["a", "b"])
    mu = np.exp(x @ fit.beta)
    assert np.allclose(x.T @ (c - mu), 0, atol=1e-6)
    nb = s.glm(df, "c", ["a", "b"], "negative_binomial")
    mu = np.exp(x @ nb.beta)
    assert np.allclose(x.T @ ((c - mu) / (1 + mu)), 0, atol=1e-6)


def test_vif_and_condition(data):
    df, x, *_ = data
    r = np.corrcoef(x[:, 1:].T)
    assert np.allclose([v.vif for v in s.vif(df, ["a", "b"]).collect()], np.diag(np.linalg.inv(r)))
    assert np.isclose(s.condition_number(df, ["a", "b"]), np.sqrt(np.linalg.cond(r)))


def test_moran_against_numpy(spark):
    rnd = np.random.default_rng(1)
    v = np.arange(30) / 5 + rnd.normal(size=30)
    w = np.zeros((30, 30))
    for i in range(30):
        for j in (i - 1, i + 1, i + 2):
            if 0 <= j < 30:
                w[i, j] = 1
    w /= w.sum(1, keepdims=True)
    values = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "k int, v double")
    weights = s.row_standardized(spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(w), strict=True)], "src int, dst int"))
    z = v - v.mean()
    n, s0 = 30, w.sum()
    i = n / s0 * (z @ w @ z) / (z @ z)
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    variance = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / (n - 1) ** 2
    out = s.moran(values, weights, "v", key="k", permutations=9).collect()[0]
    assert np.isclose(out.i, i) and np.isclose(out.z, (i + 1 / 29) / np.sqrt(variance)) and out.p == 0.1
    local = {r.k: r.local_i for r in s.local_moran(values, weights, "v", key="k").collect()}
    assert np.allclose([local[k] for k in range(30)], z * (w @ z) / z.var())


def test_matching_instruments_and_differences(spark):
    rnd = np.random.default_rng(5)
    rows = [(int(k), int(rnd.random() < 0.3), float(p)) for k, p in enumerate(np.round(rnd.random(400), 3))]
    df = spark.createDataFrame(rows, "k int, t int, p double")
    out = {r.k: r for r in s.nearest_scores(df, key="k", treated="t", score="p").collect()}
    for k, t, p in rows:
        if t:
            assert np.isclose(out[k].gap, min(abs(p - q) for _, u, q in rows if not u))
    z = rnd.normal(size=2000)
    u = rnd.normal(size=2000)
    x = z + u
    y = 3 * x - 4 * u + rnd.normal(size=2000) * 0.1
    iv = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, x, z, strict=True)], "y double, x double, z double")
    fit, first = s.two_stage(iv, "y", "x", [], ["z"])
    assert abs(fit.beta[1] - 3) < 0.3 and first > 500
    did = spark.createDataFrame([(1.0 + a + 2 * b + 5 * a * b, a, b) for a in (0, 1) for b in (0, 1) for _ in range(5)], "y double, a int, b int")
    assert np.isclose(s.difference_in_differences(did, "y", "a", "b").beta[3], 5)


def test_scaling_fits_on_the_cutoff_only(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "t int, v double")
    out = [r.v for r in s.scaled(df, ["v"], F.col("t") < 4).orderBy("t").collect()]
    assert np.allclose(out, (np.arange(10) - 1.5) / np.std([0, 1, 2, 3]))


def test_p_of_t_and_of_z(spark):
    # Fixed values from a table of Student's distribution.
    for t, freedom, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.086, 20, 0.05), (1.984, 100, 0.05), (0.0, 5, 1.0)):
        assert abs(s.t_p(t, freedom) - p) < 2e-4 and s.t_p(-t, freedom) == s.t_p(t, freedom)
    import math

    zs = [-6.0, -1.96, -0.1, 0.0, 0.5, 1.0, 2.5758, 8.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").selectExpr("z", f"{s.NORMAL_P} AS p").collect():
        assert abs(r.p / math.erfc(abs(r.z) / math.sqrt(2)) - 1) < 2e-7


def test_local_moran_against_permutations(spark):
    rng = np.random.default_rng(4)
    n, x = 40, rng.normal(size=40)
    x[:6] += 3
    edges = [(i, (i + d) % n) for i in range(n) for d in (-2, -1, 1, 2)]
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, x double")
    out = {r.k: r for r in s.local_moran(values, s.row_standardized(spark.createDataFrame(edges, "src int, dst int")), "x", key="k").collect()}
    z = x - x.mean()
    for i in range(n):
        others = np.delete(z, i)
        draws = np.array([rng.choice(others, 4, replace=False).mean() for _ in range(4000)])
        seen = z[[(i + d) % n for d in (-2, -1, 1, 2)]].mean()
        assert abs(out[i].z - (seen - draws.mean()) / draws.std()) < 0.12
        assert (out[i].label == "NotSig") == (out[i].p >= 0.05)


def test_shuffled_deals_each_value_once(spark):
    values = spark.createDataFrame([(i, float(i)) for i in range(300)], "k int, x double")
    out = s.shuffled(values, "x", key="k", permutations=5).toPandas()
    assert all(sorted(g["x"]) == sorted(map(float, range(300))) and sorted(g["k"]) == list(range(300)) for _, g in out.groupby("run")) and out["run"].nunique() == 5
    first = out[out["run"] == 1].sort_values("k")["x"].tolist()
    assert first != out[out["run"] == 2].sort_values("k")["x"].tolist() and first != sorted(first)


def test_hac_by_hand(spark):
    rng = np.random.default_rng(6)
    n, lags = 50, 4
    x = rng.normal(size=n)
    y = 1 + 2 * x + np.convolve(rng.normal(size=n + 3), np.ones(4), "valid")
    frame = spark.createDataFrame([(i * 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "step int, x double, y double")
    fit = s.ols(frame, "y", ["x"], "HAC", order="step", lags=lags)
    design = np.column_stack([np.ones(n), x])
    u = (y - design @ np.linalg.lstsq(design, y, rcond=None)[0])[:, None] * design
    meat = u.T @ u
    for lag in range(1, lags + 1):
        cross = u[lag:].T @ u[:-lag]
        meat += (1 - lag / (lags + 1)) * (cross + cross.T)
    inverse = np.linalg.inv(design.T @ design)
    assert np.allclose(fit.covariance, inverse @ meat @ inverse)
