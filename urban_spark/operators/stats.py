"""Regressions from one pass of cross products, spatial statistics over weight edges, causal estimates.

What reaches the driver is a matrix over the columns of a model, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.operators.graph import _cut
from urban_spark.operators.panel import cumulative
from urban_spark.operators.sizes import small


def gram(df: DataFrame, columns: list[str], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """Sums of products of all pairs of columns (the first is meant to be 1), by rows without a null; and their number."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    rows = df.dropna(subset=columns)
    found = rows.agg(*(F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double") * w).alias(f"s{i}_{j}") for i, j in pairs), F.count(F.lit(1)).alias("n")).collect()[0]
    out = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        out[i, j] = out[j, i] = found[f"s{i}_{j}"] or 0.0
    return out, found["n"]


#: Two-sided p of a normal z: a rational approximation of the complementary error function, whose relative error is below
#: 1.2e-7; fixed values. As SQL over a column z.
NORMAL_P = (
    "({t} * exp(-{x} * {x} - 1.26551223 + {t} * (1.00002368 + {t} * (0.37409196 + {t} * (0.09678418 + {t} * (-0.18628806 + {t} * (0.27886807 + "
    "{t} * (-1.13520398 + {t} * (1.48851587 + {t} * (-0.82215223 + {t} * 0.17087277))))))))))"
).format(x="(abs(z) / sqrt(2.0))", t="(1 / (1 + 0.5 * abs(z) / sqrt(2.0)))")


def t_p(t: float, freedom: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta function, by its continued fraction."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1 or x <= 0:
        return 1.0 if x >= 1 else 0.0
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        x, a, b = 1 - x, b, a
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    low, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d or low), 1 + term / c or low
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * out if turned else front * out


@dataclass(frozen=True)
class Fit:
    names: list[str]
    beta: np.ndarray
    inverse: np.ndarray
    covariance: np.ndarray
    n: int
    rss: float
    tss: float
    robust: bool = False

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss else 0.0

    @property
    def log_likelihood(self) -> float:
        return -self.n / 2 * (np.log(2 * np.pi) + np.log(self.rss / self.n) + 1)

    @property
    def aic(self) -> float:
        return 2 * len(self.beta) - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return np.log(self.n) * len(self.beta) - 2 * self.log_likelihood

    def table(self, df: DataFrame) -> DataFrame:
        """A row for each term: coefficient, standard error, t, and its two-sided p, by Student's distribution or, with a robust
        covariance or without a residual, the normal one."""
        se = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        freedom = self.n - len(self.beta)
        p = lambda t: math.erfc(abs(t) / math.sqrt(2)) if self.robust or not self.rss or freedom < 1 else t_p(t, freedom)
        rows = [(name, float(b), float(s), *((float(b / s), p(float(b / s))) if s else (None, None))) for name, b, s in zip(self.names, self.beta, se, strict=True)]
        return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, t double, p double")


def _ones(df: DataFrame) -> DataFrame:
    return df.withColumn("const", F.lit(1.0))


def predicted(fit: Fit) -> Column:
    out = F.lit(0.0)
    for name, b in zip(fit.names, fit.beta, strict=True):
        out = out + F.lit(float(b)) * (F.lit(1.0) if name == "const" else F.col(name))
    return out


def leverage(fit: Fit) -> Column:
    cols = [F.lit(1.0) if n == "const" else F.col(n) for n in fit.names]
    out = F.lit(0.0)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            out = out + a * b * float(fit.inverse[i, j])
    return out


def ols(df: DataFrame, y: str, xs: list[str], robust: str | None = None, *, cluster: str | None = None, order: str | None = None, lags: int = 4) -> Fit:
    """Least squares of y on a constant and xs. `robust`: None, "HC3", "cluster" (by `cluster`) or "HAC" (Bartlett weights over
    `lags` rows in the order of `order`, which has one row a step)."""
    data, names = _ones(df.dropna(subset=[y, *xs])), ["const", *xs]
    products, n = gram(data, [*names, y])
    k = len(names)
    inverse = np.linalg.pinv(products[:k, :k])
    beta = inverse @ products[:k, k]
    rss = float(products[k, k] - beta @ products[:k, k])
    tss = float(products[k, k] - products[0, k] ** 2 / n)
    fit = Fit(names, beta, inverse, inverse * rss / max(n - k, 1), n, rss, tss)
    if robust is None:
        return fit
    residual = F.col(y) - predicted(fit)
    scores = [residual * (F.lit(1.0) if c == "const" else F.col(c)) for c in names]
    if robust == "HC3":
        meat, _ = gram(data.withColumn("_w", F.pow(residual / (1 - leverage(fit)), 2)), names, F.col("_w"))
    elif robust == "cluster":
        groups = data.groupBy(cluster).agg(*(F.sum(s).alias(f"g{i}") for i, s in enumerate(scores)))
        meat, count = gram(groups, [f"g{i}" for i in range(k)])
        meat *= count / (count - 1) * (n - 1) / (n - k)
    else:
        columns, late = [f"g{i}" for i in range(k)], [f"l{i}" for i in range(k)]
        rows = data.select(order, *(s.alias(c) for s, c in zip(scores, columns, strict=True)))
        meat, _ = gram(rows, columns)
        # Each row meets those up to `lags` places before it by its place, which is a sum in two levels.
        at = rows.withColumn("_v", F.col(order).cast("timestamp").cast("double") if dict(rows.dtypes)[order] in ("date", "timestamp") else F.col(order).cast("double"))
        placed = cumulative(at.withColumn("_k", F.lit(1)), "_v", "_k", "_at").select("_at", *columns)
        before = placed.select("_at", *(F.col(c).alias(d) for c, d in zip(columns, late, strict=True)), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("_lag")).withColumn("_at", F.col("_at") + F.col("_lag"))
        weighted = placed.join(before, "_at").withColumn("_w", 1 - F.col("_lag") / (lags + 1.0))
        cross, _ = gram(weighted, [*columns, *late], F.col("_w"))
        meat += cross[:k, k:] + cross[:k, k:].T
    return Fit(names, beta, inverse, inverse @ meat @ inverse, n, rss, tss, True)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, over rows without a null in them."""
    g, n = gram(_ones(df), ["const", *columns])
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    rows = [(a, b, float(cov[i, j] / (sd[i] * sd[j]))) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def _correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    g, n = gram(_ones(df), ["const", *columns])
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix."""
    inverse = np.linalg.pinv(_correlation(df, columns))
    return df.sparkSession.createDataFrame([(c, float(inverse[i, i])) for i, c in enumerate(columns)], "term string, vif double")


def condition_number(df: DataFrame, columns: list[str]) -> float:
    return float(np.sqrt(np.linalg.cond(_correlation(df, columns))))


def glm(df: DataFrame, y: str, xs: list[str], family: str = "poisson", *, alpha: float = 1.0, rounds: int = 50, tolerance: float = 1e-10) -> Fit:
    """Log-linear Poisson or negative binomial (dispersion `alpha`) by reweighted least squares, one pass a round."""
    data, names = _ones(df.dropna(subset=[y, *xs])), ["const", *xs]
    mean = data.agg(F.avg(y)).collect()[0][0]
    beta = np.zeros(len(names))
    beta[0] = np.log(max(mean, 1e-9))
    for _ in range(rounds):
        fit = Fit(names, beta, np.eye(len(names)), np.eye(len(names)), 0, 0.0, 0.0)
        mu = F.exp(predicted(fit))
        weight = mu if family == "poisson" else mu / (1 + alpha * mu)
        rows = data.withColumn("_z", predicted(fit) + (F.col(y) - mu) / mu).withColumn("_w", weight)
        g, n = gram(rows, [*names, "_z"], F.col("_w"))
        k = len(names)
        new = np.linalg.solve(g[:k, :k], g[:k, k])
        done, beta = np.abs(new - beta).max() < tolerance, new
        if done:
            break
    inverse = np.linalg.inv(g[:k, :k])
    return Fit(names, beta, inverse, inverse, n, 0.0, 0.0)


def slopes(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def row_standardized(edges: DataFrame) -> DataFrame:
    """(src, dst, w) with weights that add up to 1 for each src."""
    return edges.select("src", "dst").distinct().withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("src")))


def spatial_lag(values: DataFrame, weights: DataFrame, columns: list[str], *, key: str) -> DataFrame:
    """`values` with W_ columns: weighted means over neighbours, 0 without any."""
    at = values.select(F.col(key).alias("dst"), *columns)
    lagged = weights.join(at, "dst").groupBy(F.col("src").alias(key)).agg(*(F.sum(F.col("w") * F.col(c)).alias(f"W_{c}") for c in columns))
    return values.join(lagged, key, "left").fillna(0.0, [f"W_{c}" for c in columns])


def shuffled(values: DataFrame, value: str, *, key: str, permutations: int, seed: int = 1) -> DataFrame:
    """(run, key, value) for the runs 1 to `permutations`: in each the values are dealt anew to the keys, by the order of the keys'
    hashes. Places in that order are row numbers within ranges of the hash and the sizes of the ranges below."""
    hashed = lambda run: F.xxhash64(F.col(key), F.lit(seed), run)

    def placed(df: DataFrame, run: Column) -> DataFrame:
        at = df.withColumn("_h", hashed(run)).withColumn("_b", F.shiftrightunsigned("_h", 58))  # 64 ranges
        counts = at.groupBy("run", "_b").agg(F.count(F.lit(1)).alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy("run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = F.row_number().over(Window.partitionBy("run", "_b").orderBy("_h", key))
        return at.withColumn("_own", own).join(F.broadcast(counts.select("run", "_b", before.alias("_before"))), ["run", "_b"]).withColumn("_at", F.col("_own") + F.col("_before"))

    runs = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("run")
    new = placed(values.select(runs, key, value), F.col("run")).select("run", "_at", value)
    places = placed(values.select(F.lit(0).alias("run"), key), F.lit(0)).select("_at", key).select(runs, "_at", key)
    return places.join(new, ["run", "_at"]).select("run", key, value)


def moran(values: DataFrame, weights: DataFrame, value: str, *, key: str, permutations: int = 0, seed: int = 1) -> DataFrame:
    """(n, i, expected, z, p): global Moran's I; z under randomisation of normal values; p from permutations by hashed order, if any."""
    lagged = spatial_lag(values.select(key, value), weights, [value], key=key)
    w = weights.agg(F.sum("w").alias("s0"))
    sums = weights.alias("a").join(weights.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v")), ["src", "dst"], "left")
    s1 = sums.agg(F.sum(F.pow(F.col("w") + F.coalesce("v", F.lit(0.0)), 2)).alias("both"), F.sum(F.when(F.col("v").isNull(), F.col("w") * F.col("w")).otherwise(0.0)).alias("single")).collect()[0]
    out, into = weights.groupBy(F.col("src").alias("k")).agg(F.sum("w").alias("a")), weights.groupBy(F.col("dst").alias("k")).agg(F.sum("w").alias("b"))
    s2 = out.join(into, "k", "full").agg(F.sum(F.pow(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 2))).collect()[0][0]
    m = lagged.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var")).collect()[0]
    s0 = w.collect()[0][0]
    rows = weights.agg(F.sum("w")).collect()[0][0]

    def index(table: DataFrame) -> float:
        at = table.select(F.col(key).alias("src"), (F.col(value) - m["mean"]).alias("x"))
        pair = weights.join(at, "src").join(at.select(F.col("src").alias("dst"), F.col("x").alias("y")), "dst")
        return pair.agg(F.sum(F.col("w") * F.col("x") * F.col("y"))).collect()[0][0] / (m["var"] * rows)

    i = index(values)
    n, expected = m["n"], -1 / (m["n"] - 1)
    # sum over ordered pairs of (w_ij + w_ji)^2 / 2: pairs present both ways are met twice, single ones once for two.
    total = (s1["both"] + s1["single"]) / 2
    variance = (n * n * total - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - expected**2
    p = None
    if permutations:
        dealt = shuffled(values.select(key, value), value, key=key, permutations=permutations, seed=seed)
        at = dealt.select("run", F.col(key).alias("src"), (F.col(value) - m["mean"]).alias("x"))
        pair = weights.join(at, "src").join(at.select("run", F.col("src").alias("dst"), F.col("x").alias("y")), ["run", "dst"])
        runs = pair.groupBy("run").agg((F.sum(F.col("w") * F.col("x") * F.col("y")) / (m["var"] * rows)).alias("i"))
        above = runs.agg(F.coalesce(F.sum((F.abs(F.col("i") - expected) >= abs(i - expected)).cast("long")), F.lit(0))).collect()[0][0]
        p = (above + 1) / (permutations + 1)
    return values.sparkSession.createDataFrame([(n, float(i), expected, float((i - expected) / np.sqrt(variance)), p)], "n long, i double, expected double, z double, p double")


def local_moran(values: DataFrame, weights: DataFrame, value: str, *, key: str, significant: float = 0.05) -> DataFrame:
    """(key, local_i, quadrant, z, p, label): a value's deviation times that of its neighbours' weighted mean, over the variance; z
    of that mean if the neighbours were drawn from all others, its two-sided p, and the quadrant where p is below
    `significant`, else NotSig. Keys without neighbours have no z and are NotSig."""
    m = values.agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(value).cast("double").alias("_n")).withColumn("_one", F.lit(1))
    dev = values.withColumn("_one", F.lit(1)).join(F.broadcast(m), "_one").select(key, (F.col(value) - F.col("_m")).alias("z"), "_v", "_n")
    squares = weights.groupBy(F.col("src").alias(key)).agg(F.sum("w").alias("_w1"), F.sum(F.col("w") * F.col("w")).alias("_w2"))
    lagged = spatial_lag(dev, weights, ["z"], key=key).join(squares, key, "left")
    high, around = F.col("z") > 0, F.col("W_z") > 0
    n, z = F.col("_n"), F.col("z")
    mean = -z / (n - 1)
    spread = (n * F.col("_v") - z * z) / (n - 1) - mean * mean
    score = (F.col("W_z") - F.col("_w1") * mean) / F.sqrt(spread * (F.col("_w2") - F.col("_w1") * F.col("_w1") / (n - 1)) * (n - 1) / (n - 2))
    quadrant = F.when(high & around, "HH").when(~high & ~around, "LL").when(high, "HL").otherwise("LH")
    found = lagged.select(key, (F.col("z") * F.col("W_z") / F.col("_v")).alias("local_i"), quadrant.alias("quadrant"), score.alias("z")).withColumn("p", F.expr(NORMAL_P))
    return found.withColumn("label", F.when(F.col("p") < significant, F.col("quadrant")).otherwise("NotSig"))


def local_moran_permuted(values: DataFrame, weights: DataFrame, value: str, *, key: str, permutations: int = 999, seed: int = 1, significant: float = 0.05) -> DataFrame:
    """(key, local_i, quadrant, p, z, label): local_moran() with p by conditional permutation: the neighbours of a row are drawn `permutations` times from
    all others, without replacement. p is the share of draws whose index lies at least as far out as the row's own on its side, the row's own counted
    in; z is its distance from the draws' mean in their standard deviations.

    Draws are numbers from a hash of seed, row, draw and neighbour, turned into distinct places among the others: nothing is shuffled for
    a row. Rows without neighbours or value have no p and are NotSig. Keys are distinct.
    """
    known = values.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).cast("double").alias("_v"))
    m = known.agg(F.avg("_v").alias("m"), F.var_pop("_v").alias("v"), F.count(F.lit(1)).alias("n")).first()
    found = local_moran(values, weights, value, key=key).select(key, "local_i", "quadrant")
    if m["n"] < 3:
        return found.select("*", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("z"), F.lit("NotSig").alias("label"))
    others = m["n"] - 1
    # Places of the rows by the order of a hash, in two levels.
    hashed = known.select(key, (F.col("_v") - m["m"]).alias("_z"), F.xxhash64(key, F.lit(seed)).alias("_h")).withColumn("_b", F.shiftright("_h", 56))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 256 rows
    starts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1 + F.col("_before")
    placed = _cut(hashed.join(F.broadcast(starts), "_b").select(key, "_z", at.cast("long").alias("_at")))
    near = weights.where("src <> dst").join(known.select(F.col(key).alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias(key)).agg(F.array_sort(F.collect_list("w")).alias("_w"))
    asking = placed.join(near, key).where(F.size("_w") < others).withColumn("_run", F.explode(F.sequence(F.lit(1), F.lit(permutations))))

    def draw(taken: Column, j: Column) -> Column:
        number = F.pmod(F.xxhash64(F.col(key), F.col("_run"), j, F.lit(seed)), F.lit(others) - j)
        return F.array_sort(F.concat(taken, F.array(F.aggregate(taken, number, lambda v, t: F.when(v >= t, v + 1).otherwise(v)))))

    drawn = F.aggregate(F.sequence(F.lit(0).cast("long"), (F.size("_w") - 1).cast("long")), F.array().cast("array<long>"), draw)
    # A set of places is dealt to the weights in an order of its own.
    mixed = F.transform(F.array_sort(F.transform(drawn, lambda v: F.struct(F.xxhash64(F.col(key), F.col("_run"), v).alias("h"), v.alias("v")))), lambda x: x["v"])
    pairs = asking.select(key, "_run", F.col("_at").alias("_own"), F.explode(F.arrays_zip(mixed.alias("v"), F.col("_w").alias("w"))).alias("_p"))
    pairs = pairs.select(key, "_run", (F.col("_p.v") + (F.col("_p.v") >= F.col("_own")).cast("long")).alias("_at"), F.col("_p.w").alias("_w"))
    draws = pairs.join(small(placed.select("_at", F.col("_z").alias("_other"))), "_at").groupBy(key, "_run").agg(F.sum(F.col("_w") * F.col("_other")).alias("_lag"))
    own = found.join(placed.select(key, "_z"), key)
    index = F.col("_z") * F.col("_lag") / m["v"]
    counts = draws.join(own.select(key, "_z", "local_i"), key).groupBy(key).agg(
        F.sum((index >= F.col("local_i") - 1e-12).cast("long")).alias("_above"), F.sum((index <= F.col("local_i") + 1e-12).cast("long")).alias("_below"), F.avg(index).alias("_mean"), F.stddev_pop(index).alias("_sd")
    )
    joined = found.join(counts, key, "left")
    p = (F.least("_above", "_below") + 1) / (permutations + 1)
    z = (F.col("local_i") - F.col("_mean")) / F.nullif("_sd", F.lit(0.0))
    return joined.select(*found.columns, p.alias("p"), z.alias("z"), F.when(p < significant, F.col("quadrant")).otherwise("NotSig").alias("label"))


def getis_ord(values: DataFrame, weights: DataFrame, value: str, *, key: str) -> DataFrame:
    """(key, g, z, p): share of the others' total that lies with the neighbours (binary weights), its z score and two-sided p."""
    n, s1, s2 = values.agg(F.count(value), F.sum(value), F.sum(F.col(value) * F.col(value))).collect()[0]
    at = values.select(F.col(key).alias("dst"), F.col(value).alias("_x"))
    near = weights.select("src", "dst").distinct().where("src <> dst").join(at, "dst").groupBy(F.col("src").alias(key)).agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).cast("double").alias("_k"))
    rows = values.select(key, F.col(value).alias("_v")).join(near, key)
    others, mean = s1 - F.col("_v"), (s1 - F.col("_v")) / (n - 1)
    var = (s2 - F.col("_v") * F.col("_v")) / (n - 1) - mean * mean
    g, expected = F.col("_s") / others, F.col("_k") / (n - 1)
    spread = F.sqrt(F.col("_k") * (n - 1 - F.col("_k")) * var / ((n - 1) * (n - 1) * (n - 2) * mean * mean))
    return rows.select(key, g.alias("g"), ((g - expected) / spread).alias("z")).withColumn("p", F.expr(NORMAL_P))


def influence(df: DataFrame, fit: Fit, y: str) -> DataFrame:
    """`df` with leverage, Cook's distance and a flag above 4 / n."""
    k, s2 = len(fit.names), fit.rss / (fit.n - len(fit.names))
    h, e = leverage(fit), F.col(y) - predicted(fit)
    return df.withColumn("leverage", h).withColumn("cooks_d", e * e * F.col("leverage") / (k * s2 * F.pow(1 - F.col("leverage"), 2))).withColumn("influential", F.col("cooks_d") > 4 / fit.n)


def two_stage(df: DataFrame, y: str, endogenous: str, exogenous: list[str], instruments: list[str]) -> tuple[Fit, float]:
    """Second-stage fit of y on the fitted endogenous column, and the first stage's F of the instruments."""
    data = df.dropna(subset=[y, endogenous, *exogenous, *instruments])
    full, short = ols(data, endogenous, [*instruments, *exogenous]), ols(data, endogenous, exogenous)
    f = (short.rss - full.rss) / len(instruments) / (full.rss / (full.n - len(full.names)))
    second = ols(data.withColumn("fitted", predicted(full)), y, ["fitted", *exogenous])
    return second, float(f)


def difference_in_differences(df: DataFrame, y: str, treated: str, after: str) -> Fit:
    """Coefficient of treated x after."""
    return ols(df.withColumn("did", F.col(treated) * F.col(after)), y, [treated, after, "did"], "HC3")


def nearest_scores(df: DataFrame, *, key: str, treated: str, score: str, ranges: int = 64) -> DataFrame:
    """(key, match, gap): for each treated row the untreated row with the nearest score (with replacement; of equally near ones that with the
    lower score, of one score below or at the row's own the greatest key, above it the least). Rows without a score match nothing.

    Matches are looked for among distinct scores, each with its least and greatest untreated key, in score order within `ranges` of about as many
    distinct scores, by a sketch of their quantiles; the nearest scores beyond a range are carried over from the ranges beside it. So neither
    a crowded stretch of scores nor a score that many rows have is a hot task.
    """
    rows = df.select(key, treated, F.col(score).cast("double").alias("_score")).where("_score IS NOT NULL AND NOT isnan(_score)")
    control = F.when(F.col(treated) == 0, F.col(key))
    scores = _cut(rows.groupBy("_score").agg(F.min(control).alias("_lo"), F.max(control).alias("_hi")))
    cuts = sorted(set(scores.stat.approxQuantile("_score", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) or []))
    at = F.lit(0)
    for cut in cuts:
        at = at + (F.col("_score") >= F.lit(cut)).cast("int")
    below, above = (F.when(F.col("_lo").isNotNull(), F.struct(F.col("_score").alias("s"), F.col(c).alias("k"))) for c in ("_hi", "_lo"))
    placed = scores.select("_score", at.alias("_b"), below.alias("_below"), above.alias("_above"))
    ends = placed.groupBy("_b").agg(F.max("_below").alias("_hi"), F.min("_above").alias("_lo"))
    w = Window.orderBy("_b")  # a row a range
    beside = ends.select("_b", F.last("_hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    # Both run from the start of their order: a frame that ends at the end of the range is computed anew for each row.
    so_far = lambda c, order: F.last(c, True).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    left, right = so_far("_below", F.asc("_score")), so_far("_above", F.desc("_score"))
    near = placed.select("_score", "_b", left.alias("_l"), right.alias("_r")).join(F.broadcast(beside), "_b")
    near = near.select("_score", F.coalesce("_l", "_before").alias("_l"), F.coalesce("_r", "_after").alias("_r"))
    gap = lambda p: F.abs(F.col("_score") - p.getField("s"))
    best = F.when(F.col("_r").isNull() | (gap(F.col("_l")) <= gap(F.col("_r"))), F.col("_l")).otherwise(F.col("_r"))
    found = near.select("_score", best.getField("k").alias("match"), gap(best).alias("gap"))
    return rows.where(F.col(treated) == 1).join(found, "_score").select(key, "match", "gap")


def att(df: DataFrame, matches: DataFrame, y: str, *, key: str) -> DataFrame:
    mine, theirs = df.select(key, F.col(y).alias("_a")), df.select(F.col(key).alias("match"), F.col(y).alias("_b"))
    return matches.join(mine, key).join(theirs, "match").agg(F.avg(F.col("_a") - F.col("_b")).alias("att"), F.count(F.lit(1)).alias("n"))


def permuted_att(df: DataFrame, y: str, *, treated: str, stratum: str, key: str, order, runs: int = 99) -> DataFrame:
    """(att, runs, p): mean difference of treated and other rows of a stratum, over strata by their treated rows; and p from
    reassignments in each of which as many rows of a stratum are treated, the first by order(run), a column of evenly spread strings such as digests. Strata
    without either kind don't count."""
    # As many tasks as shuffles have: a small file is one task, and each of its rows is met once a run.
    rows = df.select(key, treated, stratum, F.col(y).cast("double").alias("_y")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    again = rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("_o", order(F.col("run"))).withColumn("_b", F.substring("_o", 1, 2))
    # Rows whose order begins alike are treated together, or not; only at the beginning within which the treated ones end are places counted.
    w = Window.partitionBy("run", stratum)
    sums = again.groupBy("run", stratum, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum(treated).alias("_t"), F.count("_y").alias("_k"), F.sum("_y").alias("_s"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = _cut(sums.withColumn("_before", before).withColumn("_many", F.coalesce(F.sum("_t").over(w), F.lit(0))))
    split = (F.col("_before") < F.col("_many")) & (F.col("_before") + F.col("_n") > F.col("_many"))
    ends = sums.where(split).select(F.col("run").alias("_run"), F.col(stratum).alias("_stratum"), F.col("_b").alias("_begin"), (F.col("_many") - F.col("_before")).alias("_left"))
    within = again.join(small(ends), (F.col("run") == F.col("_run")) & F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_b") == F.col("_begin")))
    place = F.row_number().over(Window.partitionBy("run", stratum).orderBy("_o", key))
    within = within.withColumn("_a", (place <= F.col("_left")).cast("int")).groupBy("run", stratum, "_a").agg(F.count(F.lit(1)).alias("_n"), F.count("_y").alias("_k"), F.sum("_y").alias("_s"))
    whole = sums.where(~split).withColumn("_a", (F.col("_before") < F.col("_many")).cast("int")).select(*within.columns)
    own = rows.groupBy(stratum, F.col(treated).cast("int").alias("_a")).agg(F.count(F.lit(1)).alias("_n"), F.count("_y").alias("_k"), F.sum("_y").alias("_s")).withColumn("run", F.lit(0))
    both = own.unionByName(whole).unionByName(within)
    total = lambda c, v: F.sum(F.when(F.col("_a") == v, F.col(c)))
    mean = lambda v: total("_s", v) / F.nullif(total("_k", v), F.lit(0))
    strata = both.groupBy("run", stratum).agg(total("_n", 1).alias("n"), (mean(1) - mean(0)).alias("d")).where("d IS NOT NULL")
    effects = strata.groupBy("run").agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("att"))  # a row for each run
    one = effects.agg(F.max(F.when(F.col("run") == 0, F.col("att"))).alias("att"), F.collect_list(F.when(F.col("run") > 0, F.abs("att"))).alias("others"))
    above = F.size(F.filter("others", lambda a: a >= F.abs("att")))
    return one.select("att", F.size("others").cast("long").alias("runs"), ((above + 1) / (F.size("others") + 1)).alias("p"))


def masked_refits(df: DataFrame, y: str, xs: list[str], masked: str, mask, *, replicas: int, group: str) -> DataFrame:
    """(replica, arm, term, coefficient): least squares on replicas in which the values of `masked` are taken away where
    mask(replica) holds: on complete rows, and with the mean of what is left in the `group`. What reaches the driver is a
    matrix for each replica and arm."""
    names = ["const", *xs, y]
    each = df.select(group, *xs, y).columns
    rows = df.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas)))).withColumn("_gone", mask(F.col("replica"))).select("replica", "_gone", *each)
    means = rows.where("NOT _gone").groupBy("replica", group).agg(F.avg(masked).alias("_mean"))
    filled = rows.join(means, ["replica", group], "left").withColumn(masked, F.when(F.col("_gone"), F.col("_mean")).otherwise(F.col(masked).cast("double")))
    arms = filled.withColumn("arm", F.explode(F.when(F.col("_gone"), F.array(F.lit("imputed"))).otherwise(F.array(F.lit("imputed"), F.lit("complete"))))).withColumn("const", F.lit(1.0)).dropna(subset=[*xs, y])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = arms.groupBy("replica", "arm").agg(*(F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs)).collect()
    out, k = [], len(names) - 1
    for r in sums:
        g = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
        out += [(r["replica"], r["arm"], name, float(b)) for name, b in zip(names, np.linalg.pinv(g[:k, :k]) @ g[:k, k], strict=False)]
    return df.sparkSession.createDataFrame(out, "replica int, arm string, term string, coefficient double")


def imputed_refits(df: DataFrame, y: str, xs: list[str], masked: str, mask, *, predictors: list[str], group: str, replicas: int = 100) -> DataFrame:
    """(replica, arm, term, coefficient): least squares on `replicas` in which the values of `masked` are taken away where mask(replica), a
    column, holds: on the complete rows, and with what a regression of `masked` on the `predictors`, fitted on the complete rows of each `group`, puts in.

    Only rows that lose their value are met, once for each replica that takes it: their cross products come off those of all rows, and go back with the
    value put in, which is linear in the others, so that no row is met a second time. Regressions of (replica, group) are solved on the
    executors; the driver sees a matrix for each replica and arm. Rows with a null in any of the columns don't count.
    """
    columns = list(dict.fromkeys([*xs, y, *predictors, masked]))
    size, at = len(columns) + 1, {c: i + 1 for i, c in enumerate(columns)}
    taken = F.filter(F.sequence(F.lit(1), F.lit(replicas)), mask)
    full = df.select(F.col(group).alias("_g"), *(F.col(c).cast("double").alias(c) for c in columns), taken.alias("_r")).dropna(subset=columns)
    z = [F.lit(1.0), *(F.col(c) for c in columns)]
    products = F.array(*(F.sum(z[i] * z[j]) for i in range(size) for j in range(size)))
    whole = full.groupBy("_g").agg(products.alias("_all")).withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
    gone = full.withColumn("_k", F.explode("_r")).groupBy(F.col("_g").alias("_h"), "_k").agg(products.alias("_gone"))
    each = whole.join(gone, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("replica") == F.col("_k")), "left").select("replica", "_all", "_gone")

    def solve(g: np.ndarray, left: list[int], right: int) -> np.ndarray:
        scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
        even = g / np.outer(scale, scale)
        return np.linalg.pinv(even[np.ix_(left, left)], rcond=1e-12) @ even[left, right] / scale[left] * scale[right]

    def put_in(batches):
        target, left = at[masked], [0, *(at[c] for c in predictors)]
        for batch in batches:
            out = []
            for replica, all_, lost in zip(batch["replica"], batch["_all"], batch["_gone"], strict=True):
                lost = np.zeros((size, size)) if lost is None else np.array(lost, float).reshape(size, size)
                kept, turn = np.array(all_, float).reshape(size, size) - lost, np.eye(size)
                turn[target] = 0.0
                turn[target, left] = solve(kept, left, target)
                out.append((replica, kept.ravel().tolist(), (kept + turn @ lost @ turn.T).ravel().tolist()))
            yield pd.DataFrame(out, columns=["replica", "complete", "imputed"])

    sums = each.mapInPandas(put_in, "replica int, complete array<double>, imputed array<double>").groupBy("replica")
    found = sums.agg(*(F.array(*(F.sum(F.get(arm, F.lit(i))) for i in range(size * size))).alias(arm) for arm in ("complete", "imputed"))).collect()
    left, out = [0, *(at[c] for c in xs)], []
    for r in found:
        for arm in ("complete", "imputed"):
            fit = solve(np.array(r[arm]).reshape(size, size), left, at[y])
            out += [(r["replica"], arm, name, float(v)) for name, v in zip(["const", *xs], fit, strict=True)]
    return df.sparkSession.createDataFrame(out, "replica int, arm string, term string, coefficient double")


def propensity(df: DataFrame, treated: str, xs: list[str]) -> DataFrame:
    """`df` with a logistic propensity score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=xs, outputCol="_x").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol=treated, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r", regParam=1e-6).fit(rows)
    return model.transform(rows).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "_c", "_r")


def scaled(df: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """Columns less the mean and over the population deviation of the rows where `fit_on` holds."""
    stats = df.where(fit_on).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns)).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
    return joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}).select(*df.columns)


def sanity(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    spread = lambda c: F.coalesce(F.max(c) == F.min(c), F.lit(True))
    constant = F.array_compact(F.array(*(F.when(spread(c), F.lit(c)) for c in features)))
    return df.agg(F.count(F.lit(1)).alias("n"), spread(target).alias("constant_target"), F.array_join(constant, ",").alias("constant_features"))
