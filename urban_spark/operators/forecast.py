"""Forecasts of keyed series and how far they are off."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_split(df: DataFrame, cutoff: str, months: int = 12, *, date: str = "month") -> DataFrame:
    """Rows up to the cutoff as train, the next `months` as test; later ones go. Nothing after the cutoff is trained on."""
    end = F.lit(cutoff).cast("date")
    part = F.when(F.col(date) <= end, "train").when(F.col(date) <= F.add_months(end, months), "test")
    return df.withColumn("part", part).where("part IS NOT NULL")


def errors(df: DataFrame, keys: list[str], actual: str = "actual", forecast: str = "forecast", eps: float = 1e-9) -> DataFrame:
    e = F.col(forecast) - F.col(actual)
    mape = F.avg(F.when(F.abs(actual) > eps, F.abs(e / F.col(actual)))) * 100
    return df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), mape.alias("mape"), F.count(F.lit(1)).alias("n"))


def rolling_origin(df: DataFrame, value: str, *, horizon: int, step: int, least: int, key: str = "ward", date: str = "month") -> DataFrame:
    """Folds of the last-value forecast: for every `step`-th row from the `least`-th on as origin, the next `horizon` rows."""
    w = Window.partitionBy(key).orderBy(date)
    rows = df.withColumn("_rn", F.row_number().over(w)).select(key, date, F.col(value).alias("actual"), "_rn")
    ahead = F.collect_list(F.struct(F.col(date).alias("d"), "actual")).over(w.rowsBetween(1, horizon))
    folds = rows.withColumn("_next", ahead).where((F.col("_rn") >= least) & ((F.col("_rn") - least) % step == 0))
    return folds.select(key, F.col(date).alias("origin"), F.col("actual").alias("forecast"), F.posexplode("_next").alias("_h", "x")).select(key, "origin", (F.col("_h") + 1).alias("horizon"), F.col("x.d").alias(date), F.col("x.actual").alias("actual"), "forecast")


def holt_winters(df: DataFrame, value: str, *, horizon: int = 12, period: int = 12, key: str = "ward", date: str = "month") -> DataFrame:
    """(key, date, forecast): additive level, trend and season with the smoothing that fits each series best, on a small grid.

    One series is small and is fitted by one call; Spark spreads the series. Series shorter than two periods repeat their mean.
    """
    grid = np.array([(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.02, 0.1) for g in (0.05, 0.2, 0.5)])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(date)
        y = frame[value].to_numpy(float)
        dates = [(pd.Timestamp(frame[date].iloc[-1]) + pd.DateOffset(months=h)).date() for h in range(1, horizon + 1)]
        if len(y) < 2 * period:
            out = np.full(horizon, y.mean())
        else:
            a, b, g = grid.T
            level, trend = np.full(len(grid), y[:period].mean()), np.full(len(grid), (y[period : 2 * period].mean() - y[:period].mean()) / period)
            season, sse = np.tile(y[:period] - y[:period].mean(), (len(grid), 1)), np.zeros(len(grid))
            for t in range(period, len(y)):
                s = season[:, t % period]
                sse += (level + trend + s - y[t]) ** 2
                new = a * (y[t] - s) + (1 - a) * (level + trend)
                trend = b * (new - level) + (1 - b) * trend
                season[:, t % period] = g * (y[t] - new) + (1 - g) * s
                level = new
            k = int(sse.argmin())
            out = np.array([level[k] + h * trend[k] + season[k, (len(y) + h - 1) % period] for h in range(1, horizon + 1)])
        return pd.DataFrame({key: frame[key].iloc[0], date: dates, "forecast": out})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, date, value).dropna().groupBy(key).applyInPandas(fit, f"{key} {kind}, {date} date, forecast double")


def decompose(df: DataFrame, value: str, *, period: int = 12, key: str = "ward", date: str = "month") -> DataFrame:
    """trend: centred mean of a period (ends half weighted) where the window is full; seasonal: the mean of what is left by
    place in the period, less their mean; residual."""
    w, half = Window.partitionBy(key).orderBy(date), period // 2
    full = F.count(value).over(w.rowsBetween(-half, half)) == 2 * half + 1
    ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
    trend = F.when(full, (F.sum(value).over(w.rowsBetween(-half + 1, half - 1)) + ends) / period)
    rows = df.withColumn("trend", trend).withColumn("_p", F.month(date) % period)
    means = rows.groupBy(key, "_p").agg(F.avg(F.col(value) - F.col("trend")).alias("_s"))
    means = means.withColumn("seasonal", F.col("_s") - F.avg("_s").over(Window.partitionBy(key))).drop("_s")
    joined = rows.join(means, [key, "_p"]).drop("_p")
    return joined.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))


def tree_forecast(df: DataFrame, target: str, features: list[str], train: Column, *, trees: int = 20, depth: int = 5, seed: int = 7):
    """(rows not trained on with `forecast`, importance table of the features), by a random forest over all keys."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.dropna(subset=[target, *features]))
    model = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="forecast", numTrees=trees, maxDepth=depth, seed=seed).fit(rows.where(train))
    importance = df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double")
    return model.transform(rows.where(~train)).drop("_x"), importance


def recursive_forecast(df: DataFrame, value: str, weights: list[float], intercept: float, horizon: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    """(key, date, h, forecast): a linear model on the last len(weights) values, nearest first, each forecast taking its place
    among them; series with fewer values go. The state is an array for each key."""
    n = len(weights)
    w = Window.partitionBy(key).orderBy(F.desc(date))
    last = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    state = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rn", value))).alias("_s"), F.max(date).alias("_d")).where(F.size("_s") == n)
    start = F.struct(F.transform("_s", lambda x: x[value].cast("double")).alias("last"), F.array().cast("array<double>").alias("out"))
    w_ = F.array(*(F.lit(float(x)) for x in weights))

    def step(a: Column, h: Column) -> Column:
        new = F.aggregate(F.zip_with(a["last"], w_, lambda x, y: x * y), F.lit(float(intercept)), lambda s, x: s + x)
        return F.struct(F.concat(F.array(new), F.slice(a["last"], 1, n - 1)).alias("last"), F.concat(a["out"], F.array(new)).alias("out"))

    made = state.select(key, "_d", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda a: a["out"])).alias("_i", "forecast"))
    return made.select(key, F.add_months("_d", F.col("_i") + 1).alias(date), (F.col("_i") + 1).alias("h"), "forecast")


@dataclass
class Trees:
    """A fitted ensemble as arrays over all nodes: the feature that a node asks for (-1 in a leaf), its threshold, where it goes on, its value; and by
    tree the root and the weight. `depth` is the longest way down."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    roots: list[int]
    weights: list[float]
    depth: int

    def predicted(self, x: Column) -> Column:
        """The ensemble's value for an array of features, in the order they were fitted in."""
        feature, threshold, left, right = F.lit(self.feature), F.lit(self.threshold), F.lit(self.left), F.lit(self.right)

        def down(node: Column, _: Column) -> Column:
            goes_left = F.get(x, F.get(feature, node)) <= F.get(threshold, node)
            return F.when(F.get(feature, node) < 0, node).when(goes_left, F.get(left, node)).otherwise(F.get(right, node))

        steps = F.sequence(F.lit(1), F.lit(max(self.depth, 1)))
        leaves = F.transform(F.lit(self.roots), lambda root: F.get(F.lit(self.value), F.aggregate(steps, root, down)))
        return F.aggregate(F.zip_with(leaves, F.lit(self.weights), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)


    def of(self, x: np.ndarray) -> np.ndarray:
        """As predicted(), for an array (rows, features)."""
        feature, threshold, left, right, value = (np.asarray(a) for a in (self.feature, self.threshold, self.left, self.right, self.value))
        rows, out = np.arange(len(x)), np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, np.maximum(feature[node], 0)] <= threshold[node], left[node], right[node])  # a leaf leads to itself
            out += weight * value[node]
        return out


def compiled(model) -> Trees:
    """A random forest or gradient-boosted regression model of pyspark.ml with continuous features, as Trees."""
    out = Trees([], [], [], [], [], [], [], model_depth(model))
    forest = type(model).__name__.startswith("RandomForest")

    def put(node) -> int:
        at = len(out.feature)
        inner = node.getClass().getSimpleName() == "InternalNode"
        out.feature.append(node.split().featureIndex() if inner else -1)
        out.threshold.append(float(node.split().threshold()) if inner else 0.0)
        out.value.append(float(node.prediction()))
        out.left.append(at)
        out.right.append(at)
        if inner:
            out.left[at], out.right[at] = put(node.leftChild()), put(node.rightChild())
        return at

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        out.roots.append(put(tree._java_obj.rootNode()))
        out.weights.append(1.0 / len(model.trees) if forest else float(weight))
    return out


def model_depth(model) -> int:
    return max(tree.depth for tree in model.trees)


def _lag_names(value: str, lags: list[int], means: list[int]) -> list[str]:
    return [*(f"{value}_lag_{k}" for k in lags), *(f"{value}_mean_{k}" for k in means), "_month_of_year"]


def lag_features(df: DataFrame, value: str, lags: list[int], means: list[int], *, key: str = "ward", date: str = "month") -> DataFrame:
    """`df` with the values `lags` rows ago, the means of so many rows before (null where there are fewer), and the month of the year."""
    w = Window.partitionBy(key).orderBy(date)
    before = {f"{value}_mean_{k}": F.when(F.count(value).over(w.rowsBetween(-k, -1)) == k, F.avg(F.col(value).cast("double")).over(w.rowsBetween(-k, -1))) for k in means}
    return df.withColumns({f"{value}_lag_{k}": F.lag(F.col(value).cast("double"), k).over(w) for k in lags} | before | {"_month_of_year": F.month(date).cast("double")})


def fit_lag_trees(
    df: DataFrame, value: str, lags: list[int], means: list[int], train: Column, *, kind: str = "forest", trees: int = 20, depth: int = 5, seed: int = 7, key: str = "ward", date: str = "month"
):
    """A model of pyspark.ml for `value` on lag_features() over all keys, fitted where `train` holds: a random forest, or boosted trees (kind="boosted")."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    names = _lag_names(value, lags, means)
    rows = lag_features(df, value, lags, means, key=key, date=date).where(train).dropna(subset=[value, *names])
    rows = VectorAssembler(inputCols=names, outputCol="_x").transform(rows.withColumn(value, F.col(value).cast("double")))
    options = {"featuresCol": "_x", "labelCol": value, "maxDepth": depth, "seed": seed}
    return (RandomForestRegressor(numTrees=trees, **options) if kind == "forest" else GBTRegressor(maxIter=trees, **options)).fit(rows)


def recursive_tree_forecast(df: DataFrame, value: str, trees: Trees, lags: list[int], means: list[int], horizon: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    """(key, date, h, forecast): each series carried on `horizon` months by trees fitted on lag_features() of `lags` and `means`, each forecast taking
    its place among the last values. The state of a series is an array of these; all steps are one pass, in which the trees are walked by all series of a batch at once. Series with
    fewer values than the features need, or with a null among those, go."""
    n = max([*lags, *means])
    w = Window.partitionBy(key).orderBy(F.desc(date))
    last = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).where(F.col(value).isNotNull())
    state = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).cast("double").alias("_v")))).alias("_s"), F.max(date).alias("_d")).where(F.size("_s") == n)
    state = state.select(key, "_d", F.month("_d").alias("_m"), F.reverse(F.transform("_s", lambda x: x["_v"])).alias("_last"))

    def carried_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.empty((len(batch), n + horizon))
            values[:, :n] = np.stack(batch["_last"].to_numpy()) if len(batch) else values[:, :n]
            for h in range(horizon):
                past = values[:, h : h + n]
                month = (batch["_m"].to_numpy() + h) % 12 + 1
                values[:, n + h] = trees.of(np.column_stack([*(past[:, -k] for k in lags), *(past[:, -k:].mean(axis=1) for k in means), month.astype(float)]))
            yield pd.DataFrame({key: batch[key], "_d": batch["_d"], "_made": list(values[:, n:])})

    types = {c: df.schema[c].dataType.simpleString() for c in (key, date)}
    made = state.mapInPandas(carried_on, f"`{key}` {types[key]}, _d {types[date]}, _made array<double>").select(key, "_d", F.posexplode("_made").alias("_i", "forecast"))
    return made.select(key, F.add_months("_d", F.col("_i") + 1).alias(date), (F.col("_i") + 1).alias("h"), "forecast")


def bands(forecast: Column, share: float) -> tuple[Column, Column]:
    return forecast - share * F.abs(forecast), forecast + share * F.abs(forecast)


def ensemble(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the forecasts that are there."""
    top = reduce(lambda a, b: a + b, (F.coalesce(c * w, F.lit(0.0)) for c, w in parts))
    low = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts))
    return F.when(low > 0, top / low)


def adjusted(forecast: Column, rules: list[tuple[Column, float]]) -> Column:
    """Times the factor of the first rule that holds, rules from the strictest on."""
    factor = F.lit(1.0)
    for condition, by in reversed(rules):
        factor = F.when(condition, by).otherwise(factor)
    return forecast * factor


def clamped(forecast: Column, base: Column, percent: float) -> Column:
    """At most `percent` away from the base; as it is where there is no base."""
    reach = F.abs(base) * percent / 100
    return F.when(base.isNull(), forecast).otherwise(F.greatest(base - reach, F.least(base + reach, forecast)))


def preferred(df: DataFrame, order: list[str], *, model: str = "model", keys: list[str]) -> DataFrame:
    """For each key the rows of the first model in `order` that has any; models not named come last, by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(model)), F.lit(0))
    ranked = df.withColumn("_r", F.struct(F.when(rank == 0, 1 << 30).otherwise(rank).alias("a"), F.col(model).alias("b")))
    return ranked.withColumn("_best", F.min("_r").over(Window.partitionBy(*keys))).where(F.col("_r") == F.col("_best")).drop("_r", "_best")


def horizon_errors(df: DataFrame, ends: list[int], *, horizon: str = "horizon", actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """Errors of the forecasts up to each horizon, and their growth over that before."""
    rows = df.withColumn("upto", F.explode(F.filter(F.array(*map(F.lit, ends)), lambda e: F.col(horizon) <= e)))
    table = errors(rows, ["upto"], actual, forecast)
    w = Window.orderBy("upto")
    return table.withColumn("growth", F.col("rmse") / F.lag("rmse").over(w) - 1)


def first_crossing(df: DataFrame, value: str, *, threshold: float, kind: str, key: str = "ward", date: str = "month") -> DataFrame:
    """(key, year): the first year in which a value is above the threshold, given as it is or as a quantile of all values."""
    if kind == "quantile":
        from urban_spark.operators.panel import exact_quantiles

        cut = exact_quantiles(df, {"_cut": (value, threshold)}).withColumn("_one", F.lit(1))
    else:
        cut = df.sparkSession.createDataFrame([(float(threshold), 1)], "_cut double, _one int")
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one")
    return joined.groupBy(key).agg(F.min(F.when(F.col(value) > F.col("_cut"), F.year(date))).cast("long").alias("year"))
