"""Clusters of feature rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.operators.graph import _cut, components

#: Centres that rows are assigned to at most.
MOST_CENTERS = 1_000


def kmeans(df: DataFrame, features: list[str], ks: list[int], *, seed: int = 42) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(k, inertia, silhouette) table, and `df` with `label` for each k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows, out, table = VectorAssembler(inputCols=features, outputCol="_x").transform(df), {}, []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="label").fit(rows)
        labelled = model.transform(rows)
        table.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator(featuresCol="_x", predictionCol="label").evaluate(labelled))))
        out[k] = labelled.drop("_x")
    return df.sparkSession.createDataFrame(table, "k int, inertia double, silhouette double"), out


def centroids(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(label, n, features): each label's mean in the units of `df`, which may not be those it was fitted in."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in features))


def hierarchy(df: DataFrame, features: list[str], k: int = 4, *, seed: int = 42) -> DataFrame:
    """`df` with `label` by k-means that splits one group in two at a time."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    return BisectingKMeans(k=k, seed=seed, featuresCol="_x", predictionCol="label").fit(rows).transform(rows).drop("_x")


def close_pairs(df: DataFrame, features: list[str], eps: float, *, key: str) -> DataFrame:
    """(src, dst) both ways for rows at most eps apart, found through cells of edge eps over the first two features."""
    at = df.select(key, *features).withColumns({f"_c{i}": F.floor(F.col(f) / eps) for i, f in enumerate(features[:2])})
    a = at.select(F.col(key).alias("src"), *(F.col(f).alias(f"_a{i}") for i, f in enumerate(features)), "_c0", *(["_c1"] if len(features) > 1 else []))
    b = at.select(F.col(key).alias("dst"), *(F.col(f).alias(f"_b{i}") for i, f in enumerate(features)), "_c0", *(["_c1"] if len(features) > 1 else []))
    cells = [f"_c{i}" for i in range(min(2, len(features)))]
    for c in cells:
        b = b.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    d = reduce(lambda x, y: x + y, (F.pow(F.col(f"_a{i}") - F.col(f"_b{i}"), 2) for i in range(len(features))))
    return a.join(b, cells).where((F.col("src") != F.col("dst")) & (d <= eps * eps)).select("src", "dst")


def dbscan(df: DataFrame, features: list[str], *, key: str, eps: float, least: int) -> DataFrame:
    """(key, label): the least core row of the cluster, null for noise. Core rows have `least` rows (themselves included) within
    eps; border rows join the least cluster of a core row near. Rows without one of the features are near none.

    Rows at one place share their neighbours, so that pairs are of places, each under its least key and with the number of its rows.
    """
    has = reduce(lambda x, y: x & y, (F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features))
    places = _cut(df.where(has).groupBy(*features).agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("_n")))
    pairs = _cut(close_pairs(places, features, eps, key="id"))
    around = pairs.join(places.select(F.col("id").alias("dst"), "_n"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("_n").alias("_around"))
    core = _cut(places.join(around, "id", "left").where(F.col("_n") + F.coalesce("_around", F.lit(0)) >= least).select("id"))
    links = pairs.join(core.select(F.col("id").alias("src")), "src").join(core.select(F.col("id").alias("dst")), "dst")
    labels = components(core, links)
    near = pairs.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
    found = places.join(labels, "id", "left").join(near, "id", "left").select(*features, F.coalesce("component", "near").alias("label"))
    alone = F.col(key) if least <= 1 else F.lit(None).cast(df.schema[key].dataType)
    return df.where(has).select(key, *features).join(found, features).select(key, "label").unionByName(df.where(~has).select(key, alone.alias("label")))


def capped_assignment(df: DataFrame, centers: DataFrame, size: str, *, key: str, slack: float = 0.05) -> DataFrame:
    """(key, center): rows go to the nearest centre with room, all at once in each round: a centre takes the nearest that ask
    until its share of the total, times 1 + slack, is full; the rest ask the next nearest, until none is left. Rows that no
    centre had room for, once each has been asked, go to their nearest. `df`: key, size, x, y; centers: center, cx, cy, at
    most MOST_CENTERS, as each row holds its wishes.

    What asks of a centre before a row is summed in two levels: within ranges of the distance, and over the ranges below.
    """
    n = centers.count()
    if n > MOST_CENTERS:
        raise ValueError(f"more than {MOST_CENTERS} centres")
    limit = df.agg(F.sum(size)).collect()[0][0] / n * (1 + slack) if n else 0.0
    one = centers.agg(F.collect_list(F.struct("center", "cx", "cy")).alias("_all"))
    wishes = F.array_sort(F.transform("_all", lambda c: F.struct((F.pow(F.col("x") - c["cx"], 2) + F.pow(F.col("y") - c["cy"], 2)).alias("d"), c["center"].alias("c"))))
    left, done, used = _cut(df.crossJoin(F.broadcast(one)).select(key, size, wishes.alias("_w"))), [], None  # `one` is one row
    for k in range(n):
        ask = left.select(key, size, "_w", F.col("_w")[k]["c"].alias("center"), F.col("_w")[k]["d"].alias("_d"))
        cuts = sorted(set(ask.stat.approxQuantile("_d", [i / 64 for i in range(1, 64)], 1 / 256) or []))
        at = F.lit(0)
        for cut in cuts:
            at = at + (F.col("_d") >= F.lit(cut)).cast("int")
        ask = ask.withColumn("_b", at)
        below = Window.partitionBy("center").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = ask.groupBy("center", "_b").agg(F.sum(size).cast("double").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(below), F.lit(0.0))).drop("_s")
        own = F.sum(size).over(Window.partitionBy("center", "_b").orderBy("_d", key).rowsBetween(Window.unboundedPreceding, 0))
        ask = ask.withColumn("_own", own).join(F.broadcast(sums), ["center", "_b"])  # at most 64 rows a centre
        ask = ask.withColumn("_u", F.lit(0.0)) if used is None else ask.join(F.broadcast(used), "center", "left").fillna(0.0, ["_u"])
        got = _cut(ask.where(F.col("_own") + F.col("_before") + F.col("_u") <= limit).select(key, size, "center"))
        done.append(got)
        used = reduce(DataFrame.unionByName, done).groupBy("center").agg(F.sum(size).cast("double").alias("_u"))
        left = _cut(left.join(got.select(key), key, "left_anti"))
        if left.isEmpty():
            break
    rest = left.select(key, F.col("_w")[0]["c"].alias("center"))
    return reduce(DataFrame.unionByName, (g.select(key, "center") for g in done), rest)


def balanced_assignment(
    df: DataFrame, centers: DataFrame, measures: tuple[str, str], *, key: str, shares: dict | None = None, margin: float = 0.05, rounds: int = 300, noise: float = 1e-3, strict: bool = True
) -> DataFrame:
    """(key, center): every row of `df` (key, x, y and the `measures`) at one of `centers` (center, cx, cy), near ones first, such that of both
    measures each centre holds its share of the total (`shares`: center -> weight; equal ones without), within `margin` of it, above and below.

    An auction: each centre has a price for a unit of either measure, each row takes the centre with the least sum of its distance and
    prices. Prices go up where a centre holds too much and down where too little, by steps that grow as long as the sign stays and halve where it
    turns. A round is one pass over the rows that sums by centre; the driver sees two sums a centre. Equal rows are told apart
    by `noise` times the mean distance, dealt by hash.

    If no round is within the margin (rows may be too large for it) that is an error, or with strict=False the round whose
    worst centre is least off. Null measures count 0. More than MOST_CENTERS centres are an error; no rows: no rows.
    """
    import math

    at = [(r["center"], float(r["cx"]), float(r["cy"])) for r in centers.select("center", "cx", "cy").orderBy("center").limit(MOST_CENTERS + 1).collect()]
    if not 0 < len(at) <= MOST_CENTERS:
        raise ValueError(f"1 to {MOST_CENTERS} centres")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = _cut(df.select(key, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), *(value(c).alias(f"_m{i}") for i, c in enumerate(measures))))
    cx, cy = F.lit([c[1] for c in at]), F.lit([c[2] for c in at])
    far = F.zip_with(cx, cy, lambda x, y: F.sqrt(F.pow(F.col("_x") - x, 2) + F.pow(F.col("_y") - y, 2)))
    count, mean, *totals = rows.agg(F.count(F.lit(1)), F.avg(F.array_min(far)), F.sum("_m0"), F.sum("_m1")).first()
    weight = [float(shares[c[0]]) if shares else 1.0 for c in at]
    goals = [[w / sum(weight) * (t or 0.0) for w in weight] for t in totals]
    unit, scale = [(t or 0.0) / max(count, 1) or 1.0 for t in totals], mean or 1.0
    prices, steps, signs = ([[v] * len(at) for _ in totals] for v in (0.0, 0.25, 0))
    deal = lambda i: F.pmod(F.xxhash64(key, i), F.lit(1 << 20)) / float(1 << 20)

    def choice(prices: list[list[float]]):
        own = F.zip_with(F.lit(prices[0]), F.lit(prices[1]), lambda p, q: p * F.col("_m0") / unit[0] + q * F.col("_m1") / unit[1])
        cost = F.zip_with(far, own, lambda d, p: d / scale + p)
        return F.array_min(F.transform(cost, lambda v, i: F.struct((v + noise * deal(i)).alias("v"), i.alias("i"))))["i"]

    best, kept = math.inf, prices
    for _ in range(rounds):
        held = {r["i"]: (r["a"], r["b"]) for r in rows.groupBy(choice(prices).alias("i")).agg(F.sum("_m0").alias("a"), F.sum("_m1").alias("b")).collect()}
        off = [[(held.get(i, (0.0, 0.0))[m] - g) / g if g else 0.0 for i, g in enumerate(goals[m])] for m in (0, 1)]
        worst = max(abs(v) for m in off for v in m)
        if worst < best:
            best, kept = worst, [list(p) for p in prices]
        if worst <= margin:
            break
        for m in (0, 1):
            for i, v in enumerate(off[m]):
                sign = 0 if abs(v) <= margin / 2 else 1 if v > 0 else -1
                steps[m][i] = min(8.0, max(1e-7, steps[m][i] * (1.25 if sign * signs[m][i] > 0 else 0.5 if sign * signs[m][i] < 0 else 1.0)))
                prices[m][i] += sign * steps[m][i] * min(1.0, abs(v) * 4)
                signs[m][i] = sign
    if best > margin and strict:
        raise RuntimeError(f"no assignment within {margin:.0%}: the best is {best:.1%} off")
    return rows.select(key, F.get(F.lit([c[0] for c in at]), choice(kept)).alias("center"))
