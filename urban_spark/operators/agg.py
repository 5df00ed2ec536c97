"""Aggregations, ranks and set operations over wards, cells and sectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_measures(df: DataFrame, keys: list[str], measures: list[str], *, count: str | None = "n") -> DataFrame:
    """Sums that are 0 where all is null, and the number of rows; rows without a key go."""
    rows = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    return rows.groupBy(*keys).agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures), *([F.count(F.lit(1)).alias(count)] if count else []))


def mean_measures(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in measures))


def numeric_columns(df: DataFrame, *without: str) -> list[str]:
    return [n for n, k in df.dtypes if (k in ("int", "bigint", "double", "float", "smallint", "tinyint") or k.startswith("decimal")) and n not in without]


def mode(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """The most frequent value, the least of equally frequent ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("c"), F.col(value).alias("v"))).alias("_m")).select(*keys, F.col("_m.v").alias(out))


def built_up_ratio(buildings: DataFrame, cell_area: float, *, cells: str = "cell_ids", footprint: str = "footprint", floors: str = "floors") -> DataFrame:
    """Each footprint split evenly over its cells; percent of the cell's area, 100 at most, and mean floors."""
    split = buildings.select(F.explode(cells).alias("cell"), (F.col(footprint) / F.size(cells)).alias("part"), F.col(floors).alias("f"))
    return split.groupBy("cell").agg(F.least(F.lit(100.0), 100 * F.sum("part") / cell_area).alias("built_pct"), F.avg("f").alias("mean_floors"), F.count(F.lit(1)).alias("buildings"))


def allocate_by_weight(totals: DataFrame, parts: DataFrame, *, key: str, value: str, weight: str) -> DataFrame:
    """Each key's value over its parts by weight; evenly where all weights are 0 or null."""
    w = Window.partitionBy(key)
    shares = parts.withColumn("_w", F.sum(F.coalesce(F.col(weight), F.lit(0.0))).over(w)).withColumn("_c", F.count(F.lit(1)).over(w))
    share = F.when(F.col("_w") > 0, F.coalesce(F.col(weight), F.lit(0.0)) / F.col("_w")).otherwise(1 / F.col("_c"))
    return shares.join(totals.select(key, value), key).withColumn(value, F.col(value) * share).drop("_w", "_c")


def reconcile(allocated: DataFrame, totals: DataFrame, *, key: str, value: str) -> DataFrame:
    sums = allocated.groupBy(key).agg(F.sum(value).alias("allocated"))
    return totals.select(key, F.col(value).alias("source")).join(sums, key, "left").withColumn("difference", F.coalesce("allocated", F.lit(0.0)) - F.col("source"))


def inverse_distance(cells: DataFrame, pairs: DataFrame, values: list[str], *, cell: str = "cell", distance: str = "km", power: float = 2.0) -> DataFrame:
    """Weighted means of station values by 1 / distance ** power; weights are summed for each value, so that a station
    without one doesn't count for it. `pairs`: a row for each cell and station, with the values."""
    weight = 1 / F.pow(F.greatest(F.col(distance), F.lit(1e-6)), power)
    one = [(F.sum(F.col(v) * weight) / F.sum(F.when(F.col(v).isNotNull(), weight))).alias(v) for v in values]
    return cells.join(pairs.groupBy(cell).agg(*one), cell, "left")


def od_totals(flows: DataFrame, *, origin: str = "src", destination: str = "dst", flow: str = "flow") -> DataFrame:
    out = flows.groupBy(F.col(origin).alias("place")).agg(F.sum(flow).alias("outflow"))
    into = flows.groupBy(F.col(destination).alias("place")).agg(F.sum(flow).alias("inflow"))
    both = out.join(into, "place", "full")
    return both.select("place", F.coalesce("outflow", F.lit(0)).alias("outflow"), F.coalesce("inflow", F.lit(0)).alias("inflow"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, missing, mean, std, min, quartiles, max."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    long = df.select(pairs.alias("_p")).select("_p.*")
    from urban_spark.operators.panel import exact_quantiles

    moments = long.groupBy("column").agg(
        F.count("v").alias("count"), F.sum(F.col("v").isNull().cast("long")).alias("missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    cuts = [exact_quantiles(df, {f"q{q}": (c, q / 100) for q in (25, 50, 75)}).withColumn("column", F.lit(c)) for c in columns]
    return moments.join(F.broadcast(reduce(DataFrame.unionByName, cuts)), "column").select("column", "count", "missing", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; the last holds its upper end; values outside go."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).count().select("bin", (low + F.col("bin") * width).alias("low"), F.col("count").alias("n"))


def exceedance(df: DataFrame, keys: list[str], value: str, unit: float = 1) -> DataFrame:
    """Mean and maximum of a severity, and the shares of rows above 0, from 1 and from 2 on. Values may be whole numbers that count `unit` to a
    severity of 1; sums of these are the same in any order."""
    share = lambda c: F.avg(c.cast("double"))
    v = F.col(value)
    return df.groupBy(*keys).agg((F.avg(v) / unit).alias("mean"), (F.max(v) / unit).alias("max"), share(v > 0).alias("share_above_0"), share(v >= unit).alias("share_from_1"), share(v >= 2 * unit).alias("share_from_2"))


def quantiles(df: DataFrame, value: str, at: list[float], keys: list[str] = ()) -> DataFrame:
    """Exact quantiles by group, or of all rows without keys."""
    if not keys:
        from urban_spark.operators.panel import exact_quantiles

        return exact_quantiles(df, {f"p{round(q * 100)}": (value, q) for q in at})
    return df.groupBy(*keys).agg(*(F.percentile(value, F.lit(q)).alias(f"p{round(q * 100)}") for q in at))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, out: str = "weighted_mean") -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0))).alias(out))


def gini(df: DataFrame, value: str) -> DataFrame:
    """(n, gini) over values from 0 up: sum((2 * rank - n - 1) * x) / (n * sum(x)), ranks from counts of distinct values."""
    from urban_spark.operators.panel import cumulative

    counts = df.where(F.col(value) >= 0).groupBy(F.col(value).alias("v")).count()
    upto = cumulative(counts, "v", "count", "upto")
    # The sum of the ranks of the values that are equal is their number times the mean of their ranks.
    ranks = F.col("count") * (2 * F.col("upto") - F.col("count") + 1) / 2
    sums = upto.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in (("n", F.col("count")), ("s", F.col("v") * F.col("count")), ("r", F.col("v") * ranks))))
    return sums.select("n", F.when((F.col("n") == 0) | (F.col("s") == 0), 0.0).otherwise((2 * F.col("r") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).alias("gini"))


def palma(df: DataFrame, value: str, order: str) -> DataFrame:
    """Sum of the value over the top 10 % by `order` against that over the bottom 40 %, cut at exact percentiles."""
    from urban_spark.operators.panel import exact_quantiles

    cuts = exact_quantiles(df, {"hi": (order, 0.9), "lo": (order, 0.4)}).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(cuts), "_one")
    top, low = F.sum(F.when(F.col(order) >= F.col("hi"), F.col(value))), F.sum(F.when(F.col(order) <= F.col("lo"), F.col(value)))
    return joined.agg((top / F.nullif(low, F.lit(0))).alias("palma"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Counts of each value, and a row `TOTAL`."""
    counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias(key)).count()
    return counts.unionByName(counts.agg(F.lit("TOTAL").alias(key), F.coalesce(F.sum("count"), F.lit(0)).alias("count")))


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum for each group, and its share of all."""
    groups = df.groupBy(*keys).agg(F.sum(value).alias(value)).withColumn("_one", F.lit(1))
    total = groups.agg(F.sum(value).alias("_t")).withColumn("_one", F.lit(1))
    return groups.join(F.broadcast(total), "_one").withColumn("share", F.col(value) / F.col("_t")).drop("_one", "_t")


def missing_ratio(df: DataFrame, columns: list[str], alert: float) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("double").alias("m")) for c in columns)))
    ratio = df.select(pairs.alias("_p")).select("_p.*").groupBy("column").agg(F.avg("m").alias("missing_ratio"))
    return ratio.withColumn("alert", F.col("missing_ratio") > alert)


def nested_mean(df: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """Means of means: over the keys of each level in turn."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(value).alias(value))
    return df


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_and_worst(df: DataFrame, keys: list[str], value: str, k: int, order: list[str]) -> DataFrame:
    low, high = Window.partitionBy(*keys).orderBy(F.asc(value), *order), Window.partitionBy(*keys).orderBy(F.desc(value), *order)
    ranked = df.withColumn("_lo", F.row_number().over(low)).withColumn("_hi", F.row_number().over(high)).where((F.col("_lo") <= k) | (F.col("_hi") <= k))
    return ranked.withColumn("kind", F.when(F.col("_lo") <= k, "lowest").otherwise("highest")).drop("_lo", "_hi")


def top_fraction(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Rows at or above the exact percentile 1 - fraction."""
    from urban_spark.operators.panel import exact_quantiles

    cut = exact_quantiles(df, {"_cut": (value, 1 - fraction)}).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one").where(F.col(value) >= F.col("_cut"))
    return joined.drop("_one", "_cut")


def tagged_union(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(name)) for name, df in parts.items()))


def outer_chain(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if a key has several rows on the right."""
    if not right.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} is not unique on the right")
    return left.join(right, keys, "left")


def min_max(df: DataFrame, columns: list[str], eps: float = 1e-9) -> DataFrame:
    """Columns on 0..1 by their least and greatest value."""
    ends = df.agg(*(F.min(c).alias(f"_lo_{c}") for c in columns), *(F.max(c).alias(f"_hi_{c}") for c in columns)).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")
    return joined.select(*((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + eps) if c in columns else F.col(c) for c in df.columns)).toDF(*df.columns)
