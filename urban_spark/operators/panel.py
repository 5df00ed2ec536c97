"""Monthly panels: one row a key and month; every window is by key, in the order of the date."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: str, date: str):
    return Window.partitionBy(key).orderBy(date)


def lags(df: DataFrame, value: str, steps: list[int], *, key: str = "ward", date: str = "month") -> DataFrame:
    return df.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(_by(key, date)) for k in steps})


def rolling_mean(df: DataFrame, value: str, sizes: list[int], *, key: str = "ward", date: str = "month", previous_only: bool = False, full_only: bool = False) -> DataFrame:
    """Means of the last rows; with `previous_only` the row itself stays out, with `full_only` short windows are null."""
    shift = 1 if previous_only else 0
    out = {}
    for n in sizes:
        frame = _by(key, date).rowsBetween(-(n - 1) - shift, -shift)
        mean = F.avg(value).over(frame)
        out[f"{value}_roll_mean_{n}"] = F.when(F.count(value).over(frame) == n, mean) if full_only else mean
    return df.withColumns(out)


def rolling_std(df: DataFrame, value: str, sizes: list[int], *, key: str = "ward", date: str = "month") -> DataFrame:
    """Sample deviation of the last rows, 0 where there is none."""
    return df.withColumns({f"{value}_roll_std_{n}": F.coalesce(F.stddev_samp(value).over(_by(key, date).rowsBetween(-(n - 1), 0)), F.lit(0.0)) for n in sizes})


def ordered_fold(df: DataFrame, keys: list[str], order: str, value: str, fold, out: str) -> DataFrame:
    """(keys, order, value, and the columns of `out`, a DDL string): the rows of each key in order, with what fold(values)
    gives for them, a list for each column of `out`. One pass over a key's rows, which are one task's, with null as None."""
    rows = df.select(*keys, order, value)
    schema, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), [c.split()[0] for c in out.split(", ")]

    def folded(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        for name, column in zip(names, fold(table.column(value).to_pylist()), strict=True):
            table = table.append_column(name, pa.array(column, pa.bool_() if isinstance(column[0], bool) else pa.float64()))
        return table

    return rows.groupBy(*keys).applyInArrow(folded, f"{schema}, {out}")


def ema(df: DataFrame, value: str, span: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    """Exponential moving average, unadjusted: the first value, then a * x + (1 - a) * before with a = 2 / (span + 1). A null
    has no average, and the next value starts anew."""
    a = 2 / (span + 1)

    def fold(values: list) -> tuple[list]:
        out, state = [], None
        for x in values:
            state = None if x is None else float(x) if state is None else a * float(x) + (1 - a) * state
            out.append(state)
        return (out,)

    return ordered_fold(df, [key], date, value, fold, f"{value}_ema_{span} double")


def differences(df: DataFrame, value: str, steps: list[int], *, key: str = "ward", date: str = "month") -> DataFrame:
    return df.withColumns({f"{value}_diff_{k}": F.col(value) - F.lag(value, k).over(_by(key, date)) for k in steps})


def position(df: DataFrame, *, key: str = "ward", date: str = "month") -> DataFrame:
    return df.withColumn("time_idx", F.row_number().over(_by(key, date)) - 1)


def fill_both_ways(df: DataFrame, value: str, *, key: str = "ward", date: str = "month") -> DataFrame:
    """Nulls take the last value before, at the start of a series the first after."""
    w = _by(key, date)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one frame; needed where nothing is before
    return df.withColumn(value, F.coalesce(before, first))


def fill_by_medians(df: DataFrame, value: str, *, key: str = "ward") -> DataFrame:
    """Nulls take their key's median, else the median of all, else 0."""
    own = df.groupBy(F.col(key).alias("_key")).agg(F.median(value).alias("_own"))
    all_ = exact_quantiles(df, {"_all": (value, 0.5)}).withColumn("_one", F.lit(1))
    joined = df.join(own, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_one", F.lit(1)).join(F.broadcast(all_), "_one")
    return joined.withColumn(value, F.coalesce(value, "_own", "_all", F.lit(0.0))).select(*df.columns)


def last_rows(df: DataFrame, n: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(date))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def average_rank_percent(df: DataFrame, value: str, scale: float, out: str) -> DataFrame:
    """Average rank over the number of rows, times `scale`; ties share the mean of their ranks.

    Ranks come from the counts of distinct values, cumulated over a range partitioning of these, not from one sorted task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).count()
    below = cumulative(counts, "_v", "count", "_upto")
    total = counts.agg(F.sum("count").alias("_n")).withColumn("_one", F.lit(1))
    rank = F.col("_upto") - (F.col("count") - 1) / 2
    ranks = below.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("_v", (rank / F.col("_n") * scale).alias(out))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: name -> the exact quantile (column, share), between the two values beside it where it falls between; null
    without values. From counts of distinct values, cumulated in two levels, so that no task sees all of them."""
    out = None
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).count()
        upto = cumulative(counts, "_v", "count", "_upto")
        total = counts.agg(F.sum("count").alias("_n")).withColumn("_one", F.lit(1))
        rows, names = upto.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one"), [k for k, (c, _) in wanted.items() if c == column]
        ends = []
        for name in names:
            place = (F.col("_n") - 1) * F.lit(float(wanted[name][1]))
            ends += [F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v"))).alias(f"{name}_lo"), F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v"))).alias(f"{name}_hi"), F.max(place).alias(f"{name}_at")]
        lo, hi, at = (lambda s: lambda name: F.col(f"{name}_{s}"))("lo"), (lambda s: lambda name: F.col(f"{name}_{s}"))("hi"), (lambda s: lambda name: F.col(f"{name}_{s}"))("at")
        between = [F.when(lo(k) == hi(k), lo(k)).otherwise((F.ceil(at(k)) - at(k)) * lo(k) + (at(k) - F.floor(at(k))) * hi(k)).alias(k) for k in names]
        one = rows.agg(*ends).select(*between)
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(*wanted)


def cumulative(df: DataFrame, order: str, value: str, out: str, buckets: int = 64) -> DataFrame:
    """Running sum of `value` over all rows in the order of a numeric column without ties, in two levels: within ranges
    of about as many rows each, by a sketch of the order's quantiles, and over the few range totals."""
    cuts = sorted(set(df.stat.approxQuantile(order, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets)) or []))
    at = F.lit(0)
    for cut in cuts:
        at = at + (F.col(order) >= F.lit(cut)).cast("int")
    ranged = df.withColumn("_b", at)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_b").agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(out, F.sum(value).over(inside)).join(F.broadcast(sums), "_b").withColumn(out, F.col(out) + F.col("_before")).drop("_b", "_before")


def longest_runs(df: DataFrame, least: int, *, key: str = "ward", index: str = "idx") -> DataFrame:
    """Key, begin and length of the longest run of consecutive whole numbers; the earliest of equal ones; runs below `least` go."""
    islands = df.select(key, index).distinct().withColumn("_g", F.col(index) - F.row_number().over(_by(key, index)))
    runs = islands.groupBy(key, "_g").agg(F.min(index).alias("begin"), F.count(F.lit(1)).alias("length"))
    best = runs.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("length"), "begin"))).where("_rn = 1")
    return best.where(F.col("length") >= least).select(key, "begin", "length")


def validation_windows(df: DataFrame, encoder: int, horizon: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    """The last encoder + horizon rows of keys that have so many, with their part."""
    n, w = encoder + horizon, Window.partitionBy(key)
    ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(F.desc(date)))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("_rn") <= n) & (F.col("_n") >= n)).withColumn("part", F.when(F.col("_rn") <= horizon, "horizon").otherwise("encoder")).drop("_rn", "_n")


def encoder_windows(df: DataFrame, value: str, size: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    """The last `size` values of each key as an array, filled on the left with the first."""
    last = last_rows(df.select(key, date, value), size, key=key, date=date)
    rows = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(date, value))), lambda x: x[value]).alias("w"))
    return rows.select(key, F.concat(F.array_repeat(F.col("w")[0], size - F.size("w")), F.col("w")).alias("window"))


def sliding_windows(df: DataFrame, value: str, size: int, horizon: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    """For each full window: its first date, `size` inputs and the next `horizon` values."""
    w = _by(key, date)
    ahead = F.collect_list(value).over(w.rowsBetween(0, size + horizon - 1))
    found = df.select(key, date, ahead.alias("_v")).where(F.size("_v") == size + horizon)
    return found.select(key, date, F.slice("_v", 1, size).alias("inputs"), F.slice("_v", size + 1, horizon).alias("targets"))


def step_changes(df: DataFrame, value: str, out: str, *, order: str) -> DataFrame:
    """Change against the step before, for a table with one row a step (few rows: steps, not observations)."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.orderBy(order)))


def first_when(df: DataFrame, condition: Column, *, key: str, date: str, out: str = "first_date") -> DataFrame:
    return df.groupBy(key).agg(F.min(F.when(condition, F.col(date))).alias(out))


def volatility(df: DataFrame, values: list[str], *, key: str = "ward", date: str = "month") -> DataFrame:
    """Mean absolute first difference within each key, over all keys."""
    changes = df.select(*(F.abs(F.col(v) - F.lag(v).over(_by(key, date))).alias(v) for v in values))
    return changes.agg(*(F.avg(v).alias(f"{v}_volatility") for v in values))


def long_enough(df: DataFrame, least: int, *, key: str = "ward") -> DataFrame:
    enough = df.groupBy(key).count().where(F.col("count") >= least).select(key)
    return df.join(enough, key, "left_semi")


def month_spine(df: DataFrame, months: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    """The next `months` months after each key's last."""
    last = df.groupBy(key).agg(F.max(date).alias("_last"))
    return last.select(key, F.explode(F.sequence(F.add_months("_last", 1), F.add_months("_last", months), F.expr("interval 1 month"))).alias(date))


def cyclical(df: DataFrame, *, date: str = "month", phase: int = 0) -> DataFrame:
    angle = (F.month(date) - phase) * (2 * math.pi / 12)
    quarter = F.quarter(date) * (2 * math.pi / 4)
    return df.withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle), "quarter_sin": F.sin(quarter), "quarter_cos": F.cos(quarter), "monsoon": F.month(date).isin(6, 7, 8, 9).cast("int")})


def month_index(df: DataFrame, *, date: str = "month") -> DataFrame:
    """Months since January of the first year, also over the greatest."""
    first = df.agg(F.min(F.year(date)).alias("_y0")).withColumn("_one", F.lit(1))
    indexed = df.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one").withColumn("idx", (F.year(date) - F.col("_y0")) * 12 + F.month(date) - 1)
    top = indexed.agg(F.max("idx").alias("_top")).withColumn("_one", F.lit(1))
    return indexed.join(F.broadcast(top), "_one").withColumn("idx_norm", F.col("idx") / F.greatest("_top", F.lit(1))).drop("_y0", "_top", "_one")


def monthly_resample(df: DataFrame, value: str, *, date: str = "ts") -> DataFrame:
    """Sums by month, months between the first and the last without rows filled from before."""
    sums = df.groupBy(F.trunc(date, "MM").alias("month")).agg(F.sum(value).alias(value))
    ends = sums.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    joined = spine.join(sums, "month", "left")
    return joined.select("month", F.last(value, True).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)).alias(value))


def seasonal_repeat(df: DataFrame, value: str, months: int, *, key: str = "ward", date: str = "month") -> DataFrame:
    """Future months that repeat the values of the last 12 rows of each key in turn."""
    last = last_rows(df.select(key, date, value), 12, key=key, date=date)
    rows = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(date, value))).alias("w"))
    ahead = rows.select(key, "w", F.posexplode(F.sequence(F.lit(1), F.lit(months))).alias("i", "h"))
    return ahead.select(key, F.add_months(F.element_at("w", -1)[date], F.col("h")).alias(date), F.get("w", F.col("i") % F.size("w"))[value].alias(value))
