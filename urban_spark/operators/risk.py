"""Environmental and infrastructure severity, failures and their chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.operators.panel import ordered_fold
from urban_spark.operators.sizes import small

# Concentration steps (low, high) and the index steps they map to.
PM25_STEPS = [(0, 30, 0, 50), (30, 60, 50, 100), (60, 90, 100, 200), (90, 120, 200, 300), (120, 250, 300, 400), (250, 500, 400, 500)]
PM10_STEPS = [(0, 50, 0, 50), (50, 100, 50, 100), (100, 250, 100, 200), (250, 350, 200, 300), (350, 430, 300, 400), (430, 600, 400, 500)]
# Upper bounds of the air quality classes.
CATEGORIES = [(50, "Good"), (100, "Satisfactory"), (200, "Moderate"), (300, "Poor"), (400, "Very Poor")]


def sub_index(value: Column, steps: list[tuple]) -> Column:
    """Piecewise linear between the steps, the top index above the last, null below 0."""
    out = F.when(value < 0, F.lit(None).cast("double"))
    for low, high, i, j in steps:
        out = out.when(value <= high, i + (value - low) * (j - i) / (high - low))
    return out.when(value > steps[-1][1], F.lit(float(steps[-1][3])))


def aqi(pm25: Column, pm10: Column) -> Column:
    return F.greatest(sub_index(pm25, PM25_STEPS), sub_index(pm10, PM10_STEPS))


def aqi_category(index: Column) -> Column:
    out = F.when(index.isNull(), F.lit(None).cast("string"))
    for top, name in CATEGORIES:
        out = out.when(index <= top, name)
    return out.otherwise("Severe")


def severity_absolute(value: Column, threshold: Column) -> Column:
    """0 up to the threshold, then the excess over it as a share, 2 at most."""
    return F.when(value.isNull(), 0.0).when(threshold <= 0, 0.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), value / threshold - 1)))


def severity_relative(value: Column, baseline: Column, limit: Column, rise: bool = True) -> Column:
    """Relative change against the baseline in units of `limit`, from 0 to 2; a fall counts if not `rise`."""
    change = (value - baseline) / baseline * (1 if rise else -1)
    return F.when(value.isNull() | baseline.isNull() | (baseline == 0), 0.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), change / limit)))


def severity_label(severity: Column) -> Column:
    return F.when(severity <= 0, "healthy").when(severity < 0.5, "warning").when(severity < 1, "failure").otherwise("severe")


def apply_rules(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """A `sev_` column for each rule's column: {"threshold"} absolute, {"baseline", "limit", "rise"} relative."""
    out = {}
    for name, rule in rules.items():
        if name not in df.columns:
            out[f"sev_{name}"] = F.lit(0.0)
        elif "threshold" in rule:
            out[f"sev_{name}"] = severity_absolute(F.col(name), F.lit(float(rule["threshold"])))
        else:
            out[f"sev_{name}"] = severity_relative(F.col(name), F.col(rule["baseline"]), F.lit(float(rule["limit"])), rule.get("rise", True))
    return df.withColumns(out)


def latched_accumulator(df: DataFrame, value: str, *, keys: list[str], date: str, decay: float, limit: float) -> DataFrame:
    """Stress: what is left of it after `decay` plus each rise of `value`; `failed` from the first time it is above `limit` on."""

    def fold(values: list) -> tuple[list, list]:
        stresses, fails, last, stress, failed = [], [], None, 0.0, False
        for x in values:
            rise = 0.0 if x is None or last is None else max(0.0, float(x) - last)
            stress, last = stress * (1 - decay) + rise, None if x is None else float(x)
            failed = failed or stress > limit
            stresses.append(stress)
            fails.append(failed)
        return stresses, fails

    return ordered_fold(df, keys, date, value, fold, "stress double, failed boolean")


def collapse_curve(states: DataFrame, *, date: str = "date", failed: str = "failed", stress: str = "stress", ward: str = "ward") -> DataFrame:
    by_date = states.groupBy(date).agg(
        F.avg(F.col(failed).cast("double")).alias("fraction_failed"), F.count_distinct(F.when(F.col(failed), F.col(ward))).alias("wards_failed"), F.avg(stress).alias("mean_stress")
    )
    return by_date.withColumn("velocity", F.col("fraction_failed") - F.lag("fraction_failed").over(Window.orderBy(date)))


def failure_times(states: DataFrame, indicators: list[str], *, ward: str = "ward", indicator: str = "indicator", date: str = "date", failed: str = "failed") -> DataFrame:
    return states.groupBy(ward).pivot(indicator, indicators).agg(F.min(F.when(F.col(failed), F.col(date))))


def failure_sequences(states: DataFrame, edges: DataFrame, *, least: float = 0.05, ward: str = "ward", indicator: str = "indicator", step: str = "step", failed: str = "failed") -> DataFrame:
    """(ward, step, src, dst, weight): dst newly failed at a step, src on which it depends (weight above `least`) at the step before."""
    w = Window.partitionBy(ward, indicator).orderBy(step)
    before = F.coalesce(F.lag(failed).over(w), F.lit(False))
    marked = states.select(ward, indicator, step, failed, before.alias("_before"))
    new = marked.where(F.col(failed) & ~F.col("_before")).select(ward, F.col(step), F.col(indicator).alias("dst"))
    old = marked.where(failed).select(F.col(ward), (F.col(step) + 1).alias(step), F.col(indicator).alias("src"))
    strong = edges.where(F.col("weight") > least).select("src", "dst", "weight")
    return new.join(small(strong), "dst").join(old, [ward, step, "src"]).select(ward, step, "src", "dst", "weight")


def frequent_chains(sequences: DataFrame, least: int, *, ward: str = "ward") -> DataFrame:
    return sequences.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("frequency"), F.count_distinct(ward).alias("wards"), F.first("weight").alias("weight")).where(F.col("frequency") >= least)


def failure_probability(severities: list[Column]) -> Column:
    """1 - product of (1 - severity / 2), each severity from 0 to 2."""
    out = F.lit(1.0)
    for s in severities:
        out = out * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(s, F.lit(0.0)) / 2)))
    return 1 - out


def slope(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, slope): the greatest rise or fall to a neighbour over its distance; edges (src, dst, km), cells (cell, elevation). Neighbours at no
    distance have no slope and don't count."""
    at = cells.select(F.col("cell").alias("src"), F.col("elevation").alias("_a"))
    other = cells.select(F.col("cell").alias("dst"), F.col("elevation").alias("_b"))
    return edges.where("km > 0").join(at, "src").join(other, "dst").groupBy(F.col("src").alias("cell")).agg(F.max(F.abs(F.col("_a") - F.col("_b")) / (F.col("km") * 1000)).alias("slope"))


def flow_accumulation(edges: DataFrame, cells: DataFrame, passes: int = 3) -> DataFrame:
    """(cell, flow): from 1 each, in every pass a cell keeps 0.4 and its lowest neighbour, if that lies lower, gets 0.6."""
    other = cells.select(F.col("cell").alias("dst"), F.col("elevation").alias("_b"))
    low = edges.join(other, "dst").groupBy("src").agg(F.min(F.struct("_b", "dst")).alias("_low"))
    down = cells.join(low, cells["cell"] == low["src"], "left").select("cell", F.when(F.col("_low._b") < F.col("elevation"), F.col("_low.dst")).alias("to"))
    flow = cells.select("cell", F.lit(1.0).alias("flow"))
    for _ in range(passes):
        moved = flow.join(down, "cell")
        kept = moved.select("cell", F.when(F.col("to").isNull(), F.col("flow")).otherwise(0.4 * F.col("flow")).alias("flow"))
        sent = moved.where("to IS NOT NULL").select(F.col("to").alias("cell"), (0.6 * F.col("flow")).alias("flow"))
        flow = kept.unionByName(sent).groupBy("cell").agg(F.sum("flow").alias("flow"))
    return flow


def flood_risk(cells: DataFrame) -> DataFrame:
    """(cell, flood_risk) from elevation, flow and slope, each on 0..1 over all cells: low, wet and flat is 1."""
    from urban_spark.operators.agg import min_max

    scaled = min_max(cells.select("cell", "elevation", "flow", "slope"), ["elevation", "flow", "slope"])
    return scaled.select("cell", (0.5 * (1 - F.col("elevation")) + 0.3 * F.col("flow") + 0.2 * (1 - F.col("slope"))).alias("flood_risk"))


def ensemble_shares(states: DataFrame, by: str, *, over: str = "ward", run: str = "run", failed: str = "failed") -> DataFrame:
    """(by, share, failures): the share of all pairs of a run and a value of `over` that fail at each value of `by`: with by="month" the share of wards
    that fail at a date, with by="ward", over="month" a ward's mean probability. `states` has a row for each run, ward and date; missing ones did
    not fail."""
    sizes = states.agg(F.count_distinct(run).alias("_runs"), F.count_distinct(over).alias("_over")).withColumn("_one", F.lit(1))
    counts = states.groupBy(by).agg(F.sum(F.col(failed).cast("long")).alias("failures")).withColumn("_one", F.lit(1)).join(F.broadcast(sizes), "_one")
    return counts.select(by, (F.col("failures") / (F.col("_runs") * F.col("_over"))).alias("share"), "failures")
