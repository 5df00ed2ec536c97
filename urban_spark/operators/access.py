"""Access, demand, equity and investment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urban_spark.functions.geo import haversine_km
from urban_spark.operators.agg import gini, palma
from urban_spark.operators.graph import _cut
from urban_spark.operators.panel import exact_quantiles


#: Candidates that are broadcast at most.
MOST_CANDIDATES = 50_000
#: Columns of a matrix at most.
MOST_COLUMNS = 2_000


def travel_times(wards: DataFrame, candidates: DataFrame, *, ward: str, candidate: str, speed: float = 25.0, factor: float = 1.25) -> DataFrame:
    """(ward, candidate, travel_min) for every pair, which is what is asked for: the output is the product of both tables. The
    candidates, a stated set, are broadcast up to MOST_CANDIDATES of them; beyond, they are met block by block."""
    c = candidates.select(candidate, F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))
    if c.limit(MOST_CANDIDATES + 1).count() <= MOST_CANDIDATES:
        pairs = wards.join(F.broadcast(c))
    else:
        blocks = -(-c.count() // MOST_CANDIDATES)
        here = wards.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = here.join(c.withColumn("_b", F.pmod(F.xxhash64(candidate), F.lit(blocks)).cast("int")), "_b")
    return pairs.select(ward, candidate, (km * factor / speed * 60).alias("travel_min"))


def tiered_minutes(km: Column, detour: float = 1.2) -> Column:
    """Faster on longer ways: 20 km/h to 5 km, 30 to 15 km, 40 beyond."""
    way = km * detour
    return way / F.when(way <= 5, 20.0).when(way <= 15, 30.0).otherwise(40.0) * 60


def time_summary(df: DataFrame, minutes: str, keys: list[str] = ()) -> DataFrame:
    if not keys:
        return df.agg(F.avg(minutes).alias("mean")).crossJoin(F.broadcast(exact_quantiles(df, {"median": (minutes, 0.5), "p90": (minutes, 0.9)})))  # one row each
    return df.groupBy(*keys).agg(F.avg(minutes).alias("mean"), F.percentile(minutes, F.lit(0.5)).alias("median"), F.percentile(minutes, F.lit(0.9)).alias("p90"))


def facility_demand(df: DataFrame, population: str, people_each: dict[str, float]) -> DataFrame:
    return df.withColumns({f"need_{k}": F.ceil(F.col(population) / v) for k, v in people_each.items()})


def additional_needs(df: DataFrame, population: str, people_each: dict[str, float]) -> DataFrame:
    """Needs less what is there (columns `has_<type>`), 0 at least."""
    return df.withColumns({f"add_{k}": F.greatest(F.lit(0), F.ceil(F.col(population) / v) - F.coalesce(F.col(f"has_{k}"), F.lit(0))) for k, v in people_each.items()})


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks (is false or null)."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def travel_matrix(times: DataFrame, *, ward: str, candidate: str, minutes: str = "travel_min", prefix: str = "to_") -> DataFrame:
    """A row for each ward and a column `to_<candidate>` for each of at most MOST_COLUMNS candidates, in their order."""
    found = [r[0] for r in times.select(candidate).distinct().orderBy(candidate).limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} candidates")
    wide = times.groupBy(ward).pivot(candidate, found).agg(F.min(minutes))
    return wide.select(ward, *(F.col(f"`{k}`").alias(f"{prefix}{k}") for k in found))


def composite_access(times: DataFrame, weights: dict[str, float], *, ward: str, kind: str = "kind", minutes: str = "travel_min", missing: float = 999.0) -> DataFrame:
    """Least time to each kind of facility, `missing` where there is none of it, and the sum of these by weight."""
    near = times.groupBy(ward).pivot(kind, list(weights)).agg(F.min(minutes))
    near = near.withColumns({k: F.coalesce(F.col(k), F.lit(missing)) for k in weights})
    return near.withColumn("access", sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))


def income_from_density(density: Column, low: float = 0.2, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), 1 / F.ln(density + 2.718281828459045)))


def income_groups(df: DataFrame, income: str, access: str, share: float = 0.2) -> DataFrame:
    """group low / middle / high by the outer shares of income, and underserved: low with access time of the median or more."""
    cuts = exact_quantiles(df, {"_lo": (income, share), "_hi": (income, 1 - share), "_m": (access, 0.5)}).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(cuts), "_one")
    group = F.when(F.col(income) <= F.col("_lo"), "low").when(F.col(income) >= F.col("_hi"), "high").otherwise("middle")
    return joined.withColumn("group", group).withColumn("underserved", (F.col("group") == "low") & (F.col(access) >= F.col("_m"))).drop("_lo", "_hi", "_m", "_one")


def scorecard(df: DataFrame, access: str) -> DataFrame:
    """Spread, group means and gap of a table with `group`."""
    mean = lambda g: F.avg(F.when(F.col("group") == g, F.col(access)))
    return df.agg((F.max(access) - F.min(access)).alias("range"), mean("low").alias("mean_low"), mean("high").alias("mean_high"), (mean("low") - mean("high")).alias("gap"))


def before_and_after(df: DataFrame, before: str, after: str, order: str) -> DataFrame:
    """Two rows of `stage`, before and after a change of access times: those of scorecard(), Gini, and Palma by `order`."""

    df = _cut(df.select("group", before, after, order))

    def one(stage: str, access: str) -> DataFrame:
        cards = scorecard(df, access), gini(df, access).select("gini"), palma(df, access, order)
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), cards).select(F.lit(stage).alias("stage"), "*")  # one row each

    return one("before", before).unionByName(one("after", after))


def place_facilities(df: DataFrame, n: int, *, population: str, access: str, key: str) -> DataFrame:
    """The n underserved wards with the largest population times access time: the optimum if only their number is bounded."""
    return df.where("underserved").orderBy(F.desc(F.col(population) * F.col(access)), key).limit(n)


def suppress_close(df: DataFrame, pairs: DataFrame, *, key: str, size: str) -> DataFrame:
    """Without rows that are close (pairs src, dst) to a row that stays and is larger (ties: the lower key), as if the rows were
    taken one by one, the largest first: in each round those without a larger row near that is still open stay, and the
    open ones near them go, until none is open."""
    s = df.select(key, size)
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    joined = both.join(s.select(F.col(key).alias("src"), F.col(size).alias("_a")), "src").join(s.select(F.col(key).alias("dst"), F.col(size).alias("_b")), "dst")
    above = joined.where((F.col("_b") > F.col("_a")) | ((F.col("_b") == F.col("_a")) & (F.col("dst") < F.col("src")))).select("src", "dst").distinct()
    above, gone = _cut(above), None
    while not above.isEmpty():
        low, high = above.select(F.col("src").alias("id")).distinct(), above.select(F.col("dst").alias("id")).distinct()
        stay = high.join(low, "id", "left_anti")
        new = _cut(above.join(stay.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct())
        gone = new if gone is None else gone.unionByName(new)
        above = _cut(above.join(new.withColumnRenamed("id", "src"), "src", "left_anti").join(new.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return df if gone is None else df.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def suppress_near(df: DataFrame, *, key: str, size: str, km: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """suppress_close() for the rows at most `km` apart. Of rows at one place only the largest can stay, so that the others go before pairs are made.
    Rows without a size or a place are close to none and stay."""
    from urban_spark.operators.spatial import within_distance

    has = F.col(size).isNotNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull()
    placed = df.where(has).select(key, size, F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    most = placed.groupBy("lon", "lat").agg(F.max(size).alias("_most"))
    first = placed.join(most, ["lon", "lat"]).where(F.col(size) == F.col("_most")).groupBy("lon", "lat", size).agg(F.min(key).alias(key))
    first = _cut(first)
    stay = suppress_close(first, within_distance(first, key=key, km=km), key=key, size=size).select(key)
    return df.where(~has).unionByName(df.where(has).join(stay, key, "left_semi"))


def weighted_time_change(times: DataFrame, wards: DataFrame, *, ward: str, population: str, before: Column, after: Column) -> DataFrame:
    """Population-weighted least time of the facilities of one set, of the other, and the reduction in percent."""
    near = times.groupBy(ward).agg(F.min(F.when(before, F.col("travel_min"))).alias("_a"), F.min(F.when(after, F.col("travel_min"))).alias("_b"))
    p = F.col(population)
    means = near.join(wards.select(ward, population), ward).agg((F.sum(F.col("_a") * p) / F.sum(p)).alias("before"), (F.sum(F.col("_b") * p) / F.sum(p)).alias("after"))
    return means.withColumn("reduction_pct", (F.col("before") - F.col("after")) / F.col("before") * 100)


def gravity_by_time(times: DataFrame, people: DataFrame, *, key: str, population: str, factor: float = 1e-4) -> DataFrame:
    """`times` (src, dst, minutes) with the daily trips `demand`: both populations over the minutes and one, 0 from a place to itself."""
    of = lambda end, name: people.select(F.col(key).alias(end), F.col(population).cast("double").alias(name))
    both = times.join(of("src", "_a"), "src").join(of("dst", "_b"), "dst")
    demand = F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("_a") * F.col("_b") / (F.col("minutes") + 1) * factor)
    return both.withColumn("demand", demand).drop("_a", "_b")


def transit_extensions(
    demand: DataFrame, places: DataFrame, *, key: str, share: float = 0.2, shortest: float = 1.0, longest: float = 15.0, speed: float = 40.0, attracted: float = 1.2,
    cost_each_km: float = 150e6, most: int = 100,
) -> DataFrame:
    """(src, dst, km, saved_min, benefit, cost, bc_ratio), src < dst, the `most` best by ratio: lines between the `share` of pairs with the most trips both ways, if the places lie
    between `shortest` and `longest` km apart (degrees at 111 km), that save time against now. `demand`: src, dst, minutes, demand; minutes are the same both ways."""
    at = lambda end, x, y: places.select(F.col(key).alias(end), F.col("lon").alias(x), F.col("lat").alias(y))
    pair = demand.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("demand").alias("demand"), F.min("minutes").alias("minutes")).where("src < dst")
    pair = _cut(pair)
    kept = int(pair.count() * share)
    # The trips of the last pair that is taken, then ties by key.
    top = pair.orderBy(F.desc("demand"), "src", "dst").limit(kept)
    km = F.sqrt(F.pow(F.col("_x") - F.col("_u"), 2) + F.pow(F.col("_y") - F.col("_v"), 2)) * 111
    far = top.join(at("src", "_x", "_y"), "src").join(at("dst", "_u", "_v"), "dst").withColumn("km", km).where((F.col("km") > shortest) & (F.col("km") < longest))
    saved = F.greatest(F.lit(0.0), F.col("minutes") - F.col("km") / speed * 60)
    rows = far.withColumn("saved_min", saved).withColumn("benefit", F.col("demand") * attracted * F.col("saved_min") * 1000).withColumn("cost", F.col("km") * cost_each_km)
    rows = rows.withColumn("bc_ratio", F.col("benefit") / F.col("cost")).select("src", "dst", "km", "saved_min", "benefit", "cost", "bc_ratio")
    return rows.orderBy(F.desc("bc_ratio"), "src", "dst").limit(most)


def road_upgrades(
    edges: DataFrame, importance: DataFrame, demand: DataFrame, *, band: int = 5, faster: float = 0.2, cost_each_km: float = 5e6, lanes_added: int = 2, most_lanes: int = 8
) -> DataFrame:
    """(src, dst, importance, demand, saved_min, benefit, cost, bc_ratio) of each road (src, dst, km, minutes, lanes) with fewer than `most_lanes`: its `importance` (src, dst, betweenness) over all
    pairs of nodes, times the trips (`demand`: src, dst, demand) from the `band` whole numbers around one end to those around the other, times the minutes saved
    by a road `faster` by that share; over the cost of two more lanes. Nodes are whole numbers, neighbours in their order."""
    nodes = importance.select(F.col("src").alias("n")).union(importance.select("dst")).distinct().count()
    pairs = max(nodes * (nodes - 1) / 2, 1.0)
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    roads = edges.where(F.col("lanes") < most_lanes).select("src", "dst", "km", "minutes", low.alias("_a"), high.alias("_b"))
    share = importance.select(low.alias("_a"), high.alias("_b"), (F.col("betweenness") / pairs).alias("importance"))
    around = lambda end: F.explode(F.sequence(F.col(end) - band, F.col(end) + band))
    near = roads.withColumn("_i", around("src")).withColumn("_j", around("dst"))
    trips = near.join(demand.select(F.col("src").alias("_i"), F.col("dst").alias("_j"), "demand"), ["_i", "_j"]).groupBy("src", "dst").agg(F.sum("demand").alias("demand"))
    joined = roads.join(share, ["_a", "_b"], "left").join(trips, ["src", "dst"], "left").fillna(0.0, ["importance", "demand"]).withColumn("saved_min", F.col("minutes") * faster)
    joined = joined.withColumn("benefit", F.col("importance") * F.col("demand") * F.col("saved_min") * 1000).withColumn("cost", F.col("km") * cost_each_km * lanes_added)
    return joined.withColumn("bc_ratio", F.when(F.col("cost") > 0, F.col("benefit") / F.col("cost")).otherwise(0.0)).select("src", "dst", "importance", "demand", "saved_min", "benefit", "cost", "bc_ratio")


def cost_benefit(df: DataFrame, benefit: Column, cost: Column) -> DataFrame:
    """benefit, cost and their ratio; rows without a positive ratio go."""
    return df.withColumn("benefit", benefit).withColumn("cost", cost).withColumn("bc_ratio", F.when(F.col("cost") > 0, F.col("benefit") / F.col("cost"))).where("bc_ratio > 0")


def best_projects(df: DataFrame, n: int, *, key: str) -> DataFrame:
    return df.orderBy(F.desc("bc_ratio"), key).limit(n)


def within_budget(df: DataFrame, budget: float, *, key: str) -> DataFrame:
    """Projects (a short list: a catalogue of bounded length) in the order of their ratio, each taken if its cost still fits into
    the budget; `spent` is the sum after it."""
    one = df.agg(F.array_sort(F.collect_list(F.struct((-F.col("bc_ratio")).alias("o"), F.col(key).alias("k"), F.col("cost").cast("double").alias("c")))).alias("p"))
    fits = lambda a, x: a["spent"] + x["c"] <= budget
    none = F.array().cast(f"array<struct<k:{df.schema[key].dataType.simpleString()},spent:double>>")
    step = lambda a, x: F.when(fits(a, x), F.struct((a["spent"] + x["c"]).alias("spent"), F.concat(a["out"], F.array(F.struct(x["k"].alias("k"), (a["spent"] + x["c"]).alias("spent")))).alias("out"))).otherwise(a)
    taken = one.select(F.explode(F.aggregate("p", F.struct(F.lit(0.0).alias("spent"), none.alias("out")), step, lambda a: a["out"])).alias("t")).select(F.col("t.k").alias(key), "t.spent")
    return df.join(F.broadcast(taken), key)


def portfolio(df: DataFrame) -> DataFrame:
    """By type: number, cost, benefit, their ratio; and the minutes saved (column `saved_min`, if there is one)."""
    saved = [F.sum("saved_min").alias("saved_min")] if "saved_min" in df.columns else []
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("projects"), F.sum("cost").alias("cost"), F.sum("benefit").alias("benefit"), (F.sum("benefit") / F.sum("cost")).alias("bc_ratio"), *saved)
