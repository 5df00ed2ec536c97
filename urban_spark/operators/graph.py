"""Graphs as node and edge tables. Iterations cut their lineage in the shared folder and stop when nothing changes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where that is unset and all runs on this machine, one inside the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once, each of its partitions kept as it is in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as a table in the shared folder, whose size Spark then knows. A checkpoint keeps the size that was estimated for its plan: for
    a join the product of both sides, so that in a loop which joins its rows with themselves the digits of that number double every round and fill the driver.
    Values are written plainly, so that the files are about as large as the rows and no more than that is broadcast."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def property_graph(nodes: dict[str, tuple[DataFrame, str]], edges: dict[str, tuple[DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, props_json) and edges (src, dst, type, props_json) from tables: label -> (table, id column),
    type -> (table, source column, target column); all other columns are properties."""
    one = lambda df, keys: F.to_json(F.struct(*[c for c in df.columns if c not in keys])) if set(df.columns) - set(keys) else F.lit("{}")
    n = [df.select(F.col(k).cast("string").alias("id"), F.lit(label).alias("label"), one(df, [k]).alias("props_json")) for label, (df, k) in nodes.items()]
    e = [df.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), F.lit(kind).alias("type"), one(df, [a, b]).alias("props_json")) for kind, (df, a, b) in edges.items()]
    return reduce(DataFrame.unionByName, n), reduce(DataFrame.unionByName, e)


def undirected(edges: DataFrame) -> DataFrame:
    """Edges both ways without loops; of parallel ones the lightest."""
    w = [c for c in ("weight",) if c in edges.columns]
    both = edges.select("src", "dst", *w).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *w)).where("src <> dst")
    return both.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if w else both.distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): neighbours of each node, and their share of all others; isolated nodes have 0."""
    count = undirected(edges.select("src", "dst")).groupBy(F.col("src").alias("id")).count()
    total = nodes.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    joined = nodes.select("id").join(count, "id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return joined.select("id", F.coalesce("count", F.lit(0)).alias("degree"), (F.coalesce("count", F.lit(0)) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("centrality"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that edges connect a node with; labels take the least around and then that one's own,
    until none changes."""
    around = _cut(undirected(edges.select("src", "dst")))
    labels = _cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = around.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = _cut(lower.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = step.select("id", "component")
        if step.where("old <> component").isEmpty():
            return labels


def shortcuts(edges: DataFrame, growth: float) -> DataFrame:
    """`edges` (src, dst, weight) and the shortest ways of two, four, eight and so on of them, as long as there are at most
    `growth` times as many in all."""
    edges = _cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    out, most = edges, growth * edges.count()
    while True:
        a, b = out.select("src", F.col("dst").alias("_via"), F.col("weight").alias("_w")), out.select(F.col("src").alias("_via"), "dst", "weight")
        # How many ways of two there are is counted from the degrees before they are made.
        many = out.groupBy(F.col("dst").alias("k")).agg(F.count(F.lit(1)).alias("i")).join(out.groupBy(F.col("src").alias("k")).agg(F.count(F.lit(1)).alias("o")), "k")
        if (many.agg(F.sum(F.col("i") * F.col("o"))).collect()[0][0] or 0) > 8 * most:
            return out
        two = a.join(b, "_via").where("src <> dst").select("src", "dst", (F.col("_w") + F.col("weight")).alias("weight"))
        longer = _cut(out.unionByName(two).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
        count = longer.count()
        if count > most or count == out.count():
            return out
        out = longer


def shortest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000, *, growth: float = 0.0) -> DataFrame:
    """(source, id, distance) over edges (src, dst, weight), from each row of `sources` (id): every round relaxes the
    edges of the nodes that got nearer in the last. With a `growth` the edges are joined by shortcuts() first, so that
    long paths take fewer rounds; distances are then sums in another order."""
    if growth:
        edges = shortcuts(edges, growth)
    best = _cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")))
    front = best
    for _ in range(most_rounds):
        new = front.join(edges, front["id"] == edges["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("near"))
        step = _cut(best.join(new, ["source", "id"], "full").select("source", "id", F.col("distance").alias("old"), F.least(F.coalesce("distance", "near"), F.coalesce("near", "distance")).alias("distance")))
        best = step.select("source", "id", "distance")
        front = step.where(F.col("old").isNull() | (F.col("distance") < F.col("old"))).select("source", "id", "distance")
        if front.isEmpty():
            return best
    raise RuntimeError("paths did not settle")


def closeness(paths: DataFrame) -> DataFrame:
    """(id, closeness): one over the mean distance to the sources that reach a node, on 0..1 over all nodes."""
    return _closest(paths.where("distance > 0").groupBy("id").agg(F.avg("distance").alias("mean")))


def _closest(means: DataFrame) -> DataFrame:
    mean = means.select("id", (1 / F.col("mean")).alias("c"))
    ends = mean.agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).withColumn("_one", F.lit(1))
    joined = mean.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")
    return joined.select("id", F.when(F.col("_hi") > F.col("_lo"), (F.col("c") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0).alias("closeness"))


def closeness_from(edges: DataFrame, sources: DataFrame, *, core: int | None = None) -> DataFrame:
    """closeness() by the shortest paths over directed `edges` (src, dst, weight; not negative) from `sources` (id), which may be all nodes: through an index
    (`routes.route_index`, of `core` nodes), in rounds that grow as the logarithm of the nodes; distances are summed and not written."""
    from urban_spark.operators import routes

    index = routes.route_index(edges, core=core or routes.CORE)
    nodes = edges.select(F.col("dst").alias("id")).distinct()
    sums = routes.distance_sums(index, sources.select("id").distinct(), nodes)
    return _closest(_cut(sums.where("n > 0").select("id", (F.col("total") / F.col("n")).alias("mean"))))


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """(id, rank), adding up to 1; the rank of nodes without edges out is spread over all. With a tolerance the rounds
    end when the ranks change by less than it a node on average, and are an error if they don't."""
    n = nodes.count()
    out = _cut(edges.select("src", "dst").distinct().withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("src"))))
    sinks = nodes.select("id").join(out.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    ranks = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        lost = ranks.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_lost")).withColumn("_one", F.lit(1))
        sent = out.join(ranks, out["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("in"))
        joined = nodes.select("id").join(sent, "id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(lost), "_one")
        ranks = joined.select("id", ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + F.col("_lost") / n)).alias("rank"))
        if k % 4 == 3:
            new = _cut(ranks)
            if tolerance is not None and k > 3:
                change = new.join(old.withColumnRenamed("rank", "_old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).collect()[0][0]
                if (change or 0.0) < n * tolerance:
                    return new
            ranks = old = new
    if tolerance is not None:
        raise RuntimeError("ranks did not settle")
    return ranks


def _summed(parts: list[DataFrame], value: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("source", "id").agg(F.sum(value).alias(value))


def _along(front: DataFrame, steps: DataFrame, value: str, most_rounds: int) -> DataFrame:
    """(source, id, value): `front` and all that reaches a node from it over `steps` (source, from, to), which have no cycle."""
    parts = [front]
    for _ in range(most_rounds):
        new = front.withColumnRenamed("id", "from").join(steps, ["source", "from"]).groupBy("source", F.col("to").alias("id")).agg(F.sum(value).alias(value))
        front = _cut(new)
        if front.isEmpty():
            return _cut(_summed(parts, value))
        parts.append(front)
        if len(parts) > 20:
            parts = [_cut(_summed(parts, value))]
    raise RuntimeError("paths did not end")


def _around(edges: DataFrame, weight: str | None) -> DataFrame:
    """Undirected edges both ways, checked."""
    around = _cut(undirected(edges.select("src", "dst", (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"))))
    if not around.where("NOT coalesce(weight > 0 AND NOT isnan(weight), false)").isEmpty():
        raise ValueError("weights must be positive")
    return around


def _shares(around: DataFrame, sources: DataFrame, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The steps (source, up, id) of all shortest paths, and (source, id, paths, part) by node: the number of shortest paths from
    the source, and the dependencies on the node's followers for each of these paths."""
    best = shortest_paths(around, sources, most_rounds)
    ends = best.select("source", F.col("id").alias("dst"), F.col("distance").alias("_far"))
    steps = best.join(around, best["id"] == around["src"]).join(ends, ["source", "dst"]).where("distance + weight = _far")
    steps = _cut(steps.select("source", F.col("src").alias("up"), F.col("dst").alias("id")))
    start = sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths"))
    paths = _along(start, steps.select("source", F.col("up").alias("from"), F.col("id").alias("to")), "paths", most_rounds)
    back = _along(paths.select("source", "id", (1 / F.col("paths")).alias("part")), steps.select("source", F.col("id").alias("from"), F.col("up").alias("to")), "part", most_rounds)
    return steps, _cut(paths.join(back, ["source", "id"]))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame, most_rounds: int | None = None, *, weight: str | None = None, **options) -> DataFrame:
    """(id, betweenness): shortest paths from `sources` (id), by the sum of the positive `weight` or else the number of
    edges, that pass through a node, each source's paths to a target counting 1 in all. Through condense, in rounds that grow as
    the logarithm of the nodes; with `most_rounds`, or where that doesn't do (`condense.condense`), by a round for each edge of the
    longest path: path counts outwards, dependencies back, until no path goes on, or an error at `most_rounds`."""
    from urban_spark.operators import condense

    around = _around(edges, weight)
    found = condense.loads(around, sources, **options) if most_rounds is None else None
    if found is None:
        _, shares = _shares(around, sources, most_rounds or 10_000)
        sums = shares.where("source <> id").groupBy("id").agg(F.sum(F.col("paths") * F.col("part") - 1).alias("betweenness"))
    else:
        over, reached = found
        # What comes in goes on or ends here.
        came = over.groupBy(F.col("dst").alias("id")).agg(F.sum("flow").alias("_in"))
        sums = came.join(reached, "id").select("id", F.greatest(F.col("_in") - F.col("n"), F.lit(0.0)).alias("betweenness"))
    return nodes.select("id").join(sums, "id", "left").fillna(0.0, ["betweenness"])


def edge_betweenness(edges: DataFrame, sources: DataFrame, most_rounds: int | None = None, *, weight: str | None = None, **options) -> DataFrame:
    """(src, dst, betweenness) of each undirected edge, src < dst: as betweenness(), for the paths that go over the edge."""
    from urban_spark.operators import condense

    around = _around(edges, weight)
    found = condense.loads(around, sources, **options) if most_rounds is None else None
    if found is None:
        steps, shares = _shares(around, sources, most_rounds or 10_000)
        up = shares.select("source", F.col("id").alias("up"), F.col("paths").alias("_paths"))
        over = steps.join(shares.select("source", "id", "part"), ["source", "id"]).join(up, ["source", "up"])
        over = over.select(F.col("up").alias("src"), F.col("id").alias("dst"), (F.col("_paths") * F.col("part")).alias("flow"))
    else:
        over = found[0]
    sums = over.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("flow").alias("betweenness"))
    return around.where("src < dst").select("src", "dst").join(sums, ["src", "dst"], "left").fillna(0.0, ["betweenness"])


def source_count(nodes: int) -> int:
    """How many sources stand for all nodes: a tenth, from 10 to 400."""
    return min(400, max(10, nodes // 10))


def edge_means(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("src"), F.col(value).alias("_a")), nodes.select(F.col("id").alias("dst"), F.col(value).alias("_b"))
    return edges.join(a, "src").join(b, "dst").withColumn(value, (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def normalized_weights(edges: DataFrame) -> DataFrame:
    """Edges with weights over the sum of the absolute weights into each dst."""
    total = F.sum(F.abs("weight")).over(Window.partitionBy("dst"))
    return edges.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(0.0))


def spectral_radius(edges: DataFrame, rounds: int = 50, tolerance: float | None = None) -> float:
    """Absolute dominant eigenvalue of the weight matrix, by the growth of a vector over the last half of the rounds. With
    a tolerance the rounds end when the last five grew alike but for this share, and are an error if they don't."""
    edges = _cut(edges.select("src", "dst", "weight"))  # every round reads them
    nodes = _cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    x, logs = nodes.withColumn("v", F.lit(1.0)), []
    for _ in range(rounds):
        y = edges.join(x, edges["src"] == x["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
        y = _cut(nodes.join(y, "id", "left").fillna(0.0, ["v"]))
        norm = y.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).collect()[0][0]
        if not norm:
            return 0.0
        logs.append(norm)
        if tolerance is not None and len(logs) > 5 and max(logs[-5:]) - min(logs[-5:]) <= tolerance * norm:
            return norm
        x = y.select("id", (F.col("v") / norm).alias("v"))
    if tolerance is not None:
        raise RuntimeError("growth did not settle")
    import math

    half = logs[len(logs) // 2 :]
    return math.exp(sum(map(math.log, half)) / len(half))


def gravity(pairs: DataFrame, origin: str, destination: str, distance: str, *, k: float = 1.0, power: float = 2.0) -> DataFrame:
    return pairs.withColumn("demand", k * F.col(origin) * F.col(destination) / F.pow(F.greatest(F.col(distance), F.lit(0.1)), power))


def chain_transitions(chains: DataFrame, column: str, weight: str) -> DataFrame:
    """(src, dst, n, share): steps of chains written a>b>c, weighted, and each step's share of those from its src."""
    parts = F.split(column, ">")
    steps = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts) - 1), lambda a, b: F.struct(F.trim(a).alias("src"), F.trim(b).alias("dst")))
    rows = chains.select(F.explode(F.when(F.size(parts) > 1, steps)).alias("s"), F.col(weight).alias("w")).groupBy("s.src", "s.dst").agg(F.sum("w").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("src")))
