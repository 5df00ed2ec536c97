"""Travel over networks with several layers: one weighted graph, and an index for shortest paths between many nodes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urban_spark.operators.graph import _cut, shortest_paths
from urban_spark.operators.sizes import small

#: Nodes whose distances are closed as one dense block (8 MB) in a task.
CORE = 1_000
#: Sources and targets at most whose pairs a task sums at once, and targets of these whose distances it holds.
BLOCK, CHUNK = 4_096, 256


def multimodal_graph(layers: dict[str, tuple[DataFrame, float]], transfers: DataFrame | None = None) -> DataFrame:
    """(src, dst, minutes, mode) of an undirected graph, src < dst: layer -> (edges (src, dst, km), km/h), whose nodes are named `<layer>:<id>`, and `transfers`
    (src, dst, minutes) between such names. Of parallel edges the fastest stays (of equal ones the first mode); edges of no positive length go."""
    node = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    parts = [df.select(node(name, "src").alias("a"), node(name, "dst").alias("b"), (F.col("km") / speed * 60).alias("minutes"), F.lit(name).alias("mode")) for name, (df, speed) in layers.items()]
    if transfers is not None:
        parts.append(transfers.select(F.col("src").alias("a"), F.col("dst").alias("b"), "minutes", F.lit("transfer").alias("mode")))
    both = reduce(DataFrame.unionByName, parts).where("a <> b AND minutes > 0 AND NOT isnan(minutes)")
    best = both.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min(F.struct("minutes", "mode")).alias("m"))
    return best.select("src", "dst", "m.minutes", "m.mode")


def both_ways(edges: DataFrame, weight: str) -> DataFrame:
    """(src, dst, weight) each way."""
    one = edges.select("src", "dst", F.col(weight).cast("double").alias("weight"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


@dataclass
class RouteIndex:
    """Edges up to nodes that were taken out later, by the round that took out their lower end: `out` from it and `into` it; and the distances
    within the `core` that was left, which is `bounded` if it has no more nodes than asked for."""

    out: DataFrame
    into: DataFrame
    core: DataFrame
    rounds: int
    bounded: bool


def _least(df: DataFrame) -> DataFrame:
    return df.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def _closed(around: DataFrame) -> DataFrame:
    """(src, dst, weight) of all shortest ways, 0 from a node to itself, of a graph that has few enough nodes for one dense block."""

    def close(edges: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([edges["src"].to_numpy(), edges["dst"].to_numpy()]), return_inverse=True)
        far = np.full((len(names), len(names)), np.inf)
        np.minimum.at(far, (at[: len(edges)], at[len(edges) :]), edges["weight"].to_numpy())
        np.fill_diagonal(far, 0.0)
        for k in range(len(names)):
            np.minimum(far, far[:, k, None] + far[None, k, :], out=far)
        a, b = np.nonzero(np.isfinite(far))
        return pd.DataFrame({"src": names[a], "dst": names[b], "weight": far[a, b]})

    return around.groupBy(F.lit(0).alias("_one")).applyInPandas(close, around.schema)


def route_index(edges: DataFrame, *, core: int = 48, growth: float = 4.0) -> RouteIndex:
    """Index of directed `edges` (src, dst, weight), weights not negative, for distances(): nodes are taken out in rounds, each time those with
    fewer neighbours than any neighbour has (ties by hash), and ways through them become edges of their neighbours. About a third of a road
    network's nodes goes in the first rounds, fewer where what is left is dense; rounds grow as the logarithm of the nodes. It ends at `core` nodes, whose
    distances are closed as one block, or where the ways through would be more than `growth` times the edges there were at first; the distances
    within what is left are then computed by rounds.

    Meant for networks in the plane. A dense graph is all core: the index then holds the distances of all its pairs.
    """
    around = _cut(_least(edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))))
    if not around.where("NOT coalesce(weight >= 0 AND NOT isnan(weight), false)").isEmpty():
        raise ValueError("weights must not be negative")
    most, outs, intos, level = growth * max(around.count(), 1), [], [], 0
    while True:
        ways = around.select("src", "dst").unionByName(around.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        own = F.struct("n", F.xxhash64("src").alias("h"), "src")
        order = ways.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select(F.col("src").alias("dst"), own.alias("near"))
        ranked = ways.join(order, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near"))
        ranked = _cut(ranked.select("src", "n", (own < F.col("near")).alias("go")))
        nodes, through = ranked.agg(F.count(F.lit(1)), F.sum(F.when(F.col("go"), F.col("n") * F.col("n")))).first()
        if nodes <= core or (through or 0) > most:
            break
        gone = small(ranked.where("go").select("src"))
        up_ends, down_ends = gone.withColumn("up", F.lit(True)), gone.select(F.col("src").alias("dst"), F.lit(True).alias("down"))
        marked = _cut(around.join(up_ends, "src", "left").join(down_ends, "dst", "left"))
        up, down = marked.where("up").select("src", "dst", "weight"), marked.where("down").select("src", "dst", "weight")
        rest = marked.where("up IS NULL AND down IS NULL").select("src", "dst", "weight")
        first, then = down.select("src", F.col("dst").alias("_via"), F.col("weight").alias("_w")), up.select(F.col("src").alias("_via"), "dst", "weight")
        ways_through = first.join(then, "_via").where("src <> dst").select("src", "dst", (F.col("_w") + F.col("weight")).alias("weight"))
        outs.append(up.withColumn("level", F.lit(level)))
        intos.append(down.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight").withColumn("level", F.lit(level)))
        around, level = _cut(_least(rest.unionByName(ways_through))), level + 1
    if nodes <= core:
        within = _cut(_closed(around))
    else:
        left = around.select(F.col("src").alias("id")).unionByName(around.select(F.col("dst").alias("id"))).distinct()
        within = shortest_paths(around, left).select(F.col("source").alias("src"), F.col("id").alias("dst"), F.col("distance").alias("weight"))
    empty = around.limit(0).withColumn("level", F.lit(0))
    gather = lambda parts: _cut(reduce(DataFrame.unionByName, parts, empty))
    return RouteIndex(gather(outs), gather(intos), within, level, nodes <= core)


def _upwards(up: DataFrame, starts: DataFrame, rounds: int) -> DataFrame:
    """(source, id, distance) to all nodes above `starts` (id): the edges of each round once, from the lowest."""
    best = starts.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")).distinct()
    ways = _cut(up.groupBy("level", F.col("src").alias("id")).agg(F.collect_list(F.struct(F.col("dst").alias("id"), "weight")).alias("_to")))
    for level in range(rounds):
        # A row goes on itself and by its edges, so that each round reads the one before only once.
        joined = best.join(ways.where(F.col("level") == level).drop("level"), "id", "left")
        on = F.transform(F.coalesce("_to", F.array()), lambda e: F.struct(e["id"].alias("id"), (F.col("distance") + e["weight"]).alias("distance")))
        steps = joined.select("source", F.explode(F.concat(F.array(F.struct("id", "distance")), on)).alias("_s"))
        best = steps.groupBy("source", F.col("_s.id").alias("id")).agg(F.min("_s.distance").alias("distance"))
        if level % 4 == 3:
            best = _cut(best)
    return _cut(best)


def distances(index: RouteIndex, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, distance) for each pair of `sources` (id) and `targets` (id) with a way from one to the other: the least sum over
    the nodes above both, a join of two tables of labels. A source reaches itself at 0. The result is as large as the pairs asked for."""
    up = _upwards(index.out, sources, index.rounds)
    over = up.join(index.core.select(F.col("src").alias("id"), "dst", "weight"), "id").select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"))
    up = up.unionByName(over).groupBy("source", "id").agg(F.min("distance").alias("distance"))
    down = _upwards(index.into, targets, index.rounds).select(F.col("source").alias("target"), "id", F.col("distance").alias("_rest"))
    return up.join(small(down), "id").groupBy("source", "target").agg(F.min(F.col("distance") + F.col("_rest")).alias("distance"))


def _summed(core):
    """A function, for tasks, over rows that each hold the labels of a block of sources (`a`: of, id, distance) and of one of targets (`b`): (id, n, total) of the targets."""

    def by_node(of: np.ndarray, at: np.ndarray, far: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(size + 1))
        for k in range(size):
            part = order[ends[k] : ends[k + 1]]
            yield k, at[part], far[part]

    def labels(of, hub, far):
        """The nodes; and, of the labels in the core and of those below it, what node they are of (its place), their hub (its place in the core) and distance."""
        names, _ = core.value
        nodes, of = np.unique(of, return_inverse=True)
        at = np.minimum(np.searchsorted(names, hub), max(len(names) - 1, 0))
        inside = names[at] == hub if len(names) else np.zeros(len(hub), bool)
        return nodes, (of[inside], at[inside], far[inside]), (of[~inside], hub[~inside], far[~inside])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, close = core.value
        block = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.i != block:
                    sources, over, below = labels(row.a_of, row.a_id, row.a_distance)
                    size, block = len(sources), row.i
                    far = np.full((size, len(close)), np.inf)
                    for k, at, d in by_node(*over, size):
                        if len(at):
                            far[k] = (close[at] + d[:, None]).min(0)
                    far, order = np.ascontiguousarray(far.T), np.argsort(below[1], kind="stable")
                    low_of, low_id, low_far = (x[order] for x in below)
                targets, over, below = labels(row.b_of, row.b_id, row.b_distance)
                order = np.argsort(below[0], kind="stable")
                of, hub, rest = (x[order] for x in below)
                ways, n, total = by_node(*over, len(targets)), [], []
                for start in range(0, len(targets), CHUNK):
                    many = min(CHUNK, len(targets) - start)
                    best = np.full((many, size), np.inf)
                    for _ in range(many):
                        k, at, d = next(ways)
                        if len(at):
                            best[k - start] = (far[at] + d[:, None]).min(0)
                    a, b = np.searchsorted(of, (start, start + many))
                    first, last = np.searchsorted(low_id, hub[a:b]), np.searchsorted(low_id, hub[a:b], "right")
                    met = np.repeat(np.arange(a, b), last - first)
                    other = np.arange(len(met)) + np.repeat(first - np.cumsum(last - first) + (last - first), last - first)
                    np.minimum.at(best.reshape(-1), (of[met] - start) * size + low_of[other], low_far[other] + rest[met])
                    best[~(np.isfinite(best) & (best > 0))] = 0.0
                    n.append((best > 0).sum(1))
                    total.append(best.sum(1))
                yield pd.DataFrame({"id": targets, "n": np.concatenate(n), "total": np.concatenate(total)})

    return sums


def distance_sums(index: RouteIndex, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, n, total) for each of `targets` (id): how many of `sources` (id) have a way of some length to it, and the sum of the distances. As distances(), but
    pairs are met and summed block by block in tasks, each with the labels of BLOCK sources and BLOCK targets and the distances within the core; none is written.
    Time grows with the pairs, memory doesn't. Without a bounded core the pairs are made."""
    if not index.bounded:
        return distances(index, sources, targets).where("distance > 0").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total"))
    within = index.core.toPandas()  # bounded by the core, whatever the graph
    names, at = np.unique(np.concatenate([within["src"].to_numpy(), within["dst"].to_numpy()]), return_inverse=True)
    close = np.full((len(names), len(names)), np.inf)
    close[at[: len(within)], at[len(within) :]] = within["weight"].to_numpy()
    most = max(sources.count(), targets.count())
    blocks = max(1, math.ceil(most / min(BLOCK, max(64, math.ceil(most / 8)))))

    def packed(up: DataFrame, nodes: DataFrame, side: str, block: str) -> DataFrame:
        labels = _upwards(up, nodes, index.rounds).groupBy(F.pmod(F.xxhash64("source"), F.lit(blocks)).alias(block))
        rows = labels.agg(F.collect_list(F.struct("source", "id", "distance")).alias("_l"))
        return _cut(rows.select(block, *(F.col(f"_l.{c}").alias(f"{side}_{name}") for c, name in (("source", "of"), ("id", "id"), ("distance", "distance")))))

    a, b = packed(index.out, sources, "a", "i"), packed(index.into, targets, "b", "j")
    # A task takes a block of sources with about four blocks of targets.
    pairs = a.repartition(blocks, "i").hint("shuffle_replicate_nl").crossJoin(b.repartition(math.ceil(blocks / 4), "j"))
    shared = a.sparkSession.sparkContext.broadcast((names, close))
    found = pairs.mapInPandas(_summed(shared), f"id {b.schema['b_id'].dataType.elementType.simpleString()}, n long, total double")
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def travel_matrix(edges: DataFrame, places: DataFrame, snapped: DataFrame, *, key: str, fallback_speed: float = 30.0) -> DataFrame:
    """(src, dst, minutes) between all `places` (key, lon, lat), 0 to themselves: over the undirected `edges` (src, dst, minutes) from and to the
    node that `snapped` (key, node) has for each; where no way leads, or a place has no node, the degrees between them at 111 km and `fallback_speed`.
    Places are a stated set; the result is all pairs of them."""
    nodes = snapped.select(F.col("node").alias("id")).where("id IS NOT NULL").distinct()
    found = distances(route_index(both_ways(edges, "minutes"), core=CORE), nodes, nodes)
    at = places.select(F.col(key).alias("place"), "lon", "lat").join(snapped.select(F.col(key).alias("place"), "node"), "place", "left")
    a = at.select(F.col("place").alias("src"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.col("node").alias("_from"))
    b = at.select(F.col("place").alias("dst"), F.col("lon").alias("_u"), F.col("lat").alias("_v"), F.col("node").alias("_to"))
    pairs = a.join(small(_cut(b)))
    far = F.sqrt(F.pow(F.col("_x") - F.col("_u"), 2) + F.pow(F.col("_y") - F.col("_v"), 2)) * 111 / fallback_speed * 60
    joined = pairs.join(small(found.select(F.col("source").alias("_from"), F.col("target").alias("_to"), "distance")), ["_from", "_to"], "left")
    return joined.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.coalesce("distance", far)).alias("minutes"))
