"""Shortest paths from some nodes to all, and what goes over them. Nodes are taken out of the graph in rounds, ways through them become
edges; in the few that are left paths are followed source by source; then the nodes come back, round by round, each with its nearest ends."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.operators.graph import _cut
from urban_spark.operators.sizes import small

#: Nodes that are left at most, the sources among them; a task follows paths in these.
CORE = 1_000


@dataclass
class Condensed:
    """`into`: edges (id, end, weight, paths) to each node taken out, from what was left then, by `level`, and when the end was taken out; `made`: for each round the edges
    that were left and, of those equally short, what each was made of (a node `via`, or null: the edge itself); `core`: the edges of what is left; `sources` (n, id)."""

    into: DataFrame
    made: list[DataFrame]
    core: DataFrame
    sources: DataFrame


def condense(edges: DataFrame, sources: DataFrame, *, core: int = CORE, growth: float = 4.0) -> Condensed | None:
    """Directed `edges` (src, dst, weight) without all but `core` nodes, all `sources` (id) among these; edges count the shortest `paths` they stand for. Those with
    fewer neighbours than any neighbour has are taken out together (ties by hash), so rounds grow as the logarithm of the nodes. None where that doesn't do: more
    sources than half of `core`, or more ways through than `growth` times the edges there were at first."""
    one = edges.where("src <> dst").groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("weight"))
    around = _cut(one.withColumn("paths", F.lit(1.0)))
    ids = sources.select("id").distinct()
    if ids.limit(core // 2 + 1).count() > core // 2:
        return None
    numbered = _cut(ids.select((F.row_number().over(Window.orderBy("id")) - 1).alias("n"), F.col("id").cast(around.schema["src"].dataType).alias("id")))  # half of `core` at most
    stay = F.broadcast(numbered.select(F.col("id").alias("src"), F.lit(True).alias("stays")))
    most, intos, made = growth * max(around.count(), 1), [], []
    while True:
        ways = around.select("src", "dst").unionByName(around.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        own = F.struct("stays", "n", F.xxhash64("src").alias("h"), "src")
        order = ways.groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(stay, "src", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
        order = order.select("src", "n", own.alias("own"))
        near = ways.join(order.select(F.col("src").alias("dst"), F.col("own").alias("near")), "dst").groupBy("src").agg(F.min("near").alias("near"))
        ranked = _cut(order.join(near, "src").select("src", "n", (~F.col("own.stays") & (F.col("own") < F.col("near"))).alias("go")))
        nodes, go, through = ranked.agg(F.count(F.lit(1)), F.count_if("go"), F.sum(F.when(F.col("go"), F.col("n") * F.col("n")))).first()
        if nodes <= core:
            break
        if not go or through > most:
            return None
        gone = small(ranked.where("go").select("src"))
        marked = _cut(around.join(gone.withColumn("up", F.lit(True)), "src", "left").join(gone.select(F.col("src").alias("dst"), F.lit(True).alias("down")), "dst", "left"))
        up, down = marked.where("up"), marked.where("down")
        first, then = down.select("src", F.col("dst").alias("via"), F.col("weight").alias("_w"), F.col("paths").alias("_p")), up.select(F.col("src").alias("via"), "dst", "weight", "paths")
        ways_through = first.join(then, "via").where("src <> dst").select("src", "dst", "via", (F.col("_w") + F.col("weight")).alias("weight"), (F.col("_p") * F.col("paths")).alias("paths"))
        rest = marked.where("up IS NULL AND down IS NULL").select("src", "dst", F.lit(None).cast(around.schema["src"].dataType).alias("via"), "weight", "paths")
        w = Window.partitionBy("src", "dst")
        shortest = rest.unionByName(ways_through).withColumn("_best", F.min("weight").over(w)).where("weight = _best").drop("_best")
        intos.append(down.select(F.col("dst").alias("id"), F.col("src").alias("end"), "weight", "paths", F.lit(len(made)).alias("level")))
        made.append(_cut(shortest.withColumn("total", F.sum("paths").over(w))))
        around = made[-1].groupBy("src", "dst").agg(F.first("weight").alias("weight"), F.first("total").alias("paths"))
    into = reduce(DataFrame.unionByName, intos) if intos else around.limit(0).select(F.col("dst").alias("id"), F.col("src").alias("end"), "weight", "paths", F.lit(0).alias("level"))
    height = into.select(F.col("id").alias("end"), F.col("level").alias("end_level")).distinct()
    return Condensed(_cut(into.join(height, "end", "left").fillna(len(made), ["end_level"])), made, _cut(around), numbered)


def _core(c: Condensed):
    """For tasks, what is left: the ids of sources by n, and (neighbour, weight, paths) by node. Bounded by the core, whatever the graph."""
    edges, sources, out = c.core.toPandas(), c.sources.toPandas(), {}
    for a, b, w, p in zip(*(edges[x].tolist() for x in ("src", "dst", "weight", "paths")), strict=True):
        out.setdefault(a, []).append((b, w, p))
    return c.core.sparkSession.sparkContext.broadcast((dict(zip(sources["n"].tolist(), sources["id"].tolist(), strict=True)), out))


def _follower(core):
    """A function, for tasks, from a source's n to the nodes it reaches by distance, their distances, and the numbers of shortest paths to them."""

    def follow(n: int) -> tuple[list, dict, dict]:
        ids, out = core.value
        start = ids[n]
        far, many, order, done, heap = {start: 0.0}, {start: 1.0}, [], set(), [(0.0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            order.append(a)
            for b, w, p in out.get(a, ()):
                if b not in far or d + w < far[b]:
                    far[b], many[b] = d + w, 0.0
                    heapq.heappush(heap, (d + w, b))
                if d + w == far[b] and b not in done:
                    many[b] += many[a] * p
        return order, far, many

    return follow


def _spread(c: Condensed) -> DataFrame:
    spark = c.core.sparkSession
    return c.sources.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "n")


def settled(c: Condensed, core) -> tuple[DataFrame, list[DataFrame]]:
    """(id, far, many): distances and numbers of shortest paths from all sources to a node, a place each (inf: no way); and by level (id, end, end_level, at, share): for the
    sources `at` which the last edge of shortest paths to a node may come from `end`, the share of the paths that do."""
    kind, size, paths_from = c.core.schema["src"].dataType.simpleString(), c.sources.count(), _follower(core)

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n in frame["n"].tolist():
                order, far, many = paths_from(n)
                yield pd.DataFrame({"id": order, "n": n, "d": [far[a] for a in order], "p": [many[a] for a in order]})

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        far, many = np.full(size, np.inf), np.zeros(size)
        far[frame["n"]], many[frame["n"]] = frame["d"], frame["p"]
        return pd.DataFrame({"id": frame["id"].iloc[:1], "far": [far.tobytes()], "many": [many.tobytes()]})

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        far = np.stack([np.frombuffer(x) for x in frame["far"]]) + frame["weight"].to_numpy()[:, None]
        best = far.min(0)
        many = np.stack([np.frombuffer(x) for x in frame["many"]]) * frame["paths"].to_numpy()[:, None]
        many[(far != best) | np.isinf(best)] = 0.0
        total = many.sum(0)
        rows = [(None, None, best.tobytes(), total.tobytes())]
        for end, level, part in zip(frame["end"].tolist(), frame["end_level"].tolist(), many, strict=True):
            if len(at := np.nonzero(part)[0]):
                rows.append((end, level, at.astype("<i4").tobytes(), (part[at] / total[at]).tobytes()))
        out = pd.DataFrame(rows, columns=["end", "end_level", "a", "b"]).astype({"end": "object", "end_level": "Int32"})
        out.insert(0, "id", frame["id"].iloc[0])
        return out

    found = [_cut(_spread(c).mapInPandas(follow, f"id {kind}, n int, d double, p double").groupBy("id").applyInPandas(gather, f"id {kind}, far binary, many binary"))]
    parts = []
    for level in reversed(range(len(c.made))):
        ends = reduce(DataFrame.unionByName, found).withColumnRenamed("id", "end")
        joined = ends.join(small(c.into.where(F.col("level") == level).drop("level")), "end")
        step = _cut(joined.groupBy("id").applyInPandas(settle, f"id {kind}, end {kind}, end_level int, a binary, b binary"))
        found.append(step.where("end IS NULL").select("id", F.col("a").alias("far"), F.col("b").alias("many")))
        parts.append(step.where("end IS NOT NULL").select("id", "end", "end_level", F.col("a").alias("at"), F.col("b").alias("share")))
    return reduce(DataFrame.unionByName, found), parts[::-1]


def reach(found: DataFrame) -> DataFrame:
    """(id, n, total): how many sources have a way of some length to a node, and the sum of these lengths."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(x := np.frombuffer(far))[np.isfinite(x) & (x > 0)] for far in frame["far"]]
            yield pd.DataFrame({"id": frame["id"], "n": [len(x) for x in rows], "total": [float(x.sum()) for x in rows]})

    return found.select("id", "far").mapInPandas(sums, f"id {found.schema['id'].dataType.simpleString()}, n long, total double")


def flows(c: Condensed, core, parts: list[DataFrame]) -> DataFrame:
    """(src, dst, flow) of the directed edges: for each source and each node it reaches, the share of the shortest paths that go over the edge, summed. Nodes send what
    goes to and through them to their ends, from the first taken out on; then what goes over an edge goes to the edges it was made of, from the last made on."""
    kind, size, paths_from = c.core.schema["src"].dataType.simpleString(), c.sources.count(), _follower(core)

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("end")
        here, told = frame[frame["level"].notna()], frame[frame["level"].isna()]
        amount, ats = np.zeros(size), [np.frombuffer(x, "<i4") for x in here["at"]]
        for at in ats:
            amount[at] = 1.0
        for at, value in zip(told["at"], told["value"], strict=True):
            amount[np.frombuffer(at, "<i4")] += np.frombuffer(value)
        sent = [np.frombuffer(share) * amount[at] for at, share in zip(ats, here["value"], strict=True)]
        out = pd.DataFrame({"id": here["end"], "end": frame["id"].iloc[0], "to": here["level"], "at": here["at"], "value": [x.tobytes() for x in sent], "flow": [float(x.sum()) for x in sent]})
        return out

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, at, value in zip(frame["id"].tolist(), frame["at"], frame["value"], strict=True):
                yield pd.DataFrame({"n": np.frombuffer(at, "<i4"), "id": i, "value": np.frombuffer(value)})

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        order, far, many = paths_from(int(frame["n"].iloc[0]))
        frame = frame[frame["id"].notna()].sort_values(["id", "value"])
        amount, rows = dict.fromkeys(order, 1.0), []
        for i, value in zip(frame["id"].tolist(), frame["value"].tolist(), strict=True):
            amount[i] += value
        for a in reversed(order):
            for b, w, p in core.value[1].get(a, ()):
                if far[a] + w == far[b]:
                    part = many[a] * p / many[b] * amount[b]
                    amount[a] += part
                    rows.append((a, b, part))
        return pd.DataFrame(rows, columns=["src", "dst", "flow"])

    sends = []
    for level, part in enumerate(parts):
        rows = part.select("id", "end", F.col("end_level").alias("level"), "at", F.col("share").alias("value"))
        for earlier in sends:
            rows = rows.unionByName(earlier.where(F.col("to") == level).select("id", "end", F.lit(None).cast("int").alias("level"), "at", "value"))
        sends.append(_cut(rows.groupBy("id").applyInPandas(send, f"id {kind}, end {kind}, to int, at binary, value binary, flow double")))
    mine = _spread(c).select("n", F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("value"))
    for earlier in sends:
        mine = mine.unionByName(earlier.where(F.col("to") == len(parts)).select("id", "at", "value").mapInPandas(told, f"n int, id {kind}, value double"))
    over = mine.groupBy("n").applyInPandas(within, f"src {kind}, dst {kind}, flow double")
    over = _cut(over.groupBy("src", "dst").agg(F.sum("flow").alias("flow")))
    for level in reversed(range(len(parts))):
        pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
        steps = c.made[level].join(over, ["src", "dst"])
        steps = steps.select((F.col("flow") * F.col("paths") / F.col("total")).alias("flow"), F.explode(F.when(F.col("via").isNull(), F.array(pair("src", "dst"))).otherwise(F.array(pair("src", "via"), pair("via", "dst")))).alias("e"))
        steps = steps.select("e.src", "e.dst", "flow").unionByName(sends[level].select(F.col("id").alias("src"), F.col("end").alias("dst"), "flow"))
        over = steps.groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
        if level % 4 == 0:
            over = _cut(over)
    return over


def evened(edges: DataFrame) -> DataFrame:
    """Positive weights to the nearest multiple of a power of two so small that the sum of all has 52 bits: sums are then exact in any order, and equally long ways equal."""
    total = edges.agg(F.sum("weight")).first()[0]
    if not total or not math.isfinite(total):
        return edges
    step = 2.0 ** (math.ceil(math.log2(total)) - 52)
    return edges.withColumn("weight", F.greatest(F.rint(F.col("weight") / step), F.lit(1.0)) * step)


def loads(edges: DataFrame, sources: DataFrame, *, core: int = CORE) -> tuple[DataFrame, DataFrame] | None:
    """(src, dst, flow) as flows() and (id, n, total) as reach(), by positive weights; None as condense()."""
    c = condense(evened(edges), sources, core=core)
    if c is None:
        return None
    shared = _core(c)
    found, parts = settled(c, shared)
    return flows(c, shared, parts), reach(found)
