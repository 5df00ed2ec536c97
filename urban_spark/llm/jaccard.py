"""Similarity join of documents on their sets of word n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urban_spark.llm.shared import cut, free, small

#: Documents and words that a block of one group holds on average at most.
BLOCK_DOCS, BLOCK_WORDS = 256, 400_000
#: Blocks of one bucket on one side of the join that pairs them, about.
PAIR_BLOCKS = 256


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes by which a pair at `threshold` meets in some
    band with probability `recall` at least."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes don't reach recall {recall} at {threshold}")
    return best


@lru_cache
def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def n_grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of each text in turn, where each text's begin (one more at the end), and the
    texts' numbers of words. Words are lower-cased runs without white space; a text of fewer than n words, but not
    none, has all of them as its one n-gram."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    held = np.array([w != "" for w in names], bool)[code] if len(code) else np.zeros(0, bool)
    hashes = _mix(pd.util.hash_array(names.astype(object), categorize=False))[code][held] if len(code) else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(held)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    words = np.diff(at)
    counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(at[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    factors = _odd(n, 1)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    grams = np.zeros(len(first), np.uint64)
    for k in range(n):
        grams += padded[first + k] * factors[k]
    for i in np.flatnonzero((words > 0) & (words < n)):
        own = hashes[at[i] : at[i + 1]]
        grams[starts[i]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return _mix(grams), starts, words


def signatures(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of texts that have an n-gram each: MinHash values by multiplication with odd
    numbers, `rows` of them folded into each band."""
    factors, weights = _odd(bands * rows, 2), _odd(rows, 3)
    out = np.zeros((len(starts) - 1, bands), np.uint64)
    low = 0
    while low < len(starts) - 1:  # as many texts as keep the product in the cache
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + 32_768, side="right")) - 1)
        part, cuts = grams[starts[low] : starts[high]], starts[low:high] - starts[low]
        product = np.empty_like(part)
        for b in range(bands):
            for r in range(rows):
                np.multiply(part, factors[b * rows + r], out=product)
                out[low:high, b] += np.minimum.reduceat(product, cuts) * weights[r]
        low = high
    return _mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(_id, _hash, node, words, bands): node is a 16-byte digest of the n-grams in turn, null where there is none."""
    kind = docs.schema["_id"].dataType

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                grams, starts, words = n_grams(part.column(2), n)
                some = np.flatnonzero(np.diff(starts))
                own = np.concatenate([starts[some], starts[-1:]])
                signed = signatures(grams, own, bands, rows).astype(np.int64, copy=False).view(np.int64)
                nodes: list = [None] * part.num_rows
                for i in some:
                    nodes[i] = blake2b(grams[starts[i] : starts[i + 1]].tobytes(), digest_size=16).digest()
                at_bands = np.concatenate([[0], np.cumsum(np.diff(starts) > 0)]) * bands
                lists = pa.ListArray.from_arrays(pa.array(at_bands, pa.int32()), pa.array(signed.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(words, pa.int64()), lists], ["_id", "_hash", "node", "words", "bands"])

    return docs.mapInArrow(sign, f"_id {kind.simpleString()}, _hash long, node binary, words long, bands array<long>")


def _linked(table: pa.Table, n: int, threshold: float) -> pa.Table:
    """Links of the documents of one unit: of all pairs in a block, or of those across its two blocks."""
    frame = pd.DataFrame({c: table.column(c).to_pylist() for c in ("node", "copies", "side")})
    first = np.flatnonzero(~frame["node"].duplicated().to_numpy())  # rows that repeat an id and its text
    frame, count = frame.iloc[first], len(first)
    grams, starts, _ = n_grams(table.column("_text").combine_chunks().take(pa.array(first)), n)
    sets = [np.unique(grams[starts[i] : starts[i + 1]]) for i in range(count)]
    sizes = np.array([len(s) for s in sets], np.float64)
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, column = np.repeat(np.arange(count), sizes.astype(np.int64))[shared], (np.cumsum(times > 1) - 1)[code[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    # Each product is a whole number below 2^24, exact in float32; the sums and the comparison need float64.
    common, width = np.zeros((count, count), np.float64), max(64, 4_000_000 // max(count, 1))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((count, min(width, int(column[-1]) + 1 - low)), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        common += has @ has.T
    alike = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(alike, False)
    side = frame["side"].to_numpy()
    if len(set(side.tolist())) > 1:
        alike &= side[:, None] != side[None, :]
    links = alike @ frame["copies"].to_numpy(np.int64)
    label = np.arange(count)
    while True:
        lower = np.minimum(label, np.where(alike, label[None, :], count).min(axis=1, initial=count))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    has_link = np.flatnonzero(links)
    nodes = frame["node"].to_numpy()
    return pa.table({"node": pa.array(nodes[has_link].tolist(), pa.binary()), "links": pa.array(links[has_link], pa.int64()), "root": pa.array(nodes[label[has_link]].tolist(), pa.binary())})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of `edges` (node, root): label is the least node of the connected component.

    Each round takes the least label among neighbours and then that label's own, so that paths halve, until none changes.
    """
    both = edges.where("node <> root").select("node", F.col("root").alias("other"))
    both = cut(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = cut(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = not step.where(F.col("old") != F.col("label")).isEmpty()
        labels = step.select("node", "label")
        if not changed:
            return labels


def _units(members: DataFrame, dealt: DataFrame) -> DataFrame:
    """(one, two): each pair of blocks that share a bucket, and each block with itself. A bucket of many blocks is joined
    with itself in so many parts that a task gets about PAIR_BLOCKS blocks on one side."""
    met = cut(members.select("node", "bucket").join(dealt, "node").select("bucket", "block").distinct())
    many = met.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCKS).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "parts")
    crowded = met.join(many, "bucket")
    part = F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")
    left = crowded.select("bucket", F.col("block").alias("one"), part.alias("part"))
    right = crowded.select("bucket", F.col("block").alias("two"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["bucket", "part"]).where("one < two").select("one", "two")
    return met.select(F.col("block").alias("one"), F.col("block").alias("two")).unionByName(pairs).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """What jaccard_classes() says of its input: (_id, _hash, node) for each row, node null where there is no word; and
    (node, first, copies, links, label) for each node, first being the row (no, id, hash) of it to keep, by id."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    signed = cut(_signed(docs, n, bands, rows))
    row = F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    whole = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("bands").alias("bands"))
    nodes = cut(whole)

    spread = nodes.select("node", "words", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("leader")).where("many > 1").select("bucket", "leader")
    members = cut(spread.join(shared, "bucket"))
    homes = cut(members.groupBy("node").agg(F.min("leader").alias("home"), F.first("words").alias("words")))
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("words") / BLOCK_WORDS)).alias("blocks"))
    dealt = cut(homes.join(small(cut(sizes)), "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block")))
    sides = _units(members, dealt).select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("side"))
    placed = dealt.join(sides, F.col("block") == F.col("side")).select("node", "one", "two", "side")
    wanted = cut(placed.join(nodes.select("node", "copies", F.col("first.id").alias("i"), F.col("first.hash").alias("h")), "node"))
    texts = docs.join(small(wanted), F.col("_id").eqNullSafe(F.col("i")) & (F.col("_hash") == F.col("h"))).select("one", "two", "side", "node", "copies", "_text")
    found = cut(texts.groupBy("one", "two").applyInArrow(lambda table: _linked(table, n, threshold), "node binary, links long, root binary"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select("node", "root"))
    linked = nodes.select("node", "first", "copies").join(links, "node", "left").join(labels, "node", "left")
    return signed.select("_id", "_hash", "node"), linked.select("node", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """`docs` with one row of each class of jaccard_classes(): the one with the least id (none last), then text hash.

    Rows that share an id but not a class are judged apart. Repeated rows: one stays. Null texts and texts without a
    word: every row stays. No rows: no rows. All columns stay as they are, whatever their names.
    """
    signed, linked = _classes(docs, id_col, text_col, n, threshold, recall)
    keep = linked.groupBy("label").agg(F.min("first").alias("keep"))
    rows = signed.where("node IS NOT NULL").groupBy("_id", "_hash", "node").agg(F.count(F.lit(1)).alias("many"))
    told = rows.join(linked.select("node", "label").join(keep, "label"), "node")
    kept = F.col("_id").eqNullSafe(F.col("keep.id")) & (F.col("_hash") == F.col("keep.hash"))
    key, ours, theirs, fate = free(docs.columns, "hash", "told_id", "told_hash", "kept")
    # Only rows that go, or that stand for equal ones, are told; the others need not be shuffled to meet them if these are few.
    told = small(cut(told.where(~kept | (F.col("many") > 1)).select(F.col("_id").alias(ours), F.col("_hash").alias(theirs), kept.alias(fate))))
    met = docs.withColumn(key, F.xxhash64(text_col)).join(told, F.col(id_col).eqNullSafe(F.col(ours)) & (F.col(key) == F.col(theirs)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = met.where(F.col(fate).isNull()).select(*names)
    if told.where(fate).isEmpty():
        return single
    repeated = met.where(F.col(fate)).dropDuplicates([ours, theirs]).select(*names)
    return single.unionAll(repeated)


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(id, class_id, n_links) for each row of `docs`.

    n_links: other rows whose set of word n-grams has Jaccard similarity `threshold` or more; class_id: the least id
    among all that links connect. Candidates are texts that share a MinHash band, with bands and rows chosen so that
    a pair at the threshold is one with probability `recall` at least; pairs are verified on their full sets.

    Rows with the same words in turn are one node, so copies make no pairs. Texts that share a bucket are dealt into
    blocks of about BLOCK_DOCS texts by the least node they meet; pairs of blocks that share a bucket are the units
    of work, each pair of texts in exactly one. A group of any size is so many units of bounded size, which send on
    sums of links and one edge a text, never pairs.

    Null texts and texts without a word: a class of their own, no links. Null ids: linked as others; such rows and
    classes have the least other id as class id, null if there is none. Rows that repeat an id and its text are
    copies. No rows: no rows. Extra columns are not read.
    """
    signed, linked = _classes(docs, id_col, text_col, n, threshold, recall)
    classes = linked.groupBy("label").agg(F.min("first.id").alias("class_id"))
    result = linked.join(classes, "label").select("node", "class_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"))
    full = signed.select("_id", "node").join(result, "node", "left")
    return full.select(F.col("_id").alias(id_col), F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
