"""Benchmark passages in training texts, found through a positional inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.llm.shared import cut, free, small, written

#: What parts words: everything in ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(word: Column) -> Column:
    """A-Z in lower case and nothing else; plain ASCII words take the short way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def _count(text: Column) -> Column:
    ends = F.when(text.rlike(f"^{GAP}"), 1).otherwise(0) + F.when(text.rlike(f"{GAP}\\z"), 1).otherwise(0)
    return F.when(text.isNull() | (text == "") | text.rlike(f"^{GAP}\\z"), 0).otherwise(F.size(F.split(text, GAP, -1)) - ends).cast("long")


def _words(rows: DataFrame, *keys: str) -> DataFrame:
    """A row (keys, pos, term) for each word of the column `text`; positions count from the first part, empty or not."""
    parts = rows.select(*keys, F.posexplode(F.split("text", GAP, -1)).alias("pos", "word")).where("word <> ''")
    return parts.select(*keys, "pos", F.xxhash64(_lower(F.col("word"))).alias("term"))


@dataclass(frozen=True)
class PositionalIndex:
    """`postings`: (doc, text_hash, pos, term, rank) of the training texts, for all terms that the test items have; each rank,
    the logarithm of a term's number of postings, is a folder with its terms in order, so that a look-up of rare terms
    reads no frequent ones. `frequencies`: (term, count, rank). `items`: (item, item_hash, pos, term, size), positions
    from 0. `documents`: (doc, text_hash, n_words)."""

    postings: DataFrame
    frequencies: DataFrame
    items: DataFrame
    documents: DataFrame
    id_col: str
    item_col: str


#: Postings of one rank that one key of the shuffle before they are written holds about.
PER_KEY = 50_000
#: Postings that a task sorts and writes, about, as long as there are no more than MOST_TASKS tasks.
PER_TASK, MOST_TASKS = 700_000, 20_000


def build_index(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", every_term: bool = False, clustered: bool = True) -> PositionalIndex:
    """Stores the postings in the shared folder, once, as Parquet. Terms that no item has can't take part in a match
    and get none, unless `every_term`, for an index that shall serve other items too: about half of all postings would never
    be looked up. The item vocabulary and the frequencies are broadcast if they are small, else joined by a shuffle.

    With `clustered` off postings stay in the order of the texts: no shuffle, but every look-up reads them all.

    Null texts and texts without a word have no postings. Repeated rows have theirs several times. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).alias("item"), F.xxhash64(text_col).alias("item_hash"), F.col(text_col).alias("text")).distinct()
    words = _words(tests, "item", "item_hash")
    item = Window.partitionBy("item", "item_hash")
    words = words.withColumn("pos", (F.row_number().over(item.orderBy("pos")) - 1).cast("int")).withColumn("size", F.count(F.lit(1)).over(item).cast("int"))
    words = cut(words)
    places = _words(rows, "doc", "text_hash")
    own = _words(rows) if every_term else _words(rows).join(small(words.select("term").distinct(), 1_000_000), "term", "left_semi")
    frequencies = cut(own.groupBy("term").agg(F.count(F.lit(1)).alias("count")).withColumn("rank", F.floor(F.log2("count")).cast("int")))
    # A hot term is many keys of the shuffle, by text.
    ranks = frequencies.groupBy("rank").agg(F.ceil(F.sum("count") / PER_KEY).alias("keys"))  # a row for each power of two
    ranked = places.join(small(frequencies.select("term", "rank"), 1_000_000), "term").join(F.broadcast(ranks), "rank")
    columns = ["doc", "text_hash", "pos", "term", "rank"]
    documents = rows.select("doc", "text_hash", _count(F.col("text")).alias("n_words"))
    if not clustered:
        return PositionalIndex(written(ranked.select(*columns), "postings"), frequencies, words, documents, id_col, item_col)
    tasks = (frequencies.agg(F.sum("count")).first()[0] or 0) // PER_TASK + 1
    tasks = min(MOST_TASKS, max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = ranked.repartition(tasks, "rank", F.pmod(F.xxhash64("term", "text_hash"), F.col("keys"))).select(*columns)
    postings = written(dealt.sortWithinPartitions("rank", "term", "doc", "pos"), "postings", "rank")
    return PositionalIndex(postings, frequencies, words, documents, id_col, item_col)


def _anchors(index: PositionalIndex, window: int) -> DataFrame:
    """(item, item_hash, p1, term1, p2, term2): for each window of an item its rarest and second rarest place, by the
    term's number of postings. A window with a term that has no posting occurs nowhere and has no row."""
    placed = index.items.join(small(index.frequencies), "term", "left").select("*", F.coalesce("count", F.lit(0)).alias("freq"))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - window + 1), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("size") - window))))
    windows = placed.select("item", "item_hash", starts.alias("start"), F.struct("freq", "pos", "term").alias("place")).groupBy("item", "item_hash", "start")
    # Of the places with the same term only the first counts: two lists of one term narrow less than those of two.
    rare = windows.agg(F.min("place.freq").alias("least"), F.sort_array(F.collect_list("place")).alias("p")).where("least > 0")
    first = F.col("p")[0]
    second = F.coalesce(F.get(F.filter("p", lambda x: x["term"] != first["term"]), F.lit(0)), F.get("p", F.lit(1)), first)
    pair = rare.select("item", "item_hash", first["pos"].alias("p1"), first["term"].alias("term1"), second["pos"].alias("p2"), second["term"].alias("term2"))
    return cut(pair.distinct())


def _lists(index: PositionalIndex, terms: DataFrame) -> DataFrame:
    """Postings of the ranks that the column `term` of `terms` has: at most 64 numbers go through the driver."""
    ranks = [r[0] for r in terms.join(index.frequencies, "term").select("rank").distinct().collect()]
    return index.postings.where(F.col("rank").isin(ranks)).drop("rank")


def _same_text(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def phrase_matches(index: PositionalIndex, *, window: int = 10) -> DataFrame:
    """(doc, text_hash, item, item_hash, pos): each word of a text inside an occurrence of `window` consecutive item
    words (of the whole item, if it has fewer). Exact up to equal 64-bit hashes of different words.

    The posting list of each window's rarest term gives the places where the item may lie, as the offset between text
    and item; the list of the second rarest, shifted by its own place in the item, narrows them; what is left is
    intersected with the shifted lists of all the item's terms, and runs of `window` hits are kept. Null and empty texts
    and items: no rows. Texts of any length; repeated rows of a text share theirs, each place once.
    """
    anchors = _anchors(index, window)
    lists = _lists(index, anchors.select(F.col("term1").alias("term")))
    first = lists.join(small(anchors), lists["term"] == anchors["term1"]).select("doc", "text_hash", "item", "item_hash", (F.col("pos") - F.col("p1")).alias("shift"), "p2", "term2")
    seconds = anchors.select(F.col("term2").alias("term")).distinct()
    other = _lists(index, seconds).join(small(seconds), "term", "left_semi")
    a, b = first.alias("a"), other.alias("b")
    both = a.join(b, _same_text("a", "b") & (F.col("b.term") == F.col("a.term2")) & (F.col("b.pos") == F.col("a.shift") + F.col("a.p2")), "left_semi")
    places = cut(both.select("doc", "text_hash", "item", "item_hash", "shift").distinct())

    texts = small(places.select(F.col("doc").alias("d"), F.col("text_hash").alias("h")).distinct())
    near = index.postings.drop("rank").join(texts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    wanted = places.join(small(index.items), ["item", "item_hash"]).select("doc", "text_hash", "item", "item_hash", "shift", "size", F.col("pos").alias("at"), "term", (F.col("shift") + F.col("pos")).alias("pos"))
    w, n = wanted.alias("w"), near.distinct().alias("n")
    hits = w.join(n, _same_text("w", "n") & (F.col("w.pos") == F.col("n.pos")) & (F.col("w.term") == F.col("n.term")), "left_semi")
    lying = Window.partitionBy("doc", "text_hash", "item", "item_hash", "shift")
    runs = hits.withColumn("run", F.col("at") - F.row_number().over(lying.orderBy("at")))
    whole = Window.partitionBy("doc", "text_hash", "item", "item_hash", "shift", "run")
    runs = runs.withColumn("length", F.count(F.lit(1)).over(whole)).where(F.col("length") >= F.least(F.lit(window), F.col("size")))
    return runs.select("doc", "text_hash", "item", "item_hash", "pos")


def _rare_places(index: PositionalIndex, window: int, least: int) -> DataFrame:
    """(item, item_hash, size, p, term): of each window of an item the places of the rarest terms, two more than may be
    missing in a match, so that two of them at least are in it. Terms without a posting count as the rarest."""
    placed = index.items.join(small(index.frequencies), "term", "left").select("*", F.coalesce("count", F.lit(0)).alias("freq"))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - window + 1), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("size") - window))))
    windows = placed.select("item", "item_hash", "size", starts.alias("start"), F.struct("freq", "pos", "term").alias("place")).groupBy("item", "item_hash", "size", "start")
    full = F.least(F.lit(window), F.col("size"))
    rare = windows.agg(F.sort_array(F.collect_list("place")).alias("places")).withColumn("many", F.least(full, full - F.least(F.lit(least), full) + 2))
    return cut(rare.select("item", "item_hash", "size", F.explode(F.slice("places", F.lit(1), F.col("many"))).alias("r")).select("item", "item_hash", "size", F.col("r.pos").alias("p"), F.col("r.term").alias("term")).distinct())


def proximity_matches(index: PositionalIndex, *, window: int = 10, slop: int = 3, least: int = 8) -> DataFrame:
    """(doc, text_hash, item, item_hash, terms): texts and items of which, with the item laid somewhere over the text, at
    least `least` terms of a window (all, if it has fewer) lie within `slop` words of where the item has them; terms is
    the most of a window. Positions in the text count empty parts at its ends as words. Exact up to equal hashes. Null and
    empty texts and items: no rows. Texts of any length; repeated rows of a text share theirs; ties of rarity go by place.

    Two of each window's rarest places are in any match, with shifts between text and item that differ by 2 * slop at
    most; where they are, all terms of the item are looked up around that shift and counted for each way to lay it.
    """
    lists, width = index.postings.drop("rank"), 2 * slop + 1
    rare = _rare_places(index, window, least)
    hits = _lists(index, rare).join(small(rare), "term").select("doc", "text_hash", "item", "item_hash", "size", "p", F.floor((F.col("pos") - F.col("p")) / width).alias("zone"))
    # A zone has the shifts of two neighbouring strips, so that any two that are near enough share one.
    zones = hits.distinct().withColumn("zone", F.explode(F.array(F.col("zone"), F.col("zone") + 1)))
    places = zones.groupBy("doc", "text_hash", "item", "item_hash", "size", "zone").agg(F.count_distinct("p").alias("n")).where(F.col("n") >= F.least(F.lit(2), F.lit(least), F.col("size")))
    places = cut(places.drop("n"))
    item = index.items.select(F.col("item").alias("i"), F.col("item_hash").alias("ih"), F.col("pos").alias("at"), "term")
    a = places.join(small(cut(item)), F.col("item").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih"))).drop("i", "ih").alias("a")
    b, shift = lists.alias("b"), F.col("b.pos") - F.col("a.at")
    found = a.join(b, _same_text("a", "b") & (F.col("a.term") == F.col("b.term")) & shift.between((F.col("a.zone") - 1) * width, (F.col("a.zone") + 1) * width - 1))
    laid = found.select("a.doc", "a.text_hash", "a.item", "a.item_hash", "a.size", "a.at", shift.alias("shift")).distinct()
    laid = laid.withColumn("shift", F.explode(F.sequence(F.col("shift") - slop, F.col("shift") + slop))).distinct()
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - window + 1), F.least(F.col("at"), F.greatest(F.lit(0), F.col("size") - window))))
    terms = laid.withColumn("start", starts).groupBy("doc", "text_hash", "item", "item_hash", "size", "shift", "start").agg(F.count(F.lit(1)).alias("terms"))
    terms = terms.where(F.col("terms") >= F.least(F.lit(least), F.col("size")))
    return terms.groupBy("doc", "text_hash", "item", "item_hash").agg(F.max("terms").alias("terms"))


def near_items(docs: DataFrame, items: DataFrame, *, window: int = 10, slop: int = 3, least: int = 8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, n_proximity, proximity_sha256) for each row of `docs`: number and digest of the items of proximity_matches()."""
    index = build_index(docs, items, id_col=id_col, item_col=item_col, text_col=text_col)
    found = proximity_matches(index, window=window, slop=slop, least=least)
    names = F.array_join(F.sort_array(F.collect_set(F.col("item").cast("string"))), ",")
    near = found.groupBy(F.col("doc").alias("d"), F.col("text_hash").alias("h")).agg(F.size(F.collect_set("item")).cast("long").alias("n"), names.alias("names"))
    joined = index.documents.join(near, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select(F.col("doc").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_proximity"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("proximity_sha256"))


def without_contaminated(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows in which a window of an item occurs. Cases as in decontaminate(): rows that share an id but
    not the text are judged each by its own. All columns stay as they are, whatever their names.

    The index is made for this one look-up, and not clustered: that would cost a shuffle of the postings."""
    index = build_index(docs, items, id_col=id_col, item_col=item_col, text_col=text_col, clustered=False)
    key, ours, theirs = free(docs.columns, "hash", "found_id", "found_hash")
    found = phrase_matches(index, window=window).select(F.col("doc").alias(ours), F.col("text_hash").alias(theirs)).distinct()
    kept = docs.withColumn(key, F.xxhash64(text_col)).join(small(cut(found)), F.col(id_col).eqNullSafe(F.col(ours)) & (F.col(key) == F.col(theirs)), "left_anti")
    return kept.drop(key)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of `docs`.

    Null texts and texts or items without a word match nothing. Rows that repeat an id and its text get the same
    result each; items that share an id count as one. No documents: no rows; no items: all clean. An item without an
    id shows in n_hit only. Extra columns are not read.
    """
    index = build_index(docs, items, id_col=id_col, item_col=item_col, text_col=text_col)
    found = phrase_matches(index, window=window)
    names = F.array_join(F.sort_array(F.collect_set(F.col("item").cast("string"))), ",")
    hit = found.groupBy(F.col("doc").alias("d"), F.col("text_hash").alias("h")).agg(F.size(F.collect_set("pos")).cast("long").alias("hits"), F.size(F.collect_set("item")).cast("long").alias("n"), names.alias("names"))
    joined = index.documents.join(hit, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select(
        F.col("doc").alias(id_col), "n_words", F.coalesce("hits", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("hits") > 0, F.lit(False)).alias("contaminated"),
    )


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, list_slice(ws, i, i + n - 1) AS win FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, i, list_slice(ws, i, i + n - 1) AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), m AS MATERIALIZED (SELECT r, i, dw.n, item_id FROM dw JOIN bw USING (n, win)
), hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r
), named AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
