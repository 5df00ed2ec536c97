"""Frequent phrases with a cohesion score, from a weighted de Bruijn graph of words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urban_spark.llm.shared import cut, small, written

#: Tabs to blanks, and what ends a piece to a line feed.
_TABLE = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" \n\n\n\n\n\n\n\n\n")
#: Rows of a batch and bytes of text that are held as words at once, codes that are summed before they leave a task, and distinct words.
ROWS, STRETCH, CODES, DISTINCT = 512, 1 << 21, 1 << 20, 200_000
#: Bits of the filters of frequent words and pairs, at most: 32 MB a filter.
FILTER_BITS = 1 << 28
#: Odd multipliers that mix the codes of a window.
_MIX = np.random.default_rng(5).integers(1 << 62, (1 << 63) - 1, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 32) - 1)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words in lower case with a line feed where a piece ends) for stretches of whole pieces."""
    for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if text:
                by.setdefault(lang, []).append(text.encode())
        for lang, texts in by.items():
            blob, at = b"\n".join(texts).lower().translate(_TABLE), 0
            while at < len(blob):
                end = len(blob) if at + STRETCH >= len(blob) else blob.find(b"\n", at + STRETCH) + 1 or len(blob)
                yield lang, [w for w in blob[at:end].replace(b"\n", b" \n ").split(b" ") if w] + [b"\n"]
                at = end


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, word, n); those of a null word are all words of the language."""

    def out() -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] if k[1] is None else k[1].decode() for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    seen: Counter = Counter()
    for lang, tokens in _tokens(batches):
        counts = Counter(tokens)
        del counts[b"\n"]
        for word, n in counts.items():
            seen[lang, word] += n
        seen[lang, None] += counts.total()
        if len(seen) > DISTINCT:
            yield out()
            seen = Counter()
    if seen:
        yield out()


class _Filter:
    """Set of 64-bit codes by their upper bits: never says no of a code that was put in."""

    def __init__(self, codes: DataFrame, rows: int):
        bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * rows).bit_length()))
        self.shift = 64 - (bits.bit_length() - 1)
        place = F.shiftrightunsigned("code", self.shift)
        slots = codes.select(F.shiftrightunsigned(place, 6).alias("slot"), F.expr("1L").alias("one"), place.alias("place"))
        slots = slots.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits")).toArrow()
        self.slots = np.zeros(bits >> 6, np.uint64)
        self.slots[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)

    def has(self, codes: np.ndarray) -> np.ndarray:
        place = codes >> np.uint64(self.shift)
        return (self.slots[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _code(attempt: int, lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{attempt}:"), lang), word)


def _coded(batches: Iterator[pa.RecordBatch], attempt: int, words: _Filter) -> Iterator[np.ndarray]:
    """The codes of each stretch, as _code() has them; 0 at the end of a piece and for words that are not frequent."""
    for lang, tokens in _tokens(batches):
        seed = xxhash.xxh64_intdigest(f"{attempt}:{lang}".encode(), 42)
        distinct = list(set(tokens))
        codes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))
        codes[~words.has(codes)] = 0
        known = dict(zip(distinct, codes.tolist(), strict=True))
        known[b"\n"] = 0
        yield np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def _pairs(codes: np.ndarray) -> np.ndarray:
    """A code for each word and the one after it; 0 where either is missing. Only its upper 32 bits differ, more than the filter of pairs
    takes, as what differs is what shuffles can't compress; pairs of one code are counted together, so that too many pass at worst."""
    both = (codes[:-1] * _MIX[0]) ^ (codes[1:] * _MIX[1])
    return np.where((codes[:-1] > 0) & (codes[1:] > 0), (((both ^ (both >> np.uint64(31))) * _MIX[2]) & ~_LOW) | np.uint64(1), 0)


def _sums(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their counts. Rows of one mixed value that differ only stay apart where they alternate."""
    order = np.argsort((columns * _MIX[: columns.shape[1]]).sum(axis=1, dtype=np.uint64), kind="stable")
    columns = columns[order]
    first = np.flatnonzero(np.concatenate([[True], (columns[1:] != columns[:-1]).any(axis=1)]))
    return columns[first], np.add.reduceat(counts[order], first)


def _gathered(parts: Iterator[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of uint64 columns as (names, n), summed in blocks."""
    held, rows = [], 0

    def out() -> pa.RecordBatch:
        block = np.concatenate(held)
        columns, n = _sums(block, np.ones(len(block), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(columns[:, i].view(np.int64)) for i in range(len(names))] + [pa.array(n)], [*names, "n"])

    for part in parts:
        held.append(part)
        rows += len(part)
        if rows * len(names) >= CODES:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def _windows(codes: np.ndarray, pairs: _Filter, longest: int) -> np.ndarray:
    """The `longest` words from each word on, with 0 behind the end of its piece. Pieces also end where a pair is not frequent."""
    rows = len(codes)
    codes = np.concatenate([codes, np.zeros(longest, np.uint64)])
    beside = _pairs(codes)
    whole = pairs.has(beside) & (beside > 0)
    out, going = np.zeros((rows, longest), np.uint64), np.ones(rows, bool)
    out[:, 0] = codes[:rows]
    for k in range(1, longest):
        going &= whole[k - 1 : k - 1 + rows]  # the words k - 1 and k of the window are in one piece
        out[:, k] = np.where(going, codes[k : k + rows], 0)
    return out[out[:, 0] > 0]


def _names(k: int) -> list[str]:
    return [f"_w{i}" for i in range(1, k + 1)]


def _key(k: int, start: int = 1) -> Column:
    return F.array(*[f"_w{i}" for i in range(start, start + k)])


def _graph(docs: DataFrame, *, text_col: str, lang_col: str, min_count: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n, code), a null word with all of its language, and edges (_w1 .. _w5, n): every window of `longest` words of
    the pieces that frequent words and pairs leave, padded with 0 behind a piece's end."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(counted, "phrase-words")
    frequent = words.where((F.col("n") >= min_count) & F.col("word").isNotNull())
    for attempt in range(16):
        code = _code(attempt, F.col("lang"), F.col("word"))
        coded = words.where("word IS NOT NULL").groupBy(code.alias("code")).count()
        if coded.where("count > 1 OR code = 0").isEmpty():
            break
    else:
        raise RuntimeError("words share codes")
    frequent = frequent.withColumn("code", code)
    send = docs.sparkSession.sparkContext.broadcast
    own = send(_Filter(frequent, frequent.count()))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (_pairs(codes) for codes in _coded(batches, attempt, own.value))
        yield from _gathered((p[p > 0].reshape(-1, 1) for p in pairs), ["code"])

    pairs = cut(texts.mapInArrow(beside, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("code"))
    both = send(_Filter(pairs, pairs.count()))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered((_windows(codes, both.value, longest) for codes in _coded(batches, attempt, own.value)), _names(longest))

    schema = ", ".join(f"{c} long" for c in [*_names(longest), "n"])
    total = texts.mapInArrow(edges, schema).groupBy(*_names(longest)).agg(F.sum("n").alias("n"))
    return words.where((F.col("n") >= min_count) | F.col("word").isNull()).withColumn("code", code), written(total, "phrase-edges")


def _flow(edges: DataFrame, longest: int, min_count: int) -> list[DataFrame]:
    """(key, f) of all phrases of 1, 2 .. `longest` words that occur `min_count` times: the longest are the edges, the nodes between
    them have the flow out of them, with what goes to the end of a piece, and shorter ones the flow of the nodes that begin with them."""
    full = lambda df, k: df.where((F.col(f"_w{k}") != 0) & (F.col("n") >= min_count)).select(_key(k).alias("key"), F.col("n").alias("f"))
    nodes = written(edges.groupBy(*_names(longest - 1)).agg(F.sum("n").alias("n")), "phrase-nodes")
    shorter = [nodes.groupBy(*_names(k)).agg(F.sum("n").alias("n")) for k in range(1, longest - 1)]
    return [cut(full(df, k)) for k, df in enumerate([*shorter, nodes, edges], 1)]


def _paths(edges: DataFrame, nodes: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Unary paths (path, f), whose edges all carry one count, and the nodes (key) inside them. A node is inside if one edge brings all its
    flow and one takes all of it, so nothing begins, ends or branches there; edges find the head of their path by doubling."""
    first, last = F.slice("key", 1, longest - 1), F.slice("key", 2, longest - 1)
    into = edges.select(last.alias("node"), F.col("key").alias("edge"), F.col("f").alias("f"))
    out = edges.select(first.alias("node"), F.col("key").alias("next"), F.col("f").alias("f"))
    through = nodes.select(F.col("key").alias("node"), "f")
    links = cut(into.join(through, ["node", "f"]).join(out, ["node", "f"]).select("node", "edge", "next"))
    ahead = cut(edges.select(F.col("key").alias("next")).join(links.select("next", "edge"), "next", "left").select(F.col("next").alias("edge"), F.coalesce("edge", "next").alias("head"), F.when(F.col("edge").isNotNull(), 1).otherwise(0).alias("at")))
    while True:
        jump = ahead.where("at > 0").select(F.col("edge").alias("head"), F.col("head").alias("_head"), F.col("at").alias("_at"))
        ahead = cut(ahead.join(jump, "head", "left").select("edge", F.coalesce("_head", "head").alias("head"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"), F.col("_at").isNotNull().alias("moved")))
        if ahead.where("moved").isEmpty():
            break
    tail = F.transform(F.array_sort(F.collect_list(F.struct("at", F.element_at("edge", -1).alias("w")))), lambda x: x["w"])
    path = ahead.join(edges.select(F.col("key").alias("edge"), "f"), "edge").groupBy("head").agg(tail.alias("tail"), F.max("f").alias("f"))
    return path.select(F.concat(F.slice("head", 1, longest - 1), "tail").alias("path"), "f"), links.select(F.col("node").alias("key"))


def _named(keyed: DataFrame, column: str, words: DataFrame, out: str) -> DataFrame:
    """`keyed` with the words of the codes in `column`, joined by blanks, as `out`; `keyed` has one row a value of `column`."""
    parts = keyed.select(column, F.posexplode(column).alias("_at", "code"))
    names = parts.join(words.where("word IS NOT NULL").select("code", "word"), "code").groupBy(column)
    return keyed.join(names.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]).alias("_words")), column).withColumn(out, F.array_join("_words", " ")).drop("_words")


def score_column() -> Column:
    """floor(1000 * a * n / (l * r)) of the columns a, n, l and r, by decimals of 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")


def repeated_passages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5) -> DataFrame:
    """(lang, passage, n_words, n): the compacted unary paths of the graph of collocations(): passages of `longest` words or more, within
    pieces, that occur `min_count` times and of which every window of `longest` words occurs as often. Cases as in collocations()."""
    words, edges = _graph(docs, text_col=text_col, lang_col=lang_col, min_count=min_count, longest=longest)
    counts = _flow(edges, longest, min_count)
    path, _ = _paths(counts[-1], counts[-2], longest)
    lang = small(cut(words.where("word IS NOT NULL").select("lang", "code")))
    named = _named(path, "path", words, "passage").withColumn("code", F.get("path", F.lit(0))).join(lang, "code")
    return named.select("lang", "passage", F.size("path").cast("long").alias("n_words"), F.col("f").alias("n"))


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, share: int = 100, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the first `top` phrases of 2 to `longest` words that occur `min_count` times.

    Texts are lower-cased in A-Z and split at `[.,;:!?\\n-\\r]` into pieces, these at blanks and tabs into words. All occurrences
    within pieces count (a); n are the language's words, l and r the occurrences of the two parts at the cut with the lowest score
    floor(1000 * a * n / (l * r)), the first such cut. Phrases inside a longer one with `share` percent of their count go.
    Order: score and a descending, phrase ascending.

    Words that are not frequent, and pairs, end pieces too: no frequent phrase holds them. What is left goes into a de Bruijn graph, whose
    nodes are `longest` - 1 words and whose edges are the windows of `longest`, summed in the tasks before the shuffle. Only edges are counted;
    counts of shorter phrases are sums of the flow through nodes, with the edges to the end of a piece. Unary paths are
    compacted, and the nodes inside them are no phrases of their own. Words are 64-bit codes, made anew in the case that two
    words of the corpus share one; filters of frequent words and pairs have a bounded size and let too much pass at worst.

    Null language: `und`. Null or empty text, or one of separators only: nothing. Repeated rows count each time. No rows, or
    no frequent phrase: no rows. Extra columns are not read. A piece without a separator is held whole in a task.
    """
    words, edges = _graph(docs, text_col=text_col, lang_col=lang_col, min_count=min_count, longest=longest)
    counts = _flow(edges, longest, min_count)
    _, inside = _paths(counts[-1], counts[-2], longest)
    nodes = counts[-2].join(inside, "key", "left_anti") if share <= 100 else counts[-2]
    phrases = reduce(DataFrame.unionByName, [*counts[1:-2], nodes, counts[-1]]).withColumnRenamed("f", "a")
    phrases = phrases if longest > 2 else counts[-1].withColumnRenamed("f", "a")
    part = lambda start, less: F.slice("key", start, F.size("key") - less)
    longer = reduce(DataFrame.unionByName, counts[2:]) if longest > 2 else counts[-1].limit(0)
    over = longer.select(F.explode(F.array(part(1, 1), part(2, 1))).alias("key"), "f").groupBy("key").agg(F.max("f").alias("over"))
    left = phrases.join(over, "key", "left").where(F.col("over").isNull() | (100 * F.col("over") < share * F.col("a"))).drop("over")
    totals = words.where("word IS NULL").select("lang", F.col("n").alias("n"))
    langs = small(cut(words.where("word IS NOT NULL").select("lang", "code").join(small(totals), "lang")))
    left = cut(left.withColumn("code", F.get("key", F.lit(0))).join(langs, "code").drop("code"))
    all_counts = reduce(DataFrame.unionByName, counts[:-1])
    cuts = left.select("key", "a", "n", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("key", F.lit(1), F.col("k"))).withColumn("rest", F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")))
    cuts = cuts.join(all_counts.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(all_counts.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    best = cuts.withColumn("score", score_column()).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = left.join(best, "key").select("key", "lang", "a", "n", "cut.l", "cut.r", "cut.score")
    named = _named(cut(scored), "key", words, "phrase").drop("key")
    return _first(named, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(phrases: DataFrame, top: int, deal: int = 64) -> DataFrame:
    """The first `top` of each language with their rank: those of `deal` parts first, so that no task sorts a whole language."""
    rank = lambda by: F.expr(f"CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, a DESC, phrase) AS BIGINT)")
    dealt = phrases.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(deal))).withColumn("rank", rank("lang, _deal")).where(F.col("rank") <= top)
    return dealt.drop("_deal", "rank").withColumn("rank", rank("lang")).where(F.col("rank") <= top)


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
), listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS words FROM pieces
), grams AS (
  SELECT lang, k, words[i : i + k - 1] AS key FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM listed, (SELECT unnest(range(1, 6)) AS k))
), counts AS (
  SELECT lang, k, key, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(words)) AS n FROM listed GROUP BY lang
), inner_parts AS (
  SELECT lang, key[1 : k - 1] AS key, f FROM counts WHERE k > 2 UNION ALL SELECT lang, key[2 : k] AS key, f FROM counts WHERE k > 2
), kept AS (
  SELECT c.lang, c.k, c.key, c.f AS a, t.n FROM counts c JOIN totals t USING (lang)
  LEFT JOIN (SELECT lang, key, max(f) AS over FROM inner_parts GROUP BY ALL) p ON p.lang = c.lang AND p.key = c.key WHERE c.k > 1 AND (over IS NULL OR over < c.f)
), cuts AS (
  SELECT q.lang, q.key, q.a, q.n, q.c, x.f AS l, y.f AS r, CAST((1000::HUGEINT * q.a * q.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept) q JOIN counts x ON x.lang = q.lang AND x.key = q.key[1 : q.c] JOIN counts y ON y.lang = q.lang AND y.key = q.key[q.c + 1 : q.k]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY score, c) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, array_to_string(key, ' ') AS phrase FROM best) QUALIFY rank <= 2000
"""
