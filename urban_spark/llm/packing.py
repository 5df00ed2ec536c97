"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

What is planned is the histogram of lengths, which has at most `capacity` entries at any input size; documents then
take their places by their rank among those of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.llm.shared import cut

END = 1
#: Up to U+024F case, letters and numbers are as in any Unicode version, and nothing composes. Words beyond it, and those
#: with special strings or with characters that count as a digit or a blank in one library only, go to the tokenizer whole.
ODD = r"[^\x00-\x{24F}]|<\||[\x{AA}\x{B2}\x{B3}\x{B9}\x{BA}\x{BC}-\x{BE}\x1C-\x1F\x{85}\x{A0}]"
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+| ")
BLANK = re.compile(r"[ \t-\r]")
#: Stands for a blank among ids; an id's last byte is 0, so it is found at the border of two ids only.
MARK = b"\xff\xff\xff\xff"
CACHE, SEGMENT = 60_000, 1 << 20


class _Recent:
    """A cache of two generations: what was looked up since the last change of generations outlives the next."""

    def __init__(self, size: int = CACHE):
        self.size, self.new, self.old = size, {}, {}

    def look_up(self, keys: list[str], make) -> list[bytes]:
        """Values of the distinct `keys`; those not held come from make(list of keys)."""
        found = list(map(self.new.get, keys))
        lost = [i for i, value in enumerate(found) if value is None]
        if lost:
            names = [keys[i] for i in lost]
            held = list(map(self.old.get, names))
            made = iter(make([name for name, value in zip(names, held, strict=True) if value is None]))
            values = [next(made) if value is None else value for value in held]
            for i, value in zip(lost, values, strict=True):
                found[i] = value
            self.new.update(zip(names, values, strict=True))
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
        return found


class _Ids:
    """Words -> their ids as little-endian 32-bit integers. Words part at ASCII white space, which the tokenizer drops, so
    the ids of a text are those of its words in turn; within a word, those of its pre-tokens."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.stems = Tokenizer.from_file(path), _Recent(cache), _Recent(cache)
        # Byte-level spelling: printable bytes stand for themselves, the others for U+0100 and on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def of_stems(self, stems: list[str]) -> list[bytes]:
        if not stems:
            return []
        tokenize = self.tokenizer.model.tokenize
        spelled = " ".join(stems).encode().decode("latin-1").translate(self.spelling).split(self.spelling[32])
        found = [[t.id for t in tokenize(x)] for x in spelled]
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = [0, *accumulate(4 * len(ids) for ids in found)]
        return [flat[a:b] for a, b in pairwise(ends)]

    def of_plain(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        tokens = PRE_TOKEN.findall(" ".join(words).lower())
        names = list({*tokens} - {" "})
        stems = dict(zip(names, self.stems.look_up(names, self.of_stems), strict=True)) | {" ": MARK}
        return b"".join(map(stems.__getitem__, tokens)).split(MARK)

    def of_words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        odd = pc.match_substring_regex(pa.array(words, pa.string()), ODD).to_numpy(zero_copy_only=False).tolist()
        plain = iter(self.of_plain([w for w, o in zip(words, odd, strict=True) if not o]))
        whole = iter(self.tokenizer.encode_batch(list(compress(words, odd)), add_special_tokens=False))
        return [np.array(next(whole).ids, "<u4").tobytes() if o else next(plain) for o in odd]

    def of_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in turn, and how many each has."""
        lists = pc.ascii_split_whitespace(pa.array(segments, pa.string()))
        coded = lists.flatten().dictionary_encode()
        names, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        runs = self.words.look_up(names, self.of_words)
        each = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        table = np.frombuffer(b"".join(runs), "<u4")
        many = each[code]
        upto = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat((np.cumsum(each) - each)[code] - upto[:-1], many)
        at += np.arange(len(at))
        return table[at], np.diff(upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


_ids: dict[str | tuple[str, int], _Ids] = {}


def token_ids(texts: list[str | None], path: str, segment: int | None = None, cache: int = CACHE) -> list[np.ndarray]:
    """Ids of each text (null: empty) without special tokens, then END, as little-endian unsigned 32-bit integers. Long
    texts are taken by segments of about `segment` characters (SEGMENT) that end at white space."""
    segment = segment or SEGMENT
    key = path if cache == CACHE else (path, cache)
    ids = _ids.get(key) or _ids.setdefault(key, _Ids(path, cache))
    segments, owner = [], []
    for i, text in enumerate(texts):
        text, low = text or "", 0
        while low < len(text):
            blank = BLANK.search(text, low + segment) if len(text) - low > segment else None
            high = blank.start() if blank else len(text)
            segments.append(text[low:high])
            owner.append(i)
            low = high
    flat, sizes = ids.of_segments(segments)
    each = np.bincount(np.array(owner, np.int64), sizes, len(texts)).astype(np.int64)
    ends = np.cumsum(each + 1)
    out = np.full(len(flat) + len(texts), END, "<u4")
    held = np.ones(len(out), bool)
    held[ends - 1] = False
    out[held] = flat
    return np.split(out, ends[:-1]) if len(texts) else []


def _parts(batch: pa.RecordBatch, column: int, segment: int) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with about `segment` bytes of text, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + segment, side="right")))
        yield batch.slice(low, high - low)
        low = high


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, cache: int = CACHE) -> DataFrame:
    """(_row, id, piece, start, length, ids_crc32): documents as token runs, those beyond `capacity` cut every `capacity` ids. Tasks
    encode the distinct words of `segment` bytes at once and keep up to `cache` words of two generations: more is faster and takes memory."""
    kind = docs.schema[id_col].dataType

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2, segment):
                take, found = [], []
                for i, ids in enumerate(token_ids(part.column(2).to_pylist(), tokenizer_path, segment, cache)):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        run = ids[start : start + capacity]
                        take.append(i)
                        found.append((k, start, len(run), zlib.crc32(run)))
                columns = [part.column(c).take(pa.array(take, pa.int64())) for c in (0, 1)]
                columns += [pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(cuts, f"_row long, _id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all runs: (length, first rank, first sequence, runs of this length in each sequence, offset of the first).

    Runs of more than a third of the capacity go at most two to a sequence: each, longest first, is matched with the
    longest left that fits beside it. Shorter ones, longest first, go to the tightest gap that holds them, as many to
    a sequence as fit; where no gap does, to new sequences. Each length splits at most two groups of like sequences,
    and a sequence holds fewer than sqrt(2 * capacity) different lengths, so there are at most
    4 * capacity * sqrt(2 * capacity) places, whatever the number of documents.
    """
    places: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap -> [(first sequence, how many)]
    left = {n: c for n, c in histogram.items() if c}
    rank = dict.fromkeys(left, 0)
    opened = 0

    def put(n: int, first: int, each: int, many: int, offset: int) -> None:
        places.append((n, rank[n], first, each, offset))
        rank[n] += each * many
        left[n] -= each * many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] >= 1 + (m == n)), None)
            if mate is None:
                many, used = left[n], n
                put(n, opened, 1, many, 0)
            elif mate == n:
                many, used = left[n] // 2, 2 * n
                put(n, opened, 2, many, 0)
            else:
                many, used = min(left[n], left[mate]), n + mate
                put(n, opened, 1, many, 0)
                put(mate, opened, 1, many, n)
            gaps[capacity - used].append((opened, many))
            opened += many

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        gap = n
        while left[n]:
            while gap < capacity and not gaps[gap]:
                gap += 1
            each = gap // n
            if gap >= capacity:
                gap, each = capacity, capacity // n
                gaps[capacity].append((opened, -(-left[n] // each)))
                opened += -(-left[n] // each)
            first, many = gaps[gap].pop()
            full = min(many, left[n] // each)
            some = left[n] - full * each if full < many else 0  # fewer than `each`, in one more sequence
            if full:
                put(n, first, each, full, capacity - gap)
                gaps[gap - each * n].append((first, full))
            if some:
                put(n, first + full, some, 1, capacity - gap)
                gaps[gap - some * n].append((first + full, 1))
            if many > full + bool(some):
                gaps[gap].append((first + full + bool(some), many - full - bool(some)))
    return places


def best_fit_packing(pieces: DataFrame, *, capacity: int = 4096, per_bucket: int = 500_000) -> DataFrame:
    """`pieces` (cheap to read again: cut) with sequence_id and offset; offsets in a sequence have no gaps and start at 0.

    Needs columns _row, piece and length (1 to `capacity`); others stay. Ties in length go by _row and piece, repeated rows
    (same _row and piece) to places of their own, no rows to no places. Rows are ranked by length within hash buckets, so many that
    none has much more than `per_bucket` rows of the commonest length; bucket offsets come from the (length, bucket) counts.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows, buckets = plan(histogram, capacity), max(64, -(-max(histogram.values(), default=0) // per_bucket))
    keys = np.array([(n << 44) + r for n, r, *_ in rows] or [0], np.int64)
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], np.array(rows or [(0,) * 5], np.int64)[order]))

    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("length", "_bucket").count()
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_row", "piece")
    ranked = bucketed.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_at")).alias("_rank"))

    def placed(frames):
        starts_at, places = table.value
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["_rank"].to_numpy()
            found = places[np.searchsorted(starts_at, (length << 44) + rank, side="right") - 1]
            number = rank - found[:, 1]
            frame["sequence_id"] = found[:, 2] + number // np.maximum(found[:, 3], 1)
            frame["offset"] = found[:, 4] + number % np.maximum(found[:, 3], 1) * length
            yield frame.drop(columns="_rank")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(placed, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, cache: int = CACHE) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each run of tokens of each document.

    Null or empty text: the closing id alone, a run of length 1. Repeated rows and repeated or null ids: runs of their
    own. No rows: no rows. Ties in length go by row. Extra columns are not read. `segment` and `cache` as in token_pieces().
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity=capacity, id_col=id_col, text_col=text_col, segment=segment, cache=cache))
    packed = best_fit_packing(pieces, capacity=capacity)
    return packed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
