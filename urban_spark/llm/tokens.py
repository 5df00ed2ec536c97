"""Token counts of whole texts without token ids.

The vocabulary of a piece model has white space only at the start of a piece and no line feed in any, so no merge
crosses the place before a run of spaces or beside a line feed. A text's count is therefore the sum over such
pre-tokens, each of which the library needs to see once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urban_spark.llm.shared import written

#: A run of spaces with the word behind it, or a word right after a line feed.
PRE_TOKEN = re.compile(r"[ ▁]+[^ ▁\n]*|[^ ▁\n]+")
#: The most frequent pre-tokens, no longer than HEAD_CHARS, that every task is sent: at most HEAD of them, at any input size.
HEAD, HEAD_CHARS = 1 << 18, 64
#: And of longer ones, so many of so many characters.
LONG, LONG_CHARS = 1_000, 16_384
_models: dict[str, object] = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def check_model(path: str) -> None:
    """Fails for a model whose counts are not sums over pre-tokens: one that changes texts before it splits them, or that has a
    piece with a space behind another character or with a line feed and anything else."""
    model = _model(path)
    odd = "ﬁ ²  Ａ e\u0301\t x \u00a0y  "
    if model.normalize(odd) != "▁" + odd.replace(" ", "▁"):
        raise ValueError(f"{path} normalises texts or drops blanks")
    for piece in (model.id_to_piece(i) for i in range(model.get_piece_size())):
        if "▁" in piece.lstrip("▁") or ("\n" in piece and piece != "\n"):
            raise ValueError(f"{path} has the piece {piece!r}")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without the line feeds, the leading dummy space included; none for an empty text."""
    return PRE_TOKEN.findall(" " + text) if text else []


def piece_counts(model_path: str, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token. The library puts a space before what it encodes: one of the pre-token's own, or one
    kept apart from it by a line feed and taken off again."""
    model = _model(model_path)
    own = [p[1:] if p[0] in " ▁" else "\n" + p for p in pieces]
    return [
        (len(ids) if p[0] in " ▁" else len(ids) - 2) if p not in (" ", "▁") else 1
        for p, ids in zip(pieces, model.encode(own, num_threads=1), strict=True)
    ]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of pre-tokens, given out whenever they have grown large."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    seen: Counter = Counter()
    for part in _slices(batches):
        for text in part.column(0).to_pylist():
            if text:
                seen.update(PRE_TOKEN.findall(" " + text))
        if len(seen) > 600_000:
            yield out()
            seen = Counter()
    if seen:
        yield out()


def _most_frequent(vocabulary: DataFrame) -> dict[str, int]:
    """Tokens of at most HEAD of the most frequent pre-tokens: all from the lowest frequency class that leaves no more."""
    short = vocabulary.where(F.length("piece") <= HEAD_CHARS).withColumn("_class", F.floor(8 * F.log2("n")).cast("int"))
    sizes, lowest, held = sorted(short.groupBy("_class").count().collect(), reverse=True), 1 << 30, 0
    for name, count in sizes:
        held += count
        if held > HEAD:
            break
        lowest = name
    # Long ones, such as rules of dashes, are few if frequent: the LONG most frequent, up to LONG_CHARS characters.
    long = vocabulary.where(F.length("piece").between(HEAD_CHARS + 1, LONG_CHARS)).orderBy(F.desc("n"), "piece").limit(LONG)
    top = short.where(F.col("_class") >= lowest).select("piece", "tokens").unionByName(long.select("piece", "tokens")).toArrow()
    return dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))


class _Known(dict):
    """Counts of the frequent pre-tokens; others are noted in `missed` and count as 0."""

    missed: list[str]

    def __missing__(self, piece: str) -> int:
        self.missed.append(piece)
        return 0


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of `docs`, by the piece model's own library.

    A first pass counts the distinct pre-tokens of the corpus; each is encoded once. A second pass takes per-document
    frequencies: those of the HEAD most frequent pre-tokens are summed in place against a broadcast of that fixed
    size, all rarer ones are joined by a shuffle on the pre-token.

    Models for which this sum isn't the library's count are an error (check_model). Null or empty text: 0 bytes, 0 tokens. Repeated rows and repeated or null ids: a row each. No rows: no rows.
    Extra columns are not read.
    """
    check_model(model_path)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 4096):
            counts = pa.array(piece_counts(model_path, part.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts], ["piece", "n", "tokens"])

    distinct = docs.select("_text").mapInArrow(_frequencies, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    vocabulary = written(distinct.mapInArrow(encoded, "piece string, n long, tokens long"), "pretokens")
    head = spark.sparkContext.broadcast(_most_frequent(vocabulary))

    kind = docs.schema["_id"].dataType

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(head.value)
        for part in _slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for i, (row, text) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                known.missed = []
                total = sum(map(known.__getitem__, pre_tokens(text or ""))) + (text or "").count("\n")
                rare = Counter(known.missed)
                # The row's own sum goes under a key that no pre-token has, so that it is no hot join key.
                rows[0] += [row] * (1 + len(rare))
                rows[1] += [i] + [None] * len(rare)
                rows[2] += [f"\n{row}", *rare]
                rows[3] += [total] + [0] * len(rare)
                rows[4] += [0, *rare.values()]
            own = pa.array(rows[1], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), part.column(1).take(own), part.column(3).take(own), *(pa.array(v, t) for v, t in zip(rows[2:], (pa.string(), pa.int64(), pa.int64()), strict=True))],
                ["_row", "_id", "n_bytes", "piece", "known", "times"],
            )

    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text", size)
    parts = rows.mapInArrow(summed, f"_row long, _id {kind.simpleString()}, n_bytes long, piece string, known long, times long")
    tokens = F.sum(F.col("known") + F.col("times") * F.coalesce("tokens", F.lit(0))).alias("n_tokens")
    totals = parts.join(vocabulary.select("piece", "tokens"), "piece", "left").groupBy("_row").agg(F.max("_id").alias(id_col), F.max("n_bytes").alias("n_bytes"), tokens)
    return totals.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
