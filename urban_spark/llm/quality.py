"""A text classifier on averaged subword vectors, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of words and of their letter n-grams; the last two stand for a word that repeats the one before and for a text's end.
WORDS, GRAMS = 1 << 16, 1 << 17
ORDERS = (3, 4, 5)
SIZE = WORDS + GRAMS + 2
#: Labelled rows that training uses at most.
SAMPLE = 4_000


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word in turn, and where each text begins (one more at the end)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    names, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
    held = np.array([w != "" for w in names], bool)[code] if len(code) else np.zeros(0, bool)
    at = np.concatenate([[0], np.cumsum(held)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return names, code[held], at


def features(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its n-grams of letters (bytes, with `<` and `>` around), and their words' numbers."""
    own = (pd.util.hash_array(names.astype(object), categorize=False) % np.uint64(WORDS)).astype(np.int64)
    coded = [b"<%b>" % w.encode("utf-8", "replace") for w in names]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) for w in coded], np.int64)
    word = np.repeat(np.arange(len(coded)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    buckets, words = [own], [np.arange(len(own))]
    rolled = np.zeros(len(data), np.uint64)
    for k in range(min(max(ORDERS), len(data))):
        rolled[: len(data) - k] = rolled[: len(data) - k] * np.uint64(0x100000001B3) + data[k:] + np.uint64(1)
        if k + 1 in ORDERS:
            some = np.flatnonzero(left > k)
            mixed = (rolled[some] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - 17)).astype(np.int64) + WORDS)
            words.append(word[some])
    return np.concatenate(buckets), np.concatenate(words)


@dataclass(frozen=True)
class Model:
    """What softmax over two classes needs of each bucket: the difference of its two scores; and that of the biases."""

    scores: np.ndarray
    bias: float


def examples(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares of all it has; at most SIZE of them, whatever its length."""
    names, code, at = _words(texts)
    buckets, word = features(names)
    order = np.argsort(word, kind="stable")
    buckets, begin = buckets[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(names)))])
    rows = []
    for i in range(len(at) - 1):
        own = code[at[i] : at[i + 1]]
        distinct, times = np.unique(own, return_counts=True)
        spans = begin[distinct + 1] - begin[distinct]
        places = np.repeat(begin[distinct] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        again = int((own[1:] == own[:-1]).sum())
        ids = np.concatenate([buckets[places], [SIZE - 2, SIZE - 1]]).astype(np.int64)
        counts = np.concatenate([np.repeat(times, spans), [again, 1]]).astype(np.float64)
        ids, inverse = np.unique(ids, return_inverse=True)
        sums = np.bincount(inverse, counts)
        rows.append((ids, (sums / sums.sum()).astype(np.float32)))
    return rows


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], *, dims: int = 12, epochs: int = 6, rate: float = 0.4, seed: int = 7) -> Model:
    """Bucket vectors, averaged over a text's examples(), and a softmax layer over two classes, by stochastic gradient descent."""
    random = np.random.default_rng(seed)
    table = ((random.random((SIZE, dims)) - 0.5) / dims).astype(np.float32)
    out, bias = np.zeros((2, dims), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            ids, weights = rows[i]
            hidden = weights @ table[ids]
            logits = out @ hidden + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            step = np.float32(rate * (1 - done / steps))
            done += 1
            back = chance @ out
            out -= step * np.outer(chance, hidden)
            bias -= step * np.float32(0.1) * chance
            # Each bucket's share of the average is small; scaled by the number of buckets, the step is that of a mean.
            table[ids] -= (step * np.float32(len(ids)) * np.minimum(weights, 0.05))[:, None] * back
    return Model((table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    names, code, at = _words(texts)
    counts = np.diff(at)
    if not len(names) or not len(code):
        sums, sizes = np.zeros(len(counts)), np.zeros(len(counts))
    else:
        buckets, word = features(names)
        each, many = np.bincount(word, model.scores[buckets], len(names)), np.bincount(word, minlength=len(names))
        again = np.concatenate([[False], code[1:] == code[:-1]])
        again[at[:-1][counts > 0]] = False
        line = np.concatenate([[0], np.cumsum(each[code] + again * model.scores[SIZE - 2])])
        size = np.concatenate([[0], np.cumsum(many[code] + again)])
        sums, sizes = line[at[1:]] - line[at[:-1]], size[at[1:]] - size[at[:-1]]
    return 1 / (1 + np.exp(-((sums + model.scores[SIZE - 1]) / (sizes + 1) + model.bias)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` labelled rows, those whose ids have the least hashes; None without any. What the driver gets
    of each is its hashed counts, not its text.

    A document with several labels has the least of them; rows without text, id or label are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = examples(part.column(0))
                place = pd.util.hash_array(part.column(0).to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64)
                lists = [pa.array([r[k] for r in found], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.float32()))]
                yield pa.RecordBatch.from_arrays([pa.array(place), part.column(1), *lists], ["place", "label", "ids", "shares"])

    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL").join(F.broadcast(known), "_id").select("_text", "_label")
    found = labelled.mapInArrow(counted, "place long, label int, ids array<int>, shares array<float>").toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(found.column("place").to_numpy().view(np.uint64), kind="stable")
    # Views of what was received, without a copy.
    views = [[x.values.to_numpy() for chunk in found.column(c).chunks for x in chunk] for c in ("ids", "shares")]
    labels_ = found.column("label").to_numpy()[order]
    return train([(views[0][i], views[1][i]) for i in order], [int(x > 0) for x in labels_])


def score_quality(docs: DataFrame, model: Model | None, *, text_col: str = "text", positive_from: float = 0.3) -> DataFrame:
    """All columns of `docs` with score and predicted, each replacing one of that name.

    score: probability of label 1 by the whole text; predicted: 1 from `positive_from`, else 0. Null texts count as
    empty ones, which get the score of no words; without a model all scores are 0.5. Repeated rows: a row each. No
    rows: no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inner = [f"_{i}" for i in range(len(kept))]  # names with a dot can't be mapped
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, inner, strict=True)))
    at = kept.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = np.full(part.num_rows, 0.5) if sent.value is None else scores(sent.value, part.column(at))
                columns = [*part.columns, pa.array(found, pa.float64()), pa.array((found >= positive_from).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*inner, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(score, f"{schema}, score double, predicted int").toDF(*kept, "score", "predicted")
