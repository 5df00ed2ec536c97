"""Languages of documents, as mixtures of letter n-gram models."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed letter trigrams; a model is so many counts a language.
BUCKETS = 1 << 15
#: Languages of a model at most: some 100 MB of counts.
MOST_LANGS = 200
LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters is a blank; bytes of other characters stand for themselves.
_PLAIN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_SHIFT = np.uint32(32 - 15)


def held_out(id_col: str, fold: int = 5) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text divides by `fold`. Not those without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == 0, F.lit(False))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, with a blank around it."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    mixed = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> _SHIFT


def train(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, from the counts over all rows with text and language.

    Counts are summed by Spark; the driver gets one number for each language and bucket, whatever the input's size. More
    than MOST_LANGS different languages are an error: a model is a dense row for each. Repeated rows count each; a long
    text counts whole; without rows there are no languages. Extra columns are not read.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if docs.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages in {lang_col}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if name not in sums:
                        sums[name] = np.zeros(BUCKETS, np.int64)
                    if LETTER.search(text):
                        sums[name] += np.bincount(trigrams(text), minlength=BUCKETS)
        for name, sum_ in sums.items():
            some = np.flatnonzero(sum_)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(sum_[some], pa.int64())], ["lang", "bucket", "n"])

    rows = known.select(F.col(lang_col).cast("string"), text_col)
    table = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {name: i for i, name in enumerate(langs)}
    counts = np.full((len(langs), BUCKETS), 0.1)
    counts[[place[n] for n in names], table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return langs, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def mixture(weights: np.ndarray, chances: np.ndarray, rounds: int = 25, penalty: float = 4.0) -> tuple[dict[int, float], np.ndarray]:
    """Language -> proportion for one document, and each language's log-likelihood alone.

    `weights`: counts of the document's distinct trigrams; `chances`: (languages, trigrams) probabilities. Starting
    from the likeliest language, that language is added whose mixture, fitted by expectation-maximisation, is
    likeliest, as long as the log-likelihood gains more than `penalty` * log(1 + trigrams).
    """
    alone = np.log(chances) @ weights
    total = weights.sum()
    chosen, shares = [int(alone.argmax())], np.ones(1)
    fit, price = alone.max(), penalty * np.log1p(total)
    while len(chosen) < len(chances):
        now = shares @ chances[chosen]
        # The likelihood is concave in the share of a language to add, so its slope at 0 bounds what is gained.
        slopes = (chances / now) @ weights - total
        slopes[chosen] = -np.inf
        best = None
        for new in np.flatnonzero(slopes > price):
            among = chances[[*chosen, new]]
            part = np.append(shares * 0.7, 0.3)
            for _ in range(rounds):
                part = part * (among @ (weights / (part @ among))) / total
            gained = np.log(part @ among) @ weights
            if best is None or gained > best[0]:
                best = (gained, int(new), part)
        if best is None or best[0] - fit <= price:
            break
        fit, shares = best[0], best[2]
        chosen.append(best[1])
    return {lang: float(share) for lang, share in zip(chosen, shares, strict=True)}, alone


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", set_col: str = "lang_set"
) -> DataFrame:
    """All columns of `docs` with lang_pred, score and lang_set (language -> proportion), named `pred_col`, `score_col` and
    `set_col`, each replacing one of that name; other columns stay, whatever their names.

    lang_pred has the largest proportion; score is that proportion times the language's probability among those of the
    set and the likeliest other. Null texts and texts without a letter: lang_pred `und`, score 0, an empty set; so are
    all if nothing was learned. Whole texts of any length count. Ties go to the language that sorts first. Repeated
    rows: a row each. No rows: no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in (pred_col.lower(), score_col.lower(), set_col.lower())]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inner = [f"_{i}" for i in range(len(kept))]  # names with a dot can't be mapped
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, inner, strict=True)))
    text_at = kept.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, chances = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores, sets = [], [], []
                for text in part.column(text_at).to_pylist():
                    if not langs or text is None or not LETTER.search(text):
                        found, alone = {}, None
                    else:
                        counts = np.bincount(trigrams(text), minlength=BUCKETS)
                        some = np.flatnonzero(counts)
                        found, alone = mixture(counts[some].astype(np.float64), chances[:, some].astype(np.float64))
                    if not found:
                        names.append("und")
                        scores.append(0.0)
                    else:
                        top = max(found, key=lambda k: (found[k], -k))
                        others = [alone[k] for k in range(len(langs)) if k not in found]
                        odds = np.exp(min(0.0, max(others) - max(alone[k] for k in found))) if others else 0.0
                        names.append(langs[top])
                        scores.append(min(1.0, found[top] / (1 + odds)))
                    sets.append([(langs[k], v) for k, v in found.items()])
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*inner, "pred", "score", "set"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(predict, f"{schema}, pred string, score double, set map<string, double>").toDF(*kept, pred_col, score_col, set_col)
